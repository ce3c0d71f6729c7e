"""Commands: tile, mvt, build, serve, info."""

from __future__ import annotations

import argparse
import logging
import sys

from ..functions.boxes import human_size, parse_size

#: Options of the public functions by command: flag -> what argparse is told.  Names are those of the functions' parameters.
_TILING = {
    "--partition-size": {"type": parse_size, "metavar": "SIZE"},
    "--covering-bbox": {"action": argparse.BooleanOptionalAction, "default": False},
    "--geojson-executor": {"default": "process", "choices": ["process", "thread"]},
    "--orchestrator": {"default": "two-stage", "choices": ["round", "two-stage"]},
}
_TILE = {
    "--sort": {"default": "zorder", "choices": ["zorder", "hilbert", "columns", "none"]},
    "--compression": {"default": "zstd"},
    "--sample-cap": {"type": int, "default": 10_000},
    "--sample-ratio": {"type": float, "default": 1.0},
    "--seed": {"type": int, "default": 42},
    "--geom-col": {"default": "geometry"},
    "--sfc-bits": {"type": int, "default": 16},
    "--max-parallel-files": {"type": int, "default": 64},
    "--two-stage-executor": {"default": "process", "choices": ["process", "thread"]},
    "--two-stage-assignment-workers": {"type": int},
    "--two-stage-write-workers": {"type": int},
    "--two-stage-reducers": {"type": int},
    "--temp-dir": {},
}
_COMMANDS = {
    "tile": {"--input": {"required": True}, "--outdir": {"required": True}, **_TILING, **_TILE},
    "build": {
        "--input": {"required": True},
        "--outdir": {"required": True},
        **_TILING,
        "--zoom": {"type": int, "default": 7},
        "--threshold": {"type": float, "default": 100_000},
        "--pmtiles": {"action": "store_true"},
        "--pmtiles-compression": {"default": "gzip", "choices": ["gzip", "brotli", "zstd", "none"]},
    },
    "mvt": {"--dir": {"required": True}, "--zoom": {"type": int, "default": 7}, "--threshold": {"type": float, "default": 0}, "--outdir": {}, "--no-auto-zoom": {"action": "store_true"}},
    "serve": {"--dir": {"required": True}, "--host": {"default": "0.0.0.0"}, "--port": {"type": int, "default": 8765}, "--cache-size": {"type": int, "default": 256}},
    "info": {"--dir": {"required": True}},
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tesserae")
    sub = top.add_subparsers(dest="command", required=True)
    for name, options in _COMMANDS.items():
        p = sub.add_parser(name)
        for flag, about in options.items():
            p.add_argument(flag, **about)
        if name != "info":
            p.add_argument("--log-level", default="INFO")
    return top


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    command = args.pop("command")
    logging.basicConfig(level=args.pop("log_level", "INFO").upper())
    from ..sources import files
    from . import api

    if command == "tile":
        print(api.tile(**args))
    elif command == "build":
        print(*api.build(**args), sep="\n")
    elif command == "mvt":
        print(api.generate_mvt(args["dir"], zoom=args["zoom"], threshold=args["threshold"], outdir=args["outdir"], auto_zoom=not args["no_auto_zoom"]))
    elif command == "serve":
        from .server import serve

        serve(args["dir"], args["host"], args["port"], args["cache_size"])
    else:
        ds = api.Dataset(args["dir"])
        size = sum(files.size(f) for f, folder in files.listing(args["dir"], recursive=True) if not folder)
        print(f"tiles {ds.num_tiles}, {human_size(size)}, bounds {ds.bbox}, zooms {ds.zoom_levels}, statistics {ds.has_stats}, histograms {ds.has_histograms}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
