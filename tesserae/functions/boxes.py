"""Bounding-box predicates and small text functions as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERNAL_COLUMNS = ("_tile_id", "_sfc", "_bbox_xmin", "_bbox_ymin", "_bbox_xmax", "_bbox_ymax")


@dataclass(frozen=True)
class Box:
    """A closed box; inverted sides are swapped."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float

    def __post_init__(self) -> None:
        for low, high in (("xmin", "xmax"), ("ymin", "ymax")):
            a, b = getattr(self, low), getattr(self, high)
            object.__setattr__(self, low, min(a, b))
            object.__setattr__(self, high, max(a, b))

    @classmethod
    def parse(cls, text: str) -> Box:
        """From "minx,miny,maxx,maxy"; anything else is a ValueError."""
        parts = [float(p) for p in text.split(",")]
        if len(parts) != 4:
            raise ValueError(f"a box is four numbers, not {text!r}")
        return cls(*parts)

    def intersects(self, other: Box) -> bool:
        return self.xmax >= other.xmin and self.xmin <= other.xmax and self.ymax >= other.ymin and self.ymin <= other.ymax

    def contains(self, x: float, y: float) -> bool:
        return self.xmin <= x <= self.xmax and self.ymin <= y <= self.ymax

    def merge(self, other: Box) -> Box:
        return Box(min(self.xmin, other.xmin), min(self.ymin, other.ymin), max(self.xmax, other.xmax), max(self.ymax, other.ymax))

    @property
    def area(self) -> float:
        return (self.xmax - self.xmin) * (self.ymax - self.ymin)

    @property
    def margin(self) -> float:
        return (self.xmax - self.xmin) + (self.ymax - self.ymin)

    @property
    def is_empty(self) -> bool:
        return self.xmax <= self.xmin or self.ymax <= self.ymin

    def overlap(self, other: Box) -> float:
        return max(0.0, min(self.xmax, other.xmax) - max(self.xmin, other.xmin)) * max(0.0, min(self.ymax, other.ymax) - max(self.ymin, other.ymin))


def intersects(box: Box, xmin: str | Column = "_bbox_xmin", ymin: str | Column = "_bbox_ymin", xmax: str | Column = "_bbox_xmax", ymax: str | Column = "_bbox_ymax") -> Column:
    """Four comparisons on plain columns, which Parquet readers use to skip row groups. Touching counts."""
    c = [F.col(n) if isinstance(n, str) else n for n in (xmin, ymin, xmax, ymax)]
    return (c[2] >= box.xmin) & (c[0] <= box.xmax) & (c[3] >= box.ymin) & (c[1] <= box.ymax)


def contains_point(box: Box, x: Column, y: Column) -> Column:
    return x.between(box.xmin, box.xmax) & y.between(box.ymin, box.ymax)


def parse_box(text: Column) -> Column:
    return F.split(text, ",").cast("array<double>")


def display_name(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def mime_type(fmt: Column) -> Column:
    return F.when(fmt == "csv", "text/csv").when(fmt == "geojson", "application/geo+json").otherwise("application/octet-stream")


def search_names(name: Column, wanted: str) -> Column:
    """Case-insensitive substring."""
    return F.contains(F.lower(name), F.lit(wanted.lower()))


def parse_size(raw: str) -> int:
    """Bytes of "123", "1.5kb", "2 MB", "1gb", "1tb" (steps of 1024)."""
    text = raw.strip().lower()
    if text.isdigit():
        return int(text)
    for power, unit in enumerate(("kb", "mb", "gb", "tb"), 1):
        if text.endswith(unit):
            return int(float(text[:-2]) * 1024**power)
    raise ValueError(f"no size: {raw!r}")


def human_size(n: int) -> str:
    for unit, power in (("GB", 3), ("MB", 2), ("KB", 1)):
        if n >= 1024**power:
            return f"{n / 1024**power:.1f} {unit}"
    return f"{n} B"
