"""A catalog of datasets: descriptors from statistics, embeddings, cosine search, upserts."""

from __future__ import annotations

import hashlib
import math
import re
from abc import ABC, abstractmethod

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MAX_ATTRIBUTES, MAX_VALUES, TINY = 120, 8, 1e-12


class TextEmbedder(ABC):
    """What turns texts into vectors; remote services are plugged in here."""

    dimensions: int

    @abstractmethod
    def embed(self, text: str) -> list[float]: ...

    def embed_query(self, text: str) -> list[float]:
        """Services that treat queries and documents differently override this."""
        return self.embed(text)

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]


class HashingEmbedder(TextEmbedder):
    """Signed hashed words and word pairs: deterministic and offline."""

    def __init__(self, dimensions: int = 256) -> None:
        self.dimensions = dimensions

    def embed(self, text: str) -> list[float]:
        words = re.findall(r"\w+", text.lower())
        out = [0.0] * self.dimensions
        for token in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
            h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
            out[(h >> 1) % self.dimensions] += 1.0 if h & 1 else -1.0
        size = math.sqrt(sum(v * v for v in out))
        return [v / size for v in out] if size else out


def embedded(df: DataFrame, text: str, embedder: TextEmbedder, into: str = "embedding") -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed_documents([x or "" for x in t]), dtype=object)

    return df.withColumn(into, run(text))


def norm(v: Column) -> Column:
    """Of the components there are."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double") * x.cast("double"), F.lit(0.0))))


def l2_normalised(v: Column, zero: float = 0.0) -> Column:
    """Missing components stay missing; those of a zero vector become ``zero``."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(x.isNull(), F.lit(None).cast("double")).when(n == 0, F.lit(zero)).otherwise(x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / F.greatest(norm(a) * norm(b), F.lit(TINY))


def nearest(df: DataFrame, query: list[float], k: int, *, key: str, vector: str = "embedding") -> DataFrame:
    """The k rows of largest cosine, ties by key: a top-k in every partition, merged once."""
    q = F.lit([float(v) for v in query])
    return df.withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc("score"), key).limit(max(1, k))


def catalog(spark, root: str, backend: str = "auto", jdbc: dict | None = None) -> DataFrame:
    """The catalog table of a backend: files below ``root``, or a database table; auto takes the
    database if there are options for it."""
    from ..sources import files

    backend = backend.lower()
    if backend not in ("auto", "npy", "jdbc"):
        raise ValueError(f"backend {backend!r}")
    if backend == "jdbc" or (backend == "auto" and jdbc):
        if not jdbc:
            raise ValueError("a database needs its reader's options")
        return spark.read.format("jdbc").options(**jdbc).load().withColumn("embedding", F.from_json(F.col("embedding").cast("string"), "array<float>"))
    if not files.is_dir(f"{root}/_catalog"):
        raise FileNotFoundError(f"{root}/_catalog")
    return spark.read.parquet(f"{root}/_catalog")


def upsert(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Last write wins by (version, then the changes before the table)."""
    both = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    n = F.row_number().over(W.partitionBy(key).orderBy(F.desc(version), F.desc("__new")))
    return both.withColumn("__n", n).filter("__n = 1").drop("__n", "__new")


def attribute_kind(stats: dict) -> str:
    if "mbr" in stats:
        return "geometry"
    if "mean" in stats:
        return "numeric"
    if "avg_length" in stats:
        return "categorical_text" if (stats.get("approx_distinct") or 0) <= 50 else "text"
    return "categorical"


def describe(name: str, profile: dict, description: str | None = None, most: int = MAX_ATTRIBUTES) -> dict:
    """{"dataset", "text", "summary"} from a dataset's statistics."""
    lines = [f"Dataset: {name.replace('_', ' ').title()}"] + ([f"Description: {description}"] if description else [])
    geometry, attributes = [], []
    for a in profile.get("attributes", []):
        s, kind = a.get("stats", {}), attribute_kind(a.get("stats", {}))
        if kind == "geometry":
            types = ", ".join(f"{t} ({n})" for t, n in sorted((s.get("geom_types") or {}).items()))
            geometry.append(f"Geometry: {types or 'none'}; bounds {s.get('mbr')}; {s.get('total_points', 0)} points")
        else:
            attributes.append((a["name"], kind, s))
    rows, summary = [], []
    for attribute, kind, s in attributes[:most]:
        values = [str(v["value"]) for v in s.get("top_k") or []][:MAX_VALUES]
        parts = [f"{attribute} ({kind})", f"{s.get('non_null_count', 0)} values, {s.get('approx_distinct', 0)} distinct"]
        if kind == "numeric":
            parts.append(f"from {s.get('min')} to {s.get('max')}, mean {s.get('mean')}")
        if values:
            parts.append("such as " + ", ".join(values))
        rows.append("- " + "; ".join(parts))
        summary.append({"name": attribute, "role": kind, "top_values": values})
    return {"dataset": name, "text": "\n".join(lines + geometry + ["Attributes:"] + rows), "summary": {"attributes": summary, "geometry": geometry}}
