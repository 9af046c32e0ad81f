"""Vector retrieval: cosine of a query set against all entries, floor, then top k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

BATCH = 64
FLOOR = 0.35


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length in double."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 if a length is 0; the longer vector is cut."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, 0.0).otherwise(_dot(a, b) / lengths)


def search(entries: DataFrame, queries: DataFrame, *, k: int = 4, floor: float = FLOOR) -> DataFrame:
    """``entries(course_ref, ord, vector)`` x ``queries(query_id, course_ref, vector)``: the best k at or over the floor.

    Joined on the course, so each query meets its own course's entries only.
    """
    double = lambda c: F.col(c).cast("array<double>")
    # a length belongs to a vector, not to a pair; one is divided by the other's in the pair, as cosine() has it
    e = entries.filter(F.col("vector").isNotNull()).select("course_ref", "ord", double("vector").alias("v")).withColumn("v_norm", norm(F.col("v")))
    q = queries.select("query_id", "course_ref", double("vector").alias("q")).withColumn("q_norm", norm(F.col("q")))
    lengths = F.col("q_norm") * F.col("v_norm")
    score = F.when(lengths == 0, 0.0).otherwise(_dot(F.col("q"), F.col("v")) / lengths)
    scored = e.join(q, "course_ref").withColumn("score", score).filter(F.col("score") >= floor)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "ord"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "course_ref", "ord", F.round("score", 4).alias("score"))


def in_order(data: list[dict]) -> list[list[float]]:
    """Vectors of a response's ``data`` by their ``index``: a server may answer in any order."""
    return [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]


def embedded(chunks: DataFrame, provider: Callable[[list[str]], list[list[float]]], *, batch: int = BATCH) -> DataFrame:
    """Chunks with a vector from ``provider``, called with ``batch`` texts at a time; it may give :func:`in_order`'s input."""
    schema = StructType([*chunks.schema.fields, StructField("vector", ArrayType(DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[list[float]] = []
            for a in range(0, len(f), batch):
                texts = f["text"].iloc[a : a + batch].tolist()
                got = provider(texts)
                got = in_order(got) if got and isinstance(got[0], dict) else got
                if len(got) != len(texts):
                    raise RuntimeError(f"{len(got)} vectors for {len(texts)} texts")
                out += got
            yield f.assign(vector=out)

    return chunks.mapInPandas(run, schema)
