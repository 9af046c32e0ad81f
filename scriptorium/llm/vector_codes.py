"""Compression of vectors to short codes: one codebook a part, filtered by segment means.

Components become integers. A vector is cut into equal parts, and each part is
named by its nearest codebook entry. To find it, parts and entries are summed up
coarse to fine: by the means of their blocks and by the norm of what the means
leave over. The distance of two such summaries never exceeds that of the parts
(Cauchy-Schwarz), so an entry whose summary lies farther than an exact distance
already known cannot be nearest. Each level drops entries so; the survivors get
exact integer distances. Codebooks are of fixed size; the driver holds them and
their sums and nothing else.

Defined results: rows whose vector is null or has a null or non-finite component
are left out. Entries begin with the smallest ids (null ids last, equal ids by
components), fewer where there are fewer rows. Repeated rows are coded each for
itself; equal distances go to the lower index. An empty table gives an empty
one. Vectors of different lengths, of a length that the parts do not divide, or
so large that a distance exceeds a long, raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, small_batches, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part: ``entries[part]`` is a matrix of a row an entry."""

    entries: np.ndarray

    def digest(self) -> str:
        """sha256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x): floor(scale * component) of the vectors that are whole, written to the shared folder."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    kept = vectors.filter(v.isNotNull() & finite).select(F.col(id_col).alias("vec_id"), label.alias("label"), v.alias("_v"))
    most = F.sqrt(F.lit(float(1 << 61)) / F.greatest(F.size("_v"), F.lit(1))) - 1  # 4 * size * most^2 is a long
    fits = F.forall(F.col("_v"), lambda c: F.abs(c * scale) < most)
    x = F.when(fits, F.transform("_v", lambda c: F.floor(c * scale))).otherwise(F.raise_error("a component is too large for distances in a long").cast("array<bigint>"))
    return written(kept.select("vec_id", "label", x.alias("x")), "vector-integers")


def train(table: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of :func:`integers`' table: the first entries, then rounds of assigning all parts and taking floors of their means."""
    small_batches(table.sparkSession)
    shortest, longest = table.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if shortest is None:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    if shortest != longest or longest % parts:
        raise ValueError(f"vectors of {shortest} to {longest} components do not make {parts} equal parts")
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # so many entries, no more
    books = np.array([r.x for r in first], np.int64).reshape(len(first), parts, longest // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _sums(table, books).collect():  # a row an entry
            books[r.part, r.entry] = [s // r.n for s in r.s]
    return Codebooks(books)


def _sums(table: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, s): how many parts go to an entry, and their sums by position."""
    shipped, width = table.sparkSession.sparkContext.broadcast(books), books.shape[2]
    columns = ["part", "entry", "n", *(f"s{i}" for i in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Nearest(b) for b in shipped.value]
        total = np.zeros((len(near), books.shape[1], 1 + width), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), len(near), width)
            for p, finder in enumerate(near):
                own, _ = finder.find(x[:, p])
                total[p, :, 0] += np.bincount(own, minlength=books.shape[1])
                np.add.at(total[p, :, 1:], own, x[:, p])
        at = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*at, *total[at].T)], names=columns)

    found = table.select("x").mapInArrow(run, ", ".join(f"{c} long" for c in columns))
    summed = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns[3:]))
    return summed.select("part", "entry", "n", F.array(*columns[3:]).cast("array<bigint>").alias("s"))


def _matrix(column: pa.Array, parts: int, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts, width)


class Nearest:
    """Nearest entries of one codebook, by bounds of segment means and exact distances."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        width = entries.shape[1]
        #: Cuts of each level's blocks: the whole part, then four times as many blocks a level.
        self.levels = [np.linspace(0, width, n + 1).astype(int)[:-1] for n in (1, 4, 16, 64) if n < width or n == 1] if width else []
        self.known = [self._summary(entries, cuts) for cuts in self.levels]

    @staticmethod
    def _summary(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Block means, each times the root of its block's length, and the norm of the rest."""
        lengths = np.diff([*cuts, x.shape[1]])
        means = np.add.reduceat(x, cuts, axis=1) / lengths
        rest = x - np.repeat(means, lengths, axis=1)
        return np.hstack([means * np.sqrt(lengths), np.sqrt((rest * rest).sum(1))[:, None]])

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of its nearest entry and their squared distance."""
        rows, k = len(x), len(self.entries)
        if not rows or not self.levels:
            return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        # what rounding may take from a distance of summaries, many times over
        slack = (np.abs(x).max(1) + np.abs(self.entries).max()) * x.shape[1] * 2.0**-44
        least = np.full(rows, np.inf)
        i = j = None
        for cuts, known in zip(self.levels, self.known, strict=True):
            own = self._summary(x, cuts)
            if i is None:  # all pairs of the first level, as a matrix
                low = sum((own[:, f, None] - known[None, :, f]) ** 2 for f in range(own.shape[1])).ravel()
                likely = low.reshape(rows, k).argmin(1)
            else:
                low = sum((own[:, f][i] - known[:, f][j]) ** 2 for f in range(own.shape[1]))
                likely = j[_first(low, np.searchsorted(i, np.arange(rows)))]
            least = np.minimum(least, np.sqrt(self._exact(x, np.arange(rows), likely).astype(float)))
            bar = (least + slack) ** 2 * (1 + 2.0**-40)
            if i is None:
                i, j = np.nonzero(low.reshape(rows, k) <= bar[:, None])
            else:
                left = np.flatnonzero(low <= bar[i])
                i, j = i[left], j[left]
        exact = self._exact(x, i, j)
        best = _first(exact, np.searchsorted(i, np.arange(rows)))
        return j[best], exact[best]

    def _exact(self, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        gap = x[i] - self.entries[j]
        return np.einsum("ij,ij->i", gap, gap)


def _first(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Place of the first least value of each group; groups begin at ``begins`` and none is empty."""
    least = np.repeat(np.minimum.reduceat(values, begins), np.diff([*begins, len(values)]))
    hits = np.flatnonzero(values == least)
    return hits[np.searchsorted(hits, begins)]


def encode(table: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of :func:`integers`' table: two hex digits a part, and the squared distance over all parts."""
    small_batches(table.sparkSession)
    shipped = table.sparkSession.sparkContext.broadcast(books.entries)
    schema = extended(table.select("vec_id", "label"), "code string, error long")
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Nearest(b) for b in shipped.value]
        for batch in batches:
            x = _matrix(batch.column(2), parts, width)
            found = [finder.find(x[:, p]) for p, finder in enumerate(near)]
            codes = np.stack([j for j, _ in found], 1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], names=schema.names)

    return table.select("vec_id", "label", "x").mapInArrow(run, schema)


def decode(codes: DataFrame, books: Codebooks, *, id_col: str = "vec_id", code_col: str = "code", scale: int = SCALE) -> DataFrame:
    """Per row: id and the vector that its code stands for (null for a null code)."""
    shipped = codes.sparkSession.sparkContext.broadcast(books.entries)
    schema = extended(codes.select(id_col), "vector array<double>")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries = shipped.value
        for f in frames:
            vectors = [None if c is None else np.concatenate([entries[p, e] for p, e in enumerate(bytes.fromhex(c))]) / scale for c in f[code_col]]
            yield pd.DataFrame({id_col: f[id_col], "vector": vectors})

    return codes.select(id_col, code_col).mapInPandas(run, schema)


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the error of all rows of the same label (nulls together); summed before it is joined, so a common label is no hot group."""
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["_label"])).drop("_label")
