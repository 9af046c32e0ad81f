"""Best-fit-decreasing packing of token sequences, exact at any input size.

Lengths are whole numbers up to the sequence size, so pieces of one length are
alike and best-fit decreasing may run on the histogram of lengths: a segment
tree over remaining capacities finds the tightest open bins in logarithmic
time, and all bins of equal content form one range of numbers. That plan has a
size bounded by the sequence size, not by the input. Each piece then finds its
place from its length and its rank among pieces of that length; the rank is its
rank in its partition plus the counts of the partitions before it, so neither
the driver nor a single task ever holds the pieces.

Defined results: null text counts as empty and gives a piece of the end id
alone; null ids are packed like others; a text of any length is encoded whole
and then cut into pieces; repeated rows are packed as often as they occur; equal lengths are
ranked by partition and place; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import extended, give_back, small_batches, written
from .pieces import AT_ONCE, MEMO, library_encoder

SEQUENCE = 1024


class CapacityTree:
    """Segment tree over remaining capacities: bins open at each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        """Open (or close) bins with this capacity left."""
        i = capacity + self.leaves
        while i:
            self.open[i] += bins
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open bin has."""
        i = least + self.leaves
        if self.open[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def plan(histogram: dict[int, int], capacity: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over ``{length: pieces}``.

    Returns runs (length, first rank, end rank, first bin, pieces a bin, offset):
    pieces of ranks in the run go to consecutive bins, so many into each.
    """
    tree = CapacityTree(capacity)
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
    bins, runs = 0, []

    def give(left: int, first: int, n: int) -> None:
        if n and left:
            ranges[left].append((first, n))
            tree.add(left, n)

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        while rank < count:
            left = tree.tightest(length)
            if left is None:
                left, first, n = capacity, bins, -(-(count - rank) // (capacity // length))
                bins += n
            else:
                first, n = ranges[left].pop()
                tree.add(left, -n)
            each = left // length
            full = min(n, (count - rank) // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, capacity - left))
                rank += full * each
                give(left - each * length, first, full)
            rest = min(count - rank, each) if full < n else 0
            if rest and rank < count:
                runs.append((length, rank, rank + rest, first + full, rest, capacity - left))
                rank += rest
                give(left - rest * length, first + full, 1)
                full += 1
            give(left, first + full, n - full)
    return runs


def pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = SEQUENCE, memo: int = MEMO, at_once: int = AT_ONCE) -> DataFrame:
    """Cut encoded documents into pieces; written, with each piece's partition and rank there.

    ``memo`` and ``at_once`` bound what a worker holds (see ``pieces``): results are the same.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = extended(docs.select(F.col(id_col).alias("_id")), "piece int, start long, length long, ids_crc32 long, part long, place long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()
        part, encoder, seen = TaskContext.get().partitionId(), library_encoder(tokenizer_path, memo, at_once), Counter()
        end = array("I", [end_id]).tobytes()
        for b in batches:
            rows, source = [], []
            for i, raw in enumerate(encoder.encode(b.column(1))):
                ids = raw + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((k, a, z - a, zlib.crc32(ids[4 * a : 4 * z]), part, seen[z - a]))
                    seen[z - a] += 1
                    source.append(i)
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(columns))], names=schema.names)

    return written(docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema), "pieces")


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = SEQUENCE, memo: int = MEMO, at_once: int = AT_ONCE) -> DataFrame:
    """Per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    cut = pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, end_id=end_id, capacity=capacity, memo=memo, at_once=at_once)
    counts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    runs = sorted(plan(histogram, capacity))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(counts.select("part", "length", before.alias("before")), ["part", "length"]).withColumn("rank", F.col("place") + F.col("before"))
    shipped = docs.sparkSession.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 6))
    out = ["piece", "start", "length", "ids_crc32"]
    source = ranked.select(F.col("_id").alias(id_col), *out, "rank")
    schema = extended(source.drop("rank"), "sequence_id long, offset long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        table = shipped.value
        keys = table[:, 0] * (1 << 40) + table[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            run = table[np.searchsorted(keys, length * (1 << 40) + rank, side="right") - 1]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(run[:, 3] + nth // run[:, 4]), pa.array(run[:, 5] + nth % run[:, 4] * length)], names=schema.names)

    return source.mapInArrow(place, schema)
