"""Token-id files: patched frame-of-reference blocks.

A file is a row of segments; a segment holds the ids of consecutive documents
in blocks of ``BLOCK`` ids. Each block subtracts its minimum and packs the rest
at the width that a percentile of its values needs; larger values go to the
exception lists. An index has the block starts, so any block is decoded alone.

Files are written in ascending order of document id by a range partitioning
(one file a partition, written by Spark's committer into the shared folder),
and a document's global start is the sum of the files before it, the start of
its segment and its place there: nothing but one total a file meets anywhere.

Defined results: null text counts as empty; a null id sorts first; rows with
the same id follow each other in the order in which the table is read, so their
starts follow its layout; texts of any length are written whole, each in one
segment; an empty table gives an empty one.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, small_batches, written
from .pieces import library_encoder

BLOCK = 128
#: Share of a block's values that must fit the packed width.
PERCENTILE = 0.9
#: Stored text of a file, about.
FILE_BYTES = 32 << 20
#: A segment is closed once it has so many ids; documents are never cut.
SEGMENT_IDS = 1 << 18
_MAGIC = b"PFR1"


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Encode unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    values = np.zeros((blocks, BLOCK), np.uint32)
    if n:
        values.reshape(-1)[:n] = ids
        values.reshape(-1)[n:] = ids[-1]
    low = values.min(1) if blocks else np.zeros(0, np.uint32)
    rest = values - low[:, None]
    at = max(0, int(np.ceil(percentile * BLOCK)) - 1)
    bound = np.partition(rest, at, 1)[:, at] if blocks else low
    width = np.ceil(np.log2(bound.astype(np.float64) + 1)).astype(np.uint8)
    over = rest > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None]
    size = width.astype(np.int64) * (BLOCK // 8)
    start = np.concatenate([[0], np.cumsum(size)])
    data = np.zeros(start[-1], np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            bits = np.unpackbits(rest[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, count=int(w), bitorder="little")
            packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
            data[start[rows][:, None] + np.arange(packed.shape[1])] = packed
    where = np.nonzero(over)
    parts = [struct.pack("<4sQII", _MAGIC, n, blocks, len(where[0])), low.astype("<u4"), width, over.sum(1).astype("<u2"), start.astype("<u8"), where[1].astype(np.uint8), rest[where].astype("<u4"), data]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class Packed:
    """Reads a packed run of ids, whole or block by block."""

    def __init__(self, raw: bytes):
        magic, self.n, blocks, exceptions = struct.unpack_from("<4sQII", raw)
        if magic != _MAGIC:
            raise ValueError("no packed ids")
        at = 20
        read = []
        for kind, count in (("<u4", blocks), ("u1", blocks), ("<u2", blocks), ("<u8", blocks + 1), ("u1", exceptions), ("<u4", exceptions)):
            read.append(np.frombuffer(raw, kind, count, at))
            at += read[-1].nbytes
        self.low, self.width, count, self.start, self.place, self.value = read
        self.first = np.concatenate([[0], np.cumsum(count.astype(np.int64))])
        self.data = np.frombuffer(raw, np.uint8, int(self.start[-1]), at)

    def blocks(self, which: np.ndarray) -> np.ndarray:
        """The ids of some blocks, a row each (the last block padded)."""
        out = np.zeros((len(which), BLOCK), np.uint32)
        width = self.width[which]
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w:
                size = int(w) * (BLOCK // 8)
                raw = self.data[self.start[which[rows]].astype(np.int64)[:, None] + np.arange(size)]
                bits = np.zeros((len(rows), BLOCK, 32), np.uint8)
                bits[:, :, : int(w)] = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
                out[rows] = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
        many = self.first[which + 1] - self.first[which]
        row = np.repeat(np.arange(len(which)), many)
        at = np.repeat(self.first[which], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        out[row, self.place[at]] = self.value[at]
        return out + self.low[which][:, None]

    def all(self) -> np.ndarray:
        """All ids."""
        return self.blocks(np.arange(len(self.low))).reshape(-1)[: self.n]


def file_count(docs: DataFrame, file_bytes: int) -> int:
    """Files for a table by the size the planner knows of its files; where it knows none, by a thousand rows each."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return -(-size // file_bytes) if size < 1 << 60 else docs.count() // 1000 + 1


def write_files(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode and write all documents in order of id; returns the files as a table.

    A file holds about ``file_bytes`` of stored text, but there are no fewer
    files than the session has shuffle partitions. Rows of one id are split like others.

    Columns: ``file`` (ascending with the ids), ``segment``, ``start`` (ids of
    the same file before the segment), ``n_ids``, ``doc_ids``, ``lengths``,
    ``image`` (the packed ids).
    """
    spark = docs.sparkSession
    small_batches(spark)
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), file_count(docs, file_bytes))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("k"), text.alias("t")).withColumn("at", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(files, "k", "at").sortWithinPartitions("k", "at").select("k", "t")
    schema = "file int, segment int, start long, n_ids long, doc_ids array<long>, lengths array<long>, image binary"
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    names = ["file", "segment", "start", "n_ids", "doc_ids", "lengths", "image"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()
        part, encoder = TaskContext.get().partitionId(), library_encoder(tokenizer_path)
        end = array("I", [] if end_id is None else [end_id]).tobytes()
        keys: list = []
        held: list[bytes] = []
        state = {"segment": 0, "start": 0}

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), np.uint32)
            row = (part, state["segment"], state["start"], len(ids), list(keys), [len(x) // 4 for x in held], pack(ids))
            state["segment"] += 1
            state["start"] += len(ids)
            keys.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1)), strict=True):
                keys.append(k)
                held.append(ids + end)
                if sum(map(len, held[-1:])) + state.get("size", 0) >= 4 * SEGMENT_IDS:
                    state["size"] = 0
                    yield closed()
                else:
                    state["size"] = state.get("size", 0) + len(held[-1])
        if held:
            yield closed()

    return written(dealt.mapInArrow(run, schema), "token-files")


def read_files(table: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, global ``start``, ``n_tokens``, ``ids_crc32``."""
    small_batches(table.sparkSession)
    totals = table.groupBy("file").agg(F.sum("n_ids").alias("n"))  # one row a file
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = F.broadcast(totals.select(F.col("file").alias("f"), before.alias("base")))
    own = table.select("file", "start", "doc_ids", "lengths", "image")
    schema = f"file int, `{id_col}` long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start, keys, lengths, image in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, size = Packed(image).all().astype("<u4"), np.array(lengths, np.int64)
                ends = np.cumsum(size)
                crc = [zlib.crc32(ids[e - s : e]) for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(start + ends - size), pa.array(size), pa.array(crc, pa.int64())], names=["file", id_col, "start", "n_tokens", "ids_crc32"])

    read = own.mapInArrow(run, schema)
    return read.join(base, read["file"] == base["f"]).select(id_col, (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
