"""WARC files and a Merkle audit of their replicas.

``write_warc`` writes pages as WARC response records to gzipped files of about
``FILE_BYTES`` in order of their key; a record may make a file longer, never
less than whole. Spark's text writer does it with the end of a record as line
separator, so a lost executor costs its tasks only. ``read_warc`` parses files
to records with their byte ranges (in the unpacked file), digests and faults:
a record whose head, length or end is wrong is told with an error, and reading
goes on at the next head.

``audit`` builds, for each file of two replicas, a tree whose leaves hash the
records' digests and ranges and whose inner nodes hash the ordered offset
ranges and hashes of their ``FAN`` children. Roots are compared first; only the
children of nodes that differ are looked at on the next level, down to the
records. Leaves and nodes are made by built-in functions. ``diagnosed`` then
tells damaged records from those that are lost, new or only moved.

Defined results: a null address or page counts as empty; a null key sorts
first and is null again when read; equal rows give equal records, split over
files like all others; pages of any length are whole records; further columns
are passed over; empty tables have no files and differ nowhere; a record that
one replica lacks has null hash and range there.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, written

FAN = 16
FILE_BYTES = 32 << 20
_END = "\r\n\r\n"


def record(key: Column, url: Column, html: Column) -> Column:
    """A WARC response record as text, without its end."""
    url, html, key = (F.coalesce(c.cast("string"), F.lit("")) for c in (url, html, key))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html)
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), key, F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "))
    return F.concat(head, F.octet_length(http).cast("string"), F.lit("\r\n\r\n"), http)


def _store(rows: DataFrame, path: str | None) -> str:
    """Write rows (``file``, ``value``), sorted by file and place, to a folder a file; a value is a record without its end."""
    path = path or f"{shared_dir(rows.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows.select("file", "value").write.partitionBy("file").option("lineSep", _END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)
    return path


def write_warc(pages: DataFrame, *, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None, file_bytes: int = FILE_BYTES) -> str:
    """Write pages as WARC files; returns the folder."""
    rows = pages.select(F.col(key_col).cast("long").alias("key"), record(F.col(key_col), F.col(url_col), F.col(html_col)).alias("value"))
    size = pages.agg(F.sum(F.octet_length(F.coalesce(F.col(html_col).cast("string"), F.lit(""))) + 300)).first()[0] or 0
    rows = rows.withColumn("at", F.monotonically_increasing_id())  # rows of one key may be split
    dealt = rows.repartitionByRange(max(1, -(-int(size) // file_bytes)), "key", "at")
    return _store(dealt.withColumn("file", F.spark_partition_id()).sortWithinPartitions("file", "key", "at"), path)


_LENGTH = re.compile(rb"\r\ncontent-length:\s*(\d+)\s*(?=\r\n|\Z)", re.IGNORECASE)
_ID = re.compile(rb"\r\nwarc-record-id:\s*<?([^>\r\n]*)", re.IGNORECASE)


def records(data: bytes) -> Iterator[tuple[int, int, str | None, str | None]]:
    """Start, length, id and fault of each record of an unpacked file."""
    at, end_mark = 0, _END.encode()
    while at < len(data):
        head = data.find(end_mark, at)
        told = data[at:head] if head >= 0 else b""
        size, name = _LENGTH.search(told), _ID.search(told)
        end = head + len(end_mark) * 2 + int(size[1]) if size else -1
        fault = None
        if not told.startswith(b"WARC/1."):
            fault = "no head"
        elif not size:
            fault = "no length"
        elif end > len(data):
            fault = "cut short"
        elif data[end - len(end_mark) : end] != end_mark:
            fault = "wrong length"
        if fault:
            further = data.find(end_mark + b"WARC/1.", at + 1)
            end = further + len(end_mark) if further >= 0 else len(data)
        yield at, end - at, name[1].decode("utf-8", "replace") if name else None, fault
        at = end


def unpacked(content: bytes) -> tuple[bytes, bool]:
    """A file's bytes, as far as they can be unpacked, and whether that is all."""
    try:
        return gzip.decompress(content), True
    except (OSError, EOFError, zlib.error):
        reader = zlib.decompressobj(31)
        try:
            return reader.decompress(content), False
        except zlib.error:
            return b"", False


def read_warc(spark: SparkSession, path: str, *, with_records: bool = False) -> DataFrame:
    """Rows (file, ordinal, offset, length, key, record_id, sha256, error[, record]) of the files under ``path``.

    A worker holds one file at a time.
    """
    small_batches(spark)
    names = ["file", "ordinal", "offset", "length", "key", "record_id", "sha256", "error", *(["record"] if with_records else [])]
    schema = "file int, ordinal long, offset long, length long, key long, record_id string, sha256 string, error string" + (", record binary" if with_records else "")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not [s for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at) if s.getPath().getName().startswith("file=")]:
        return spark.createDataFrame([], schema)
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    source = source.select(F.regexp_extract("path", r"/file=(\d+)/", 1).cast("int").alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data, whole = unpacked(b.column(1)[i].as_py())
                rows = []
                for n, (start, length, name, fault) in enumerate(records(data)):
                    page = re.fullmatch(r"urn:page:(-?\d+)", name or "")
                    rows.append((b.column(0)[i].as_py(), n, start, length, int(page[1]) if page else None, name, hashlib.sha256(data[start : start + length]).hexdigest(), fault or (None if whole else "file cut short")))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                for a in range(0, len(rows), 4096):
                    part = rows[a : a + 4096]
                    arrays = [pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)]
                    if with_records:
                        arrays.append(pa.array([data[r[2] : r[2] + r[3]] for r in part], pa.binary()))
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, schema)


def leaves(replica: DataFrame, name: str) -> DataFrame:
    """Leaf nodes: (replica, file, idx, start, end, hash)."""
    return replica.select(F.lit(name).alias("replica"), "file", F.col("ordinal").alias("idx"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), F.sha2(F.concat(F.lit("\0"), "sha256"), 256).alias("hash"))


def parents(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """The next level: each node hashes at most ``fan`` children in order."""
    child = F.struct("idx", "start", "end", "hash")
    grouped = nodes.groupBy("replica", "file", F.floor(F.col("idx") / fan).cast("long").alias("up")).agg(F.array_sort(F.collect_list(child)).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["start"], x["end"], x["hash"])), ",")
    return grouped.select("replica", "file", F.col("up").alias("idx"), F.get("c", F.lit(0))["start"].alias("start"), F.element_at("c", -1)["end"].alias("end"), F.sha2(F.concat(F.lit("\1"), text), 256).alias("hash"))


def _differing(nodes: DataFrame) -> DataFrame:
    side = lambda r: nodes.filter(F.col("replica") == r).select("file", "idx", F.struct("start", "end", "hash").alias(r))
    return side("a").join(side("b"), ["file", "idx"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))


def audit(a: DataFrame, b: DataFrame, *, fan: int = FAN) -> DataFrame:
    """The records that differ: (file, ordinal, and each replica's start, end and hash)."""
    level = written(leaves(a, "a").unionByName(leaves(b, "b")), "leaves")
    levels = [level]
    last = level.agg(F.max("idx")).first()[0] or 0
    while last > 0:
        level = written(parents(level, fan), "nodes")
        levels.append(level)
        last //= fan
    found = written(_differing(levels[-1]), "differing")
    for below in reversed(levels[:-1]):
        open_nodes = found.select("file", F.col("idx").alias("up"))
        children = below.withColumn("up", F.floor(F.col("idx") / fan).cast("long")).join(open_nodes, ["file", "up"], "left_semi").drop("up")
        found = written(_differing(children), "differing")
    return found.select("file", F.col("idx").alias("ordinal"), *[F.col(f"{r}.{x}").alias(f"{x}_{r}") for r in "ab" for x in ("start", "end", "hash")])


def diagnosed(found: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """What happened to the records that differ: (replica a's file and ordinal, record_id, ``what``).

    ``moved``: the same bytes at another place of the file; ``damaged``: the id is
    there with other bytes; ``lost``: it is not; ``new``: only the second replica has it.
    """
    touched = found.select("file").distinct()
    first = a.join(found.select("file", "ordinal"), ["file", "ordinal"], "left_semi").select("file", "ordinal", "record_id", "sha256")
    second = b.join(touched, "file", "left_semi").groupBy("file", "record_id").agg(F.collect_set("sha256").alias("digests"))  # copies of a record in one file
    told = first.join(second, first["record_id"].eqNullSafe(second["record_id"]) & (first["file"] == second["file"]), "left").select(first["file"], "ordinal", first["record_id"], F.when(F.col("digests").isNull(), "lost").when(F.array_contains("digests", F.col("sha256")), "moved").otherwise("damaged").alias("what"))
    known = a.join(touched, "file", "left_semi").select("file", "record_id").distinct()
    new = b.filter(F.col("error").isNull()).join(touched, "file", "left_semi").join(known, ["file", "record_id"], "left_anti").select("file", F.lit(None).cast("long").alias("ordinal"), "record_id", F.lit("new").alias("what"))
    return told.unionByName(new)


def copied(spark: SparkSession, path: str, *, damage: Column | None = None, lose: Column | None = None, to: str | None = None) -> str:
    """Store a second replica of the files under ``path``: records where ``damage`` holds have their last letter overwritten, those where ``lose`` holds are left out."""
    rows = read_warc(spark, path, with_records=True)
    if lose is not None:
        rows = rows.filter(~F.coalesce(lose, F.lit(False)))
    value = F.substring("record", F.lit(1), F.octet_length("record") - len(_END)).cast("string")
    last = F.right(value, F.lit(1))
    marred = F.concat(F.substring(value, F.lit(1), F.length(value) - 1), F.repeat(F.when(last == "X", "Y").otherwise("X"), F.octet_length(last)))
    rows = rows.withColumn("value", value if damage is None else F.when(F.coalesce(damage, F.lit(False)), marred).otherwise(value))
    return _store(rows.sortWithinPartitions("file", "ordinal"), to)
