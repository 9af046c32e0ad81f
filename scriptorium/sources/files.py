"""Files to units: bytes in, rows of (unit, locator, text, engine, error) out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from . import office, pdf

UNITS = "unit int, locator string, text string, engine string, error string"
#: Files and bytes that a worker gets at once; a longer file comes alone.
BATCH_FILES, BATCH_BYTES = 64, 8 << 20


def read_folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files of a folder (``path``, ``content``); the content is read only where it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def read_units(data: bytes | None, engine: str = "auto") -> tuple[list[tuple[str, str]], str, str | None]:
    """Units of one file, what read them, and why there are none. A page is ``S. n``."""
    data = data or b""
    try:
        if data[:4] == b"%PDF":
            found, by = pdf.pages(data, engine)
            return [(f"S. {n}", t) for n, t in enumerate(found, 1)], by, None
        found, by = office.units(data)
        return found, by, None
    except pdf.Scanned as fault:
        return [], "scan", str(fault)
    except pdf.Unreadable as fault:
        return [], "", str(fault)


def small_batches(spark: SparkSession) -> None:
    """Bound what a worker gets at once; a session that is stricter stays so."""
    for key, most in (("maxRecordsPerBatch", BATCH_FILES), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def extract_units(files: DataFrame, *, content_col: str = "content", engine: str = "auto") -> DataFrame:
    """A row a unit, beside the file's other columns; a file that cannot be read gives one row with its ``error``.

    A null content is an unreadable file. A worker holds one file at a time.
    """
    small_batches(files.sparkSession)
    rest = [c for c in files.columns if c != content_col]
    source = files.select(*rest, F.col(content_col).cast("binary"))
    schema = StructType([*files.select(*rest).schema.fields, *StructType.fromDDL(UNITS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found, by, error = read_units(b.column(len(rest))[i].as_py(), engine)
                rows = [(n, place, text, by, None) for n, (place, text) in enumerate(found, 1)] or [(None, None, None, by, error)]
                own = [c.take(pa.array([i] * len(rows))) for c in b.columns[: len(rest)]]
                kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=schema.names)

    return source.mapInArrow(run, schema)


def unit_documents(units: DataFrame, floor: int = 15) -> DataFrame:
    """Units worth indexing: their text collapsed, those under the floor left out."""
    return units.filter(F.col("error").isNull()).withColumn("text", T.collapse("text")).filter(T.size("text") >= floor)


def scans(units: DataFrame, *, key: str = "path", floor: int = 15) -> DataFrame:
    """Files to be read by eye: scanned PDFs (``pages`` null: all), and those with pages under the floor (their numbers)."""
    short = units.filter(F.col("error").isNull() & F.col("locator").startswith("S. ") & (T.size(T.collapse("text")) < floor))
    some = short.groupBy(key).agg(F.array_sort(F.collect_list("unit")).alias("pages"))
    whole = units.filter(F.col("engine") == "scan").select(key, F.lit(None).cast("array<int>").alias("pages"))
    return some.unionByName(whole)
