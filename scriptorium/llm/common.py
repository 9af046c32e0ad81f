"""What the operators of this subpackage share: reading, the shared scratch folder, folds.

Every operator takes a DataFrame, selects the columns it needs by name, and so
ignores any further columns whatever they are called.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes an Arrow batch holds at most; a row that is longer comes alone.
BATCH_ROWS = 1024
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once: texts and byte arrays are long.

    The bounds are the same for all operators, as a session keeps them.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` where the cluster names one. Only a local
    session (one machine, as in tests) may fall back on a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="scriptorium-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    This cuts lineage in a way that survives the loss of executors, and fixes
    what a later join would otherwise compute twice.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    out = df.write.mode("errorifexists")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    del df, out
    spark.sparkContext._jvm.System.gc()  # shuffle files go when the driver lets go of their stages
    back = spark.read.schema(schema).parquet(path)
    back._written_to = path
    return back


def path_of(table: DataFrame) -> str:
    """Where :func:`written` put a table."""
    return table._written_to


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of this session's."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Delete a table of :func:`written` that nothing reads any more."""
    remove(table.sparkSession, path_of(table))


def give_back() -> None:
    """Return what this worker has freed to the system: a worker is kept for further tasks, and so is its heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id is in no held-out fold (-1)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def hash_share(column: str, salt: int) -> Column:
    """A number in [0, 1) that depends on the value alone."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with the columns of ``ddl`` behind."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
