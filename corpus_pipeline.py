"""The corpus pipeline: four stages, each over all that the one before it kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
and its result is written as Parquet and read again for the next. All stages
but the last return the columns of ``documents``. Every stage takes null ids,
null and empty texts, texts of any length, repeated rows and further columns;
an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import jaccard_join, language_id, packing, quality_rules
from scriptorium.llm.common import documents, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known: not ``und``, and likelier than not.

    Null texts and texts without a letter go; repeated rows share their fate.
    """
    return language_id.accepted(docs, language_id.train(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the base rule and the certified cutoffs of their language.

    Null and short texts fail the base rule; a row without an id or a label is
    judged like all others; without labels only the base rule rejects.
    """
    return quality_rules.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest id.

    Rows with an id come before those without, equal ids in the order of a
    digest of the whole row; rows equal in all columns are one document. Texts
    without a word are copies of nothing and stay.
    """
    digest = F.unhex(F.md5(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).cast("binary")))
    keyed = docs.select(F.struct("*").alias("_row"), F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), digest.alias("digest")).alias("_key"))
    groups = jaccard_join.clustered(keyed.select("_key", F.col("_row.text").alias("text")), id_col="_key")
    first = groups.filter(F.col("_key") == F.col("component_id")).select("_key.digest").distinct()
    return keyed.withColumn("digest", F.col("_key.digest")).join(written(first, "first-of-group"), "digest", "left_semi").dropDuplicates(["digest"]).select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences; a null text is its end token, each repeated row is packed.

    Executors come here with heaps that the stages before have filled, so workers hold small memos and encode little at once.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), memo=200_000, at_once=1 << 19)


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("pack", pack)]

#: No SQL: language models and tokenizers are beyond it; ``tests/llm/test_pipeline.py`` holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
