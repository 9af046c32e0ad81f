"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, jaccard_join, language_id, language_model, media, packing, quality_rules, sentence_pieces, target_encoding, token_files, toxicity, vector_codes, warc
from .common import documents, fold, remove, written


def op1_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_pfor_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_files(token_files.write_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op4_log_frequency_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, rare = language_model.train(docs.filter(fold("doc_id", 7) != 2))
    return language_model.score(docs, model, rare)


def op5_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write WARC files, store a replica in which every page whose id leaves 13 modulo 97 is damaged, and audit it."""
    path = warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    first = written(warc.read_warc(spark, path), "warc-index")
    replica = warc.copied(spark, path, damage=F.col("key") % 97 == 13)
    second = written(warc.read_warc(spark, replica), "warc-index")
    remove(spark, path)
    remove(spark, replica)
    found = warc.audit(first, second).select("file", "ordinal", F.lit(True).alias("differs"))
    both = first.select("file", "ordinal", F.col("key").alias("page_id"), F.col("length").alias("record_bytes"), F.col("sha256").alias("record_sha256"))
    return both.join(found, ["file", "ordinal"], "left").select("page_id", "record_bytes", "record_sha256", F.coalesce("differs", F.lit(False)).alias("corrupt"))


def op7_combination_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.clustered(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.to_media(documents(spark, sf_dir).select("doc_id", "text")))


def op11_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op12_segment_mean_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = vector_codes.integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    books = vector_codes.train(table)
    coded = vector_codes.with_label_error(written(vector_codes.encode(table, books), "vector-codes"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_fold_vector_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_encoding.encoded_lines(*(spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("sale_lines", "sales", "items", "vendors", "clients")))


QUERIES = {f.__name__: f for f in (op1_ppm_language_id, op2_byte_bpe, op3_pfor_token_files, op4_log_frequency_bloom, op5_ftrl_toxicity, op6_merkle_fixity, op7_combination_jaccard, op8_best_fit_packing, op9_risk_controlled_rules, op10_iso_media, op11_distinct_chunks, op12_segment_mean_codes, op13_fold_vector_encoding)}



def _codes_sql(rounds: int = 4) -> str:
    """All distances by brute force, a pair of common table expressions a round."""
    ctes = [
        """whole AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x IS NULL OR NOT isfinite(x)))""",
        """placed AS (SELECT vec_id, len(embedding) // 4 AS width, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS place FROM whole)""",
        """parts AS MATERIALIZED (SELECT vec_id, place // width AS part, place % width AS pos, floor(1024 * x)::BIGINT AS x FROM placed)""",
        """book0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM whole) USING (vec_id) WHERE entry < 256)""",
    ]
    for n in range(rounds + 1):
        ctes.append(f"""far{n} AS (SELECT p.vec_id, p.part, b.entry, sum((p.x - b.c) * (p.x - b.c))::BIGINT AS d FROM parts p JOIN book{n} b USING (part, pos) GROUP BY ALL)""")
        ctes.append(f"""near{n} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM far{n} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)""")
        ctes.append(f"""book{n + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN (SELECT part, entry, pos, floor(sum(x) / count(*))::BIGINT AS c FROM near{n} JOIN parts USING (vec_id, part) GROUP BY ALL) m USING (part, entry, pos))""")
    ctes.append(f"""coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)""")
    return f"""WITH {", ".join(ctes)}
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN whole USING (vec_id)"""


def _encoding_sql() -> str:
    """Windows over a key's earlier lines, less those over its fold's; crc32 by its table."""
    earlier = "ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"
    told = lambda what, key: f"coalesce(sum({what}) OVER (PARTITION BY {key} {earlier}), 0) - coalesce(sum({what}) OVER (PARTITION BY {key}, fold {earlier}), 0)"
    counts = ", ".join(f"({told('1', key)})::BIGINT AS {key}_n, ({told('hit', key)})::BIGINT AS {key}_s" for key in ("item_id", "vendor_id", "client_id", "kind", "nation", "segment", "whole"))
    rate = lambda key, prior: f"CASE WHEN {key}_n < 1 THEN {prior} ELSE (1000000 * {key}_s + 50 * {prior}) // ({key}_n + 50) END"
    return f"""
        WITH RECURSIVE bit(b, x, k) AS (SELECT b, b::BIGINT, 0 FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, k + 1 FROM bit WHERE k < 8),
        crc_table AS MATERIALIZED (SELECT list(x ORDER BY b) AS crc FROM bit WHERE k = 8),
        folds AS MATERIALIZED (
          SELECT sale_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(sale_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a // 256, crc[1 + xor(a % 256, b)])), 4294967295) % 5 AS fold
          FROM (SELECT DISTINCT sale_id FROM sales WHERE sale_id IS NOT NULL), crc_table),
        sold AS (
          SELECT sale_id, coalesce(l.item_id, -1) AS item_id, l.vendor_id, coalesce(s.client_id, -1) AS client_id, s.sold_at AS t, f.fold, (coalesce(l.flag, '') = 'returned')::INT AS hit, 0 AS whole
          FROM sale_lines l JOIN sales s USING (sale_id) JOIN folds f USING (sale_id) WHERE s.sold_at IS NOT NULL),
        lines AS MATERIALIZED (
          SELECT d.*, i.kind, v.nation_id AS nation, c.segment
          FROM sold d LEFT JOIN items i ON i.item_id = d.item_id LEFT JOIN vendors v ON v.vendor_id = d.vendor_id LEFT JOIN clients c ON c.client_id = d.client_id),
        told AS (SELECT sale_id, item_id, vendor_id, hit, {counts} FROM lines),
        g AS (SELECT *, {rate("whole", "500000")} AS p FROM told),
        priors AS (SELECT *, {rate("kind", "p")} AS kind_p, {rate("nation", "p")} AS nation_p, {rate("segment", "p")} AS segment_p FROM g)
        SELECT sale_id, item_id, vendor_id, count(*) AS n_lines, sum(hit)::BIGINT AS n_returned,
               max(item_id_n) AS item_n, max({rate("item_id", "kind_p")}) AS item_rate, max(vendor_id_n) AS vendor_n, max({rate("vendor_id", "nation_p")}) AS vendor_rate, max(client_id_n) AS client_n, max({rate("client_id", "segment_p")}) AS client_rate
        FROM priors GROUP BY sale_id, item_id, vendor_id"""


_CRLF = "chr(13) || chr(10)"
ORACLE_SQL = {
    "op12_segment_mean_codes": _codes_sql(),
    "op13_fold_vector_encoding": _encoding_sql(),
    "op6_merkle_fixity": f"""
        WITH http AS (
          SELECT page_id, coalesce(url, '') AS url,
                 'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || strlen(coalesce(html, '')) || {_CRLF} || {_CRLF} || coalesce(html, '') AS body
          FROM pages),
        records AS (
          SELECT page_id, 'WARC/1.1' || {_CRLF} || 'WARC-Type: response' || {_CRLF} || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || {_CRLF} || 'WARC-Target-URI: ' || url || {_CRLF}
                 || 'WARC-Date: 1970-01-01T00:00:00Z' || {_CRLF} || 'Content-Type: application/http; msgtype=response' || {_CRLF} || 'Content-Length: ' || strlen(body) || {_CRLF} || {_CRLF} || body || {_CRLF} || {_CRLF} AS record
          FROM http)
        SELECT page_id, strlen(record)::BIGINT AS record_bytes, sha256(record) AS record_sha256, coalesce(page_id % 97 = 13, false) AS corrupt FROM records""",
}
