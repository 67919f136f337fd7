"""The thin queries over whole tables, one for each operator, and those DuckDB twins that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, fingerprints, html, licences, packing, sharding, simhash, suffixes, token_files, toxicity


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(common.documents(spark, sf_dir))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(common.documents(spark, sf_dir))


def op4_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(common.documents(spark, sf_dir))


def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(common.documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(spark, sf_dir))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(common.documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op2_token_files, op3_suffix_array_dedup, op4_multiset_fingerprints, op5_wrapper_induction, op6_licence_scan, op7_toxicity, op8_simhash_components, op9_benchmark_decontamination, op10_hilbert_shards)
}
ORACLE_SQL: dict[str, str] = {}


# --- parts of the queries above that SQL can express -------------------------------------------------------------------------


def licence_base_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6's words, places of the base phrases and their labels."""
    return op6_licence_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def document_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's lengths and digests of the edited texts."""
    return op4_multiset_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's sizes added up, and the rows and slots of each shard."""
    rows = op10_hilbert_shards(spark, sf_dir)
    total = rows.agg(F.sum("size").alias("all_bytes"))
    return rows.groupBy("shard", "law").agg(F.count("*").alias("rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("slots")).crossJoin(F.broadcast(total))


QUERIES |= {f.__name__: f for f in (licence_base_phrases, document_edits, shard_balance)}
_PHRASES = [(label, phrase.split()) for phrase, label in licences.BASE.items()]
_PLACES = ", ".join(f"list_filter(range(len(w)), lambda i: {' AND '.join(f'''w[i + {k + 1}] = '{x}' ''' for k, x in enumerate(words))}) AS {label}" for label, words in _PHRASES)
ORACLE_SQL["licence_base_phrases"] = f"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, {_PLACES} FROM t), q AS (SELECT *, list_concat(list_concat({_PHRASES[0][0]}, {_PHRASES[1][0]}), {_PHRASES[2][0]}) AS every FROM p)
SELECT doc_id, n_words, CAST(len(every) AS BIGINT) AS n_base, CAST(list_min(every) AS BIGINT) AS first_word, CAST(list_max(every) AS BIGINT) AS last_word,
concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels FROM q"""
ORACLE_SQL["document_edits"] = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nxt FROM documents)
SELECT doc_id, length(text) AS n_chars, sha256(left(text, length(text) - length(text) // 4) || left(nxt, length(text) // 4)) AS edited_sha256 FROM t"""
ORACLE_SQL["shard_balance"] = """WITH n AS (SELECT count(*) AS n, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS all_bytes FROM documents), s AS (SELECT CAST(unnest(range(8)) AS INT) AS shard)
SELECT shard, 'rows' AS law, n // 8 + CASE WHEN shard < n % 8 THEN 1 ELSE 0 END AS rows, CAST(0 AS BIGINT) AS first_slot, n // 8 + CASE WHEN shard < n % 8 THEN 1 ELSE 0 END - 1 AS last_slot, n // 8 + CASE WHEN shard < n % 8 THEN 1 ELSE 0 END AS slots, all_bytes FROM s, n"""
