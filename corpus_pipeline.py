"""A corpus pipeline over `documents`: five stages, each of which works on what the one before has kept.

toxicity: documents that the machine rejects go. near_duplicates: of documents whose sets of five-word shingles
have a Jaccard similarity of 0.8 or more, directly or through others, one row stays, with the smallest doc_id (null only if all
are; of equal doc_ids the first by a hash of the text); op8's query has its own measure: four words, four bits. repeated_strings: bytes that repeat an earlier 100-byte string are cut out of the texts; n_chars follows.
contamination: documents that hold a benchmark item go. packing: the rest is packed into sequences.

All stages but the last return the columns of `documents`; extra columns, whatever their names, go at the first stage. Null
texts stay null up to repeated_strings, which makes them empty; null and empty texts are copies of one another, so one of
them stays. A row with a null doc_id is a document like any other, and of rows that repeat one stays. A document that is cut
down to nothing stays, with an empty text. Texts of any length are worked on whole. Without documents there are no rows;
without labels nothing is toxic, without benchmark items nothing is contaminated.

near_duplicates takes its candidates from the SimHash operator's Gray-order hierarchy: fingerprints of 256 bits, since two
texts of similarity 0.8 differ in about 10 of 64, at which no block index is selective. An exact check of the shingle sets
follows (see netloom/llm/near.py and the README).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import common, decontaminate, near, packing, suffixes, toxicity

#: Of the pieces that a worker remembers for packing: the stages before leave less memory than op1 has.
SHARE = 0.6
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all labelled documents of the input outside the held-out fifth, drop what is predicted toxic."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs.select(*COLUMNS), machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts that share four fifths of their five-word shingles stays, whether doc_ids repeat or are null."""
    rows = suffixes.numbered(docs.select(*COLUMNS).withColumn("_null", F.col("text").isNull()), ["lang", "source", "n_chars", "_null"])
    groups = common.keep(near.components(rows).join(rows.where("doc_id is null").select("rid", F.lit(True).alias("_late")), "rid", "left"), "components")
    first = F.min(F.struct(F.coalesce("_late", F.lit(False)).alias("late"), "rid"))["rid"]
    stay = common.keep(groups.groupBy("component").agg(first.alias("rid")).select("rid"), "survivors")
    text, doc_id = F.when(~F.col("_null"), F.col("text")), F.col("doc_id").cast(docs.schema["doc_id"].dataType)
    return rows.join(stay, "rid", "left_semi").withColumns({"text": text, "doc_id": doc_id}).select(*COLUMNS)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 100-byte string that also starts earlier go; a character that loses some of its bytes goes whole."""
    return suffixes.rows_kept(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, share=SHARE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeated_strings),
    ("contamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Training, fingerprints and packing have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL: str | None = None
