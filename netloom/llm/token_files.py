"""Token ids as Parquet list columns: dictionary pages, delta encoding where a column chunk has too many values for a
dictionary (version 2 pages), bounded row groups and pages, page indexes; a reader of the metadata columns touches no token page, and a reader of some doc_ids
touches only the row groups and pages whose ranges hold them.

Nulls and empty texts are documents of the end id alone. Rows of one doc_id stand in the order of their texts. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Row groups, pages and rows of a page are bounded, so that a selective read skips most of a file.
LAYOUT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",
    "compression": "zstd",
}
#: Of the pieces that a worker may remember: beside Spark's sort and the file writer there is less room than in packing.
SHARE = 0.6
SCHEMA = "doc_id long, n_tokens long, _part int, _local long, tokens array<int>"


def write(df: DataFrame, folder: str, path: str | None = None, end_id: int = 2, layout: dict[str, str] = LAYOUT) -> None:
    """Encode every whole text and write files in ascending doc_id order. The raw rows are dealt by range before they are encoded, so token lists are never shuffled."""
    path = path or tokens.vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        part, total, make = TaskContext.get().partitionId(), 0, tokens.encoder(path, SHARE).encode
        for table in tokens.gathered(batches, most=1000):  # beside Spark's sort and the file writer there is room for little
            ids, made = tokens.flat(table, "doc_id"), make(tokens.flat(table, "text"))
            for at in range(0, len(ids), 512):
                data = [x + end for x in made[at : at + 512]]
                counts = np.array([len(x) // 4 for x in data], np.int64)
                upto = np.cumsum(counts)
                offsets = np.concatenate(([0], upto)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(data), np.int32)))
                yield pa.RecordBatch.from_arrays([ids.slice(at, 512), pa.array(counts), pa.array(np.full(len(data), part, np.int32)), pa.array(upto - counts + total), lists], names=["doc_id", "n_tokens", "_part", "_local", "tokens"])
                total += int(upto[-1])
            pa.default_memory_pool().release_unused()  # what Arrow keeps for later adds to two workers' share

    rows = common.plain(df, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))  # the sample of the ranges takes short keys, not texts, to the driver
    rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").drop("_tie").mapInArrow(encode, SCHEMA).write.options(**layout).parquet(folder)


def read(spark: SparkSession, folder: str, where=None) -> DataFrame:
    """doc_id, start, n_tokens, tokens of the written documents; `where` over doc_id is pushed into the files."""
    files = spark.read.schema(SCHEMA).parquet(folder)
    chosen = files if where is None else files.where(where)
    bases = common.with_bases(files.select("doc_id", "n_tokens", "_part", "_local"), "n_tokens") if where is not None else None
    if bases is None:
        return common.with_bases(chosen, "n_tokens").withColumnRenamed("before", "start").select("doc_id", "start", "n_tokens", "tokens")
    return chosen.drop("n_tokens").join(bases.select("doc_id", "before", "n_tokens").where(where), "doc_id").select("doc_id", F.col("before").alias("start"), "n_tokens", "tokens")


def digests(frame: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read() gives."""

    def sums(batches):
        for batch in batches:
            lists = batch.column("tokens")
            data, edges = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return frame.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write `df` into the shared folder and return the digests of what the files hold."""
    spark = df.sparkSession
    folder = f"{common.shared_dir(spark)}/netloom/tokens-{uuid.uuid4().hex}"
    write(df, folder, path, end_id)
    return digests(read(spark, folder))
