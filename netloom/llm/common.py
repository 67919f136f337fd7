"""What several operators share: tables kept in the shared folder, and a global order with running totals."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.sources.kept import shared_dir


def keep(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write `df` once into the shared folder and read it back: lineage is cut there, and a lost executor costs a reread only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/netloom/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python a thousand at a time at most: batches stay a few MB on both sides. The setting is the session's,
    as the plan reads it when it runs; it is only ever lowered."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def frugal(make):
    """`make` (batches to batches); after its last batch the worker, which the next stage uses again, gives back what it no longer holds."""

    def made(batches):
        yield from make(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)

    return made


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, so that a clash with other columns of the input can't arise; a null text is an empty one."""
    small_batches(df.sparkSession)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in ("text", "html") else F.col(c) for c in columns])


def in_order(df: DataFrame, order: list[str], value: str | None = None, name: str = "layout") -> DataFrame:
    """`df` in a total order over all partitions, with `before`: the sum of `value` (1 each where None) over the rows that stand before.

    Rows are dealt by ranges of `order`, which must tell rows apart well enough that no range is large; running totals
    are taken inside each partition as it streams by and written to the shared folder, and only one number for each
    partition goes to the driver, whose number is bounded by spark.sql.shuffle.partitions. No window, no single task.
    """
    fields = [*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())]

    def number(batches):
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            worth = np.ones(batch.num_rows, np.int64) if value is None else batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(worth) + total
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(upto - worth)]
            if batch.num_rows:
                total = int(upto[-1])
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_local"])

    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = keep(dealt.mapInArrow(number, T.StructType(fields)), name)
    return with_bases(kept, value)


def with_bases(kept: DataFrame, value: str | None) -> DataFrame:
    """`kept` has `_part` and `_local`; give it `before`, the partitions' totals added up in their order."""
    spark = kept.sparkSession
    worth = F.lit(1) if value is None else F.col(value)
    totals = kept.groupBy("_part").agg(F.sum(worth).cast("long").alias("n")).orderBy("_part").collect()
    bases, total = [], 0
    for row in totals:
        bases.append((row["_part"], total))
        total += row["n"]
    lookup = spark.createDataFrame(bases or [(0, 0)], "_part int, _base long")
    return kept.join(F.broadcast(lookup), "_part").withColumn("before", F.col("_local") + F.col("_base")).drop("_part", "_local", "_base")
