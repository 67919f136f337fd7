"""Sharding along a Hilbert curve over quantised metadata.

Each dimension (language, source, length) is cut into at most 2^BITS cells at quantiles over all rows; the cells' place on
the Hilbert curve is the sort key, and equal runs of the order become the shards, so that each shard covers a compact part
of every dimension and files can be skipped by their ranges (write() makes such files). Strings are cut as whole strings,
byte by byte: their different values are counted, put in order across the cluster, and the values at the quantiles of the
running counts are the cuts, so that values with a common front fall into different cells. The law is `rows`: shard sizes differ by at most one row.
Copies of a text take the cell of their first copy (smallest doc_id), so that they stand next to one another, however
many there are; only the at most shards-1 cuts can part them.

Null metadata go to the first cell, a null text counts as empty. Repeated rows each get a slot of their own. An empty
table gives no rows. Extra columns are ignored, missing dimensions are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS = 5
DIMENSIONS = ("lang", "source", "size")


def curve(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of `cells` (n, dimensions), by Skilling's transform of coordinates to the transposed index."""
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for k in range(n):
            up = (x[k] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
        q >>= 1
    for k in range(1, n):
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    index = np.zeros_like(flip)
    for bit in range(bits - 1, -1, -1):
        for k in range(n):
            index = index << 1 | (x[k] ^ flip) >> bit & 1
    return index


def _sortable(df: DataFrame, column: str):
    numeric = isinstance(df.schema[column].dataType, (T.NumericType, T.StringType))
    return F.col(column) if numeric else F.col(column).cast("string")


def cells(df: DataFrame, names: list[str], bits: int = BITS) -> dict[str, list[tuple]]:
    """For each column its cuts (value, cell): a value is in the cell of the greatest cut up to it, else in cell 0.

    A cell's number says at which of the 2^bits quantiles it begins, so a dimension of few values spans the whole axis.
    """
    kinds = dict(df.dtypes)
    at = [k / 2**bits for k in range(1, 2**bits)]
    numbers = [n for n in names if kinds[n] != "string"]
    row = df.agg(*[F.percentile_approx(n, at, 1000).alias(n) for n in numbers]).first() if numbers else {}
    cuts = {}
    for n in numbers:
        first: dict = {}
        for k, value in enumerate(row[n] or [], 1):
            first.setdefault(value, k)
        cuts[n] = sorted(first.items())
    for n in names:
        if n not in cuts:
            values = df.where(F.col(n).isNotNull()).groupBy(F.col(n).alias("value")).agg(F.count("*").alias("n"))
            laid = common.in_order(values, ["value"], "n", name="values")
            total = laid.agg(F.sum("n")).first()[0] or 0
            step = F.floor(F.lit(1.0) * F.col("before") * 2**bits / max(total, 1)).cast("int").alias("step")
            cuts[n] = sorted((r["value"], r["step"]) for r in laid.groupBy(step).agg(F.min("value").alias("value")).collect())  # at most 2^bits
    return {n: cuts[n] for n in names}


def _cell(column: str, cuts: list[tuple]):
    """A value's cell; nulls go to the first."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(k).alias("k")) for v, k in cuts])
    below = F.filter(table, lambda x: x["v"] <= F.col(column))
    return F.coalesce(F.when(F.col(column).isNotNull(), F.array_max(F.transform(below, lambda x: x["k"]))), F.lit(0))


def laid(df: DataFrame, dims: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, _text, hilbert of every row; copies take the place of their first."""
    dims = [d for d in dims if d == "size" or d in df.columns]
    body = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("_text"), *[_sortable(df, d).alias(f"_{d}") for d in dims if d != "size"])
    rows = common.keep(rows.withColumn("_size", F.col("size").cast("double")), "meta")
    rows = rows.select("doc_id", "size", "text_crc32", "_text", F.array(*[_cell(n, c) for n, c in cells(rows, [f"_{d}" for d in dims], bits).items()]).alias("_cells"))
    key = ["_text", "text_crc32", "size"]
    first = common.keep(rows.groupBy(*key).agg(F.min(F.struct("doc_id", "_cells"))["_cells"].alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "copies")
    placed = rows.join(first, key, "left").select("doc_id", "size", "text_crc32", "_text", F.coalesce("_first", "_cells").alias("_cells"))

    def index(batches):
        for batch in batches:
            flat = batch.column("_cells").flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(curve(flat.reshape(-1, len(dims)), bits))], names=["doc_id", "size", "text_crc32", "_text", "hilbert"])

    return placed.mapInArrow(index, "doc_id long, size long, text_crc32 long, _text long, hilbert long")


def write(df: DataFrame, folder: str, files: int = 8, dims: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> None:
    """The rows of `df`, all columns, in about `files` Parquet files along the curve: each covers a compact part of every
    dimension, so a reader with a filter on any of them skips the others by their ranges."""
    given = [d for d in dims if d != "size" and d in df.columns]
    rows = df.withColumn("_size", F.octet_length(F.encode(F.coalesce("text", F.lit("")), "utf-8")).cast("double"))
    rows = rows.withColumns({f"_at_{d}": _sortable(df, d) for d in given})
    given = [f"_at_{d}" for d in given]
    cuts = cells(common.keep(rows.select(*given, "_size"), "meta"), [*given, "_size"], bits)
    rows = rows.withColumn("_cells", F.array(*[_cell(n, c) for n, c in cuts.items()])).drop("_size", *given)
    common.small_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("_hilbert", T.LongType())])

    def index(batches):
        for batch in batches:
            flat = batch.column("_cells").flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(curve(flat.reshape(-1, len(cuts)), bits))], names=schema.fieldNames())

    rows.mapInArrow(index, schema).repartitionByRange(files, "_hilbert").sortWithinPartitions("_hilbert").drop("_hilbert").write.parquet(folder)


def shard(df: DataFrame, shards: int = 8, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert."""
    rows = common.in_order(laid(df, bits=bits), ["hilbert", "size", "text_crc32", "_text", "doc_id"], name="curve")
    n = rows.count()
    each, more = divmod(n, shards)
    cut = more * (each + 1)  # the first `more` shards have one row more
    at = F.col("before")
    late = F.lit(more) + (at - cut) / F.lit(max(each, 1))
    number = F.when(at < cut, F.floor(at / (each + 1))).otherwise(F.floor(late)).cast("int")
    rows = rows.withColumn("shard", number)
    start = F.when(F.col("shard") <= more, F.col("shard") * (each + 1)).otherwise(cut + (F.col("shard") - more) * each)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (at - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")
