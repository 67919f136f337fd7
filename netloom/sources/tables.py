"""Networks derived from the warehouse tables; ties are cut by rank with a total order, so that every scale works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.network import Network, series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strongest(pairs: DataFrame, most: int, *partition: str) -> DataFrame:
    """The `most` pairs of largest weight, ties broken by src and dst."""
    if not partition:  # a top-k, not a sort of everything in one task
        return pairs.orderBy(F.desc("w"), "src", "dst").limit(most)
    order = Window.partitionBy(*partition).orderBy(F.desc("w"), "src", "dst")
    return pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def trade_pairs(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """Arcs from the customer's nation to the supplier's, weighted by lineitems."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.year("l_shipdate").alias("year"), "l_returnflag")
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    joined = line.join(order, "l_orderkey").join(customer, "c_custkey").join(supplier, "l_suppkey")
    return joined.where("src != dst").groupBy(*by, "src", "dst").agg(F.count("*").alias("w"))


def trade(spark: SparkSession, sf_dir: str, most: int = 150) -> Network:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("region"), (F.col("n_regionkey") % 2).alias("half"))
    return Network.from_tables(strongest(trade_pairs(spark, sf_dir), most), nation, weight="w", directed=True)


def trade_series(spark: SparkSession, sf_dir: str, most: int = 150) -> Network:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("region"))
    pairs = strongest(trade_pairs(spark, sf_dir, "year").where("year between 1995 and 2001"), most, "year")
    return series(pairs, nation, time="year", directed=True)


def together(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """Pairs of suppliers or parts that stand in one order, weighted by orders."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col(column).alias("x")).distinct()
    pair = line.select("l_orderkey", F.col("x").alias("src")).join(line.select("l_orderkey", F.col("x").alias("dst")), "l_orderkey").where("src < dst")
    return pair.groupBy("src", "dst").agg(F.count("*").alias("w"))


def cosupply(spark: SparkSession, sf_dir: str, most: int = 400) -> Network:
    v = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), (F.col("s_nationkey") % 3).alias("third"))
    return Network.from_tables(strongest(together(spark, sf_dir, "l_suppkey"), most), v, weight="w")


def copart(spark: SparkSession, sf_dir: str, least: int = 2) -> Network:
    v = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("type"))
    return Network.from_tables(together(spark, sf_dir, "l_partkey").where(F.col("w") >= least), v, weight="w")


def supplypart(spark: SparkSession, sf_dir: str, least: float = 48.0) -> Network:
    """Bipartite: suppliers (mode 1) and parts (mode 2) of lineitems of at least that quantity."""
    pairs = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= least).select(F.concat(F.lit("s"), F.lpad("l_suppkey", 9, "0")).alias("src"), F.concat(F.lit("t"), F.lpad("l_partkey", 9, "0")).alias("dst")).distinct()
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.lpad("s_suppkey", 9, "0")).alias("key"), F.lit(1).alias("mode"), (F.col("s_nationkey") % 3).alias("grp"), F.col("s_acctbal").cast("double").alias("x"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("t"), F.lpad("p_partkey", 9, "0")).alias("key"), F.lit(2).alias("mode"), (F.col("p_size") % 3).alias("grp"), F.col("p_size").cast("double").alias("x"))
    return Network.from_tables(pairs, s.union(p), mode="mode", attributes=["grp", "x"])
