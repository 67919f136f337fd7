"""Networks from files: GraphML, and tables of ties and vertices as CSV, JSON or Parquet. All are read by Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.network import Network, NetworkError

#: What GraphML calls its kinds of values, as types of columns (fixed values).
KINDS = {"string": "string", "boolean": "boolean", "int": "int", "long": "bigint", "float": "double", "double": "double"}
_DATA = "data array<struct<_VALUE: string, _key: string>>"


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").schema(schema).load(path)


def _with_data(rows: DataFrame, keys: list, kept: list[str]) -> DataFrame:
    """A column for each declared key; absent values are its default or null."""
    out = []
    for key in keys:
        value = F.get(_values(key["_id"]), 0)
        out.append(F.coalesce(value, F.lit(key["default"])).cast(KINDS.get(key["_type"], "string")).alias(key["_name"]))
    return rows.select(*kept, *out)


def _values(key: str):
    return F.transform(F.filter("data", lambda x: x["_key"] == F.lit(key)), lambda x: x["_VALUE"])


def read_graphml(spark: SparkSession, path: str, *, mode: str | None = None) -> Network:
    """A network from a GraphML file: vertices keep their id as `key` and every declared attribute. A boolean edge attribute
    `na` marks missing dyads, `weight` gives values. `mode`: a boolean or whole-number vertex attribute that names the modes
    of a bipartite network (false or 1, true or 2)."""
    declared = _elements(spark, path, "key", "_id string, `_attr.name` string, `_attr.type` string, _for string, default string")
    keys = [{"_id": r[0], "_name": r[1] or r[0], "_type": r[2] or "string", "_for": r[3] or "all", "default": r[4]} for r in declared.collect()]
    nodes = _with_data(_elements(spark, path, "node", f"_id string, {_DATA}"), [k for k in keys if k["_for"] in ("node", "all")], ["_id"]).withColumnRenamed("_id", "_key")
    ties = _with_data(_elements(spark, path, "edge", f"_source string, _target string, {_DATA}"), [k for k in keys if k["_for"] in ("edge", "all")], ["_source", "_target"])
    head = spark.read.text(path).where("value like '%edgedefault%'").limit(1).collect()
    directed = bool(head) and 'edgedefault="directed"' in head[0][0].replace("'", '"')
    vertices, has = nodes.withColumnRenamed("_key", "key"), set(ties.columns)
    if nodes.columns.count("key"):
        raise NetworkError("a vertex attribute is named key")
    if mode:
        kind = dict(vertices.dtypes)[mode]
        vertices = vertices.withColumn("_mode", F.when(F.col(mode), 2).otherwise(1) if kind == "boolean" else F.col(mode).cast("int"))
    return Network.from_tables(ties, vertices, src="_source", dst="_target", weight="weight" if "weight" in has else None, missing="na" if "na" in has else None, mode="_mode" if mode else None, directed=directed)


def read_tables(spark: SparkSession, ties: str, vertices: str | None = None, *, kind: str = "csv", src: str = "src", dst: str = "dst", key: str = "key", schema: str | None = None, **network) -> Network:
    """A network from tables of ties and vertices; CSV files have a header. `schema` is that of the ties, else it is read off
    the data. What else is given goes to Network.from_tables()."""

    def table(path: str, given: str | None) -> DataFrame:
        reader = spark.read.format(kind)
        if kind == "csv":
            reader = reader.option("header", "true")
        if given:
            reader = reader.schema(given)
        elif kind == "csv":
            reader = reader.option("inferSchema", "true")
        return reader.load(path)

    return Network.from_tables(table(ties, schema), table(vertices, None) if vertices else None, src=src, dst=dst, key=key, **network)


def write_tables(net: Network, folder: str, kind: str = "parquet") -> None:
    """Vertices, edges and graphs under `folder`."""
    for name in ("vertices", "edges", "graphs"):
        writer = getattr(net, name).write.format(kind)
        (writer.option("header", "true") if kind == "csv" else writer).save(f"{folder}/{name}")
