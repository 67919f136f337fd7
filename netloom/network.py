"""Networks as DataFrames.

`vertices` (net, vid, attributes...), `edges` (net, src, dst, w, na) and `graphs` (net, n, attributes...). Many networks
live in the same frames under different `net`; every statistic groups by it. vid counts from 0 inside a net. Undirected
edges stand with src < dst; bipartite networks have mode 1 or 2 on each vertex, and src is of mode 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from collections import OrderedDict

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.sources.kept import estimate, keep

#: Bytes, by Catalyst's estimate, up to which the rows of a frame are numbered by one window.
ONE_WINDOW = 64 << 20
#: Networks of a session whose frames are persisted at a time; the one that was used longest ago is let go first.
HOLDING = 24
_holding: OrderedDict = OrderedDict()

#: Shared frames that several plans read.
HELD = frozenset(("degrees", "two_paths", "triads", "triangles", "mutual_arcs", "same level degrees", "projection", "centre levels"))


def ranked(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """`df` with the place of each row inside its group `by`, from 0, in the total order `order`.

    A small frame takes a window. A larger one is dealt by ranges of group and order and written; a row's place is its own
    in its partition and group, and the rows of the group in earlier partitions are added up from one row for each
    partition and group. No group, however large, comes to one task.
    """
    if estimate(df) <= ONE_WINDOW:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    kept = keep(dealt.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    parts = kept.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    parts = parts.select(*by, "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return kept.join(parts, [*by, "_part"]).withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before")).cast("long")).drop("_at", "_part", "_first", "_before")


class NetworkError(ValueError):
    """What a network or a formula may not be."""


@dataclass(frozen=True)
class Network:
    vertices: DataFrame
    edges: DataFrame
    graphs: DataFrame
    directed: bool = False
    bipartite: bool = False
    #: Earlier networks on the same vertices, for series: edges of t-1 under net t.
    previous: DataFrame | None = None
    _memo: dict = field(default_factory=dict, compare=False, repr=False)

    @staticmethod
    def from_tables(edges: DataFrame, vertices: DataFrame | None = None, *, src: str = "src", dst: str = "dst", key: str = "key", net: str | None = None, weight: str | None = None, missing: str | None = None, mode: str | None = None, directed: bool = False, attributes: list[str] | None = None) -> "Network":
        """Vertices are numbered by their keys inside each net; without a vertex table they are the ends of the edges."""
        e = edges.select(
            (F.col(net) if net else F.lit(0)).cast("long").alias("net"),
            F.col(src).alias("_s"),
            F.col(dst).alias("_d"),
            (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
            (F.coalesce(F.col(missing).cast("boolean"), F.lit(False)) if missing else F.lit(False)).alias("na"),
        )
        if vertices is None:
            v = e.select("net", F.col("_s").alias("key")).union(e.select("net", F.col("_d"))).distinct()
        else:
            has = set(vertices.columns)
            more = attributes if attributes is not None else [c for c in vertices.columns if c not in {key, net, mode, "net", "vid", "mode"}]
            v = vertices.select((F.col(net) if net and net in has else F.lit(0)).cast("long").alias("net"), F.col(key).alias("key"), *([F.col(mode).cast("int").alias("mode")] if mode else []), *more)
        v = ranked(v, ["net"], [*(["mode"] if mode else []), "key"], "vid")
        ends = v.select("net", "key", "vid")
        e = e.join(ends.select("net", F.col("key").alias("_s"), F.col("vid").alias("src")), ["net", "_s"]).join(ends.select("net", F.col("key").alias("_d"), F.col("vid").alias("dst")), ["net", "_d"])
        if not directed:
            e = e.select("net", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w", "na")
        g = v.groupBy("net").agg(F.count("*").alias("n"), *([F.sum((F.col("mode") == 1).cast("long")).alias("n1")] if mode else []))
        return Network(v, e.select("net", "src", "dst", "w", "na"), g, directed, mode is not None)

    def validated(self) -> "Network":
        """Raise on loops, parallel edges and ties inside a mode; the checks are aggregates over the frames."""
        bad = self.edges.agg(F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops")).first()["loops"]
        if bad:
            raise NetworkError(f"{bad} loops")
        twice = self.edges.groupBy("net", "src", "dst").count().where("count > 1").limit(1).count()
        if twice:
            raise NetworkError("parallel edges")
        if self.bipartite:
            ends = self.ties_with(["mode"])
            if ends.where("s_mode = d_mode").limit(1).count():
                raise NetworkError("ties inside a mode")
        return self

    # --- frames that terms share -----------------------------------------------------------------------------------------

    def memo(self, key, make):
        """What terms share is made once; frames that several plans read are persisted, on disk where memory is short."""
        if key not in self._memo:
            made = make()
            if isinstance(made, DataFrame) and (key if isinstance(key, str) else key[0]) in HELD:
                made = made.persist(StorageLevel.MEMORY_AND_DISK)
            self._memo[key] = made
        return self._memo[key]

    def held(self) -> "Network":
        """The same network with its frames persisted: plans over it start from them. Of many such networks the oldest are let
        go, which costs their plans a recomputation and no more."""
        if "held" not in self._memo:
            some = {n: getattr(self, n).persist(StorageLevel.MEMORY_AND_DISK) for n in ("vertices", "edges", "graphs")}
            before = self.previous.persist(StorageLevel.MEMORY_AND_DISK) if self.previous is not None else None
            got = replace(self, **some, previous=before, _memo={})
            got._memo["held"] = got
            self._memo["held"] = got
        net = self._memo["held"]
        _holding[id(net)] = net
        _holding.move_to_end(id(net))
        while len(_holding) > HOLDING:
            _holding.popitem(last=False)[1].let_go()
        return net

    def let_go(self) -> None:
        """Unpersist all frames of a held network; what was planned over them is computed anew where it is still asked for."""
        for frame in [self.vertices, self.edges, self.graphs, self.previous, *self._memo.values()]:
            if isinstance(frame, DataFrame):
                frame.unpersist()

    def release(self) -> None:
        """Let go of everything that is held."""
        net = self._memo.get("held", self)
        _holding.pop(id(net), None)
        net.let_go()
        net._memo.clear()
        self._memo.clear()

    @property
    def ties(self) -> DataFrame:
        """Ties that count: missing dyads don't."""
        return self.memo("ties", lambda: self.edges.where(~F.col("na")).select("net", "src", "dst", "w"))

    @property
    def ends(self) -> DataFrame:
        """(net, i, j, w): every tie from both of its ends."""
        return self.memo("ends", lambda: self.ties.select("net", F.col("src").alias("i"), F.col("dst").alias("j"), "w").union(self.ties.select("net", F.col("dst"), F.col("src"), "w")))

    def ties_with(self, attributes: list[str], degrees: bool = False) -> DataFrame:
        """Ties with attributes of both ends as s_... and d_...; degrees as s_deg, s_out, s_in and so on."""
        cols = tuple(sorted(set(attributes)))

        def make():
            v = self.degrees if degrees else self.vertices
            names = [*cols, *(("deg", "out", "in") if degrees else ())]
            e = self.ties
            for end, p in (("src", "s_"), ("dst", "d_")):
                e = e.join(v.select("net", F.col("vid").alias(end), *[F.col(f"`{c}`").alias(p + c) for c in names]), ["net", end])
            return e

        return self.memo(("ties_with", cols, degrees), make) if cols or degrees else self.ties

    @property
    def degrees(self) -> DataFrame:
        """Vertices with out, in and deg (ties at the vertex), zeros included."""

        def make():
            count = self.ends_signed.groupBy("net", "vid").agg(F.sum("o").alias("out"), F.sum("n").alias("in"))
            v = self.vertices.join(count, ["net", "vid"], "left").na.fill(0, ["out", "in"])
            return v.withColumn("deg", F.col("out") + F.col("in"))

        return self.memo("degrees", make)

    @property
    def ends_signed(self) -> DataFrame:
        one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
        return self.ties.select("net", F.col("src").alias("vid"), one.alias("o"), zero.alias("n")).union(self.ties.select("net", F.col("dst"), zero, one))

    def two_paths(self, kind: str = "UTP") -> DataFrame:
        """(net, i, j, sp): pairs with shared partners. UTP undirected (i < j); OTP i->k->j, ITP j->k->i, OSP i->k<-j, ISP i<-k->j, RTP i<->k<->j for ordered pairs."""

        def make():
            t = self.ties.select("net", "src", "dst")
            a, b = t.alias("a"), t.alias("b")
            if kind == "UTP":
                e = self.ends
                x = e.select("net", F.col("i"), F.col("j").alias("k"))
                y = e.select("net", F.col("i").alias("j"), F.col("j").alias("k"))
                return x.join(y, ["net", "k"]).where("i < j").groupBy("net", "i", "j").agg(F.count("*").alias("sp"))
            first = {"OTP": ("src", "dst"), "ITP": ("dst", "src"), "OSP": ("src", "dst"), "ISP": ("dst", "src")}
            second = {"OTP": ("dst", "src"), "ITP": ("src", "dst"), "OSP": ("src", "dst"), "ISP": ("dst", "src")}
            if kind == "RTP":
                m = self.mutual_arcs
                x = m.select("net", F.col("src").alias("i"), F.col("dst").alias("k"))
                y = m.select("net", F.col("src").alias("k"), F.col("dst").alias("j"))
            else:
                (p, q), (r, s) = first[kind], second[kind]
                x = t.select("net", F.col(p).alias("i"), F.col(q).alias("k"))
                y = t.select("net", F.col(r).alias("j"), F.col(s).alias("k"))
            del a, b
            return x.join(y, ["net", "k"]).where("i != j").groupBy("net", "i", "j").agg(F.count("*").alias("sp"))

        return self.memo(("two_paths", kind), make)

    @property
    def mutual_arcs(self) -> DataFrame:
        """Arcs whose reverse is there too, both of each pair."""
        back = self.ties.select("net", F.col("dst").alias("src"), F.col("src").alias("dst"))
        return self.memo("mutual_arcs", lambda: self.ties.select("net", "src", "dst").join(back, ["net", "src", "dst"], "left_semi"))

    def dyads(self) -> Column:
        """Number of dyads, over a row of `graphs`."""
        n = F.col("n")
        if self.bipartite:
            return F.col("n1") * (n - F.col("n1"))
        return n * (n - 1) if self.directed else (n * (n - 1) / 2).cast("long")

    def dyad_frame(self) -> DataFrame:
        """(net, src, dst, y): all free observed dyads with their state; generated per net, never held."""
        sizes = self.graphs.select("net", "n", *(["n1"] if self.bipartite else []))
        v = self.vertices.select("net", F.col("vid").alias("src")).join(sizes, "net")
        # vertices are numbered without gaps, so a vertex makes its own dyads; dealt by vertex first, since few rows make many
        v = v.repartition(4 * int(self.vertices.sparkSession.conf.get("spark.sql.shuffle.partitions")), "net", "src")
        if self.bipartite:
            d = v.where("src < n1 and n1 < n").select("net", "src", F.explode(F.sequence(F.col("n1"), F.col("n") - 1)).alias("dst"))
        elif self.directed:
            d = v.select("net", "src", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("dst")).where("src != dst")
        else:
            d = v.where("src < n - 1").select("net", "src", F.explode(F.sequence(F.col("src") + 1, F.col("n") - 1)).alias("dst"))
        e = self.edges.select("net", "src", "dst", "na", F.lit(1).alias("_y"))
        return d.join(e, ["net", "src", "dst"], "left").where("na is null or not na").select("net", "src", "dst", F.coalesce("_y", F.lit(0)).alias("y"))

    def missing_dyads(self) -> DataFrame:
        """(net, src, dst, y): the dyads whose state is not known, without a tie."""
        return self.edges.where("na").select("net", "src", "dst").distinct().withColumn("y", F.lit(0))

    # --- networks from networks ------------------------------------------------------------------------------------------

    def with_edges(self, edges: DataFrame, directed: bool | None = None) -> "Network":
        if "w" not in edges.columns:
            edges = edges.withColumn("w", F.lit(1.0))
        if "na" not in edges.columns:
            edges = edges.withColumn("na", F.lit(False))
        return replace(self, edges=edges.select("net", "src", "dst", "w", "na"), directed=self.directed if directed is None else directed, _memo={})

    def subgraph(self, condition: Column) -> "Network":
        """Induced by the vertices that meet `condition`, numbered anew."""
        v = self.vertices.where(condition).withColumn("_old", F.col("vid"))
        v = ranked(v.drop("vid"), ["net"], ["_old"], "vid")
        ids = v.select("net", "_old", "vid")
        e = self.edges
        for end in ("src", "dst"):
            e = e.join(ids.select("net", F.col("_old").alias(end), F.col("vid").alias(f"_{end}")), ["net", end]).drop(end).withColumnRenamed(f"_{end}", end)
        g = self.graphs.drop("n", "n1").join(v.groupBy("net").agg(F.count("*").alias("n"), *([F.sum((F.col("mode") == 1).cast("long")).alias("n1")] if self.bipartite else [])), "net")
        return replace(self, vertices=v.drop("_old"), edges=e.select("net", "src", "dst", "w", "na"), graphs=g, _memo={})

    def symmetrized(self, rule: str = "weak") -> "Network":
        """An undirected network: weak either arc, strong both, upper those with src < dst, lower those with src > dst."""
        e = self.edges.where(~F.col("na"))
        if rule == "upper":
            e = e.where("src < dst")
        elif rule == "lower":
            e = e.where("src > dst")
        pairs = e.groupBy("net", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("k"), F.max("w").alias("w"))
        if rule == "strong":
            pairs = pairs.where("k = 2")
        elif rule not in ("weak", "upper", "lower"):
            raise NetworkError(f"no rule {rule!r}")
        return self.with_edges(pairs.select("net", F.col("a").alias("src"), F.col("b").alias("dst"), "w"), directed=False)


def series(edges: DataFrame, vertices: DataFrame, *, time: str, src: str = "src", dst: str = "dst", key: str = "key", directed: bool = False, attributes: list[str] | None = None) -> Network:
    """Transitions of a series on one vertex set: net t holds the ties of step t, `previous` those of the step before.

    Steps are numbered by their order; the first has no transition. graphs carry the time and the time passed.
    """
    steps = edges.select(F.col(time).alias("time")).distinct().withColumn("net", (F.row_number().over(Window.orderBy("time")) - 1).cast("long"))
    steps = steps.withColumn("delta", F.col("time") - F.lag("time").over(Window.orderBy("time")))
    numbered = edges.join(F.broadcast(steps), edges[time] == steps["time"])
    e = numbered.select("net", F.col(src).alias("_s"), F.col(dst).alias("_d"))
    more = attributes if attributes is not None else [c for c in vertices.columns if c != key]
    v0 = ranked(vertices.select(F.lit(0).cast("long").alias("_all"), F.col(key).alias("key"), *more), ["_all"], ["key"], "vid").drop("_all")
    ids = v0.select("key", "vid")
    e = e.join(ids.select(F.col("key").alias("_s"), F.col("vid").alias("src")), "_s").join(ids.select(F.col("key").alias("_d"), F.col("vid").alias("dst")), "_d")
    if not directed:
        e = e.select("net", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    e = e.select("net", "src", "dst").distinct()
    later = steps.where("net > 0").select("net")
    v = later.join(v0)
    g = v.groupBy("net").agg(F.count("*").alias("n")).join(steps.select("net", "time", "delta"), "net")
    now = e.where("net > 0").withColumns({"w": F.lit(1.0), "na": F.lit(False)})
    before = e.join(steps.agg(F.max("net").alias("_last"))).where("net < _last").select((F.col("net") + 1).alias("net"), "src", "dst")
    return Network(v, now.select("net", "src", "dst", "w", "na"), g, directed, False, before)
