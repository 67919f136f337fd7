"""Distributions that goodness of fit compares: degrees, shared partners, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.network import Network
from netloom.sources.kept import shared_dir


def degree_distribution(net: Network, which: str = "deg", mode: int | None = None) -> DataFrame:
    """(net, k, n): vertices of each degree."""
    net = net.held()
    d = net.degrees if mode is None else net.degrees.where(F.col("mode") == mode)
    return d.groupBy("net", F.col(which).cast("long").alias("k")).agg(F.count("*").alias("n"))


def shared_partners(net: Network, pairs: bool = False) -> DataFrame:
    """(net, k, n): ties (pairs: all pairs) with each number of shared partners; those without any by complement."""
    net = net.held()
    p = net.two_paths("OTP" if net.directed else "UTP")
    if pairs:
        some = p.groupBy("net", F.col("sp").alias("k")).agg(F.count("*").alias("n"))
        total = net.graphs.select("net", net.dyads().alias("all"))
        zero = total.join(some.groupBy("net").agg(F.sum("n").alias("s")), "net", "left").select("net", F.lit(0).cast("long").alias("k"), (F.col("all") - F.coalesce("s", F.lit(0))).cast("long").alias("n"))
        return some.union(zero)
    t = net.ties.join(p.select("net", F.col("i").alias("src"), F.col("j").alias("dst"), "sp"), ["net", "src", "dst"], "left").na.fill(0, ["sp"])
    return t.groupBy("net", F.col("sp").alias("k")).agg(F.count("*").alias("n"))


def distances(net: Network, most: int | None = None) -> DataFrame:
    """(net, k, n): pairs at each geodesic distance; k is null for pairs without a path (or beyond `most`).

    Breadth-first over all sources at once: the frontier of one round joins the ties, what has been reached before falls
    away. Each round is checkpointed, so that plans stay short and a lost executor costs one round.
    """
    net = net.held()
    arcs = (net.ties.select("net", F.col("src").alias("i"), F.col("dst").alias("j")) if net.directed else net.ends.select("net", "i", "j")).persist()
    shared_dir(net.vertices.sparkSession)
    seen = net.vertices.select("net", F.col("vid").alias("s"), F.col("vid").alias("j"))
    frontier, counts, step = seen, [], 0
    while most is None or step < most:
        step += 1
        frontier = frontier.select("net", "s", F.col("j").alias("i")).join(arcs, ["net", "i"]).select("net", "s", "j").distinct().join(seen, ["net", "s", "j"], "left_anti").checkpoint()
        found = frontier.groupBy("net").agg(F.count("*").alias("n")).collect()
        if not found:
            break
        counts.extend((r["net"], step, r["n"] if net.directed else r["n"] // 2) for r in found)
        seen = seen.union(frontier)
    rows = net.vertices.sparkSession.createDataFrame(counts, "net long, k long, n long")
    total = net.graphs.select("net", net.dyads().alias("all"))
    rest = total.join(rows.groupBy("net").agg(F.sum("n").alias("s")), "net", "left").select("net", F.lit(None).cast("long").alias("k"), (F.col("all") - F.coalesce("s", F.lit(0))).cast("long").alias("n"))
    return rows.union(rest.where("n > 0"))


def p_values(observed: DataFrame, simulated: DataFrame) -> DataFrame:
    """(k, obs, min, mean, max, p) of observed (k, n) against simulated (sim, k, n): twice the smaller tail, 1 at most; a missing cell is 0."""
    sims = simulated.select("sim").distinct()
    cells = observed.select("k").union(simulated.select("k")).distinct()
    full = sims.crossJoin(F.broadcast(cells)).join(simulated, ["sim", "k"], "left").na.fill(0, ["n"])
    obs = cells.join(observed.select("k", F.col("n").alias("obs")), "k", "left").na.fill(0, ["obs"])
    both = full.join(F.broadcast(obs), "k")
    low, high = F.avg((F.col("n") <= F.col("obs")).cast("double")), F.avg((F.col("n") >= F.col("obs")).cast("double"))
    return both.groupBy("k", "obs").agg(F.min("n").alias("min"), F.avg("n").alias("mean"), F.max("n").alias("max"), F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p"))
