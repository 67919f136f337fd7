"""Statistics of valued networks: ties with a weight, absent ones 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.numbers import label, log_factorial
from netloom.network import Network, NetworkError
from netloom.operators import terms as T
from netloom.operators.terms import Context, Part, Stat, tie_part

def _count(net: Network, title: str, test, zero_counts: bool) -> Stat:
    w = F.col("w")
    hit = tie_part(F.when(test, 1.0).otherwise(0.0))
    some = tie_part(F.when(w != 0, 1.0).otherwise(0.0))
    zeros = tie_part(F.when((w == 0) & test, 1.0).otherwise(0.0))
    if zero_counts:  # all dyads without a tie meet the test
        return Stat(title, [hit, some, zeros], lambda p: p[0] - p[2] + net.dyads() - p[1])
    return Stat(title, [hit, zeros], lambda p: p[0] - p[1])


def reciprocity(net: Network) -> DataFrame:
    """(net, a, b): values of both directions of each dyad that has any."""
    up = net.ties.where("src < dst").select("net", F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("a"))
    low = net.ties.where("src > dst").select("net", F.col("dst").alias("i"), F.col("src").alias("j"), F.col("w").alias("b"))
    return up.join(low, ["net", "i", "j"], "full").na.fill(0.0, ["a", "b"])


def two_path_values(net: Network, cyclic: bool, how: str, combine: str) -> DataFrame:
    """For each ordered pair (undirected: both orders) the combined value of its two-paths i -> k -> j (cyclic: j -> k -> i)."""
    t = net.ties.select("net", "src", "dst", "w") if net.directed else net.ends.select("net", F.col("i").alias("src"), F.col("j").alias("dst"), "w")
    a = t.select("net", F.col("src").alias("x"), F.col("dst").alias("k"), F.col("w").alias("w1"))
    b = t.select("net", F.col("src").alias("k"), F.col("dst").alias("y"), F.col("w").alias("w2"))
    value = F.least("w1", "w2") if how == "min" else F.sqrt(F.col("w1") * F.col("w2"))
    path = a.join(b, ["net", "k"]).where("x != y").groupBy("net", "x", "y").agg((F.max(value) if combine == "max" else F.sum(value)).alias("p"))
    return path.select("net", F.col("y" if cyclic else "x").alias("src"), F.col("x" if cyclic else "y").alias("dst"), "p")


def _weights(ctx, name, twopath="min", combine="max", affect="min"):
    cyclic = name == "cyclicalweights"

    def frame(net):
        p = two_path_values(net, cyclic, twopath, combine)
        return net.ties.join(p, ["net", "src", "dst"])

    value = F.least("w", "p") if affect == "min" else F.sqrt(F.col("w") * F.col("p"))
    return [Stat(f"{name}.{twopath}.{combine}.{affect}", [Part((name, twopath, combine, affect), frame, value)])]


def _covariance(ctx, name, center=False, transform="identity"):
    net = ctx.net
    t = F.sqrt("w") if "sqrt" in name or transform == "sqrt" else F.col("w")

    def frame(net):
        ends = {"nodeocovar": ["src"], "nodeosqrtcovar": ["src"], "nodeicovar": ["dst"], "nodeisqrtcovar": ["dst"]}.get(name, ["src", "dst"])
        rows = None
        for e in ends:
            one = net.ties.select("net", F.col(e).alias("v"), t.alias("t"))
            rows = one if rows is None else rows.union(one)
        return rows.groupBy("net", "v").agg(F.sum("t").alias("s"), F.sum(F.col("t") * F.col("t")).alias("q"))

    scale = (F.col("n") - 2) * (1 if name.startswith(("nodeo", "nodei")) else 2)
    parts = [Part((name, transform), frame, F.col("s") * F.col("s") - F.col("q"))]
    if center:
        parts.append(tie_part(t))
        return [Stat(name, parts, lambda p: p[0] / scale - p[1] * p[1] / net.dyads())]
    return [Stat(name, parts, lambda p: p[0] / scale)]


def valued_stats(ctx: Context, name: str, *args, **kw) -> list[Stat]:
    net, w = ctx.net, F.col("w")
    if name == "sum":
        power = kw.get("pow", args[0] if args else 1)
        return [Stat("sum" if power == 1 else f"sum{label(power)}", [tie_part(F.pow(w, F.lit(float(power))))])]
    if name in ("nonzero", "edges"):
        return [Stat("nonzero", [tie_part(F.when(w != 0, 1.0).otherwise(0.0))])]
    if name in ("atleast", "atmost", "greaterthan", "smallerthan"):
        out = []
        for x in T.as_list(kw.get("threshold", args[0] if args else 0)):
            test, zero = {"atleast": (w >= x, 0 >= x), "atmost": (w <= x, 0 <= x), "greaterthan": (w > x, 0 > x), "smallerthan": (w < x, 0 < x)}[name]
            out.append(_count(net, f"{name}.{label(x)}", test, zero))
        return out
    if name == "equalto":
        value, tolerance = kw.get("value", args[0] if args else 0), kw.get("tolerance", args[1] if len(args) > 1 else 0)
        return [_count(net, f"equalto.{label(value)}.pm.{label(tolerance)}" if tolerance else f"equalto.{label(value)}", F.abs(w - value) <= tolerance, abs(value) <= tolerance)]
    if name == "ininterval":
        lower, upper = kw.get("lower", args[0] if args else float("-inf")), kw.get("upper", args[1] if len(args) > 1 else float("inf"))
        open_ = kw.get("open", [True, True])
        test = ((w > lower) if open_[0] else (w >= lower)) & ((w < upper) if open_[1] else (w <= upper))
        zero = ((0 > lower) if open_[0] else (0 >= lower)) and ((0 < upper) if open_[1] else (0 <= upper))
        return [_count(net, f"ininterval{'(' if open_[0] else '['}{label(lower)},{label(upper)}{')' if open_[1] else ']'}", test, zero)]
    if name == "mutual":
        if not net.directed:
            raise NetworkError("mutual is for directed networks")
        form = kw.get("form", args[0] if args else "min")
        a, b = F.col("a"), F.col("b")
        value: Column = {"min": F.least(a, b), "nabsdiff": -F.abs(a - b), "product": a * b, "geometric": F.sqrt(a * b)}[form]
        return [Stat(f"mutual.{form}", [Part(("reciprocity",), reciprocity, value)])]
    if name in ("transitiveweights", "cyclicalweights"):
        return _weights(ctx, name, *args, **kw)
    if name in ("nodecovar", "nodeocovar", "nodeicovar", "nodesqrtcovar", "nodeosqrtcovar", "nodeisqrtcovar"):
        return _covariance(ctx, name, *args, **kw)
    if name == "CMP":
        return [Stat("CMP", [tie_part(log_factorial(w))])]
    if name in ("transitiveties", "cyclicalties"):
        threshold = kw.get("threshold", args[0] if args else 0)
        inner = net.with_edges(net.ties.where(w > threshold)).held()
        (got,) = T.TERMS[name](Context(inner, ctx.data), name)
        part = got.parts[0]
        return [Stat(f"{name}.{label(threshold)}" if threshold else name, [Part((*part.key, threshold), lambda _n: part.frame(inner), part.expr)])]
    form = kw.pop("form", "sum")
    out = []
    for stat in T.TERMS[name](ctx, name, *args, **kw):
        if stat.dyad is None:
            raise NetworkError(f"{name} has no valued form")
        out.append(Stat(f"{stat.name}.{form}", [tie_part(stat.dyad * (w if form == "sum" else F.when(w != 0, 1.0).otherwise(0.0)), stat.attrs)], attrs=stat.attrs))
    return out


def valued_summary(net: Network, formula: str, data: dict | None = None) -> DataFrame:
    """Statistics of a valued network: net, position, stat, value."""
    from netloom.formula import Name, Term, parse
    from netloom.plans.summary import Bound, long, wide

    net = net.held()
    ctx, stats = Context(net, data or {}), []
    for _, t in parse(formula).terms:
        t = Term(t.text) if isinstance(t, Name) else t
        stats.extend(Bound(s, net) for s in valued_stats(ctx, t.name, *t.args, **dict(t.kwargs)))
    return long(*wide(net, stats))
