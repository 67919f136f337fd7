"""Two-level networks: level A, level B, ties inside each (A-ties, B-ties) and between them (X-ties).

Three frames serve all terms: vertices with their degrees inside the level and across, ties inside a level with the
number of shared partners across, X-ties with the inner degrees of both ends. Four-cycles are a join of ties inside both
levels through two X-ties. In directed networks X-ties are the arcs from A to B.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.numbers import geometric
from netloom.network import Network, NetworkError
from netloom.operators.terms import TERMS, Context, Part, Stat, attr_name

LOG2 = math.log(2)


def _levels(ctx: Context, attr: str, levels) -> tuple:
    found = list(levels) if levels is not None else ctx.levels(attr)
    if len(found) != 2:
        raise NetworkError(f"{attr!r} has {len(found)} levels; two are needed")
    return tuple(found)


def _tied(net: Network, attr: str, levels: tuple) -> DataFrame:
    """Ties with the level of both ends: 1 for A, 2 for B."""

    def make():
        code = lambda c: F.when(c == levels[0], 1).when(c == levels[1], 2)
        t = net.ties_with([attr])
        return t.select("net", "src", "dst", code(F.col(f"s_{attr}")).alias("p"), code(F.col(f"d_{attr}")).alias("q")).where("p is not null and q is not null")

    return net.memo(("multilevel ties", attr, levels), make)


def _cross(net: Network, attr: str, levels: tuple) -> DataFrame:
    """X-ties (net, a, b) from A to B."""
    t = _tied(net, attr, levels)
    if net.directed:
        return t.where("p = 1 and q = 2").select("net", F.col("src").alias("a"), F.col("dst").alias("b"))
    x = t.where("p != q")
    return x.select("net", F.when(F.col("p") == 1, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(F.col("p") == 1, F.col("dst")).otherwise(F.col("src")).alias("b"))


def _inner(net: Network, attr: str, levels: tuple, side: int) -> DataFrame:
    return _tied(net, attr, levels).where(f"p = {side} and q = {side}").select("net", "src", "dst")


def _vertices(net: Network, attr: str, levels: tuple) -> DataFrame:
    """(net, v, side, out, in, deg, x): every vertex of both levels."""

    def make():
        side = F.when(F.col(attr) == levels[0], 1).when(F.col(attr) == levels[1], 2)
        v = net.vertices.select("net", F.col("vid").alias("v"), side.alias("side")).where("side is not null")
        t = _tied(net, attr, levels).where("p = q")
        one, zero = F.lit(1), F.lit(0)
        deg = t.select("net", F.col("src").alias("v"), one.alias("o"), zero.alias("i")).union(t.select("net", F.col("dst"), zero, one)).groupBy("net", "v").agg(F.sum("o").alias("out"), F.sum("i").alias("in"))
        x = _cross(net, attr, levels)
        across = x.select("net", F.col("a").alias("v")).union(x.select("net", F.col("b"))).groupBy("net", "v").agg(F.count("*").alias("x"))
        got = v.join(deg, ["net", "v"], "left").join(across, ["net", "v"], "left").na.fill(0, ["out", "in", "x"])
        return got.withColumn("deg", F.col("out") + F.col("in"))

    return net.memo(("multilevel vertices", attr, levels), make)


def _mutual_inner(net: Network, attr: str, levels: tuple, side: int) -> DataFrame:
    e = _inner(net, attr, levels, side)
    back = e.select("net", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.where("src < dst").join(back, ["net", "src", "dst"], "left_semi")


def _pairs(net: Network, attr: str, levels: tuple, side: int, mutual: bool) -> DataFrame:
    """Ties inside a level (mutual: reciprocated pairs) with shared partners across and the X-degrees of both ends."""

    def make():
        e = _mutual_inner(net, attr, levels, side) if mutual else _inner(net, attr, levels, side)
        mine, other = ("a", "b") if side == 1 else ("b", "a")
        x = _cross(net, attr, levels)
        p, q = x.select("net", F.col(mine).alias("src"), F.col(other).alias("k")), x.select("net", F.col(mine).alias("dst"), F.col(other).alias("k"))
        sp = e.join(p, ["net", "src"]).join(q, ["net", "dst", "k"]).groupBy("net", "src", "dst").agg(F.count("*").alias("sp"))
        v = _vertices(net, attr, levels)
        got = e.join(sp, ["net", "src", "dst"], "left").na.fill(0, ["sp"])
        for end, name in (("src", "xu"), ("dst", "xv")):
            got = got.join(v.select("net", F.col("v").alias(end), F.col("x").alias(name)), ["net", end])
        return got

    return net.memo(("multilevel pairs", attr, levels, side, mutual), make)


def _x_ties(net: Network, attr: str, levels: tuple) -> DataFrame:
    """X-ties with the inner degrees of both ends: deg_a, in_a, out_a, deg_b, in_b, out_b."""

    def make():
        got, v = _cross(net, attr, levels), _vertices(net, attr, levels)
        for end in ("a", "b"):
            got = got.join(v.select("net", F.col("v").alias(end), F.col("deg").alias(f"deg_{end}"), F.col("in").alias(f"in_{end}"), F.col("out").alias(f"out_{end}")), ["net", end])
        return got

    return net.memo(("multilevel x", attr, levels), make)


def _four_cycles(net: Network, attr: str, levels: tuple, mutual_a: bool, mutual_b: bool, opposed: bool) -> DataFrame:
    """(A-tie u, v), (B-tie w, z) and the X-ties u - w and v - z (opposed: u - z and v - w), a row for each."""
    a = _mutual_inner(net, attr, levels, 1) if mutual_a else _inner(net, attr, levels, 1)
    b = _mutual_inner(net, attr, levels, 2) if mutual_b else _inner(net, attr, levels, 2)
    if (not net.directed) or mutual_a or mutual_b:  # either end of a tie may stand at u's partner where one of the two has no direction
        b = b.union(b.select("net", F.col("dst").alias("src"), F.col("src").alias("dst")))
    x = _cross(net, attr, levels)
    path = a.select("net", F.col("src").alias("u"), F.col("dst").alias("v"))
    path = path.join(x.select("net", F.col("a").alias("u"), F.col("b").alias("r")), ["net", "u"]).join(x.select("net", F.col("a").alias("v"), F.col("b").alias("s")), ["net", "v"]).where("r != s")
    ends = ("s", "r") if opposed else ("r", "s")
    return path.join(b.select("net", F.col("src").alias(ends[0]), F.col("dst").alias(ends[1])), ["net", "r", "s"])


def _level_triangles(net: Network, attr: str, levels: tuple, side: int) -> DataFrame:
    """Triangles inside a level from each of their vertices, with the X-degree there."""
    e = _inner(net, attr, levels, side)
    p, q, r = e.select("net", F.col("src").alias("i"), F.col("dst").alias("j")), e.select("net", F.col("src").alias("j"), F.col("dst").alias("k")), e.select("net", F.col("src").alias("i"), F.col("dst").alias("k"))
    tri = p.join(q, ["net", "j"]).join(r, ["net", "i", "k"])
    each = tri.select("net", F.explode(F.array("i", "j", "k")).alias("v"))
    return each.join(_vertices(net, attr, levels).select("net", "v", "x"), ["net", "v"])


def _add(name: str, directed: bool | None, alternating: bool, key: Callable, frame: Callable, expr: Callable[[Callable[[Column], Column]], Column]) -> None:
    def make(ctx: Context, called: str, attr, *args, levels=None, decay=None, fixed=True, cutoff=30):
        attr = attr_name(attr)
        if directed is not None and ctx.net.directed != directed:
            raise NetworkError(f"{name} is for {'directed' if directed else 'undirected'} networks")
        rest = list(args)
        if alternating:
            decay = float(rest.pop(0)) if rest else LOG2 if decay is None else float(decay)
            if not fixed:
                raise NetworkError(f"{name} with a decay to be estimated is not available")
        levels = _levels(ctx, attr, rest[0] if rest else levels)
        g = (lambda c: geometric(c, decay)) if alternating else (lambda c: c)
        title = f"{name}.{attr}" + (f".{decay:g}" if alternating else "")
        return [Stat(title, [Part(("multilevel", *key(), attr, levels), lambda net: frame(net, attr, levels), expr(g).cast("double"))])]

    TERMS[name.lower()] = make


def _at(side: int, value: Callable) -> tuple:
    return (lambda: ("v",)), _vertices, lambda g: F.when(F.col("side") == side, value(g)).otherwise(0.0)


def _within(side: int, mutual: bool, value: Callable) -> tuple:
    return (lambda: ("p", side, mutual)), (lambda net, attr, levels: _pairs(net, attr, levels, side, mutual)), value


def _between(value: Callable) -> tuple:
    return (lambda: ("x",)), _x_ties, value


def _cycles(ma: bool, mb: bool, opposed: bool) -> tuple:
    return (lambda: ("c", ma, mb, opposed)), (lambda net, attr, levels: _four_cycles(net, attr, levels, ma, mb, opposed)), lambda g: F.lit(1.0)


def c(name: str) -> Column:
    return F.col(name)


for _side, _l in ((1, "A"), (2, "B")):
    _add(f"Star2{_l}X", False, False, *_at(_side, lambda g: c("deg") * c("x")))
    _add(f"AXS1{_l}", False, True, *_at(_side, lambda g: c("deg") * g(c("x"))))
    _add(f"A{_l}S1X", False, True, *_at(_side, lambda g: g(c("deg")) * c("x")))
    _add(f"A{_l}AXS", False, True, *_at(_side, lambda g: g(c("deg")) * g(c("x"))))
    _add(f"TX{_l}X", False, False, *_within(_side, False, lambda g: c("sp")))
    _add(f"ATX{_l}X", False, True, *_within(_side, False, lambda g: g(c("sp"))))
    _add(f"L3X{_l}X", None, False, *_within(_side, False, lambda g: c("xu") * c("xv")))
    _add(f"EXT{_l}", False, False, lambda side=_side: ("t", side), lambda net, attr, levels, side=_side: _level_triangles(net, attr, levels, side), lambda g: c("x"))
    for _way in ("In", "Out"):
        _w = _way.lower()
        _add(f"{_way}2Star{_l}X", True, False, *_at(_side, lambda g, w=_w: c(w) * c("x")))
        _add(f"AXS1{_l}{_w}", True, True, *_at(_side, lambda g, w=_w: c(w) * g(c("x"))))
        _add(f"A{_l}{_w}S1X", True, True, *_at(_side, lambda g, w=_w: g(c(w)) * c("x")))
    for _tie, _m in (("arc", False), ("reciprocity", True)):
        _add(f"TX{_l}X{_tie}", True, False, *_within(_side, _m, lambda g: c("sp")))
        _add(f"ATX{_l}X{_tie}", True, True, *_within(_side, _m, lambda g: g(c("sp"))))
    _add(f"L3X{_l}Xreciprocity", True, False, *_within(_side, True, lambda g: c("xu") * c("xv")))
_add("L3AXB", False, False, *_between(lambda g: c("deg_a") * c("deg_b")))
_add("ASAXASB", False, True, *_between(lambda g: g(c("deg_a")) * g(c("deg_b"))))
_add("C4AXB", False, False, *_cycles(False, False, False))
for _name, _p, _q in (("L3AXBin", "in", "in"), ("L3AXBout", "out", "out"), ("L3AXBpath", "in", "out"), ("L3BXApath", "out", "in")):
    _add(_name, True, False, *_between(lambda g, p=_p, q=_q: c(f"{p}_a") * c(f"{q}_b")))
for _p in ("in", "out"):
    for _q in ("in", "out"):
        _add(f"A{_p}ASXA{_q}BS", True, True, *_between(lambda g, p=_p, q=_q: g(c(f"{p}_a")) * g(c(f"{q}_b"))))
_add("C4AXBentrainment", True, False, *_cycles(False, False, False))
_add("C4AXBexchange", True, False, *_cycles(False, False, True))
_add("C4AXBexchangeAreciprocity", True, False, *_cycles(True, False, False))
_add("C4AXBexchangeBreciprocity", True, False, *_cycles(False, True, False))
_add("C4AXBreciprocity", True, False, *_cycles(True, True, False))
