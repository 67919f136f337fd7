"""Network statistics as plans.

A term says which shared frame it reads (ties with attributes, vertices with degrees, pairs with shared partners, ...),
one aggregate expression for each part of a statistic, and how the parts make the value. The planner (plans/summary.py)
puts all parts over one frame into one aggregation by net, so that a formula scans each frame once.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.formula import Formula, FormulaError, Name
from netloom.functions.numbers import binomial, geometric, label, log_factorial
from netloom.network import Network, NetworkError

LOG2 = math.log(2)


@dataclass
class Part:
    """sum(expr) over a frame; `frame` makes it, `key` names it so that parts share it."""

    key: tuple
    frame: Callable[[Network], DataFrame]
    expr: Column
    how: str = "sum"


@dataclass
class Stat:
    name: str
    parts: list[Part]
    #: From the parts' aggregates (and n, n1 of the net) to the value.
    final: Callable[[list[Column]], Column] = lambda p: p[0]
    #: For dyad-independent statistics: the change of a dyad over s_ and d_ attributes, src, dst.
    dyad: Column | None = None
    attrs: tuple = ()
    #: For degree statistics: f(degree) summed over vertices, of which degree, and where.
    degree: tuple | None = None
    #: For shared-partner statistics: (kind, of ties/pairs, f(sp)).
    shared: tuple | None = None


@dataclass
class Context:
    net: Network
    data: dict = field(default_factory=dict)

    def levels(self, attr: str, where: str | None = None) -> list:
        """The sorted distinct values of an attribute; whole numbers and truth values in their order, words regardless of case first."""

        def make():
            v = self.net.vertices.where(where) if where else self.net.vertices
            found = [r[0] for r in v.select(f"`{attr}`").distinct().collect()]
            if any(x is None for x in found):
                raise NetworkError(f"{attr!r} is missing for some vertices")
            return sorted(found, key=lambda x: (str(x).casefold(), str(x).swapcase()) if isinstance(x, str) else (x,))

        return self.net.memo(("levels", attr, where), make)

    def sizes(self) -> list[tuple[int, int]]:
        return self.net.memo("sizes", lambda: [(r["net"], r["n"]) for r in self.net.graphs.select("net", "n").orderBy("net").collect()])

    def one_size(self) -> int:
        return max((n for _, n in self.sizes()), default=0)


def choose(levels: list, wanted) -> list[int]:
    """Places of the selected levels: TRUE or NULL all, names, places from 1, negative places to leave out, a list of truth values."""
    if wanted is None or wanted is True:
        return list(range(len(levels)))
    some = wanted if isinstance(wanted, list) else [wanted]
    if some and all(isinstance(x, bool) for x in some):
        return [k for k, x in enumerate(some) if x]
    if some and all(isinstance(x, int) for x in some):
        if all(x < 0 for x in some):
            return [k for k in range(len(levels)) if -(k + 1) not in some]
        return [x - 1 for x in some if 0 < x <= len(levels)]
    found = [label(x) for x in levels]
    return [found.index(label(x)) for x in some if label(x) in found]


def as_list(x) -> list:
    return x if isinstance(x, list) else [x]


def attr_name(x) -> str:
    if isinstance(x, Formula):
        x = x.terms[0][1]
    if isinstance(x, Name):
        return x.text
    if isinstance(x, str):
        return x
    if hasattr(x, "name"):
        return x.name
    raise FormulaError(f"an attribute is expected, not {x!r}")


# --- frames ---------------------------------------------------------------------------------------------------------------


def tie_part(expr: Column, attrs: tuple = (), degrees: bool = False) -> Part:
    # the planner replaces this frame by one with all attributes that any term wants
    return Part(("ties", degrees), lambda net: net.ties_with(list(attrs), degrees), expr)


def vertex_part(expr: Column) -> Part:
    return Part(("vertices",), lambda net: net.degrees, expr)


def pair_part(kind: str, expr: Column) -> Part:
    """Pairs that are tied or share partners: sp, y."""

    def make(net: Network) -> DataFrame:
        t = net.ties.select("net", F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1).alias("y"))
        p = net.two_paths(kind)
        if net.bipartite:  # partners stand between vertices of one mode, ties between the modes
            return p.join(net.vertices.select("net", F.col("vid").alias("i"), "mode"), ["net", "i"]).withColumn("y", F.lit(0))
        return p.join(t, ["net", "i", "j"], "full").na.fill(0, ["sp", "y"])

    return Part(("pairs", kind), make, expr)


def dyadic(name: str, expr: Column, *attrs: str) -> Stat:
    return Stat(name, [tie_part(expr.cast("double"), attrs)], dyad=expr.cast("double"), attrs=attrs)


def by_degree(name: str, f: Callable[[Column], Column], which: str = "deg", where: Column | None = None, final=None) -> Stat:
    value = f(F.col(which)).cast("double")
    if where is not None:
        value = F.when(where, value).otherwise(0.0)
    return Stat(name, [vertex_part(value)], final or (lambda p: p[0]), degree=(f, which, where))


TERMS: dict[str, Callable] = {}


def term(*names: str):
    def add(f):
        for n in names:
            TERMS[n] = f
        return f

    return add


def register_term(name: str, make: Callable) -> None:
    """A term of one's own: make(ctx, name, *args, **kwargs) gives its statistics as Stat, from parts over shared frames
    (tie_part, vertex_part, pair_part or a Part of its own); dyadic() makes one that a dyad's attributes decide."""
    if name in TERMS:
        raise FormulaError(f"there is a term {name!r} already")
    TERMS[name] = make


def directed_only(ctx: Context, name: str, wanted: bool = True) -> None:
    if ctx.net.directed != wanted:
        raise NetworkError(f"{name} is for {'directed' if wanted else 'undirected'} networks")


def s(attr: str) -> Column:
    return F.col(f"s_{attr}")


def d(attr: str) -> Column:
    return F.col(f"d_{attr}")


def is_one(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


# --- dyadic terms ---------------------------------------------------------------------------------------------------------


@term("edges")
def edges(ctx, name):
    return [dyadic("edges", F.lit(1.0))]


@term("density")
def density(ctx, name):
    return [Stat("density", [tie_part(F.lit(1.0))], lambda p: p[0] / ctx.net.dyads())]


@term("meandeg")
def meandeg(ctx, name):
    return [Stat("meandeg", [tie_part(F.lit(1.0))], lambda p: p[0] * (1 if ctx.net.directed else 2) / F.col("n"))]


def _matched(ctx, name, frame_key, frame, attr, diff, levels, prefix, by=False):
    if attr is None:
        return [Stat(prefix, [Part(frame_key, frame, F.lit(1.0))])]
    every = ctx.levels(attr)
    chosen = choose(every, levels)
    full = levels is None or levels is True
    if by:
        return [Stat(f"{prefix}.by.{attr}.{label(every[k])}", [Part(frame_key, frame, is_one(s(attr) == every[k]) + is_one(d(attr) == every[k]))]) for k in chosen]
    if diff:
        return [Stat(f"{prefix}.{attr}.{label(every[k])}", [Part(frame_key, frame, is_one((s(attr) == every[k]) & (d(attr) == every[k])))]) for k in chosen]
    inside = F.lit(True) if full else s(attr).isin([every[k] for k in chosen])
    return [Stat(f"{prefix}.{attr}", [Part(frame_key, frame, is_one((s(attr) == d(attr)) & inside))])]


@term("mutual")
def mutual(ctx, name, same=None, by=None, diff=False, keep=None, levels=None):
    directed_only(ctx, name)
    attr = attr_name(same or by) if same or by else None

    def frame(net):
        return net.memo(("mutual pairs", attr), lambda: net.with_edges(net.mutual_arcs.where("src < dst")).ties_with([attr] if attr else []))

    got = _matched(ctx, name, ("mutual pairs", attr), frame, attr, diff, levels if levels is not None else keep, "mutual", by is not None)
    if same and diff:
        for x in got:
            x.name = x.name.replace("mutual.", "mutual.same.", 1)
    return got


@term("asymmetric")
def asymmetric(ctx, name, attr=None, diff=False, keep=None, levels=None):
    directed_only(ctx, name)
    attr = attr_name(attr) if attr else None

    def frame(net):
        back = net.ties.select("net", F.col("dst").alias("src"), F.col("src").alias("dst"))
        return net.memo(("asymmetric", attr), lambda: net.with_edges(net.ties.join(back, ["net", "src", "dst"], "left_anti")).ties_with([attr] if attr else []))

    return _matched(ctx, name, ("asymmetric", attr), frame, attr, diff, levels if levels is not None else keep, "asymmetric")


def _each_vertex(ctx, name, which, nodes, mode=None, attr=None):
    n = ctx.one_size()
    if mode is not None:
        n1 = ctx.net.graphs.agg(F.max("n1")).first()[0]
        ids = list(range(n1)) if mode == 1 else list(range(n1, n))
    else:
        ids = list(range(n))
    chosen = choose(ids, nodes)
    if attr:
        match = ctx.net.memo(("same ends", attr), lambda: ctx.net.ties_with([attr]))
        del match
        return [Stat(f"{name}{ids[k] + 1}.{attr}", [tie_part(is_one((s(attr) == d(attr)) & ((F.col("src") == ids[k]) | (F.col("dst") == ids[k]))), (attr,))], dyad=is_one((s(attr) == d(attr)) & ((F.col("src") == ids[k]) | (F.col("dst") == ids[k]))), attrs=(attr,)) for k in chosen]
    here = {"out": lambda v: F.col("src") == v, "in": lambda v: F.col("dst") == v, "deg": lambda v: (F.col("src") == v) | (F.col("dst") == v)}[which]
    return [Stat(f"{name}{ids[k] + 1}", [tie_part(is_one(here(ids[k])))], dyad=is_one(here(ids[k]))) for k in chosen]


@term("sender")
def sender(ctx, name, base=1, nodes=-1):
    directed_only(ctx, name)
    return _each_vertex(ctx, name, "out", nodes)


@term("receiver")
def receiver(ctx, name, base=1, nodes=-1):
    directed_only(ctx, name)
    return _each_vertex(ctx, name, "in", nodes)


@term("sociality")
def sociality(ctx, name, attr=None, base=1, levels=None, nodes=-1):
    directed_only(ctx, name, False)
    return _each_vertex(ctx, name, "deg", nodes, attr=attr_name(attr) if attr else None)


@term("b1sociality", "b2sociality")
def bsociality(ctx, name, nodes=-1):
    return _each_vertex(ctx, name, "deg", nodes, mode=int(name[1]))


def _covariate(ctx, x) -> DataFrame:
    frame = ctx.data.get(attr_name(x))
    if frame is None:
        raise NetworkError(f"no dyadic covariate {attr_name(x)!r}")
    if "net" not in frame.columns:
        frame = ctx.net.graphs.select("net").join(frame)
    return frame.select("net", F.col("i").cast("long").alias("src"), F.col("j").cast("long").alias("dst"), F.col("x").cast("double").alias("x"))


@term("edgecov")
def edgecov(ctx, name, x, attrname=None):
    cov = _covariate(ctx, x)
    key = attr_name(x)
    if not ctx.net.directed:
        cov = cov.where("src < dst")
    frame = lambda net: net.ties.join(cov, ["net", "src", "dst"])
    return [Stat(f"edgecov.{attrname or key}", [Part(("edgecov", key), frame, F.col("x"))])]


@term("dyadcov")
def dyadcov(ctx, name, x):
    if not ctx.net.directed:
        got = edgecov(ctx, name, x)
        got[0].name = f"dyadcov.{attr_name(x)}"
        return got
    cov, key = _covariate(ctx, x).where("src < dst"), attr_name(x)

    def frame(net):
        up = net.ties.where("src < dst").select("net", "src", "dst", F.lit(1).alias("up"))
        low = net.ties.where("src > dst").select("net", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("low"))
        return up.join(low, ["net", "src", "dst"], "full").na.fill(0).join(cov, ["net", "src", "dst"])

    return [Stat(f"dyadcov.{key}.{kind}", [Part(("dyadcov", key), frame, F.when(F.expr(rule), F.col("x")).otherwise(0.0))]) for kind, rule in (("mutual", "up = 1 and low = 1"), ("utri", "up = 1 and low = 0"), ("ltri", "up = 0 and low = 1"))]


@term("hamming")
def hamming(ctx, name, x=None, cov=None):
    ref = _covariate(ctx, x).where("x != 0").select("net", "src", "dst", F.lit(1).alias("r")) if x is not None else ctx.net.ties.select("net", "src", "dst", F.lit(1).alias("r"))
    weight = _covariate(ctx, cov) if cov is not None else None
    key = attr_name(x) if x is not None else ""

    def frame(net):
        both = net.ties.select("net", "src", "dst", F.lit(1).alias("y")).join(ref, ["net", "src", "dst"], "full").na.fill(0, ["y", "r"]).where("y != r")
        return both.withColumn("x", F.lit(1.0)) if weight is None else both.join(weight, ["net", "src", "dst"])

    return [Stat("hamming" + (f".{key}" if key else "") + (f".{attr_name(cov)}" if cov is not None else ""), [Part(("hamming", key, str(cov)), frame, F.col("x"))])]


@term("attrcov")
def attrcov(ctx, name, attr, mat):
    attr = attr_name(attr)
    every, table = ctx.levels(attr), ctx.data.get(attr_name(mat))
    if table is None:
        raise NetworkError(f"no matrix {mat!r}")
    cells = F.lit(0.0)
    for i, a in enumerate(every):
        for j, b in enumerate(every):
            cells = F.when((s(attr) == a) & (d(attr) == b), float(table[i][j])).otherwise(cells)
    return [dyadic(f"attrcov.{attr}.{attr_name(mat)}", cells, attr)]


# --- degrees --------------------------------------------------------------------------------------------------------------


def _same_level_degrees(net: Network, attr: str) -> DataFrame:
    """Degrees over ties inside a level, by vertex."""

    def make():
        inside = net.with_edges(net.ties_with([attr]).where(F.col(f"s_{attr}") == F.col(f"d_{attr}")).select("net", "src", "dst", "w"))
        return inside.degrees

    return net.memo(("same level degrees", attr), make)


_WHICH = {"k": "deg", "i": "in", "o": "out"}


def _mode(name: str) -> Column | None:
    return F.col("mode") == int(name[1]) if name[:2] in ("b1", "b2") else None


def _bip(ctx, name):
    if name[:2] in ("b1", "b2") and not ctx.net.bipartite:
        raise NetworkError(f"{name} needs a bipartite network")


@term("kstar", "istar", "ostar", "b1star", "b2star")
def stars(ctx, name, k, attr=None, levels=None):
    _bip(ctx, name)
    if name == "kstar":
        directed_only(ctx, name, False)
    which = {"istar": "in", "ostar": "out"}.get(name, "deg")
    if attr is None:
        return [by_degree(f"{name}{x}", lambda c, x=x: binomial(c, x), which, _mode(name)) for x in as_list(k)]
    attr = attr_name(attr)
    every = ctx.levels(attr)
    chosen = choose(every, levels)
    inside = F.col(attr).isin([every[c] for c in chosen])
    out = []
    for x in as_list(k):
        where = inside if _mode(name) is None else inside & _mode(name)
        out.append(Stat(f"{name}{x}.{attr}", [Part(("same level", attr), lambda net: _same_level_degrees(net, attr), F.when(where, binomial(F.col(which), x)).otherwise(0.0))]))
    return out


def _degree_range(ctx, name, ranges, by, homophily, levels):
    _bip(ctx, name)
    base = name.replace("range", "")
    mode = _mode(name)
    which = "in" if name.startswith("i") else "out" if name.startswith("o") else "deg"
    prefix = {"degree": "degree", "degrange": "deg", "idegree": "idegree", "odegree": "odegree", "idegrange": "ideg", "odegrange": "odeg", "b1degree": "b1degree", "b2degree": "b2degree", "b1degrange": "b1deg", "b2degrange": "b2deg", "b1mindegree": "b1mindeg", "b2mindegree": "b2mindeg", "concurrent": "concurrent", "b1concurrent": "b1concurrent", "b2concurrent": "b2concurrent"}[name]
    del base
    out = []
    titles = []
    for lo, hi, exact in ranges:
        if "concurrent" in name:
            titles.append(prefix)
        elif exact or "mindegree" in name:
            titles.append(f"{prefix}{lo}")
        else:
            titles.append(f"{prefix}{lo}+" if hi is None else f"{prefix}{lo}to{hi}")
    tests = [(lambda c, lo=lo, hi=hi: ((c >= lo) if hi is None else (c >= lo) & (c < hi)).cast("double")) for lo, hi, _ in ranges]
    if by is None:
        return [by_degree(t, f, which, mode) for t, f in zip(titles, tests)]
    by = attr_name(by)
    if homophily:
        for t, f in zip(titles, tests):
            value = f(F.col(which)) if mode is None else F.when(mode, f(F.col(which))).otherwise(0.0)
            out.append(Stat(f"{t}.homophily.{by}", [Part(("same level", by), lambda net: _same_level_degrees(net, by), value)]))
        return out
    every = ctx.levels(by)
    for k in choose(every, levels):
        for t, f in zip(titles, tests):
            where = F.col(by) == every[k]
            dot = "." if "range" in name or "concurrent" not in name and "degree" not in name else ""
            out.append(by_degree(f"{t}.{by}{dot}{label(every[k])}", f, which, where if mode is None else where & mode))
    return out


@term("degree", "idegree", "odegree", "b1degree", "b2degree")
def degree(ctx, name, d, by=None, homophily=False, levels=None):
    if name == "degree":
        directed_only(ctx, name, False)
    return _degree_range(ctx, name, [(x, x + 1, True) for x in as_list(d)], by, homophily, levels)


@term("degrange", "idegrange", "odegrange", "b1degrange", "b2degrange")
def degrange(ctx, name, from_=0, to=None, by=None, homophily=False, levels=None):
    los, his = as_list(from_), as_list(to)
    his = his * len(los) if len(his) == 1 else his
    los = los * len(his) if len(los) == 1 else los
    return _degree_range(ctx, name, [(a, None if b is None or b == float("inf") else b, False) for a, b in zip(los, his)], by, homophily, levels)


@term("b1mindegree", "b2mindegree")
def bmindegree(ctx, name, d):
    return _degree_range(ctx, name, [(x, None, False) for x in as_list(d)], None, False, None)


@term("concurrent", "b1concurrent", "b2concurrent")
def concurrent(ctx, name, by=None, levels=None):
    return _degree_range(ctx, name, [(2, None, True)], by, False, levels)


@term("concurrentties")
def concurrentties(ctx, name, by=None, levels=None):
    f = lambda c: F.greatest(c - 1, F.lit(0))
    if by is None:
        return [by_degree(name, f)]
    by = attr_name(by)
    every = ctx.levels(by)
    return [by_degree(f"{name}.{by}{label(every[k])}", f, "deg", F.col(by) == every[k]) for k in choose(every, levels)]


@term("degree1.5", "idegree1.5", "odegree1.5")
def degree_power(ctx, name):
    which = {"i": "in", "o": "out"}.get(name[0], "deg")
    return [by_degree(name, lambda c: F.pow(c.cast("double"), F.lit(1.5)), which)]


@term("isolates")
def isolates(ctx, name):
    return [by_degree(name, lambda c: (c == 0).cast("double"))]


@term("isolatededges")
def isolatededges(ctx, name):
    return [Stat(name, [tie_part(is_one((F.col("s_deg") == 1) & (F.col("d_deg") == 1)), degrees=True)])]


@term("degcrossprod")
def degcrossprod(ctx, name):
    directed_only(ctx, name, False)
    return [Stat(name, [tie_part((F.col("s_deg") * F.col("d_deg")).cast("double"), degrees=True), tie_part(F.lit(1.0))], lambda p: F.when(p[1] > 0, p[0] / p[1]).otherwise(0.0))]


@term("degcor")
def degcor(ctx, name):
    directed_only(ctx, name, False)
    a, b = F.col("s_deg").cast("double"), F.col("d_deg").cast("double")
    parts = [tie_part(2 * a * b, degrees=True), tie_part(a + b, degrees=True), tie_part(a * a + b * b, degrees=True), tie_part(F.lit(2.0))]

    def final(p):
        mean = p[1] / p[3]
        var = p[2] / p[3] - mean * mean
        return F.when((p[3] > 0) & (var > 0), (p[0] / p[3] - mean * mean) / var).otherwise(0.0)

    return [Stat(name, parts, final)]


@term("altkstar")
def altkstar(ctx, name, lambda_=2.0, fixed=False):
    r = 1 - 1 / lambda_
    return [by_degree(f"altkstar.{lambda_:g}", lambda c: lambda_**2 * (F.pow(F.lit(r), c) - 1 + c / lambda_))]


@term("twopath", "m2star")
def twopath(ctx, name):
    if not ctx.net.directed:
        if name == "m2star":
            directed_only(ctx, name)
        return [by_degree(name, lambda c: binomial(c, 2))]
    pairs = Part(("mutual arcs",), lambda net: net.mutual_arcs, F.lit(1.0))
    return [Stat(name, [vertex_part((F.col("in") * F.col("out")).cast("double")), pairs], lambda p: p[0] - p[1])]


def _curved(ctx, prefix, cutoff, count_part, largest):
    """Histogram statistics #1..#K and an overflow: the linear statistics of a term whose decay is estimated."""
    top = min(cutoff, largest)
    out = [Stat(f"{prefix}#{k}", [count_part(lambda c, k=k: (c == k).cast("double"))]) for k in range(1, top + 1)]
    if largest > cutoff:
        out.append(Stat(f"{prefix}#>{cutoff}", [count_part(lambda c: (c > cutoff).cast("double"))]))
    return out


@term("gwdegree", "gwidegree", "gwodegree", "gwb1degree", "gwb2degree")
def gwdegree(ctx, name, decay=0.5, fixed=False, attr=None, cutoff=30, levels=None):
    short = {"gwdegree": "gwdeg", "gwidegree": "gwideg", "gwodegree": "gwodeg", "gwb1degree": "gwb1deg", "gwb2degree": "gwb2deg"}[name]
    mode = _mode(name[2:])
    which = {"gwidegree": "in", "gwodegree": "out"}.get(name, "deg")
    f = lambda c: geometric(c, float(decay))
    if attr is not None:
        attr = attr_name(attr)
        every = ctx.levels(attr)
        return [by_degree(f"{short}{float(decay):g}.{attr}.{label(every[k])}", f, which, (F.col(attr) == every[k]) if mode is None else (F.col(attr) == every[k]) & mode) for k in choose(every, levels)]
    if fixed:
        return [by_degree(f"{short}.fixed.{float(decay):g}", f, which, mode)]
    part = lambda g: vertex_part(g(F.col(which)) if mode is None else F.when(mode, g(F.col(which))).otherwise(0.0))
    return _curved(ctx, short, cutoff, part, ctx.one_size() - 1)


# --- triads and shared partners ---------------------------------------------------------------------------------------------


def _triangles(net: Network, kind: str, attr: str | None) -> DataFrame:
    """One row for each triangle (undirected, transitive triple, or cycle), with the level where attr is given."""

    def make():
        t = net.ties_with([attr]) if attr else net.ties
        if attr:
            t = t.where(F.col(f"s_{attr}") == F.col(f"d_{attr}")).select("net", "src", "dst", F.col(f"s_{attr}").alias("level"))
        else:
            t = t.select("net", "src", "dst", F.lit(0).alias("level"))
        if kind == "undirected":  # from the end of smaller degree, so that hubs are not paired with themselves
            deg = net.degrees.select("net", "vid", "deg")
            u = t.join(deg.select("net", F.col("vid").alias("src"), F.col("deg").alias("a")), ["net", "src"]).join(deg.select("net", F.col("vid").alias("dst"), F.col("deg").alias("b")), ["net", "dst"])
            first = (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("src") < F.col("dst")))
            o = u.select("net", "level", F.when(first, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("y"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("yd"))
            p, q = o.select("net", "level", "x", F.col("y").alias("y1"), F.col("yd").alias("d1")), o.select("net", "x", F.col("y").alias("y2"), F.col("yd").alias("d2"))
            wedge = p.join(q, ["net", "x"]).where("d1 < d2 or (d1 = d2 and y1 < y2)")
            close = o.select("net", F.col("x").alias("y1"), F.col("y").alias("y2"))
            return wedge.join(close, ["net", "y1", "y2"], "left_semi").select("net", "level")
        a = t.select("net", "level", F.col("src").alias("i"), F.col("dst").alias("j"))
        b = t.select("net", F.col("src").alias("j"), F.col("dst").alias("k"))
        path = a.join(b, ["net", "j"]).where("i != k")
        ends = ("i", "k") if kind == "transitive" else ("k", "i")
        c = t.select("net", F.col("src").alias(ends[0]), F.col("dst").alias(ends[1]))
        return path.join(c, ["net", "i", "k"], "left_semi").select("net", "level")

    return net.memo(("triangles", kind, attr), make)


def _triangle_stat(ctx, name, kinds, attr, diff, levels):
    attr = attr_name(attr) if attr else None
    part = lambda kind, e: Part(("triangles", kind, attr), lambda net: _triangles(net, kind, attr), e)

    def total(e):
        return [part(k, e) for k, _ in kinds], lambda p: reduce(lambda a, b: a + b, [x / w for x, (_, w) in zip(p, kinds)])

    if attr is None:
        return [Stat(name, *total(F.lit(1.0)))]
    every = ctx.levels(attr)
    chosen = choose(every, levels)
    if diff:
        return [Stat(f"{name}.{attr}.{label(every[k])}", *total(is_one(F.col("level") == every[k]))) for k in chosen]
    return [Stat(f"{name}.{attr}", *total(is_one(F.col("level").isin([every[k] for k in chosen]))))]


@term("triangle", "triangles")
def triangle(ctx, name, attr=None, diff=False, levels=None):
    kinds = [("transitive", 1), ("cyclic", 3)] if ctx.net.directed else [("undirected", 1)]
    return _triangle_stat(ctx, "triangle", kinds, attr, diff, levels)


@term("ttriple", "ttriad")
def ttriple(ctx, name, attr=None, diff=False, levels=None):
    directed_only(ctx, name)
    return _triangle_stat(ctx, "ttriple", [("transitive", 1)], attr, diff, levels)


@term("ctriple", "ctriad")
def ctriple(ctx, name, attr=None, diff=False, levels=None):
    directed_only(ctx, name)
    return _triangle_stat(ctx, "ctriple", [("cyclic", 3)], attr, diff, levels)


@term("tripercent")
def tripercent(ctx, name, attr=None, diff=False, levels=None):
    directed_only(ctx, name, False)
    got = _triangle_stat(ctx, "tripercent", [("undirected", 1)], attr, diff, levels)
    key = attr_name(attr) if attr else None
    every = ctx.levels(key) if key else []
    chosen = choose(every, levels) if key else []
    for k, stat in enumerate(got):
        if key is None:
            two = vertex_part(binomial(F.col("deg"), 2))
        else:
            inside = (F.col(key) == every[chosen[k]]) if diff else F.col(key).isin([every[c] for c in chosen])
            two = Part(("same level", key), lambda net: _same_level_degrees(net, key), F.when(inside, binomial(F.col("deg"), 2)).otherwise(0.0))
        stat.parts.append(two)
        stat.final = lambda p: F.coalesce(100 * p[0] / F.when(p[1] - 2 * p[0] > 0, p[1] - 2 * p[0]), F.lit(0.0))  # T + open two-paths
    return got


@term("opentriad")
def opentriad(ctx, name):
    directed_only(ctx, name, False)
    t = _triangle_stat(ctx, name, [("undirected", 1)], None, False, None)[0]
    return [Stat(name, [vertex_part(binomial(F.col("deg"), 2)), *t.parts], lambda p: p[0] - 3 * p[1])]


SP_KINDS = ("OTP", "ITP", "RTP", "OSP", "ISP")


def _kind(ctx, type_):
    if not ctx.net.directed:
        return "UTP", ""
    if type_ not in SP_KINDS:
        raise FormulaError(f"no type {type_!r} of shared partners")
    return type_, f".{type_}"


def _over(name: str) -> tuple[str, Column]:
    """Which pairs a shared-partner term looks at."""
    which = name.lstrip("d") if name.startswith("dd") or name[1:4] in ("esp", "dsp", "nsp") and name[0] == "d" and name != "dsp" else name
    letter = next(c for c in ("esp", "dsp", "nsp") if c in (which if name not in ("dsp", "ddsp") else "dsp"))
    return letter, {"esp": F.col("y") == 1, "dsp": F.lit(True), "nsp": F.col("y") == 0}[letter]


@term("esp", "dsp", "nsp", "desp", "ddsp", "dnsp")
def shared(ctx, name, d, type="OTP"):
    if name in ("desp", "ddsp", "dnsp"):
        directed_only(ctx, name)
    kind, tag = _kind(ctx, type)
    base = name if len(name) == 3 else name[1:]
    where = {"esp": F.col("y") == 1, "dsp": F.lit(True), "nsp": F.col("y") == 0}[base]
    out = []
    for x in as_list(d):
        hit = pair_part(kind, is_one(where & (F.col("sp") == x)))
        if x > 0 or base == "esp":
            out.append(Stat(f"{base}{tag}{x}", [hit], shared=(kind, base, lambda c, x=x: (c == x).cast("double"))))
        else:  # pairs without partners by complement: those of the frame that have some, or are tied
            rest = pair_part(kind, is_one(F.lit(True) & ((F.col("sp") > 0) if base == "dsp" else (F.col("sp") > 0) | (F.col("y") == 1))))
            out.append(Stat(f"{base}{tag}{x}", [rest], lambda p: ctx.net.dyads() - p[0], shared=(kind, base, lambda c: (c == 0).cast("double"))))
    return out


@term("gwesp", "gwdsp", "gwnsp", "dgwesp", "dgwdsp", "dgwnsp")
def gwshared(ctx, name, decay=0.5, fixed=False, cutoff=30, type="OTP"):
    if name.startswith("d"):
        directed_only(ctx, name)
    kind, tag = _kind(ctx, type)
    base = name[-3:]
    where = {"esp": F.col("y") == 1, "dsp": F.lit(True), "nsp": F.col("y") == 0}[base]
    f = lambda c: geometric(c, float(decay))
    if fixed:
        return [Stat(f"gw{base}{tag}.fixed.{float(decay):g}", [pair_part(kind, F.when(where, f(F.col("sp"))).otherwise(0.0))], shared=(kind, base, f))]
    part = lambda g: pair_part(kind, F.when(where, g(F.col("sp"))).otherwise(0.0))
    return _curved(ctx, f"{base}{tag}", cutoff, part, max(0, ctx.one_size() - 2))


@term("b1dsp", "b2dsp")
def bdsp(ctx, name, d):
    _bip(ctx, name)
    mode = F.col("mode") == int(name[1])
    out = []
    for x in as_list(d):
        if x:
            out.append(Stat(f"{name}{x}", [pair_part("UTP", is_one(mode & (F.col("sp") == x)))]))
        else:
            m = F.col("n1") if name[1] == "1" else F.col("n") - F.col("n1")
            out.append(Stat(f"{name}0", [pair_part("UTP", is_one(mode))], lambda p, m=m: m * (m - 1) / 2 - p[0]))
    return out


@term("gwb1dsp", "gwb2dsp")
def gwbdsp(ctx, name, decay=0.5, fixed=False, cutoff=30):
    _bip(ctx, name[2:])
    mode = F.col("mode") == int(name[3])
    part = lambda g: pair_part("UTP", F.when(mode, g(F.col("sp"))).otherwise(0.0))
    if fixed:
        return [Stat(f"{name}.fixed.{float(decay):g}", [part(lambda c: geometric(c, float(decay)))])]
    return _curved(ctx, name[2:], cutoff, part, ctx.one_size())


@term("transitiveties", "cyclicalties")
def supported(ctx, name, attr=None, levels=None):
    attr = attr_name(attr) if attr else None

    def frame(net):
        inner = net if attr is None else net.with_edges(net.ties_with([attr]).where(F.col(f"s_{attr}") == F.col(f"d_{attr}")).select("net", "src", "dst", "w"))
        p = inner.two_paths("UTP" if not net.directed else "OTP" if name == "transitiveties" else "ITP")
        return inner.ties.join(p.select("net", F.col("i").alias("src"), F.col("j").alias("dst")), ["net", "src", "dst"], "left_semi")

    return [Stat(name + (f".{attr}" if attr else ""), [Part(("supported", name, attr), frame, F.lit(1.0))])]


@term("simmelianties")
def simmelianties(ctx, name):
    directed_only(ctx, name)

    def frame(net):
        p = net.two_paths("RTP")
        return net.mutual_arcs.join(p.select("net", F.col("i").alias("src"), F.col("j").alias("dst")), ["net", "src", "dst"], "left_semi")

    return [Stat(name, [Part(("simmelian",), frame, F.lit(1.0))])]


@term("threetrail", "threepath")
def threetrail(ctx, name, keep=None, levels=None):
    if not ctx.net.directed:
        return [Stat("threetrail", [tie_part(((F.col("s_deg") - 1) * (F.col("d_deg") - 1)).cast("double"), degrees=True)])]
    arcs = Part(("mutual arcs",), lambda net: net.mutual_arcs, F.lit(1.0))
    kinds = [
        ("RRR", F.col("s_in") * F.col("d_out"), True),
        ("RRL", F.col("s_in") * (F.col("d_in") - 1), False),
        ("LRR", (F.col("s_out") - 1) * F.col("d_out"), False),
        ("LRL", (F.col("s_out") - 1) * (F.col("d_in") - 1), False),
    ]
    chosen = choose(kinds, levels if levels is not None else keep)
    return [Stat(f"threetrail.{kinds[k][0]}", [tie_part(kinds[k][1].cast("double"), degrees=True), arcs], (lambda p: p[0] - p[1]) if kinds[k][2] else (lambda p: p[0])) for k in chosen]


@term("localtriangle")
def localtriangle(ctx, name, x):
    near = _covariate(ctx, x).where("x != 0").select("net", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()

    def frame(net):
        t = net.ties.join(near if not net.directed else near.union(near.select("net", F.col("dst").alias("src"), F.col("src").alias("dst"))), ["net", "src", "dst"], "left_semi")
        inner = net.with_edges(t)
        if not net.directed:
            return _triangles(inner, "undirected", None).withColumn("c", F.lit(1.0))
        return _triangles(inner, "transitive", None).withColumn("c", F.lit(1.0)).union(_triangles(inner, "cyclic", None).withColumn("c", F.lit(1.0) / 3))

    return [Stat("localtriangle." + attr_name(x), [Part(("local", attr_name(x)), frame, F.col("c"))])]


@term("cycle")
def cycle(ctx, name, k, semi=False):
    kind_directed = ctx.net.directed and not semi
    out = []
    for length in as_list(k):
        if length < (2 if kind_directed else 3):
            raise FormulaError(f"no cycles of length {length}")

        def frame(net, length=length):
            if kind_directed:
                a = net.ties.select("net", F.col("src").alias("u"), F.col("dst").alias("v"))
            else:
                und = net.symmetrized("weak") if net.directed else net
                a = und.ends.select("net", F.col("i").alias("u"), F.col("j").alias("v"))
            path = a.select("net", F.col("u").alias("p0"), F.col("v").alias("p1")).where("p0 < p1")  # the start is the least vertex
            for step in range(2, length):
                nxt = a.select("net", F.col("u").alias(f"p{step - 1}"), F.col("v").alias(f"p{step}"))
                path = path.join(nxt, ["net", f"p{step - 1}"]).where(" and ".join([f"p{step} > p0", *[f"p{step} != p{q}" for q in range(1, step)]]))
            close = a.select("net", F.col("u").alias(f"p{length - 1}"), F.col("v").alias("p0"))
            path = path.join(close, ["net", f"p{length - 1}", "p0"], "left_semi")
            return path if kind_directed else path.where(f"p1 < p{length - 1}")

        out.append(Stat(f"{'semicycle' if semi and ctx.net.directed else 'cycle'}{length}", [Part(("cycle", length, semi), frame, F.lit(1.0))]))
    return out


#: The sixteen triad types in their usual order (fixed values).
TRIADS = ("003", "012", "102", "021D", "021U", "021C", "111D", "111U", "030T", "030C", "201", "120D", "120U", "120C", "210", "300")


def triad_type(ab: int, ac: int, bc: int) -> str:
    """Type of a triad from its dyads' states: 1 forward, 2 backward, 3 both."""
    arcs = {(0, 1): ab & 1, (1, 0): ab >> 1, (0, 2): ac & 1, (2, 0): ac >> 1, (1, 2): bc & 1, (2, 1): bc >> 1}
    kinds = [x for x in (ab, ac, bc)]
    m, a, n = kinds.count(3), sum(x in (1, 2) for x in kinds), kinds.count(0)
    base = f"{m}{a}{n}"
    asym = [(i, j) for (i, j), y in arcs.items() if y and not arcs[j, i]]
    out = [sum(1 for i, _ in asym if i == v) for v in range(3)]
    inn = [sum(1 for _, j in asym if j == v) for v in range(3)]
    if base in ("021", "120"):
        return base + ("D" if 2 in out else "U" if 2 in inn else "C")
    if base == "030":
        return base + ("T" if 2 in out else "C")
    if base == "111":  # whether the single arc goes to the mutual pair or comes from it
        both = {v for (i, j), y in arcs.items() if y and arcs[j, i] for v in (i, j)}
        return base + ("D" if asym[0][1] in both else "U")
    return base


def _triads(net: Network) -> DataFrame:
    """Triples with at least two tied dyads, by type."""

    def make():
        states = net.ties.groupBy("net", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(F.when(F.col("src") < F.col("dst"), 1).otherwise(2)).alias("state"))
        ends = states.select("net", F.col("a").alias("i"), F.col("b").alias("j")).union(states.select("net", F.col("b"), F.col("a")))
        x, y = ends.select("net", F.col("i").alias("k"), F.col("j").alias("u")), ends.select("net", F.col("i").alias("k"), F.col("j").alias("v"))
        triple = x.join(y, ["net", "k"]).where("u < v").select("net", F.least("k", "u").alias("a"), F.greatest("k", "v").alias("c"), (F.col("k") + F.col("u") + F.col("v") - F.least("k", "u") - F.greatest("k", "v")).alias("b")).distinct()
        for name, (p, q) in {"ab": ("a", "b"), "ac": ("a", "c"), "bc": ("b", "c")}.items():
            triple = triple.join(states.select("net", F.col("a").alias(p), F.col("b").alias(q), F.col("state").alias(name)), ["net", p, q], "left")
        code = F.coalesce("ab", F.lit(0)) * 16 + F.coalesce("ac", F.lit(0)) * 4 + F.coalesce("bc", F.lit(0))
        names = F.array(*[F.lit(triad_type(c >> 4, c >> 2 & 3, c & 3)) for c in range(64)])
        triple = triple.select("net", F.get(names, code.cast("int")).alias("type"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("ab", "ac", "bc")])
        return triple.groupBy("net", "type").agg(F.count("*").cast("double").alias("c"), F.sum(sum((is_one(F.col(x).isin(1, 2)) for x in ("ab", "ac", "bc")), F.lit(0.0))).alias("asym"), F.sum(sum((is_one(F.col(x) == 3) for x in ("ab", "ac", "bc")), F.lit(0.0))).alias("mut"))

    return net.memo("triads", make)


def _census(ctx, types: list[str]) -> tuple[list[Part], Callable]:
    """Parts of the sum of some types and how they add up; 012, 102 and 003 by complement."""
    part = lambda e: Part(("triads",), _triads, e)
    parts = [part(F.when(F.col("type").isin([t for t in types if t not in ("003", "012", "102")]), F.col("c")).otherwise(0.0))]
    parts += [part(F.col("asym")), part(F.col("mut")), part(F.col("c")), tie_part(F.lit(1.0)), Part(("mutual arcs",), lambda net: net.mutual_arcs, F.lit(1.0))]

    def final(p):
        connected, in_asym, in_mut, all_, ties, arcs = p[0], p[1], p[2], p[3], p[4], p[5]
        n = F.col("n").cast("double")
        one = (ties - arcs) * (n - 2) - in_asym
        two = arcs / 2 * (n - 2) - in_mut
        none = n * (n - 1) * (n - 2) / 6 - all_ - one - two
        extra = {"012": one, "102": two, "003": none}
        return reduce(lambda a, b: a + b, [extra[t] for t in types if t in extra], connected)

    return parts, final


@term("triadcensus")
def triadcensus(ctx, name, levels=None):
    if ctx.net.directed:
        kinds = list(TRIADS)
        chosen = choose(kinds, levels) if levels is not None else list(range(1, 16))
        return [Stat(f"triadcensus.{kinds[k]}", *_census(ctx, [kinds[k]])) for k in chosen]
    chosen = choose([0, 1, 2, 3], levels) if levels is not None else [1, 2, 3]
    t = _triangle_stat(ctx, name, [("undirected", 1)], None, False, None)[0].parts[0]
    two, m = vertex_part(binomial(F.col("deg"), 2)), tie_part(F.lit(1.0))
    n = F.col("n").cast("double")

    def value(k):
        def final(p):
            tri, paths, ties = p
            full, open_ = tri, paths - 3 * tri
            single = ties * (n - 2) - 2 * open_ - 3 * full
            return [n * (n - 1) * (n - 2) / 6 - full - open_ - single, single, open_, full][k]

        return final

    return [Stat(f"triadcensus.{k}", [t, two, m], value(k)) for k in chosen]


#: Sums of the census (fixed values).
CENSUS_SUMS = {"transitive": ["030T", "120D", "120U", "300"], "intransitive": ["111D", "201", "111U", "021C", "030C"], "balance": ["102", "300"], "simmelian": ["300"], "nearsimmelian": ["210"]}


@term(*CENSUS_SUMS)
def census_sum(ctx, name):
    if name == "balance" and not ctx.net.directed:
        one = [x for k in (1, 3) for x in triadcensus(ctx, name, levels=[k + 1])]
        parts = [p for x in one for p in x.parts]
        return [Stat(name, parts, lambda p: one[0].final(p[:3]) + one[1].final(p[3:]))]
    directed_only(ctx, name)
    return [Stat(name, *_census(ctx, CENSUS_SUMS[name]))]


# --- attributes -------------------------------------------------------------------------------------------------------------


@term("nodematch", "match")
def nodematch(ctx, name, attr, diff=False, keep=None, levels=None):
    attr = attr_name(attr)
    levels = levels if levels is not None else keep
    every = ctx.levels(attr) if diff or levels is not None else []
    if diff:
        return [dyadic(f"nodematch.{attr}.{label(every[k])}", is_one((s(attr) == every[k]) & (d(attr) == every[k])), attr) for k in choose(every, levels)]
    inside = F.lit(True) if levels is None else s(attr).isin([every[k] for k in choose(every, levels)])
    return [dyadic(f"nodematch.{attr}", is_one((s(attr) == d(attr)) & inside), attr)]


def _types(n: int, directed: bool, bip: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    if bip:
        return [(r, c) for c in range(bip[1]) for r in range(bip[0])]
    return [(r, c) for c in range(n) for r in range(n) if directed or r <= c]


@term("nodemix")
def nodemix(ctx, name, attr, levels=None, levels2=-1, base=None):
    attr = attr_name(attr)
    if ctx.net.bipartite:
        rows, cols = ctx.levels(attr, "mode = 1"), ctx.levels(attr, "mode = 2")
        cells = [(rows[r], cols[c]) for r, c in _types(0, False, (len(rows), len(cols)))]
    else:
        every = ctx.levels(attr)
        kept = [every[k] for k in choose(every, levels)]
        cells = [(kept[r], kept[c]) for r, c in _types(len(kept), ctx.net.directed)]
    out = []
    for k in choose(cells, levels2):
        a, b = cells[k]
        hit = (s(attr) == a) & (d(attr) == b)
        if not ctx.net.directed and not ctx.net.bipartite:
            hit = hit | ((s(attr) == b) & (d(attr) == a))
        out.append(dyadic(f"mix.{attr}.{label(a)}.{label(b)}", is_one(hit), attr))
    return out


@term("nodefactor", "nodeifactor", "nodeofactor")
def nodefactor(ctx, name, attr, base=1, levels=-1):
    attr = attr_name(attr)
    if name != "nodefactor":
        directed_only(ctx, name)
    every = ctx.levels(attr)
    ends = {"nodefactor": (s, d), "nodeifactor": (d,), "nodeofactor": (s,)}[name]
    return [dyadic(f"{name}.{attr}.{label(every[k])}", reduce(lambda a, b: a + b, [is_one(e(attr) == every[k]) for e in ends]), attr) for k in choose(every, levels)]


@term("nodecov", "nodemain", "nodeicov", "nodeocov")
def nodecov(ctx, name, attr):
    attr = attr_name(attr)
    if name in ("nodeicov", "nodeocov"):
        directed_only(ctx, name)
    x, y = s(attr).cast("double"), d(attr).cast("double")
    return [dyadic(f"{'nodecov' if name == 'nodemain' else name}.{attr}", {"nodeicov": y, "nodeocov": x}.get(name, x + y), attr)]


@term("absdiff")
def absdiff(ctx, name, attr, pow=1):
    attr = attr_name(attr)
    gap = F.abs(s(attr).cast("double") - d(attr).cast("double"))
    return [dyadic(f"absdiff{'' if pow == 1 else pow}.{attr}", gap if pow == 1 else F.pow(gap, F.lit(float(pow))), attr)]


@term("absdiffcat")
def absdiffcat(ctx, name, attr, base=None, levels=None):
    attr = attr_name(attr)
    every = [float(x) for x in ctx.levels(attr)]
    gaps = sorted({abs(a - b) for a, b in itertools.combinations(every, 2)} - {0.0})
    gap = F.abs(s(attr).cast("double") - d(attr).cast("double"))
    return [dyadic(f"absdiff.{attr}.{label(gaps[k])}", is_one(gap == gaps[k]), attr) for k in choose(gaps, levels)]


@term("smalldiff")
def smalldiff(ctx, name, attr, cutoff):
    attr = attr_name(attr)
    return [dyadic(f"smalldiff.{attr}{label(cutoff)}", is_one(F.abs(s(attr).cast("double") - d(attr).cast("double")) <= cutoff), attr)]


@term("diff")
def difference(ctx, name, attr, pow=1, dir="t-h", sign_action="identity"):
    attr = attr_name(attr)
    gap = s(attr).cast("double") - d(attr).cast("double")
    if dir in ("h-t", "b2-b1"):
        gap = -gap
    gap = {"identity": gap, "abs": F.abs(gap), "posonly": F.greatest(gap, F.lit(0.0)), "negonly": F.least(gap, F.lit(0.0))}[sign_action]
    gap = F.signum(gap) if pow == 0 else gap if pow == 1 else F.pow(gap, F.lit(float(pow)))
    way = "" if sign_action == "abs" else f".{dir}"
    return [dyadic(f"diff{'' if pow == 1 else label(pow)}{'' if sign_action == 'identity' else '.' + sign_action}{way}.{attr}", gap, attr)]


@term("mm")
def mm(ctx, name, attrs, levels=None, levels2=-1):
    def side(x):
        x = x.terms[0][1] if isinstance(x, Formula) and x.left is None else x
        return None if isinstance(x, Name) and x.text == "." else attr_name(x)

    if isinstance(attrs, Formula) and attrs.left is not None:
        row, col = side(attrs.left), side(attrs.terms[0][1])
    else:
        row = col = side(attrs)
    both = row == col and row is not None
    rows = ctx.levels(row) if row else [None]
    cols = ctx.levels(col) if col else [None]
    cells = [(r, c) for c in range(len(cols)) for r in range(len(rows)) if not (both and not ctx.net.directed) or r <= c]
    out = []
    for k in choose(cells, levels2):
        r, c = cells[k]

        def hit(x, y, r=r, c=c):
            test = F.lit(True)
            if row:
                test = test & (x(row) == rows[r])
            if col:
                test = test & (y(col) == cols[c])
            return test

        if ctx.net.directed or ctx.net.bipartite:
            value = is_one(hit(s, d))
        elif both:
            value = is_one(hit(s, d) | hit(d, s))
        else:
            value = is_one(hit(s, d)) + is_one(hit(d, s))
        title = f"mm[{f'{row}={label(rows[r])}' if row else '.'},{f'{col}={label(cols[c])}' if col else '.'}]"
        out.append(dyadic(title, value, *[a for a in dict.fromkeys((row, col)) if a]))
    return out


def _around(net: Network, attr: str, which: str) -> DataFrame:
    """Range and number of distinct levels of an attribute over the neighbours of each vertex: out, in or all."""

    def make():
        t = net.ties_with([attr])
        if which == "out":
            n = t.select("net", F.col("src").alias("vid"), F.col(f"d_{attr}").alias("x"))
        elif which == "in":
            n = t.select("net", F.col("dst").alias("vid"), F.col(f"s_{attr}").alias("x"))
        else:
            n = t.select("net", F.col("src").alias("vid"), F.col(f"d_{attr}").alias("x")).union(t.select("net", F.col("dst"), F.col(f"s_{attr}")))
        g = n.groupBy("net", "vid").agg((F.max("x").cast("double") - F.min("x").cast("double")).alias("range"), F.count_distinct("x").cast("double").alias("distinct"))
        return g.join(net.vertices.select("net", "vid", *(["mode"] if net.bipartite else [])), ["net", "vid"])

    return net.memo(("around", attr, which), make)


@term("nodecovrange", "nodeicovrange", "nodeocovrange", "b1covrange", "b2covrange")
def covrange(ctx, name, attr):
    attr = attr_name(attr)
    _bip(ctx, name)
    sides = {"nodeicovrange": ["in"], "nodeocovrange": ["out"]}.get(name, ["out", "in"] if ctx.net.directed else ["all"])
    mode = _mode(name)
    value = F.col("range") if mode is None else F.when(mode, F.col("range")).otherwise(0.0)
    return [Stat(f"{name}.{attr}", [Part(("around", attr, w), lambda net, w=w: _around(net, attr, w), value) for w in sides], lambda p: reduce(lambda a, b: a + b, p))]


@term("nodefactordistinct", "nodeifactordistinct", "nodeofactordistinct", "b1factordistinct", "b2factordistinct")
def factordistinct(ctx, name, attr, levels=True):
    attr = attr_name(attr)
    _bip(ctx, name)
    side = {"nodeifactordistinct": "in", "nodeofactordistinct": "out"}.get(name, "all")
    mode = _mode(name)
    value = F.col("distinct") if mode is None else F.when(mode, F.col("distinct")).otherwise(0.0)
    return [Stat(f"{name}.{attr}", [Part(("around", attr, side), lambda net: _around(net, attr, side), value)])]


# --- bipartite --------------------------------------------------------------------------------------------------------------


@term("b1factor", "b2factor")
def bfactor(ctx, name, attr, base=1, levels=-1):
    _bip(ctx, name)
    attr = attr_name(attr)
    every, end = ctx.levels(attr, f"mode = {name[1]}"), s if name[1] == "1" else d
    return [dyadic(f"{name}.{attr}.{label(every[k])}", is_one(end(attr) == every[k]), attr) for k in choose(every, levels)]


@term("b1cov", "b2cov")
def bcov(ctx, name, attr):
    _bip(ctx, name)
    attr = attr_name(attr)
    return [dyadic(f"{name}.{attr}", (s if name[1] == "1" else d)(attr).cast("double"), attr)]


def _projection(net: Network, attr: str, mode: int, other: str | None = None) -> DataFrame:
    """(x, x2, c): 2-stars between vertices of a mode with one level, centred on the other mode."""

    def make():
        t = net.ties_with([a for a in (attr, other) if a])
        end, centre, p, q = ("src", "dst", "s_", "d_") if mode == 1 else ("dst", "src", "d_", "s_")
        a = t.select("net", F.col(centre).alias("c"), F.col(end).alias("x"), F.col(p + attr).alias("level"), *([F.col(q + other).alias("at")] if other else [F.lit(0).alias("at")]))
        b = a.select("net", "c", F.col("x").alias("x2"), "level")
        return a.join(b, ["net", "c", "level"]).where("x < x2")

    return net.memo(("projection", attr, mode, other), make)


@term("b1nodematch", "b2nodematch")
def bnodematch(ctx, name, attr, diff=False, keep=None, alpha=1, beta=1, byb2attr=None, byb1attr=None, levels=None):
    _bip(ctx, name)
    attr = attr_name(attr)
    mode = int(name[1])
    other = byb2attr if mode == 1 else byb1attr
    other = attr_name(other) if other else None
    every = ctx.levels(attr, f"mode = {mode}")
    chosen = choose(every, levels if levels is not None else keep)
    key = ("projection", attr, mode, other)

    def frame(net):
        p = _projection(net, attr, mode, other)
        if alpha != 1:
            return p.groupBy("net", "level", "at", "x", "x2").agg(F.pow(F.count("*").cast("double"), F.lit(float(alpha))).alias("v"))
        if beta != 1:  # over ties: how many others of the level the centre has, to the power
            q = p.select("net", "level", "at", "c", "x").union(p.select("net", "level", "at", "c", F.col("x2")))
            return q.groupBy("net", "level", "at", "c", "x").agg((F.pow(F.count("*").cast("double"), F.lit(float(beta))) / 2).alias("v"))
        return p.withColumn("v", F.lit(1.0))

    ats = ctx.levels(other, f"mode = {3 - mode}") if other else [None]
    out = []
    for k in chosen if diff else [None]:
        for at in ats:
            inside = F.col("level").isin([every[c] for c in chosen]) if k is None else F.col("level") == every[k]
            if other:
                inside = inside & (F.col("at") == at)
            title = f"{name}.{attr}" + (f".{label(every[k])}" if k is not None else "") + (f".{label(at)}" if other else "")
            out.append(Stat(title, [Part((*key, alpha, beta), frame, F.when(inside, F.col("v")).otherwise(0.0))]))
    return out


def _centre_levels(net: Network, centre_attr: str | None, leaf_attr: str, mode: int) -> DataFrame:
    """How many leaves of each level a vertex of the mode has: (net, c, own, level, k)."""

    def make():
        t = net.ties_with([a for a in dict.fromkeys((centre_attr, leaf_attr)) if a])
        centre, p, q = ("src", "s_", "d_") if mode == 1 else ("dst", "d_", "s_")
        own = F.col(p + centre_attr) if centre_attr else F.lit(0)
        return t.groupBy("net", F.col(centre).alias("c"), own.alias("own"), F.col(q + leaf_attr).alias("level")).agg(F.count("*").alias("k"))

    return net.memo(("centre levels", centre_attr, leaf_attr, mode), make)


@term("b1starmix", "b2starmix")
def bstarmix(ctx, name, k, attr, base=None, diff=True):
    _bip(ctx, name)
    attr, mode = attr_name(attr), int(name[1])
    mine, theirs = ctx.levels(attr, f"mode = {mode}"), ctx.levels(attr, f"mode = {3 - mode}")
    frame = lambda net: _centre_levels(net, attr, attr, mode)
    key = ("centre levels", attr, attr, mode)
    value = binomial(F.col("k"), k)
    if diff:
        return [Stat(f"{name}.{k}.{attr}.{label(a)}.{label(b)}", [Part(key, frame, F.when((F.col("own") == a) & (F.col("level") == b), value).otherwise(0.0))]) for b in theirs for a in mine]
    return [Stat(f"{name}.{k}.{attr}.{label(a)}", [Part(key, frame, F.when(F.col("own") == a, value).otherwise(0.0))]) for a in mine]


@term("b1twostar", "b2twostar")
def btwostar(ctx, name, b1attr, b2attr=None, base=None, b1levels=None, b2levels=None, levels2=None):
    _bip(ctx, name)
    mode = int(name[1])
    b1, b2 = attr_name(b1attr), attr_name(b2attr or b1attr)
    centre, leaf = (b1, b2) if mode == 1 else (b2, b1)
    mine, theirs = ctx.levels(centre, f"mode = {mode}"), ctx.levels(leaf, f"mode = {3 - mode}")

    def frame(net):
        g = _centre_levels(net, centre, leaf, mode)
        other = g.select("net", "c", "own", F.col("level").alias("level2"), F.col("k").alias("k2"))
        pair = g.join(other, ["net", "c", "own"]).where("level <= level2")
        return pair.withColumn("v", F.when(F.col("level") == F.col("level2"), binomial(F.col("k"), 2)).otherwise((F.col("k") * F.col("k2")).cast("double")))

    cells = [(a, x, y) for j, y in enumerate(theirs) for x in theirs[: j + 1] for a in mine]
    out = []
    for k in choose(cells, levels2):
        a, x, y = cells[k]
        lo, hi = (x, y) if x <= y else (y, x)
        out.append(Stat(f"{name}.{centre}.{label(a)}.{leaf}.{label(x)}.{label(y)}", [Part(("two stars", centre, leaf, mode), frame, F.when((F.col("own") == a) & (F.col("level") == lo) & (F.col("level2") == hi), F.col("v")).otherwise(0.0))]))
    return out


@term("coincidence")
def coincidence(ctx, name, levels=None, active=0):
    if not ctx.net.bipartite:
        raise NetworkError("coincidence needs a bipartite network")
    pairs = ctx.net.two_paths("UTP").join(ctx.net.vertices.where("mode = 2").select("net", F.col("vid").alias("i")), ["net", "i"], "left_semi")
    n1 = ctx.net.graphs.agg(F.max("n1")).first()[0]
    if active:
        cells = [(r["i"], r["j"]) for r in pairs.groupBy("i", "j").agg(F.max("sp").alias("m")).where(F.col("m") >= active).orderBy("j", "i").collect()]
    else:
        ids = range(n1, ctx.one_size())
        cells = [(a, b) for b in ids for a in ids if a < b]
    key = ("coincidence",)
    return [Stat(f"coincidence.{cells[k][0] - n1 + 1}.{cells[k][1] - n1 + 1}", [Part(key, lambda net: pairs, F.when((F.col("i") == cells[k][0]) & (F.col("j") == cells[k][1]), F.col("sp")).otherwise(0).cast("double"))]) for k in choose(cells, levels)]


def names() -> list[str]:
    return sorted(TERMS)


del log_factorial
