"""From a formula to one plan: every shared frame is aggregated once by net, and values are made from the aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.formula import Binary, Formula, FormulaError, Name, Term, parse
from netloom.functions.numbers import label
from netloom.network import Network, NetworkError, ranked
from netloom.operators import multilevel  # noqa: F401  registers its terms
from netloom.operators import terms as T
from netloom.operators.terms import Context, Part, Stat


@dataclass
class Bound:
    """A statistic on the network that its operators have made of the given one."""

    stat: Stat
    net: Network
    offset: bool = False
    coef: float | None = None


@dataclass
class Group:
    """A value made of the values of several statistics."""

    name: str
    inner: list
    final: Callable[[list[Column]], Column]
    offset: bool = False


OPERATORS: dict[str, Callable] = {}


def operator(*names: str):
    def add(f):
        for n in names:
            OPERATORS[n] = f
        return f

    return add


def expand(formula: Formula | str, ctx: Context) -> list:
    """The statistics of a formula, in order."""
    if isinstance(formula, str):
        formula = parse(formula)
    out: list = []
    for sign, t in formula.terms:
        got = expand_term(t, ctx)
        if sign < 0:
            names = {b_name(x) for x in got}
            out = [x for x in out if b_name(x) not in names]
        else:
            out.extend(got)
    return out


def b_name(x) -> str:
    return x.stat.name if isinstance(x, Bound) else x.name


def rename(x, name: str):
    if isinstance(x, Bound):
        s = x.stat
        return Bound(Stat(name, s.parts, s.final, s.dyad, s.attrs, s.degree, s.shared), x.net, x.offset, x.coef)
    return Group(name, x.inner, x.final, x.offset)


def expand_term(t, ctx: Context) -> list:
    if isinstance(t, Formula):
        return expand(t, ctx)
    if isinstance(t, Name):
        t = Term(t.text)
    if isinstance(t, Binary) and t.op == ":":
        return interact(expand_term(t.left, ctx), expand_term(t.right, ctx))
    if not isinstance(t, Term):
        raise FormulaError(f"not a term: {t!r}")
    if t.name in OPERATORS:
        return OPERATORS[t.name](ctx, *t.args, **t.kwargs)
    if t.name not in T.TERMS:
        raise FormulaError(f"no term {t.name!r}")
    kwargs = {("from_" if k in ("from", "frm") else "lambda_" if k == "lambda" else k): v for k, v in t.kwargs.items()}
    return [Bound(s, ctx.net) for s in T.TERMS[t.name](ctx, t.name, *t.args, **kwargs)]


def interact(left: list, right: list) -> list:
    """Products of the change statistics of dyad-independent terms."""
    out = []
    for b in right:
        for a in left:
            if not (isinstance(a, Bound) and isinstance(b, Bound)) or a.stat.dyad is None or b.stat.dyad is None:
                raise FormulaError("interactions are of dyad-independent terms")
            expr, attrs = a.stat.dyad * b.stat.dyad, tuple(dict.fromkeys((*a.stat.attrs, *b.stat.attrs)))
            out.append(Bound(Stat(f"{a.stat.name}:{b.stat.name}", [T.tie_part(expr, attrs)], dyad=expr, attrs=attrs), a.net))
    return out


# --- operators ----------------------------------------------------------------------------------------------------------------


def _formula(x) -> Formula:
    return x if isinstance(x, Formula) else parse(x) if isinstance(x, str) else Formula(((1, x),))


def text_of(x) -> str:
    if isinstance(x, Formula):
        return "+".join(text_of(t) for _, t in x.terms)
    if isinstance(x, Term):
        inner = [repr(a).replace("'", '"') if isinstance(a, str) else text_of(a) for a in x.args] + [f"{k}={text_of(v)}" for k, v in x.kwargs.items()]
        return f"{x.name}({','.join(inner)})" if inner else x.name
    if isinstance(x, Name):
        return x.text
    if isinstance(x, Binary):
        return f"{text_of(x.left) if x.left is not None else ''}{x.op}{text_of(x.right)}"
    return label(x)


@operator("offset")
def offset(ctx, t, coef=None):
    out = []
    for x in expand_term(t, ctx):
        x = rename(x, f"offset({b_name(x)})")
        x.offset = True
        out.append(x)
    return out


@operator("Offset")
def offset_operator(ctx, formula, coef=0.0, which=True):
    inner = expand(_formula(formula), ctx)
    fixed = set(T.choose(list(range(len(inner))), which))
    coefs = coef if isinstance(coef, list) else [coef] * len(inner)
    out = []
    for k, x in enumerate(inner):
        if k in fixed:
            x = rename(x, f"offset({b_name(x)})")
            x.offset = True
            if isinstance(x, Bound):
                x.coef = float(coefs[k % len(coefs)])
        out.append(x)
    return out


@operator("F")
def filtered(ctx, formula, filter):
    """Terms on the ties whose change of the filter is not 0."""
    test = _formula(filter).terms[0][1]
    negate = isinstance(test, Binary) and test.op == "!"
    test = test.right if negate else test
    limit = None
    if isinstance(test, Binary) and test.op in ("==", "!=", "<", ">", "<=", ">="):
        test, limit = test.left, (test.op, test.right)
    got = expand_term(test, ctx)
    if len(got) != 1 or got[0].stat.dyad is None:
        raise FormulaError("a filter is one dyad-independent statistic")
    value = got[0].stat.dyad
    keep = value != 0 if limit is None else {"==": value == limit[1], "!=": value != limit[1], "<": value < limit[1], ">": value > limit[1], "<=": value <= limit[1], ">=": value >= limit[1]}[limit[0]]
    keep = ~keep if negate else keep
    net = ctx.net.with_edges(ctx.net.ties_with(list(got[0].stat.attrs)).where(keep).select("net", "src", "dst", "w"))
    title = ("!" if negate else "") + text_of(test) + (f"{limit[0]}{label(limit[1])}" if limit else "")
    return [rename(x, f"F({title})~{b_name(x)}") for x in expand(_formula(formula), Context(net.held(), ctx.data))]


def condition(x) -> Column:
    """A selector over vertex attributes as a Column."""
    if isinstance(x, Formula):
        return condition(x.terms[0][1])
    if isinstance(x, (Name, Term)) and not getattr(x, "args", ()):
        return F.col(f"`{x.text if isinstance(x, Name) else x.name}`")
    if isinstance(x, Term) and x.name in ("abs", "sqrt", "exp", "log", "is_na", "is.na"):
        return {"abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.log, "is.na": F.isnull}[x.name](condition(x.args[0]))
    if isinstance(x, Term) and x.name == "I":
        return condition(x.args[0])
    if isinstance(x, Binary):
        if x.left is None:
            return ~condition(x.right) if x.op == "!" else -condition(x.right)
        if x.op == "%in%":
            return condition(x.left).isin(x.right)
        a, b = condition(x.left), condition(x.right)
        table = {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "&": lambda: a & b, "&&": lambda: a & b, "|": lambda: a | b, "||": lambda: a | b, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "^": lambda: F.pow(a, b), "%%": lambda: F.pmod(a, b), "%/%": lambda: F.floor(a / b)}
        return table[x.op]()
    if isinstance(x, list):
        raise FormulaError("a vector is no condition")
    return F.lit(x)


@operator("S")
def subgraph(ctx, formula, attrs):
    """Terms on the subgraph of selected vertices; with two sides, on the bipartite graph between two disjoint sets."""
    if attrs.left is None:
        net = ctx.net.subgraph(condition(attrs))
    else:
        one, two = condition(attrs.left), condition(attrs)
        v = ctx.net.vertices.withColumn("mode", F.when(one, 1).when(two, 2)).where("mode is not null")
        base = Network(v, ctx.net.edges, ctx.net.graphs.drop("n1"), False, True)
        between = ctx.net.edges.select("net", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w", "na")
        key = v.select("net", "vid", "mode")
        e = between.join(key.select("net", F.col("vid").alias("src"), F.col("mode").alias("m1")), ["net", "src"]).join(key.select("net", F.col("vid").alias("dst"), F.col("mode").alias("m2")), ["net", "dst"]).where("m1 != m2")
        order = ranked(v, ["net"], ["mode", "vid"], "_new")
        ids = order.select("net", F.col("vid"), F.col("_new"))
        e = e.withColumns({"_a": F.when(F.col("m1") == 1, F.col("src")).otherwise(F.col("dst")), "_b": F.when(F.col("m1") == 1, F.col("dst")).otherwise(F.col("src"))})
        e = e.join(ids.select("net", F.col("vid").alias("_a"), F.col("_new").alias("s")), ["net", "_a"]).join(ids.select("net", F.col("vid").alias("_b"), F.col("_new").alias("t")), ["net", "_b"]).select("net", F.col("s").alias("src"), F.col("t").alias("dst"), "w", "na")
        vertices = order.drop("vid").withColumnRenamed("_new", "vid")
        graphs = vertices.groupBy("net").agg(F.count("*").alias("n"), F.sum((F.col("mode") == 1).cast("long")).alias("n1"))
        net = Network(vertices, e, graphs, False, True)
        del base
    side = text_of(attrs.terms[0][1]) if attrs.left is None else f"{text_of(attrs.left)},{text_of(attrs.terms[0][1])}"
    return [rename(x, f"S({side})~{b_name(x)}") for x in expand(_formula(formula), Context(net.held(), ctx.data))]


@operator("Symmetrize")
def symmetrize(ctx, formula, rule="weak"):
    net = ctx.net.symmetrized(rule)
    return [rename(x, f"Symmetrize({rule})~{b_name(x)}") for x in expand(_formula(formula), Context(net.held(), ctx.data))]


@operator("Passthrough", "I")
def passthrough(ctx, formula, label=False):
    return [rename(x, f"Passthrough~{b_name(x)}") if label else x for x in expand(_formula(formula), ctx)]


@operator("Label")
def relabel(ctx, formula, label, pos="("):
    inner = expand(_formula(formula), ctx)
    labels = label if isinstance(label, list) else [label] * len(inner)
    if pos == "(":
        return [rename(x, f"{b}({b_name(x)})") for x, b in zip(inner, labels)]
    return [rename(x, b if pos in ("replace", "r") else f"{b}{b_name(x)}" if pos in ("prepend", "p") else f"{b_name(x)}{b}") for x, b in zip(inner, labels)]


def _linear(ctx, formulas, label):
    """Inner statistics of Sum() and Prod(): lists of (weight, formula)."""
    some = formulas if isinstance(formulas, list) else [formulas]
    out = []
    for f in some:
        if not isinstance(f, Formula):
            f = Formula(((1, f),))
        weight = f.left if isinstance(f.left, (int, float)) else -1.0 if isinstance(f.left, Binary) else 1.0
        out.append((float(weight), expand(Formula(f.terms), ctx)))
    if len({len(x) for _, x in out}) != 1:
        raise FormulaError("the formulas have different numbers of statistics")
    return out


@operator("Sum")
def total(ctx, formulas, label=None):
    parts = _linear(ctx, formulas, label)
    out = []
    for k in range(len(parts[0][1])):
        weights = [w for w, _ in parts]
        title = f"Sum~{label}" if label and len(parts[0][1]) == 1 else f"Sum~{label}{k + 1}" if label else "Sum~" + b_name(parts[0][1][k])
        out.append(Group(title, [x[k] for _, x in parts], lambda c, weights=weights: sum((w * v for w, v in zip(weights, c)), F.lit(0.0))))
    return out


@operator("Prod")
def product(ctx, formulas, label=None):
    parts = _linear(ctx, formulas, label)
    out = []
    for k in range(len(parts[0][1])):
        weights = [w for w, _ in parts]

        def final(c, weights=weights):
            value = F.lit(1.0)
            for w, v in zip(weights, c):
                value = value * F.pow(v, F.lit(w))
            return value

        title = f"Prod~{label}" if label and len(parts[0][1]) == 1 else f"Prod~{label}{k + 1}" if label else "Prod~" + b_name(parts[0][1][k])
        out.append(Group(title, [x[k] for _, x in parts], final))
    return out


@operator("Log")
def logarithm(ctx, formula, log0=-1 / math.sqrt(2.220446049250313e-16)):
    return [Group(f"Log~{b_name(x)}", [x], lambda c: F.when(c[0] == 0, F.lit(float(log0))).otherwise(F.log(c[0]))) for x in expand(_formula(formula), ctx)]


@operator("Exp")
def exponential(ctx, formula):
    return [Group(f"Exp~{b_name(x)}", [x], lambda c: F.exp(c[0])) for x in expand(_formula(formula), ctx)]


@operator("For")
def for_each(ctx, formula, *args, **kwargs):
    """The formula for every value of a variable; several variables nest, the last one fastest."""
    out = []

    def replace(x, name, value):
        if isinstance(x, Name) and x.text == name or isinstance(x, Term) and x.name == name and not x.args and not x.kwargs:
            return value
        if isinstance(x, Formula):
            return Formula(tuple((sg, replace(t, name, value)) for sg, t in x.terms), replace(x.left, name, value) if x.left is not None else None)
        if isinstance(x, Term):
            return Term(x.name, tuple(replace(a, name, value) for a in x.args), {k: replace(v, name, value) for k, v in x.kwargs.items()})
        if isinstance(x, Binary):
            return Binary(x.op, replace(x.left, name, value), replace(x.right, name, value))
        if isinstance(x, list):
            return [replace(v, name, value) for v in x]
        return x

    def nest(f, rest):
        if not rest:
            out.extend(expand(f, ctx))
            return
        (name, values), *more = rest
        for v in values if isinstance(values, list) else [values]:
            nest(replace(f, name, v), more)

    nest(_formula(formula), list(kwargs.items()))
    return out


def _series(ctx, formula, op):
    net = ctx.net
    if net.previous is None:
        raise NetworkError(f"{op}() needs a series")
    now, before = net.ties.select("net", "src", "dst"), net.previous.select("net", "src", "dst")
    if op == "Form":
        edges = now.union(before).distinct()
    elif op in ("Persist", "Diss"):
        edges = now.join(before, ["net", "src", "dst"], "left_semi")
    elif op == "Change":
        edges = now.join(before, ["net", "src", "dst"], "left_anti").union(before.join(now, ["net", "src", "dst"], "left_anti"))
    else:
        edges = now
    inner = expand(_formula(formula), Context(net.with_edges(edges).held(), ctx.data))
    if op == "Diss":
        return [Group(f"Diss(1)~{b_name(x)}", [x], lambda c: -c[0]) for x in inner]
    return [rename(x, f"{op}(1)~{b_name(x)}") for x in inner]


for _op in ("Form", "Persist", "Diss", "Cross", "Change"):
    OPERATORS[_op] = lambda ctx, formula, lm=None, _op=_op, **more: _series(ctx, formula, _op)


def _project(ctx, formula, mode):
    """Binary terms of a projection: vertices of a mode, tied if they share a partner."""
    if not ctx.net.bipartite:
        raise NetworkError("a projection is of a bipartite network")
    net = ctx.net.memo(("projected", mode), lambda: _projected(ctx.net, mode))
    return [rename(x, f"Proj{mode}~{b_name(x)}") for x in expand(_formula(formula), Context(net.held(), ctx.data))]


def _projected(net: Network, mode: int) -> Network:
    v = net.vertices.where(F.col("mode") == mode)
    pairs = net.two_paths("UTP").join(v.select("net", F.col("vid").alias("i")), ["net", "i"], "left_semi")
    base = Network(net.vertices, pairs.select("net", F.col("i").alias("src"), F.col("j").alias("dst"), F.col("sp").cast("double").alias("w"), F.lit(False).alias("na")), net.graphs.drop("n1"), False, False)
    return base.subgraph(F.col("mode") == mode)


OPERATORS["Proj1"] = lambda ctx, formula: _project(ctx, formula, 1)
OPERATORS["Proj2"] = lambda ctx, formula: _project(ctx, formula, 2)
OPERATORS["Project"] = lambda ctx, formula, mode=1: _project(ctx, formula, mode)


# --- the plan -----------------------------------------------------------------------------------------------------------------


def unique(names: list[str]) -> list[str]:
    """Repeated names get .1, .2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if n in seen:
            k = seen[n]
            while f"{n}.{k}" in seen:
                k += 1
            seen[n] = k + 1
            n = f"{n}.{k}"
        seen.setdefault(n, 1)
        out.append(n)
    return out


def _leaves(x) -> list[Bound]:
    return [x] if isinstance(x, Bound) else [y for z in x.inner for y in _leaves(z)]


def wide(net: Network, stats: list) -> tuple[DataFrame, list[str]]:
    """One row for each net with a column for each statistic."""
    leaves = [b for x in stats for b in _leaves(x)]
    groups: dict[tuple, list[tuple[Part, Network]]] = {}
    for b in leaves:
        for p in b.stat.parts:
            groups.setdefault((id(b.net), p.key), []).append((p, b.net))
    columns: dict[int, str] = {}
    out = net.graphs.select("net", "n", *(["n1"] if "n1" in net.graphs.columns else []))
    sizes = {id(b.net): b.net for b in leaves}
    number = 0
    own_size: dict[int, tuple[str, str]] = {}
    for k, other in sizes.items():
        if other is not net and other.graphs is not net.graphs:
            own_size[k] = (f"_n{number}", f"_m{number}")
            g = other.graphs.select("net", F.col("n").alias(f"_n{number}"), *([F.col("n1").alias(f"_m{number}")] if other.bipartite else []))
            out = out.join(g, "net", "left").na.fill(0, [f"_n{number}"])
            number += 1
    for (_, key), parts in groups.items():
        where = parts[0][1]
        if key[0] == "ties":
            attrs = tuple(dict.fromkeys(a for b in leaves if b.net is where for a in b.stat.attrs))
            extra = [a for p, _ in parts for a in _tie_attributes(p, where)]
            frame = where.ties_with(list(dict.fromkeys((*attrs, *extra))), key[1])
        else:
            frame = parts[0][0].frame(where)
        aggregates = []
        for p, _ in parts:
            if id(p) not in columns:
                columns[id(p)] = f"_a{number}"
                aggregates.append(F.sum(p.expr).alias(f"_a{number}"))
                number += 1
        out = out.join(frame.groupBy("net").agg(*aggregates), "net", "left")
    names = unique([b_name(x) for x in stats])
    # as text: a column made call by call costs a message to the JVM for each part of it
    out = out.selectExpr(*[f"coalesce(cast({c} as double), 0.0D) AS {c}" if c.startswith("_a") else c for c in out.columns])

    def value(x) -> Column:
        if isinstance(x, Group):
            return x.final([value(y) for y in x.inner])
        got = x.stat.final([F.col(columns[id(p)]) for p in x.stat.parts])
        return got

    # statistics of an operator's network see its own number of vertices: the columns trade names for them
    rounds: dict = {}
    for x, n in zip(stats, names):
        rounds.setdefault(next((id(b.net) for b in _leaves(x) if id(b.net) in own_size), None), []).append((x, n))
    final = {n: f"_v{k}" for k, n in enumerate(names)}
    for k, some in rounds.items():
        there = {}
        if k is not None:
            a, b = own_size[k]
            there = {"n": "_n", "n1": "_n1", a: "n", b: "n1"}
            there = {x: y for x, y in there.items() if x in out.columns}
            out = out.withColumnsRenamed(there)
        out = out.withColumns({final[n]: value(x).cast("double") for x, n in some})
        out = out.withColumnsRenamed({y: x for x, y in there.items()})
    return out.select("net", *[F.col(final[n]).alias(n) for n in names]), names


def _tie_attributes(p: Part, net: Network) -> list[str]:
    """Attributes that an expression over ties names, for parts without a list of their own."""
    text = p.expr._jc.toString() if hasattr(p.expr, "_jc") else str(p.expr)
    return [a for a in net.vertices.columns if a not in ("net", "vid", "key") and (f"s_{a}" in text or f"d_{a}" in text)]


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def long(frame: DataFrame, names: list[str]) -> DataFrame:
    """net, position, stat, value."""
    short = frame.toDF("net", *[f"_{k}" for k in range(len(names))])
    rows = ", ".join(f"named_struct('position', {k}, 'stat', {quoted(n)}, 'value', _{k})" for k, n in enumerate(names))
    return short.selectExpr("net", f"inline(array({rows}))")


def summary_stats(net: Network, formula: str | Formula, data: dict | None = None) -> DataFrame:
    """The statistics of `formula` on every net: net, position, stat, value."""
    net = net.held()
    frame, names = wide(net, expand(formula, Context(net, data or {})))
    return long(frame, names)
