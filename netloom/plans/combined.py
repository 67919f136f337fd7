"""Statistics of many networks against linear models of network attributes, and terms of layers.

N(): a statistic g and a column c of the model's design give the sum over networks of X_kc g(y_k): the statistics of all
networks come from one plan by net, the design is a frame of the graphs, and their product is one aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.formula import Binary, Formula, FormulaError, Name, Term, parse
from netloom.functions.numbers import geometric, label
from netloom.network import Network
from netloom.operators.terms import Context
from netloom.plans.summary import condition, expand, text_of, wide

_FUNCTIONS = {"log": F.log, "sqrt": F.sqrt, "exp": F.exp, "abs": F.abs, "log2": F.log2, "log10": F.log10, "log1p": F.log1p}


def _column(x) -> Column:
    if isinstance(x, Term) and x.name in _FUNCTIONS:
        return _FUNCTIONS[x.name](_column(x.args[0]))
    if isinstance(x, Term) and x.name == "I":
        return _column(x.args[0])
    if isinstance(x, Binary) and x.left is not None and x.op in "+-*/^":
        a, b = _column(x.left), _column(x.right)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "^": lambda: F.pow(a, b)}[x.op]()
    return condition(x).cast("double")


def design(net: Network, lm: str | Formula = "~1") -> list[tuple[str, Column]]:
    """(name, column over `graphs`): an intercept unless it is taken away, numbers as they are, treatment contrasts for words
    and truth values (full indicators for the first factor of a model without an intercept), products for a:b and a*b."""
    formula = parse(lm) if isinstance(lm, str) else lm
    kinds = dict(net.graphs.dtypes)
    intercept, used_full = True, False
    terms = []
    for sign, t in formula.terms:
        if isinstance(t, (int, float)):
            intercept = (t == 1) == (sign > 0)
        elif sign > 0:
            terms.append(t)
    terms.sort(key=lambda t: isinstance(t, Binary) and t.op == ":")
    out = [("1", F.lit(1.0))] if intercept else []

    def cells(t, full: bool) -> list[tuple[str, Column]]:
        if isinstance(t, Binary) and t.op == ":":
            return [(f"{a}:{b}", x * y) for b, y in cells(t.right, False) for a, x in cells(t.left, False)]
        name = t.text if isinstance(t, Name) else t.name if isinstance(t, Term) and not t.args else None
        if name is not None and kinds.get(name) in ("string", "boolean"):
            levels = sorted((r[0] for r in net.graphs.select(name).distinct().collect()), key=lambda x: (str(x).casefold(), str(x).swapcase()))
            return [(f"{name}{label(x)}", F.coalesce((F.col(name) == x).cast("double"), F.lit(0.0))) for x in (levels if full else levels[1:])]
        if name is not None and name not in kinds:
            raise FormulaError(f"no network attribute {name!r}")
        return [(text_of(t), _column(t))]

    for t in terms:
        factor = isinstance(t, (Name, Term)) and kinds.get(t.text if isinstance(t, Name) else t.name) in ("string", "boolean")
        full = factor and not intercept and not used_full
        used_full |= full
        out += cells(t, full)
    return out


def network_model(net: Network, formula: str, lm: str = "~1", subset: str | None = None, data: dict | None = None) -> DataFrame:
    """(stat, value): N(column)~statistic over all networks, or over those that meet `subset`."""
    net = net.held()
    frame, names = wide(net, expand(formula, Context(net, data or {})))
    columns = design(net, lm)
    graphs = net.graphs if subset is None else net.graphs.where(condition(parse(subset)))
    x = graphs.select("net", *[c.alias(f"x{k}") for k, (_, c) in enumerate(columns)])
    both = frame.select("net", *[F.col(f"`{n}`").alias(f"g{k}") for k, n in enumerate(names)]).join(x, "net")
    cells = [(f"N({c})~{n}", F.sum(F.col(f"x{i}") * F.col(f"g{j}"))) for j, n in enumerate(names) for i, (c, _) in enumerate(columns)]
    one = both.agg(*[e.alias(f"v{k}") for k, (_, e) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(n).alias("stat"), F.coalesce(F.col(f"v{k}"), F.lit(0.0)).alias("value")) for k, (n, _) in enumerate(cells)])
    return one.select(F.explode(rows).alias("r")).select("r.stat", "r.value")


# --- layers ---------------------------------------------------------------------------------------------------------------------


def _logic(x, layers: list[str]) -> Column:
    """An expression of Layer Logic over columns l_<name> (and r_<name> for the transposed layer), whole numbers as in R."""
    if isinstance(x, Formula):
        return _logic(x.terms[0][1], layers)
    if isinstance(x, (int, float)):
        return F.lit(int(x))
    if isinstance(x, Name) or isinstance(x, Term) and not x.args:
        name = x.text if isinstance(x, Name) else x.name
        if name not in layers:
            raise FormulaError(f"no layer {name!r}")
        return F.col(f"l_{name}")
    if isinstance(x, Term):
        inner = [_logic(a, layers) for a in x.args]
        if x.name == "t":
            name = x.args[0].text if isinstance(x.args[0], Name) else x.args[0].name
            return F.col(f"r_{name}")
        if x.name == "xor":
            return ((inner[0] != 0) != (inner[1] != 0)).cast("int")
        if x.name in ("abs", "sign"):
            return (F.abs if x.name == "abs" else F.signum)(inner[0]).cast("int")
        raise FormulaError(f"no function {x.name!r} of layers")
    if isinstance(x, Binary):
        b = _logic(x.right, layers)
        if x.left is None:
            return (b == 0).cast("int") if x.op == "!" else -b
        a = _logic(x.left, layers)
        table = {"&": lambda: ((a != 0) & (b != 0)).cast("int"), "|": lambda: ((a != 0) | (b != 0)).cast("int"), "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "==": lambda: (a == b).cast("int"), "!=": lambda: (a != b).cast("int"), "<": lambda: (a < b).cast("int"), ">": lambda: (a > b).cast("int"), "<=": lambda: (a <= b).cast("int"), ">=": lambda: (a >= b).cast("int")}
        return table[x.op[0] if x.op in ("&&", "||") else x.op]()
    raise FormulaError(f"not of layers: {x!r}")


def layered(net: Network, layers: DataFrame) -> DataFrame:
    """(net, src, dst, l_..., r_...): a row for each dyad that some layer ties, with every layer's state and its reverse.
    `layers`: net, layer, src, dst on the vertices of `net`."""
    names = sorted(r[0] for r in layers.select("layer").distinct().collect())
    both = layers.select("net", "src", "dst", "layer", F.lit(0).alias("rev"))
    if net.directed:
        both = both.union(layers.select("net", "dst", "src", "layer", F.lit(1)))
    else:
        both = both.select("net", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "layer", "rev")
    state = lambda n, r: F.max(F.when((F.col("layer") == n) & (F.col("rev") == r), 1).otherwise(0))
    return both.groupBy("net", "src", "dst").agg(*[state(n, 0).alias(f"l_{n}") for n in names], *[state(n, 1 if net.directed else 0).alias(f"r_{n}") for n in names])


def layer_stats(net: Network, layers: DataFrame, formula: str, logic: str = "~.", data: dict | None = None) -> DataFrame:
    """net, position, stat, value of the logical layer: ties are the dyads whose expression is not 0. An expression that holds
    where no layer has a tie is refused, as its network would be nearly complete."""
    from netloom.plans.summary import summary_stats

    frame = layered(net, layers).persist()
    names = [c[2:] for c in frame.columns if c.startswith("l_")]
    parsed = parse(logic)
    first = parsed.terms[0][1]
    whole = isinstance(first, Name) and first.text == "."
    value = reduce(lambda a, b: a | b, [F.col(f"l_{n}") != 0 for n in names]) if whole else _logic(first if len(parsed.terms) == 1 else _joined(parsed), names) != 0
    zeros = net.vertices.sparkSession.range(1).select(*[F.lit(0).alias(c) for c in frame.columns if c[:2] in ("l_", "r_")])
    if zeros.select(value.alias("v")).first()["v"]:
        raise FormulaError("the expression holds for dyads without any tie")
    inner = net.with_edges(frame.where(value).select("net", "src", "dst"))
    return summary_stats(inner, formula, data).withColumn("stat", F.concat(F.lit(f"L({logic.lstrip('~')})~"), "stat"))


def _joined(parsed: Formula):
    """A sum that the parser has split into terms, as one expression again."""
    out = None
    for sign, t in parsed.terms:
        out = (t if sign > 0 else Binary("-", None, t)) if out is None else Binary("+" if sign > 0 else "-", out, t)
    return out


def conway_maxwell_binomial(net: Network, layers: DataFrame) -> DataFrame:
    """(net, value): CMBL, the sum over dyads of log(E! (R - E)! / R!) with E of R layers tied; dyads without ties add 0."""
    import math

    frame = layered(net, layers)
    names = [c for c in frame.columns if c.startswith("l_")]
    r = len(names)
    table = F.array(*[F.lit(math.lgamma(e + 1) + math.lgamma(r - e + 1) - math.lgamma(r + 1)) for e in range(r + 1)])
    count = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    return net.graphs.select("net").join(frame.groupBy("net").agg(F.sum(F.get(table, count.cast("int"))).alias("value")), "net", "left").na.fill(0.0, ["value"])


def mutual_layers(net: Network, layers: DataFrame, one: str, other: str) -> DataFrame:
    """(net, value): MutualL, pairs tied i -> j in one layer and j -> i in the other; inside one layer each pair once."""
    a = layers.where(F.col("layer") == one).select("net", "src", "dst")
    b = layers.where(F.col("layer") == other).select("net", F.col("dst").alias("src"), F.col("src").alias("dst"))
    n = a.join(b, ["net", "src", "dst"], "left_semi").groupBy("net").agg((F.count("*") / (2 if one == other else 1)).alias("value"))
    return net.graphs.select("net").join(n, "net", "left").na.fill(0.0, ["value"])


def twostar_layers(net: Network, layers: DataFrame, one: str, other: str, type: str = "out", distinct: bool = True) -> DataFrame:
    """(net, value): TwostarL, a tie of one layer and a tie of the other at a vertex: out (both leave it), in (both reach it),
    path (one reaches it, the other leaves it); distinct: the other ends differ."""
    end = {"out": ("src", "src"), "in": ("dst", "dst"), "path": ("dst", "src")}[type]
    far = {"src": "dst", "dst": "src"}
    a = layers.where(F.col("layer") == one).select("net", F.col(end[0]).alias("v"), F.col(far[end[0]]).alias("x"))
    b = layers.where(F.col("layer") == other).select("net", F.col(end[1]).alias("v"), F.col(far[end[1]]).alias("y"))
    da, db = a.groupBy("net", "v").agg(F.count("*").alias("m")), b.groupBy("net", "v").agg(F.count("*").alias("k"))
    total = da.join(db, ["net", "v"]).groupBy("net").agg(F.sum(F.col("m") * F.col("k")).alias("all"))
    same = a.join(b, (a["net"] == b["net"]) & (a["v"] == b["v"]) & (a["x"] == b["y"])).groupBy(a["net"]).agg(F.count("*").alias("same"))
    got = net.graphs.select("net").join(total, "net", "left").join(same, "net", "left").na.fill(0)
    return got.select("net", (F.col("all") - (F.col("same") if distinct else 0)).cast("double").alias("value"))


def shared_layers(net: Network, layers: DataFrame, kind: str, d: list[int] | None = None, decay: float | None = None, *, type: str = "OTP", base: str | None = None, path: list[str] | None = None, in_order: bool = False, mode: int | None = None) -> DataFrame:
    """(net, stat, value): shared partners across layers, espL, dspL, nspL and, with `decay`, their geometric sums.

    A partner of i and j has its two ties in the path layers, one in each, in either order unless `in_order`; the base layer
    ties i and j (esp), does not (nsp), or is not asked (dsp). With `mode`, pairs of one mode of a bipartite network.
    """
    if kind not in ("esp", "dsp", "nsp") or (d is None) == (decay is None):
        raise FormulaError("esp, dsp or nsp, with counts or a decay")
    if path is None and base is None:
        raise FormulaError("a base layer or path layers are needed")
    path = [base, base] if path is None else path * 2 if len(path) == 1 else path
    base = None if kind == "dsp" else base or path[0]
    if type not in ("OTP", "ITP", "OSP", "ISP"):
        raise FormulaError(f"no two-paths {type!r} across layers")
    undirected = not net.directed

    def arcs(name: str, reverse: bool) -> DataFrame:
        t = layers.where(F.col("layer") == name).select("net", "src", "dst").distinct()
        back = t.select("net", F.col("dst").alias("src"), F.col("src").alias("dst"))
        return t.unionByName(back).distinct() if undirected else back if reverse else t

    first = type in ("ITP", "ISP")  # the tie at i is read backwards
    second = type in ("ITP", "OSP")
    ways = [(path[0], path[1])] if in_order and not undirected or path[0] == path[1] else [(path[0], path[1]), (path[1], path[0])]
    found = None
    for a, b in ways:
        x = arcs(a, first).select("net", F.col("src").alias("i"), F.col("dst").alias("k"))
        y = arcs(b, second).select("net", F.col("src").alias("k"), F.col("dst").alias("j"))
        got = x.join(y, ["net", "k"]).where("i < j" if undirected else "i != j").select("net", "i", "j", "k")
        found = got if found is None else found.unionByName(got)
    pairs = (found.distinct() if len(ways) > 1 else found).groupBy("net", "i", "j").agg(F.count("*").alias("sp"))
    if mode is not None:
        pairs = pairs.join(net.vertices.where(F.col("mode") == mode).select("net", F.col("vid").alias("i")), ["net", "i"], "left_semi")
    ties = None
    if base is not None:
        ties = layers.where(F.col("layer") == base).select("net", *([F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")] if undirected else [F.col("src").alias("i"), F.col("dst").alias("j")])).distinct().withColumn("y", F.lit(1))
        pairs = pairs.join(ties, ["net", "i", "j"], "full").na.fill(0, ["sp", "y"])
    else:
        pairs = pairs.withColumn("y", F.lit(0))
    where = {"esp": F.col("y") == 1, "dsp": F.lit(True), "nsp": F.col("y") == 0}[kind]
    label = ",".join(dict.fromkeys(path))
    tag = f".{type}" if net.directed else ""
    name = kind if mode is None else f"b{mode}dsp"
    wrap = f"L(pth=({label}),bse={base or ''},inord={'' if mode else 'TRUE' if in_order else 'FALSE'})~"
    one = lambda c: F.sum(F.when(where & c, 1).otherwise(0)).cast("double")
    if decay is not None:
        cells = [(f"{wrap}gw{name}{tag}.fixed.{float(decay):g}", F.sum(F.when(where, geometric(F.col("sp"), float(decay))).otherwise(0.0)))]
    else:
        cells = [(f"{wrap}{name}{tag}{x}", one(F.col("sp") == x)) for x in d]
    some = pairs.groupBy("net").agg(*[c.alias(f"c{k}") for k, (_, c) in enumerate(cells)], one(F.lit(True)).alias("_some"), F.sum("y").cast("double").alias("_ties"), F.sum((F.col("sp") > 0).cast("long") * F.when(where, 1).otherwise(0)).cast("double").alias("_with"))
    out = net.graphs.select("net", "n", *(["n1"] if net.bipartite else [])).join(some, "net", "left").na.fill(0.0)
    total = net.dyads() if mode is None else (lambda m: m * (m - 1) / 2)(F.col("n1") if mode == 1 else F.col("n") - F.col("n1"))
    rows = []
    for k, (title, _) in enumerate(cells):
        value = F.col(f"c{k}")
        if decay is None and d[k] == 0 and kind != "esp":  # pairs that nothing names, by complement
            value = total - (F.col("_ties") if kind == "nsp" else F.lit(0.0)) - F.col("_with")
        rows.append(F.struct(F.lit(title).alias("stat"), value.cast("double").alias("value")))
    return out.select("net", F.explode(F.array(*rows)).alias("r")).select("net", "r.stat", "r.value")
