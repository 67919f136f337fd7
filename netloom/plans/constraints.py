"""Sample-space constraints as filters of the free dyads: equalities and joins, never a mask of all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.formula import Formula, FormulaError, Name, Term, parse
from netloom.network import Network
from netloom.operators.terms import Context, attr_name, choose
from netloom.plans.summary import expand


def _values(net: Network, frame: DataFrame, attr: str) -> DataFrame:
    for end, p in (("src", "_s"), ("dst", "_d")):
        frame = frame.join(net.vertices.select("net", F.col("vid").alias(end), F.col(f"`{attr}`").alias(p)), ["net", end])
    return frame


def _changing(net: Network, frame: DataFrame, formula: Formula):
    """The frame with `_hit`: whether any of the dyad-independent statistics changes with the dyad."""
    stats = expand(formula, Context(net, {}))
    if any(x.stat.dyad is None for x in stats):
        raise FormulaError("constraints count dyads by dyad-independent terms")
    attrs = list(dict.fromkeys(a for x in stats for a in x.stat.attrs))
    for end, p in (("src", "s_"), ("dst", "d_")):
        if attrs:
            frame = frame.join(net.vertices.select("net", F.col("vid").alias(end), *[F.col(f"`{a}`").alias(p + a) for a in attrs]), ["net", end])
    hit = F.lit(False)
    for x in stats:
        hit = hit | (x.stat.dyad != 0)
    return frame.withColumn("_hit", hit)


def _sees(direction: str, s, d):
    """Whether the ego of an egocentric design sees a dyad."""
    s, d = s.cast("boolean"), d.cast("boolean")
    return {"both": s | d, "out": s, "in": d}[direction]


def _fixed_cells(net: Network, t: Term, attr: str) -> list[tuple]:
    """Pairs of levels whose dyads blocks() fixes; undirected dyads have them in both orders."""
    levels = Context(net, {}).levels(attr)
    cells = [(r, c) for c in range(len(levels)) for r in range(len(levels)) if net.directed or net.bipartite or r <= c]
    wanted = t.kwargs.get("levels2", t.args[1] if len(t.args) > 1 else False)
    fixed = [(levels[r], levels[c]) for r, c in ([cells[k] for k in choose(cells, wanted)] if wanted is not False else [])]
    return fixed if net.directed or net.bipartite else list(dict.fromkeys([*fixed, *((c, r) for r, c in fixed)]))


def _listed(frame: DataFrame, net: Network, dyads: DataFrame, how: str) -> DataFrame:
    d = dyads if "net" in dyads.columns else net.graphs.select("net").join(dyads)
    d = d.select("net", "src", "dst")
    if not net.directed:
        d = d.select("net", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return frame.join(d.distinct(), ["net", "src", "dst"], how)


def free_dyads(net: Network, constraints: str, data: dict[str, DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function from the dyad frame to its free part: blockdiag(attr), blocks(attr, levels2), Dyads(fix, vary), fixedas(present,
    absent), fixallbut(free), observed (missing dyads only) and egocentric(attr, direction). Degree-preserving constraints leave no dyad free. Its `by_class` is what by_class() gives."""
    data = data or {}
    parsed = [Term(t.text) if isinstance(t, Name) else t for _, t in parse(constraints).terms]

    def one(frame: DataFrame, t: Term) -> DataFrame:
        columns, name = frame.columns, t.name.lower()
        if name in (".", "observed"):
            return frame
        if name == "blockdiag":
            return _values(net, frame, attr_name(t.args[0])).where("_s = _d").select(*columns)
        if name == "blocks":
            attr = attr_name(t.args[0])
            got, gone = _values(net, frame, attr), F.lit(False)
            for r, c in _fixed_cells(net, t, attr):
                gone = gone | ((F.col("_s") == r) & (F.col("_d") == c))
            return got.where(~gone).select(*columns)
        if name == "dyads":
            fix, vary = t.kwargs.get("fix", t.args[0] if t.args else None), t.kwargs.get("vary")
            if fix is not None:
                frame = _changing(net, frame, fix).where("not _hit").select(*columns)
            if vary is not None:
                frame = _changing(net, frame, vary).where("_hit").select(*columns)
            return frame
        if name == "fixedas":
            for key in ("fixed_dyads", "present", "absent"):
                if key in t.kwargs:
                    frame = _listed(frame, net, data[attr_name(t.kwargs[key])], "left_anti")
            return frame
        if name == "fixallbut":
            return _listed(frame, net, data[attr_name(t.kwargs.get("free_dyads", t.args[0] if t.args else None))], "left_semi")
        if name == "egocentric":
            attr, direction = attr_name(t.args[0]), t.kwargs.get("direction", "both")
            got = _values(net, frame, attr)
            return got.where(_sees(direction, F.col("_s"), F.col("_d"))).select(*columns)
        raise FormulaError(f"no constraint {t.name!r} on dyads")

    def free(frame: DataFrame) -> DataFrame:
        if any(t.name.lower() == "observed" for t in parsed):  # what has been observed is fixed: only missing dyads vary
            frame = net.missing_dyads().select(*frame.columns)
        for t in parsed:
            frame = one(frame, t)
        return frame

    free.by_class = by_class(net, parsed)
    return free


def by_class(net: Network, parsed: list[Term]) -> tuple[list[str], Column] | None:
    """The attributes of both ends that decide whether a dyad is free, and the condition over them as s_... and d_...; None where
    the constraints look at more than attributes."""
    attrs, condition = [], F.lit(True)
    for t in parsed:
        name = t.name.lower()
        if name == ".":
            continue
        if name not in ("blockdiag", "blocks", "egocentric"):
            return None
        attr = attr_name(t.args[0])
        s, d = F.col(f"`s_{attr}`"), F.col(f"`d_{attr}`")
        if name == "blockdiag":
            condition = condition & (s == d)
        elif name == "blocks":
            for r, c in _fixed_cells(net, t, attr):
                condition = condition & ~((s == r) & (d == c))
        else:
            direction = t.kwargs.get("direction", "both")
            if direction != "both" and not net.directed and not net.bipartite:
                return None  # which end is src is not the attribute's to say
            condition = condition & _sees(direction, s, d)
        attrs.append(attr)
    return list(dict.fromkeys(attrs)), condition
