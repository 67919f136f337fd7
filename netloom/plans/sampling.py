"""Simulated networks: Metropolis chains, one task each.

A chain is sequential, so parallelism is across chains: each is a row of a DataFrame, walked inside mapInPandas over
adjacency sets with the change of every statistic updated per toggle. What a chain needs (dyad-independent changes,
starting ties) is broadcast; a network whose dyads exceed `most` is refused, as its chain does not fit a task.

Constraints: those on dyads leave all but the free ones alone; bd(maxout, maxin, minout, minin) refuses toggles past its
bounds; edges keeps the number of ties, moving one at a time; degrees keeps every vertex's degrees (in and out), by
swapping the far ends of two ties (directed networks can't turn a three-cycle round by such swaps).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from netloom.formula import Name, Term, parse
from netloom.network import Network, NetworkError
from netloom.operators.terms import Context
from netloom.plans import pseudolikelihood
from netloom.plans.summary import b_name, expand


def _kernel(term: Term, directed: bool):
    """change(out, in_, i, j): what adding i -> j to a network without it adds, for the terms that depend on other ties."""
    a = [x for x in term.args]
    if term.name == "mutual":
        return [lambda out, inn, i, j: float(i in out[j])]
    if term.name == "triangle" and not directed:
        return [lambda out, inn, i, j: float(len(out[i] & out[j]))]
    if term.name == "ttriple":
        return [lambda out, inn, i, j: float(len(out[i] & inn[j]) + len(out[i] & out[j]) + len(inn[i] & inn[j]))]
    if term.name == "ctriple":
        return [lambda out, inn, i, j: float(len(out[j] & inn[i]))]
    ks = a[0] if a and isinstance(a[0], list) else a[:1]
    if term.name in ("kstar", "ostar", "istar"):
        def star(k):
            if term.name == "kstar":
                return lambda out, inn, i, j: float(math.comb(len(out[i]), k - 1) + math.comb(len(out[j]), k - 1))
            return (lambda out, inn, i, j: float(math.comb(len(out[i]), k - 1))) if term.name == "ostar" else (lambda out, inn, i, j: float(math.comb(len(inn[j]), k - 1)))

        return [star(k) for k in ks]
    if term.name == "degree" and not directed:
        def exact(d):
            step = lambda x: (x + 1 == d) - (x == d)
            return lambda out, inn, i, j: float(step(len(out[i])) + step(len(out[j])))

        return [exact(d) for d in ks]
    if term.name == "isolates" and not directed:
        return [lambda out, inn, i, j: -float(not out[i]) - float(not out[j])]
    if term.name == "gwdegree" and not directed and term.kwargs.get("fixed"):
        rate = 1 - math.exp(-float(a[0]))
        return [lambda out, inn, i, j: rate ** len(out[i]) + rate ** len(out[j])]
    if term.name == "gwesp" and not directed and term.kwargs.get("fixed"):
        decay = float(a[0])
        rate, top = 1 - math.exp(-decay), math.exp(decay)

        def gwesp(out, inn, i, j):
            both = out[i] & out[j]
            total = top * (1 - rate ** len(both))
            for k in both:
                total += rate ** len(out[i] & out[k]) + rate ** len(out[j] & out[k])
            return total

        return [gwesp]
    return None


def simulate(net: Network, formula: str, coef: list[float], nsim: int = 100, *, burnin: int = 10_000, interval: int = 1000, chains: int = 4, seed: int = 0, most: int = 4_000_000, ties: bool = False, constraints: str | None = None, data: dict | None = None) -> DataFrame:
    """(sim, stat, value), or with ties=True (sim, src, dst): draws of one network's model at the given coefficients, under constraints."""
    spark = net.vertices.sparkSession
    net = net.held()
    (row,) = net.graphs.collect() if net.graphs.count() == 1 else (None,)
    if row is None:
        raise NetworkError("simulate() draws from one network at a time")
    n, directed = row["n"], net.directed
    if n * n > most:
        raise NetworkError(f"{n} vertices: a chain would not fit into a task")
    parsed = [Term(t.text) if isinstance(t, Name) else t for _, t in parse(formula).terms]
    names: list[str] = []
    fixed: list[np.ndarray | None] = []
    kernels: list = []
    for t in parsed:
        stats = expand_one(t, net)
        own = [b_name(s) for s in stats]
        moving = _kernel(t, directed) if t.name not in ("edges",) else None
        if moving is not None and len(moving) == len(own):
            fixed += [None] * len(own)
            kernels += moving
        else:
            frame, _, got = pseudolikelihood.design(net, _text(t))
            if any(s.stat.dyad is None for s in got):
                raise NetworkError(f"no chain for {t.name}")
            rows = frame.toPandas()
            for k in range(len(own)):
                m = np.zeros((n, n))
                m[rows["src"], rows["dst"]] = rows[f"x{k}"]
                fixed.append(m)
                kernels.append(None)
        names += own
    start = [(r["src"], r["dst"]) for r in net.ties.select("src", "dst").collect()]
    theta = np.array(coef, float)
    if len(theta) != len(names):
        raise NetworkError(f"{len(names)} coefficients are needed: {names}")
    kind, bounds, free = _constrained(net, constraints, data, n)
    state = spark.sparkContext.broadcast((fixed, start, free))

    def walk(batches):
        fixed, start, free = state.value
        moving = [(k, f) for k, f in enumerate(kernels) if f is not None]
        constant = [(k, m) for k, m in enumerate(fixed) if m is not None]
        for batch in batches:
            for chain, draws, first in zip(batch["chain"], batch["draws"], batch["first"]):
                rng = np.random.default_rng([seed, int(chain)])
                out = [set() for _ in range(n)]
                inn = [set() for _ in range(n)] if directed else out
                edges: list[tuple[int, int]] = []
                place: dict[tuple[int, int], int] = {}
                value = np.zeros(len(names))

                def change(i, j):
                    x = np.zeros(len(names))
                    for k, m in constant:
                        x[k] = m[i, j]
                    for k, f in moving:
                        x[k] = f(out, inn, i, j)
                    return x

                def add(i, j):
                    out[i].add(j)
                    inn[j].add(i)
                    place[i, j] = len(edges)
                    edges.append((i, j))

                def drop(i, j):
                    out[i].discard(j)
                    inn[j].discard(i)
                    k = place.pop((i, j))
                    last = edges.pop()
                    if k < len(edges):
                        edges[k] = last
                        place[last] = k

                for i, j in start:
                    value += change(i, j)
                    add(i, j)
                dyads = n * (n - 1) if directed else n * (n - 1) // 2

                def past(i, j, here):
                    """Whether the toggle would leave the bounds of degrees."""
                    o, n_ = len(out[i]), len(inn[j])
                    if here:
                        return o <= bounds["minout"] or n_ <= bounds["minin"]
                    return o >= bounds["maxout"] or n_ >= bounds["maxin"]

                def traded(old, new):
                    """The ties `old` for `new`, if the model accepts it."""
                    nonlocal value
                    x = np.zeros(len(names))
                    for i, j in old:
                        drop(i, j)
                        x -= change(i, j)
                    for i, j in new:
                        x += change(i, j)
                        add(i, j)
                    if math.log(rng.random()) < float(x @ theta):
                        value = value + x
                        return
                    for i, j in new:
                        drop(i, j)
                    for i, j in old:
                        add(i, j)

                def settle(i, j):
                    return (i, j) if directed or i < j else (j, i)

                def move():
                    """A tie goes to a dyad without one."""
                    if not 0 < len(edges) < dyads:
                        return
                    i, j = edges[int(rng.integers(len(edges)))]
                    k, m = int(rng.integers(n)), int(rng.integers(n - 1))
                    k, m = settle(k, m + (m >= k))
                    if (k, m) in place or free is not None and not (free[i, j] and free[k, m]):
                        return
                    traded([(i, j)], [(k, m)])

                def swap():
                    """Two ties trade their far ends."""
                    if len(edges) < 2:
                        return
                    (a, b), (c, d) = (edges[int(rng.integers(len(edges)))] for _ in range(2))
                    if not directed and rng.random() < 0.5:
                        c, d = d, c
                    if a == d or c == b:
                        return
                    old, new = [settle(a, b), settle(c, d)], [settle(a, d), settle(c, b)]
                    if old[0] == old[1] or new[0] == new[1] or any(e in place for e in new) or free is not None and not all(free[e] for e in old + new):
                        return
                    traded(old, new)

                def toggle():
                    nonlocal value
                    ties_now = len(edges)
                    if ties_now and rng.random() < 0.5:  # tie or no tie: half of the proposals pick a tie
                        i, j = edges[int(rng.integers(ties_now))]
                    else:
                        i, j = int(rng.integers(n)), int(rng.integers(n - 1))
                        j += j >= i
                        if not directed and i > j:
                            i, j = j, i
                    here = (i, j) in place
                    if free is not None and not free[i, j] or bounds and past(i, j, here):
                        return
                    if here:
                        drop(i, j)
                    x = change(i, j)
                    m = ties_now - here  # ties without this dyad
                    with_tie = 0.5 / (m + 1) + 0.5 / dyads
                    without = 0.5 / dyads if m else 1.0 / dyads
                    ratio = float(x @ theta) + math.log(with_tie / without)
                    accept = -ratio if here else ratio
                    if math.log(rng.random()) < accept:
                        if here:
                            value = value - x
                        else:
                            value = value + x
                            add(i, j)
                    elif here:
                        add(i, j)

                step = {"toggle": toggle, "edges": move, "degrees": swap}[kind]
                for _ in range(burnin):
                    step()
                for d in range(int(draws)):
                    if d:
                        for _ in range(interval):
                            step()
                    if ties:
                        yield pd.DataFrame({"sim": int(first) + d, "src": [i for i, _ in edges], "dst": [j for _, j in edges]}).astype("int64")
                    else:
                        yield pd.DataFrame({"sim": int(first) + d, "stat": names, "value": value})

    each, more = divmod(nsim, chains)
    rows, first = [], 0
    for c in range(chains):
        draws = each + (c < more)
        if draws:
            rows.append((c, draws, first))
            first += draws
    plan = spark.createDataFrame(rows, "chain int, draws int, first int").repartition(len(rows), "chain")
    return plan.mapInPandas(walk, "sim long, src long, dst long" if ties else "sim long, stat string, value double")


def _constrained(net: Network, constraints: str | None, data: dict | None, n: int) -> tuple[str, dict, np.ndarray | None]:
    """How a chain moves, the bounds of degrees, and which dyads are free (None: all)."""
    from netloom.plans.constraints import free_dyads

    kind, bounds, rest = "toggle", {}, []
    for t in [Term(t.text) if isinstance(t, Name) else t for _, t in parse(constraints).terms] if constraints else []:
        name = t.name.lower()
        if name in ("edges", "degrees", "nodedegrees"):
            kind = "degrees" if kind == "degrees" or name != "edges" else "edges"
        elif name == "bd":
            order = ("maxout", "maxin", "minout", "minin")
            given = dict(zip(order, t.args)) | t.kwargs
            bounds = {k: float(given[k]) if given.get(k) is not None else -math.inf if k.startswith("min") else math.inf for k in order}
            if not net.directed:  # one degree: the bounds of both kinds hold
                bounds["maxout"] = bounds["maxin"] = min(bounds["maxout"], bounds["maxin"])
                bounds["minout"] = bounds["minin"] = max(bounds["minout"], bounds["minin"])
        elif name != ".":
            rest.append(_text(t))
    if bounds and kind != "toggle":
        raise NetworkError("bd goes with toggles only")
    free = None
    if rest or net.missing_dyads().limit(1).count():
        some = free_dyads(net, "+".join(rest) if rest else "~.", data)(net.dyad_frame()).select("src", "dst").toPandas()
        free = np.zeros((n, n), bool)
        free[some["src"], some["dst"]] = True
    return kind, bounds, free


def expand_one(t: Term, net: Network) -> list:
    from netloom.formula import Formula

    return expand(Formula(((1, t),)), Context(net, {}))


def _text(t: Term) -> str:
    """The term as a formula again, for terms with plain arguments."""
    show = lambda x: f"'{x}'" if isinstance(x, str) else "TRUE" if x is True else "FALSE" if x is False else "NULL" if x is None else f"c({','.join(map(show, x))})" if isinstance(x, list) else str(x)
    inner = [show(a) for a in t.args] + [f"{k}={show(v)}" for k, v in t.kwargs.items()]
    return f"{t.name}({','.join(inner)})" if inner else t.name
