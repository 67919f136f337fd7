"""One entry for fits: exact where dyads are independent, by simulation elsewhere, with a log-likelihood by bridge sampling."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.formula import Name, Term, parse
from netloom.network import Network, NetworkError
from netloom.operators.terms import Context
from netloom.plans import gof as distributions
from netloom.plans import pseudolikelihood
from netloom.plans.constraints import free_dyads
from netloom.plans.estimation import MonteCarloFit, mcmle
from netloom.plans.pseudolikelihood import Fit
from netloom.plans.sampling import _text, expand_one, simulate
from netloom.plans.summary import Bound, b_name, expand, summary_stats


def independent(net: Network, formula: str, data: dict | None = None) -> bool:
    """Whether the change of every statistic of the formula is the same whatever the other ties are."""
    return all(isinstance(x, Bound) and x.stat.dyad is not None for x in expand(formula, Context(net, data or {})))


def dyads(net: Network) -> int:
    """Number of dyads of all networks whose state is known."""
    every = net.graphs.agg(F.sum(net.dyads()).alias("n")).first()["n"]
    return int(every or 0) - net.missing_dyads().count()


def bridge_loglik(net: Network, formula: str, coef, *, bridges: int = 10, nsim: int = 200, burnin: int = 4000, interval: int = 200, chains: int = 4, seed: int = 1) -> float:
    """The log-likelihood at `coef`: that of the formula's dyad-independent part, which is exact, and the integral from there
    of the way times the distance of the observed statistics from their means, at the nodes of a Gauss-Legendre rule.

    Each node is one Spark job of `chains` tasks; only the means come back.
    """
    terms = [Term(t.text) if isinstance(t, Name) else t for _, t in parse(formula).terms]
    names, plain, alone = [], [], []
    for t in terms:
        own = expand_one(t, net)
        free = all(isinstance(x, Bound) and x.stat.dyad is not None for x in own)
        names += [b_name(x) for x in own]
        plain += [free] * len(own)
        alone += [_text(t)] if free else []
    end, start = np.array(coef, float), np.zeros(len(names))
    if len(end) != len(names):
        raise NetworkError(f"{len(names)} coefficients are needed: {names}")
    value = -dyads(net) * math.log(2)
    if alone:
        base = pseudolikelihood.fit(net, "+".join(alone))
        start[np.array(plain)] = base.coef
        value = base.loglik
    obs = {r["stat"]: r["value"] for r in summary_stats(net, formula).collect()}
    observed = np.array([obs[n] for n in names])
    places, weights = np.polynomial.legendre.leggauss(bridges)
    for k, (x, w) in enumerate(zip((places + 1) / 2, weights / 2)):
        theta = start + x * (end - start)
        drawn = simulate(net, formula, theta.tolist(), nsim, burnin=burnin, interval=interval, chains=chains, seed=seed * 1009 + k)
        mean = {r["stat"]: r["m"] for r in drawn.groupBy("stat").agg(F.avg("value").alias("m")).collect()}
        value += float(w * (end - start) @ (observed - np.array([mean[n] for n in names])))
    return value


def ergm(net: Network, formula: str, *, estimate: str = "MLE", constraints: str | None = None, data: dict | None = None, offset_coef: list[float] | None = None, target_stats: list[float] | None = None, eval_loglik: bool = True, **control) -> Fit:
    """A fit of `formula`: maximum likelihood (exact for dyad-independent models, by Monte Carlo for others) or, with
    estimate="MPLE", maximum pseudo-likelihood. Offsets and constraints on dyads are for what needs no chain; target
    statistics, in the place of the observed ones, for what does. `control` goes to mcmle()."""
    if estimate not in ("MLE", "MPLE"):
        raise NetworkError(f"no estimate {estimate!r}")
    free = free_dyads(net.held(), constraints, data) if constraints else None
    plain = independent(net, formula, data)
    if estimate == "MPLE" or plain and target_stats is None:
        return pseudolikelihood.fit(net, formula, data, offset_coef, free=free)
    if constraints or offset_coef or data:
        raise NetworkError("chains know no constraints, offsets or covariates")
    got: MonteCarloFit = mcmle(net, formula, target=target_stats, **control)
    n = dyads(net)
    value = bridge_loglik(net, formula, got.coef) if eval_loglik and target_stats is None else float("nan")
    return Fit(got.names, got.coef, got.cov + got.mc_cov, value, -n * math.log(2), n, np.zeros(len(got.names), bool), False)


def simulated_networks(net: Network, formula: str, coef, nsim: int = 100, **control) -> Network:
    """Draws of a model as networks of their own, 0 to nsim - 1, on the vertices of `net`."""
    ties = simulate(net, formula, list(map(float, coef)), nsim, ties=True, **control)
    sims = net.vertices.sparkSession.range(nsim).select(F.col("id").alias("net"))
    vertices = sims.join(F.broadcast(net.vertices.drop("net")))
    graphs = sims.join(F.broadcast(net.graphs.drop("net")))
    edges = ties.select(F.col("sim").alias("net"), "src", "dst", F.lit(1.0).alias("w"), F.lit(False).alias("na"))
    return Network(vertices, edges, graphs, net.directed, net.bipartite)


def gof(net: Network, formula: str, coef, nsim: int = 100, of: tuple[str, ...] | None = None, **control) -> DataFrame:
    """(statistic, k, obs, min, mean, max, p): degrees, shared partners, distances and the model's own statistics of the observed
    network against draws of the model; twice the smaller tail, 1 at most."""
    from netloom.sources.kept import keep

    drawn = simulated_networks(net, formula, coef, nsim, **control)
    kept = keep(drawn.edges, "draws")  # one walk of the chains for all distributions
    drawn = Network(drawn.vertices, kept, drawn.graphs, net.directed, net.bipartite)
    of = of or (("idegree", "odegree") if net.directed else ("degree",)) + ("espartners", "distance", "model")
    makers = {
        "degree": lambda x: distributions.degree_distribution(x),
        "idegree": lambda x: distributions.degree_distribution(x, "in"),
        "odegree": lambda x: distributions.degree_distribution(x, "out"),
        "espartners": distributions.shared_partners,
        "distance": distributions.distances,
        "model": lambda x: summary_stats(x, formula).select("net", F.col("stat").alias("k"), F.col("value").alias("n")),
    }
    out = None
    for name in of:
        if name not in makers:
            raise NetworkError(f"no distribution {name!r}")
        text = lambda f: f.select("net", F.coalesce(F.col("k").cast("string"), F.lit("Inf")).alias("k"), F.col("n").cast("double").alias("n"))
        obs, sims = text(makers[name](net)).drop("net"), text(makers[name](drawn)).withColumnRenamed("net", "sim")
        got = distributions.p_values(obs, sims.unionByName(drawn.graphs.select(F.col("net").alias("sim")).join(F.broadcast(obs.select("k").limit(1))).withColumn("n", F.lit(0.0))).groupBy("sim", "k").agg(F.sum("n").alias("n")))
        got = got.select(F.lit(name).alias("statistic"), "k", *[F.col(c).cast("double").alias(c) for c in ("obs", "min", "mean", "max", "p")])
        out = got if out is None else out.unionByName(got)
    return out
