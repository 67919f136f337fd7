"""Monte Carlo maximum likelihood, conditional maximum likelihood of series, and the bootstrap over time steps."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.network import Network, NetworkError
from netloom.plans import pseudolikelihood
from netloom.plans.pseudolikelihood import Fit
from netloom.plans.sampling import simulate
from netloom.plans.summary import summary_stats


@dataclass
class MonteCarloFit:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    mc_cov: np.ndarray
    iterations: int
    converged: bool
    sample: np.ndarray
    target: np.ndarray

    @property
    def stderr(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov + self.mc_cov))


def effective_size(x: np.ndarray) -> float:
    """Of one chain, by Geyer's initial monotone sequence of autocovariances."""
    n = len(x)
    if n < 4 or x.std() == 0:
        return float(n)
    z = np.fft.rfft(x - x.mean(), 2 * n)
    acov = np.fft.irfft(z * np.conj(z))[:n] / n
    pairs = acov[: n // 2 * 2].reshape(-1, 2).sum(axis=1)
    stop = np.flatnonzero(pairs <= 0)
    pairs = np.minimum.accumulate(pairs[: stop[0] if len(stop) else None])
    return float(min(n, n * acov[0] / max(2 * pairs.sum() - acov[0], acov[0] / n)))


def split_rhat(chains: np.ndarray) -> float:
    """(chains, draws): potential scale reduction of the halves of all chains."""
    half = chains.shape[1] // 2
    parts = np.vstack([chains[:, :half], chains[:, half : 2 * half]])
    within, between = parts.var(axis=1, ddof=1).mean(), half * parts.mean(axis=1).var(ddof=1)
    return float(math.sqrt(((half - 1) / half * within + between / half) / within)) if within else 1.0


def geweke(x: np.ndarray, first: float = 0.1, last: float = 0.5) -> float:
    """z of the difference between the means of a chain's beginning and its end."""
    a, b = x[: int(first * len(x))], x[int((1 - last) * len(x)) :]
    se = math.sqrt(a.var(ddof=1) / effective_size(a) + b.var(ddof=1) / effective_size(b))
    return float((a.mean() - b.mean()) / se) if se else 0.0


def mcmle(net: Network, formula: str, init: list[float] | None = None, *, target: list[float] | None = None, nsim: int = 512, burnin: int = 4000, interval: int = 400, chains: int = 4, iterations: int = 30, seed: int = 1) -> MonteCarloFit:
    """Each iteration is one Spark job of `chains` tasks; the step is the log-normal approximation's, shortened while the
    target is far outside of the sample, and the search ends when the means can't be told from the target."""
    obs = {r["stat"]: r["value"] for r in summary_stats(net, formula).collect()}
    theta = np.array(init if init is not None else pseudolikelihood.fit(net, formula).coef, float)
    names = list(obs)
    target = np.array([obs[n] for n in names] if target is None else target, float)
    converged, calm = False, 0
    for turn in range(1, iterations + 1):
        drawn = simulate(net, formula, theta.tolist(), nsim, burnin=burnin, interval=interval, chains=chains, seed=seed * 1000 + turn).toPandas()
        sample = drawn.pivot(index="sim", columns="stat", values="value")[names].to_numpy()
        cov = np.cov(sample, rowvar=False).reshape(len(names), len(names))
        inverse = np.linalg.pinv(cov + 1e-10 * np.eye(len(names)))
        delta = target - sample.mean(axis=0)
        far = float(delta @ inverse @ delta)
        each = np.array_split(sample, chains)
        size = min(sum(effective_size(c[:, k]) for c in each) for k in range(len(names)))
        gamma = min(1.0, 1.5 * math.sqrt(len(names)) / math.sqrt(far)) if far > 0 else 1.0
        calm = calm + 1 if far * size < 2 * len(names) + 2 else 0
        if calm >= 2:
            converged = True
            break
        theta = theta + inverse @ (gamma * delta)
    mc = inverse / max(size, 1.0)
    return MonteCarloFit(names, theta, inverse, mc, turn, converged, sample, target)


def cmle(net: Network, form: str, persist: str) -> tuple[Fit, Fit]:
    """Separable model of a series: formation on the dyads without a tie before, over the union with the step before;
    persistence on those with one, over the intersection. Each is a fit of its own."""
    if net.previous is None:
        raise NetworkError("a series is needed")
    net = net.held()
    before = net.previous.select("net", "src", "dst")
    now = net.ties.select("net", "src", "dst")
    union, both = net.with_edges(now.union(before).distinct()), net.with_edges(now.join(before, ["net", "src", "dst"], "left_semi"))
    formed = pseudolikelihood.fit(union, form, free=lambda d: d.join(before, ["net", "src", "dst"], "left_anti"))
    kept = pseudolikelihood.fit(both, persist, free=lambda d: d.join(before, ["net", "src", "dst"], "left_semi"))
    return formed, kept


def memory_terms(net: Network, frame: DataFrame) -> DataFrame:
    """`frame` of dyads with what the step before says: autoregression (tied), stability (1 as before, -1 not), innovation and
    loss (no tie, a tie before), delrecip (the reverse tie before)."""
    before = net.previous.select("net", "src", "dst", F.lit(1).alias("_b"))
    back = net.previous.select("net", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("_r"))
    got = frame.join(before, ["net", "src", "dst"], "left").join(back, ["net", "src", "dst"], "left").na.fill(0, ["_b", "_r"])
    return got.select(*frame.columns, F.col("_b").alias("autoregression"), (2 * F.col("_b") - 1).alias("stability"), (1 - F.col("_b")).alias("innovation"), F.col("_b").alias("loss"), F.col("_r").alias("delrecip"))


def btergm(net: Network, formula: str, replicates: int = 500, seed: int = 0) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(names, estimates, replicates x parameters): pooled pseudo-likelihood of a series, with time steps drawn anew. The
    distinct rows with their counts by step are all that leaves the cluster; a draw only changes the counts' weights."""
    frame, names, _ = pseudolikelihood.design(net, formula)
    xs = [f"x{k}" for k in range(len(names))]
    rows = frame.groupBy("net", *xs, "y").agg(F.count("*").alias("n")).toPandas()
    x, y, n = rows[xs].to_numpy(float), rows["y"].to_numpy(float), rows["n"].to_numpy(float)
    steps, of = np.unique(rows["net"], return_inverse=True)

    def best(weight):
        def moments(theta):
            z = x @ theta
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            return float(weight @ (y * z - pseudolikelihood._softplus(z))), x.T @ (weight * (y - p)), (x * (weight * p * (1 - p))[:, None]).T @ x

        return pseudolikelihood.newton(moments, np.zeros(len(names)), np.arange(len(names)))[0]

    rng = np.random.default_rng(seed)
    draws = [best(n * rng.multinomial(len(steps), np.full(len(steps), 1 / len(steps)))[of]) for _ in range(replicates)]
    return names, best(n), np.array(draws)
