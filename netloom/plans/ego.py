"""Egocentric data: statistics of a population's network estimated from egos, their alters and ties among alters.

Each ego contributes half of what it sees of a dyadic statistic (the alter's ego sees the other half), all of a degree
statistic, a third of its triangles. The estimate is the weighted mean times the population's size; its variance comes
from the weighted spread of the contributions. All of it is aggregation by ego.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.formula import FormulaError, Name, Term, parse
from netloom.functions.numbers import binomial, geometric, label


def contributions(egos: DataFrame, alters: DataFrame, formula: str, aaties: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(ego, weight, h0, h1, ...): egos (ego, weight, attributes), alters (ego, alter, attributes), aaties (ego, a, b)."""
    attrs = [c for c in egos.columns if c not in ("ego", "weight") and c in alters.columns]
    pair = alters.join(egos.select("ego", *[F.col(c).alias(f"e_{c}") for c in attrs]), "ego")
    sums, names = [], []
    per_ego: list[tuple[str, object]] = []
    shared = None
    if aaties is not None:  # shared alters of an ego and each alter: ties of the alter among the alters
        ends = aaties.select("ego", F.col("a").alias("alter")).union(aaties.select("ego", F.col("b")))
        shared = ends.groupBy("ego", "alter").agg(F.count("*").alias("sp"))
        pair = pair.join(shared, ["ego", "alter"], "left").na.fill(0, ["sp"])

    def add(name, expr):
        names.append(name)
        per_ego.append(("sum", expr))
        sums.append(expr)

    def by_degree(name, f):
        names.append(name)
        per_ego.append(("degree", f))

    def levels(attr):
        found = egos.select(attr).union(alters.select(attr)).distinct().collect()
        return sorted((r[0] for r in found if r[0] is not None), key=lambda x: (str(x).casefold(), str(x).swapcase()) if isinstance(x, str) else (x,))

    half = F.lit(0.5)
    for _, t in parse(formula).terms:
        t = Term(t.text) if isinstance(t, Name) else t
        a = t.args
        if t.name == "edges":
            add("edges", half)
        elif t.name == "meandeg":
            add("meandeg", F.lit(1.0))
        elif t.name == "nodematch":
            same = F.col(f"e_{a[0]}") == F.col(a[0])
            if t.kwargs.get("diff"):
                for x in levels(a[0]):
                    add(f"nodematch.{a[0]}.{label(x)}", F.when(same & (F.col(a[0]) == x), half).otherwise(0.0))
            else:
                add(f"nodematch.{a[0]}", F.when(same, half).otherwise(0.0))
        elif t.name == "nodefactor":
            for x in levels(a[0])[1:]:
                add(f"nodefactor.{a[0]}.{label(x)}", half * ((F.col(f"e_{a[0]}") == x).cast("double") + (F.col(a[0]) == x).cast("double")))
        elif t.name == "nodemix":
            every = levels(a[0])
            for j, y in enumerate(every):
                for x in every[: j + 1]:
                    hit = ((F.col(f"e_{a[0]}") == x) & (F.col(a[0]) == y)) | ((F.col(f"e_{a[0]}") == y) & (F.col(a[0]) == x))
                    add(f"mix.{a[0]}.{label(x)}.{label(y)}", F.when(hit, half).otherwise(0.0))
        elif t.name in ("nodecov", "absdiff"):
            x, y = F.col(f"e_{a[0]}").cast("double"), F.col(a[0]).cast("double")
            add(f"{t.name}.{a[0]}", half * (x + y if t.name == "nodecov" else F.abs(x - y)))
        elif t.name == "degree":
            for d in a[0] if isinstance(a[0], list) else [a[0]]:
                by_degree(f"degree{d}", lambda c, d=d: (c == d).cast("double"))
        elif t.name == "kstar":
            for k in a[0] if isinstance(a[0], list) else [a[0]]:
                by_degree(f"kstar{k}", lambda c, k=k: binomial(c, k))
        elif t.name == "gwdegree":
            by_degree(f"gwdeg.fixed.{float(a[0]):g}", lambda c, x=float(a[0]): geometric(c, x))
        elif t.name == "concurrent":
            by_degree("concurrent", lambda c: (c >= 2).cast("double"))
        elif t.name in ("esp", "gwesp", "transitiveties", "triangle"):
            if shared is None:
                raise FormulaError(f"{t.name} needs ties among alters")
            if t.name == "esp":
                for d in a[0] if isinstance(a[0], list) else [a[0]]:
                    add(f"esp{d}", F.when(F.col("sp") == d, half).otherwise(0.0))
            elif t.name == "gwesp":
                add(f"gwesp.fixed.{float(a[0]):g}", half * geometric(F.col("sp"), float(a[0])))
            elif t.name == "transitiveties":
                add("transitiveties", F.when(F.col("sp") > 0, half).otherwise(0.0))
            else:
                add("triangle", F.col("sp").cast("double") / 6)
        else:
            raise FormulaError(f"no egocentric form of {t.name!r}")
    aggregates = [F.count("*").alias("deg")] + [F.sum(e).alias(f"s{k}") for k, (kind, e) in enumerate(per_ego) if kind == "sum"]
    seen = pair.groupBy("ego").agg(*aggregates)
    weight = F.col("weight") if "weight" in egos.columns else F.lit(1.0)
    both = egos.select("ego", weight.cast("double").alias("weight")).join(seen, "ego", "left").na.fill(0)
    return both.select("ego", "weight", *[(F.col(f"s{k}") if kind == "sum" else e(F.col("deg"))).cast("double").alias(f"h{k}") for k, (kind, e) in enumerate(per_ego)]), names


def ego_stats(egos: DataFrame, alters: DataFrame, formula: str, aaties: DataFrame | None = None, *, scale: float | None = None, variance: str = "survey") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(names, estimates, covariance): weighted means of the contributions, times `scale` (default the number of egos)."""
    frame, names = contributions(egos, alters, formula, aaties)
    k = len(names)
    w = F.col("weight")
    cells = [F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * w).alias("ww")]
    cells += [F.sum(w * F.col(f"h{i}")).alias(f"m{i}") for i in range(k)] + [F.sum(w * w * F.col(f"h{i}")).alias(f"u{i}") for i in range(k)]
    cells += [F.sum(w * w * F.col(f"h{i}") * F.col(f"h{j}")).alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1)]
    cells += [F.sum(w * F.col(f"h{i}") * F.col(f"h{j}")).alias(f"d{i}_{j}") for i in range(k) for j in range(i + 1)]
    r = frame.agg(*cells).first()
    n, total = r["n"], r["w"]
    mean = np.array([r[f"m{i}"] for i in range(k)]) / total
    at = lambda p, i, j: r[f"{p}{max(i, j)}_{min(i, j)}"]
    if variance in ("survey", "asymptotic"):  # linearised: sum of (w (h - mean) / W)^2, with n / (n - 1) for the survey one
        u = np.array([r[f"u{i}"] for i in range(k)])
        cov = np.array([[at("c", i, j) - mean[i] * u[j] - mean[j] * u[i] + mean[i] * mean[j] * r["ww"] for j in range(k)] for i in range(k)]) / total**2
        cov = cov * (n / (n - 1) if variance == "survey" else 1.0)
    elif variance == "naive":
        cov = np.array([[at("d", i, j) / total - mean[i] * mean[j] for j in range(k)] for i in range(k)]) / (n - 1)
    elif variance in ("jackknife", "bootstrap"):
        got = frame.toPandas()  # one short row for each ego of the survey
        h, ws = got[[f"h{i}" for i in range(k)]].to_numpy(), got["weight"].to_numpy()
        if variance == "jackknife":
            left = (mean * total - h * ws[:, None]) / (total - ws)[:, None]
            cov = (n - 1) / n * (left - left.mean(0)).T @ (left - left.mean(0))
        else:
            rng = np.random.default_rng(0)
            draws = rng.multinomial(n, np.full(n, 1 / n), 2000)
            means = (draws * ws) @ h / (draws @ ws)[:, None]
            cov = np.cov(means, rowvar=False).reshape(k, k)
    else:
        raise ValueError(f"no variance {variance!r}")
    factor = float(n if scale is None else scale)
    return names, mean * factor, cov * factor**2
