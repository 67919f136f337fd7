"""Tie ages of a series of networks, and statistics over them.

A tie's age counts steps since it was last absent (1 when formed): runs of consecutive steps are islands, told apart by
the step minus its row number, so one window over each dyad's own rows is all that is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.numbers import label


def tie_ages(ties: DataFrame, time: str = "t") -> DataFrame:
    """(t, src, dst, age) for ties (t, src, dst) at whole-number steps."""
    dyad = Window.partitionBy("src", "dst").orderBy(time)
    island = ties.select(time, "src", "dst").distinct().withColumn("_g", F.col(time) - F.row_number().over(dyad))
    run = Window.partitionBy("src", "dst", "_g").orderBy(time)
    return island.withColumn("age", F.row_number().over(run).cast("long")).select(time, "src", "dst", "age")


def spells(ties: DataFrame, time: str = "t") -> DataFrame:
    """(src, dst, onset, last, duration, censored_left, censored_right) for each unbroken run of a tie."""
    aged = tie_ages(ties, time)
    ends = ties.agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    run = aged.withColumn("onset", F.col(time) - F.col("age") + 1).groupBy("src", "dst", "onset").agg(F.max(time).alias("last"))
    return run.crossJoin(F.broadcast(ends)).select("src", "dst", "onset", "last", (F.col("last") - F.col("onset") + 1).alias("duration"), (F.col("onset") == F.col("_first")).alias("censored_left"), (F.col("last") == F.col("_last")).alias("censored_right"))


def changes(ties: DataFrame, time: str = "t") -> DataFrame:
    """(t, formed, dissolved, persisted) against the step before, from the second step on."""
    now = ties.select(F.col(time).alias("t"), "src", "dst").distinct()
    before = now.select((F.col("t") + 1).alias("t"), "src", "dst")
    both = now.withColumn("_n", F.lit(1)).join(before.withColumn("_b", F.lit(1)), ["t", "src", "dst"], "full")
    steps = now.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    got = both.groupBy("t").agg(F.sum(F.when(F.col("_b").isNull(), 1).otherwise(0)).cast("long").alias("formed"), F.sum(F.when(F.col("_n").isNull(), 1).otherwise(0)).cast("long").alias("dissolved"), F.sum(F.when(F.col("_n").isNotNull() & F.col("_b").isNotNull(), 1).otherwise(0)).cast("long").alias("persisted"))
    return got.crossJoin(F.broadcast(steps)).where("t > lo and t <= hi").select("t", "formed", "dissolved", "persisted")


def age_stats(ages: DataFrame, time: str = "t", *, intervals: list[tuple[float, float | None]] = (), log: bool = False, empty: float = 0.0) -> DataFrame:
    """(t, stat, value): edges, edge.ages, mean.age and edges.age<from>to<to> at each step."""
    age = F.col("age").cast("double")
    mean = F.avg(F.log(age) if log else age)
    cells = [("edges", F.count("*").cast("double")), ("edge.ages", F.sum(age)), ("mean.age" if not log else "mean.log.age", F.coalesce(mean, F.lit(float(empty))))]
    for lo, hi in intervals:
        test = (age >= lo) if hi is None else (age >= lo) & (age < hi)
        cells.append((f"edges.age{label(lo)}{'+' if hi is None else f'to{label(hi)}'}", F.sum(F.when(test, 1.0).otherwise(0.0))))
    wide = ages.groupBy(time).agg(*[c.alias(f"c{k}") for k, (_, c) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(n).alias("stat"), F.col(f"c{k}").alias("value")) for k, (n, _) in enumerate(cells)])
    return wide.select(time, F.explode(rows).alias("r")).select(time, "r.stat", "r.value")


def _mean(log: bool, where, empty: float, weight=None):
    """The mean of the ages, or of their logarithms, where a condition holds; `empty` where nothing does or the weights add up to 0."""
    age = F.col("age").cast("double")
    w = F.when(where, F.lit(1.0) if weight is None else weight.cast("double"))
    total = F.sum(w)
    return F.when(F.coalesce(total, F.lit(0.0)) != 0, F.sum(w * (F.log(age) if log else age)) / total).otherwise(F.lit(float(empty)))


def _stacked(frame: DataFrame, time: str, cells: list[tuple]) -> DataFrame:
    """(t, stat, value) from one aggregate for each named column."""
    wide = frame.groupBy(time).agg(*[c.cast("double").alias(f"c{k}") for k, (_, c) in enumerate(cells)])
    names = [n.replace("\\", "\\\\").replace("'", "\\'") for n, _ in cells]
    return wide.selectExpr(time, "inline(array(" + ", ".join(f"named_struct('stat', '{n}', 'value', c{k})" for k, n in enumerate(names)) + "))")


def _with(ages: DataFrame, covariate: DataFrame, directed: bool) -> DataFrame:
    """Ties with the covariate (i, j, x) of their dyad as x, 0 where it names none; undirected ones take its upper triangle."""
    c = covariate.select(F.col("i").alias("src"), F.col("j").alias("dst"), "x")
    if not directed:
        c = c.where("src < dst")
        ages = ages.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    return ages.join(c, ["src", "dst"], "left").na.fill(0.0, ["x"])


def covariate_ages(ages: DataFrame, covariate: DataFrame, name: str, time: str = "t", *, directed: bool = True, log: bool = False, empty: float = 0.0) -> DataFrame:
    """(t, stat, value): edgecov.ages, the covariate times the ages of the ties, and the mean age weighted by the covariate."""
    x = F.col("x").cast("double")
    title = f"mean.{'log.' if log else ''}age.{name}"
    return _stacked(_with(ages, covariate, directed), time, [(f"edgecov.ages.{name}", F.sum(x * F.col("age"))), (title, _mean(log, F.lit(True), empty, x))])


def _mixed(ages: DataFrame, vertices: DataFrame, attr: str) -> DataFrame:
    v = vertices.select(F.col("vid"), F.col(attr).alias("_level"))
    for end, to in (("src", "_s"), ("dst", "_d")):
        ages = ages.join(v.select(F.col("vid").alias(end), F.col("_level").alias(to)), end)
    return ages


def _levels(vertices: DataFrame, attr: str, levels: list | None) -> list:
    return levels if levels is not None else sorted(r[0] for r in vertices.select(attr).distinct().collect())


def mixing_mean_age(ages: DataFrame, vertices: DataFrame, attr: str, time: str = "t", *, directed: bool = True, levels: list | None = None, empty: float = 0.0, log: bool = False) -> DataFrame:
    """(t, stat, value): nodemix.mean.age, the mean age of the ties of each mixing type."""
    known = _levels(vertices, attr, levels)
    base = f"nodemix.mean.{'log.' if log else ''}age.{attr}"
    cells = []
    for j, c in enumerate(known):
        for r in known if directed else known[: j + 1]:
            hit = (F.col("_s") == r) & (F.col("_d") == c)
            if not directed:
                hit = hit | (F.col("_s") == c) & (F.col("_d") == r)
            cells.append((f"{base}.{label(r)}.{label(c)}", _mean(log, hit, empty)))
    return _stacked(_mixed(ages, vertices, attr), time, cells)


def factor_mean_age(ages: DataFrame, vertices: DataFrame, attr: str, time: str = "t", *, levels: list | None = None, empty: float = 0.0, log: bool = False) -> DataFrame:
    """(t, stat, value): nodefactor.mean.age, the mean age of the ties' ends at vertices of each level; a tie inside a level counts twice."""
    v = vertices.select("vid", F.col(attr).alias("_level"))
    ends = ages.select(time, F.col("src").alias("vid"), "age").union(ages.select(time, F.col("dst"), "age")).join(v, "vid")
    base = f"nodefactor.mean.{'log.' if log else ''}age.{attr}"
    return _stacked(ends, time, [(f"{base}.{label(x)}", _mean(log, F.col("_level") == x, empty)) for x in _levels(vertices, attr, levels)])


def degree_range_mean_age(ages: DataFrame, ranges: list[tuple[int, int | None]], time: str = "t", *, empty: float = 0.0, log: bool = False) -> DataFrame:
    """(t, stat, value): degrange.mean.age, the mean age of the ties' ends at vertices with a degree from `lo` up to below `hi` (None: any)."""
    ends = ages.select(time, F.col("src").alias("vid"), "age").union(ages.select(time, F.col("dst"), "age"))
    degree = ends.groupBy(time, "vid").agg(F.count("*").alias("_deg"))
    both = ends.join(degree, [time, "vid"])
    base = f"mean.{'log.' if log else ''}age"
    cells = [(f"deg{lo}{'+' if hi is None else f'to{hi}'}.{base}", _mean(log, (F.col("_deg") >= lo) if hi is None else (F.col("_deg") >= lo) & (F.col("_deg") < hi), empty)) for lo, hi in ranges]
    return _stacked(both, time, cells)


def edge_ages_of(net, ages: DataFrame, formula: str, time: str = "t") -> DataFrame:
    """(t, stat, value): EdgeAges(formula), for each statistic of a dyad-independent formula the ages of the ties times its change."""
    from netloom.formula import FormulaError
    from netloom.operators.terms import Context
    from netloom.plans.summary import b_name, expand

    stats = expand(formula, Context(net, {}))
    if any(getattr(x, "stat", None) is None or x.stat.dyad is None for x in stats):
        raise FormulaError("EdgeAges() takes dyad-independent terms")
    attrs = list(dict.fromkeys(a for x in stats for a in x.stat.attrs))
    frame = ages
    for end, p in (("src", "s_"), ("dst", "d_")):
        if attrs:
            frame = frame.join(net.vertices.select(F.col("vid").alias(end), *[F.col(f"`{a}`").alias(p + a) for a in attrs]).distinct(), end)
    return _stacked(frame, time, [(f"EdgeAges~{b_name(x)}", F.sum(x.stat.dyad * F.col("age"))) for x in stats])


def level_mean_age(ages: DataFrame, vertices: DataFrame, attr: str, time: str = "t", log: bool = False) -> DataFrame:
    """(t, level, value): mean age of the ties that end at a vertex of the level, counted at both ends."""
    v = vertices.select("vid", F.col(attr).alias("level"))
    ends = ages.select(time, F.col("src").alias("vid"), "age").union(ages.select(time, F.col("dst"), "age"))
    age = F.col("age").cast("double")
    return ends.join(v, "vid").groupBy(time, "level").agg(F.avg(F.log(age) if log else age).alias("value"))


def degree_mean_age(ages: DataFrame, degrees: list[int], time: str = "t", empty: float = 0.0) -> DataFrame:
    """(t, stat, value): mean age of the ties at vertices of each degree."""
    ends = ages.select(time, F.col("src").alias("vid"), "age").union(ages.select(time, F.col("dst"), "age"))
    degree = ends.groupBy(time, "vid").agg(F.count("*").alias("deg"), F.sum("age").alias("s"))
    cells = [(f"degree{d}.mean.age", F.coalesce(F.sum(F.when(F.col("deg") == d, F.col("s"))) / F.sum(F.when(F.col("deg") == d, F.col("deg"))), F.lit(float(empty)))) for d in degrees]
    wide = degree.groupBy(time).agg(*[c.cast("double").alias(f"c{k}") for k, (_, c) in enumerate(cells)])
    rows = F.array(*[F.struct(F.lit(n).alias("stat"), F.col(f"c{k}").alias("value")) for k, (n, _) in enumerate(cells)])
    return wide.select(time, F.explode(rows).alias("r")).select(time, "r.stat", "r.value")
