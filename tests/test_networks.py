"""Statistics against DuckDB twins, change statistics against toggling, and the parser."""

import itertools
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from netloom import queries
from netloom.formula import FormulaError, parse
from netloom.network import Network, NetworkError
from netloom.plans import gof, pseudolikelihood
from netloom.plans.summary import summary_stats
from netloom.streaming import ages

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-5, rtol=1e-9)
    spark.catalog.clearCache()


def network(spark, ties, n, directed=False):
    v = spark.createDataFrame([(i, "ab"[i % 2], float(i * i % 7)) for i in range(n)], "key long, g string, x double")
    return Network.from_tables(spark.createDataFrame(ties, "src long, dst long"), v, directed=directed)


def stats(net, formula):
    return {r["stat"]: r["value"] for r in summary_stats(net, formula).collect()}


def test_change_statistics_equal_toggling(spark):
    rng = np.random.default_rng(3)
    ties = [(i, j) for i, j in itertools.combinations(range(7), 2) if rng.random() < 0.45]
    net = network(spark, ties, 7)
    formula = "edges+nodematch('g')+kstar(2)+triangle+gwesp(0.5,fixed=TRUE)+esp(0:1)+degree(2)+absdiff('x')+gwdegree(0.3,fixed=TRUE)"
    a = pseudolikelihood.design(net, formula)[0].orderBy("src", "dst").toPandas().to_numpy(float)
    b = pseudolikelihood.changed(net, formula).orderBy("src", "dst").toPandas().to_numpy(float)
    assert np.abs(a - b).max() < 1e-9


def test_directed_change_statistics_by_toggling(spark):
    net = network(spark, [(0, 1), (1, 0), (1, 2), (2, 0), (3, 2)], 4, directed=True)
    frame, names, _ = pseudolikelihood.design(net, "edges+mutual+ttriple+ctriple+odegree(1)")
    rows = {(r["src"], r["dst"]): [r[f"x{k}"] for k in range(len(names))] for r in frame.collect()}
    assert rows[0, 1][:2] == [1.0, 1.0]
    assert rows[0, 2][:4] == [1.0, 1.0, 2.0, 0.0]  # closes 0 -> 1 -> 2 and makes 1 -> 0 -> 2 under 1 -> 2


def test_triangles_and_shared_partners_of_a_small_graph(spark):
    net = network(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4)], 6)
    got = stats(net, "edges+triangle+esp(0:1)+dsp(0:1)+nsp(0)+degree(0:3)+isolates+gwesp(0.5,fixed=TRUE)+cycle(3)+opentriad")
    assert got == {"edges": 5, "triangle": 1, "esp0": 2, "esp1": 3, "dsp0": 9, "dsp1": 6, "nsp0": 7, "degree0": 1, "degree1": 1, "degree2": 3, "degree3": 1, "isolates": 1, "gwesp.fixed.0.5": 3, "cycle3": 1, "opentriad": 3}


def test_an_empty_network_has_zeros(spark):
    net = network(spark, [(0, 1)], 3)
    empty = net.with_edges(net.edges.where("src < 0"))
    assert stats(empty, "edges+triangle+density+kstar(2)+gwesp(0.5,fixed=TRUE)+isolates") == {"edges": 0, "triangle": 0, "density": 0, "kstar2": 0, "gwesp.fixed.0.5": 0, "isolates": 3}


def test_missing_dyads_are_no_ties_and_not_observed(spark):
    v = spark.createDataFrame([(i,) for i in range(4)], "key long")
    e = spark.createDataFrame([(0, 1, False), (1, 2, True)], "src long, dst long, na boolean")
    net = Network.from_tables(e, v, missing="na")
    assert stats(net, "edges") == {"edges": 1}
    assert net.dyad_frame().count() == 5


def test_validation(spark):
    with pytest.raises(NetworkError):
        network(spark, [(0, 0)], 2).validated()
    with pytest.raises(NetworkError):
        network(spark, [(0, 1), (1, 0)], 2).validated()


def test_several_networks_in_one_frame(spark):
    e = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 0, 2), (1, 0, 1)], "net long, src long, dst long")
    v = spark.createDataFrame([(n, i) for n in (0, 1, 2) for i in range(3)], "net long, key long")
    got = {(r["net"], r["stat"]): r["value"] for r in summary_stats(Network.from_tables(e, v, net="net"), "edges+triangle").collect()}
    assert got == {(0, "edges"): 3, (0, "triangle"): 1, (1, "edges"): 1, (1, "triangle"): 0, (2, "edges"): 0, (2, "triangle"): 0}


def test_exact_fit_has_its_closed_form(spark):
    net = network(spark, [(0, 1), (2, 3), (0, 2), (1, 3), (4, 5)], 6)
    fit = pseudolikelihood.fit(net, "edges")
    assert fit.exact and math.isclose(fit.coef[0], math.log(5 / 10), abs_tol=1e-9)
    assert math.isclose(fit.loglik, 5 * math.log(1 / 3) + 10 * math.log(2 / 3), abs_tol=1e-9)
    fixed = pseudolikelihood.fit(net, "edges+Offset(~nodematch('g'),1.5)")
    assert fixed.coef[1] == 1.5 and fixed.df == 1


def test_distances_of_a_path(spark):
    got = {r["k"]: r["n"] for r in gof.distances(network(spark, [(0, 1), (1, 2)], 4)).collect()}
    assert got == {1: 2, 2: 1, None: 3}


def test_tie_ages_restart_after_a_gap(spark):
    ties = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (4, 0, 1)], "t long, src long, dst long")
    assert {(r["t"], r["age"]) for r in ages.tie_ages(ties).collect()} == {(1, 1), (2, 2), (4, 1)}


def test_the_parser_reads_vectors_ranges_and_formulas():
    assert [t.name for _, t in parse("net ~ edges + degree(0:3, by='g')").terms] == ["edges", "degree"]
    assert parse("degree(0:3)").terms[0][1].args == ([0, 1, 2, 3],)
    assert parse("nodemix('a', levels2=-c(1,3))").terms[0][1].kwargs == {"levels2": [-1, -3]}
    with pytest.raises(FormulaError):
        parse("edges +")
    with pytest.raises(FormulaError):
        parse("edges ? 2")


def test_unknown_terms_and_wrong_kinds_are_refused(spark):
    net = network(spark, [(0, 1)], 3)
    with pytest.raises(FormulaError):
        summary_stats(net, "nothing")
    with pytest.raises(NetworkError):
        summary_stats(net, "mutual")
    with pytest.raises(NetworkError):
        summary_stats(net, "b1star(2)")


def test_chains_draw_from_the_model(spark):
    """Independent ties: the simulated density has its closed form."""
    from netloom.plans.sampling import simulate

    net = network(spark, [(0, 1)], 8)
    got = simulate(net, "edges+nodematch('g')", [-1.0, 0.7], nsim=300, burnin=500, interval=60, chains=3).toPandas()
    mean = got.groupby("stat").value.mean()
    same = 2 * math.comb(4, 2)
    want = same / (1 + math.exp(0.3)), (28 - same) / (1 + math.exp(1.0))
    assert abs(mean["nodematch.g"] - want[0]) < 0.5 and abs(mean["edges"] - sum(want)) < 0.8


def test_chains_keep_their_statistics(spark):
    from netloom.plans.sampling import simulate

    net = network(spark, [(0, 1), (1, 2), (0, 2)], 9)
    formula = "edges+triangle+kstar(2)+gwesp(0.5,fixed=TRUE)+degree(1)+gwdegree(0.4,fixed=TRUE)"
    coef = [-1.5, 0.2, 0.05, 0.3, 0.1, 0.1]
    walked = simulate(net, formula, coef, nsim=4, burnin=300, interval=200, chains=2, seed=5).toPandas()
    drawn = simulate(net, formula, coef, nsim=4, burnin=300, interval=200, chains=2, seed=5, ties=True).toPandas()
    for sim, g in drawn.groupby("sim"):
        again = stats(network(spark, list(zip(g.src.tolist(), g.dst.tolist())), 9), formula)
        mine = walked[walked.sim == sim].set_index("stat").value
        assert all(abs(again[k] - mine[k]) < 1e-9 for k in again)


def test_egos_that_see_everything_give_the_network(spark):
    """With every vertex an ego of weight 1 the estimates are the network's own statistics."""
    from netloom.plans.ego import ego_stats

    ties = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5)]
    net = network(spark, ties, 7)
    around = {i: sorted({b if a == i else a for a, b in ties if i in (a, b)}) for i in range(7)}
    level = lambda i: "ab"[i % 2]
    egos = spark.createDataFrame([(i, level(i)) for i in range(7)], "ego long, g string")
    alters = spark.createDataFrame([(i, j, level(j)) for i, js in around.items() for j in js], "ego long, alter long, g string")
    aaties = spark.createDataFrame([(i, a, b) for i, js in around.items() for a, b in itertools.combinations(js, 2) if (a, b) in ties], "ego long, a long, b long")
    formula = "edges+nodematch('g')+degree(0:3)+kstar(2)+triangle+gwesp(0.5,fixed=TRUE)+esp(0:1)+transitiveties"
    names, value, cov = ego_stats(egos, alters, formula, aaties)
    want = stats(net, formula)
    assert all(abs(want[n] - v) < 1e-9 for n, v in zip(names, value))
    assert (np.linalg.eigvalsh(cov) > -1e-9).all()
    for kind in ("asymptotic", "naive", "jackknife", "bootstrap"):
        other = ego_stats(egos, alters, formula, aaties, variance=kind)[2]
        assert np.allclose(np.diag(other), np.diag(cov), rtol=0.35, atol=0.3)


def _two_levels(spark, directed):
    rng = np.random.default_rng(11)
    level = lambda i: "A" if i < 5 else "B"
    ties = []
    for i in range(10):
        for j in range(10):
            if i == j or (not directed and i > j) or (directed and level(i) == "B" and level(j) == "A"):
                continue
            if rng.random() < 0.45:
                ties.append((i, j))
    v = spark.createDataFrame([(i, level(i)) for i in range(10)], "key long, l string")
    return Network.from_tables(spark.createDataFrame(ties, "src long, dst long"), v, directed=directed), ties


def test_undirected_multilevel_terms(spark):
    net, ties = _two_levels(spark, False)
    y = np.zeros((10, 10))
    for i, j in ties:
        y[i, j] = y[j, i] = 1
    a, b, x = y[:5, :5], y[5:, 5:], y[:5, 5:]
    g = lambda d: 2 * (1 - 0.5**d)
    da, db, xa, xb = a.sum(1), b.sum(1), x.sum(1), x.sum(0)
    up = np.triu(np.ones((5, 5)), 1)
    want = {
        "Star2AX.l": da @ xa, "Star2BX.l": db @ xb, "AXS1A.l.0.693147": da @ g(xa), "AXS1B.l.0.693147": db @ g(xb), "AAS1X.l.0.693147": g(da) @ xa, "ABS1X.l.0.693147": g(db) @ xb, "AAAXS.l.0.693147": g(da) @ g(xa), "ABAXS.l.0.693147": g(db) @ g(xb),
        "TXAX.l": (a * up * (x @ x.T)).sum(), "TXBX.l": (b * up * (x.T @ x)).sum(), "ATXAX.l.0.693147": (a * up * g(x @ x.T)).sum(), "ATXBX.l.0.693147": (b * up * g(x.T @ x)).sum(), "L3XAX.l": (a * up * np.outer(xa, xa)).sum(), "L3XBX.l": (b * up * np.outer(xb, xb)).sum(),
        "L3AXB.l": (x * np.outer(da, db)).sum(), "C4AXB.l": np.trace(a @ x @ b @ x.T) / 2, "EXTA.l": np.diag(a @ a @ a) / 2 @ xa, "EXTB.l": np.diag(b @ b @ b) / 2 @ xb, "ASAXASB.l.0.693147": (x * np.outer(g(da), g(db))).sum(),
    }
    got = stats(net, "+".join(f"{k.split('.')[0].lower()}('l')" for k in want))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), {k: (got[k], want[k]) for k in want if abs(got[k] - want[k]) > 1e-9}


def test_directed_multilevel_terms(spark):
    net, ties = _two_levels(spark, True)
    y = np.zeros((10, 10))
    for i, j in ties:
        y[i, j] = 1
    a, b, x = y[:5, :5], y[5:, 5:], y[:5, 5:]
    g = lambda d: 2 * (1 - 0.5**d)
    ia, oa, ib, ob, xa, xb = a.sum(0), a.sum(1), b.sum(0), b.sum(1), x.sum(1), x.sum(0)
    ma, mb = a * a.T, b * b.T
    d = ".0.693147"
    want = {
        "In2StarAX.l": ia @ xa, "In2StarBX.l": ib @ xb, "Out2StarAX.l": oa @ xa, "Out2StarBX.l": ob @ xb, "AXS1Ain.l" + d: ia @ g(xa), "AXS1Bout.l" + d: ob @ g(xb), "AAinS1X.l" + d: g(ia) @ xa, "ABoutS1X.l" + d: g(ob) @ xb,
        "TXAXarc.l": (a * (x @ x.T)).sum(), "TXBXreciprocity.l": (mb * (x.T @ x)).sum() / 2, "ATXAXreciprocity.l" + d: (ma * g(x @ x.T)).sum() / 2, "ATXBXarc.l" + d: (b * g(x.T @ x)).sum(), "L3XAXreciprocity.l": (ma * np.outer(xa, xa)).sum() / 2,
        "L3AXBin.l": (x * np.outer(ia, ib)).sum(), "L3AXBout.l": (x * np.outer(oa, ob)).sum(), "L3AXBpath.l": (x * np.outer(ia, ob)).sum(), "L3BXApath.l": (x * np.outer(oa, ib)).sum(),
        "C4AXBentrainment.l": (a * (x @ b @ x.T)).sum(), "C4AXBexchange.l": (a * (x @ b.T @ x.T)).sum(), "C4AXBexchangeAreciprocity.l": (ma * (x @ b @ x.T)).sum(), "C4AXBexchangeBreciprocity.l": (a * (x @ mb @ x.T)).sum(), "C4AXBreciprocity.l": (ma * (x @ mb @ x.T)).sum() / 2,
        "AinASXAinBS.l" + d: (x * np.outer(g(ia), g(ib))).sum(), "AoutASXAinBS.l" + d: (x * np.outer(g(oa), g(ib))).sum(),
    }
    got = stats(net, "+".join(f"{k.split('.')[0].lower()}('l')" for k in want))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), {k: (got[k], want[k]) for k in want if abs(got[k] - want[k]) > 1e-9}


def test_linear_models_over_networks(spark):
    from netloom.plans.combined import network_model

    e = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 1), (2, 0, 2), (2, 1, 2), (2, 0, 1)], "net long, src long, dst long")
    v = spark.createDataFrame([(n, i) for n in range(4) for i in range(3)], "net long, key long")
    net = Network.from_tables(e, v, net="net")
    g = spark.createDataFrame([(0, 3, 1.0, "x"), (1, 3, 2.0, "y"), (2, 3, 4.0, "y"), (3, 3, 8.0, "x")], "net long, n long, z double, kind string")
    net = Network(net.vertices, net.edges, g)
    got = {r["stat"]: r["value"] for r in network_model(net, "edges+triangle", "~z+kind+I(z^2)").collect()}
    assert got == {"N(1)~edges": 6, "N(z)~edges": 2 + 2 + 12, "N(kindy)~edges": 4, "N(I(z^2))~edges": 2 + 4 + 48, "N(1)~triangle": 1, "N(z)~triangle": 4, "N(kindy)~triangle": 1, "N(I(z^2))~triangle": 16}
    some = {r["stat"]: r["value"] for r in network_model(net, "edges", "~0+kind", subset="~z>1").collect()}
    assert some == {"N(kindx)~edges": 0, "N(kindy)~edges": 4}


def test_layers(spark):
    from netloom.plans import combined

    net = network(spark, [(0, 1)], 5, directed=True)
    rows = [("f", 0, 1), ("f", 1, 0), ("f", 1, 2), ("f", 3, 4), ("g", 1, 2), ("g", 2, 1), ("g", 4, 3), ("g", 0, 2)]
    layers = spark.createDataFrame([(0, *r) for r in rows], "net long, layer string, src long, dst long")
    count = lambda logic: combined.layer_stats(net, layers, "edges", logic).first()["value"]
    assert (count("~f&g"), count("~f|g"), count("~f&t(g)"), count("~xor(f,g)"), count("~f-g"), count("~.")) == (1, 7, 2, 6, 6, 7)
    with pytest.raises(FormulaError):
        count("~!f")
    assert combined.mutual_layers(net, layers, "f", "g").first()["value"] == 2
    assert combined.mutual_layers(net, layers, "f", "f").first()["value"] == 1
    assert combined.twostar_layers(net, layers, "f", "g", "out").first()["value"] == 1 * 1 + 2 * 1 - 1
    assert abs(combined.conway_maxwell_binomial(net, layers).first()["value"] - 6 * math.log(1 / 2)) < 1e-12


def test_constraints_leave_free_dyads(spark):
    from netloom.plans.constraints import free_dyads

    net = network(spark, [(0, 1), (0, 2), (3, 5)], 6)  # levels a: 0 2 4, b: 1 3 5
    held = spark.createDataFrame([(2, 0), (1, 3)], "src long, dst long")
    count = lambda c, data=None: free_dyads(net, c, data)(net.dyad_frame()).count()
    assert count("~blockdiag('g')") == 6 and count("~blocks('g',levels2=1)") == 12 and count("~Dyads(fix=~nodematch('g'))") == 9
    assert count("~Dyads(vary=~nodematch('g'))") == 6 and count("~fixedas(present=d)", {"d": held}) == 13 and count("~fixallbut(d)", {"d": held}) == 2
    fit = pseudolikelihood.fit(net, "edges", free=free_dyads(net, "~blockdiag('g')"))
    assert fit.dyads == 6 and math.isclose(fit.coef[0], math.log(2 / 4), abs_tol=1e-9)
    with pytest.raises(FormulaError):
        count("~degrees")


def test_monte_carlo_fit_meets_the_exact_one(spark):
    from netloom.plans.estimation import mcmle

    net = network(spark, [(0, 2), (1, 3), (0, 4), (2, 4), (5, 6), (1, 6), (3, 7)], 9)
    exact = pseudolikelihood.fit(net, "edges+nodematch('g')")
    got = mcmle(net, "edges+nodematch('g')", init=[0.0, 0.0], nsim=400, burnin=800, interval=80, chains=2)
    assert got.converged and np.abs(got.coef - exact.coef).max() < 0.35
    assert np.abs(got.stderr / exact.stderr - 1).max() < 0.35


def test_separable_fit_of_a_series(spark):
    from netloom.network import series
    from netloom.plans.estimation import btergm, cmle

    ties = [(1, 0, 1), (1, 1, 2), (1, 3, 4), (2, 0, 1), (2, 2, 3), (3, 0, 1), (3, 2, 3), (3, 1, 4)]
    v = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(5)], "key long, g string")
    net = series(spark.createDataFrame(ties, "t long, src long, dst long"), v, time="t")
    formed, kept = cmle(net, "edges", "edges")
    # formed: 1 of 7 and 1 of 8 dyads without a tie before; kept: 1 of 3 and 2 of 2
    assert formed.dyads == 15 and math.isclose(formed.coef[0], math.log(2 / 13), abs_tol=1e-8)
    assert kept.dyads == 5 and math.isclose(kept.coef[0], math.log(3 / 2), abs_tol=1e-8)
    names, estimate, draws = btergm(net, "edges", replicates=20)
    assert names == ["edges"] and math.isclose(estimate[0], math.log(5 / 15), abs_tol=1e-8) and draws.shape == (20, 1)


def test_reports(spark, tmp_path):
    from netloom.plans import report

    net = network(spark, [(0, 1), (2, 3), (0, 2), (1, 3), (4, 5)], 6)
    one, two = pseudolikelihood.fit(net, "edges"), pseudolikelihood.fit(net, "edges+nodematch('g')")
    text = report.table(one, two)
    assert "edges" in text and f"{two.aic:.2f}" in text and text.splitlines()[0].split() == ["Model", "1", "Model", "2"]
    assert report.table(one, style="markdown").startswith("|") and "\\hline" in report.table(one, style="latex") and "<table>" in report.table(one, style="html")
    report.save(two, str(tmp_path / "fit.json"))
    assert np.allclose(report.load(str(tmp_path / "fit.json")).coef, two.coef)
    assert pseudolikelihood.compare(one, two)[1]["lr_df"] == 1


@pytest.mark.parametrize("directed", [False, True])
def test_tables_by_class_equal_tables_by_dyad(spark, directed):
    rng = np.random.default_rng(9)
    ties = [(i, j) for i in range(40) for j in range(40) if i != j and (directed or i < j) and rng.random() < 0.1]
    v = spark.createDataFrame([(i, "abc"[i % 3], i % 2) for i in range(40)], "key long, g string, x long")
    e = spark.createDataFrame([(i, j, k % 17 == 0) for k, (i, j) in enumerate(ties)], "src long, dst long, na boolean")
    net = Network.from_tables(e, v, missing="na", directed=directed)
    formula = "edges+nodematch('g')+absdiff('x')+nodefactor('g')+nodemix('g')"
    rows, names, stats_ = pseudolikelihood.table(net, formula)
    assert pseudolikelihood._by_class(net.held(), stats_) is not None
    xs = [f"x{k}" for k in range(len(names))]
    want = pseudolikelihood.design(net, formula)[0].groupBy(*xs, "y").count()
    assert {tuple(r[c] for c in [*xs, "y"]): r["n"] for r in rows.collect()} == {tuple(r[c] for c in [*xs, "y"]): r["count"] for r in want.collect()}


def test_observed_frees_missing_dyads_only(spark):
    from netloom.plans import constraints

    e = spark.createDataFrame([(0, 1, False), (1, 2, True), (3, 2, True), (0, 3, False)], "src long, dst long, na boolean")
    v = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(5)], "key long, g string")
    net = Network.from_tables(e, v, missing="na")
    free = lambda c: sorted((r["src"], r["dst"]) for r in constraints.free_dyads(net, c)(net.dyad_frame()).collect())
    assert free("~observed") == [(1, 2), (2, 3)]
    assert len(free("~.")) == 8
    assert free("~observed+blockdiag('g')") == []


def test_vertices_are_numbered_alike_by_a_window_and_by_ranges(spark, monkeypatch):
    from netloom import network as module

    rng = np.random.default_rng(31)
    rows = [(int(rng.integers(3)), int(k)) for k in rng.permutation(400)]
    v = spark.createDataFrame(rows, "net long, key long").repartition(5)
    e = v.limit(0).selectExpr("net", "key AS src", "key AS dst")
    one = {(r["net"], r["key"]): r["vid"] for r in Network.from_tables(e, v, net="net").vertices.collect()}
    monkeypatch.setattr(module, "ONE_WINDOW", -1)
    other = {(r["net"], r["key"]): r["vid"] for r in Network.from_tables(e, v, net="net").vertices.collect()}
    assert one == other and len(one) == 400
    for k in range(3):
        mine = sorted((key, vid) for (n, key), vid in one.items() if n == k)
        assert [vid for _, vid in mine] == list(range(len(mine)))


def test_held_networks_are_bounded(spark, monkeypatch):
    from netloom import network as module

    monkeypatch.setattr(module, "HOLDING", 2)
    nets = [network(spark, [(0, 1), (1, 2)], 4 + k) for k in range(4)]
    frames = [net.held() for net in nets]
    assert len(module._holding) == 2 and not frames[0].vertices.is_cached and frames[3].vertices.is_cached
    assert [stats(net, "edges")["edges"] for net in nets] == [2.0] * 4
    for net in nets:
        net.release()


GRAPHML = """<?xml version="1.0" encoding="UTF-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
  <key id="n0" for="node" attr.name="name" attr.type="string"/>
  <key id="n1" for="node" attr.name="wealth" attr.type="double"><default>1.5</default></key>
  <key id="e0" for="edge" attr.name="na" attr.type="boolean"/>
  <graph id="G" edgedefault="undirected">
    <node id="a"><data key="n0">Ann</data><data key="n1">3</data></node>
    <node id="b"><data key="n0">Bob &amp; co</data></node>
    <node id="c"/>
    <edge source="a" target="b"/>
    <edge source="c" target="b"><data key="e0">true</data></edge>
  </graph>
</graphml>
"""


def test_networks_from_files(spark, tmp_path):
    from netloom.sources import files

    path = tmp_path / "x.graphml"
    path.write_text(GRAPHML)
    net = files.read_graphml(spark, str(path))
    assert not net.directed and {r["key"]: (r["name"], r["wealth"]) for r in net.vertices.collect()} == {"a": ("Ann", 3.0), "b": ("Bob & co", 1.5), "c": (None, 1.5)}
    assert stats(net, "edges+nodecov('wealth')") == {"edges": 1.0, "nodecov.wealth": 4.5} and net.missing_dyads().count() == 1
    (tmp_path / "t.csv").write_text("from,to\n1,2\n2,3\n3,1\n")
    (tmp_path / "v.csv").write_text("id,g\n1,x\n2,x\n3,y\n4,y\n")
    net = files.read_tables(spark, str(tmp_path / "t.csv"), str(tmp_path / "v.csv"), src="from", dst="to", key="id", directed=True)
    assert stats(net, "edges+ctriple+nodematch('g')") == {"edges": 3.0, "ctriple": 1.0, "nodematch.g": 1.0}
    files.write_tables(net, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "edges")).count() == 3


def test_a_term_of_ones_own(spark):
    from pyspark.sql import functions as F

    from netloom.operators import terms

    def make(ctx, name, attr):
        return [terms.dyadic(f"{name}.{attr}", terms.s(attr) * terms.d(attr), attr)]

    terms.register_term("productof", make)
    try:
        net = network(spark, [(0, 1), (1, 2), (2, 4)], 5)
        assert stats(net, "productof('x')")["productof.x"] == 0 * 1 + 1 * 4 + 4 * (16 % 7)
        with pytest.raises(FormulaError):
            terms.register_term("edges", make)
    finally:
        del terms.TERMS["productof"]
    assert F is not None


def test_bridge_log_likelihood_is_that_of_enumeration(spark):
    from netloom.plans.ergm import bridge_loglik, ergm

    n, ties = 4, [(0, 1), (1, 2), (0, 2)]
    net = network(spark, ties, n)
    pairs = list(itertools.combinations(range(n), 2))

    def count(edges):
        e = set(edges)
        return np.array([len(e), sum({(a, b), (a, c), (b, c)} <= e for a, b, c in itertools.combinations(range(n), 3))], float)

    every = np.array([count([p for k, p in enumerate(pairs) if bits >> k & 1]) for bits in range(1 << len(pairs))])
    theta = np.array([-0.5, 0.6])
    want = float(count(ties) @ theta - np.log(np.exp(every @ theta).sum()))
    got = bridge_loglik(net, "edges+triangle", theta, bridges=4, nsim=400, burnin=500, interval=30)
    assert abs(got - want) < 0.15
    exact = ergm(net, "edges+nodecov('x')")
    assert exact.exact and exact.dyads == 6


def test_goodness_of_fit_of_draws(spark):
    from netloom.plans.ergm import gof as check

    net = network(spark, [(0, 1), (1, 2), (2, 3), (4, 5)], 7)
    got = check(net, "edges", [-1.4], 40, burnin=300, interval=60, chains=2).toPandas()
    assert set(got.statistic) == {"degree", "espartners", "distance", "model"} and got.p.between(0, 1).all()
    edges = got[got.statistic == "model"].iloc[0]
    assert edges.obs == 4 and abs(edges["mean"] - 21 / (1 + math.exp(1.4))) < 1.5 and edges.p > 0.1
    assert abs(got[got.statistic == "degree"].obs.sum() - 7) < 1e-9 and abs(got[got.statistic == "degree"]["mean"].sum() - 7) < 1e-9


def test_constrained_chains_keep_what_they_must(spark):
    from netloom.plans.sampling import simulate

    n, ties = 6, [(0, 1), (1, 2), (0, 2), (3, 4), (2, 5)]
    net = network(spark, ties, n)
    pairs = list(itertools.combinations(range(n), 2))

    def degrees(edges):
        return tuple(sum(v in e for e in edges) for v in range(n))

    def triangles(edges):
        e = set(edges)
        return sum({(a, b), (a, c), (b, c)} <= e for a, b, c in itertools.combinations(range(n), 3))

    def draws(constraints, **more):
        got = simulate(net, "edges+triangle", [0.0, 0.7], 400, burnin=300, interval=40, chains=4, ties=True, constraints=constraints, **more).toPandas()
        return [[(int(i), int(j)) for i, j in zip(g.src, g.dst)] for _, g in got.groupby("sim")]

    same = [list(c) for c in itertools.combinations(pairs, len(ties))]
    for constraints, keeps in (("~edges", lambda e: True), ("~degrees", lambda e: degrees(e) == degrees(ties))):
        got = draws(constraints)
        assert all(len(e) == len(ties) and keeps(e) for e in got)
        t = np.array([triangles(e) for e in same if keeps(e)])
        want = (t * np.exp(0.7 * t)).sum() / np.exp(0.7 * t).sum()
        assert abs(np.mean([triangles(e) for e in got]) - want) < 0.12, constraints
    assert all(max(degrees(e)) <= 2 for e in draws("~bd(maxout=2)")[50:])
    assert all(((i % 2) == (j % 2)) or (i, j) in ties for e in draws("~blockdiag('g')") for i, j in e)
