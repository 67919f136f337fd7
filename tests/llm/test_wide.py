"""Wide SimHash fingerprints, which name the candidates of the pipeline's near duplicates."""

import numpy as np
import pytest

from netloom.llm import near, simhash

from .test_near import copies


def test_sets_of_similarity_point_eight_are_within_the_radius():
    rng = np.random.default_rng(4)
    for both, a, b in [(4, 0, 1), (8, 1, 1), (8, 0, 2), (80, 10, 10), (400, 0, 100)]:
        many = []
        for _ in range(300):
            h = rng.integers(0, 1 << 63, both + a + b, np.uint64)
            many.append(int(simhash.differing(simhash.wide(h[: both + a])[None] ^ simhash.wide(np.concatenate((h[:both], h[both + a :])))[None])[0]))
        assert 35 < np.mean(many) < 43 and max(many) <= simhash.WIDE_RADIUS
    apart = [simhash.wide(rng.integers(0, 1 << 63, 50, np.uint64)) for _ in range(300)]
    assert simhash.differing(np.stack(apart[1:]) ^ np.stack(apart[:-1])).min() > simhash.WIDE_RADIUS


@pytest.mark.parametrize("size", [60, 300, 5000])
def test_files_and_draws_meet_near_pairs(size):
    """Pairs with 39 to 58 other bits among so many unrelated fingerprints in each file."""
    rng = np.random.default_rng(size)
    n = 200
    f = rng.integers(0, 1 << 63, (n, 4), np.uint64) * np.uint64(2) + rng.integers(0, 2, (n, 4), np.uint64)
    g = f.copy()
    for k in range(n):
        for bit in rng.choice(256, (39, 48, 58)[k % 3], replace=False):
            g[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    noise = rng.integers(0, 1 << 63, (size, 4), np.uint64)
    every = np.concatenate((f, g, noise))
    parent = np.arange(len(every))
    for k in range(simhash.FILES):
        shift = np.uint64(simhash.BLOCK * (k % 10))
        block = (every[:, k // 10] >> shift) & np.uint64(63)
        rows = np.flatnonzero(np.isin(np.arange(len(every)), np.flatnonzero(block[:n] == block[n : 2 * n])) | (np.arange(len(every)) >= 2 * n))
        rows = np.unique(np.concatenate((rows, rows[rows < n] + n)))
        for at in (rows >= 2 * n, np.ones(len(rows), bool)):  # unrelated ones have no links
            some = rows[at]
            a, b = simhash.wide_joined(every[some], np.zeros(len(some), np.int64), np.full(len(some), k), simhash.WIDE_RADIUS)
            simhash.unite(parent, some[a], some[b])
    linked = parent[:n] == parent[n : 2 * n]
    assert linked.mean() >= 0.99 and linked[::3].all() and (parent[2 * n :] == np.arange(2 * n, len(every))).all()


def test_gray_order_of_several_words():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 4, (200, 2), np.uint64)
    whole = [(int(x[1]) << 64) | int(x[0]) for x in f]

    def rank(x):
        out = x
        while x := x >> 1:
            out ^= x
        return out

    assert [rank(whole[k]) for k in simhash.gray_order(f)] == sorted(map(rank, whole))


@pytest.mark.parametrize("crowd", [simhash.WIDE_CROWD, 8])
def test_links_join_what_brute_force_finds(spark, crowd):
    sets = {tuple(s): s for s in map(near.shingles, (t or "" for t in copies())) if len(s)}
    f = np.stack([simhash.wide(s) for s in sets.values()])
    rows = [(k, *map(int, x.view(np.int64))) for k, x in enumerate(f)]
    made = spark.createDataFrame(rows, "node long, " + ", ".join(f"f{k} long" for k in range(simhash.WIDE)))
    found = [(r["a"], r["b"]) for r in simhash.wide_links(made, crowd=crowd).collect()]
    parent, want = np.arange(len(f)), np.arange(len(f))
    if found:
        simhash.unite(parent, *np.array(found).T)
    close = np.array([(i, j) for i in range(len(f)) for j in range(i) if simhash.differing((f[i] ^ f[j])[None])[0] <= simhash.WIDE_RADIUS])
    simhash.unite(want, *close.T)
    assert parent.tolist() == want.tolist() and len(np.unique(want)) < len(f) / 2


def test_candidates_are_those_of_simhash(spark, monkeypatch):
    """Without the links of the hierarchy only equal sets meet: no other index stands beside it."""
    monkeypatch.setattr(simhash, "wide_links", lambda nodes, *_: nodes.selectExpr("node AS a", "node AS b").limit(0))
    text = " ".join(f"w{k}" for k in range(60))
    rows = spark.createDataFrame([(0, text), (1, text + " more"), (2, text.upper())], "rid long, text string")
    assert {r["rid"]: r["component"] for r in near.components(rows).collect()} == {0: 0, 1: 1, 2: 0}
