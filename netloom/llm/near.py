"""Near copies by shared five-word shingles: rows whose sets of shingles have a Jaccard similarity of LIKE or more.

Candidates come from SimHash and its Gray-order hierarchy (simhash.wide_links). 64 bits are too few here: at a radius that holds
nearly all pairs of similarity 0.8 (24 of 64) a few in a hundred of all pairs would be candidates. A set of shingles has 256 bits
instead, of which two sets of that similarity differ in 39 with a deviation of 5.8; the radius of 68 bits is 5 deviations
above, and unrelated sets lie 7 deviations beyond it. What is within the radius is
joined into loose groups, and only inside a loose group the shingle sets are set against each other, exactly:
rarest shingles first, each set names its candidates by the prefix that two sets of that similarity must share, and the
sizes of their intersections are counted. A pair that is linked already is passed over, so a cluster gives a tree of links.
A loose group above BLOCK bytes of text is cut into blocks, and every two blocks meet in a task: bounded memory, no pair
left out.

White space and letters are those of simhash.fingerprint, but a shingle counts once; a text of fewer words is one shingle, a null or empty one has none
and is a copy of other empty ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

WORDS = 5
#: Similarity from which two texts are near copies, as a fraction.
LIKE = (4, 5)
SEED = 42
#: Bytes of text of a loose group that one task takes from one side.
BLOCK = 16 << 20


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted different XXH64 of a text's shingles."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    last = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    starts = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last.tolist())], np.uint64))


def linked(sets: list[np.ndarray], like: tuple[int, int] = LIKE, side: np.ndarray | None = None) -> np.ndarray:
    """For each set (sorted, different numbers) the first one of its component; with `side`, only sets of different sides are compared."""
    n = np.array([len(s) for s in sets], np.int64)
    label = np.arange(len(sets))
    if not n.sum():
        return label
    doc = np.repeat(np.arange(len(sets)), n)
    _, inverse, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    token = rank[inverse]
    token = token[np.lexsort((token, doc))]  # the rarest first
    begin = np.cumsum(n) - n
    num, den = like
    prefix = n - -(-num * n // den) + 1
    first = np.arange(len(token)) - begin[doc] < prefix[doc]
    first &= np.sort(often)[token] > 1
    key, own = token[first], doc[first]
    order = np.lexsort((own, key))
    posts, keys = own[order], key[order]
    names = np.searchsorted(own, np.arange(len(sets) + 1))  # own is in the order of the sets
    low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
    flag = np.zeros(len(often), bool)
    for i in range(len(sets)):
        some = [posts[low[k] : high[k]] for k in range(names[i], names[i + 1])]
        if not some:
            continue
        near = np.unique(np.concatenate(some))
        near = near[(near < i) & (den * n[near] >= num * n[i]) & (den * n[i] >= num * n[near])]
        if side is not None:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        flag[token[begin[i] : begin[i] + n[i]]] = True
        most = max(1, (1 << 21) // int(n[near].max()))
        for at in range(0, len(near), most):
            part = near[at : at + most]
            part = part[label[part] != label[i]]
            if not len(part):
                continue
            upto = np.cumsum(n[part])
            places = np.arange(upto[-1]) + np.repeat(begin[part] - (upto - n[part]), n[part])
            both = np.add.reduceat(flag[token[places]].astype(np.int64), upto - n[part])
            hit = part[den * both >= num * (n[part] + n[i] - both)]
            if len(hit):
                met = np.unique(np.append(label[hit], label[i]))
                label[np.isin(label, met)] = met[0]
        flag[token[begin[i] : begin[i] + n[i]]] = False
    return label


def components(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(rid, component) of each of `rows` (rid, text; rid tells rows apart): component is the least rid that links reach."""

    prints = [f"f{k}" for k in range(simhash.WIDE)]

    def sketch(batches):
        for batch in batches:
            high, low, size, words = [], [], [], []
            for t in batch.column("text").to_pylist():
                some = shingles(t)
                digest = xxhash.xxh3_128_digest(some.tobytes())
                high.append(int.from_bytes(digest[:8], "little", signed=True))
                low.append(int.from_bytes(digest[8:], "little", signed=True))
                size.append(len(t))
                words.append(simhash.wide(some).view(np.int64).tolist() if len(some) else [None] * simhash.WIDE)
            made = [pa.array(x, pa.int64()) for x in (high, low, size, *([w[k] for w in words] for k in range(simhash.WIDE)))]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), *made], names=["rid", "high", "low", "size", *prints])

    plain = common.plain(rows, "rid", "text")
    made = common.keep(plain.mapInArrow(common.frugal(sketch), ", ".join(f"{c} long" for c in ("rid", "high", "low", "size", *prints))), "sketches")
    least = common.keep(made.groupBy("high", "low").agg(F.min("rid").alias("node")), "sets")  # equal sets meet in one row
    alone = made.join(least.select(F.col("node").alias("rid")), "rid", "left_semi").where("f0 is not null")
    loose = common.keep(simhash.components(simhash.wide_links(alone.select(F.col("rid").alias("node"), *prints))), "loose")
    members = loose.join(made.select(F.col("rid").alias("node"), "size"), "node")
    blocks = members.groupBy("root").agg(F.ceil(F.sum("size") / F.lit(block)).cast("int").alias("blocks"))
    members = members.join(blocks, "root").select("root", F.col("node").alias("rid"), F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))).cast("int").alias("side"), "blocks")
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)))
    members = members.select("root", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "rid", "side")
    texts = plain.join(members, "rid").select("root", "x", "y", "rid", "side", "text")

    def join(batches):
        now, rids, sides, sets = None, [], [], []

        def links():
            if len(sets) > 1:
                label = linked(sets, LIKE, np.array(sides) if now[1] != now[2] else None)
                moved = np.flatnonzero(label != np.arange(len(sets)))
                ids = np.array(rids, np.int64)
                if len(moved):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[label[moved]]), pa.array(ids[moved])], names=["a", "b"])

        for batch in batches:
            for root, x, y, rid, side, text in zip(*(batch.column(c).to_pylist() for c in ("root", "x", "y", "rid", "side", "text"))):
                if (root, x, y) != now:
                    yield from links()
                    now, rids, sides, sets = (root, x, y), [], [], []
                rids.append(rid)
                sides.append(side)
                sets.append(shingles(text))
        yield from links()

    found = texts.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "rid").mapInArrow(common.frugal(join), "a long, b long")
    joined = simhash.components(found)
    named = least.join(joined, "node", "left").select("high", "low", F.coalesce("root", "node").alias("component"))
    return made.select("rid", "high", "low").join(named, ["high", "low"]).select("rid", "component")
