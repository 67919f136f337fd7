"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's fingerprint has a bit set where over half of its shingles' XXH64 have it. Distinct fingerprints only are
compared: copies meet in one row. Fingerprints are dealt by the value of some of their bit blocks: two that differ in
at most `radius` bits agree in all blocks but `radius`, so each such pair meets in some group, whatever the number of
fingerprints; with more of them, more and finer block sets keep the groups small. A block set and its value are the topmost node of a
hierarchy, the mask and the value of bits that the group shares; below it the group's fingerprints are sorted by Gray
rank and stand as the leaves of a tree whose nodes hold the mask and the value of the bits that all their leaves share.
Groups of any size go through their trees, many at a time; two nodes are set against each other from the top down, and a pair whose shared masked bits already
differ in more than `radius` places is dropped with everything below it. So is a pair whose leaves are all linked
already, so that a group of near copies gives a tree of links and not all pairs. Groups above `CROWD` fingerprints
take another exact way: every fingerprint names all points within half the radius, and those that name one point are
linked to the smallest that names it, which Spark combines before it shuffles.

Wide fingerprints (`wide`, `wide_links`) are for radii at which 64 bits tell nothing: WIDE words of 64 bits, of which two
sets of similarity 0.8 differ in about 39 of 256 and unrelated ones in 128. No block set of a useful size catches every pair within
such a radius, so these are filed by each of FILES blocks of six bits, and a file with many fingerprints is dealt further by as many
draws of bits as a pair at the radius needs; the Gray-order hierarchy joins every group that comes of it.

Components come from contracting the links round by round in the cluster; nothing is collected. Nulls and empty texts
have fingerprint zero and are linked like any other; repeated rows share a fingerprint; an empty table gives no rows;
extra columns are ignored. component_id is the smallest doc_id that links reach.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, RADIUS, SEED = 4, 4, 42
#: Groups up to this size are joined in one task.
CROWD = 200_000
#: Children of a node of the hierarchy, leaves and nodes.
LEAVES, FAN = 8, 4
#: Wide fingerprints: words of 64 bits, and the blocks of BLOCK bits by which they are filed, a whole number of them in each word.
WIDE, FILES, BLOCK = 4, 40, 6
WIDE_RADIUS = 68
#: Rows of a file that one task takes, and rows that go through a forest together.
WIDE_CROWD, SPAN = 1 << 17, 1 << 15
_turns = np.random.default_rng(SEED).integers(0, 1 << 63, WIDE * 8, np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space is 20 and 09-0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    last = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, last.tolist())], "<u8")
    count = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""

    def make(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return common.plain(df, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(make, "doc_id long, fp long")


def wide(hashes: np.ndarray) -> np.ndarray:
    """WIDE words of a set of 64-bit hashes: each hash votes on each bit with a weight between -128 and 127 of its own.

    Weights instead of single bits leave no ties, so that sets of few shingles differ in no more bits than large ones.
    """
    votes = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096, None] * _turns[None, :]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        votes += x.view(np.int8).sum(axis=0, dtype=np.int32)
    return np.packbits(votes > 0, bitorder="little").view("<u8")


def differing(x: np.ndarray) -> np.ndarray:
    """How many bits are set in each row of words."""
    many = np.bitwise_count(x)
    if x.ndim == 1:
        return many
    total = many[:, 0].astype(np.uint16)
    for k in range(1, x.shape[1]):
        total += many[:, k]
    return total


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each number in the reflected Gray order: the running parity of its bits from the top."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def gray_order(fps: np.ndarray) -> np.ndarray:
    """The order of rows of several words, the last column the highest, in the reflected Gray order."""
    ranks, odd = [], np.zeros(len(fps), np.uint64)
    for k in range(fps.shape[1] - 1, -1, -1):
        ranks.append(gray_rank(fps[:, k]) ^ odd)
        odd = np.uint64(0) - (ranks[-1] & np.uint64(1))  # the parity so far turns all bits below
    return np.lexsort(ranks[::-1])


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Link a to b in `parent`, which leads every place to the least one of its component."""

    def root(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if np.array_equal(up, x):
                return x
            x = up

    while len(a):
        a, b = root(a), root(b)
        apart = a != b
        a, b = a[apart], b[apart]
        if len(a):
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    parent[:] = root(parent)


class Forest:
    """Groups of fingerprints, each Gray-sorted under a tree whose nodes hold what bits all leaves below share.

    All trees are built level by level together, so that many small groups cost no more than one large group of that
    size; every group goes through its tree, however small. `tally` counts node pairs seen, those dropped by the shared
    bits or since their leaves are linked already, and pairs of fingerprints that were compared.
    """

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        """Rows of one word each in any order, or of several words that stand by group and in Gray order already."""
        order = np.lexsort((gray_rank(fps), group)) if fps.ndim == 1 else np.arange(len(fps))
        self.order, self.fps = order, fps[order]
        group = group[order]
        self.levels = [(self.fps, self.fps)]  # bits set in all leaves below, in any of them
        self.child: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]  # first child and how many
        self.leaf = [(np.arange(len(fps)), np.ones(len(fps), np.int64))]  # first leaf and how many
        self.group = [group]
        while len(group) > 1 and (group[1:] == group[:-1]).any():
            width = LEAVES if len(self.levels) == 1 else FAN
            edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            inside = np.arange(len(group)) - np.repeat(edge, np.diff(np.concatenate((edge, [len(group)]))))
            at = np.flatnonzero(inside % width == 0)
            many = np.diff(np.concatenate((at, [len(group)])))
            low, high = self.levels[-1]
            self.levels.append((np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)))
            self.child.append((at, many))
            first, count = self.leaf[-1]
            self.leaf.append((first[at], np.add.reduceat(count, at)))
            group = group[at]
            self.group.append(group)
        self.tally = {"seen": 0, "pruned": 0, "linked": 0, "compared": 0}

    def linked(self, radius: int) -> np.ndarray:
        """For each fingerprint in tree order the first one of its component by links of at most `radius` bits."""
        n = len(self.fps)
        parent = np.arange(n)

        def union(a: np.ndarray, b: np.ndarray) -> None:
            unite(parent, a, b)

        for step in (1, 2, 3, 5, 8):  # neighbours in the order first: most links of a cluster are there
            if step < n:
                near = np.flatnonzero((self.group[0][step:] == self.group[0][:-step]) & (differing(self.fps[step:] ^ self.fps[:-step]) <= radius))
                union(near, near + step)
        top = len(self.levels) - 1
        if not top:
            return parent
        roots = np.arange(len(self.levels[top][0]))
        roots = roots[self.leaf[top][1] > 1]
        stack = [(roots, roots, top)]
        while stack:
            a, b, level = stack.pop()
            if len(a) > 200_000:  # bounded memory: halves, one after the other
                half = len(a) // 2
                stack += [(a[half:], b[half:], level), (a[:half], b[:half], level)]
                continue
            low, high = self.levels[level]
            share = ~(low[a] ^ high[a]) & ~(low[b] ^ high[b])  # bits that are constant below both
            near = differing((low[a] ^ low[b]) & share) <= radius
            self.tally["compared" if level == 0 else "seen"] += len(a)
            self.tally["pruned"] += 0 if level == 0 else int(len(a) - near.sum())
            a, b = a[near], b[near]
            if level == 0:
                union(a, b)
                continue
            if level <= 3 and len(a):
                first = self.leaf[level][0]
                one, same = parent[first], np.minimum.reduceat(parent, first) == np.maximum.reduceat(parent, first)
                apart = ~(same[a] & same[b] & (one[a] == one[b]))
                self.tally["linked"] += int(len(a) - apart.sum())
                a, b = a[apart], b[apart]
            if not len(a):
                continue
            first, many = self.child[level]
            width = int(many[a].max()), int(many[b].max())
            x = (first[a][:, None] + np.arange(width[0])[None, :])[:, :, None]
            y = (first[b][:, None] + np.arange(width[1])[None, :])[:, None, :]
            fit = (x < (first[a] + many[a])[:, None, None]) & (y < (first[b] + many[b])[:, None, None]) & ((x < y) if level == 1 else (x <= y))
            x, y = np.broadcast_to(x, fit.shape)[fit], np.broadcast_to(y, fit.shape)[fit]
            stack.append((x, y, level - 1))
        return parent


def block_sets(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of bits: two fingerprints within `radius` agree on at least one of them. More fingerprints, more blocks and longer keys: about n / 2^bits meet by chance."""
    blocks = radius + 1
    while blocks < radius + 4 and n > 64 << (64 * (blocks - radius) // blocks):
        blocks += 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in itertools.combinations(parts, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, n: int, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(a, b): links that join every two of the distinct fingerprints `fps` (fp) within `radius` bits, directly or through others."""
    masks = [signed(m) for m in block_sets(n, radius)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("set", "bits"))
    sizes = keyed.groupBy("set", "bits").agg(F.count("*").alias("n")).where(f"n > {crowd}")
    crowded = common.keep(sizes.select("set", "bits"), "crowded")
    some = crowded.limit(1).count() > 0
    calm = keyed.join(crowded, ["set", "bits"], "left_anti") if some else keyed

    def join(batches):
        set_of = bits = fps_left = None
        for batch in batches:
            s, k, f = (batch.column(c).to_numpy() for c in ("set", "bits", "fp"))
            if set_of is not None:
                s, k, f = np.concatenate((set_of, s)), np.concatenate((bits, k)), np.concatenate((fps_left, f))
            cut = np.flatnonzero((s[1:] != s[:-1]) | (k[1:] != k[:-1])) + 1
            last = int(cut[-1]) if len(cut) else 0  # the last group may go on in the next batch
            set_of, bits, fps_left = s[last:], k[last:], f[last:]
            yield from pairs(f[:last], cut[:-1] if len(cut) else cut)
        if fps_left is not None:
            yield from pairs(fps_left, np.array([], np.int64))

    def pairs(f, cuts):
        if not len(f):
            return
        a, b = grouped(f.view(np.uint64), cuts, radius)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    found = calm.repartition("set", "bits").sortWithinPartitions("set", "bits", "fp").mapInArrow(join, "a long, b long")
    if some:
        found = found.unionByName(balls(keyed.join(crowded, ["set", "bits"], "left_semi").select("fp").distinct(), radius))
    return found.distinct()


def grouped(f: np.ndarray, cuts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each of the groups into which `cuts` part `f`, all through one forest."""
    edges = np.concatenate(([0], cuts, [len(f)]))
    sizes = np.diff(edges)
    group = np.repeat(np.arange(len(sizes)), sizes)
    several = sizes[group] > 1
    forest = Forest(f[several], group[several])
    first = forest.linked(radius)
    moved = np.flatnonzero(first != np.arange(len(first)))
    return forest.fps[first[moved]], forest.fps[moved]


def balls(fps: DataFrame, radius: int) -> DataFrame:
    """The exact way for crowds: two fingerprints within `radius` both lie within half of it of some point."""
    half = (radius + 1) // 2
    flips = [signed(sum(1 << i for i in c)) for r in range(half + 1) for c in itertools.combinations(range(64), r)]

    def around(batches):
        flip = np.array(flips, np.int64)
        for batch in batches:
            f = batch.column("fp").to_numpy()
            for at in range(0, len(f), 200):
                part = f[at : at + 200]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, len(flip))), pa.array((part[:, None] ^ flip[None, :]).ravel())], names=["fp", "point"])

    named = common.keep(fps.mapInArrow(around, "fp long, point long"), "points")
    least = common.keep(named.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a"), "least")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return named.join(least, "point").select("a", F.col("fp").alias("b")).where("a != b").where(near if radius % 2 == 0 else F.lit(True))


def draws(size: int) -> np.ndarray:
    """Places of bits, one row for each draw, by which a file of `size` fingerprints is dealt into groups of about eight.

    The bits are counted from the file's own block on, so that a row means other bits in each file. A pair that differs in
    58 of 256 bits, 3.3 deviations above what similarity 0.8 makes, meets in eight groups on average.
    """
    k = min(max(0, int(size - 1).bit_length() - 3), 20) if size > 64 else 0
    many = int(np.ceil(8 / (FILES * (198 / 256) ** (BLOCK + k)))) if k else 1
    rng = np.random.default_rng([SEED, k])
    return np.array([rng.choice(FILES * BLOCK - BLOCK, k, replace=False) + BLOCK for _ in range(many)], np.int64).reshape(many, k)


def wide_joined(fps: np.ndarray, file: np.ndarray, start: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places of two rows) inside each file of wide fingerprints: `file` names each row's, `start` its block."""
    order = gray_order(fps)
    fps, (_, own, sizes) = fps[order], np.unique(file[order], return_inverse=True, return_counts=True)
    start, parent = start[order], np.arange(len(fps))
    depth = np.array([int(n - 1).bit_length() if n > 64 else 0 for n in sizes], np.int64)[own]
    for d in np.unique(depth):
        rows = np.flatnonzero(depth == d)
        places = draws(1 << int(d))
        planes = np.zeros((0, len(rows)), np.uint8)
        if d:
            bits = np.unpackbits(fps[rows].view(np.uint8).reshape(len(rows), WIDE, 8), axis=2, bitorder="little")[:, :, : FILES // WIDE * BLOCK].reshape(len(rows), -1)
            for k in np.unique(start[rows]):
                here = start[rows] == k
                bits[here] = np.roll(bits[here], -BLOCK * int(k), axis=1)
            planes = np.ascontiguousarray(bits.T)
        for draw in places:
            key = own[rows].astype(np.int64)
            for at in draw:
                key = (key << 1) | planes[at]
            key = (key << 20) | np.arange(len(rows))
            key.sort()
            group = key >> 20
            same = np.flatnonzero(group[1:] == group[:-1])
            several = np.zeros(len(rows), bool)
            several[same] = several[same + 1] = True
            met = rows[key[several] & ((1 << 20) - 1)]
            first = Forest(fps[met], group[several]).linked(radius)
            moved = np.flatnonzero(first != np.arange(len(first)))
            unite(parent, met[first[moved]], met[moved])
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    return order[parent[moved]], order[moved]


def wide_links(nodes: DataFrame, radius: int = WIDE_RADIUS, crowd: int = WIDE_CROWD) -> DataFrame:
    """(a, b): links between the `nodes` (node, f0, f1, ...: their wide fingerprints) that join what is within `radius` bits."""
    words = [f"f{k}" for k in range(WIDE)]
    per = FILES // WIDE
    blocks = [F.shiftright(words[k // per], BLOCK * (k % per)).bitwiseAND(F.lit((1 << BLOCK) - 1)) for k in range(FILES)]
    keyed = nodes.select("node", *words, F.posexplode(F.array(*blocks)).alias("set", "bits"))
    keyed = keyed.select((F.col("set") * F.lit(1 << BLOCK) + F.col("bits")).cast("int").alias("file"), "node", *words)
    sizes = keyed.groupBy("file").agg(F.count("*").alias("n")).where(f"n > {crowd}").collect()  # one row for each of 2560 files at most
    if sizes:  # blocks of such a file, every two of which meet in a task
        many = nodes.sparkSession.createDataFrame([(r["file"], -(-2 * r["n"] // crowd)) for r in sizes], "file int, blocks int")
        keyed = keyed.join(F.broadcast(many), "file", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        keyed = keyed.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keyed = keyed.where("blocks = 1 or side != other").select("file", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "node", *words)
    else:
        keyed = keyed.select("file", F.lit(0).alias("x"), F.lit(0).alias("y"), "node", *words)

    def join(batches):
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            table = np.stack([batch.column(k).to_numpy().astype(np.int64, copy=False) for k in range(batch.num_columns)], axis=1)
            if not len(table):
                continue
            name = table[:, :3]
            cut = np.flatnonzero((name[1:] != name[:-1]).any(axis=1)) + 1
            if held and (name[0] != held[-1][-1, :3]).any():
                cut = np.concatenate(([0], cut))
            held.append(table)
            rows += len(table)
            if rows >= SPAN and len(cut):  # the last file may go on in the next batch
                held[-1] = table[: cut[-1]]
                yield from pairs(np.concatenate(held))
                held = [table[cut[-1] :]]
                rows = len(held[0])
        if held:
            yield from pairs(np.concatenate(held))

    def pairs(table):
        name = table[:, :3]
        file = np.concatenate(([0], np.cumsum((name[1:] != name[:-1]).any(axis=1))))
        a, b = wide_joined(np.ascontiguousarray(table[:, 4:]).view(np.uint64), file, table[:, 0] >> BLOCK, radius)
        yield pa.RecordBatch.from_arrays([pa.array(table[a, 3]), pa.array(table[b, 3])], names=["a", "b"])

    return keyed.repartition("file", "x", "y").sortWithinPartitions("file", "x", "y", "node").mapInArrow(common.frugal(join), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node that links reach.

    Each round every node points to the smallest of itself and its neighbours, pointers are followed to their end, and the
    links between different ends go into the next round. A round at least halves the nodes that still have links.
    """
    spark = edges.sparkSession
    rounds = []
    edges = common.keep(edges.where("a != b"), "links")
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = common.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "points")
        while True:  # follow pointers, each time twice as far
            up = point.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            point, moved = (q := common.keep(point.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"), (F.coalesce("_up", "root") != F.col("root")).alias("_moved")), "points")).drop("_moved"), q.where("_moved").limit(1).count()
            if not moved:
                break
        rounds.append(point)
        ends = edges.join(point.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(point.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = common.keep(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a != b").distinct(), "links")
    if not rounds:
        return spark.createDataFrame([], "node long, root long")
    out = rounds[0]
    for later in rounds[1:]:
        out = out.join(later.select(F.col("node").alias("root"), F.col("root").alias("_up")), "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
    return out


def near_duplicates(df: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    made = common.keep(fingerprints(df, words), "fingerprints")
    distinct = common.keep(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    n = distinct.count()
    joined = components(links(distinct.select("fp"), n, radius))
    # the component's id: the least doc_id over its fingerprints
    member = common.keep(distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "members")
    ids = common.keep(member.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    labels = common.keep(member.join(ids, "root").select("fp", "component_id"), "labels")
    return made.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
