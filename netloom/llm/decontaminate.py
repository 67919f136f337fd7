"""Benchmark decontamination by SimHash of item-sized windows.

Texts and items are words (A-Z lower-cased, ASCII punctuation and white space between them) and their shingles of
SHINGLE words, weighted by how often they stand; an item of fewer words is one shingle of its own length, looked for at
every place of a text. A window has as many words as the item it is held against (a shorter document is one window).
Windows without any shingle of an item of that length can't be alike and are not hashed; every other one gets a SimHash
from running sums of its shingles' bits. Items are filed by length under the blocks of their own SimHash: with BLOCKS
blocks, a fingerprint within RADIUS bits differs in at most RADIUS // BLOCKS bits of some block, so the lists of all near
block values hold every item within the radius, and they alone name the candidates. Those within the radius are verified
by the exact weighted Jaccard similarity of their shingles.

The items go to every task in blocks of at most ITEMS, one pass over the documents each; of several blocks the driver
holds one at a time, and what a pass finds is written before the next. Null and empty texts match nothing, nor do items
without words. Rows are judged one by one, repeated ones too. Empty tables give no rows. Extra columns are ignored, or
kept by clean().
"""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .suffixes import Hasher, _mix

SHINGLE, LIKE = 5, 0.8
RADIUS, BLOCKS = 24, 8
ITEMS = 20_000
#: Characters of a piece of input at most.
PIECE = 1 << 18
#: Pairs of windows and items that are looked at together, at most.
PAIRS = 1 << 20
_TABLE = bytes(ord(chr(b).lower()) if chr(b) in string.ascii_letters + string.digits else b if b >= 128 else 32 for b in range(256))
_hasher = Hasher()


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def hashed(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes of all texts in a row, number of shingles of each text, number of words of each text)."""
    parts = [words(t) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    counts = np.where(sizes > 0, np.maximum(1, sizes - k + 1), 0)
    data = np.frombuffer(b" ".join(w for p in parts for w in p), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), counts, sizes
    _hasher.grow(len(data) + 1)
    sums = _hasher.sums(data, 0)
    breaks = np.flatnonzero(data == 32)
    begin, end = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(data)]))
    first = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(texts)), counts)
    at = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    last = at + np.minimum(k, sizes[own]) - 1
    a, b = begin[at], end[last]
    return _mix((sums[b] - sums[a]) * _hasher.inverse[0][a]), counts, sizes


def bits(hashes: np.ndarray) -> np.ndarray:
    """+1 and -1 for the bits of each hash."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def simhash(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two shingle multisets."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both)


@dataclass
class Benchmark:
    """Items whose shingles have `words` words, filed by length under the blocks of their SimHash."""

    ids: list
    shingles: list[np.ndarray]
    sizes: np.ndarray  # words of each item
    words: int = SHINGLE

    def __post_init__(self):
        self.fps = np.concatenate([simhash(bits(s).sum(axis=0, keepdims=True)) for s in self.shingles]) if self.ids else np.zeros(0, np.uint64)
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= RADIUS // BLOCKS
        self.filed: dict[int, tuple] = {}  # items, their different shingles, and for each block where a value's items begin and which they are
        for size in np.unique(self.sizes).tolist():
            items = np.flatnonzero(self.sizes == size)
            values = self.fps[items].view(np.uint8).reshape(-1, BLOCKS)
            lists = []
            for k in range(BLOCKS):
                value, place = np.nonzero(near[:, values[:, k]])
                lists.append((np.searchsorted(value, np.arange(257)), place))
            self.filed[size] = items, np.unique(np.concatenate([self.shingles[i] for i in items])), lists
        self.distinct = np.unique(np.concatenate(self.shingles)) if self.ids else np.zeros(0, np.uint64)
        self.tally = Counter()

    def near(self, fps: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, item) pairs within RADIUS bits, among the items of `size` words: named by the blocks, then counted."""
        items, _, lists = self.filed[size]
        values = fps.view(np.uint8).reshape(-1, BLOCKS)
        named = []
        for k, (begin, place) in enumerate(lists):
            first = begin[values[:, k]]
            many = begin[values[:, k].astype(np.int64) + 1] - first
            own = np.repeat(np.arange(len(fps)), many)
            at = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + first[own]
            named.append(own * len(items) + place[at])
        pairs = np.unique(np.concatenate(named))
        x, y = pairs // len(items), items[pairs % len(items)]
        close = np.bitwise_count(fps[x] ^ self.fps[y]) <= RADIUS
        self.tally.update(windows=len(fps), named=len(pairs), near=int(close.sum()), pairs=len(fps) * len(items))
        return x[close], y[close]

    def search(self, h: np.ndarray, n_words: int, like: float = LIKE) -> list[tuple[int, float, int]]:
        """(item, similarity, first word) of the best window for each item that a document with shingle hashes `h` holds."""
        out = []
        for size, (items, own, _) in self.filed.items():
            where = np.searchsorted(own, h)
            where[where == len(own)] = 0
            hits = np.flatnonzero(own[where] == h)
            if not len(hits):
                continue
            width = max(1, min(size, n_words) - self.words + 1)  # shingles of a window
            last = len(h) - width
            mark = np.zeros(len(h) + 1, np.int64)  # windows that hold a shared shingle
            np.add.at(mark, np.maximum(hits - width + 1, 0), 1)
            np.add.at(mark, np.minimum(hits + 1, last + 1), -1)
            starts = np.flatnonzero(np.cumsum(mark[: last + 1]) > 0)
            best: dict[int, tuple[float, int]] = {}
            step = max(1, min(4096, PAIRS // (BLOCKS * len(items))))
            for at in range(0, len(starts), step):
                part = starts[at : at + step]
                held = np.unique((part[:, None] + np.array([0, width])[None, :]).ravel()) if part[-1] - part[0] > 8 * (len(part) + width) else None
                a, b = part[0], part[-1] + width
                if held is None:
                    run = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits(h[a:b]), axis=0, dtype=np.int32)))
                    sums = run[part - a + width] - run[part - a]
                else:  # far between: each by itself
                    sums = np.concatenate([bits(h[k : k + width]).sum(axis=0, keepdims=True) for k in part.tolist()])
                for x, y in zip(*(z.tolist() for z in self.near(simhash(sums), size))):
                    start = int(part[x])
                    if best.get(y, (0.0, 0))[0] == 1.0:
                        continue
                    alike = similarity(h[start : start + width], self.shingles[y])
                    self.tally["verified"] += 1
                    if alike >= like and alike > best.get(y, (0.0, 0))[0]:
                        best[y] = (alike, start)
            out.extend((item, *found) for item, found in best.items())
        return out


def made(got: list) -> list[Benchmark]:
    """Rows of item_id and text as benchmarks, one for each length of shingles."""
    _, _, sizes = hashed([r["text"] for r in got])
    out = []
    for k in sorted({min(SHINGLE, n) for n in sizes.tolist()} - {0}):
        some = [r for r, n in zip(got, sizes.tolist()) if min(SHINGLE, n) == k]
        h, counts, own = hashed([r["text"] for r in some], k)
        out.append(Benchmark([r["item_id"] for r in some], np.split(h, np.cumsum(counts)[:-1]), own, k))
    return out


def blocks(benchmark: DataFrame):
    """How many blocks of at most about ITEMS items there are, and the blocks one after the other."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    n = -(-rows.count() // ITEMS)

    def each():
        for k in range(n):
            part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
            yield made(part.orderBy("item_id", "text").collect())

    return n, each()


def _found(block: list[Benchmark], texts: list[str]):
    """For each text what it holds, (benchmark, item, similarity, start), a piece of input at a time."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < PIECE or end == at):
            size += len(texts[end])
            end += 1
        out: list[list] = [[] for _ in range(end - at)]
        for one in block:
            h, counts, sizes = hashed(texts[at:end], one.words)
            known = np.searchsorted(one.distinct, h)
            known[known == len(one.distinct)] = 0
            hit = one.distinct[known] == h
            edge = np.concatenate(([0], np.cumsum(counts)))
            some = np.concatenate(([0], np.cumsum(hit)))
            for k in range(end - at):
                a, b = edge[k], edge[k + 1]
                if some[b] > some[a]:
                    out[k] += [(one, *got) for got in one.search(h[a:b], int(sizes[k]))]
        yield from out
        at = end


def matches(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word: one row for each document and benchmark item that it holds."""
    kind = dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id long, item_id {kind}, similarity double, start_word long"
    arrow = benchmark.select("item_id").limit(0).toArrow().schema.field("item_id").type
    rows = common.plain(df, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    out = df.sparkSession.createDataFrame([], schema)
    n, some = blocks(benchmark)
    for block in some:

        def scan(batches, block=block):
            for batch in batches:
                got = [(doc, one.ids[i], alike, start) for doc, found in zip(batch.column("doc_id").to_pylist(), _found(block, batch.column("text").to_pylist())) for one, i, alike, start in found]
                columns = list(zip(*got)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), arrow, pa.float64(), pa.int64()))], names=["doc_id", "item_id", "similarity", "start_word"])

        found = rows.mapInArrow(scan, schema)
        out = out.unionByName(common.keep(found, "matches") if n > 1 else found)
    return out


def clean(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `df`, all columns, whose text holds no benchmark item."""
    common.small_batches(df.sparkSession)
    n, some = blocks(benchmark)
    for block in some:

        def keep(batches, block=block):
            for batch in batches:
                texts = [t or "" for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array([not found for found in _found(block, texts)], pa.bool_()))

        df = df.mapInArrow(keep, df.schema)
        df = common.keep(df, "clean") if n > 1 else df
    return df
