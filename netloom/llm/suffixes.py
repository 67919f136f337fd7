"""Suffix-array deduplication of repeated byte strings.

A window of LENGTH bytes is removed wherever it also starts earlier. Each window is filed under the smallest hash of the
GRAM-byte strings inside it, so equal windows come to one shard whatever their documents; neighbouring windows with one
hash travel as one segment, with a hash of the segment's bytes beside it. Segments that repeat as a whole are set against
the first of them byte by byte, and all others go; no byte is removed on the word of a hash. Different segments under one
hash overlap in part: they form a shard's text, whose suffix array comes from induced sorting (suffixes are classified,
leftmost-smaller substrings are sorted recursively, the rest is induced in two linear passes). The common prefix of each
suffix with the one that precedes it there is computed in text order, permuted: compared where the letters before the two
differ, and one less than its left neighbour's elsewhere. Where it reaches LENGTH, both hold one window, and all but the
window's first place go.

Before anything is shuffled, a task keeps only the first of the segments that repeat in the piece of text it has read, byte
by byte again, and reports the others as removed, so that a passage in a third of all documents arrives as a row for
each piece of input. Hashes with over CROWD different segments are filed anew under longer strings, and what still crowds
then window by window, dealt by the windows' own bytes; what is filed anew is dealt by content first and counted by hash
in parts, so that no hash, however crowded, comes to one task.

Documents are ordered by doc_id; rows of one doc_id by a hash of their texts. Nulls and empty texts have no bytes. Equal rows are
documents of their own: the later ones go like any copy. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH, GRAM = 100, 32
#: Grams of further filings, for hashes with too many different segments: what crowds under one mostly parts under the next.
FINER = (72, 92)
#: Different segments of one hash that are sorted together at most; bytes of a shard's text at most, and of a piece of input.
CROWD, SHARD, PIECE = 48, 24 << 20, 8 << 20
#: Bytes that are hashed together: arrays of that size stay in a core's cache.
BLOCK = 1 << 18
#: Windows of a segment at most, and of all segments under one hash that are sorted together.
LONG, MASS = 1 << 12, 1 << 13
SEGMENT = "v long, s long, rid long, start int, n int"
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Hashes that are known to every task at once, at most; more are met by a join.
KNOWN = 500_000


# --- suffix array -------------------------------------------------------------------------------------------------------


def suffix_arrays(s: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix arrays of the columns of `s` (length, strings), numbers below sigma, by induced sorting; the end sorts before
    every number. Zeros behind a shorter string act as its end. All strings go step by step together."""
    n, width = s.shape
    sa = np.zeros((n, width), np.int32)
    if n < 2:
        return sa
    column = np.arange(width)
    small = np.zeros((n, width), bool)  # S-type: smaller than the suffix behind it
    for j in range(n - 2, -1, -1):
        small[j] = (s[j] < s[j + 1]) | ((s[j] == s[j + 1]) & small[j + 1])
    lms = np.zeros((n, width), bool)
    lms[1:] = small[1:] & ~small[:-1]
    bucket = column * sigma  # buckets of all strings in one row
    counts = np.bincount((s + bucket[None, :]).ravel(), minlength=sigma * width).reshape(width, sigma)
    ends = np.cumsum(counts, axis=1)
    heads, ends = (ends - counts).ravel(), ends.ravel()
    text, kind, flat = s.ravel(), small.ravel(), sa.ravel()

    def induce(order: np.ndarray) -> None:
        """order: (k, strings), the leftmost-smaller places of each string sorted, -1 behind them."""
        flat.fill(-1)
        room = ends.copy()
        for r in range(len(order) - 1, -1, -1):
            at = np.flatnonzero(order[r] >= 0)
            j = order[r][at]
            q = bucket[at] + text[j * width + at]
            room[q] -= 1
            flat[room[q] * width + at] = j
        room = heads.copy()
        q = bucket + s[n - 1]
        flat[room[q] * width + column] = n - 1  # the suffix before the end comes first in its bucket
        room[q] += 1
        for i in range(n):
            at = np.flatnonzero(sa[i] > 0)
            k = sa[i][at] - 1
            where = k * width + at
            large = ~kind[where]
            at, k = at[large], k[large]
            q = bucket[at] + text[where[large]]
            p = room[q]
            flat[p * width + at] = k
            room[q] = p + 1
        room = ends.copy()
        for i in range(n - 1, -1, -1):
            at = np.flatnonzero(sa[i] > 0)
            k = sa[i][at] - 1
            where = k * width + at
            less = kind[where]
            at, k = at[less], k[less]
            q = bucket[at] + text[where[less]]
            p = room[q] - 1
            flat[p * width + at] = k
            room[q] = p

    def stacked(col: np.ndarray, value: np.ndarray, many: np.ndarray, fill: int) -> np.ndarray:
        """Values in order of their strings as columns, `fill` behind them."""
        out = np.full((int(many.max(initial=0)), width), fill, np.int32)
        first = np.cumsum(many) - many
        out[np.arange(len(col)) - first[col], col] = value
        return out

    col, place = np.nonzero(lms.T)
    many = np.bincount(col, minlength=width)
    if len(col):
        induce(stacked(col, place, many, -1))
        ranked = sa.T[lms.ravel()[(sa * width + column[None, :])].T]  # string by string, their places sorted by substring
        until = np.full(n * width, n + 1, np.int64)
        same_string = col[1:] == col[:-1]
        until[(place * width + col)[:-1][same_string]] = place[1:][same_string]
        x, y = ranked[:-1].astype(np.int64), ranked[1:].astype(np.int64)
        long = until[x * width + col[:-1]] - x
        alike = same_string & (long == until[y * width + col[1:]] - y) & (x + long <= n) & (y + long <= n)
        open_ = np.flatnonzero(alike)
        d = 0
        while len(open_):
            c = col[open_]
            equal = text[(x[open_] + d) * width + c] == text[(y[open_] + d) * width + c]
            alike[open_[~equal]] = False
            open_ = open_[equal & (d < long[open_])]
            d += 1
        name = np.concatenate(([0], np.cumsum(~alike)))
        first = np.cumsum(many) - many
        name = name - np.repeat(name[first[many > 0]], many[many > 0]) + 1
        named = np.zeros(n * width, np.int64)
        named[ranked.astype(np.int64) * width + col] = name
        short = named[place * width + col]
        tied = np.flatnonzero(np.bincount(col[1:][alike], minlength=width) > 0)
        order = stacked(col, ranked, many, -1)
        if len(tied):
            reduced = stacked(col, short, many, 0)[:, tied]
            places = stacked(col, place, many, -1)
            sub = suffix_arrays(reduced, int(reduced.max()) + 1)
            for r, c in enumerate(tied.tolist()):
                m = many[c]
                order[:m, c] = places[sub[len(reduced) - m :, r], c]
        induce(order)
    else:
        induce(np.zeros((0, width), np.int32))
    return sa


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted common prefixes of the columns of `s` (length, strings), given their suffix arrays: for each place the
    length that its suffix has in common with the suffix that precedes it in the array.

    Where the letters before two neighbours of the array are the same, their common prefix is one less than that of the
    place to the left; only the other, irreducible places are compared, 32 letters at a time.
    """
    n, width = s.shape
    text = np.full((width, n + 32), 1 << 15, np.uint16)  # no suffix goes on behind its string
    text[:, :n] = s.T
    flat = text.ravel()
    order = sa.T.astype(np.int64)
    before = np.full((width, n), -1, np.int64)  # in text order
    rows = np.arange(width)[:, None]
    before[rows, order[:, 1:]] = order[:, :-1]
    place = np.broadcast_to(np.arange(n), (width, n))
    known = before >= 0
    left = known & (before > 0) & (place > 0)
    base = rows * (n + 32)
    plain = left.copy()
    plain[left] = flat[(base + before - 1)[left]] == flat[(base + place - 1)[left]]
    long = np.zeros((width, n), np.int64)
    row, x = np.nonzero(known & ~plain)
    y, start, shared = before[row, x], row * (n + 32), np.zeros(len(row), np.int64)
    open_ = np.arange(len(row))
    step = np.arange(32)
    while len(open_):
        still = []
        for part in np.array_split(open_, -(-len(open_) // 100_000)):
            at = start[part] + shared[part]
            same = flat[(at + x[part])[:, None] + step] == flat[(at + y[part])[:, None] + step]
            more = np.where(same.all(axis=1), 32, same.argmin(axis=1))
            shared[part] += more
            still.append(part[more == 32])
        open_ = np.concatenate(still)
    long[row, x] = shared
    # the last irreducible place up to here, and how far it is
    last = np.maximum.accumulate(np.where(plain, 0, place), axis=1)
    return long[rows, last] - (place - last)


def repeated(groups: list[list[tuple[int, int, bytes]]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rid, start, n): windows of each group's segments (rid, start, bytes) that also stand at an earlier place of the same group."""
    sizes = [sum(len(b) + 1 for _, _, b in g) for g in groups]
    out = []
    at = 0
    order = np.argsort(sizes, kind="stable").tolist()
    while at < len(order):  # groups of about one size side by side
        end = at + 1
        while end < len(order) and end - at < 4096 and sizes[order[end]] <= 1.25 * sizes[order[at]] + 64 and (end - at + 1) * sizes[order[end]] <= 1 << 20:
            end += 1
        out.append(_repeated([groups[k] for k in order[at:end]], [sizes[k] for k in order[at:end]], length))
        at = end
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))


def _repeated(groups, sizes, length):
    segs = [x for g in groups for x in g]
    many = np.array([len(g) for g in groups])
    size = np.array([len(b) for _, _, b in segs])
    data = np.frombuffer(b"\0".join([b for _, _, b in segs]) + b"\0", np.uint8)
    edge = np.cumsum(size + 1) - (size + 1)
    own = np.repeat(np.arange(len(segs)), size + 1)
    inside = np.arange(len(data)) - edge[own]
    group = np.repeat(np.arange(len(groups)), many)[own]
    base = np.cumsum(sizes) - sizes
    n = max(sizes)
    s = np.zeros((n, len(groups)), np.int32)
    s[np.arange(len(data)) - base[group], group] = np.where(inside < size[own], data.astype(np.int32) + 1, 0)
    sa = suffix_arrays(s, 257)
    shared = common_prefixes(s, sa)
    sa = sa.T  # a row for each group
    real = sa < np.array(sizes)[:, None]
    flat = (sa + base[:, None])[real]
    reach = np.take_along_axis(shared, sa.astype(np.int64), axis=1)[real] >= length
    window = (inside + length <= size[own])[flat]
    flat, meets = flat[window], reach[window]  # windows, in the order of their groups' suffix arrays; between two equal ones stand equal ones only
    if not len(flat):
        return (np.zeros(0, np.int64),) * 3
    run = np.cumsum(~meets)
    rid, start = np.array([r for r, _, _ in segs], np.int64), np.array([a for _, a, _ in segs], np.int64)
    place = start[own[flat]] + inside[flat]
    o = np.lexsort((place, rid[own[flat]], run))
    late = np.zeros(len(o), bool)
    late[1:] = run[o][1:] == run[o][:-1]
    gone = np.sort(flat[o][late])
    return joined(rid[own[gone]], start[own[gone]] + inside[gone], own[gone])


def joined(rid: np.ndarray, place: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(rid):
        return rid, place, place
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)))
    first = np.flatnonzero(new)
    return rid[first], place[first], np.diff(np.concatenate((first, [len(rid)])))


# --- segments -----------------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of any substrings of a buffer, from running sums of bytes times powers of a base modulo 2^64."""

    def __init__(self):
        self.size = 0

    def grow(self, n: int) -> None:
        if n > self.size:
            self.size = n + (n >> 2)
            self.powers, self.inverse = [], []
            for base in _BASES:
                back = np.uint64(pow(int(base), -1, 1 << 64))
                for b, out in ((base, self.powers), (back, self.inverse)):
                    p = np.full(self.size, b)
                    p[0] = 1
                    out.append(np.multiply.accumulate(p))

    def sums(self, data: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[k][: len(data)], out=out[1:])
        return out


_hasher = Hasher()


def segments(texts: list[bytes], rid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(v, s, rid, start, n, at): the runs of windows under one smallest gram hash v; s is a hash of the run's bytes, at their
    place in the joined texts. n is negative where windows inside the run may be equal."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4
    joined_texts = b"".join(texts)
    data = np.frombuffer(joined_texts, np.uint8)
    if len(data) < length:
        return none
    _hasher.grow(len(data) + 1)
    sums = _hasher.sums(data, 0)
    g = (sums[gram:] - sums[:-gram]) * _hasher.inverse[0][: len(data) - gram + 1]
    g_mixed = _mix(g)
    low, width, wide = g_mixed, 1, length - gram + 1
    while width * 2 <= wide:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < wide:
        low = np.minimum(low[: -(wide - width)], low[wide - width :])
    sizes = np.array([len(t) for t in texts])
    edge = np.concatenate(([0], np.cumsum(sizes)))
    change = np.zeros(len(low) + 1, bool)  # low[i] is of the window that starts at i
    change[0] = True
    change[1:-1] = low[1:] != low[:-1]
    bad = np.zeros(len(low) + 1, np.int64)  # windows that reach across the end of a document
    first_bad = np.maximum(edge[1:] - length + 1, edge[:-1])
    np.add.at(bad, np.minimum(first_bad, len(low)), 1)
    np.add.at(bad, np.minimum(edge[1:], len(low)), -1)
    fits = np.cumsum(bad[:-1]) == 0
    change[edge[:-1][edge[:-1] < len(low)]] = True
    change[1:-1] |= fits[1:] != fits[:-1]
    at = np.flatnonzero(change[:-1])
    n = np.diff(np.concatenate((at, [len(low)])))
    keep = fits[at]
    at, n = at[keep], n[keep]
    if not len(at):
        return none
    if n.max() > LONG:  # one hash over a long stretch: periodic text
        parts = -(-n // LONG)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, n = np.repeat(at, parts) + k * LONG, np.minimum(np.repeat(n, parts) - k * LONG, LONG)
    # windows of one segment can only be equal where the text has a period below `wide` over more than `wide` grams: some
    # gram at a multiple of `tick` then comes again within that distance
    tick = 1 << (wide.bit_length() - 1)
    here = np.arange(0, max(0, len(g) - wide), tick)
    again = np.zeros(len(here), bool)
    for step in range(1, wide):
        again |= g_mixed[here] == g_mixed[here + step]
    marks = here[again]
    periodic = np.searchsorted(marks, at + n + wide) > np.searchsorted(marks, at)
    doc = np.searchsorted(edge, at, "right") - 1
    digest, view = xxhash.xxh3_64_intdigest, memoryview(joined_texts)
    s = np.fromiter((digest(view[a:b]) for a, b in zip(at.tolist(), (at + n + length - 1).tolist())), np.uint64, len(at))
    return low[at], s, rid[doc], at - edge[doc], np.where(periodic | (n > wide), -n, n), at


def _pieces(batches, length: int, gram: int):
    """The segments of each piece of input, hashed block by block; those whose bytes came before in it are gone already."""
    texts, rid, size, done, held, total = [], [], 0, [], [], 0

    def block():
        *columns, at = segments(texts, np.array(rid, np.int64), length, gram)
        done.append((*columns, at + total))
        held.append(b"".join(texts))
        texts.clear()
        rid.clear()

    def piece():
        columns = [np.concatenate([d[k] for d in done]) for k in range(6)]
        out = combined(*columns, b"".join(held), length)
        done.clear()
        held.clear()
        return out

    for batch in batches:
        for r, t in zip(batch.column("rid").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            texts.append(t)
            rid.append(r)
            size += len(t)
            if size >= BLOCK:
                block()
                total, size = total + size, 0
                if total >= PIECE:
                    yield piece()
                    total = 0
    if texts:
        block()
    if done:
        yield piece()


def _batch(names: str, *columns) -> pa.RecordBatch:
    out = []
    fields = [x.split() for x in names.split(", ")]
    for c, (_, kind) in zip(columns, fields):
        c = np.asarray(c)
        out.append(pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype({"long": np.int64, "int": np.int32, "boolean": bool}[kind])))
    return pa.RecordBatch.from_arrays(out, names=[f[0] for f in fields])


RANGE = "rid long, start int, n int"
FOUND = f"{SEGMENT}, kind int, copied boolean"


def combined(v, s, r, a, n, at, data: bytes, length: int):
    """Segments of a piece of input; those whose bytes came before in it are gone already (a negative start), and travel
    under a hash of their own, so that they meet nothing and crowd nothing."""
    order = np.lexsort((a, r, s, v))
    again = np.zeros(len(v), bool)
    k = np.flatnonzero((v[order][1:] == v[order][:-1]) & (s[order][1:] == s[order][:-1])) + 1
    x, y, size = at[order[k - 1]], at[order[k]], np.abs(n[order[k]]) + length - 1
    again[order[k]] = np.fromiter((data[i : i + m] == data[j : j + m] for i, j, m in zip(x.tolist(), y.tolist(), size.tolist())), bool, len(k))
    own = _mix((r * 0x9E3779B1 + a).astype(np.uint64))
    return np.where(again, own, v), s, r, np.where(again, -1 - a, a), n


def resolve(df: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Segments (v, s, rid, start, n) meet under v. kind 0: like the one before it, if their bytes are; 1: the first of a
    content under a v with others, to be sorted with them; 2: the same, under a v with over `crowd` of them; 3: the first
    of the only content under its v, which others are like. `copied`: others may be like it. Rows with a negative start,
    -1 - start, are gone already and only pass, as kind -1."""
    names = [f.split()[0] for f in SEGMENT.split(", ")]

    def put(columns, kind, copied) -> pa.RecordBatch:
        return _batch(FOUND, *columns[:4], np.abs(columns[4]), kind, copied)

    def judge(batches):
        last = None  # v, s of the row before
        held: list[list] = []  # firsts of the last v, whose end is not in sight
        held_n, crowded, held_v = 0, False, None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            passing = rows[3] < 0
            if passing.any():
                gone = [x[passing] for x in rows]
                gone[3] = -1 - gone[3]
                yield put(gone, np.full(len(gone[0]), -1), np.zeros(len(gone[0]), bool))
                rows = [x[~passing] for x in rows]
            v, s = rows[:2]
            if not len(v):
                continue
            first = np.ones(len(v), bool)
            first[1:] = (v[1:] != v[:-1]) | (s[1:] != s[:-1])
            if last is not None:
                first[0] = (v[0], s[0]) != last
            last, last_v = (v[-1], s[-1]), v[-1]
            copied = np.append(~first[1:], True)  # of the last row the next batch may hold copies
            if not first.all():
                gone = [x[~first] for x in rows]
                yield put(gone, np.zeros(len(gone[0])), np.zeros(len(gone[0]), bool))
            rows = [*(x[first] for x in rows), copied[first]]
            if held_v is not None:  # rows of the v that was left open
                more = int(np.searchsorted(rows[0] != held_v, True))
                held.append([x[:more] for x in rows])
                held_n += more
                rows = [x[more:] for x in rows]
                if last_v != held_v:
                    yield from let_go(held, held_n, crowded)
                    held, held_n, crowded, held_v = [], 0, False, None
            if len(rows[0]):
                tail = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if (rows[0] != rows[0][-1]).any() else 0
                if tail:
                    done = [x[:tail] for x in rows]
                    cut = np.flatnonzero(np.concatenate(([True], done[0][1:] != done[0][:-1])))
                    each = np.diff(np.concatenate((cut, [tail])))
                    size, mass = np.repeat(each, each), np.repeat(np.add.reduceat(np.abs(done[4]).astype(np.int64), cut), each)
                    kind = np.where((size > crowd) | (mass > MASS), 2, np.where((size > 1) | (done[4] < 0), 1, 3))
                    some = (kind < 3) | done[5]
                    if some.any():
                        yield put([x[some] for x in done], kind[some], done[5][some])
                held, held_n, held_v, crowded = [[x[tail:] for x in rows]], len(rows[0]) - tail, rows[0][-1], False
            if held_n > crowd:
                crowded = True
                yield from let_go(held, held_n, True)
                held, held_n = [], 0
        if held_v is not None:
            yield from let_go(held, held_n, crowded)

    def let_go(held, n, crowded):
        if not n:
            return
        columns = [np.concatenate([h[k] for h in held]) for k in range(6)]
        kind = 2 if crowded or np.abs(columns[4]).sum(dtype=np.int64) > MASS else 1 if n > 1 or columns[4][0] < 0 else 3
        if kind < 3 or columns[5].any():
            yield put(columns, np.full(n, kind), columns[5])

    return df.repartition("v").sortWithinPartitions("v", "s", "rid", "start").mapInArrow(judge, FOUND)


def verified(df: DataFrame) -> DataFrame:
    """Segments with their bytes meet under (v, s): all that are byte by byte the first of them go (kind 0), the first stays (kind 1)."""

    def judge(batches):
        last, own = None, None  # v, s and bytes of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            v, s, body = batch.column("v").to_numpy(), batch.column("s").to_numpy(), batch.column("bytes")
            like = np.zeros(batch.num_rows, bool)  # under the same hashes as the row before
            like[1:] = (v[1:] == v[:-1]) & (s[1:] == s[:-1])
            like[0] = last == (v[0], s[0])
            same = np.zeros(batch.num_rows, bool)
            same[1:] = pc.equal(body.slice(1), body.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            same[0] = like[0] and body[0].as_py() == own
            if (like & ~same).any():  # nothing is removed or kept on a guess
                raise RuntimeError("two different strings have one hash of 128 bits")
            last, own = (v[-1], s[-1]), body[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((~like).astype(np.int32))], names=[*batch.schema.names, "kind"])

    rows = df.select("v", "s", "rid", "start", "n", "bytes")
    return rows.repartition("v", "s").sortWithinPartitions("v", "s", "rid", "start").mapInArrow(judge, f"{SEGMENT}, bytes binary, kind int")


def parted(firsts: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Different segments under hashes that few share, and under crowded ones. Hashes are counted in parts before they meet."""
    count = firsts.groupBy("v").agg(F.count("*").alias("k"), F.sum(F.abs("n")).alias("mass")).where((F.col("k") > crowd) | (F.col("mass") > MASS) & (F.col("k") > 1))
    crowded = common.keep(count.select("v"), "crowded")
    if crowded.count() <= KNOWN:
        crowded = F.broadcast(crowded)
    return firsts.join(crowded, "v", "left_anti"), firsts.join(crowded, "v", "left_semi")


def numbered(df: DataFrame, more: list[str] | None = None) -> DataFrame:
    """rid, doc_id, text: rid orders the rows. It is doc_id itself where that tells all rows apart, else a place in the order of doc_id and a hash of the text."""
    rows = common.plain(df, "doc_id", "text", *(more or [])).withColumn("doc_id", F.col("doc_id").cast("long"))
    ids = rows.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if ids["n"] == ids["d"]:
        return rows.withColumn("rid", F.col("doc_id"))
    return common.in_order(rows.withColumn("_tie", F.xxhash64("text")), ["doc_id", "_tie"], name="numbered").withColumnRenamed("before", "rid").drop("_tie")


def ranges(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(rid, start, n): runs of windows that go, for rows of rid and text."""
    texts = rows.select("rid", "text")

    def send(batches):
        for columns in _pieces(batches, length, gram):
            yield _batch(SEGMENT, *columns)

    found = common.keep(resolve(texts.mapInArrow(send, SEGMENT), crowd), "segments", compression="zstd")
    asked = found.where("kind >= 0").groupBy("rid").agg(F.collect_list(F.struct("v", "s", "start", "n", "kind", "copied")).alias("asked"))
    schema = f"{FOUND}, bytes binary"

    def cut(batches):
        for batch in batches:
            lists = batch.column("asked")
            flat, many = lists.flatten(), np.diff(lists.offsets.to_numpy())
            start, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
            texts_here = batch.column("text").cast(pa.binary()).to_pylist()
            own = np.repeat(np.arange(batch.num_rows), many)
            ends = start.astype(np.int64) + n + length - 1
            body = [texts_here[i][x:y] for i, x, y in zip(own.tolist(), start.tolist(), ends.tolist())]
            rid = batch.column("rid").take(pa.array(own))
            yield pa.RecordBatch.from_arrays([flat.field("v"), flat.field("s"), rid, flat.field("start"), flat.field("n"), flat.field("kind"), flat.field("copied"), pa.array(body, pa.binary())], names=["v", "s", "rid", "start", "n", "kind", "copied", "bytes"])

    # the lists go into the join as they are grouped: writing them would hold every segment twice, and deal them by rid again
    pieces = common.keep(texts.join(asked, "rid").select("rid", "text", "asked").mapInArrow(cut, schema), "pieces", compression="zstd")

    def sort(batches):
        v_of, groups, size = None, [], 0
        lone = False  # one segment under the last v, whose windows all differ

        def done():
            if groups and lone:
                groups.pop()
            return _batch(RANGE, *repeated(groups, length))

        for batch in batches:
            for v, r, a, n, b in zip(*(batch.column(c).to_pylist() for c in ("v", "rid", "start", "n", "bytes"))):
                if v != v_of:
                    if lone:
                        size -= len(groups.pop()[0][2])
                    if size >= SHARD:
                        yield _batch(RANGE, *repeated(groups, length))
                        groups, size = [], 0
                    groups.append([])
                    v_of = v
                lone = not groups[-1] and n > 0
                groups[-1].append((r, a, b))
                size += len(b)
        yield done()

    def refine(batches, longer):
        """The windows of crowded segments, filed anew under longer grams, with their bytes."""
        for batch in batches:
            body = batch.column("bytes").to_pylist()
            if not body:
                continue
            v, s, k, a, n, at = segments(body, np.arange(len(body)), length, longer)
            size = np.abs(n) + length - 1
            cut = pa.array([body[i][x : x + m] for i, x, m in zip(k.tolist(), a.tolist(), size.tolist())], pa.binary())
            v, s, rid, start, n = combined(v, s, batch.column("rid").to_numpy()[k], batch.column("start").to_numpy()[k] + a, n, at, b"".join(body), length)
            out = _batch(SEGMENT, v, s, rid, start, n)
            yield pa.RecordBatch.from_arrays([*out.columns, cut], names=[*out.schema.names, "bytes"])

    def windows(batches):
        for batch in batches:
            rid, start, body = batch.column("rid").to_numpy(), batch.column("start").to_numpy(), batch.column("bytes").to_pylist()
            for at in range(0, len(body), 100):  # a body has at most LONG windows
                some = body[at : at + 100]
                n = np.array([len(b) - length + 1 for b in some])
                joined_bodies = b"".join(some)
                data = np.frombuffer(joined_bodies, np.uint8)
                _hasher.grow(len(data) + 1)
                own = np.repeat(np.arange(len(some)), n)
                inside = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                i = (np.cumsum(n + length - 1) - (n + length - 1))[own] + inside
                h = []
                for k in (0, 1):
                    sums = _hasher.sums(data, k)
                    h.append(_mix((sums[i + length] - sums[i]) * _hasher.inverse[k][i]))
                out = _batch(SEGMENT, *combined(h[0], h[1], rid[at : at + 100][own], start[at : at + 100][own] + inside, np.ones(len(own), np.int64), i, joined_bodies, length))
                cut = pa.array([joined_bodies[x : x + length] for x in i.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*out.columns, cut], names=[*out.schema.names, "bytes"])

    def gone(rows: DataFrame) -> DataFrame:
        return rows.select("rid", "start", F.abs("n").alias("n"))

    def passed(rows: DataFrame) -> DataFrame:
        return gone(rows.where("start < 0").withColumn("start", -1 - F.col("start")))

    out = gone(found.where("kind = -1")).unionByName(gone(verified(pieces.where("kind = 0 or copied")).where("kind = 0")))
    columns = ("v", "rid", "start", "n", "bytes")
    sorted_in = pieces.where("kind = 1").withColumn("n", -F.col("n")).select(*columns)
    crowded = pieces.where("kind = 2")
    for longer in [x for x in FINER if gram < x < length]:
        if not crowded.limit(1).count():
            break
        filed = common.keep(crowded.select("rid", "start", "bytes").mapInArrow(lambda batches, x=longer: refine(batches, x), f"{SEGMENT}, bytes binary"), "filed")
        finer = common.keep(verified(filed.where("start >= 0")), "finer")
        out = out.unionByName(passed(filed)).unionByName(gone(finer.where("kind = 0")))
        calm, crowded = parted(finer.where("kind = 1"), crowd)
        sorted_in = sorted_in.unionByName(calm.select(*columns))
        crowded = common.keep(crowded, "crowd")
    if crowded.limit(1).count():
        single = common.keep(crowded.select("rid", "start", "bytes").mapInArrow(windows, f"{SEGMENT}, bytes binary"), "windows")
        out = out.unionByName(passed(single)).unionByName(gone(verified(single.where("start >= 0")).where("kind = 0")))
    return out.unionByName(sorted_in.repartition("v").sortWithinPartitions("v", "rid", "start").mapInArrow(sort, RANGE))


def removed(df: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, rid, text and `gone`, the list of (start, n) runs of windows that go (null where there are none)."""
    rows = numbered(df)
    gone = common.keep(ranges(rows, length, gram, crowd).groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("gone")), "gone")
    return rows.join(gone, "rid", "left")


def spans(size: int, gone, length: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes of a text of `size` bytes."""
    if gone is None or not len(gone):
        return []
    edge = np.zeros(size + 1, np.int64)
    start = np.array([g["start"] for g in gone])
    np.add.at(edge, start, 1)
    np.add.at(edge, start + np.array([g["n"] for g in gone]) + length - 1, -1)
    dark = np.cumsum(edge) > 0
    turns = np.flatnonzero(np.diff(np.concatenate(([False], dark[:-1], [False]))))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def kept_bytes(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for run in runs for x in run], len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def digests(df: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def judge(batches):
        for batch in batches:
            out = []
            for doc, text, gone in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist()):
                runs = spans(len(text), gone, length)
                out.append((doc, len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(text, runs)).hexdigest()))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (*[pa.int64()] * 4, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed(df, length, gram, crowd).select("doc_id", "text", "gone").mapInArrow(judge, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def rows_kept(df: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """The rows of `df`, all columns, with the text that is left; a character that loses some of its bytes goes whole."""
    others = [c for c in df.columns if c != "text"]
    rows = numbered(df, [c for c in others if c != "doc_id"])
    gone = common.keep(ranges(rows, length, gram, crowd).groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("gone")), "gone")
    schema = T.StructType([f if f.name != "text" else T.StructField("text", T.StringType()) for f in df.schema.fields])

    def cut(batches):
        for batch in batches:
            out = []
            for text, gone in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist()):
                out.append(kept_bytes(text, spans(len(text), gone, length)).decode("utf-8", "ignore"))
            columns = [pa.array(out, pa.string()) if f.name == "text" else batch.column(f.name) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    joined = rows.join(gone, "rid", "left").withColumn("doc_id", F.col("doc_id").cast(df.schema["doc_id"].dataType))
    return joined.select(*df.columns, "gone").mapInArrow(common.frugal(cut), schema)
