"""Best-fit packing by minimum bin slack.

Tokenising is spread over all tasks; the plan needs only how many pieces have each length, at most `capacity` numbers,
so its size does not grow with the corpus. For one bin the longest piece left is put in, and a bitset subset-sum over
the lengths that are left (with their counts) finds the fullest feasible rest; that combination is then removed as
often as the counts allow, all those bins at once. Pieces of one length are interchangeable: they are numbered in a
total order over all partitions (common.in_order) and the n-th of a length takes the n-th place planned for it.

Nulls and empty texts are one-token documents (the end id). Repeated rows and doc_ids are packed each for itself. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest(lengths: list[int], counts: list[int], room: int) -> tuple[dict[int, int], int]:
    """The multiset of `lengths` (descending, `counts` of each) whose sum is the largest up to `room`: {index: times}, sum.

    Bit s of `reach` says that s can be made of the lengths so far. A length's copies go in as 1, 2, 4, ... at a time.
    It stops at the first length with which `room` itself is met, so longer pieces go first.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for k, (length, count) in enumerate(zip(lengths, counts)):
        if length > room:
            continue
        left, lot = min(count, room // length), 1
        while left and not reach >> room & 1:
            lot = min(lot, left)
            steps.append((k, lot, reach))
            reach |= reach << (lot * length) & mask
            left -= lot
            lot *= 2
        if reach >> room & 1:
            break
    total = at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for k, lot, before in reversed(steps):
        if not before >> at & 1:
            chosen[k] = chosen.get(k, 0) + lot
            at -= lot * lengths[k]
    return chosen, total


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins as ({length: times in a bin}, number of such bins), until every piece has a place."""
    left = {length: n for length, n in histogram.items() if n}
    bins = []
    while left:
        lengths = sorted(left, reverse=True)
        longest = lengths[0]
        counts = [left[x] - (x == longest) for x in lengths]
        chosen, _ = fullest(lengths, counts, capacity - longest)
        one = {longest: 1}
        for k, times in chosen.items():
            one[lengths[k]] = one.get(lengths[k], 0) + times
        often = min(left[x] // times for x, times in one.items())
        bins.append((one, often))
        for x, times in one.items():
            left[x] -= often * times
            if not left[x]:
                del left[x]
    return bins


def places(histogram: dict[int, int], bins: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Where the pieces go, by their rank in the order (length, ...): runs of ranks that one kind of bin takes."""
    begin, total = {}, 0
    for length in sorted(histogram):
        begin[length] = total
        total += histogram[length]
    rows, first = [], 0
    for one, often in bins:
        offset = 0
        for length in sorted(one, reverse=True):
            rows.append((begin[length], one[length], first, offset, length))
            begin[length] += one[length] * often
            offset += one[length] * length
        first += often
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("rank", "times", "first", "offset", "length"), table.T))


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, share: float = 1.0) -> DataFrame:
    """Token counts and checksums of every document, cut into pieces of `capacity` where it is longer; the first may be shorter. `share`: see tokens.encoder."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encode = tokens.encoder(path, share).encode
        for table in tokens.gathered(batches):
            rows = []
            for doc, data in zip(tokens.flat(table, "doc_id").to_pylist(), encode(tokens.flat(table, "text"))):
                data += end
                n = len(data) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                rows.extend((doc, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:])))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.plain(df, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(cut, PIECES)


def pack(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, share: float = 1.0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece's sequence and place there."""
    path = path or tokens.vocabulary()
    cut = common.keep(pieces(df, path, capacity, end_id, share), "pieces")  # written first: dealing by range would tokenise twice, once for its sample
    ranked = common.in_order(cut, ["length", "doc_id", "piece", "ids_crc32"], name="ranked")
    histogram = {r["length"]: r["count"] for r in ranked.groupBy("length").count().collect()}
    where = places(histogram, plan(histogram, capacity))

    def assign(batches):
        for batch in batches:
            rank = batch.column("before").to_numpy()
            k = np.searchsorted(where["rank"], rank, "right") - 1
            bin_of, copy = np.divmod(rank - where["rank"][k], where["times"][k])
            sequence, offset = where["first"][k] + bin_of, where["offset"][k] + copy * where["length"][k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    columns = [c.split()[0] for c in PIECES.split(", ")]
    return ranked.select(*columns, "before").mapInArrow(assign, f"{PIECES}, sequence_id long, offset long")
