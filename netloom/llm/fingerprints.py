"""Homomorphic multiset fingerprints, with DataFrame functions only.

A text is the multiset of its paragraphs (lines, cut further at sentence ends). Each paragraph is hashed into a wide
vector; a text's fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo powers of two. So equal multisets
have equal fingerprints whatever the order of their paragraphs, and combine() adds or takes away paragraphs without a look
at the rest. A vector has two parts, of hashes with seeds of their own:

- WIDE lanes of 32 bits, each half of one of WIDE / 2 independent 64-bit hashes of the paragraph, summed modulo 2^32. They
  tell multisets apart: those of different paragraphs agree by chance in one of 2^256 cases.
- LANES lanes, 0 or the paragraph's weight (about the square root of its length) by a bit each of two further independent
  hashes, summed modulo 2^16. With the total weight they are random projections: the cosine of two centred vectors
  estimates the share of text that two documents have in common, and likeness() is that cosine, 0 at least.

Each paragraph adds two lanes of 31 bits to a long, or a half of 32 bits to one, which no text that fits into a string can
overflow; whole-stage code sums them, and the partial sums of a document meet in the task that holds it, without a shuffle.

The next document is found without one global window: documents fall into buckets of about ROWS rows at quantiles of
doc_id, found by bisection, and every bucket gets a copy of the first document of the next one. Null texts are empty; an
empty text has the zero vector, like only to another one (likeness 1). Rows of one doc_id, null too, share a bucket and
stand in the order of their texts. An empty table gives no rows; a single document is its own next one. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANES, WIDE = 128, 8
#: Documents of a bucket, about.
ROWS = 5000
_PAIRS = LANES // 2
_LOW = (1 << 31) - 1
_BREAK = r"[\n\r]+|(?<=[.!?])\s+"


def paragraphs(text):
    return F.split(text, _BREAK)


def _hashes(p) -> dict:
    """Independent hashes of a paragraph: a seed stands in front of it, so that no hash is a function of another."""
    names = [f"_h{k}" for k in range(LANES // 64)] + [f"_g{k}" for k in range(WIDE // 2)]
    return {n: F.xxhash64(F.lit(k), p) for k, n in enumerate(names)}


def _sums() -> list:
    """One sum for each pair of lanes, a bit of the hash says whether the paragraph's weight goes into the lane; and one for each wide lane."""
    out = []
    for k in range(_PAIRS):
        seed, bit = divmod(k, 32)
        low = F.shiftrightunsigned(F.col(f"_h{seed}"), bit).bitwiseAND(F.lit(1 | 1 << 32))  # bits `bit` and `bit` + 32
        out.append(F.sum((low.bitwiseAND(F.lit(1)) + F.shiftrightunsigned(low, 1).bitwiseAND(F.lit(1 << 31))) * F.col("_w")).alias(f"_s{k}"))
    for k in range(WIDE):
        half = F.shiftrightunsigned(F.col(f"_g{k // 2}"), 32 * (k % 2)).bitwiseAND(F.lit((1 << 32) - 1))
        out.append(F.sum(F.when(F.col("_w") > 0, half).otherwise(F.lit(0).cast("long"))).alias(f"_x{k}"))
    return out


def fingerprint(vector, wide):
    """The lanes modulo 2^16 and the wide ones modulo 2^32 as hexadecimal digits."""
    pair = lambda x: F.lpad(F.hex(F.shiftleft(x.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(F.shiftright(x, 31).bitwiseAND(F.lit(0xFFFF)))), 8, "0")
    one = lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit((1 << 32) - 1))), 8, "0")
    return F.lower(F.concat(F.array_join(F.transform(vector, pair), ""), F.array_join(F.transform(wide, one), "")))


def combine(first, second, sign: int = 1):
    """The fingerprint of the paragraphs of both columns of fingerprints together, or of the first without the second's."""

    def added(digits: int, skip: int, many: int):
        lane = lambda c, i: F.conv(F.substring(c, skip + i * digits + 1, digits), 16, 10).cast("long")
        add = lambda i: F.lpad(F.hex(F.pmod(lane(first, i) + sign * lane(second, i), F.lit(1 << 4 * digits))), digits, "0")
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(many - 1)), add), "")

    return F.lower(F.concat(added(4, 0, LANES), added(8, 4 * LANES, WIDE)))


def likeness(a, wa, b, wb):
    """Cosine of two centred vectors given with their total weights; 0 at least, 1 for two empty ones."""
    low = lambda x, w: (x.bitwiseAND(F.lit(_LOW)) * 2 - w).cast("double")
    high = lambda x, w: (F.shiftright(x, 31) * 2 - w).cast("double")
    dot = lambda x, wx, y, wy: F.aggregate(F.zip_with(x, y, lambda p, q: low(p, wx) * low(q, wy) + high(p, wx) * high(q, wy)), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, wa, a, wa)) * F.sqrt(dot(b, wb, b, wb))
    cosine = F.when((wa == 0) & (wb == 0), F.lit(1.0)).when((wa == 0) | (wb == 0), F.lit(0.0)).otherwise(dot(a, wa, b, wb) / norm)
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)))


def _bucket(cuts: list[int]):
    """How many of the sorted cuts are no greater than doc_id, by bisection over a constant array."""
    if not cuts:
        return F.lit(0)
    bits = len(cuts).bit_length()
    padded = F.lit(cuts + [(1 << 63) - 1] * ((1 << bits) - 1 - len(cuts))).cast("array<long>")
    steps = F.array(*[F.lit(1 << k) for k in range(bits - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(padded, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))


def edited(df: DataFrame) -> DataFrame:
    """Every row of doc_id and text in its bucket (_bucket, _row) with the next document's text; the rows with _copy are the next bucket's first, repeated."""
    spark = df.sparkSession
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], max(1000, 4 * buckets))).first()[0]
    cuts = sorted(set(cuts or []))
    bucket = _bucket(cuts)
    rows = rows.withColumn("_bucket", bucket)
    first = rows.groupBy("_bucket").agg(F.min(F.struct("doc_id", "text")).alias("_first"))
    numbers = [r[0] for r in rows.select("_bucket").distinct().collect()]  # as many as there are buckets
    after = {b: c for b, c in zip(sorted(numbers), [*sorted(numbers)[1:], *sorted(numbers)[:1]])}
    if not after:
        return rows.withColumns({"_copy": F.lit(False), "_row": F.lit(1), "_next": F.lit("")})
    before = {c: b for b, c in after.items()}
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    copies = first.select(F.col("_first.doc_id").alias("doc_id"), F.col("_first.text").alias("text"), to[F.col("_bucket")].alias("_bucket"), F.lit(True).alias("_copy"))
    order = Window.partitionBy("_bucket").orderBy("_copy", "doc_id", "text")
    return rows.withColumn("_copy", F.lit(False)).unionByName(copies).withColumns({"_row": F.row_number().over(order), "_next": F.coalesce(F.lead("text").over(order), F.lit(""))})


def compare(df: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = edited(df)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("_edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))"), F.expr("substring(_next, 1, cast(floor(n_chars / 4) as int))")))
    sides = F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("_edited").alias("body")))
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256))
    keys = ["_bucket", "_row", "_copy", "doc_id", "n_chars", "edited_sha256"]
    each = rows.select(*keys, F.explode(sides).alias("s")).select(*keys, F.col("s.which").alias("_which"), F.explode(paragraphs(F.col("s.body"))).alias("p"))
    each = each.withColumn("p", F.trim("p"))  # an empty paragraph weighs nothing
    each = each.select(*keys, "_which", F.ceil(F.sqrt(F.octet_length("p"))).cast("long").alias("_w"), *[h.alias(n) for n, h in _hashes(F.col("p")).items()])
    sums = each.groupBy(*keys, "_which").agg(F.sum("_w").alias("_weight"), *_sums())
    vectors = sums.select(*keys, "_which", "_weight", F.array(*[f"_s{k}" for k in range(_PAIRS)]).alias("_vector"), F.array(*[f"_x{k}" for k in range(WIDE)]).alias("_wide"))
    order = Window.partitionBy("_bucket").orderBy("_row", "_which")
    vectors = vectors.withColumns({"_ev": F.lead("_vector", 1).over(order), "_ew": F.lead("_weight", 1).over(order), "_ex": F.lead("_wide", 1).over(order), "_nv": F.lead("_vector", 2).over(order), "_nw": F.lead("_weight", 2).over(order)})
    kept = vectors.where("_which = 0 and not _copy")
    return kept.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("_vector"), F.col("_wide")).alias("fingerprint"),
        fingerprint(F.col("_ev"), F.col("_ex")).alias("edited_fingerprint"),
        likeness(F.col("_vector"), F.col("_weight"), F.col("_ev"), F.col("_ew")).alias("near_edited"),
        likeness(F.col("_vector"), F.col("_weight"), F.col("_nv"), F.col("_nw")).alias("near_next"),
    )
