"""Every operator against brute force, on small tables with nulls, empty and long texts, ties, copies and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from netloom.llm import common, decontaminate, fingerprints, html, licences, packing, sharding, simhash, suffixes, token_files, tokens, toxicity

from ..conftest import SF
from .test_near import brute as brute_near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, rid string, gone int, part string, v string"


@pytest.fixture(scope="module")
def frame():
    """Documents of the smoke table and odd ones; extra columns have names that operators use inside."""
    d = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").head(60)
    d["text"] = d.text.str.slice(0, 1500)
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "Été", "naïve", "zeta", "42", "x"]
    passage = " ".join(rng.choice(words, 60))
    odd = [None, "", " ", "\n\n", "one", "Shti " * 90, "a" * 400, "ab" * 300, passage, passage, "Start here. " + passage, passage + " and on it goes", passage.replace("alpha", "ALPHA", 1), "é" * 130, "Released under the MIT License. MIT license", "<|endoftext|> two  spaces\tand\n lines ", "\x00\x01 nul"]
    odd += [" ".join(rng.choice(words, 700)), d.text.iloc[3], d.text.iloc[3][:700] + " changed " + d.text.iloc[3][700:]]
    rows = [(int(i), t, la, so, int(n)) for i, t, la, so, n in d[["doc_id", "text", "lang", "source", "n_chars"]].itertuples(index=False)]
    rows += [(1000 + k, t, None if k % 3 == 0 else "en", None if k % 5 == 0 else "srcx", None) for k, t in enumerate(odd)]
    return [(*r, "r", 1, "p", "v") for r in rows]


@pytest.fixture(scope="module")
def docs(spark, frame):
    return spark.createDataFrame(frame, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def repeated(spark, frame):
    """Rows that come twice, and texts that share a doc_id."""
    return spark.createDataFrame([*frame[:10], *frame[:5], (3, "another text of document three", "en", "s", 1, "r", 1, "p", "v"), *frame[-6:], *frame[-6:]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(frame):
    return {r[0]: r[1] or "" for r in frame}


@pytest.fixture(scope="module")
def whole():
    """Ids of whole texts, by the library alone."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_of_pieces_are_ids_of_whole_texts(frame, whole):
    some = [*texts(frame).values(), " lead", "trail ", "a  b", "a \n b", "it 's 're", "don't  do", "a b", "tab\t x", "hello <|endoftext|> there", "<|endoftext|>", "a<|endoftext|>b  c", "<| endoftext |>", "中文 字符 mixed words", "emoji 😀 here"]
    got = tokens.encoder(tokens.vocabulary()).encode(some)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole(t) for t in some]


def test_packing(docs, frame, whole):
    got = packing.pack(docs, capacity=256).toPandas()
    for doc, text in texts(frame).items():
        ids = [*whole(text), 0]
        mine = got[got.doc_id == doc].sort_values("piece")
        assert mine.length.sum() == len(ids) and mine.length.max() <= 256
        if len(ids) > 256:
            assert (mine.length.iloc[1:] == 256).all()
        else:
            assert len(mine) == 1
        assert (mine.start == mine.length.cumsum() - mine.length).all()
        assert all(zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) == c for a, n, c in zip(mine.start, mine.length, mine.ids_crc32))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) + 1


def test_packing_of_repeated_rows_and_of_none(repeated, empty):
    assert packing.pack(repeated).select("doc_id", "piece").count() == repeated.count()
    assert packing.pack(empty).count() == 0


def test_the_fullest_bin_is_found():
    rng = np.random.default_rng(0)
    for _ in range(200):
        lengths = sorted(rng.choice(np.arange(1, 25), 5, replace=False).tolist(), reverse=True)
        counts = rng.integers(1, 4, 5).tolist()
        room = int(rng.integers(1, 50))
        best = 0
        for mix in np.ndindex(*[c + 1 for c in counts]):
            s = sum(m * x for m, x in zip(mix, lengths))
            best = max(best, s) if s <= room else best
        chosen, total = packing.fullest(lengths, counts, room)
        assert total == best == sum(lengths[k] * m for k, m in chosen.items())
        assert all(m <= counts[k] for k, m in chosen.items())


def test_plans_place_every_piece_once():
    rng = np.random.default_rng(1)
    histogram = collections.Counter(rng.integers(1, 65, 500).tolist())
    bins = packing.plan(dict(histogram), 64)
    used = collections.Counter()
    for one, often in bins:
        assert sum(x * n for x, n in one.items()) <= 64
        for x, n in one.items():
            used[x] += n * often
    assert used == histogram


def test_token_files(spark, docs, frame, whole, tmp_path):
    got = token_files.round_trip(docs).toPandas().sort_values("doc_id")
    start = 0
    for (_, row), (_, text) in zip(got.iterrows(), sorted(texts(frame).items())):
        ids = [*whole(text), 2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    folder = str(tmp_path / "tokens")
    token_files.write(docs, folder)
    some = token_files.read(spark, folder, "doc_id = 7").collect()
    assert len(some) == 1 and list(some[0]["tokens"]) == [*whole(texts(frame)[7]), 2]
    assert int(some[0]["start"]) == int(got[got.doc_id == 7].start.iloc[0])


def test_token_files_of_repeated_rows_and_of_none(repeated, empty):
    got = token_files.round_trip(repeated).toPandas().sort_values("start")
    assert (got.start == got.n_tokens.cumsum() - got.n_tokens).all() and got.doc_id.is_monotonic_increasing
    assert token_files.round_trip(empty).count() == 0


def brute_suffixes(rows, length=100):
    seen, out = set(), {}
    for doc, text in rows:
        b = text.encode()
        dark = np.zeros(len(b) + 1, int)
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            if w in seen:
                dark[j : j + length] += 1
            seen.add(w)
        dark = dark[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~dark])
        out[doc] = (len(b), int(dark.sum()), int((np.diff(np.concatenate(([0], dark.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd,mass", [(suffixes.CROWD, suffixes.MASS), (1, 150)])
def test_suffix_array_dedup(docs, frame, monkeypatch, crowd, mass):
    monkeypatch.setattr(suffixes, "MASS", mass)  # small bounds: the ways for crowded hashes give the same
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.digests(docs, crowd=crowd).collect()}
    assert got == brute_suffixes(sorted(texts(frame).items()))


def test_suffix_dedup_of_repeated_rows_and_of_none(repeated, empty):
    got = suffixes.digests(repeated).toPandas()
    assert len(got) == repeated.count()
    again = got[(got.doc_id == 3) & (got.n_bytes >= 100)]
    assert sorted(again.n_removed == again.n_bytes) == [False, True]  # one of two equal rows stays
    assert suffixes.digests(empty).count() == 0


def test_suffix_arrays_of_many_strings():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, width = int(rng.integers(1, 40)), int(rng.integers(1, 6))
        s = np.zeros((n, width), np.int32)
        for c in range(width):
            m = int(rng.integers(1, n + 1))
            s[:m, c] = rng.integers(1, rng.choice([2, 3, 8]), m)
        sa = suffixes.suffix_arrays(s, 10)
        for c in range(width):
            assert sa[:, c].tolist() == sorted(range(n), key=lambda i: s[i:, c].tolist())


def test_rows_kept_keeps_columns(docs, frame):
    got = suffixes.rows_kept(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"] and got.count() == len(frame)


def test_fingerprints(docs, frame):
    got = fingerprints.compare(docs).toPandas().set_index("doc_id")
    order = sorted(texts(frame).items())
    for k, (doc, text) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        q = len(text) // 4
        assert got.n_chars[doc] == len(text)
        assert got.edited_sha256[doc] == hashlib.sha256((text[: len(text) - q] + nxt[:q]).encode()).hexdigest()
    same = collections.defaultdict(set)  # not by pandas: it ends keys at a zero byte
    for d, t in order:
        same[t].add(got.fingerprint[d])
    assert all(len(x) == 1 for x in same.values())
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()
    long = [d for d, t in order if len(re.split(r"[\n\r]+|(?<=[.!?])\s+", t)) > 15]
    assert got.near_edited[long].mean() > got.near_next[long].mean() + 0.3


def test_fingerprints_ignore_order_and_add_up(spark):
    from pyspark.sql import functions as F

    rows = [(1, "One fine day.\nTwo by two."), (2, "Two by two.\nOne fine day."), (3, "One fine day."), (4, "Two by two.")]
    got = fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string"))
    f = {r["doc_id"]: r["fingerprint"] for r in got.collect()}
    assert f[1] == f[2] != f[3]
    both = spark.createDataFrame([(f[3], f[4], f[1])], "a string, b string, c string").select(fingerprints.combine(F.col("a"), F.col("b")).alias("sum"), fingerprints.combine(F.col("c"), F.col("b"), -1).alias("rest")).first()
    assert both["sum"] == f[1] and both["rest"] == f[3]


def test_fingerprints_of_repeated_rows_of_one_and_of_none(spark, repeated, empty):
    assert fingerprints.compare(repeated).count() == repeated.count()
    assert fingerprints.compare(empty).count() == 0
    one = fingerprints.compare(spark.createDataFrame([(1, "A b c d.")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


PAGE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy</div>{0}<footer>&copy; h</footer></body></html>"


def test_main_text(spark):
    body = "<article><h1>A &amp; B</h1><p><b>first  part<br><p>second\n part</p><section class='comments'><p>reader</p></section><form><p>x</p></form></article>"
    rows = [(1, "http://h.example/1", PAGE.format(body)), (2, "http://h.example/2", PAGE.format("<article><p>other")), (3, None, None), (4, "x", ""), (5, "http://h.example/5", "<p>cut <b"), (1, "http://h.example/1", PAGE.format(body))]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    assert set(got[got.page_id == 1].text) == {"A & B\nfirst part\nsecond part"} and (got.page_id == 1).sum() == 2
    by = got.set_index("page_id")
    assert by.text[2] == "other" and by.text[3] == by.text[4] == "" and by.text[5] == "cut"
    assert (got.n_chars == got.text.str.len()).all()
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_induction_finds_template_without_names(spark):
    page = "<body><div><p>Always the same words on top of every page here</p></div><div class=x><p>{0}</p><p>{1}</p></div></body>"
    rows = [(k, f"https://site.example/{k}", page.format(f"Story number {k} has its own opening words", "and goes on " * (3 + k))) for k in range(6)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    assert not got.text.str.contains("Always the same").any() and got.text.str.startswith("Story number").all()


def test_simple_tree_matching():
    assert html.match("0:a\n1:b\n1:c\n2:d", "0:a\n1:x\n1:c\n2:d") == {0: 0, 2: 2, 3: 3}
    assert html.match("", "0:a") == {}


def test_licences(docs, frame):
    got = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    for doc, text in texts(frame).items():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places, labels = [], set()
        for phrase, label in licences.BASE.items():
            k = phrase.split()
            found = [i for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k]
            places += found
            labels |= {label} if found else set()
        r = got[doc]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_licence_notices_are_found_whole(spark, empty):
    rows = [(1, "x y Licensed under CC BY-NC 4.0. z"), (2, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"), (3, "license " * 50), (4, None)]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["labels"], got[2]["labels"], got[3]["labels"], got[4]["n_words"]) == ("cc-by-nc", "bsd", "", 0)
    assert licences.scan(empty).count() == 0


def test_subsequence_kernel_is_the_definition():
    from itertools import combinations

    def brute(s, t, p=3, decay=0.7):
        a, b = collections.Counter(), collections.Counter()
        for x, c in ((s, a), (t, b)):
            for i in combinations(range(len(x)), p):
                c[tuple(x[k] for k in i)] += decay ** (i[-1] - i[0] + 1)
        return sum(a[k] * b[k] for k in a)

    for s, t in (("idiot", "i-d-i_oot"), ("abcab", "babca"), ("aaaa", "aaa"), ("xy", "xyz")):
        x, y = toxicity.codes(s), toxicity.codes(t)
        assert np.isclose(toxicity.subsequences(toxicity.padded([x]), toxicity.padded([y]), decay=0.7)[0], brute(x, y))


def test_toxicity_learns_gapped_insults(spark, empty):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "ru") for b in ("nt", "st", "ll", "rk") for c in ("er", "en", "o", "al")]
    insults = ["worthless", "idiot", "scum", "pathetic"]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        text = rng.choice(words, 30).tolist()
        if toxic:
            text[5:5] = rng.choice(insults, 2).tolist()
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    rows += [(9001, "you i-d-i-o-t and s.c.u.m"), (9002, "a p a t h e t i c and worthle$s thing"), (9003, " ".join(words[:20])), (9004, None), (9005, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs, machine).toPandas().set_index("doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    held = [i for i in range(600) if got.held_out[i]]
    assert all(got.predicted[i] == int(i % 4 == 0) for i in held)
    assert got.predicted[9001] == 1 and got.predicted[9002] == 1 and got.predicted[9003] == 0
    assert got.score[9004] == got.score[9005] < 0.5
    assert sorted(toxicity.clean(docs, machine).toPandas().doc_id) == sorted(got.index[got.predicted == 0])
    assert toxicity.score(empty, machine).count() == 0


def test_toxicity_without_labels(spark, docs):
    machine = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert set(toxicity.score(docs, machine).toPandas().score) == {0.0}


def brute_fingerprint(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    counts = [0] * 64
    for x in shingles:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def brute_components(f, radius=4):
    parent = {d: d for d in f}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = sorted(f.items())
    for k, (a, x) in enumerate(items):
        for b, y in items[k + 1 :]:
            if (x ^ y).bit_count() <= radius:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: root(d) for d in f}


def test_simhash_components(docs, frame, repeated, empty):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    f = {d: brute_fingerprint(t) for d, t in texts(frame).items()}
    assert {d: int(r["fingerprint"], 16) for d, r in got.items()} == f
    assert {d: r["component_id"] for d, r in got.items()} == brute_components(f)
    assert simhash.near_duplicates(repeated).count() == repeated.count()
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowd", [simhash.CROWD, 40])
def test_links_join_what_is_near(spark, crowd):
    rng = np.random.default_rng(6)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 6).tolist():
        for _ in range(120):
            x = centre
            for b in rng.integers(0, 64, int(rng.integers(0, 7))).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(simhash.signed(x) for x in fps)
    found = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), len(fps), crowd=crowd)).collect()
    roots = {r["node"]: r["root"] for r in found}
    want = brute_components({x: x & (1 << 64) - 1 for x in fps})
    groups, mine = collections.defaultdict(set), collections.defaultdict(set)
    for x in fps:
        groups[want[x]].add(x)
        mine[roots.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_block_sets_meet_every_near_pair():
    for n in (100, 10**7, 10**10):
        masks = simhash.block_sets(n)
        rng = np.random.default_rng(7)
        for _ in range(200):
            flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not flip & m for m in masks)


def brute_matches(rows, items, like=0.8):
    def shingles(w, k=5):
        return [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []

    out = {}
    for doc, text in rows:
        w = decontaminate.words(text)
        for item, t in items:
            x = decontaminate.words(t)
            if not x or not w:
                continue
            want = collections.Counter(shingles(x))
            size, best = min(len(x), len(w)), None
            for a in range(len(w) - size + 1):
                have = collections.Counter(shingles(w[a : a + size]))
                both = sum((have & want).values())
                alike = both / (sum(have.values()) + sum(want.values()) - both)
                if alike >= like and (best is None or alike > best[0]):
                    best = (alike, a)
            if best:
                out[doc, item] = best
    return out


def test_decontamination(spark, empty):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(words, int(rng.integers(12, 60))))) for k in range(12)] + [(90, None), (91, "short one"), (92, "")]
    rows = []
    for k in range(40):
        body = rng.choice(words, 80).tolist()
        item = items[k % 12][1].split()
        if k % 2 == 0:
            if k % 4 == 0 and len(item) > 30:
                item[int(rng.integers(0, 3))] = "other"  # near, not exact
            body[30:30] = item
        rows.append((k, " ".join(body)))
    rows += [(100, items[0][1].upper() + "!"), (101, None), (102, ""), (103, "Short one."), (104, items[3][1])]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start_word"]) for r in decontaminate.matches(docs, benchmark).collect()}
    want = brute_matches([(d, t or "") for d, t in rows], [(i, t or "") for i, t in items])
    assert got == {k: (round(a, 9), b) for k, (a, b) in want.items()} and len(got) > 20
    kept = {r["doc_id"] for r in decontaminate.clean(docs, benchmark).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}
    assert decontaminate.matches(empty, benchmark).count() == 0
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == len(rows)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = sorted(map(tuple, decontaminate.matches(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS", 7)
    assert sorted(map(tuple, decontaminate.matches(docs, items).collect())) == one and one


def test_shards(docs, frame, repeated, empty):
    got = sharding.shard(docs).toPandas()
    t = texts(frame)
    assert all(s == len(t[d].encode()) + 1 and c == zlib.crc32(t[d].encode()) for d, s, c in zip(got.doc_id, got["size"], got.text_crc32))
    sizes = got.groupby("shard").size()
    assert set(got.law) == {"rows"} and sizes.max() - sizes.min() <= 1 and set(sizes.index) == set(range(8))
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    shards = collections.defaultdict(set)
    for d, k in zip(got.doc_id, got.shard):
        shards[t[d]].add(k)
    assert sum(len(x) > 1 for x in shards.values()) <= 7
    assert sharding.shard(repeated).count() == repeated.count() and sharding.shard(empty).count() == 0


def test_neighbours_on_the_curve_are_neighbours_in_space():
    side = np.arange(8)
    cells = np.array(np.meshgrid(side, side, side)).reshape(3, -1).T
    order = np.argsort(sharding.curve(cells, 3))
    assert len(set(sharding.curve(cells, 3).tolist())) == 512
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_global_order(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k", "id % 5 AS w").repartition(7)
    got = common.in_order(df, ["k"], "w").toPandas().sort_values("k")
    assert (got.before == got.w.cumsum() - got.w).all()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        nxt = common.keep(stage(spark, out, SF), name)
        if name != "packing":
            assert set(nxt.columns) == set(docs.columns) and nxt.count() <= before
        if name == "near_duplicates":
            rows = sorted((r["doc_id"], r["text"]) for r in out.collect())  # five words, Jaccard similarity of 0.8 or more
            assert {r["doc_id"] for r in nxt.collect()} == {rows[k][0] for k in brute_near([t for _, t in rows])}
        if name == "repeated_strings":
            want = brute_suffixes(sorted((r["doc_id"], r["text"] or "") for r in out.collect()))
            for r in nxt.collect():
                n, gone, _, digest = want[r["doc_id"]]
                assert r["n_chars"] == len(r["text"]) and (gone or hashlib.sha256(r["text"].encode()).hexdigest() == digest)
        if name == "contamination":
            bad = {r["doc_id"] for r in decontaminate.matches(out, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert {r["doc_id"] for r in nxt.collect()} == {r["doc_id"] for r in out.collect()} - bad
        out, before = nxt, nxt.count()
    assert out.agg({"sequence_id": "count"}).first()[0] == before


def brute_fingerprint_vector(text):
    """The multiset of a text's paragraphs."""
    return collections.Counter(p for p in (x.strip(" ") for x in re.split(r"[\n\r]+|(?<=[.!?])\s+", text)) if p)


def test_fingerprints_are_equal_where_multisets_are(spark):
    rng = np.random.default_rng(12)
    some = ["A one.", "B two!", "C three?", "D four", "E five."]
    rows = [(k, "\n".join(rng.choice(some, int(rng.integers(0, 6))).tolist())) for k in range(120)] + [(500, None), (None, "A one."), (3, "A one."), (3, "A one."), (600, "x. " * 60_000)]
    got = fingerprints.compare(spark.createDataFrame([(*r, "c", 1, "d") for r in rows], "doc_id long, text string, _bucket string, _row int, fingerprint string")).toPandas()
    assert len(got) == len(rows) and got.fingerprint.str.len().eq(4 * fingerprints.LANES + 8 * fingerprints.WIDE).all()
    kinds = {}
    for d, f in zip(got.doc_id, got.fingerprint):
        kinds.setdefault(-1 if pd.isna(d) else int(d), set()).add(f)
    seen = {}
    for d, t in rows[:120]:
        if d != 3:
            key = frozenset(brute_fingerprint_vector(t).items())
            assert kinds[d] == seen.setdefault(key, kinds[d])
    assert len({f for d in kinds for f in kinds[d] if d < 120 and d not in (3, -1)}) == len(seen)


def test_lanes_are_independent(spark):
    """No lane's bit follows from another's: pairs of lanes agree in about half of the paragraphs."""
    from pyspark.sql import functions as F

    rows = spark.range(2000).select(F.concat(F.lit("paragraph "), F.col("id").cast("string")).alias("p"))
    h = np.array([list(r) for r in rows.select(*[c.alias(n) for n, c in fingerprints._hashes(F.col("p")).items()]).collect()], np.int64)
    bits = np.unpackbits(h.view(np.uint8), axis=1).astype(float)
    agree = np.corrcoef(bits.T)
    assert np.abs(agree - np.eye(len(agree))).max() < 0.15


def test_buckets_by_bisection(spark):
    from pyspark.sql import functions as F

    for cuts in ([], [5], [1, 3, 3**9, 2**40], list(range(0, 700, 7))):
        ids = [-3, 0, 1, 2, 3, 5, 6, 7, 699, 2**41]
        got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", fingerprints._bucket(cuts).alias("b")).collect()
        assert {r["doc_id"]: r["b"] for r in got} == {i: sum(c <= i for c in cuts) for i in ids}


def brute_licences(text, weight, notices=licences.NOTICES):
    """Labels and score by trying every template at every place."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    labels, score = set(), 0.0
    for phrase, label in licences.BASE.items():
        k = phrase.split()
        if any(w[i : i + len(k)] == k for i in range(len(w))):
            labels.add(label)
            score = 1.0
    for label, body, phrase in notices:
        body, key = body.split(), phrase.split()
        at = next(k for k in range(len(body)) if body[k : k + len(key)] == key)
        total = sum(weight[x] for x in body)
        for start in range(len(w)):
            if w[start + at : start + at + len(key)] != key:
                continue
            share = sum(weight[x] for k, x in enumerate(body) if start + k < len(w) and w[start + k] == x) / total
            score = max(score, min(1.0, share))
            labels |= {label} if share >= licences.MATCH else set()
    return ",".join(sorted(labels)), score


def test_licence_labels_and_scores_are_those_of_every_place(spark, frame):
    rng = np.random.default_rng(13)
    rows = [(r[0], r[1]) for r in frame if r[0] < 1100]
    for k in range(60):
        _, body, _ = licences.NOTICES[k % len(licences.NOTICES)]
        words = body.split()
        for _ in range(k // 20):  # some words changed, or words of other notices between
            words[int(rng.integers(len(words)))] = str(rng.choice(["license", "public", "other", "4"]))
        rows.append((2000 + k, " ".join(["Cc by", *words, *words[: k % 7], "public license 4 0"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weight = licences.weights(licences.with_words(df))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.scan(df).collect()}
    for doc, text in rows:
        labels, score = brute_licences(text or "", weight)
        assert got[doc][0] == labels and np.isclose(got[doc][1], score), doc


def test_strings_with_a_common_front_fall_into_different_cells(spark):
    rows = [(k, f"text {k}", "en", f"https://long.common.front/{k % 16:02d}", None) for k in range(640)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    cuts = sharding.cells(df, ["source", "lang"])
    assert [v[-2:] for v, _ in cuts["source"]] == [f"{k:02d}" for k in range(16)] and [k for _, k in cuts["source"]] == list(range(0, 32, 2))
    assert cuts["lang"] == [("en", 0)]
    got = sharding.shard(df).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]), on="doc_id")
    assert got.groupby("shard").source.nunique().max() <= 8


def test_files_along_the_curve_are_pruned(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    rng = np.random.default_rng(14)
    rows = [(k, "x" * int(rng.integers(1, 4000)), str(rng.choice(["de", "en", "es", "fr"])), f"src{int(rng.integers(32)):02d}", 7) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(4)
    folder = str(tmp_path / "curve")
    sharding.write(df, folder, files=64)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{folder}/*.parquet")]
    assert spark.read.parquet(folder).columns == df.columns and sum(m.num_rows for m in files) == 4000 and len(files) > 40

    def read(column, value):
        """Files whose ranges hold the value."""
        k = df.columns.index(column)
        return sum(m.row_group(0).column(k).statistics.min <= value <= m.row_group(0).column(k).statistics.max for m in files)

    assert read("source", "src17") < len(files) / 2 and read("lang", "es") < len(files) / 2


def test_every_group_goes_through_its_tree():
    """Groups from one to many hundreds: links are those of all pairs, and the shared bits drop whole nodes."""
    rng = np.random.default_rng(15)
    some, group = [], []
    for g, size in enumerate([1, 2, 3, 9, 40, 65, 700, 1, 5]):
        centres = rng.integers(0, 1 << 63, max(1, size // 70)).astype(np.uint64)
        for k in range(size):
            x = int(centres[k % len(centres)])
            for b in rng.integers(0, 64, int(rng.integers(0, 5))).tolist():
                x ^= 1 << b
            some.append(x)
            group.append(g)
    f, group = np.array(some, np.uint64), np.array(group)
    forest = simhash.Forest(f, group)
    first = forest.linked(4)
    assert forest.tally["seen"] > forest.tally["pruned"] > 0
    assert forest.tally["linked"] > 0 and forest.tally["compared"] < sum(int((group == g).sum()) ** 2 // 2 for g in set(group.tolist())) / 2
    for g in set(group.tolist()):
        mine = np.flatnonzero(forest.group[0] == g)
        want = brute_components({i: int(forest.fps[i]) for i in mine.tolist()})
        groups, ours = collections.defaultdict(set), collections.defaultdict(set)
        for i in mine.tolist():
            groups[want[i]].add(i)
            ours[int(first[i])].add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))
    # a node's bits are those that all its leaves share
    for level in range(1, len(forest.levels)):
        low, high = forest.levels[level]
        for k, (a, n) in enumerate(zip(*forest.leaf[level])):
            leaves = forest.fps[a : a + n]
            assert low[k] == np.bitwise_and.reduce(leaves) and high[k] == np.bitwise_or.reduce(leaves)


def test_short_items_are_found_anywhere(spark):
    items = [(1, "one two three"), (2, "word"), (3, "just four words here"), (4, "five words are a shingle"), (5, "!!!")]
    rows = [(1, "now one two three and more"), (2, "one two four three"), (3, "Just FOUR words, here"), (4, "a word"), (5, "x five words are a shingle y"), (6, "one two"), (7, None), (1, "now one two three and more"), (None, "one two three")]
    names = "doc_id long, text string, item_id string, similarity string, start_word string"
    docs, benchmark = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], names), spark.createDataFrame([(*r, "d") for r in items], "item_id long, text string, doc_id string")
    got = sorted((r["doc_id"] or 0, r["item_id"], r["similarity"], r["start_word"]) for r in decontaminate.matches(docs, benchmark).collect())
    want = brute_matches([(k, t or "") for k, (_, t) in enumerate(rows)], items)
    assert got == sorted((rows[k][0] or 0, i, a, b) for (k, i), (a, b) in want.items()) and len(got) == 6
    assert sorted(r["text"] or "" for r in decontaminate.clean(docs, benchmark).collect()) == ["", "one two", "one two four three"]


def test_blocks_alone_name_the_candidates():
    """What each stage decides: windows that share a shingle, pairs that the blocks name, pairs within the radius, verified ones."""
    rng = np.random.default_rng(16)
    words = [f"w{k}" for k in range(3000)]
    rows = [{"item_id": k, "text": " ".join(rng.choice(words, 40))} for k in range(300)]
    (bench,) = decontaminate.made(rows)
    docs = []
    for k in range(300):
        item = rows[k]["text"].split()
        for _ in range(k % 5):
            item[int(rng.integers(40))] = "other"
        docs.append(" ".join([*rng.choice(words, 30), *item, *rng.choice(words, 30)]))
    found = list(decontaminate._found([bench], docs))
    t = bench.tally
    assert t["pairs"] > t["named"] >= t["near"] >= t["verified"] > 0 and t["near"] < t["pairs"] / 20
    want = brute_matches(list(enumerate(docs)), [(r["item_id"], r["text"]) for r in rows[:40]])
    assert {(d, one.ids[i]): (round(a, 9), s) for d, got in enumerate(found) for one, i, a, s in got if one.ids[i] < 40} == {k: (round(a, 9), b) for k, (a, b) in want.items()}
    # recall of the radius at the similarity asked for
    near = total = 0
    for _ in range(3000):
        a = rng.integers(0, 1 << 63, 36).astype(np.uint64)
        b = np.concatenate((a[4:], rng.integers(0, 1 << 63, 4).astype(np.uint64)))
        fps = decontaminate.simhash(np.stack([decontaminate.bits(x).sum(axis=0) for x in (a, b)]))
        total, near = total + 1, near + int(np.bitwise_count(fps[:1] ^ fps[1:])[0] <= decontaminate.RADIUS)
    assert near / total > 0.999


def test_permuted_common_prefixes():
    rng = np.random.default_rng(17)
    for _ in range(80):
        n, width = int(rng.integers(2, 90)), int(rng.integers(1, 6))
        s = np.zeros((n, width), np.int32)
        for c in range(width):
            m = int(rng.integers(1, n + 1))
            s[:m, c] = np.resize(rng.integers(1, 4, int(rng.integers(1, 9))), m) if rng.random() < 0.5 else rng.integers(1, rng.choice([2, 3, 8]), m)
        sa = suffixes.suffix_arrays(s, 10)
        got = suffixes.common_prefixes(s, sa)
        for c in range(width):
            for k in range(1, n):
                x, y = s[sa[k - 1, c] :, c], s[sa[k, c] :, c]
                m = min(len(x), len(y))
                same = x[:m] == y[:m]
                assert got[c, sa[k, c]] == (m if same.all() else int(same.argmin()))
            assert got[c, sa[0, c]] == 0


def test_no_byte_goes_on_the_word_of_a_hash(spark, monkeypatch):
    """With every hash of contents the same, nothing unequal may be taken for equal: a piece keeps both, and the cluster stops."""
    rng = np.random.default_rng(18)
    texts = [bytes(rng.integers(97, 123, 300).astype(np.uint8)) for _ in range(3)] * 2
    rid = np.arange(6)
    v, s, r, a, n, at = suffixes.segments(texts, rid, 100, 32)
    same = np.zeros(len(v), np.uint64)
    got = suffixes.combined(v * 0, same, r, a, n, at, b"".join(texts), 100)
    first = {}
    for k in np.lexsort((a, r)).tolist():
        body = b"".join(texts)[at[k] : at[k] + abs(n[k]) + 99]
        first.setdefault(body, k)
    assert (got[3] < 0).sum() <= len(v) - len(first)  # only what is byte by byte like another goes
    rows = [(1, 2, 5, 0, 1, b"x" * 100), (1, 2, 6, 0, 1, b"x" * 100), (1, 2, 7, 0, 1, b"y" * 100)]
    frame = spark.createDataFrame(rows[:2], f"{suffixes.SEGMENT}, bytes binary")
    assert sorted((r["rid"], r["kind"]) for r in suffixes.verified(frame).collect()) == [(5, 1), (6, 0)]
    with pytest.raises(Exception, match="two different strings"):
        suffixes.verified(spark.createDataFrame(rows, f"{suffixes.SEGMENT}, bytes binary")).collect()


def test_a_passage_in_very_many_documents(spark, monkeypatch):
    """A crowded passage with different contexts: all ways of filing anew give what brute force gives; hashes that are met by a join too."""
    rng = np.random.default_rng(19)
    passage = " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit"], 40))
    rows = [(k, "".join(rng.choice(list("abcdefgh "), int(rng.integers(0, 60)))) + passage + "".join(rng.choice(list("abcdefgh "), int(rng.integers(0, 60))))) for k in range(150)]
    rows += [(200, "periodic " * 400), (201, "periodic " * 300), (202, "é" * 6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_suffixes(rows)
    monkeypatch.setattr(suffixes, "PIECE", 4000)
    assert {r["doc_id"]: tuple(r)[1:] for r in suffixes.digests(df).collect()} == want
    monkeypatch.setattr(suffixes, "KNOWN", 0)
    assert {r["doc_id"]: tuple(r)[1:] for r in suffixes.digests(df, crowd=2).collect()} == want


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty, repeated and very long texts, ties, extra columns; then empty tables."""
    import os

    text = " ".join(f"w{k}" for k in range(80))
    rows = [(None, "no id of its own", None, None, None), (1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text, "en", "t", 5), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "you scum idiot of a moron " * 3, "en", "s", 9), (6, " ".join(f"z{k}" for k in range(40_000)), "en", "s", None)]
    rows += [(100 + k, f"fine plain text number {k} with words {k * 7} of its own" + (" scum idiot" if k % 4 == 0 else ""), "en", "s", 1) for k in range(80)]
    tables = {
        "documents": spark.createDataFrame([(*r, "x", 7, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rid string, component long, gone boolean"),
        "labels": spark.createDataFrame([(100 + k, 1, int(k % 4 == 0), "y") for k in range(80)] + [(None, 1, 1, "y")], "doc_id long, quality int, toxic int, text string"),
        "benchmark": spark.createDataFrame([(1, "w3 w4 w5 w6 w7 w8 w9 nothing like it here at all"), (2, None)], "item_id long, text string"),
    }
    for name, folder in (("full", tmp_path / "full"), ("empty", tmp_path / "empty")):
        os.makedirs(folder)
        for t, df in tables.items():
            (df if name == "full" else df.limit(0)).write.parquet(f"{folder}/{t}.parquet")
        out = corpus_pipeline.run(spark, str(folder)).toPandas()
        if name == "empty":
            assert len(out) == 0
            continue
        docs = set(out.doc_id.dropna().astype(int))
        assert {1, 6} <= docs and 5 not in docs and 2 not in docs and (out.doc_id.isna()).sum() == 1
        assert len(docs & {3, 4}) == 1 and (out.doc_id == 1).sum() == 1
        assert len(docs & {100 + k for k in range(80) if k % 4 == 0}) == 0


@pytest.mark.parametrize("name", ["licence_base_phrases", "document_edits", "shard_balance"])
def test_parts_equal_their_twins(spark, name):
    import duckdb

    from netloom.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
