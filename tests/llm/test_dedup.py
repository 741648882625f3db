"""Line, near and substring dedup against plain restatements."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.llm import bloom, components, line_dedup, near_dedup, substring_dedup

SCHEMA = "doc_id long, text string"


def _docs(spark, rows, parts=4):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def _vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(rng.randint(2, 9))) for _ in range(n)]


# ---------------------------------------------------------------- lines
def _lined(seed=3, n=120):
    rng = random.Random(seed)
    shared = ["  " * k + f"This line number {k} is shared by very many documents here" for k in range(8)] + ["short", "", "\t x \t"]
    rows = []
    for i in range(n):
        lines = [rng.choice(shared) if rng.random() < 0.6 else f"own line {i} {rng.random()} with enough characters to count" for _ in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.2 else x for x in lines)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "\n\n"), (None, rows[0][1])]


@pytest.mark.parametrize("parts", [1, 7])
def test_lines(spark, parts):
    rows = _lined()
    rows += [rows[5], rows[5]]  # repeated rows are documents of their own
    got = line_dedup.dedup_lines(_docs(spark, rows, parts)).collect()
    assert sorted((-(2**63) if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == brute.line_dedup(rows)


def test_lines_of_one_hot_line_and_very_long_texts(spark):
    hot = "the same very common line that every document begins with"
    rows = [(i, hot + ("\nx" * (50_000 if i == 7 else 1))) for i in range(400)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(_docs(spark, rows)).collect()}
    assert got[399] == (2, 0) and got[7] == (50_001, 1) and sum(d for _, d in got.values()) == 399


def test_lines_extra_columns_and_empty_table(spark):
    rows = _docs(spark, _lined(n=30))
    wide = rows.withColumns({"id": F.lit(1), "_id": F.lit(2), "lost": F.lit("x"), "key": F.lit(None).cast("string"), "n_lines": F.lit("old")})
    out = line_dedup.dedup_lines(wide)
    assert out.columns == ["doc_id", "text", "id", "_id", "lost", "key", "n_lines", "n_dropped"]
    assert out.select("id", "_id", "lost", "key").distinct().collect()[0] == (1, 2, "x", None) and out.count() == 34
    assert line_dedup.dedup_lines(wide, counts=False).schema["n_lines"].dataType.simpleString() == "string"
    assert line_dedup.dedup_lines(rows.limit(0)).count() == 0


def test_bloom_pair_suspects_all_repeats():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(2))
    pair = line_dedup.BloomPair(5000)
    pair.add(a, b, np.zeros(5000, bool))
    pair.add(a[:500], b[:500], np.zeros(500, bool))
    seen = pair.seen_twice(a, b)
    assert seen[:500].all() and seen[500:].mean() < 0.02


# ---------------------------------------------------------------- near copies
def _near(seed=5):
    """Groups of near copies around the threshold, exact copies, short and empty texts."""
    rng = random.Random(seed)
    vocabulary = _vocabulary(rng, 3000)
    rows, i = [], 0

    def add(words):
        nonlocal i
        rows.append((i, (" " if i % 3 else "\n").join(words)))
        i += 1

    for copies, share in ((150, 0.12), (12, 0.05), (12, 0.15), (4, 0.02)):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 160))]
        for _ in range(copies):
            own = rng.random() * 2 * share
            add([rng.choice(vocabulary) if rng.random() < own else w for w in base])
        for _ in range(3):
            add(base)
            add([w.upper() if w.isascii() else w for w in base])
    for _ in range(40):
        add([rng.choice(vocabulary) for _ in range(rng.randint(1, 80))])
    for words in (["one"], ["one"], ["ONE"], ["a", "b"], ["A", "b"], ["a"] * 400, ["a"] * 900):
        add(words)
    rows += [(i, None), (i + 1, ""), (i + 2, " \n\t ")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,light", [(2, 64), (2, 3), (5, 64)])
def test_near_copies_equal_all_pairs(spark, monkeypatch, size, light):
    monkeypatch.setattr(near_dedup, "LIGHT", light)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "LIGHT_BLOCK", 8)
    rows = _near()
    got = near_dedup.near_copies(_docs(spark, rows), size).collect()
    want = brute.near_copies(rows, size)
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_near_copies_nulls_repeats_and_kept_rows(spark):
    text = "some words that make a text long enough to have shingles"
    rows = [(None, text), (4, text), (4, text), (9, text + "!"), (2, "other words altogether are written in here now"), (7, None)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_dedup.near_copies(_docs(spark, rows), 5, 70).collect()), key=str)
    assert got == [(2, 2), (4, 4), (4, 4), (7, 7), (9, 4), (None, None)]
    wide = _docs(spark, rows).withColumns({"id": F.lit(1), "component_id": F.lit("c"), "_id": F.lit(0), "bucket": F.lit(3)})
    kept = near_dedup.drop_near_copies(wide, 5, 70)
    assert kept.columns == wide.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 4, 4, 7, None]
    assert near_dedup.near_copies(wide.limit(0)).count() == 0


def test_sequential_bounds_keep_what_may_be_similar():
    needed = near_dedup.least_matches(0.8)
    assert len(needed) == near_dedup.HASHES // near_dedup.STEP and needed == sorted(needed)
    rng = np.random.default_rng(0)
    for similarity, most, least in ((0.8, 1.0, 0.999), (0.3, 0.001, 0.0)):
        same = rng.random((20_000, near_dedup.HASHES)) < similarity
        alive = near_dedup.survives(np.zeros_like(same, dtype=np.uint16), (~same).astype(np.uint16), needed).mean()
        assert least <= alive <= most


def test_components(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(25)] + [(500, k) for k in range(501, 700)]
    want = {x: x for p in pairs for x in p}
    for _ in range(len(want)):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if any(a != b and k in (a, b) for a, b in pairs)}


# ---------------------------------------------------------------- substrings
def _passages(seed=2, n=60):
    rng = random.Random(seed)
    vocabulary = _vocabulary(rng, 400)
    pieces = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(1, 6)):
            words += rng.choice(pieces) if rng.random() < 0.4 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(n, "und " * 200), (n + 1, None), (n + 2, ""), (n + 3, " ".join(pieces[0])), (None, " ".join(pieces[1]) + " tail"), (None, "only here")]
    return rows + [rows[3], rows[3]]


@pytest.mark.parametrize("window,bits,parts", [(35, 1 << 22, 3), (35, 1 << 16, 1), (7, 1 << 22, 5), (4, 1 << 22, 2)])
def test_substrings_equal_brute_force(spark, window, bits, parts):
    """A filter that is far too small marks everything and changes nothing."""
    rows = _passages()
    out = substring_dedup.dedup_substrings(_docs(spark, rows, parts), window, once_bits=bits, twice_bits=bits).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out), key=str) == brute.substring_dedup(rows, window)


@pytest.mark.parametrize("first", ["long", "short"])
def test_substrings_of_rows_that_share_an_id(spark, first):
    """Two texts under one id, or text ids: each row is a text of its own, also where the longer one repeats something."""
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(60)
    long, short, other = " ".join(words(80) + passage), " ".join(words(45)), " ".join(passage + words(20))
    rows = [(1, long), (1, short)] if first == "long" else [(1, short), (1, long)]
    rows += [(2, other), (2, " ".join(words(200))), (None, " ".join(words(100))), (None, short + " x")]
    want = brute.substring_dedup(rows, 35)
    for kind in ("long", "string"):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
        got = substring_dedup.dedup_substrings(df).collect()
        named = sorted(((int(r.doc_id) if r.doc_id is not None else None, r.n_words, r.n_removed, r.text) for r in got), key=str)
        assert named == want


def test_substrings_of_a_hot_passage_and_extra_columns(spark):
    passage = " ".join(f"w{k}" for k in range(50))
    rows = [(i, f"own{i} start {passage} end{i}") for i in range(300)]
    wide = _docs(spark, rows).withColumns({"_key": F.lit(1), "id": F.lit("i"), "n_words": F.lit(None).cast("string"), "start": F.lit(2.0)})
    out = substring_dedup.dedup_substrings(wide)
    assert out.columns == ["doc_id", "text", "_key", "id", "start", "n_words", "n_removed"]
    # "start" in front of the passage is shared as well.
    assert {(r["n_words"], r["n_removed"], r["text"] == f"own{r['doc_id']} end{r['doc_id']}") for r in out.collect()} == {(53, 51, True)}
    assert substring_dedup.dedup_substrings(wide.limit(0)).count() == 0


def test_fixed_size_filter(spark):
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    rows = bloom.pack(h[:2000]) + bloom.pack(h[1000:3000])
    packed = spark.createDataFrame([(s, k, bytearray(d)) for s, k, d in rows], bloom.PACKED).repartition(3)
    once, twice = bloom.build(packed, 1 << 20, 1 << 20)
    assert bloom.has(once, h[:3000]).all() and bloom.has(once, h[3000:]).mean() < 0.02
    assert bloom.has(twice, h[1000:2000]).all() and bloom.has(twice, h[:1000]).mean() < 0.02
