"""Pattern tables, leak audits and lexicon tables against plain restatements."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.config import DEFAULT_LEXICON
from voxmill.operators import patterns
from voxmill.operators.highlight import highlight_spans, highlight_terms
from voxmill.operators.redaction import leak_audit_table
from voxmill.operators.sentiment import score_lexicon, score_lexicon_table

ALPHABET = ["a", "b", "ab", "é", "😀", " ", "\n", "ba ", "ß"]


def texts(seed=1, n=60):
    rng = random.Random(seed)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*out, None, "", "abba" * 30_000, "x"]


def some_patterns(rows, seed=2):
    rng = random.Random(seed)
    out = {"a", "😀", "zz", "abba" * 10, "b" * 3000, "ab" * 600}
    for t in rows:
        if t:
            a = rng.randrange(len(t))
            out.add(t[a : a + rng.randint(1, 40)])
    return sorted(out)


def places(text, pattern):
    at, out = text.find(pattern), []
    while at >= 0:
        out.append(at)
        at = text.find(pattern, at + 1)
    return out


@pytest.mark.parametrize("bits", [1 << 13, 1 << 22])
def test_occurrences_equal_a_plain_search(spark, bits):
    """The smaller filter is full, so nearly everything is joined; the results are the same."""
    rows = texts()
    wanted = some_patterns(rows)
    df = spark.createDataFrame([(t,) for t in rows], "text string").coalesce(1)
    table = spark.createDataFrame([(p,) for p in [*wanted, None, "", wanted[0]]], "pattern string")
    looked_for = patterns.prepare(table, bits=bits)
    got = sorted((r.row, r.at, r.pattern) for r in patterns.occurrences(df, "text", looked_for).collect())
    assert got == sorted((i, at, p) for i, t in enumerate(rows) for p in wanted for at in places(t or "", p))
    once = sorted((r.row, r.pattern) for r in patterns.occurrences(df, "text", looked_for, once=True).collect())
    assert once == sorted((i, p) for i, t in enumerate(rows) for p in wanted if p in (t or ""))


def test_pieces_do_not_change_what_is_found(spark, monkeypatch):
    rows = [t for t in texts(5, 20) if t is not None]
    probe = patterns.prepare(spark.createDataFrame([(p,) for p in some_patterns(rows)], "pattern string")).probe
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(len(rows))), pa.array(rows)], names=["row", "text"])
    whole = pa.Table.from_batches(patterns._searcher(probe, False)([batch])).to_pylist()
    monkeypatch.setattr(patterns, "PIECE", 8)
    small = pa.Table.from_batches(patterns._searcher(probe, False)([batch])).to_pylist()
    key = lambda r: (r["row"], r["at"], r["found"])
    assert sorted(whole, key=key) == sorted(small, key=key)


def test_rolling_hash_tells_stretches_apart():
    data = np.frombuffer(("abcab" * 50).encode(), dtype=np.uint8)
    rolling = patterns.Rolling(data)
    starts = np.arange(len(data) - 5)
    h = rolling.of(starts, 5)
    stretches = [data[s : s + 5].tobytes() for s in starts]
    assert len(set(h.tolist())) == len(set(stretches)) == 5


def test_leak_audit_of_many_secrets(spark):
    rows = [(t, "p" + str(i) if i % 2 else None) for i, t in enumerate(texts(7, 40))]
    secrets = [*some_patterns([t for t, _ in rows], 9), "p1", "b\np3", "nowhere"]
    df = spark.createDataFrame(rows, "text string, extra string").repartition(4)
    found = leak_audit_table(df, spark.createDataFrame([(s,) for s in secrets], "secret string"), ["text", "extra"])
    lines = ["\n".join(x for x in r if x is not None) for r in rows]
    assert {r.secret: r.rows_found for r in found.collect()} == {s: sum(s in x for x in lines) for s in secrets}
    none = spark.createDataFrame([], "secret string")
    assert leak_audit_table(df, none, ["text"]).count() == 0
    assert leak_audit_table(df.limit(0), spark.createDataFrame([("x",)], "secret string"), ["text"]).first().rows_found == 0


def test_a_lexicon_table_of_200_000_terms(spark):
    """As many terms as the plan could not hold; the spans are those of the few that occur."""
    real = {"good": 2.0, "not good": -2.5, "love": 3.0, "hate": -2.7, "waste of time": -3.0, "of time": 2.0, "weak": -1.0, "tire": -2.0}
    many = spark.range(200_000).select(F.concat(F.lit("q"), F.col("id"), F.when(F.col("id") % 3 == 0, " w").otherwise("")).alias("term"), F.lit(2.0).alias("valence"))
    lexicon = many.unionByName(spark.createDataFrame(list(real.items()), "term string, valence double"))
    rows = [
        (1, "😀 I LOVED it, not good at all [EMAIL_REDACTED] hated"), (2, "a Waste of Time of time"), (3, None), (4, "weak tired tires"), (5, ""),
        (6, "q7 q9 w Q9 W q12 word"), (7, "it is knot goodness, İ love [PII_REDACTED]love good-ly goodly"),
    ]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: [(h.start, h.end, h.polarity, h.term) for h in r.highlights] for r in highlight_spans(df, lexicon, "id").collect()}
    few = real | {"q7": 2.0, "q9 w": 2.0, "q12 w": 2.0}
    want = {r.id: [(h.start, h.end, h.polarity, h.term) for h in r.highlights] for r in highlight_terms(df, few).collect() if r.highlights}
    assert got == want
    assert set(got) == {1, 2, 4, 6, 7}


def test_overlapping_phrases_are_settled_longest_first(spark):
    lexicon = {"ha ha": 2.0, "ha ha ha ha": -2.0, "b c": 3.0, "a b": -3.0, "a b c": 1.0, "c d e": 2.0}
    df = spark.createDataFrame([(1, "ha ha ha ha ha ha ha"), (2, "a b c d e"), (3, "xa bx a b")], "id long, text string")
    table = spark.createDataFrame(list(lexicon.items()), "term string, valence double")
    got = {r.id: [(h.start, h.end, h.polarity) for h in r.highlights] for r in highlight_spans(df, table, "id").collect()}
    assert got[1] == [(0, 11, "negative"), (12, 17, "positive")]
    assert got[2] == [(0, 3, "negative"), (4, 9, "positive")]
    assert got[3] == [(1, 4, "negative"), (6, 9, "negative")]


def test_table_scores_equal_those_of_the_plan(spark):
    rng = random.Random(3)
    vocabulary = [*DEFAULT_LEXICON, "not", "very", "slightly", "never", "x", "Ünü", "so", "GREAT"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))) for i in range(200)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    table = spark.createDataFrame(list(DEFAULT_LEXICON.items()), "term string, valence double")
    want = {r.id: r.sentiment_score for r in score_lexicon(df.fillna(""), DEFAULT_LEXICON).collect()}
    for bits in (1 << 12, 1 << 20):
        assert {r.id: r.sentiment_score for r in score_lexicon_table(df, table, "id", bits=bits).collect()} == want
    assert {r.sentiment_score for r in score_lexicon_table(df, table.limit(0), "id").collect()} == {0.0}


@pytest.mark.parametrize("mask", [None, 3])
def test_rows_are_counted_inside_the_task(monkeypatch, mask):
    """One row leaves for each different string, however many texts hold it; strings whose hashes are equal stay apart."""
    import pyarrow as pa

    if mask is not None:
        monkeypatch.setattr(patterns, "_mixed", lambda x: x & np.uint64(mask))
    rows, wanted = ["xabcx abc", "abc", "bcd abd", "nothing", "", "abcd"] * 50, ["abc", "abd", "bcd", "zzz"]
    column = pa.array(wanted)
    seeds, wholes = (np.full(1 << 13, 255, dtype=np.uint8) for _ in range(2))
    probe = patterns.Probe(*(type("Sent", (), {"value": t}) for t in (seeds, wholes)), [len(column[0].as_py())])
    monkeypatch.setattr(patterns, "PIECE", 100)
    out = pa.Table.from_batches(patterns._row_counter(probe)([pa.record_batch([pa.array(rows)], names=["text"])])).to_pylist()
    got = {r["found"].decode(): r["rows"] for r in out}
    assert len(got) == len(out)
    assert {w: got.get(w, 0) for w in wanted} == {w: sum(w in t for t in rows) for w in wanted}


def test_filters_grow_with_their_tables():
    assert patterns.filter_bits(0) == patterns.filter_bits(1_000_000) == patterns.FILTER_BITS
    assert patterns.filter_bits(6_000_000) == 1 << 28
    assert patterns.filter_bits(10**10) == patterns.MOST_FILTER_BITS


def test_tokens_are_scored_in_pieces_of_bounded_size(monkeypatch):
    import pyarrow as pa

    from voxmill.operators import sentiment

    rng = random.Random(8)
    rows = [["", "", "", *(rng.choice(["not", "very", "partly", "good", "x", "é"]) for _ in range(n))] for n in (0, 1, 200, 3, 0, 40)]
    batch = pa.record_batch([pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.string()))], names=["id", "tokens"])
    table = type("Sent", (), {"value": np.full(1 << 13, 255, dtype=np.uint8)})
    kind = {"not": sentiment.NEGATES, "very": sentiment.BOOSTS, "partly": sentiment.DAMPENS}
    want = {(i, w, p, sum(kind.get(t[p - 1 - k], 0) << 2 * k for k in range(3))) for i, t in enumerate(rows) for p, w in enumerate(t) if p >= 3}
    for size in (7, 1 << 18):
        monkeypatch.setattr(sentiment, "TOKENS_AT_ONCE", size)
        out = list(sentiment._hits_of(table)([batch]))
        assert all(sum(map(len, b.column(3).to_pylist())) <= size for b in out)
        got = [(r["id"], r["word"], u >> 6, u & 63) for b in out for r in b.to_pylist() for u in r["uses"]]
        assert set(got) == want and len(got) == len(want)


def test_a_text_sends_each_string_once_and_no_claim(spark, monkeypatch):
    """What is joined to the lexicon are the different strings of a chunk, however often they occur in it."""
    from voxmill.operators import highlight

    joined = []
    join = highlight.salted_join
    monkeypatch.setattr(highlight, "salted_join", lambda big, *a: joined.append(big.count()) or join(big, *a))
    lexicon = spark.createDataFrame([("good", 2.0), ("bad day", -2.0)], "term string, valence double")
    df = spark.range(500).select("id", F.lit("good GOOD a bad day, a Bad Day good").alias("text")).coalesce(1)
    rows = {tuple((h.start, h.end, h.polarity, h.term) for h in r.highlights) for r in highlight_spans(df, lexicon, "id").collect()}
    assert rows == {((0, 4, "positive", "good"), (5, 9, "positive", "GOOD"), (12, 19, "negative", "bad day"), (23, 30, "negative", "Bad Day"), (31, 35, "positive", "good"))}
    assert joined == [4]


def test_claims_of_one_id_are_settled_together(spark):
    lexicon = spark.createDataFrame([("good", 2.0), ("a bad", -2.0)], "term string, valence double")
    rows = [(1, "good x"), (1, "good x"), (2, "good [EMAIL_REDACTED]"), (2, "a bad good"), (None, "x good"), (None, "xx good"), (3, "good")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    got = {r.id: [(h.start, h.end, h.term) for h in r.highlights] for r in highlight_spans(df, lexicon, "id").collect()}
    assert {k: len(v) for k, v in got.items()} == {1: 1, 2: 1, None: 1, 3: 1}
    assert got[2] == [(0, 5, "a bad")] and got[3] == [(0, 4, "good")]


@pytest.mark.parametrize("rounds", [0, 1, 64])
def test_stretches_hold_as_if_taken_one_by_one(rounds):
    from voxmill.operators.highlight import first_come

    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 300):
        start = rng.integers(0, 400, n)
        end = start + rng.integers(1, 12, n)
        given = rng.random(420) < 0.1
        taken, want = given.copy(), []
        for a, b in zip(start, end, strict=True):
            want.append(not taken[a:b].any())
            taken[a:b] |= want[-1]
        assert first_come(start, end, given.copy(), rounds).tolist() == want
