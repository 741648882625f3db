"""Mixing, decontamination and the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxmill.llm import decontamination, mixing

SCHEMA = "doc_id long, text string, source string"


# ---------------------------------------------------------------- mixing
def _targets(sizes, share=1.5, most=2, weights=(3, 1, 2)):
    """Reshare until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = [s for s in open_ if level * weight[s] >= most * sizes[s]]
        if not full:
            return fixed | {s: level * weight[s] for s in open_}
        for s in full:
            fixed[s] = most * sizes[s]
            left -= fixed[s]


def _sources(seed=1, n=900):
    rng = random.Random(seed)
    names = ["hot"] * 6 + ["b", "A", "é", "z9", None, ""]
    return [(i, " ".join(["w"] * rng.randint(0, 120)), rng.choice(names)) for i in range(n)]


def test_mix_hits_its_targets(spark):
    rows = _sources()
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(brute.WORD.findall(text))
    want, source_of, taken = _targets(sizes), {i: s for i, _, s in rows}, Counter()
    assert len(got) == len(rows)
    for r in got:
        source = source_of[r["doc_id"]]
        assert r["target"] == pytest.approx(want[source]) and r["source_size"] == sizes[source]
        assert r["size"] == len(brute.WORD.findall(rows[r["doc_id"]][1]))
        assert r["taken"] in {k * r["size"] for k in range(3)}
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(2)).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}


def test_mix_order_is_the_pareto_order(spark):
    """Within a source the documents that are taken once more are the first ones of the order."""
    rows = _sources(4, 500)
    df = spark.createDataFrame(rows, SCHEMA)
    u = {r["id"]: r["u"] for r in df.select(F.col("doc_id").alias("id"), mixing.draw("doc_id", "mix").alias("u")).collect()}
    assert all(0 < x < 1 for x in u.values())
    got = [r for r in mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").collect() if r["size"] and r["source"] == "hot"]
    chance, whole = _chances(got)
    assert all(0 < p < 1 for p in chance.values())
    key = lambda r: u[r["doc_id"]] / (1 - u[r["doc_id"]]) / (chance[r["doc_id"]] / (1 - chance[r["doc_id"]]))
    first = [key(r) for r in got if r["taken"] == (whole + 1) * r["size"]]
    rest = [key(r) for r in got if r["taken"] == whole * r["size"]]
    assert first and rest and len(first) + len(rest) == len(got) and max(first) < min(rest)


def _chances(rows):
    """Inclusion probability of every document of one source, by halving the factor's range, and the number of whole copies."""
    size, target = sum(r["size"] for r in rows), rows[0]["target"]
    whole = int(target // size)
    rest, low, high = target - whole * size, 0.0, 5.0
    wish = {r["doc_id"]: 0.25 if r["size"] < 50 else 1.0 for r in rows}
    for _ in range(200):
        factor = (low + high) / 2
        words = sum(min(1.0, factor * wish[r["doc_id"]]) * r["size"] for r in rows)
        low, high = (factor, high) if words < rest else (low, factor)
    return {i: min(1.0, factor * w) for i, w in wish.items()}, whole


@pytest.mark.parametrize("share", [0.3, 0.95])
def test_inclusion_probabilities(spark, share):
    """Over many seeds short and long documents come as often as their probabilities say, also where the long ones are certain."""
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * (rng.randint(60, 90) if i % 2 else rng.randint(10, 40))), "s") for i in range(1200)]
    df, found, seeds = spark.createDataFrame(rows, SCHEMA).cache(), Counter(), 4
    for seed in range(seeds):
        got = mixing.mix(df, share=share, seed=f"seed{seed}").collect()
        found.update(r["doc_id"] for r in got if r["taken"] == r["size"])
        assert {r["taken"] // r["size"] for r in got} <= {0, 1}
    chance, whole = _chances(got)
    assert whole == 0
    for odd in (0, 1):
        p = chance[odd]
        assert p == pytest.approx(1) if share > 0.9 and odd else p < 1
        often = sum(n for i, n in found.items() if i % 2 == odd) / (600 * seeds)
        assert abs(often - p) <= 4 * (p * (1 - p) / (600 * seeds)) ** 0.5 + 0.002


def test_mix_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "n n n", "b"), (4, "long " * 30_000, "c"), (5, "w", "c")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit("s"), "target": F.lit(1), "copies": F.lit(2), "copy": F.lit("old"), "u": F.lit(0)})
    got = mixing.mix(df)
    assert got.count() == len(rows) and got.agg(F.max(F.col("taken") - 2 * F.col("size"))).first()[0] <= 0
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns and set(r["doc_id"] for r in out.collect()) <= {3, 4, 5, None}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_rows(df.limit(0)).count() == 0
    assert {r["taken"] for r in mixing.mix(df.where("doc_id < 3")).collect()} == {0}


def test_mixed_rows_follow_the_plan_where_rows_share_an_id(spark):
    """Two texts of different length, or of different sources, under each id."""
    rows = []
    for i in range(300):
        rows += [(i, "w " * (20 + i % 90), "abc"[i % 3]), (i, "w " * (150 + i % 70), "abc"[i % 3]), (i, "w " * 60, "abc"[(i + 1) % 3])]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.mix(df).agg(F.sum("taken")).first()[0]
    out = mixing.mixed_rows(df)
    assert out.agg(F.sum(mixing.size_of("text"))).first()[0] == plan
    assert out.groupBy("doc_id", "source", "text").count().agg(F.max("count")).first()[0] <= 2


# ---------------------------------------------------------------- decontamination
def _leaky(seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(2500)]
    common = ["the", "of", "and", "in", "to"]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]
    items = [(k, text(rng.randint(15, 60))) for k in range(20)] + [(50, text(400))]
    rows, truth = [], set()
    for i in range(240):
        body = text(rng.randint(5, 300))
        if i % 6 == 0:
            k, item = items[(i // 6) % len(items)]
            piece = list(item)
            if k == 50:
                piece = piece[70:260]
            elif i % 12 == 0:
                piece = [w.upper() + rng.choice(["", ",", "!"]) for w in piece]
            elif i % 18 == 0:
                # A paraphrase: some words replaced, the end as it was.
                piece = [rng.choice(words) if rng.random() < 0.25 and n < len(piece) - 9 else w for n, w in enumerate(piece)]
            at = rng.randint(0, len(body))
            body[at:at] = piece
            truth.add((i, k))
        rows.append((i, " ".join(body)))
    return rows, [(k, " ".join(w)) for k, w in items], truth


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    rows, items, truth = _leaky()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["share"] for r in decontamination.leaks(docs, benchmark).collect()}
    assert set(got) == truth
    left = decontamination.clean_documents(docs, benchmark).select("doc_id").collect()
    assert {r[0] for r in left} == {i for i, _ in rows} - {i for i, _ in truth}


def test_leaks_in_blocks_and_with_answers(spark, monkeypatch):
    rows, items, truth = _leaky(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(decontamination, "BLOCK", 8)
    benchmark = spark.createDataFrame([(k, t, " ".join(t.split()[-4:])) for k, t in items], "item_id long, text string, answer string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, benchmark, answer_col="answer").collect()}
    assert got == truth


def test_decontamination_edge_cases(spark):
    rows, items, _ = _leaky()
    odd = [(None, items[0][1]), (900, None), (901, ""), (902, "..."), (903, "filler " * 60_000 + items[1][1]), (904, items[2][1]), (904, items[2][1])]
    docs = spark.createDataFrame(rows[:20] + odd, "doc_id long, text string").withColumns({"item_id": F.lit(1), "share": F.lit("s"), "_text": F.lit(0)})
    benchmark = spark.createDataFrame(items + [(60, None), (61, ""), (None, "x y"), items[0], (99, items[0][1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, benchmark).collect()}
    assert {(None, 0), (None, 99), (903, 1), (904, 2)} <= got and not {i for i, _ in got} & {900, 901, 902}
    assert decontamination.clean_documents(docs, benchmark).columns == docs.columns
    assert decontamination.leaks(docs, benchmark.limit(0)).count() == 0
    assert decontamination.clean_documents(docs, benchmark.limit(0)).count() == docs.count()
    assert decontamination.leaks(docs.limit(0), benchmark).count() == 0


def _paraphrases(replaced, seed):
    """60 items, 300 invented texts, 60 of which hold an item with a share of its words replaced, anywhere; in order at least half stay."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(2500)]
    common = ["the", "of", "and", "in", "to"]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]
    items = [text(rng.randint(25, 60)) for _ in range(60)]
    rows, truth = [], set()
    for i in range(300):
        body = text(rng.randint(20, 200))
        if i % 5 == 0:
            item = items[i // 5]
            gone = set(rng.sample(range(len(item)), int(replaced * len(item))))
            body[len(body) // 2 : len(body) // 2] = [rng.choice(words) if n in gone else w for n, w in enumerate(item)]
            truth.add((i, i // 5))
        rows.append((i, " ".join(body)))
    return rows, [(k, " ".join(w)) for k, w in enumerate(items)], truth


@pytest.mark.parametrize("replaced", [0.15, 0.25, 0.35, 0.45])
def test_recall_of_paraphrases(spark, replaced):
    rows, items, truth = _paraphrases(replaced, int(100 * replaced))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {tuple(r)[:2] for r in decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & truth) >= 0.9 * len(truth), len(got & truth) / len(truth)
    assert got <= truth


def test_heaviest_subsequence():
    import numpy as np

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        weight = [rng.random() for _ in a]
        table = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + weight[i] if x == y else 0)
        got = decontamination.heaviest_subsequence(np.array(a, dtype=np.uint64), np.array(weight), np.array(b, dtype=np.uint64))
        assert got == pytest.approx(table[-1][-1])


def test_common_subsequence():
    import numpy as np

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_subsequence(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)) == table[-1][-1]


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages_against_plain_restatements(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, sf_dir)
        after = out.collect()
        ids = Counter(r["doc_id"] for r in after)
        if name != "mixing":
            assert out.schema.names == docs.schema.names and max(ids.values()) == 1
        if name == "quality_classifier":
            gone = {r["doc_id"] for r in before} - set(ids)
            assert gone and all(labels.get(i, 0) == 0 for i in gone)
            bad = {i for i, q in labels.items() if q == 0}
            assert len(bad & set(ids)) <= 0.2 * len(bad)
        if name == "line_dedup":
            want = brute.line_dedup([(r["doc_id"], r["text"]) for r in before])
            assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in after) == [(i, t, len(t)) for i, _, _, t in want]
        if name == "near_dedup":
            want = brute.near_copies([(r["doc_id"], r["text"]) for r in before], 5)
            assert set(ids) == {i for i, (_, c) in want.items() if i == c}
        if name == "decontamination":
            assert set(ids) == {r["doc_id"] for r in before if not any(t in r["text"] for t in items)}
        if name == "mixing":
            size = {r["doc_id"]: len(brute.WORD.findall(r["text"])) for r in before}
            total = sum(n * size[i] for i, n in ids.items())
            assert max(ids.values()) <= 2 and total == pytest.approx(1.5 * sum(size.values()), rel=0.05)
            assert sorted(r["copy"] for r in after if ids[r["doc_id"]] == 2)[:1] == [1]
        docs = spark.createDataFrame(after, out.schema)


def test_pipeline_runs_as_a_query(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"] and out.count() > 0


def test_batches_without_a_benchmark_word_have_the_same_types(spark):
    """The sums of the Gram matrix stay fractions where a batch of the task has nothing to sum."""
    (piece,) = decontamination.pieces(pa.array(["alpha beta"]), lower=True, gaps=decontamination.NOT_ALNUM)
    vocabulary = decontamination.Vocabulary(decontamination.word_hashes(piece))
    texts = ["alpha beta alpha", "nothing here", "", "beta and alpha", "nothing"]
    docs = spark.createDataFrame([(t,) for t in texts], "_text string").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = {(r["row"], r["col"]): r["value"] for r in decontamination.gram(docs, vocabulary).collect()}
        split = decontamination.gram(docs.where("_text like '%nothing%'"), vocabulary).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert split == 0 and got == {(r["row"], r["col"]): r["value"] for r in decontamination.gram(docs, vocabulary).collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0), (1, 1)}
