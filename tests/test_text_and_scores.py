"""Cleaning, dates, sentiment, classes and highlights on small tables."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from voxmill.config import ALTERNATE_LABELS, DEFAULT_LEXICON, Config
from voxmill.errors import ContractMismatch, RowGateError
from voxmill.functions.dates import bucket_label, parse_date
from voxmill.functions.numbers import percent_ints
from voxmill.operators import cleaning, sentiment, themes
from voxmill.operators.highlight import highlight_terms

DATES = [
    ("2026-7-1", dt.date(2026, 7, 1)),
    ("2026/07/01", dt.date(2026, 7, 1)),
    ("01-07-2026", dt.date(2026, 7, 1)),
    ("07/31/2026", dt.date(2026, 7, 31)),
    ("31/12/2026", None),
    ("2026-07-01T10:20:30+05:30", dt.date(2026, 7, 1)),
    ("2026-07-01T23:59:59Z", dt.date(2026, 7, 1)),
    ("2026-07-01 10:20:30.123456", dt.date(2026, 7, 1)),
    ("20260701", dt.date(2026, 7, 1)),
    ("  2026-07-01 ", dt.date(2026, 7, 1)),
    ("2026-02-30", None),
    ("2026-07-01T25:00:00", None),
    ("nan", None),
    ("NaT", None),
    ("", None),
    (None, None),
    ("soon", None),
]


def test_parse_date(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(DATES)], "i int, s string")
    got = {r["i"]: r["d"] for r in df.select("i", parse_date(F.col("s")).alias("d")).collect()}
    assert [got[i] for i in range(len(DATES))] == [d for _, d in DATES]


def test_iso_labels_around_new_year(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),), (dt.date(2021, 1, 3),)], "d date")
    assert [r[0] for r in df.select(bucket_label(F.col("d"), "weekly")).collect()] == ["2025-W01", "2020-W53"]


def test_clean_text_strips_all_white_space_and_numbers_rows(spark):
    rows = [(0, "  a \n"), (1, " \t　"), (2, None), (3, "b")]
    df = cleaning.assign_rows(cleaning.clean_text(spark.createDataFrame(rows, "source_row long, review_text string")))
    assert sorted((r["row"], r["source_row"], r["review_text"]) for r in df.collect()) == [(0, 0, "a"), (1, 3, "b")]


def test_quality_warns_when_most_dates_are_bad(spark):
    rows = [("a", "x", None), ("b", "y", None), ("c", "2026-01-01", None), (" ", "z", None)]
    df = spark.createDataFrame(rows, "review_text string, date string, rating string")
    q = cleaning.data_quality(df).first()
    assert (q["rows_received"], q["rows_analyzed"], q["rows_dropped"]) == (4, 3, 1)
    assert q["dropped_reasons"] == {"empty_text": 1} and q["warnings"] == [cleaning.DATE_WARNING]
    assert cleaning.date_quality(df).first()["unparseable"] == 3


@pytest.mark.parametrize("n,code", [(0, "NO_VALID_REVIEWS"), (3, "TOO_FEW_ROWS"), (200, "TOO_MANY_ROWS")])
def test_row_gates(n, code):
    with pytest.raises(RowGateError) as err:
        cleaning.gate_rows(n, Config(max_rows=100))
    assert err.value.code == code


def test_coercion_of_engine_rows(spark):
    df = spark.createDataFrame([(1, None, float("nan"), "2026-07-01T10:00")], "row int, text string, rating double, date string")
    r = cleaning.coerce_scored(df).first()
    assert (r["text"], r["sentiment_score"], r["sentiment_label"], r["rating"]) == ("", 0.0, "Neutral", None)
    assert r["date"] == dt.date(2026, 7, 1)
    with pytest.raises(ContractMismatch):
        cleaning.coerce_scored(df.drop("row"))
    t = cleaning.coerce_themes(spark.createDataFrame([("theme-1", "")], "theme_id string, general_class string")).first()
    assert (t["general_class"], t["sentiment"], t["count"], t["representative_indices"]) == ("Other", "Neutral", 0, [])


def test_empty_row_list_keeps_nothing(spark):
    df = spark.range(5).withColumnRenamed("id", "row")
    assert cleaning.filter_reviews(df, rows=[]).count() == 0
    assert cleaning.filter_reviews(df, rows=[1, 3, 9]).count() == 2
    assert cleaning.filter_reviews(df, rows=df.where("row > 2")).count() == 2


def test_percentages_always_sum_to_100(spark):
    rng = random.Random(5)
    rows = [(1, 1, 1), (25, 20, 55), (0, 0, 7), (333, 333, 334), (0, 0, 0)] + [
        tuple(rng.randrange(200) for _ in range(3)) for _ in range(300)
    ]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    got = df.select("a", "b", "c", F.array(*percent_ints([F.col(c) for c in "abc"])).alias("p")).collect()
    for r in got:
        counts, total = [r["a"], r["b"], r["c"]], r["a"] + r["b"] + r["c"]
        if not total:
            assert r["p"] == [0, 0, 0]
            continue
        floors = [c * 100 // total for c in counts]
        order = sorted(range(3), key=lambda i: (-(counts[i] * 100 % total), i))
        for i in order[: 100 - sum(floors)]:
            floors[i] += 1
        assert r["p"] == floors and sum(r["p"]) == 100


@pytest.mark.parametrize(
    "score,engine,other",
    [
        (0.25, "Positive", "Positive"),
        (0.2499, "Neutral", "Positive"),
        (0.15, "Neutral", "Neutral"),
        (-0.15, "Neutral", "Neutral"),
        (-0.25, "Negative", "Negative"),
        (-0.6, "Strongly Negative", "Negative"),
        (-0.75, "Strongly Negative", "Strongly Negative"),
    ],
)
def test_labels(spark, score, engine, other):
    row = spark.range(1).select(
        sentiment.label_sentiment(F.lit(score)), sentiment.label_sentiment(F.lit(score), ALTERNATE_LABELS)
    ).first()
    assert tuple(row) == (engine, other)


def test_overall_label_edges_and_empty_summary(spark):
    got = [
        spark.range(1).select(sentiment.overall_label(F.lit(v)), sentiment.overall_label(F.lit(v), ALTERNATE_LABELS)).first()
        for v in (-10.0, 10.0, 0.0)
    ]
    assert [tuple(r) for r in got] == [
        ("Negative Trend", "Mixed Trend"),
        ("Positive Trend", "Mixed Trend"),
        ("Mixed Trend", "Mixed Trend"),
    ]
    empty = spark.createDataFrame([], "sentiment_label string, sentiment_score double")
    s = sentiment.summarize_sentiment(empty).first()
    assert (s["total_reviews"], s["net_sentiment_score"], s["mean_score"]) == (0, 0.0, 0.0)
    assert tuple(sentiment.sentiment_percent(empty).first()) == (0, 0, 0)


def test_lexicon_rules(spark):
    texts = ["good", "very good", "not good", "nothing here", "", "slightly bad"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r["sentiment_score"] for r in sentiment.score_lexicon(df, DEFAULT_LEXICON).collect()}

    def norm(s):
        return round(s / (s * s + 15) ** 0.5, 4)

    assert got["good"] == norm(1.9)
    assert got["very good"] == norm(1.9 + 0.293)
    assert got["not good"] == norm(1.9 * -0.74)
    assert got["nothing here"] == got[""] == 0.0
    assert got["slightly bad"] == norm(-2.5 + 0.293)


def test_external_scorer_runs_once_per_distinct_text(spark):
    seen = spark.sparkContext.accumulator(0)

    def scorer():
        def predict(texts):
            seen.add(len(texts))
            return [{"LABEL_2": 0.9, "LABEL_0": len(t) / 10} for t in texts]

        return predict

    df = spark.createDataFrame([(i, "aa" if i % 3 else f"t{i}") for i in range(90)], "id long, text string")
    scored = sentiment.score_distinct(df, lambda d: sentiment.score_external(d, scorer), "id")
    rows = scored.collect()
    assert len(rows) == 90 and all(abs(r["sentiment_score"] - round(0.9 - len(r["text"]) / 10, 4)) < 1e-9 for r in rows)
    assert seen.value == df.select("text").distinct().count()


def test_classes(spark):
    texts = ["The STREAM buffers on 1080p", "upstream", "plan to pay, then cancel the app crash", "", "play", "player", "café bug"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: (r["general_class"], r["confidence"]) for r in themes.classify_keywords(df).collect()}
    assert got["The STREAM buffers on 1080p"] == ("Streaming/Playback", 1.0)
    assert got["upstream"] == got[""] == got["player"] == ("Other", 0.0)
    assert got["plan to pay, then cancel the app crash"] == ("Billing & Subscriptions", 0.75)
    assert got["play"][0] == "Streaming/Playback" and got["café bug"][0] == "Performance & Crashes"


def test_patterns_of_classes_do_not_fill_one_generated_method(spark):
    rows = spark.range(3).selectExpr("concat('video ', id) AS text")
    stages = themes.classify_keywords(rows)._jdf.queryExecution().debug().codegenToSeq()
    # The JVM leaves methods above 8,000 bytes to its interpreter.
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000


def test_pattern_heads_are_implied():
    for patterns in themes.CLASS_PATTERNS.values():
        for p in patterns:
            head = themes.literal_head(p)
            assert all(c.isalpha() or c == " " for c in head)
    assert themes.literal_head(r"\bloads?\b") == "load" and themes.literal_head(r"\b(?:1080p|720p)\b") == ""
    assert themes.literal_head(r"\bforce.?clos") == "force" and themes.literal_head(r"\bhome screen") == "home screen"


def test_custom_classes_use_their_words(spark):
    cfg = Config(categories=("Parking lots", "Food"))
    df = spark.createDataFrame([("the parking was full",), ("foods",)], "text string")
    assert [r["general_class"] for r in themes.classify_keywords(df, cfg=cfg).collect()] == ["Parking lots", "Food"]


def test_external_classifier_has_a_floor(spark):
    def classifier():
        return lambda texts, categories: [(categories[1], 0.29 if "low" in t else 0.3) for t in texts]

    df = spark.createDataFrame([("low",), ("high",)], "text string")
    got = {r["text"]: (r["general_class"], r["confidence"]) for r in themes.classify_external(df, classifier).collect()}
    assert got == {"low": ("Other", 0.29), "high": ("Comments & Social", 0.3)}


def test_highlights_count_utf16_units_and_respect_tags(spark):
    lexicon = {"love": 3.2, "bad": -2.5, "fair": 1.0, "waste of time": -2.6, "time": 2.0, "redacted": -3.0}
    text = "\U0001f600 I loved it \U0001f600 a Waste of Time, fair but BAD [PII_REDACTED] bads"
    row = highlight_terms(spark.createDataFrame([(text,)], "text string"), lexicon).first()
    got = [(h["start"], h["end"], h["polarity"], h["term"]) for h in row["highlights"]]
    units = text.encode("utf-16-le")
    assert [t for *_, t in got] == ["loved", "Waste of Time", "BAD", "bads"]
    assert [p for _, _, p, _ in got] == ["positive", "negative", "negative", "negative"]
    for start, end, _, term in got:
        assert units[2 * start : 2 * end].decode("utf-16-le") == term


def test_highlights_of_nothing(spark):
    df = spark.createDataFrame([("",), (None,), ("plain",)], "text string")
    assert all(r["highlights"] == [] for r in highlight_terms(df, {"love": 3.0}).collect())
