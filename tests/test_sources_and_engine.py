"""Files, stored results, the whole run, and streams that must equal batch."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from voxmill.config import Config
from voxmill.errors import ContractMismatch, InvalidFile, MissingColumn, NoDateData, NotFound, RowGateError
from voxmill.operators import analytics, redaction, runs, scale, themes
from voxmill.operators.governance import governance
from voxmill.plans import queries_streams
from voxmill.plans.engine import AnalysisEngine, BackEnds, run_and_store
from voxmill.plans.serving import RunReader
from voxmill.plans.views import TEMPLATES, uploads
from voxmill.sources.dimensions import read_keywords, read_labels, read_lexicon
from voxmill.sources.manifest import file_manifest
from voxmill.sources.reviews import file_dialects, map_columns, read_reviews, require_columns, sniff_dialect
from voxmill.sources.tables import ResultStore, export_json
from voxmill.streaming import streams

CFG = Config()


def _write(path, data: bytes) -> str:
    path.write_bytes(data)
    return str(path)


def test_read_csv_dialects(spark, tmp_path):
    semi = _write(tmp_path / "a.csv", "﻿Review; Date ;Stars\n\"one; \"\"quoted\"\"\nline\";2026-07-01;5\nNA;2026-07-02;x\n".encode())
    rows = read_reviews(spark, semi).collect()
    assert [(r["source_row"], r["review_text"], r["date"], r["rating"]) for r in rows] == [
        (0, 'one; "quoted"\nline', "2026-07-01", "5"),
        (1, None, "2026-07-02", "x"),
    ]
    latin = _write(tmp_path / "b.csv", "content\tdate\ncaf\xe9\t2026-07-01\n".encode("latin-1"))
    assert read_reviews(spark, latin).first()["review_text"] == "café"


def test_sample_may_end_inside_a_character():
    sample = ("text,date\n" + "é" * 50).encode()[:-1]
    assert sniff_dialect(sample, complete=False)[0] == "UTF-8"
    assert sniff_dialect("text,date\nä".encode("latin-1"), complete=True)[0] == "ISO-8859-1"
    with pytest.raises(InvalidFile):
        sniff_dialect(b" \n", complete=True)


def test_columns(spark):
    df = spark.createDataFrame([("a", "b", "c", "d")], [" Comment", "TEXT", "created_at", "score"])
    assert map_columns(df) == {"review_text": " Comment", "date": "created_at", "rating": "score"}
    with pytest.raises(MissingColumn) as err:
        require_columns(df.select("score"))
    assert err.value.details["missing"] == ["review_text", "date"]
    assert require_columns(df.select("TEXT"), require_date=False)["date"] is None


def test_manifest(spark, tmp_path):
    _write(tmp_path / "ok.csv", b"text,date\na,2026-01-01\n")
    _write(tmp_path / "zip.csv", b"PK\x03\x04....")
    _write(tmp_path / "empty.csv", b"")
    _write(tmp_path / "blank.csv", b"\xef\xbb\xbf \n\t")
    _write(tmp_path / "doc.pdf", b"%PDF")
    _write(tmp_path / "fake.xlsx", b"abc")
    _write(tmp_path / "big.csv", b"x" * 200)
    got = {os.path.basename(r["path"]): r for r in file_manifest(spark, str(tmp_path), Config(max_file_bytes=100)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "ok.csv": "OK",
        "zip.csv": "INVALID_FILE_FORMAT",
        "empty.csv": "EMPTY_FILE",
        "blank.csv": "EMPTY_FILE",
        "doc.pdf": "INVALID_FILE_FORMAT",
        "fake.xlsx": "INVALID_FILE_FORMAT",
        "big.csv": "FILE_TOO_LARGE",
    }
    assert len(got["ok.csv"]["sha256"]) == 64 and got["big.csv"]["sha256"] is None


def test_dimensions(spark, tmp_path):
    lex = _write(tmp_path / "lex.csv", b"term,valence\nGood,1.9\nbad,-2.5\nodd,x\n")
    assert read_lexicon(spark, lex) == {"good": 1.9, "bad": -2.5}
    keys = _write(tmp_path / "k.csv", b"general_class,pattern\nA,\\bfoo\nB,\\bbar\nA,\\bbaz\n")
    assert read_keywords(spark, keys) == {"A": ["\\bfoo", "\\bbaz"], "B": ["\\bbar"]}
    spark.createDataFrame([("t", "Positive")], "text string, sentiment string").write.parquet(str(tmp_path / "l"))
    with pytest.raises(ContractMismatch):
        read_labels(spark, str(tmp_path / "l"))


def _raw(spark, n=240):
    rows = []
    for i in range(n):
        text = TEMPLATES[i % 12] + (" Mail jo@example.com" if i % 20 == 0 else "") + f" No {i % 7}"
        rows.append((i, "" if i % 30 == 29 else text, f"2026-07-{i % 28 + 1:02d}", str(i % 5 + 1)))
    return spark.createDataFrame(rows, "source_row long, review_text string, date string, rating string")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    labelled = spark.createDataFrame(
        [("Playback is terrible", "Negative", "Streaming/Playback"), ("I love the menu", "Positive", "UI/UX & Navigation")],
        "text string, sentiment string, category string",
    )
    job = run_and_store(
        spark, _raw(spark), root, "job-1", AnalysisEngine(CFG), baseline_path=f"{root}/baseline", labelled=labelled
    )
    return ResultStore(spark, root), job


def test_run_invariants(spark, stored):
    store, job = stored
    got = store.read_results(job)
    reviews, theme_rows = got["reviews"].cache(), got["themes"].cache()
    assert reviews.count() == 232
    assert sorted(r["row"] for r in reviews.select("row").collect()) == list(range(232))
    assert reviews.select("source_row").distinct().count() == 232
    assert themes.theme_invariants(reviews, theme_rows).count() == 0
    assert 0 < theme_rows.count() <= CFG.max_themes
    sizes = {r["theme_id"]: r["count"] for r in theme_rows.collect()}
    assert [sizes[f"theme-{i + 1}"] for i in range(len(sizes))] == sorted(sizes.values(), reverse=True)
    assert reviews.where(F.col("text").contains("jo@example.com")).count() == 0
    assert redaction.leak_audit(reviews, ["jo@example.com"], ["text"]).first()["rows_found"] == 0
    by_row = {r["row"]: r["theme_id"] for r in reviews.collect()}
    for t in theme_rows.collect():
        assert 1 <= len(t["representative_indices"]) <= 5
        assert all(by_row[i] == t["theme_id"] for i in t["representative_indices"])


def test_run_row_result_and_audit(spark, stored):
    store, job = stored
    run = store.runs().first()
    assert (run["status"], run["rows_received"], run["rows_analyzed"], run["rows_dropped"]) == ("COMPLETED", 240, 232, 8)
    assert run["dropped_reasons"] == {"empty_text": 8}
    result = store.read_results(job)["result"].first()
    assert result["total_reviews"] == 232 and result["pii_redacted_count"] == 12
    assert result["drift_status"] == "Baseline initialized" and result["model_validation_accuracy"] == "100.0%"
    assert result["positive_pct"] + result["neutral_pct"] + result["negative_pct"] == 100
    events = [r["event"] for r in runs.audit_trail(store.audit(), job).collect()]
    assert events == ["JOB_STARTED", "PII_REDACTION_COMPLETED", "JOB_COMPLETED"]


def test_reads_over_a_stored_run(spark, stored, tmp_path):
    store, job = stored
    got = store.read_results(job)
    theme_list = analytics.list_themes(got["themes"], 232)
    first = theme_list.first()
    assert first["rank"] == 1 and first["priority_score"] >= 0
    samples = analytics.sample_verbatims(got["reviews"], got["themes"])
    shown = analytics.with_samples(theme_list, samples).collect()
    assert all(1 <= len(t["sample_verbatims"]) <= 5 for t in shown)
    trend = analytics.trends(got["reviews"], "weekly").collect()
    assert sum(t["review_count"] for t in trend) + analytics.trend_excluded(got["reviews"]).first()[0] == 232
    with pytest.raises(NoDateData):
        analytics.trends(got["reviews"].withColumn("date", F.lit(None).cast("date")), "weekly", require_dates=True)
    page = analytics.verbatims(got["reviews"], first["theme_id"], page=999)
    assert page.count() == 0
    with pytest.raises(ValueError):
        analytics.verbatims(got["reviews"], first["theme_id"], limit=101)
    out = str(tmp_path / "json")
    export_json(got["result"].drop("job_id"), theme_list.withColumn("position", F.col("rank")), out, got["reviews"])
    document = spark.read.json(f"{out}/document").first()
    assert document["total_reviews"] == 232 and len(document["themes"]) == len(shown)
    assert spark.read.json(f"{out}/reviews").count() == 232


def test_governance_block(spark, stored):
    engine = AnalysisEngine(CFG)
    totals = redaction.pii_totals(redaction.redact(spark.createDataFrame([("a@b.co",)], "text string")))
    one = spark.createDataFrame([("Low (0.01)",)], "display string")
    quality = spark.createDataFrame([(["w", "w"],)], "warnings array<string>")
    row = governance(totals, one, one, quality, engine.info()).first()
    assert row["pii"]["total_redacted"] == 1 and row["pii"]["by_type"]["email"] == 1
    assert row["data_quality"]["warnings"] == ["w"] and row["models"]["external_data_egress"] is False


def test_delete_keeps_the_audit_log(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    now = dt.datetime(2026, 7, 1)
    for job in ("a", "b"):
        rows = spark.createDataFrame([(job, 0)], "job_id string, row long")
        run = spark.createDataFrame([(job, "COMPLETED")], "job_id string, status string")
        store.write_results(rows, spark.createDataFrame([(job, "theme-1")], "job_id string, theme_id string"), run, run)
        store.record(job, now, "JOB_COMPLETED")
    store.delete_run("a", now, "retention")
    with pytest.raises(NotFound):
        store.read_results("a")
    assert store.read_results("b")["reviews"].count() == 1
    trail = [(r["event"], r["details"].get("reason")) for r in runs.audit_trail(store.audit(), "a").collect()]
    assert sorted(trail, key=str) == [("JOB_COMPLETED", None), ("JOB_DELETED", "retention")]


def test_failed_run_is_recorded(spark, tmp_path):
    few = _raw(spark, 5)
    with pytest.raises(RowGateError):
        run_and_store(spark, few, str(tmp_path), "bad", AnalysisEngine(CFG))
    run = ResultStore(spark, str(tmp_path)).runs().first()
    assert (run["status"], run["error_code"]) == ("FAILED", "TOO_FEW_ROWS")


def test_plugged_in_models(spark):
    def scorer():
        return lambda texts: [1.0 if "love" in t else -1.0 for t in texts]

    def encoder():
        return lambda texts: [[float(len(t)), float(t.count("e")), 1.0] for t in texts]

    def classifier():
        return lambda texts, categories: [(categories[len(t) % 2], 0.9) for t in texts]

    engine = AnalysisEngine(CFG, BackEnds(scorer=scorer, encoder=encoder, classifier=classifier))
    done = engine.run(_raw(spark, 120))
    assert {r[0] for r in done.reviews.select("sentiment_score").distinct().collect()} == {1.0, -1.0}
    assert engine.info()["embeddings"] == "model" and done.themes.count() > 0


def test_same_result_for_any_partitioning(spark):
    raw = _raw(spark, 90)
    engine = AnalysisEngine(CFG)
    one = {r["source_row"]: (r["row"], r["text"], r["sentiment_score"]) for r in engine.prepare(raw.coalesce(1)).collect()}
    many = {r["source_row"]: (r["row"], r["text"], r["sentiment_score"]) for r in engine.prepare(raw.repartition(8)).collect()}
    assert one == many


def test_dedupe_stream_is_first_per_text(spark, tmp_path):
    rows = [(f"t{i % 4}", dt.datetime(2026, 7, 1, i)) for i in range(12)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "text string, ts timestamp").write.parquet(src)
    stream = streams.read_stream(spark, src, spark.read.parquet(src).schema)
    out = str(tmp_path / "out")
    streams.run_available(streams.dedupe_stream(stream, "text", "ts"), str(tmp_path / "cp"), streams.batch_writer(out))
    assert spark.read.parquet(out).count() == 4


def test_trend_stream_weeks_start_on_monday(spark, tmp_path):
    rows = [(dt.datetime(2026, 7, 6, 1) + dt.timedelta(days=i), 0.5, "Positive") for i in range(21)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "ts timestamp, sentiment_score double, sentiment_label string").write.parquet(src)
    stream = streams.read_stream(spark, src, spark.read.parquet(src).schema)
    out = str(tmp_path / "out")
    streams.run_available(
        streams.trend_stream(stream), str(tmp_path / "cp"), lambda b, _: b.write.mode("overwrite").parquet(out), "complete"
    )
    got = sorted((r["period_start"], r["review_count"]) for r in spark.read.parquet(out).collect())
    assert got == [(dt.date(2026, 7, 6), 7), (dt.date(2026, 7, 13), 7), (dt.date(2026, 7, 20), 7)]


# ---------------------------------------------------------------- mixed files, commits, scratch
def test_each_file_has_its_own_dialect(spark, tmp_path):
    _write(tmp_path / "a.csv", b"review,date,stars\none,2026-07-01,5\n")
    _write(tmp_path / "b.csv", "Stars;Comment;Date\n4;zw\xf6lf;2026-07-02\n".encode("latin-1"))
    _write(tmp_path / "c.csv", "date\tfeedback\n2026-07-03\tdrüben\n".encode())
    rows = read_reviews(spark, str(tmp_path)).orderBy("source_row").collect()
    assert [(r["source_row"], r["review_text"], r["date"], r["rating"]) for r in rows] == [
        (0, "one", "2026-07-01", "5"),
        (1, "zwölf", "2026-07-02", "4"),
        (2, "drüben", "2026-07-03", None),
    ]


def test_a_file_that_turns_from_utf8_is_unreadable(spark, tmp_path):
    _write(tmp_path / "late.csv", b"review,date\n" + b"plain,2026-07-01\n" * 3000 + "sp\xe4t,2026-07-02\n".encode("latin-1"))
    _write(tmp_path / "good.csv", b"review,date\nfine,2026-07-01\n")
    _write(tmp_path / "none.csv", b" \n")
    status = {os.path.basename(r["path"]): r["status"] for r in file_dialects(spark, str(tmp_path)).collect()}
    assert status == {"late.csv": "UNREADABLE_FILE", "good.csv": "OK", "none.csv": "EMPTY_FILE"}
    with pytest.raises(InvalidFile) as err:
        read_reviews(spark, str(tmp_path))
    assert err.value.code in ("UNREADABLE_FILE", "EMPTY_FILE") and len(err.value.details["files"]) == 2
    assert [r["review_text"] for r in read_reviews(spark, str(tmp_path), on_bad="skip").collect()] == ["fine"]
    with pytest.raises(InvalidFile) as err:
        read_reviews(spark, str(tmp_path / "missing*.csv"))
    assert err.value.code == "FILE_NOT_FOUND"


def test_store_refuses_ids_that_are_no_plain_names(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    for bad in ("a:b", "../x", "", "a/b", "%41", ".hidden"):
        with pytest.raises(ContractMismatch):
            store.delete_run(bad)
    with pytest.raises(NotFound) as err:
        store.delete_run("nobody")
    assert err.value.code == "JOB_NOT_FOUND"
    store.put_run(spark.createDataFrame([("busy", "PROCESSING")], "job_id string, status string"))
    with pytest.raises(NotFound) as err:
        store.delete_run("busy")
    assert err.value.code == "JOB_PROCESSING"


def test_a_run_leaves_no_scratch_and_publishes_its_baseline_at_the_end(spark, tmp_path):
    root = scale.checkpoint_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    with pytest.raises(RowGateError):
        run_and_store(spark, _raw(spark, 5), str(tmp_path), "r", AnalysisEngine(CFG), baseline_path=str(tmp_path / "base"))
    assert not os.path.exists(tmp_path / "base")
    for _ in range(2):
        # The run that makes the baseline makes it again when it is repeated.
        run_and_store(spark, _raw(spark, 120), str(tmp_path), "r", AnalysisEngine(CFG), baseline_path=str(tmp_path / "base"))
        assert ResultStore(spark, str(tmp_path)).read_results("r")["result"].first()["drift_status"] == "Baseline initialized"
    assert not [d for d in set(os.listdir(root)) - before if d.startswith("scope-")]


def test_reader_of_a_stored_run(spark, stored):
    store, job = stored
    reader = RunReader(store, CFG)
    listed, facets, totals = reader.themes(job)
    first = listed.first()
    header, page = reader.verbatims(job, first["theme_id"], limit=3)
    assert header["total"] == first["count"] and page.count() == 3 and "highlights" in page.columns
    assert sum(r["count"] for r in facets.collect()) + totals["unassigned_count"] == 232
    assert reader.trends(job, "weekly").count() > 0
    with pytest.raises(NotFound) as err:
        reader.verbatims(job, "theme-999")
    assert err.value.code == "THEME_NOT_FOUND"
    row, trail = reader.governance(job)
    got = row.first()
    assert got["pii"]["total_redacted"] == 12 and got["drift"]["status"] == "Baseline initialized"
    assert got["validation"]["validation"]["display"] == "100.0%" and trail.count() == 3
    assert reader.summary(job).first()["summary"]["total_reviews"] == 232


def test_stream_goes_on_after_a_bad_batch_and_after_a_restart(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = "\n".join(f"{TEMPLATES[i % 12]} {i},2026-07-0{i % 9 + 1}" for i in range(30))
    for k, body in enumerate(("review,date\n" + lines, "review,date\nfew,2026-07-01", "nothing,here\n1,2", "Review;Date\n" + lines.replace(",2026", ";2026"))):
        _write(source / f"{k}.csv", body.encode())
        os.utime(source / f"{k}.csv", (1_700_000_000 + 100 * k, 1_700_000_000 + 100 * k))

    def drain():
        streams.ingest_stream(spark, str(source), str(tmp_path / "store"), str(tmp_path / "cp"))
        return {r["job_id"]: (r["status"], r["error_code"], r["rows_analyzed"]) for r in ResultStore(spark, str(tmp_path / "store")).runs().collect()}

    want = {
        "batch-0": ("COMPLETED", None, 30),
        "batch-1": ("FAILED", "TOO_FEW_ROWS", None),
        "batch-2": ("FAILED", "MISSING_COLUMN", None),
        "batch-3": ("COMPLETED", None, 30),
    }
    assert drain() == want
    _write(source / "4.csv", ("review,date\nNA,2026-07-01\n" + lines).encode())
    assert drain() == want | {"batch-4": ("COMPLETED", None, 30)}


def test_uploads_are_written_and_ingested_as_many_files(spark, sf_dir, tmp_path, monkeypatch):
    df = spark.range(100).selectExpr("concat(' text ', id) AS review_text").repartition(4)
    queries_streams.write_csv(df, str(tmp_path / "many"), ";")
    assert len(list((tmp_path / "many").glob("*.csv"))) == 4
    # All files of one layout are one batch and one run.
    monkeypatch.setattr(queries_streams, "uploads", lambda *a: uploads(*a).repartition(4))
    got = {r["half"]: (r["status"], r["rows_received"]) for r in queries_streams.ingest_stream(spark, sf_dir).collect()}
    rows = uploads(spark, sf_dir).where("source_row > 0")
    want = {half: ("COMPLETED", rows.where(f"source_row % 2 = {i}").count()) for i, half in enumerate(("even", "odd"))}
    assert got == want | {"none": ("FAILED", 0)}


def test_uploads_to_ingest_are_dealt_over_many_files(spark, sf_dir, monkeypatch):
    class Seen(Exception):
        pass

    def write(df, path, sep):
        raise Seen(df.rdd.getNumPartitions())

    monkeypatch.setattr(queries_streams, "write_csv", write)
    with pytest.raises(Seen) as seen:
        queries_streams.ingest_stream(spark, sf_dir)
    assert seen.value.args[0] >= 4 * spark.sparkContext.defaultParallelism
