"""Kept aggregates and the page index of a store: equal to scans, gone with their run, and read without the reviews."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from voxmill.operators import analytics
from voxmill.plans.serving import RunReader
from voxmill.sources import tables
from voxmill.sources.tables import ResultStore

LABELS = ["Positive", "Neutral", "Negative", "Strongly Negative"]
NOW = datetime.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = spark.range(900).select(
        F.col("id").alias("row"), F.concat(F.lit("run-"), F.col("id") % 3).alias("job_id"), F.concat(F.lit("text "), F.col("id")).alias("text"),
        F.round(F.sin("id"), 4).alias("sentiment_score"), F.element_at(F.array(*map(F.lit, LABELS)), (F.col("id") % 4 + 1).cast("int")).alias("sentiment_label"),
        F.when(F.col("id") % 7 != 0, F.when(F.col("id") % 5 == 0, "small").otherwise("theme-1")).alias("theme_id"),
        F.when(F.col("id") % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int"))).alias("date"),
    )
    kept = ResultStore(spark, str(tmp_path_factory.mktemp("kept")), index_from=100, index_bucket=30)
    runs = spark.createDataFrame([(f"run-{i}", "COMPLETED", NOW) for i in range(3)], "job_id string, status string, created_at timestamp")
    themes = rows.select("job_id", "theme_id").where("theme_id is not null").distinct().withColumn("name", F.col("theme_id"))
    kept.write_results(rows, themes, runs.select("job_id", "status"), runs)
    kept.write_results(rows, themes, runs.select("job_id", "status"), runs)  # again: everything replaces itself
    return kept


def scanned(store, *jobs):
    return store._table("reviews_scored", "job_id string, row long, theme_id string, sentiment_label string, sentiment_score double, date date").where(
        F.col("job_id").isin(*jobs)
    )


def test_trends_and_breakdown_equal_scans(store):
    reader = RunReader(store)
    jobs = ["run-0", "run-1", "run-2"]
    for interval in ("weekly", "monthly"):
        for theme in (None, "theme-1", "nowhere"):
            assert reader.trends_of_runs(interval, theme).collect() == analytics.trends(scanned(store, *jobs), interval, theme).collect()
    assert reader.breakdown_of_runs().first().asDict() == analytics.sentiment_breakdown(scanned(store, *jobs)).first().asDict()
    assert reader.breakdown_of_runs(["run-1"]).first().asDict() == analytics.sentiment_breakdown(scanned(store, "run-1")).first().asDict()
    assert not [f for f in reader.trends_of_runs("weekly").inputFiles() if "reviews_scored" in f]


@pytest.mark.parametrize("sort", analytics.VERBATIM_SORTS)
@pytest.mark.parametrize(("page", "limit", "label"), [(1, 20, None), (8, 15, None), (13, 10, None), (400, 10, None), (3, 50, "Positive")])
def test_pages_equal_a_sort(store, sort, page, limit, label):
    header, shown = RunReader(store).verbatims("run-1", "theme-1", page, limit, label, sort)
    rows = scanned(store, "run-1").where("theme_id = 'theme-1'")
    rows = rows.where(F.col("sentiment_label") == label) if label else rows
    want = [r["row"] for r in rows.orderBy(*analytics.verbatim_order(sort)).collect()]
    assert [r["row"] for r in shown.collect()] == want[(page - 1) * limit : page * limit]
    assert header["total"] == len(want)


def test_a_deep_page_opens_the_files_of_its_places(store):
    from voxmill.operators.pages import page_rows

    places = page_rows(store.spark, store.path("verbatim_ranks"), "run-1", "theme-1", "recent", 125, 20, bucket=30)
    assert len(places.inputFiles()) == 1
    assert sorted(r["rank"] for r in places.collect()) == list(range(125, 145))
    assert page_rows(store.spark, store.path("verbatim_ranks"), "run-1", "small", "recent", 0, 5, bucket=30) is None


def test_all_goes_with_the_run(spark, store):
    store.delete_run("run-2", NOW)
    reader = RunReader(store)
    assert reader.breakdown_of_runs().first().asDict() == analytics.sentiment_breakdown(scanned(store, "run-0", "run-1")).first().asDict()
    assert store.partials("run-2").count() == 0
    assert spark.read.parquet(store.path("verbatim_ranks")).where("job_id = 'run-2'").count() == 0


def test_small_buckets_share_files(spark, tmp_path, monkeypatch):
    """A file holds many buckets; a page that lies in two files opens both."""
    from voxmill.operators import pages

    rows = spark.range(1000).selectExpr("'j' AS job_id", "'t' AS theme_id", "'Neutral' AS sentiment_label", "id AS row", "0.5D AS sentiment_score", "DATE '2024-01-01' AS date")
    counts = rows.groupBy("job_id", "theme_id", "sentiment_label").agg(F.count(F.lit(1)).alias("reviews"))
    for file_rows, files in ((1 << 17, 1), (64, 17)):  # two buckets of 30 in a file
        monkeypatch.setattr(pages, "FILE_ROWS", file_rows)
        path = str(tmp_path / str(file_rows))
        pages.write_index(rows, counts, path, from_rows=10, bucket=30, sorts=["recent"])
        assert len(list((tmp_path / str(file_rows) / "job_id=j" / "theme_id=t" / "label=all" / "sort=recent").glob("*/*.parquet"))) == files
        got = pages.page_rows(spark, path, "j", "t", "recent", 50, 25, bucket=30)
        assert sorted(r["rank"] for r in got.collect()) == list(range(50, 75)) and len(got.inputFiles()) == min(files, 2)
        assert pages.page_rows(spark, path, "j", "t", "recent", 5000, 5, bucket=30).count() == 0


@pytest.mark.parametrize("sort", analytics.VERBATIM_SORTS)
def test_places_are_numbered_without_another_sort_of_the_rows(store, sort):
    from voxmill.operators.pages import rank_index

    reviews, partials = store._table("reviews_scored", tables.SCORED), store._table("partials", tables.PARTIALS)
    index = rank_index(reviews, partials, sort, from_rows=1)
    assert "row_number" not in index._jdf.queryExecution().analyzed().toString()
    ranks = {}
    for r in index.collect():
        ranks.setdefault((r.job_id, r.theme_id, r.label), []).append(r["rank"])
    assert ranks and all(sorted(v) == list(range(len(v))) for v in ranks.values())
