"""Cleaning queries over the raw upload view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.operators import cleaning
from voxmill.plans.catalog import query
from voxmill.plans.views import R, U, reviews, table, uploads, wide_texts
from voxmill.sources.manifest import file_manifest

_STRIPPED = "regexp_replace(review_text, '^\\s+|\\s+$', '', 'g')"
_DATE = (
    "CAST(try_strptime(left(date, 19), ['%Y-%m-%d', '%Y/%m/%d', '%d-%m-%Y', '%m/%d/%Y', '%Y-%m-%dT%H:%M:%S']) AS DATE)"
)


@query("clean_reviews", f"WITH {U} SELECT source_row, {_STRIPPED} AS review_text FROM u WHERE {_STRIPPED} <> ''")
def clean_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean_text(uploads(spark, sf_dir)).select("source_row", "review_text")


@query("normalize_dates", f"WITH {U} SELECT source_row, date AS raw_date, {_DATE} AS date FROM u")
def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = uploads(spark, sf_dir).withColumn("raw_date", F.col("date"))
    return cleaning.normalize_dates(raw).select("source_row", "raw_date", "date")


@query(
    "date_quality",
    f"""WITH {U}, d AS (SELECT date <> '' AS given, date <> '' AND {_DATE} IS NULL AS bad FROM u)
    SELECT count(*) FILTER (WHERE given) AS nonempty, count(*) FILTER (WHERE bad) AS unparseable,
           CAST(count(*) FILTER (WHERE bad) * 2 > count(*) FILTER (WHERE given) AS INTEGER) AS n_warnings FROM d""",
)
def date_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = cleaning.date_quality(uploads(spark, sf_dir))
    return quality.select("nonempty", "unparseable", F.size("warnings").alias("n_warnings"))


@query("coerce_rating", f"WITH {U} SELECT source_row, rating AS raw_rating, TRY_CAST(rating AS DOUBLE) AS rating FROM u")
def coerce_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = uploads(spark, sf_dir).withColumn("raw_rating", F.col("rating"))
    return cleaning.coerce_rating(raw).select("source_row", "raw_rating", "rating")


@query(
    "assign_rows",
    f"""WITH {U} SELECT source_row, row_number() OVER (ORDER BY source_row) - 1 AS "row"
    FROM u WHERE {_STRIPPED} <> ''""",
)
def assign_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.assign_rows(cleaning.clean_text(uploads(spark, sf_dir))).select("source_row", "row")


@query(
    "data_quality",
    f"""WITH {U}, k AS (SELECT {_STRIPPED} <> '' AS kept, date <> '' AS given, {_DATE} IS NULL AS bad FROM u)
    SELECT count(*) AS rows_received, count(*) FILTER (WHERE kept) AS rows_analyzed,
           count(*) FILTER (WHERE NOT kept) AS rows_dropped, count(*) FILTER (WHERE NOT kept) AS empty_text,
           CAST(count(*) FILTER (WHERE kept AND given AND bad) * 2 > count(*) FILTER (WHERE kept AND given) AS INTEGER)
             AS n_warnings FROM k""",
)
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.data_quality(uploads(spark, sf_dir)).select(
        "rows_received",
        "rows_analyzed",
        "rows_dropped",
        F.col("dropped_reasons")["empty_text"].alias("empty_text"),
        F.size("warnings").alias("n_warnings"),
    )


@query(
    "batch_profile",
    f"""WITH {U} SELECT min({_DATE}) AS date_start, max({_DATE}) AS date_end,
           round(avg(TRY_CAST(rating AS DOUBLE)), 2) AS average_rating FROM u WHERE {_STRIPPED} <> ''""",
)
def batch_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = cleaning.clean_text(uploads(spark, sf_dir))
    return cleaning.batch_profile(cleaning.coerce_rating(cleaning.normalize_dates(clean)))


@query(
    "filter_reviews",
    f"""WITH {R} SELECT "row", theme_id, sentiment_label FROM r
    WHERE theme_id = 'click' AND sentiment_label = 'Negative'""",
)
def filter_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cleaning.filter_reviews(reviews(spark, sf_dir), theme_id="click", sentiment="Negative")
    return kept.select("row", "theme_id", "sentiment_label")


@query("count_unassigned", f"WITH {R} SELECT count(*) AS unassigned FROM r WHERE theme_id IS NULL")
def count_unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cleaning.filter_reviews(reviews(spark, sf_dir), unassigned=True)
    return kept.agg(F.count(F.lit(1)).alias("unassigned"))


@query(
    "join_semi_rows",
    f"""WITH {R} SELECT "row", text, sentiment_label FROM r WHERE "row" IN (SELECT doc_id FROM labels)""",
)
def join_semi_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row"))
    return cleaning.filter_reviews(reviews(spark, sf_dir), rows=rows).select("row", "text", "sentiment_label")


@query(
    "near_dup_groups",
    """SELECT md5(k) AS key_hash, count(*) AS copies, count(DISTINCT text) AS distinct_texts, min(doc_id) AS first_id
    FROM (SELECT doc_id, text, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k FROM documents)
    GROUP BY k""",
)
def near_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.near_duplicates(wide_texts(spark, sf_dir, "documents"), "doc_id")


@query(
    "coerce_engine_rows",
    f"""WITH {R} SELECT "row", text, sentiment_score, coalesce(nullif(CASE WHEN "row" % 3 = 0 THEN '' ELSE sentiment_label END, ''),
           'Neutral') AS sentiment_label, theme_id, date, CAST(NULL AS DOUBLE) AS rating FROM r""",
)
def coerce_engine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    partial = reviews(spark, sf_dir).select(
        "row",
        "text",
        "sentiment_score",
        F.when(F.col("row") % 3 == 0, "").otherwise(F.col("sentiment_label")).alias("sentiment_label"),
        "theme_id",
        F.concat(F.col("date").cast("string"), F.lit("T00:00:00")).alias("date"),
        F.lit(float("nan")).alias("rating"),
    )
    return cleaning.coerce_scored(partial)


@query("file_manifest")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_manifest(spark, f"{sf_dir}/*").withColumn("path", F.element_at(F.split("path", "/"), -1))
