"""Read queries: trends, theme lists, verbatims, summary figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.config import Config
from voxmill.operators import analytics, redaction, sentiment
from voxmill.operators.themes import attach_representatives, theme_stats
from voxmill.plans.catalog import query
from voxmill.plans.queries_sentiment import PERCENT
from voxmill.plans.views import MEAN, REVIEWS_GAP, THEMES, G, R, reviews, view


def _trend(source: str, interval: str, where: str = "date IS NOT NULL") -> str:
    unit, step = ("week", "7 DAY") if interval == "weekly" else ("month", "1 MONTH")
    label = (
        "concat(CAST(isoyear(period_start) AS VARCHAR), '-W', lpad(CAST(weekofyear(period_start) AS VARCHAR), 2, '0'))"
        if interval == "weekly"
        else "strftime(period_start, '%Y-%m')"
    )
    return f"""b AS (SELECT CAST(date_trunc('{unit}', date) AS DATE) AS period_start, count(*) AS n,
  count(*) FILTER (WHERE sentiment_label = 'Positive') AS pos, count(*) FILTER (WHERE sentiment_label = 'Neutral') AS neu,
  count(*) FILTER (WHERE sentiment_label NOT IN ('Positive', 'Neutral')) AS neg, {MEAN} AS m
  FROM {source} WHERE {where} GROUP BY 1),
axis AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(period_start) FROM b) AS TIMESTAMP),
  CAST((SELECT max(period_start) FROM b) AS TIMESTAMP), INTERVAL {step})) AS DATE) AS period_start),
trend AS (SELECT period_start, {label} AS period_label, coalesce(n, 0) AS review_count, round(m, 2) AS average_sentiment_score,
  round((pos - neg) * 100.0e0 / n, 1) AS net_sentiment_score, coalesce(pos, 0) AS positive, coalesce(neu, 0) AS neutral,
  coalesce(neg, 0) AS negative, coalesce(n, 0) < 10 AS low_sample FROM axis LEFT JOIN b USING (period_start))"""


@query("trend_weekly", f"WITH {G}, {_trend('g', 'weekly')} SELECT * FROM trend")
def trend_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.trends(view(spark, sf_dir, REVIEWS_GAP), "weekly")


@query("trend_monthly", f"WITH {R}, {_trend('r', 'monthly')} SELECT * FROM trend")
def trend_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.trends(reviews(spark, sf_dir), "monthly")


# Orders cover more than six years, so this is a long axis.
_ORDER_REVIEWS = """
SELECT CAST(o_orderdate AS DATE) AS date, round(greatest(-1.0, least(1.0, (150000 - o_totalprice) / 200000)), 4) AS sentiment_score,
       CASE o_orderstatus WHEN 'F' THEN 'Positive' WHEN 'O' THEN 'Neutral' ELSE 'Negative' END AS sentiment_label
FROM {orders}"""
_O = f"o AS ({_ORDER_REVIEWS.replace('{orders}', 'orders')})"


@query("trend_long_monthly", f"WITH {_O}, {_trend('o', 'monthly')} SELECT * FROM trend")
def trend_long_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.trends(view(spark, sf_dir, _ORDER_REVIEWS), "monthly")


@query("trend_long_weekly", f"WITH {_O}, {_trend('o', 'weekly')} SELECT * FROM trend")
def trend_long_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.trends(view(spark, sf_dir, _ORDER_REVIEWS), "weekly")


@query("trend_theme", f"""WITH {G}, {_trend('g', 'weekly', "date IS NOT NULL AND theme_id = 'error'")} SELECT * FROM trend""")
def trend_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.trends(view(spark, sf_dir, REVIEWS_GAP), "weekly", theme_id="error")


@query("trend_excluded", f"WITH {G} SELECT count(*) AS excluded_without_date FROM g WHERE date IS NULL")
def trend_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.trend_excluded(view(spark, sf_dir, REVIEWS_GAP))


@query(
    "trend_percent",
    f"""WITH {G}, {_trend('g', 'weekly')} SELECT period_start, period_label, review_count,
      CAST(CASE WHEN review_count > 0 THEN floor(positive * 100.0e0 / review_count + 0.5) END AS INTEGER) AS positive_pct,
      CAST(CASE WHEN review_count > 0 THEN floor(neutral * 100.0e0 / review_count + 0.5) END AS INTEGER) AS neutral_pct,
      CAST(CASE WHEN review_count > 0 THEN floor(negative * 100.0e0 / review_count + 0.5) END AS INTEGER) AS negative_pct
    FROM trend""",
)
def trend_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.trend_percent(analytics.trends(view(spark, sf_dir, REVIEWS_GAP), "weekly"))


# ---------------------------------------------------------------- themes
def review_themes(rows: DataFrame) -> DataFrame:
    """Theme table of the review view, its event types standing in for discovered themes."""
    return theme_stats(rows, ["theme_id", "general_class"])


_PRIORITY = "round(count * greatest(0e0, -sentiment_score), 4)"
_ORDERS = {
    "priority": f"{_PRIORITY} DESC, count DESC, theme_id",
    "volume": "count DESC, theme_id",
    "severity": "sentiment_score, count DESC, theme_id",
}


def _themes(sort: str) -> str:
    return f"""WITH {R}, {THEMES} SELECT row_number() OVER (ORDER BY {_ORDERS[sort]}) AS rank, theme_id, general_class,
      count, round(count * 100.0e0 / (SELECT count(*) FROM r), 1) AS percentage, sentiment, sentiment_score,
      {_PRIORITY} AS priority_score FROM themes"""


def _list(spark: SparkSession, sf_dir: str, sort: str) -> DataFrame:
    rows = reviews(spark, sf_dir)
    return analytics.list_themes(review_themes(rows), rows, sort)


@query("themes_priority", _themes("priority"))
def themes_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list(spark, sf_dir, "priority")


@query("themes_volume", _themes("volume"))
def themes_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list(spark, sf_dir, "volume")


@query("themes_severity", _themes("severity"))
def themes_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list(spark, sf_dir, "severity")


@query(
    "dashboard_themes",
    f"""WITH {R}, {THEMES} SELECT * FROM (
      SELECT theme_id, general_class, count, sentiment, sentiment_score,
        row_number() OVER (ORDER BY count * greatest(0e0, -sentiment_score) DESC, count DESC, theme_id) AS rank FROM themes)
    WHERE rank <= 3""",
)
def dashboard_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.dashboard_themes(review_themes(reviews(spark, sf_dir)), limit=3)


@query(
    "summary_kpis",
    f"""WITH {R}, {PERCENT}, {THEMES}, s AS (SELECT count(*) AS total_reviews,
      round((count(*) FILTER (WHERE sentiment_label = 'Positive')
             - count(*) FILTER (WHERE sentiment_label NOT IN ('Positive', 'Neutral'))) * 100.0e0 / count(*), 1)
        AS net_sentiment_score, count(*) FILTER (WHERE "row" % 13 = 0) AS pii_redacted_count,
      count(*) FILTER (WHERE theme_id IS NULL) AS unassigned_count FROM r)
    SELECT s.*, shares.*, (SELECT count(*) FROM themes) AS themes_total,
      CASE WHEN net_sentiment_score <= -10 THEN 'Negative Trend' WHEN net_sentiment_score >= 10 THEN 'Positive Trend'
           ELSE 'Mixed Trend' END AS overall_sentiment FROM s, shares""",
)
def summary_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = redaction.redact(reviews(spark, sf_dir, wide=True))
    # One pass over the reviews gives all figures.
    summary = sentiment.summarize_sentiment(
        rows,
        pii_redacted_count=redaction.total_of_row(),
        unassigned_count=F.count_if(F.col("theme_id").isNull()),
        themes_total=F.count_distinct("theme_id"),
    )
    return sentiment.with_percent(summary).drop("positive", "neutral", "negative", "mean_score")


# ---------------------------------------------------------------- verbatims
def _page(order: str, first: int, last: int, where: str) -> str:
    return f"""WITH {R} SELECT concat('v', CAST("row" AS VARCHAR)) AS id, "row", sentiment_label, sentiment_score, date, rating
    FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS k FROM r WHERE {where}) WHERE k BETWEEN {first} AND {last}"""


def _verbatims(spark: SparkSession, sf_dir: str, **kwargs: object) -> DataFrame:
    page = analytics.verbatims(reviews(spark, sf_dir), **kwargs)
    return page.select("id", "row", "sentiment_label", "sentiment_score", "date", "rating")


@query("verbatims_negative", _page('sentiment_score, "row"', 21, 40, "theme_id = 'click'"))
def verbatims_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verbatims(spark, sf_dir, theme_id="click", page=2, limit=20, sort="most_negative")


@query(
    "verbatims_positive",
    _page('sentiment_score DESC, "row"', 1, 50, "theme_id = 'view' AND sentiment_label = 'Neutral'"),
)
def verbatims_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verbatims(spark, sf_dir, theme_id="view", limit=50, sort="most_positive", sentiment="Neutral")


@query("verbatims_recent", _page('date DESC NULLS LAST, "row" DESC', 201, 300, "theme_id = 'error'"))
def verbatims_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verbatims(spark, sf_dir, theme_id="error", page=3, limit=100, sort="recent")


@query(
    "verbatim_page_info",
    f"""WITH {R} SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 20.0e0) AS BIGINT)) AS total_pages
    FROM r WHERE theme_id = 'click' AND sentiment_label = 'Negative'""",
)
def verbatim_page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.verbatim_page_info(reviews(spark, sf_dir), "click", 20, "Negative")


@query(
    "sample_verbatims",
    f"""WITH {R}, best AS (SELECT theme_id, "row", row_number() OVER (PARTITION BY theme_id
        ORDER BY CASE WHEN theme_id IN ('click', 'error') THEN -sentiment_score ELSE sentiment_score END, "row") AS position
      FROM r WHERE theme_id IS NOT NULL)
    SELECT theme_id, CAST(position AS INTEGER) AS position, concat('v', CAST("row" AS VARCHAR)) AS id, "row", text, sentiment_label
    FROM best JOIN r USING (theme_id, "row") WHERE position <= 5""",
)
def sample_verbatims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir)
    # Two themes bring representatives (their most positive reviews), the others fall back to the most negative.
    w = Window.partitionBy("theme_id").orderBy(F.desc("sentiment_score"), F.asc("row"))
    reps = rows.where(F.col("theme_id").isin("click", "error")).withColumn("position", F.row_number().over(w))
    themes = attach_representatives(review_themes(rows), reps.where(F.col("position") <= 5))
    return analytics.sample_verbatims(rows, themes, Config().samples_per_theme)
