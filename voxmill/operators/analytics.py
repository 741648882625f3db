"""The read queries over scored reviews and themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.config import NEGATIVE, NEUTRAL, POSITIVE, STRONGLY_NEGATIVE, Config
from voxmill.errors import NoDateData
from voxmill.functions.dates import bucket_axis, bucket_label, bucket_start
from voxmill.functions.numbers import exact_mean
from voxmill.operators.scale import small_table, sorted_slice, top_n
from voxmill.operators.sentiment import with_percent

SORTS = ("priority", "volume", "severity")
VERBATIM_SORTS = ("most_negative", "most_positive", "recent")
MAX_PAGE = 100


# ---------------------------------------------------------------- trends
def trend_buckets(reviews: DataFrame, interval: str) -> DataFrame:
    """Counts and means per bucket of dated reviews; only buckets that have rows."""
    label = F.col("sentiment_label")
    return (
        reviews.where(F.col("date").isNotNull())
        .groupBy(bucket_start(F.col("date"), interval).alias("period_start"))
        .agg(
            F.count(F.lit(1)).alias("review_count"),
            F.count_if(label == POSITIVE).alias("positive"),
            F.count_if(label == NEUTRAL).alias("neutral"),
            F.count_if(~label.isin(POSITIVE, NEUTRAL)).alias("negative"),
            exact_mean(F.col("sentiment_score")).alias("_mean"),
        )
    )


def fill_trend(buckets: DataFrame, interval: str, cfg: Config = Config()) -> DataFrame:
    """Continuous axis from the first to the last bucket; empty buckets have 0 rows and null scores."""
    counted = ["review_count", "positive", "neutral", "negative"]

    def empty(start: Column) -> Column:
        zeros = [F.lit(0).cast("long").alias(c) for c in counted]
        return F.struct(start.alias("period_start"), *zeros, F.lit(None).cast("double").alias("_mean"))

    # There are as many buckets as calendar weeks or months, so they fit one row; from it the axis is made
    # and merged, and the reviews are read only once.
    all_buckets = buckets.agg(
        F.min("period_start").alias("_a"),
        F.max("period_start").alias("_b"),
        F.collect_list(F.struct("period_start", *counted, "_mean")).alias("_rows"),
    ).where(F.col("_a").isNotNull())
    axis = F.transform(bucket_axis(F.col("_a"), F.col("_b"), interval), empty)
    filled = (
        all_buckets.select(F.inline(F.concat(F.col("_rows"), axis)))
        .groupBy("period_start")
        .agg(*[F.sum(c).alias(c) for c in counted], F.max("_mean").alias("_mean"))
    )
    nss = F.try_divide((F.col("positive") - F.col("negative")) * 100.0, F.col("review_count"))
    return filled.select(
        "period_start",
        bucket_label(F.col("period_start"), interval).alias("period_label"),
        "review_count",
        F.round("_mean", 2).alias("average_sentiment_score"),
        F.round(nss, 1).alias("net_sentiment_score"),
        "positive",
        "neutral",
        "negative",
        (F.col("review_count") < cfg.low_sample).alias("low_sample"),
    )


def trends(
    reviews: DataFrame, interval: str, theme_id: str | None = None, cfg: Config = Config(), require_dates: bool = False
) -> DataFrame:
    if interval not in ("weekly", "monthly"):
        raise ValueError("interval must be weekly or monthly")
    if theme_id is not None:
        reviews = reviews.where(F.col("theme_id") == theme_id)
    if require_dates and reviews.where(F.col("date").isNotNull()).isEmpty():
        raise NoDateData("no review has a usable date")
    return fill_trend(trend_buckets(reviews, interval), interval, cfg).orderBy("period_start")


def trend_excluded(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count_if(F.col("date").isNull()).alias("excluded_without_date"))


def trend_percent(trend: DataFrame) -> DataFrame:
    """Whole percentages per bucket, halves up; null where a bucket has no rows."""

    def share(name: str) -> Column:
        return F.floor(F.try_divide(F.col(name) * 100.0, F.col("review_count")) + 0.5).cast("int").alias(f"{name}_pct")

    return trend.select("period_start", "period_label", "review_count", share("positive"), share("neutral"), share("negative"))


# ---------------------------------------------------------------- themes
def priority(count: Column, score: Column) -> Column:
    """Reviews times negative polarity; 0 for themes that are not negative."""
    return count * F.greatest(F.lit(0.0), -score)


def list_themes(
    themes: DataFrame, total_reviews: int | DataFrame, sort: str = "priority", general_class: str | None = None
) -> DataFrame:
    """Ranked theme list. Themes of a run are capped by discovery, so one ordered window ranks them."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}")
    if isinstance(total_reviews, DataFrame):
        total_reviews = total_reviews.count()
    if general_class is not None:
        themes = themes.where(F.col("general_class") == general_class)
    scored = themes.withColumn("priority_score", F.round(priority(F.col("count"), F.col("sentiment_score")), 4))
    share = F.round(F.try_divide(F.col("count") * 100.0, F.lit(total_reviews)), 1)
    scored = scored.withColumn("percentage", F.coalesce(share, F.lit(0.0)))
    order = {
        "priority": [F.desc("priority_score"), F.desc("count"), F.asc("theme_id")],
        "volume": [F.desc("count"), F.asc("theme_id")],
        "severity": [F.asc("sentiment_score"), F.desc("count"), F.asc("theme_id")],
    }[sort]
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(*order))).orderBy("rank")


def dashboard_themes(themes: DataFrame, limit: int = 10) -> DataFrame:
    """Top themes by the unrounded priority: a plain top-k, then numbered."""
    order = [F.desc("_priority"), F.desc("count"), F.asc("theme_id")]
    ranked = themes.withColumn("_priority", priority(F.col("count"), F.col("sentiment_score"))).orderBy(*order).limit(limit)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("_priority")


def sample_verbatims(reviews: DataFrame, themes: DataFrame, limit: int = 5, text: str = "text") -> DataFrame:
    """Representative reviews of every theme in stored order; the most negative ones where a theme has none.

    One scan of the reviews: listed rows come first in the order that keeps ``limit`` rows of a theme, and what
    is not listed goes where a theme has a listed row. The themes table is small, so reviews are not shuffled for it.
    """
    side, small = small_table(themes.select("theme_id", "representative_indices"))
    listed = side.select("theme_id", F.posexplode("representative_indices").alias("_pos", "row"))
    hint = F.broadcast if small else lambda df: df
    chosen = reviews.select("theme_id", "row", text, "sentiment_label", "sentiment_score")
    chosen = chosen.join(hint(side.select("theme_id")), "theme_id", "left_semi").join(hint(listed), ["theme_id", "row"], "left")
    first = top_n(chosen, ["theme_id"], [F.asc_nulls_last("_pos"), F.asc("sentiment_score"), F.asc("row")], limit, "position")
    has_listed = F.count("_pos").over(Window.partitionBy("theme_id")) > 0
    kept = first.withColumn("_has", has_listed).where(F.col("_pos").isNotNull() | ~F.col("_has"))
    return kept.drop("_pos", "_has", "sentiment_score").withColumn("id", F.concat(F.lit("v"), F.col("row")))


def with_samples(themes: DataFrame, samples: DataFrame, text: str = "text") -> DataFrame:
    """Attach the (at most five) sample verbatims of each theme as an ordered array."""
    item = F.struct("position", "id", F.col(text).alias("text"), F.col("sentiment_label").alias("sentiment"))
    lists = samples.groupBy("theme_id").agg(F.array_sort(F.collect_list(item)).alias("_s"))
    out = F.transform("_s", lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text"), s["sentiment"].alias("sentiment")))
    return themes.join(lists, "theme_id", "left").withColumn("sample_verbatims", out).drop("_s")


# ---------------------------------------------------------------- verbatims
def verbatim_order(sort: str) -> list[Column]:
    if sort not in VERBATIM_SORTS:
        raise ValueError(f"sort must be one of {VERBATIM_SORTS}")
    return {
        "most_negative": [F.asc("sentiment_score"), F.asc("row")],
        "most_positive": [F.desc("sentiment_score"), F.asc("row")],
        "recent": [F.desc_nulls_last("date"), F.desc("row")],
    }[sort]


def _of_theme(reviews: DataFrame, theme_id: str, sentiment: str | None) -> DataFrame:
    chosen = reviews.where(F.col("theme_id") == theme_id)
    return chosen.where(F.col("sentiment_label") == sentiment) if sentiment else chosen


def check_page(page: int, limit: int) -> None:
    if page < 1 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"page must be at least 1 and limit between 1 and {MAX_PAGE}")


def verbatims(
    reviews: DataFrame,
    theme_id: str,
    page: int = 1,
    limit: int = 20,
    sentiment: str | None = None,
    sort: str = "most_negative",
) -> DataFrame:
    """One page of a theme's reviews; a page past the end is empty."""
    check_page(page, limit)
    chosen = _of_theme(reviews, theme_id, sentiment)
    rows = sorted_slice(chosen, verbatim_order(sort), (page - 1) * limit, limit)
    return rows.withColumn("id", F.concat(F.lit("v"), F.col("row")))


def verbatim_page_info(reviews: DataFrame, theme_id: str, limit: int = 20, sentiment: str | None = None) -> DataFrame:
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(limit))).cast("long")
    return _of_theme(reviews, theme_id, sentiment).agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", pages)


# ---------------------------------------------------------------- summaries
def sentiment_breakdown(reviews: DataFrame) -> DataFrame:
    """One row from one pass: whole percentages, the four absolute counts and the total."""
    label = F.col("sentiment_label")
    counts = reviews.agg(
        F.count_if(label == POSITIVE).alias("positive"),
        F.count_if(label == NEUTRAL).alias("neutral"),
        F.count_if(label == NEGATIVE).alias("_negative"),
        F.count_if(label == STRONGLY_NEGATIVE).alias("strongly_negative"),
        F.count(F.lit(1)).alias("total_reviews"),
    )
    # For the percentages every other label is negative.
    counts = counts.withColumn("negative", F.col("total_reviews") - F.col("positive") - F.col("neutral"))
    shares = with_percent(counts)
    return shares.withColumn("negative", F.col("_negative")).drop("_negative")


def kpi_estimates(breakdown: DataFrame) -> DataFrame:
    """Review estimates per class from the whole percentages."""

    def estimate(name: str) -> Column:
        return F.floor(F.col("total_reviews") * F.col(f"{name}_pct") / 100.0 + 0.5).cast("long").alias(f"{name}_reviews")

    return breakdown.select("total_reviews", estimate("positive"), estimate("neutral"), estimate("negative"))
