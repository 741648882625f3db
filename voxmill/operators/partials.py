"""Kept aggregates of runs: counts and score sums per date, theme and label, from which trends and breakdowns are read without a review.

A run has at most dates x themes x labels rows of them. Sums are decimals, so adding up partials gives the same figures as a scan of the
reviews, whatever their order. Partials of a run are rows of that run: they come with its commit and go with its deletion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.config import NEGATIVE, NEUTRAL, POSITIVE, STRONGLY_NEGATIVE, Config
from voxmill.errors import NoDateData
from voxmill.functions.dates import bucket_start
from voxmill.functions.numbers import exact_sum
from voxmill.operators.analytics import fill_trend
from voxmill.operators.sentiment import with_percent

KEYS = ("date", "theme_id", "sentiment_label")


def partials_of(reviews: DataFrame) -> DataFrame:
    """``job_id, date, theme_id, sentiment_label, reviews, scored, score_sum``, combined before the shuffle."""
    score = F.col("sentiment_score")
    return reviews.groupBy("job_id", *KEYS).agg(
        F.count(F.lit(1)).alias("reviews"), F.count(score).alias("scored"), exact_sum(score).alias("score_sum")
    )


def _of(*labels: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("sentiment_label").isin(*labels), F.col("reviews"))), F.lit(0)).cast("long")


def _not_of(*labels: str) -> Column:
    return F.coalesce(F.sum(F.when(~F.col("sentiment_label").isin(*labels), F.col("reviews"))), F.lit(0)).cast("long")


def _mean() -> Column:
    return F.try_divide(F.sum("score_sum").cast("double"), F.sum("scored").cast("double"))


def trends_of_partials(
    partials: DataFrame, interval: str, theme_id: str | None = None, cfg: Config = Config(), require_dates: bool = False
) -> DataFrame:
    """``analytics.trends`` over all runs in ``partials``."""
    if interval not in ("weekly", "monthly"):
        raise ValueError("interval must be weekly or monthly")
    chosen = partials.where(F.col("date").isNotNull())
    if theme_id is not None:
        chosen = chosen.where(F.col("theme_id") == theme_id)
    if require_dates and chosen.isEmpty():
        raise NoDateData("no review has a usable date")
    buckets = chosen.groupBy(bucket_start(F.col("date"), interval).alias("period_start")).agg(
        F.sum("reviews").cast("long").alias("review_count"), _of(POSITIVE).alias("positive"), _of(NEUTRAL).alias("neutral"),
        _not_of(POSITIVE, NEUTRAL).alias("negative"), _mean().alias("_mean"),
    )
    return fill_trend(buckets, interval, cfg).orderBy("period_start")


def breakdown_of_partials(partials: DataFrame) -> DataFrame:
    """``analytics.sentiment_breakdown`` over all runs in ``partials``."""
    counts = partials.agg(
        _of(POSITIVE).alias("positive"), _of(NEUTRAL).alias("neutral"), _of(NEGATIVE).alias("_negative"),
        _of(STRONGLY_NEGATIVE).alias("strongly_negative"), F.coalesce(F.sum("reviews"), F.lit(0)).cast("long").alias("total_reviews"),
    )
    counts = counts.withColumn("negative", F.col("total_reviews") - F.col("positive") - F.col("neutral"))
    return with_percent(counts).withColumn("negative", F.col("_negative")).drop("_negative")


def theme_figures(partials: DataFrame) -> DataFrame:
    """``theme_id, count, sentiment_score`` of every theme, over all runs in ``partials``."""
    themed = partials.where(F.col("theme_id").isNotNull()).groupBy("theme_id")
    return themed.agg(F.sum("reviews").cast("long").alias("count"), F.round(_mean(), 4).alias("sentiment_score"))
