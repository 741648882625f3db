"""Accuracy of predictions against labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.config import NEGATIVE, STRONGLY_NEGATIVE


def three_class(label: Column) -> Column:
    return F.when(label == STRONGLY_NEGATIVE, F.lit(NEGATIVE)).otherwise(label)


def _hit(predicted: Column, gold: Column) -> Column:
    return (predicted == gold).cast("double")


def sentiment_accuracy(pairs: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(_hit(three_class(F.col(predicted)), F.col(gold))), 4).alias("accuracy"),
    )


def recall_by_class(pairs: DataFrame, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    return pairs.groupBy(F.col(gold).alias("gold")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(_hit(three_class(F.col(predicted)), F.col(gold))), 3).alias("recall"),
    )


def topic_accuracy(
    pairs: DataFrame, categories: Sequence[str], predicted: str = "predicted_class", gold: str = "gold_class"
) -> DataFrame:
    """One row; null as soon as a gold class is not among the configured ones."""
    known = F.bool_and(F.col(gold).isin(list(categories)))
    return pairs.agg(
        F.when(known, F.round(F.avg(_hit(F.col(predicted), F.col(gold))), 4)).alias("topic_accuracy")
    )


def validation_report(
    pairs: DataFrame,
    categories: Sequence[str],
    predicted: str = "predicted",
    gold: str = "gold",
    predicted_class: str = "predicted_class",
    gold_class: str = "gold_class",
) -> DataFrame:
    """One row: both accuracies, their mean, its display text and recall per gold label, in a single pass."""
    hit = _hit(three_class(F.col(predicted)), F.col(gold))
    topic = F.when(F.bool_and(F.col(gold_class).isin(list(categories))), F.avg(_hit(F.col(predicted_class), F.col(gold_class))))
    labels = ("Positive", "Neutral", NEGATIVE)
    raw = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit).alias("_sent"),
        topic.alias("_topic"),
        *[F.round(F.avg(F.when(F.col(gold) == lab, hit)), 3).alias(f"_r_{lab}") for lab in labels],
    )
    overall = F.when(F.col("_topic").isNull(), F.col("_sent")).otherwise((F.col("_sent") + F.col("_topic")) / 2)
    recall = F.create_map(*[x for lab in labels for x in (F.lit(lab), F.col(f"_r_{lab}"))])
    return raw.select(
        "n",
        F.round(overall, 4).alias("overall_accuracy"),
        F.format_string("%.1f%%", overall * 100).alias("display"),
        F.round("_sent", 4).alias("sentiment_accuracy"),
        F.round("_topic", 4).alias("tier1_topic_accuracy"),
        recall.alias("sentiment_recall_by_class"),
    )
