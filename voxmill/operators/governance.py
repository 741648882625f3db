"""Governance view of one run: personal data, validation, drift, models, data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.functions.pii import TAGS, TYPES

CAVEAT = "Accuracy comes from a small labelled set and says little about other reviews."


def pii_block(totals: DataFrame) -> DataFrame:
    """One row (total_redacted, by_type map, tags, raw_text_stored) from per-type totals."""
    by_type = F.create_map(*[x for k in TYPES for x in (F.lit(k), F.col(k).cast("bigint"))])
    return totals.select(
        F.col("total").cast("bigint").alias("total_redacted"),
        by_type.alias("by_type"),
        F.array(*[F.lit(t) for t in TAGS]).alias("tags"),
        F.lit(False).alias("raw_text_stored"),
    )


def governance(
    totals: DataFrame, validation: DataFrame, drift: DataFrame, quality: DataFrame, models: dict[str, str]
) -> DataFrame:
    """One nested row; every input is a one-row table. The audit log stays a table of its own (``audit_trail``)."""

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(1).alias("_one"), F.struct(*df.columns).alias(name))

    egress = models.get("assist", "off") != "off"
    quality = quality.withColumn("warnings", F.array_distinct("warnings"))
    blocks = (
        one(pii_block(totals), "pii")
        .join(one(validation.withColumn("caveat", F.lit(CAVEAT)), "validation"), "_one")
        .join(one(drift, "drift"), "_one")
        .join(one(quality, "data_quality"), "_one")
    )
    entries = [x for k, v in sorted(models.items()) for x in (F.lit(k), F.lit(v))]
    return blocks.withColumn(
        "models",
        F.struct(F.create_map(*entries).alias("backends"), F.lit(egress).alias("external_data_egress")),
    ).drop("_one")
