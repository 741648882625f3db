"""Redaction of personal data over a text column, with counts per type."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.functions.pii import PII_TAG, PROFILES, TYPES, Pass
from voxmill.operators.patterns import prepare, rows_holding

# Most planted secrets one audit may look for; they are folded into the plan as literals.
MAX_SECRETS = 1000


def redact(df: DataFrame, text: str = "text", out: str | None = None, profile: str = "strict") -> DataFrame:
    """Mask ``text`` into ``out`` and add one ``pii_<type>`` count column per type.

    Passes run in order, each over the output of the one before. A narrow job: no shuffle, and every
    pass is skipped for rows that cannot match it.
    """
    out = out or text
    current = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    counted: dict[str, list[str]] = {}
    for i, step in enumerate(PROFILES[profile]):
        name = f"_n{i}"
        counted.setdefault(step.kind, []).append(name)
        current = current.select(
            *[c for c in current.columns if c != "_t"],
            step.count(F.col("_t")).alias(name),
            step.mask(F.col("_t")).alias("_t"),
        )
    kept = [F.col(c) for c in df.columns if c != out]

    def total(kind: str) -> Column:
        cols = [F.col(c) for c in counted.get(kind, [])]
        return (sum(cols[1:], cols[0]) if cols else F.lit(0)).cast("long").alias(f"pii_{kind}")

    return current.select(*kept, F.col("_t").alias(out), *[total(k) for k in TYPES])


def count_matches(df: DataFrame, kind: str, text: str = "text", out: str = "found", profile: str = "strict") -> DataFrame:
    """Accepted matches of one type on the text as it is, all patterns of the type added up."""
    steps = [s for s in PROFILES[profile] if s.kind == kind]
    return df.withColumn(out, sum((s.count(F.col(text)) for s in steps[1:]), steps[0].count(F.col(text))).cast("long"))


def pii_totals(redacted: DataFrame) -> DataFrame:
    """One row with the sum of every count column, and their total."""
    sums = [F.coalesce(F.sum(f"pii_{k}"), F.lit(0)).alias(k) for k in TYPES]
    totals = redacted.agg(*sums)
    return totals.withColumn("total", sum((F.col(k) for k in TYPES[1:]), F.col(TYPES[0])))


def total_of_row() -> Column:
    """Aggregate over redacted rows: all masked entities of all types."""
    per_row = sum((F.col(f"pii_{k}") for k in TYPES[1:]), F.col(f"pii_{TYPES[0]}"))
    return F.coalesce(F.sum(per_row), F.lit(0))


def pii_report(redacted: DataFrame) -> DataFrame:
    """Rows (type, entities), with the grand total as type ``total``."""
    wide = pii_totals(redacted)
    pairs = F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("entities")) for k in (*TYPES, "total")])
    return wide.select(F.inline(pairs))


def redact_names(
    df: DataFrame, recogniser: Callable[[], Callable[[list[str]], Iterable[list[tuple[int, int]]]]], text: str = "text"
) -> DataFrame:
    """Mask PERSON spans found by a pluggable recogniser and count them in ``pii_person``.

    ``recogniser()`` is called once per task and returns a function from texts to character spans.
    """
    columns = [c for c in df.columns if c != "pii_person"]
    schema = T.StructType([*df.select(*columns).schema.fields, T.StructField("pii_person", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = recogniser()
        for batch in batches:
            texts, counts = [], []
            for value, spans in zip(batch[text], find(batch[text].tolist())):
                pieces, last, n = [], 0, 0
                for start, end in sorted(spans):
                    if start < last or len(value[start:end].strip()) <= 1:
                        continue
                    pieces += [value[last:start], PII_TAG]
                    last, n = end, n + 1
                texts.append("".join(pieces) + value[last:])
                counts.append(n)
            yield batch.assign(**{text: texts, "pii_person": counts})

    return df.select(*columns).mapInPandas(run, schema)


def output_guard(df: DataFrame, text: str = "text", profile: str = "strict") -> tuple[DataFrame, DataFrame]:
    """Redact stored text again; returns the guarded table and a one-row count of rows that changed."""
    guarded = redact(df.withColumn("_before", F.coalesce(F.col(text), F.lit(""))), text, profile=profile).withColumn(
        "guard_hit", F.col(text) != F.col("_before")
    )
    guarded = guarded.drop("_before", *[f"pii_{k}" for k in TYPES])
    return guarded, guarded.agg(F.count_if("guard_hit").alias("guard_hits"), F.count(F.lit(1)).alias("rows"))


def leak_audit(df: DataFrame, secrets: list[str], columns: list[str]) -> DataFrame:
    """Rows of ``df`` in which each known secret still shows, one output row per secret."""
    if not 0 < len(secrets) <= MAX_SECRETS:
        raise ValueError(f"between 1 and {MAX_SECRETS} secrets can be audited in one pass, got {len(secrets)}")
    haystack = F.concat_ws("\n", *columns)
    counts = df.select(haystack.alias("_hay")).agg(
        *[F.count_if(F.col("_hay").contains(s)).alias(f"_s{i}") for i, s in enumerate(secrets)]
    )
    pairs = [F.struct(F.lit(s).alias("secret"), F.col(f"_s{i}").alias("rows_found")) for i, s in enumerate(secrets)]
    return counts.select(F.inline(F.array(*pairs)))


def leak_audit_table(df: DataFrame, secrets: DataFrame, columns: list[str], secret: str = "secret") -> DataFrame:
    """``leak_audit`` for a table of secrets of any size: one row for each different secret.

    Every window of the texts is probed, so the cost does not grow with the number of secrets. Columns of a row are joined by line
    breaks, as in ``leak_audit``. Null and empty secrets are left out.
    """
    looked_for = prepare(secrets, secret)
    counts = rows_holding(df.select(F.concat_ws("\n", *columns).alias("text")), "text", looked_for)
    all_secrets = looked_for.table.select("pattern")
    return all_secrets.join(counts, "pattern", "left").select(F.col("pattern").alias(secret), F.coalesce("rows", F.lit(0)).alias("rows_found"))


__all__ = ["Pass", "count_matches", "leak_audit", "leak_audit_table", "output_guard", "pii_report", "pii_totals", "redact", "redact_names"]
