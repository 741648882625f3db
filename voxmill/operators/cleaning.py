"""Cleaning: empty texts, dates, ratings, row numbers, gates and quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.config import Config
from voxmill.errors import ContractMismatch, RowGateError
from voxmill.functions.dates import parse_date
from voxmill.functions.text import strip, text_key
from voxmill.operators.scale import dense_rows

# Fixed value: warning text.
DATE_WARNING = "More than 50% of date values could not be parsed and were treated as missing."


def clean_text(df: DataFrame, column: str = "review_text") -> DataFrame:
    return df.withColumn(column, strip(F.col(column).cast("string"))).where(F.col(column) != "")


def normalize_dates(df: DataFrame, column: str = "date", out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, parse_date(F.col(column)))


def coerce_rating(df: DataFrame, column: str = "rating", out: str | None = None) -> DataFrame:
    number = F.trim(F.col(column).cast("string")).try_cast("double")
    return df.withColumn(out or column, F.when(~F.isnan(number), number))


def assign_rows(df: DataFrame, source_row: str = "source_row") -> DataFrame:
    """Dense 0-based ``row`` over the rows that are left; ``source_row`` keeps the old position."""
    return dense_rows(df, source_row, "row")


def date_quality(df: DataFrame, column: str = "date") -> DataFrame:
    """One row: non-empty dates, unparseable ones, and the warning when those are the majority."""
    given = strip(F.col(column).cast("string")) != ""
    bad = given & parse_date(F.col(column)).isNull()
    counts = df.agg(F.count_if(given).alias("nonempty"), F.count_if(bad).alias("unparseable"))
    return counts.withColumn(
        "warnings",
        F.when(F.col("unparseable") * 2 > F.col("nonempty"), F.array(F.lit(DATE_WARNING))).otherwise(
            F.array().cast("array<string>")
        ),
    )


def data_quality(raw: DataFrame, text: str = "review_text", date: str | None = "date") -> DataFrame:
    """One row per upload: received, analysed and dropped rows, drop reasons and warnings."""
    kept = strip(F.col(text).cast("string")) != ""
    given = kept & (strip(F.col(date).cast("string")) != "") if date else F.lit(False)
    bad = given & parse_date(F.col(date)).isNull() if date else F.lit(False)
    counts = raw.agg(
        F.count(F.lit(1)).alias("rows_received"),
        F.count_if(kept).alias("rows_analyzed"),
        F.count_if(~kept).alias("rows_dropped"),
        F.count_if(given).alias("_given"),
        F.count_if(bad).alias("_bad"),
    )
    dropped = F.map_from_arrays(F.array(F.lit("empty_text")), F.array("rows_dropped"))
    return counts.select(
        "rows_received",
        "rows_analyzed",
        "rows_dropped",
        F.when(F.col("rows_dropped") > 0, dropped)
        .otherwise(F.create_map().cast("map<string,bigint>"))
        .alias("dropped_reasons"),
        F.when(F.col("_bad") * 2 > F.col("_given"), F.array(F.lit(DATE_WARNING)))
        .otherwise(F.array().cast("array<string>"))
        .alias("warnings"),
    )


def gate_rows(analyzed: int, cfg: Config) -> None:
    if analyzed == 0:
        raise RowGateError("NO_VALID_REVIEWS", "no review has any text")
    if analyzed < cfg.min_rows:
        raise RowGateError("TOO_FEW_ROWS", f"at least {cfg.min_rows} reviews are needed", found=analyzed)
    if cfg.max_rows is not None and analyzed > cfg.max_rows:
        raise RowGateError("TOO_MANY_ROWS", f"at most {cfg.max_rows} reviews are allowed", found=analyzed)


def batch_profile(df: DataFrame, date: str = "date", rating: str = "rating") -> DataFrame:
    return df.agg(
        F.min(date).alias("date_start"),
        F.max(date).alias("date_end"),
        F.round(F.avg(rating), 2).alias("average_rating"),
    )


def filter_reviews(
    df: DataFrame,
    theme_id: str | None = None,
    sentiment: str | None = None,
    rows: list[int] | DataFrame | None = None,
    unassigned: bool = False,
) -> DataFrame:
    """Any mix of predicates; ``rows`` is a list (an empty one keeps nothing) or a table with a ``row`` column."""
    if theme_id is not None:
        df = df.where(F.col("theme_id") == theme_id)
    if unassigned:
        df = df.where(F.col("theme_id").isNull())
    if sentiment is not None:
        df = df.where(F.col("sentiment_label") == sentiment)
    if isinstance(rows, DataFrame):
        df = df.join(rows.select("row"), "row", "left_semi")
    elif rows is not None:
        df = df.where(F.col("row").isin(rows) if rows else F.lit(False))
    return df


def near_duplicates(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Groups of texts that share a key: key hash, size, distinct exact texts, first member.

    Only 128-bit hashes of keys and texts are shuffled, never texts, and no group's rows come together.
    """
    keyed = df.select(
        F.col(id_col),
        F.md5(text_key(F.col(text)).cast("binary")).alias("key_hash"),
        F.md5(F.col(text).cast("binary")).alias("_h"),
    )
    # First by (key, exact text), so that distinct texts are counted by a second, far smaller aggregate.
    exact = keyed.groupBy("key_hash", "_h").agg(F.count(F.lit(1)).alias("_n"), F.min(id_col).alias("_first"))
    return exact.groupBy("key_hash").agg(
        F.sum("_n").alias("copies"),
        F.count(F.lit(1)).alias("distinct_texts"),
        F.min("_first").alias("first_id"),
    )


def coerce_scored(df: DataFrame) -> DataFrame:
    """Fill in what an external engine left out; a table without ``row`` breaks the contract."""
    if "row" not in df.columns:
        raise ContractMismatch("scored reviews must carry a row column", found=df.columns)
    have = set(df.columns)

    def given(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    rating = given("rating", "double")
    return df.select(
        F.col("row").cast("long").alias("row"),
        F.coalesce(given("text", "string"), F.lit("")).alias("text"),
        F.coalesce(given("sentiment_score", "double"), F.lit(0.0)).alias("sentiment_score"),
        F.coalesce(F.nullif(given("sentiment_label", "string"), F.lit("")), F.lit("Neutral")).alias("sentiment_label"),
        given("theme_id", "string").alias("theme_id"),
        F.substring(given("date", "string"), 1, 10).try_cast("date").alias("date"),
        F.when(~F.isnan(rating), rating).alias("rating"),
    )


def coerce_themes(df: DataFrame) -> DataFrame:
    """Defaults for theme rows of an external engine."""
    have = set(df.columns)
    if "theme_id" not in have:
        raise ContractMismatch("themes must carry a theme_id column", found=df.columns)

    def text(name: str, default: str) -> Column:
        value = F.nullif(F.col(name).cast("string"), F.lit("")) if name in have else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(default)).alias(name)

    def number(name: str, kind: str) -> Column:
        value = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return F.coalesce(value, F.lit(0).cast(kind)).alias(name)

    members = "representative_indices"
    return df.select(
        F.col("theme_id").cast("string").alias("theme_id"),
        text("general_class", "Other"),
        text("name", ""),
        number("count", "long"),
        text("sentiment", "Neutral"),
        number("sentiment_score", "double"),
        F.coalesce(
            F.col(members).cast("array<bigint>") if members in have else F.lit(None).cast("array<bigint>"),
            F.array().cast("array<bigint>"),
        ).alias(members),
    )
