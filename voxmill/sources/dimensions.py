"""Small user-supplied tables: lexicon, class patterns, labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.errors import ContractMismatch
from voxmill.operators.sentiment import MAX_LEXICON

LABEL_COLUMNS = ("text", "sentiment", "category")


def read_lexicon(spark: SparkSession, path: str, fmt: str = "csv") -> dict[str, float]:
    """Term to valence. A lexicon is a dictionary of bounded size; more than that is an error, not a cut."""
    raw = spark.read.format(fmt).option("header", True).load(path)
    clean = raw.select(F.lower(F.trim("term")).alias("term"), F.col("valence").try_cast("double").alias("valence"))
    rows = clean.dropna().limit(MAX_LEXICON + 1).collect()
    if len(rows) > MAX_LEXICON:
        raise ContractMismatch(f"a lexicon may have at most {MAX_LEXICON} terms")
    return {r["term"]: r["valence"] for r in rows}


def read_keywords(spark: SparkSession, path: str, fmt: str = "csv", limit: int = 5000) -> dict[str, list[str]]:
    """Class to patterns, in file order of first appearance."""
    rows = spark.read.format(fmt).option("header", True).load(path).select("general_class", "pattern").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ContractMismatch(f"a pattern table may have at most {limit} rows")
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["general_class"], []).append(r["pattern"])
    return out


def read_labels(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Labelled rows; they stay a table and may be of any size."""
    df = spark.read.format(fmt).option("header", True).load(path)
    missing = [c for c in LABEL_COLUMNS if c not in df.columns]
    if missing:
        raise ContractMismatch("labelled rows lack columns", missing=missing, found=df.columns)
    return df.select(*LABEL_COLUMNS)
