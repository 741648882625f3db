"""Validation and drift queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.config import CATEGORIES
from voxmill.operators import drift, drift_sketches, validation
from voxmill.operators.features import as_vector
from voxmill.operators.scale import scratch_path
from voxmill.operators.sentiment import label_sentiment, score_lexicon
from voxmill.operators.themes import classify_keywords
from voxmill.plans.catalog import query
from voxmill.plans.queries_themes import _class_oracle
from voxmill.plans.views import DOCUMENT_LEXICON, LABEL_OF, lexicon_ctes, table, wide_texts

_GOLD = """CASE WHEN quality = 1 AND toxic = 0 THEN 'Neutral' WHEN quality = 1 THEN 'Positive' ELSE 'Negative' END"""
_GOLD_CLASS = "CASE WHEN toxic = 1 THEN 'Comments & Social' WHEN quality = 1 THEN 'Other' ELSE 'Performance & Crashes' END"
_PAIRS = f"""{lexicon_ctes('documents', 'doc_id', DOCUMENT_LEXICON)}, {_class_oracle('documents', 'doc_id')},
pairs AS (SELECT CASE WHEN label = 'Strongly Negative' THEN 'Negative' ELSE label END AS predicted, gold, predicted_class, gold_class
  FROM (SELECT {LABEL_OF.format('sentiment_score')} AS label, {_GOLD} AS gold, classed.general_class AS predicted_class,
               {_GOLD_CLASS} AS gold_class
        FROM labels JOIN scored ON labels.doc_id = scored.id JOIN classed ON labels.doc_id = classed.id))"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    docs = wide_texts(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")
    scored = classify_keywords(score_lexicon(docs, DOCUMENT_LEXICON))
    return scored.select(
        label_sentiment(F.col("sentiment_score")).alias("predicted"),
        F.expr(_GOLD).alias("gold"),
        F.col("general_class").alias("predicted_class"),
        F.expr(_GOLD_CLASS).alias("gold_class"),
    )


@query("validation_accuracy", f"WITH {_PAIRS} SELECT count(*) AS n, round(avg(CAST(predicted = gold AS INTEGER)), 4) AS accuracy FROM pairs")
def validation_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.sentiment_accuracy(_pairs(spark, sf_dir))


@query(
    "recall_by_class",
    f"WITH {_PAIRS} SELECT gold, count(*) AS n, round(avg(CAST(predicted = gold AS INTEGER)), 3) AS recall FROM pairs GROUP BY gold",
)
def recall_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.recall_by_class(_pairs(spark, sf_dir))


@query(
    "topic_accuracy",
    f"WITH {_PAIRS} SELECT round(avg(CAST(predicted_class = gold_class AS INTEGER)), 4) AS topic_accuracy FROM pairs",
)
def topic_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.topic_accuracy(_pairs(spark, sf_dir), [*CATEGORIES, "Other"])


@query(
    "validation_report",
    f"""WITH {_PAIRS}, a AS (SELECT count(*) AS n, avg(CAST(predicted = gold AS INTEGER)) AS s FROM pairs)
    SELECT n, round(s, 4) AS overall_accuracy, round(s, 4) AS sentiment_accuracy, CAST(NULL AS DOUBLE) AS tier1_topic_accuracy,
           concat(printf('%.1f', s * 100), '%') AS display FROM a""",
)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    # 'Other' is not a configured class, so topic accuracy does not count here.
    report = validation.validation_report(_pairs(spark, sf_dir), CATEGORIES)
    return report.drop("sentiment_recall_by_class")


def _cohorts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings of the lower labels as baseline, of the upper labels as the current batch."""
    rows = table(spark, sf_dir, "embeddings").withColumn("features", as_vector(F.col("embedding")))
    return rows.where(F.col("label") < 5), rows.where(F.col("label") >= 5)


_DRIFT = """
x AS (SELECT vec_id, label < 5 AS base, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT base, pos, avg(v) AS m FROM x GROUP BY base, pos),
norms AS (SELECT base, greatest(sqrt(sum(m * m)), 1e-9) AS n FROM means GROUP BY base),
cents AS (SELECT base, pos, m / n AS c FROM means JOIN norms USING (base))"""


@query(
    "centroid_drift",
    f"""WITH {_DRIFT} SELECT round(1 - sum(a.c * b.c), 4) AS centroid_cosine_distance
    FROM cents a JOIN cents b USING (pos) WHERE a.base AND NOT b.base""",
)
def centroid_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.centroid_drift(*_cohorts(spark, sf_dir))


def _psi_ctes(rows: str) -> str:
    """CTEs ending in ``idx(psi)`` from a CTE ``obs(base, v)``."""
    return f"""{rows},
edges AS (SELECT list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM obs WHERE base),
binned AS (SELECT base, len(list_filter(e[2:-2], lambda t: v >= t)) AS bin FROM obs, edges),
axis AS (SELECT unnest(range(0, len(e) - 1)) AS bin FROM edges),
sizes AS (SELECT count(*) FILTER (WHERE base) AS ne, count(*) FILTER (WHERE NOT base) AS na FROM obs),
shares AS (SELECT axis.bin, greatest(count(binned.bin) FILTER (WHERE base) / any_value(ne), 1e-4) AS e,
                  greatest(count(binned.bin) FILTER (WHERE NOT base) / any_value(na), 1e-4) AS a
           FROM axis LEFT JOIN binned ON axis.bin = binned.bin, sizes GROUP BY axis.bin),
idx AS (SELECT sum((a - e) * ln(a / e)) AS psi FROM shares)"""


_STATUS = "CASE WHEN psi < 0.10 THEN 'Low' WHEN psi < 0.25 THEN 'Moderate' ELSE 'High' END"


_SIMILAR = "obs AS (SELECT x.base, sum(v * c) AS v FROM x JOIN cents USING (pos) WHERE cents.base GROUP BY vec_id, x.base)"


@query(
    "psi_drift",
    f"""WITH {_DRIFT}, {_psi_ctes(_SIMILAR)}
    SELECT round(psi, 4) AS psi, {_STATUS} AS status, concat({_STATUS}, printf(' (%.2f)', psi)) AS display,
      (SELECT round(1 - sum(a.c * b.c), 4) FROM cents a JOIN cents b USING (pos) WHERE a.base AND NOT b.base)
        AS centroid_cosine_distance, false AS degenerate FROM idx""",
)
def psi_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.embedding_drift(*_cohorts(spark, sf_dir))


@query(
    "psi_text_length",
    f"""WITH {_psi_ctes('obs AS (SELECT true AS base, CAST(length(text) AS DOUBLE) AS v FROM documents UNION ALL SELECT false, CAST(length(text) AS DOUBLE) FROM conversations)')}
    SELECT round(psi, 4) AS psi, {_STATUS} AS status FROM idx""",
)
def psi_text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    def lengths(name: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.length("text").cast("double").alias("chars"))

    index = drift.psi(lengths("documents"), lengths("conversations"), "chars")
    return index.select(F.round("psi", 4).alias("psi"), drift.drift_status(F.col("psi")).alias("status"))


# Days are batches; the first ten are the baseline, and every later ISO week is a window.
_WINDOWED = """obs AS (SELECT value AS v, CAST(ts AS DATE) < DATE '2024-01-11' AS base, date_trunc('week', CAST(ts AS DATE)) AS week FROM events),
edges AS (SELECT list_sort(list_distinct(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM obs WHERE base),
binned AS (SELECT base, week, len(list_filter(e[2:-2], lambda t: v >= t)) AS bin FROM obs, edges),
per AS (SELECT bin, count(*) / sum(count(*)) OVER () AS e FROM binned WHERE base GROUP BY bin),
axis AS (SELECT bin, week, n FROM per, (SELECT week, count(*) AS n FROM binned WHERE NOT base GROUP BY week)),
shares AS (SELECT axis.week, any_value(axis.n) AS n, axis.bin, greatest(any_value(per.e), 1e-4) AS e, greatest(count(b.bin) / any_value(axis.n), 1e-4) AS a
    FROM axis JOIN per USING (bin) LEFT JOIN binned b ON NOT b.base AND b.bin = axis.bin AND b.week = axis.week GROUP BY axis.week, axis.bin)"""


@query(
    "drift_windows",
    f"""WITH {_WINDOWED} SELECT CAST(week AS DATE) AS week, any_value(n) AS n, round(sum((a - e) * ln(a / e)), 6) AS psi, true AS within
    FROM shares GROUP BY week""",
)
def drift_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly drift from stored daily sketches beside the exact index, and whether the sketches' stays within its stated error."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), F.col("value").alias("v"))
    path = scratch_path(spark, "sketches")
    drift_sketches.save_sketches(drift_sketches.sketch(rows, "v", ["day"]), path, "day")
    stored = drift_sketches.stored_sketches(spark, path, "sketch binary, day date")
    is_base = F.col("day") < F.lit("2024-01-11").cast("date")
    week = F.date_trunc("week", "day").cast("date").alias("week")
    current = drift_sketches.merge(stored.where(~is_base).select("sketch", week), ["week"])
    found = drift_sketches.psi_from_sketches(drift_sketches.merge(stored.where(is_base)), current, ["week"])
    exact = None
    later = rows.where(~is_base).select("v", week)
    for r in later.select("week").distinct().orderBy("week").collect():  # a row a week
        one = drift.psi(rows.where(is_base), later.where(F.col("week") == r["week"]), "v").select(F.lit(r["week"]).alias("week"), F.col("psi").alias("exact"))
        exact = one if exact is None else exact.unionByName(one)
    both = found.join(exact, "week")
    return both.select("week", "n", F.round("exact", 6).alias("psi"), (F.abs(F.col("psi") - F.col("exact")) <= F.col("psi_error")).alias("within"))
