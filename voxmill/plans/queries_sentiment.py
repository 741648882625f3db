"""Sentiment queries over the review view and documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.config import ALTERNATE_LABELS, DEFAULT_LEXICON
from voxmill.operators import sentiment
from voxmill.operators.analytics import kpi_estimates as estimate_kpis
from voxmill.operators.analytics import sentiment_breakdown as breakdown_of
from voxmill.operators.highlight import highlight_counts
from voxmill.operators.highlight import highlight_terms as highlight
from voxmill.plans.catalog import query
from voxmill.plans.views import DOCUMENT_LEXICON, MEAN, R, lexicon_cte, lexicon_ctes, reviews, wide_texts

_COUNTS = """count(*) FILTER (WHERE sentiment_label = 'Positive') AS positive,
  count(*) FILTER (WHERE sentiment_label = 'Neutral') AS neutral,
  count(*) FILTER (WHERE sentiment_label NOT IN ('Positive', 'Neutral')) AS negative"""

# Largest remainder over three rows (class, count), ties to the earlier class.
PERCENT = f"""cnt AS (SELECT {_COUNTS}, count(*) AS total FROM r),
parts AS (SELECT i, name, n, total FROM cnt, LATERAL (VALUES (1, 'positive', positive), (2, 'neutral', neutral),
          (3, 'negative', negative)) AS v(i, name, n)),
floors AS (SELECT *, CAST(n * 100 // total AS INTEGER) AS f, (n * 100) % total AS rest FROM parts),
pct AS (SELECT name, f + CASE WHEN row_number() OVER (ORDER BY rest DESC, i) <= 100 - sum(f) OVER () THEN 1 ELSE 0 END AS p
        FROM floors),
shares AS (SELECT max(p) FILTER (WHERE name = 'positive') AS positive_pct,
                  max(p) FILTER (WHERE name = 'neutral') AS neutral_pct,
                  max(p) FILTER (WHERE name = 'negative') AS negative_pct FROM pct)"""


@query(
    "sentiment_labels",
    f"""WITH {R} SELECT "row", sentiment_score, sentiment_label,
    CASE WHEN sentiment_score <= -0.75 THEN 'Strongly Negative' WHEN sentiment_score < -0.15 THEN 'Negative'
         WHEN sentiment_score <= 0.15 THEN 'Neutral' ELSE 'Positive' END AS alternate_label FROM r""",
)
def sentiment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("sentiment_score")
    return reviews(spark, sf_dir).select(
        "row",
        "sentiment_score",
        sentiment.label_sentiment(score).alias("sentiment_label"),
        sentiment.label_sentiment(score, ALTERNATE_LABELS).alias("alternate_label"),
    )


_SUMMARY = f"""WITH {R}, s AS (SELECT count(*) AS total_reviews, {_COUNTS}, round({MEAN}, 4) AS mean_score FROM r)
SELECT total_reviews, positive, neutral, negative,
       round((positive - negative) * 100.0e0 / total_reviews, 1) AS net_sentiment_score, mean_score,
       CASE WHEN (positive - negative) * 100.0e0 / total_reviews <= -10 THEN 'Negative Trend'
            WHEN (positive - negative) * 100.0e0 / total_reviews >= 10 THEN 'Positive Trend'
            ELSE 'Mixed Trend' END AS overall_sentiment FROM s"""


@query("sentiment_summary", _SUMMARY)
def sentiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.summarize_sentiment(reviews(spark, sf_dir))


@query("sentiment_percent", f"WITH {R}, {PERCENT} SELECT * FROM shares")
def sentiment_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.sentiment_percent(reviews(spark, sf_dir))


_BREAKDOWN = f"""WITH {R}, {PERCENT}, c AS (SELECT count(*) FILTER (WHERE sentiment_label = 'Positive') AS positive,
    count(*) FILTER (WHERE sentiment_label = 'Neutral') AS neutral,
    count(*) FILTER (WHERE sentiment_label = 'Negative') AS negative,
    count(*) FILTER (WHERE sentiment_label = 'Strongly Negative') AS strongly_negative,
    count(*) AS total_reviews FROM r)"""


@query("sentiment_breakdown", f"{_BREAKDOWN} SELECT * FROM shares, c")
def sentiment_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown_of(reviews(spark, sf_dir))


@query(
    "kpi_estimates",
    f"""{_BREAKDOWN} SELECT total_reviews, CAST(floor(total_reviews * positive_pct / 100.0e0 + 0.5) AS BIGINT) AS positive_reviews,
    CAST(floor(total_reviews * neutral_pct / 100.0e0 + 0.5) AS BIGINT) AS neutral_reviews,
    CAST(floor(total_reviews * negative_pct / 100.0e0 + 0.5) AS BIGINT) AS negative_reviews FROM shares, c""",
)
def kpi_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate_kpis(breakdown_of(reviews(spark, sf_dir)))


@query(
    "rating_blend",
    f"""WITH {R} SELECT "row", CAST(round(greatest(-1, least(1, CASE WHEN "row" % 7 = 0 THEN CAST(sentiment_score AS DECIMAL(18,4))
      ELSE CAST(sentiment_score AS DECIMAL(18,4)) * 0.6 + (CAST(rating AS DECIMAL(18,4)) - 3) * 0.2 END)), 2) AS DOUBLE) AS blended
    FROM r""",
)
def rating_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    some_unrated = reviews(spark, sf_dir).withColumn("rating", F.when(F.col("row") % 7 != 0, F.col("rating")))
    return sentiment.blend_rating(some_unrated).select("row", "blended")


@query("lexicon_sentiment", f"""WITH {R}, {lexicon_ctes('r', '"row"', DEFAULT_LEXICON)} SELECT id AS "row", sentiment_score FROM scored""")
def lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.score_lexicon(reviews(spark, sf_dir, wide=True), DEFAULT_LEXICON).select("row", "sentiment_score")


@query(
    "dedup_score",
    f"""WITH {lexicon_ctes('documents', 'doc_id', DOCUMENT_LEXICON)} SELECT id AS doc_id, sentiment_score FROM scored""",
)
def dedup_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = wide_texts(spark, sf_dir, "documents").select("doc_id", "text")
    scored = sentiment.score_distinct(docs, lambda d: sentiment.score_lexicon(d, DOCUMENT_LEXICON), "doc_id")
    return scored.select("doc_id", "sentiment_score")


@query("highlight_terms")
def highlight_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return highlight(reviews(spark, sf_dir, wide=True), DEFAULT_LEXICON).select("row", "highlights")


_STEMS = """CASE WHEN w LIKE '%ed' THEN [w[:-3], w[:-2]] WHEN w LIKE '%ing' THEN [w[:-4], w[:-4] || 'e']
  WHEN w LIKE '%es' THEN [w[:-3], w[:-2]] WHEN w LIKE '%s' THEN [w[:-2]] WHEN w LIKE '%ly' THEN [w[:-3]] ELSE [] END"""


def _highlight_oracle(source: str, lexicon: Mapping[str, float]) -> str:
    return f"""{lexicon_cte(lexicon)}, words AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*'))) AS w FROM {source}),
seen AS (SELECT w, count(*) AS n FROM words GROUP BY w),
stems AS (SELECT w, n, unnest([w] || {_STEMS}) AS stem, generate_subscripts([w] || {_STEMS}, 1) AS k FROM seen),
valued AS (SELECT w, n, arg_min(v, k) AS v FROM stems JOIN lex ON stem = term GROUP BY w, n),
phrases AS (SELECT term, v, sum((length(text) - length(replace(lower(text), term, ''))) // length(term)) AS n
            FROM {source}, lex WHERE contains(term, ' ') AND contains(lower(text), term) GROUP BY term, v),
both_kinds AS (SELECT w AS term, v, n FROM valued UNION ALL SELECT term, v, n FROM phrases)
SELECT term, CASE WHEN v > 0 THEN 'positive' ELSE 'negative' END AS polarity, CAST(n AS BIGINT) AS hits
FROM both_kinds WHERE abs(v) >= 1.5"""


@query("highlight_term_counts", f"WITH {R}, {_highlight_oracle('r', DEFAULT_LEXICON)}")
def highlight_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return highlight_counts(highlight(reviews(spark, sf_dir, wide=True), DEFAULT_LEXICON))


@query("highlight_document_terms", f"WITH {_highlight_oracle('documents', DOCUMENT_LEXICON)}")
def highlight_document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return highlight_counts(highlight(wide_texts(spark, sf_dir, "documents"), DOCUMENT_LEXICON))
