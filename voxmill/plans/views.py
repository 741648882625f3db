"""Review, run and text views derived from the test tables.

The SQL is written in the dialect both engines share. ``{events}`` and ``{orders}`` stand for the source.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from voxmill.functions.text import DOMAIN_STOPWORDS
from voxmill.operators.scale import spread
from voxmill.operators.sentiment import BOOSTERS, DAMPENERS, NEGATIONS

# The term queries take their stop words as a parameter, so that the SQL can name the same ones.
STOPWORDS = (
    *DOMAIN_STOPWORDS, "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "not", "of", "on", "or", "that",
    "the", "this", "to", "was", "with",
)

# Valences for the invented words of the documents table, with a phrase and with words below the threshold.
DOCUMENT_LEXICON = {
    "thing": 2.1,
    "tion": 1.9,
    "pour": 1.7,
    "est": 1.2,
    "ing": 0.7,
    "sich": -1.6,
    "thly": -1.8,
    "nicht": -2.4,
    "worthless": -2.6,
    "by the": 1.6,
}

TEMPLATES = (
    "The video stream keeps buffering and playback is terrible.",
    "I really love the new subtitle options on live episodes.",
    "My comment never shows and nobody can reply to my friends.",
    "Sharing a profile with the community is great fun.",
    "They charged me twice and the refund is a waste of time.",
    "The premium plan is not good and the price is awful.",
    "It will crash on startup and the battery drains fast.",
    "After the update loading is extremely slow but fine.",
    "Dark mode and the new menu are an excellent design.",
    "The search button is confusing and I hate the layout.",
    "We moved to another city last week.",
    "It annoys me, yet support was helpful.",
)

_TEXT = "CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TEMPLATES)) + " END"
_SECRET = """CASE WHEN event_id % 13 <> 0 THEN ''
     WHEN event_id % 4 = 0 THEN concat(' Write to u', CAST(user_id AS STRING), '@mail.example.com')
     WHEN event_id % 4 = 1 THEN ' My card is 4111 1111 1111 1111.'
     WHEN event_id % 4 = 2 THEN concat(' Seen from 10.20.', CAST(user_id % 256 AS STRING), '.7')
     ELSE concat(' Call 415-555-', lpad(CAST(event_id % 10000 AS STRING), 4, '0')) END"""

REVIEWS = f"""
SELECT *, CASE WHEN sentiment_score >= 0.25 THEN 'Positive'
               WHEN sentiment_score <= -0.60 THEN 'Strongly Negative'
               WHEN sentiment_score <= -0.25 THEN 'Negative'
               ELSE 'Neutral' END AS sentiment_label
FROM (SELECT event_id AS "row", event_id AS source_row, event_type, user_id,
             CAST(ts AS DATE) AS date, CAST(1 + event_id % 5 AS DOUBLE) AS rating,
             round(greatest(-1.0, least(1.0, (40 - value) / 60)), 4) AS sentiment_score,
             CASE WHEN event_id % 12 = 11 THEN NULL ELSE event_type END AS theme_id,
             CASE WHEN event_type IN ('click', 'view') THEN 'Navigation'
                  WHEN event_type = 'error' THEN 'Stability' ELSE 'Account' END AS general_class,
             concat({_TEXT}, {_SECRET}) AS text
      FROM {{events}}) AS base
"""

# One ISO week without any date.
REVIEWS_GAP = f"""
SELECT "row", event_type, theme_id, sentiment_score, sentiment_label,
       CASE WHEN date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' THEN NULL ELSE date END AS date
FROM ({REVIEWS}) AS r
"""

# Raw uploads: blank texts, dates in nine shapes, ratings that are no numbers.
UPLOADS = f"""
SELECT source_row,
       CASE WHEN source_row % 17 = 0 THEN concat(' ', chr(9), ' ') ELSE concat(chr(10), text, '  ') END AS review_text,
       CASE source_row % 9
            WHEN 0 THEN ds
            WHEN 1 THEN replace(ds, '-', '/')
            WHEN 2 THEN concat(substr(ds, 9, 2), '-', substr(ds, 6, 2), '-', substr(ds, 1, 4))
            WHEN 3 THEN concat(substr(ds, 6, 2), '/', substr(ds, 9, 2), '/', substr(ds, 1, 4))
            WHEN 4 THEN concat(ds, 'T10:20:30')
            WHEN 5 THEN concat(ds, 'T23:59:59+05:30')
            WHEN 6 THEN ''
            WHEN 7 THEN 'nan'
            ELSE '31/12/2026' END AS date,
       CASE WHEN source_row % 19 = 0 THEN 'n/a' ELSE CAST(rating AS STRING) END AS rating
FROM (SELECT *, CAST(date AS STRING) AS ds FROM ({REVIEWS}) AS r) AS d
"""

RUNS = """
SELECT CAST(o_orderkey AS STRING) AS job_id, o_orderkey AS run_key, CAST(o_orderdate AS TIMESTAMP) AS created_at,
       CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PROCESSING' ELSE 'QUEUED' END AS status,
       o_totalprice / 1000 AS rows_per_second
FROM {orders}
"""
NOW = "2001-08-02 00:00:00"


def duck(sql: str) -> str:
    return sql.replace("{events}", "events").replace("{orders}", "orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, spread over the cores when its files are too few to do so."""
    return spread(table(spark, sf_dir, name))


def view(spark: SparkSession, sf_dir: str, sql: str, wide: bool = False) -> DataFrame:
    """A derived view; ``wide`` spreads a small scan over the cores. Double-quoted names become back-quoted ones."""
    read = wide_texts if wide else table
    sources = {n: read(spark, sf_dir, n) for n in ("events", "orders") if "{" + n + "}" in sql}
    return spark.sql(sql.replace('"', "`"), **sources)


def reviews(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    return view(spark, sf_dir, REVIEWS, wide)


def uploads(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    return view(spark, sf_dir, UPLOADS, wide)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RUNS)


# ---------------------------------------------------------------- pieces of DuckDB SQL
R = f"r AS ({duck(REVIEWS)})"
G = f"g AS ({duck(REVIEWS_GAP)})"
U = f"u AS ({duck(UPLOADS)})"
RUN = f"runs AS ({duck(RUNS)})"

MEAN = "CAST(sum(CAST(sentiment_score AS DECIMAL(18,4))) AS DOUBLE) / count(*)"
THEMES = f"""themes AS (
  SELECT *, CASE WHEN m >= 0.25 THEN 'Positive' WHEN m <= -0.60 THEN 'Strongly Negative'
                 WHEN m <= -0.25 THEN 'Negative' ELSE 'Neutral' END AS sentiment, round(m, 2) AS sentiment_score
  FROM (SELECT theme_id, min(general_class) AS general_class, count(*) AS count, {MEAN} AS m
        FROM r WHERE theme_id IS NOT NULL GROUP BY theme_id))"""


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def lexicon_cte(lexicon: Mapping[str, float]) -> str:
    rows = ", ".join(f"('{t}', CAST({v} AS DOUBLE))" for t, v in lexicon.items())
    return f"lex AS (SELECT * FROM (VALUES {rows}) AS l(term, v))"


def _shift(before: str, factor: float) -> str:
    return (
        f"CASE WHEN {before} IN ({_quoted(BOOSTERS)}) THEN {0.293 * factor!r}e0"
        f" WHEN {before} IN ({_quoted(DAMPENERS)}) THEN -{0.293 * factor!r}e0 ELSE 0e0 END"
    )


def lexicon_ctes(source: str, id_col: str, lexicon: Mapping[str, float] | None, text: str = "text") -> str:
    """CTEs ending in ``scored(id, sentiment_score)`` for the lexicon scorer over ``source``; without a lexicon ``lex`` stands before."""
    negated = " OR ".join(f"coalesce(p{i} IN ({_quoted(NEGATIONS)}), false)" for i in (1, 2, 3))
    given = f"{lexicon_cte(lexicon)}," if lexicon is not None else ""
    return f"""{given}
toks AS (SELECT {id_col} AS id, list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS ts
         FROM {source}),
tok AS (SELECT id, unnest(ts) AS w, generate_subscripts(ts, 1) AS pos FROM toks),
ctx AS (SELECT *, lag(w, 1) OVER p AS p1, lag(w, 2) OVER p AS p2, lag(w, 3) OVER p AS p3
        FROM tok WINDOW p AS (PARTITION BY id ORDER BY pos)),
hit AS (SELECT id, (v + sign(v) * ({_shift('p1', 1.0)}) + sign(v) * ({_shift('p2', 0.95)}) + sign(v) * ({_shift('p3', 0.9)}))
                   * CASE WHEN {negated} THEN -0.74e0 ELSE 1e0 END AS x
        FROM ctx JOIN lex ON ctx.w = lex.term),
sums AS (SELECT id, sum(x) AS s FROM hit GROUP BY id),
scored AS (SELECT toks.id, round(greatest(-1e0, least(1e0, coalesce(s / sqrt(s * s + 15e0), 0e0))), 4) AS sentiment_score
           FROM toks LEFT JOIN sums USING (id))"""


LABEL_OF = """CASE WHEN {0} >= 0.25 THEN 'Positive' WHEN {0} <= -0.60 THEN 'Strongly Negative'
              WHEN {0} <= -0.25 THEN 'Negative' ELSE 'Neutral' END"""
