"""Queries with lexicons that are tables: their terms are taken from the texts of the test tables themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.operators.highlight import highlight_spans
from voxmill.operators.sentiment import score_lexicon_table
from voxmill.plans.catalog import query
from voxmill.plans.queries_sentiment import _STEMS
from voxmill.plans.views import R, lexicon_ctes, reviews, table, wide_texts

# Every word of all documents and reviews, and the reviews' first pairs and triples of words, with a valence from -3 to 3 by their length.
_LEXICON = """
spoken AS (SELECT DISTINCT text FROM r),
every_term AS (
    SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS term FROM documents
    UNION SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) FROM spoken
    UNION SELECT lower(array_to_string(string_split(text, ' ')[k:k + n - 1], ' '))
        FROM spoken, (SELECT unnest([1, 2, 3, 4, 5]) AS k), (SELECT unnest([2, 3]) AS n)),
lex AS (SELECT term, CAST(length(term) % 7 - 3 AS DOUBLE) AS v FROM every_term WHERE term <> '')"""


def _lexicon(spark: SparkSession, sf_dir: str, spoken: DataFrame) -> DataFrame:
    # A text's words count once before they become rows.
    in_text = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    words = [t.select(F.explode(in_text).alias("term")) for t in (table(spark, sf_dir, "documents"), spoken)]
    parts = F.split("text", " ")
    stretches = F.array(*[F.array_join(F.slice(parts, k, n), " ") for k in range(1, 6) for n in (2, 3)])
    terms = words[0].union(words[1]).union(spoken.select(F.explode(stretches))).select(F.lower("term").alias("term")).distinct()
    return terms.where(F.col("term") != "").select("term", (F.length("term") % 7 - 3).cast("double").alias("valence"))


@query(
    "highlight_spans",
    f"""WITH {R}, {_LEXICON},
    t0 AS (SELECT text, regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*') AS m, regexp_split_to_array(text, '[A-Za-z][A-Za-z''-]*') AS g FROM spoken),
    t1 AS (SELECT text, unnest(m) AS w, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS k FROM t0),
    t2 AS (SELECT text, w AS word, lower(w) AS w, CAST(sum(length(gap) + length(w)) OVER (PARTITION BY text ORDER BY k) AS BIGINT) AS e FROM t1),
    seen AS (SELECT DISTINCT w FROM t2),
    stems AS (SELECT w, unnest([w] || {_STEMS}) AS stem, generate_subscripts([w] || {_STEMS}, 1) AS k FROM seen),
    valued AS (SELECT w, arg_min(v, k) AS v FROM stems JOIN lex ON stem = term GROUP BY w),
    phrases AS (SELECT text, term, v, string_split(lower(text), term) AS pieces FROM spoken JOIN lex
        ON contains(term, ' ') AND abs(v) >= 1.5 AND contains(lower(text), term)),
    places AS (SELECT text, term, v, pieces, unnest(range(1, len(pieces))) AS k FROM phrases),
    claims AS (
        SELECT text, 1 AS kind, length(term) AS size, term AS key, v, (k - 1) * length(term) + CAST(list_sum(list_transform(pieces[1:k], lambda x: length(x))) AS BIGINT) AS s,
            s + length(term) AS e, text[s + 1:e] AS shown FROM places
        UNION ALL SELECT text, 2, 0, '', v, e - length(word), e, word FROM t2 JOIN valued USING (w) WHERE abs(v) >= 1.5),
    ordered AS (SELECT text, list([{{'s': s, 'e': e, 'v': v, 'shown': shown}}] ORDER BY kind, size DESC, key, s) AS c FROM claims GROUP BY text),
    held AS (SELECT text, unnest(list_reduce(c, lambda acc, x:
        CASE WHEN len(list_filter(acc, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN acc ELSE acc || x END)) AS h FROM ordered)
    SELECT "row", h.s AS begins, h.e AS ends, CASE WHEN h.v > 0 THEN 'positive' ELSE 'negative' END AS polarity, h.shown AS term FROM r JOIN held USING (text)""",
)
def spans_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir, wide=True)
    lexicon = _lexicon(spark, sf_dir, rows.select("text").distinct())
    spans = highlight_spans(rows, lexicon, "row").select("row", F.inline("highlights"))
    return spans.select("row", F.col("start").cast("long").alias("begins"), F.col("end").cast("long").alias("ends"), "polarity", "term")


@query(
    "lexicon_table_sentiment",
    f"WITH {R}, {_LEXICON}, {lexicon_ctes('documents', 'doc_id', None)} SELECT id AS doc_id, sentiment_score FROM scored",
)
def table_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = _lexicon(spark, sf_dir, reviews(spark, sf_dir, wide=True).select("text").distinct())
    return score_lexicon_table(wide_texts(spark, sf_dir, "documents"), lexicon, "doc_id")
