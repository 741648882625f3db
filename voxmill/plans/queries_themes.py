"""Theme queries: classes, clusters, names, representatives, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.config import CATEGORIES, DEFAULT_LEXICON, Config
from voxmill.operators import themes
from voxmill.operators.density import Density, density_cluster
from voxmill.operators.features import as_vector, centroids, hashed_tf, similarity_to_centroid
from voxmill.operators.drift import publish_baseline
from voxmill.operators.scale import materialised, scratch_path, spread
from voxmill.plans.catalog import query
from voxmill.plans.engine import AnalysisEngine
from voxmill.plans.queries_pii import _REDACTED
from voxmill.plans.queries_reads import review_themes
from voxmill.plans.queries_sentiment import PERCENT
from voxmill.plans.views import LABEL_OF, MEAN, STOPWORDS, THEMES, R, lexicon_ctes, reviews, table, uploads, wide_texts

_W = "\\p{L}\\p{N}_"


def _re2(pattern: str) -> str:
    if pattern.startswith("\\b"):
        pattern = f"(?:^|[^{_W}])" + pattern[2:]
    return pattern[:-2] + f"(?:[^{_W}]|$)" if pattern.endswith("\\b") else pattern


def _class_oracle(source: str, id_col: str, text: str = "text") -> str:
    """CTE ``classed(id, general_class, confidence)``."""
    hits = []
    for i, patterns in enumerate(themes.class_patterns(CATEGORIES).values()):
        tests = " + ".join(f"CAST(regexp_matches(t, '{_re2(p)}') AS INTEGER)" for p in patterns)
        hits.append(f"{tests} AS h{i}")
    total = " + ".join(f"h{i}" for i in range(len(CATEGORIES)))
    best = "greatest(" + ", ".join(f"h{i}" for i in range(len(CATEGORIES))) + ")"
    names = " ".join(f"WHEN h{i} = {best} THEN '{c}'" for i, c in enumerate(CATEGORIES))
    return f"""hits AS (SELECT id, {', '.join(hits)} FROM (SELECT {id_col} AS id, lower({text}) AS t FROM {source})),
classed AS (SELECT id, CASE WHEN {total} = 0 THEN 'Other' {names} END AS general_class,
  CASE WHEN {total} = 0 THEN 0e0 ELSE CAST({best} AS DOUBLE) / ({total}) END AS confidence FROM hits)"""


@query("classify_general", f"""WITH {R}, {_class_oracle('r', '"row"')} SELECT id AS "row", general_class, round(confidence, 6) AS confidence FROM classed""")
def classify_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    classed = themes.classify_keywords(reviews(spark, sf_dir, wide=True).drop("general_class"))
    return classed.select("row", "general_class", F.round("confidence", 6).alias("confidence"))


@query(
    "classify_documents",
    f"WITH {_class_oracle('documents', 'doc_id')} SELECT id AS doc_id, general_class, round(confidence, 6) AS confidence FROM classed",
)
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    classed = themes.classify_keywords(wide_texts(spark, sf_dir, "documents"))
    return classed.select("doc_id", "general_class", F.round("confidence", 6).alias("confidence"))


@query(
    "confidence_floor",
    f"""WITH {_class_oracle('documents', 'doc_id')} SELECT id AS doc_id, round(confidence, 6) AS confidence,
    CASE WHEN confidence < 0.3 THEN 'Other' ELSE general_class END AS general_class FROM classed""",
)
def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    classed = themes.confidence_floor(themes.classify_keywords(wide_texts(spark, sf_dir, "documents")))
    return classed.select("doc_id", "general_class", F.round("confidence", 6).alias("confidence"))


@query(
    "class_facets",
    f"WITH {R}, {THEMES} SELECT general_class, CAST(sum(count) AS BIGINT) AS count FROM themes GROUP BY general_class",
)
def class_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.class_facets(review_themes(reviews(spark, sf_dir)))


@query(
    "class_theme_rollup",
    f"""WITH {R} SELECT general_class, theme_id, CAST(grouping(general_class, theme_id) AS BIGINT) AS level, count(*) AS reviews,
      round({MEAN}, 4) AS mean_score FROM r WHERE theme_id IS NOT NULL GROUP BY ROLLUP (general_class, theme_id)""",
)
def class_theme_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes.class_theme_rollup(reviews(spark, sf_dir))


@query("theme_stats", f"WITH {R}, {THEMES} SELECT theme_id, general_class, count, sentiment, sentiment_score FROM themes")
def theme_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_themes(reviews(spark, sf_dir))


@query(
    "theme_assignment",
    f"""WITH {R}, c AS (SELECT general_class, event_type, count(*) AS n FROM r GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (ORDER BY n DESC, general_class, event_type) AS p FROM c)
    SELECT "row", CASE WHEN p <= 3 THEN concat('theme-', CAST(p AS VARCHAR)) END AS theme_id FROM r JOIN k USING (general_class, event_type)""",
)
def theme_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews(spark, sf_dir).drop("theme_id")
    keys = ["general_class", "event_type"]
    clusters = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"))
    kept = themes.rank_and_cap(clusters, [F.asc(k) for k in keys], max_themes=3)
    return themes.assign_theme(rows, kept, keys).select("row", "theme_id")


@query(
    "theme_invariants",
    f"""WITH {R}, stored AS (SELECT theme_id, count(*) AS stored FROM r WHERE theme_id IS NOT NULL AND ("row" % 9 <> 0 OR theme_id = 'view') GROUP BY theme_id
      UNION ALL SELECT 'retired', 7), carried AS (SELECT theme_id, count(*) AS carried FROM r WHERE theme_id IS NOT NULL GROUP BY theme_id)
    SELECT theme_id, stored, carried FROM stored FULL JOIN carried USING (theme_id) WHERE stored IS DISTINCT FROM carried""",
)
def theme_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes whose stored count misses every ninth review, one that is right, and one that no review carries."""
    rows = reviews(spark, sf_dir)
    stored = review_themes(rows.where((F.col("row") % 9 != 0) | (F.col("theme_id") == "view"))).select("theme_id", "count")
    retired = spark.createDataFrame([("retired", 7)], "theme_id string, count long")
    return themes.theme_invariants(rows, stored.unionByName(retired))


@query(
    "unique_names",
    f"""WITH {R}, c AS (SELECT general_class, event_type, sentiment_label, count(*) AS members FROM r GROUP BY ALL),
    k AS (SELECT *, concat(general_class, ' Feedback') AS base, row_number() OVER (PARTITION BY general_class
          ORDER BY event_type, sentiment_label) AS k FROM c)
    SELECT general_class, event_type, sentiment_label, members,
      CASE WHEN k = 1 THEN base ELSE concat(base, ' (', CAST(k AS VARCHAR), ')') END AS name FROM k""",
)
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = (
        reviews(spark, sf_dir)
        .groupBy("general_class", "event_type", "sentiment_label")
        .agg(F.count(F.lit(1)).alias("members"))
        .withColumn("name", F.concat("general_class", F.lit(" Feedback")))
    )
    return themes.unique_names(clusters, [F.asc("event_type"), F.asc("sentiment_label")])


# ---------------------------------------------------------------- vectors
def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.withColumn("features", as_vector(F.col("embedding"))).withColumn("all", F.lit("all"))


_CENTROIDS = """
x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(v) AS m FROM x WHERE {where} GROUP BY label, pos),
norms AS (SELECT label, greatest(sqrt(sum(m * m)), 1e-9) AS n FROM means GROUP BY label),
cents AS (SELECT label, pos, m / n AS c FROM means JOIN norms USING (label))"""


@query(
    "group_centroids",
    f"WITH {_CENTROIDS.format(where='true')} SELECT label, CAST(pos AS INTEGER) AS pos, round(c, 6) AS value FROM cents",
)
def group_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = centroids(_vectors(spark, sf_dir), ["label"])
    flat = cents.select("label", F.posexplode("centroid").alias("pos", "value"))
    return flat.select("label", (F.col("pos") + 1).alias("pos"), F.round("value", 6).alias("value"))


_SIMS = f"""{_CENTROIDS.format(where='true')},
sims AS (SELECT vec_id, label, sum(v * c) AS similarity FROM x JOIN cents USING (label, pos) GROUP BY vec_id, label)"""


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return similarity_to_centroid(rows, centroids(rows, ["label"]), "label", "vec_id")


@query("centroid_similarity", f"WITH {_SIMS} SELECT vec_id, label, round(similarity, 6) AS similarity FROM sims")
def centroid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query(
    "merge_small",
    f"""WITH kept AS (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 50),
    {_CENTROIDS.format(where='label IN (SELECT label FROM kept)')},
    s AS (SELECT vec_id, cents.label AS target, sum(v * c) AS sim FROM x JOIN cents USING (pos) GROUP BY ALL),
    near AS (SELECT vec_id, target FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, target) AS k FROM s)
             WHERE k = 1),
    moved AS (SELECT vec_id, CASE WHEN label IN (SELECT label FROM kept) THEN label ELSE target END AS label
              FROM embeddings JOIN near USING (vec_id))
    SELECT vec_id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS cluster FROM moved""",
)
def merge_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = themes.merge_small(_vectors(spark, sf_dir), "all", "vec_id", label="label", min_size=50)
    return merged.select("vec_id", "cluster")


@query(
    "representatives",
    f"""WITH {_SIMS}, d AS (SELECT sims.label, vec_id, round(similarity, 9) AS sim, text,
        trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key,
        CAST(length(text) BETWEEN 15 AND 280 AS INTEGER) AS fits FROM sims JOIN documents ON vec_id = doc_id),
    one AS (SELECT *, row_number() OVER (PARTITION BY label, key ORDER BY fits DESC, sim DESC, vec_id) AS k FROM d),
    top AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY fits DESC, sim DESC, vec_id) AS position
            FROM one WHERE k = 1)
    SELECT label, CAST(position AS INTEGER) AS position, vec_id FROM top WHERE position <= 5""",
)
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    joined = _similar(spark, sf_dir).select("vec_id", "label", F.round("similarity", 9).alias("similarity")).join(texts, "vec_id")
    return themes.representatives(joined, ["label"], "similarity", "vec_id").select("label", "position", "vec_id")


@query("hashed_tf")
def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    rows = hashed_tf(wide_texts(spark, sf_dir, "documents"))
    values = F.filter(vector_to_array("features"), lambda x: x > 0)
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("doc_id", F.size(values).alias("buckets"), F.round(norm, 6).alias("norm"))


@query("cluster_reviews")
def cluster_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).withColumn("label", F.col("label").cast("string"))
    clustered = themes.cluster_within(rows, "label", cfg=Config())
    clustered = materialised(clustered.select("label", "vec_id", "features", "cluster"), "clustered")
    merged = themes.merge_small(clustered, "label", "vec_id")
    return merged.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("members"))


# Three dense clouds, one for each rest of the label by three, and every ninth vector alone, far out.
_CLOUDS = """
e AS (SELECT vec_id, label % 3 AS g, vec_id % 9 = 4 AS alone, embedding FROM embeddings),
anchors AS (SELECT g, arg_min(embedding, vec_id) AS a FROM e GROUP BY g),
vecs AS (SELECT vec_id, g, alone, list_transform(list_zip(embedding, a), lambda p: CASE WHEN alone THEN (3 + vec_id % 50) * CAST(p[1] AS DOUBLE)
    ELSE 0.9::DOUBLE * p[2] + 0.1::DOUBLE * p[1] END) AS v FROM e JOIN anchors USING (g))"""


def _clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("g", F.col("label") % 3)
    anchors = rows.groupBy("g").agg(F.min_by("embedding", "vec_id").alias("a"))
    alone = F.col("vec_id") % 9 == 4
    far = F.transform("embedding", lambda x: (3 + F.col("vec_id") % 50) * x.cast("double"))
    near = F.zip_with("embedding", "a", lambda x, a: F.lit(0.9) * a.cast("double") + F.lit(0.1) * x.cast("double"))
    # One row for each of the three rests.
    joined = rows.join(F.broadcast(anchors), "g")
    return joined.select("vec_id", F.lit("all").alias("grp"), F.when(alone, far).otherwise(near).alias("vec"))


@query(
    "density_clusters",
    f"""WITH {_CLOUDS}, parts AS (SELECT g, alone, unnest(v) AS x, generate_subscripts(v, 1) AS pos, vec_id FROM vecs),
    means AS (SELECT g, pos, avg(x) AS m FROM parts WHERE NOT alone GROUP BY g, pos),
    cents AS (SELECT g, pos, m / sqrt(sum(m * m) OVER (PARTITION BY g)) AS c FROM means),
    sims AS (SELECT vec_id, c.g, sum(x * c) AS sim FROM parts p JOIN cents c USING (pos) WHERE alone GROUP BY vec_id, c.g),
    placed AS (SELECT vec_id, g, alone FROM vecs WHERE NOT alone UNION ALL SELECT vec_id, arg_max(g, sim), true FROM sims GROUP BY vec_id)
    SELECT vec_id, alone AS outlier, min(vec_id) FILTER (WHERE NOT alone) OVER (PARTITION BY g) AS cluster_first FROM placed""",
)
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density labels, whose outliers go on to the nearest kept cluster."""
    labelled = density_cluster(_clouds(spark, sf_dir), "grp", "vec_id", "vec", "label", Density(min_size=8, neighbours=8))
    labelled = materialised(labelled.withColumn("vec", as_vector(F.col("vec"))), "labelled")
    merged = themes.merge_small(labelled, "grp", "vec_id", "label", "vec", 8)
    first = F.min(F.when(F.col("label") >= 0, F.col("vec_id")))
    firsts = merged.groupBy("cluster").agg(first.alias("cluster_first"))  # a row for each kept cluster
    return merged.join(firsts, "cluster").select("vec_id", (F.col("label") < 0).alias("outlier"), "cluster_first")


@query("density_documents")
def density_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the density clusters of hashed terms inside each language, outliers as -1."""
    rows = hashed_tf(wide_texts(spark, sf_dir, "documents")).select("doc_id", "lang", "features")
    clustered = themes.cluster_rows(materialised(rows, "features"), "lang", "doc_id", cfg=Config(tier2_backend="auto", density_min_docs=30))
    return clustered.groupBy("lang", "cluster").agg(F.count(F.lit(1)).alias("members"))


# ---------------------------------------------------------------- terms and names
def _ctfidf(source: str, cluster: str, order: str, text: str = "text", top: int = 15) -> str:
    stops = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"""toks AS (SELECT {cluster} AS c, {order} AS o, list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'),
        lambda x: regexp_full_match(x, '[a-z][a-z0-9]+')) AS ts FROM {source}),
tok AS (SELECT c, o, unnest(ts) AS w, generate_subscripts(ts, 1) AS pos FROM toks),
kept AS (SELECT * FROM tok WHERE w NOT IN ({stops})),
pairs AS (SELECT c, w, lead(w) OVER (PARTITION BY c ORDER BY o, pos) AS w2 FROM kept),
terms AS (SELECT c, w AS term FROM kept UNION ALL SELECT c, concat(w, ' ', w2) FROM pairs WHERE w2 IS NOT NULL),
cnt AS (SELECT c, term, count(*) AS n FROM terms GROUP BY c, term),
scores AS (SELECT c, term, n, round((n / greatest(sum(n) OVER (PARTITION BY c), 1)) * ln(1e0 + (sum(n) OVER ()
             / (SELECT count(DISTINCT {cluster}) FROM {source})) / greatest(sum(n) OVER (PARTITION BY term), 1)), 12) AS score FROM cnt),
best AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, term) AS rank FROM scores)
SELECT c AS {cluster}, term, n, round(score, 8) AS score, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= {top}"""


@query("ctfidf_terms", f"WITH {_ctfidf('documents', 'lang', 'doc_id')}")
def ctfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = wide_texts(spark, sf_dir, "documents")
    return themes.ctfidf_terms(docs, "lang", "doc_id", stopwords=STOPWORDS).withColumn("score", F.round("score", 8))


@query("ctfidf_source_terms", f"WITH {_ctfidf('documents', 'source', 'doc_id')}")
def ctfidf_source_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = wide_texts(spark, sf_dir, "documents")
    return themes.ctfidf_terms(docs, "source", "doc_id", stopwords=STOPWORDS).withColumn("score", F.round("score", 8))


@query("cluster_names")
def cluster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = wide_texts(spark, sf_dir, "documents")
    terms = themes.ctfidf_terms(docs, "source", "doc_id", group="lang")
    return themes.name_clusters(docs, terms, "source", "lang")


# ---------------------------------------------------------------- end to end
@query("full_run_themes")
def full_run_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = AnalysisEngine(Config()).run(uploads(spark, sf_dir))
    return done.themes


_SOURCE = R.replace("r AS (", "src AS (", 1)
_GOLD_LABEL = "CASE WHEN {0} % 5 >= 3 THEN 'Positive' WHEN {0} % 5 = 0 THEN 'Negative' ELSE 'Neutral' END"


@query(
    "full_run_summary",
    f"""WITH {_SOURCE}, {_REDACTED.replace("FROM r)", "FROM src)")}, clean AS (SELECT "row", text, entities FROM red WHERE "row" % 17 <> 0),
    {lexicon_ctes('clean', '"row"', DEFAULT_LEXICON)}, r AS (SELECT id, sentiment_score, {LABEL_OF.format('sentiment_score')} AS sentiment_label FROM scored),
    {PERCENT}, means AS (SELECT round({MEAN}, 4) AS mean_score FROM r),
    checked AS (WITH {lexicon_ctes('src', '"row"', DEFAULT_LEXICON)}
      SELECT avg(CAST(replace({LABEL_OF.format('sentiment_score')}, 'Strongly ', '') = {_GOLD_LABEL.format('id')} AS INTEGER)) AS s FROM scored)
    SELECT total AS total_reviews, positive, neutral, negative, mean_score, positive_pct, neutral_pct, negative_pct,
      round((positive - negative) * 100.0e0 / total, 1) AS net_sentiment_score,
      CASE WHEN (positive - negative) * 100.0e0 / total <= -10 THEN 'Negative Trend'
           WHEN (positive - negative) * 100.0e0 / total >= 10 THEN 'Positive Trend' ELSE 'Mixed Trend' END AS overall_sentiment,
      (SELECT CAST(sum(entities) AS BIGINT) FROM clean) AS pii_redacted_count,
      (SELECT concat(printf('%.1f', s * 100), '%') FROM checked) AS model_validation_accuracy, 'Low (0.00)' AS drift_status
    FROM cnt, shares, means""",
)
def full_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of a full run with labelled rows and a baseline, which an earlier run over the same batch has left."""
    raw, engine, baseline = uploads(spark, sf_dir), AnalysisEngine(Config()), scratch_path(spark, "baseline")
    rows = reviews(spark, sf_dir, wide=True)
    labelled = rows.select("text", F.expr(_GOLD_LABEL.format("row")).alias("sentiment"), F.lit("Unknown").alias("category"))
    first = spread(materialised(engine.prepare(spread(raw)), "ready"))
    publish_baseline(materialised(hashed_tf(first), "embedded"), baseline, engine.info()["embeddings"])
    return engine.run(raw, baseline, labelled).summary
