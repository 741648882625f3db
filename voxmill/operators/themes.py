"""Two-level themes: general classes, clusters inside each class, names, representatives, ids."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.config import OTHER, Config
from voxmill.functions.numbers import dot, exact_mean, let
from voxmill.functions.text import bigrams, term_tokens, text_key, theme_stopwords, unicode_boundaries
from voxmill.operators.density import Density, density_cluster
from voxmill.operators.features import centroids, similarity_to_centroid
from voxmill.operators.kmeans import POINTS_PER_TASK, nearest, settle
from voxmill.operators.scale import lookup_join, materialised, small_table, spread, top_n
from voxmill.operators.sentiment import label_sentiment

# Patterns that count as a hit for each general class.
CLASS_PATTERNS: Mapping[str, tuple[str, ...]] = {
    "Streaming/Playback": (
        r"\bstream", r"\bplayback", r"\bplay(?:ing|s)?\b", r"\bpaus", r"\bvideo", r"\bbuffer",
        r"\bresolution", r"\b(?:1080p|720p|4k|360p)\b", r"\bsubtitle", r"\bcaption", r"\blive\b",
        r"\bepisode", r"\bwatch", r"\bseek", r"\brewind", r"\baudio", r"\bcast(?:ing)?\b",
    ),
    "Comments & Social": (
        r"\bcomment", r"\brepl(?:y|ies)", r"\bshar(?:e|ing)\b", r"\bfollow", r"\bfriend", r"\bchat\b",
        r"\bmessag", r"\bprofile", r"\bcommunity", r"\breact(?:ion)?", r"\bmention", r"\bspam",
        r"\bcreator", r"\bpost(?:s|ing|ed)?\b",
    ),
    "Billing & Subscriptions": (
        r"\bbill", r"\bcharg", r"\bsubscri", r"\brefund", r"\bpay(?:s|ment|ing|ed)?\b", r"\bpric",
        r"\bexpensive", r"\bcancel", r"\bcredit card", r"\binvoice", r"\brenew", r"\btrial",
        r"\bpremium", r"\bplan\b", r"\bdiscount", r"\bcost",
    ),
    "Performance & Crashes": (
        r"\bcrash", r"\bfreez", r"\bfroze", r"\blag", r"\bslow", r"\bbug", r"\bbattery", r"\bdrain",
        r"\bloads?\b", r"\bloading", r"\bhang", r"\bforce.?clos", r"\bunresponsive", r"\bmemory",
        r"\bhot\b", r"\boverheat", r"\bstartup", r"\bstable", r"\bperformance", r"\bsnappier",
    ),
    "UI/UX & Navigation": (
        r"\bui\b", r"\bux\b", r"\binterface", r"\bmenu", r"\bnavigat", r"\bbutton", r"\bsearch",
        r"\bdesign", r"\blayout", r"\bdark mode", r"\btheme", r"\bconfus", r"\bsettings",
        r"\bhome screen", r"\btabs?\b", r"\bfont", r"\bintuitive", r"\bredesign", r"\bfilters?\b",
    ),
}

ClassScores = Callable[[], Callable[[list[str], Sequence[str]], Sequence[tuple[str, float]]]]

# A name stops growing at three words and never has more than four.
NAME_ENOUGH = 3
NAME_MOST = 4
TOP_TERMS = 15
REP_MIN_CHARS = 15
REP_MAX_CHARS = 280
# Groups that may be clustered in one call: general classes are few.
MAX_GROUPS = 1000
# Rows per window group when neighbouring documents of a cluster are paired up.
NEIGHBOUR_BUCKET = 1 << 16


# ---------------------------------------------------------------- general class
def class_patterns(categories: Sequence[str]) -> dict[str, list[str]]:
    """Patterns per class; a class without its own gets one prefix pattern per word of four or more letters."""
    return {
        c: list(CLASS_PATTERNS.get(c) or [r"\b" + w for w in re.findall("[a-z]{4,}", c.lower())]) for c in categories
    }


def literal_head(pattern: str) -> str:
    """Plain lower-case text that every match of a class pattern begins with; empty if there is none."""
    head = re.match(r"\\b([a-z ]*)(.?)", pattern)
    if head is None:
        return ""
    text, following = head.groups()
    return text[:-1] if following in ("?", "*", "{") else text


def classify_keywords(df: DataFrame, text: str = "text", cfg: Config = Config()) -> DataFrame:
    """Class with the most matching patterns (ties to the earlier class) and its share of all hits."""
    table = class_patterns(cfg.categories)

    def hit(lowered: Column, pattern: str) -> Column:
        # Every match starts with the literal head of its pattern; looking for that is far cheaper.
        head = literal_head(pattern)
        found = lowered.rlike(unicode_boundaries(pattern))
        return (lowered.contains(head) & found if head else found).cast("int")

    def hits(lowered: Column, patterns: list[str]) -> Column:
        tests = [hit(lowered, p) for p in patterns]
        return sum(tests[1:], tests[0]) if tests else F.lit(0)

    # All patterns in one generated method would be more than the JVM compiles; inside ``let`` they are evaluated one by one.
    counted = df.withColumn("_hits", let(F.lower(F.col(text)), lambda low: F.array(*[hits(low, table[c]) for c in cfg.categories])))
    best = F.array_max("_hits")
    total = F.aggregate("_hits", F.lit(0), lambda acc, x: acc + x)
    names = F.array(*[F.lit(c) for c in cfg.categories])
    return (
        counted.withColumn("_total", total)
        .withColumn(
            "general_class",
            F.when(F.col("_total") == 0, F.lit(OTHER)).otherwise(
                F.get(names, (F.array_position("_hits", best) - 1).cast("int"))
            ),
        )
        .withColumn("confidence", F.coalesce(F.try_divide(best.cast("double"), F.col("_total")), F.lit(0.0)))
        .drop("_hits", "_total")
    )


def confidence_floor(df: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Low-confidence rows become ``Other`` and keep their score."""
    sure = F.col("confidence") >= cfg.confidence_floor
    return df.withColumn("general_class", F.when(sure, F.col("general_class")).otherwise(F.lit(OTHER)))


def classify_external(df: DataFrame, classifier: ClassScores, text: str = "text", cfg: Config = Config()) -> DataFrame:
    """Top class from a pluggable model, loaded once per task, with the confidence floor applied."""
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("general_class", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
        ]
    )
    categories = list(cfg.categories)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = classifier()
        for batch in batches:
            pairs = list(predict(batch[text].tolist(), categories))
            yield batch.assign(general_class=[p[0] for p in pairs], confidence=[float(p[1]) for p in pairs])

    return confidence_floor(df.mapInPandas(run, schema), cfg)


def class_facets(themes: DataFrame) -> DataFrame:
    return (
        themes.groupBy("general_class")
        .agg(F.sum("count").cast("long").alias("count"))
        .orderBy(F.desc("count"), F.asc("general_class"))
    )


def class_theme_rollup(reviews: DataFrame) -> DataFrame:
    """Class totals and theme totals of assigned reviews in one pass."""
    return (
        reviews.where(F.col("theme_id").isNotNull())
        .rollup("general_class", "theme_id")
        .agg(
            F.grouping_id().cast("long").alias("level"),
            F.count(F.lit(1)).alias("reviews"),
            F.round(exact_mean(F.col("sentiment_score")), 4).alias("mean_score"),
        )
    )


# ---------------------------------------------------------------- clusters inside a class
def distinct_vectors(df: DataFrame, group: str, vector: str = "features") -> DataFrame:
    """One row per group and distinct vector with its number of rows as ``weight``.

    Copies of one text are combined before the shuffle, so a text that makes up a third of a class is one
    weighted point of the fit.
    """
    hashed = df.select(group, vector, F.xxhash64(vector_to_array(vector)).alias("_h"))
    return hashed.groupBy(group, "_h").agg(
        F.any_value(vector).alias(vector), F.count(F.lit(1)).cast("double").alias("weight")
    )


def cluster_sizes(points: DataFrame, group: str, cfg: Config) -> dict[str, int]:
    """Number of clusters to fit per group; 1 where there is too little to split."""
    stats = points.groupBy(group).agg(F.sum("weight").cast("long").alias("n"), F.count(F.lit(1)).alias("docs"))
    found = stats.limit(MAX_GROUPS + 1).collect()
    if len(found) > MAX_GROUPS:
        raise ValueError(f"{group} has more than {MAX_GROUPS} values; each one needs a model of its own")
    out = {}
    for r in found:
        most = min(cfg.max_subtopics, r["n"] // max(cfg.min_theme_size, 1), r["docs"])
        out[r[group]] = 1 if most < 2 else int(min(max(round((r["n"] / 4) ** 0.5), 2), most))
    return out


def _first_centres(points: DataFrame, k: int, seed: int, vector: str, out: str) -> np.ndarray:
    """Where a k-means fit starts. The points are distinct and at least ``k``, so ``k`` different ones always start it."""
    means = KMeans(k=k, seed=seed, featuresCol=vector, predictionCol=out, weightCol="weight", initMode="random", maxIter=0)
    return np.array(means.fit(points).clusterCenters())


def cluster_within(
    df: DataFrame, group: str, vector: str = "features", out: str = "cluster", cfg: Config = Config()
) -> DataFrame:
    """K-means inside each group, all groups and restarts fitted in the same jobs; the cheapest of the restarts wins.

    Points are stored by group, so a start reads those of its own group only. Rows without a group are left out.
    """
    points = materialised(distinct_vectors(df, group, vector), "points", partition_by=[group])
    sizes = cluster_sizes(points, group, cfg)

    def start(item: tuple[str, int]):
        name, k = item
        stored = points.where(F.col(group) == name).select(vector, "weight").persist(StorageLevel.MEMORY_AND_DISK)
        part = stored.coalesce(max(1, stored.count() // POINTS_PER_TASK))
        starts = {attempt: _first_centres(part, k, cfg.seed + attempt, vector, out) for attempt in range(cfg.kmeans_restarts)}
        stored.unpersist()
        return name, starts

    todo = sorted((g, k) for g, k in sizes.items() if k > 1)
    with ThreadPoolExecutor(max_workers=max(1, cfg.fit_threads)) as pool:
        starts = dict(pool.map(start, todo))
    centres = settle(points, group, vector, starts, cfg.kmeans_max_iter)
    return df.where(F.col(group).isNotNull()).withColumn(out, nearest(df, group, vector, centres))


def cluster_rows(df: DataFrame, group: str, id_col: str, vector: str = "features", out: str = "cluster", cfg: Config = Config()) -> DataFrame:
    """Clusters inside each group by the back-end that ``cfg.tier2_backend`` names; outliers of the density path get -1.

    The density path keeps the ``max_subtopics`` largest clusters of a group; rows of the others count as outliers.
    """
    if cfg.tier2_backend not in ("kmeans", "density", "auto"):
        raise ValueError(f"unknown tier2_backend {cfg.tier2_backend!r}")
    if cfg.tier2_backend == "kmeans":
        return cluster_within(df, group, vector, out, cfg)
    least = cfg.density_min_docs if cfg.tier2_backend == "auto" else 2 * cfg.min_theme_size
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).limit(MAX_GROUPS + 1).collect()
    if len(sizes) > MAX_GROUPS:
        raise ValueError(f"{group} has more than {MAX_GROUPS} values")
    dense = [r[group] for r in sizes if r["n"] >= least]
    size = max(cfg.min_theme_size, cfg.density_min_size)
    opts = Density(min_size=size, neighbours=size, seed=cfg.seed, max_clusters=cfg.max_subtopics)
    parts = []
    if dense:
        parts.append(density_cluster(df.where(F.col(group).isin(dense)), group, id_col, vector, out, opts).select(*df.columns, out))
    if len(dense) < len(sizes):
        parts.append(cluster_within(df.where(~F.col(group).isin(dense)), group, vector, out, cfg).select(*df.columns, out))
    return reduce(DataFrame.unionByName, parts) if parts else df.withColumn(out, F.lit(0))


def merge_small(
    df: DataFrame,
    group: str,
    id_col: str,
    label: str = "cluster",
    vector: str = "features",
    min_size: int = 5,
    out: str = "cluster",
) -> DataFrame:
    """Move outliers (label < 0) and clusters under ``min_size`` to the nearest kept centroid of their group.

    Ties go to the lowest label; a group that keeps none becomes cluster 0; ids are dense again afterwards.
    The kept centroids of a group travel as one array per group.
    """
    counts = df.where(F.col(label) >= 0).groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    kept = counts.where(F.col("_n") >= min_size).select(group, label)
    kept, small = small_table(kept, 1000)
    cents = centroids(df.join(F.broadcast(kept) if small else kept, [group, label], "left_semi"), [group, label], vector)
    per_group = cents.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col("centroid")))).alias("_kept")
    )
    # The number of kept labels is bounded by the sub-topic limit of the fit, so one array per group is small.
    joined = lookup_join(df, per_group, group, salt_from=id_col, small_rows=1000)
    labels = F.transform("_kept", lambda k: k["label"])
    features = vector_to_array(vector) if df.schema[vector].dataType.typeName() == "vectorudt" else F.col(vector)
    # Only rows that have to move pay for the similarities.
    sims = let(features, lambda v: F.transform("_kept", lambda k: dot(k["centroid"], v)))
    nearest = let(sims, lambda s: F.array_position(s, F.array_max(s)))
    moved = F.get(labels, (nearest - 1).cast("int"))
    target = F.when(F.array_contains(labels, F.col(label)), F.col(label)).otherwise(moved)
    dense = F.when(F.col("_kept").isNull(), F.lit(0)).otherwise(
        (F.array_position(labels, F.col("_to")) - 1).cast("int")
    )
    return (
        joined.withColumn("_to", target)
        .withColumn(out, dense)
        .drop("_kept", "_to")
    )


# ---------------------------------------------------------------- names
def _neighbour_pairs(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (last term of a document, first term of the next one) inside each cluster, in row order.

    Documents are paired inside fixed ranges of ``_o`` first; the ends of neighbouring ranges are paired
    from one summary row per range, so a cluster with a third of all rows is cut into many groups.
    """
    ranged = edges.withColumn("_range", F.floor(F.col("_o") / F.lit(NEIGHBOUR_BUCKET)))
    inside = Window.partitionBy(*keys, "_range").orderBy("_o")
    within = ranged.withColumn("_next", F.lead("_first").over(inside)).where(F.col("_next").isNotNull())
    ends = ranged.groupBy(*keys, "_range").agg(
        F.min_by("_first", "_o").alias("_first"), F.max_by("_last", "_o").alias("_last")
    )
    across = ends.withColumn("_next", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_range")))
    across = across.where(F.col("_next").isNotNull())
    pair = F.concat_ws(" ", "_last", "_next").alias("term")
    return within.select(*keys, pair).unionByName(across.select(*keys, pair))


def _sent(df: DataFrame) -> DataFrame:
    """The table, marked to go to every task if it is small."""
    side, small = small_table(df)
    return F.broadcast(side) if small else side


def _term_counts(df: DataFrame, keys: list[str], order: str, text: str, stopwords: Sequence[str] | None) -> DataFrame:
    """Occurrences of 1-grams and 2-grams per cluster; a pair may have a second row for its uses ``across`` documents.

    Texts are read and cut into tokens once: the same pass emits the terms and, per document, its first
    and last token. Pairs across documents are then made from those two alone.
    """
    docs = df.select(*keys, F.col(order).alias("_o"), term_tokens(F.col(text), theme_stopwords(stopwords)).alias("_t"))
    none = F.lit(None).cast("string")

    def emitted(tokens: Column) -> Column:
        terms = F.transform(
            F.concat(tokens, bigrams(tokens)),
            lambda t: F.struct(t.alias("term"), F.lit(None).cast("long").alias("_o"), none.alias("_first"), none.alias("_last")),
        )
        edge = F.struct(
            none.alias("term"),
            F.col("_o").cast("long").alias("_o"),
            F.get(tokens, F.lit(0)).alias("_first"),
            F.try_element_at(tokens, F.lit(-1)).alias("_last"),
        )
        return F.concat(terms, F.array(edge))

    # ``_t`` stands outside the lambda of ``let`` once, so tokens are made once per document.
    rows = docs.select(*keys, F.inline(let(F.col("_t"), emitted)))
    grouped = rows.groupBy(*keys, "term", "_o", "_first", "_last").agg(F.count(F.lit(1)).alias("n"))
    grouped = materialised(grouped, "terms")
    edges = grouped.where(F.col("_o").isNotNull() & F.col("_first").isNotNull()).select(*keys, "_o", "_first", "_last")
    pairs = _neighbour_pairs(edges, keys).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))
    inner = grouped.where(F.col("term").isNotNull()).select(*keys, "term", "n")
    return inner.withColumn("across", F.lit(False)).unionByName(materialised(pairs, "pairs").withColumn("across", F.lit(True)))


def ctfidf_terms(
    df: DataFrame,
    cluster: str,
    order: str,
    text: str = "text",
    group: str | None = None,
    stopwords: Sequence[str] | None = None,
    top: int = TOP_TERMS,
) -> DataFrame:
    """Best terms per cluster by class-based TF-IDF over 1-grams and 2-grams.

    The documents of a cluster count as one long text in ``order`` (a unique whole number), so pairs also
    bridge neighbouring documents. With ``group`` every group is its own corpus. Term counts are combined
    before the shuffle; there is no cluster-by-vocabulary matrix. Terms whose count alone rules them out are not scored.
    """
    keys = [group, cluster] if group else [cluster]
    corpus = [group] if group else []
    counts = _term_counts(df, keys, order, text, stopwords)
    # How many counts there are of each power of two: a row for each cluster and power.
    powers = counts.groupBy(*keys, F.floor(F.log2("n")).alias("_power")).agg(F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_sum"), F.max("n").alias("_n"))
    powers = materialised(powers, "powers")
    cluster_totals = powers.groupBy(*keys).agg(F.sum("_sum").alias("cluster_total"))
    clusters = df.groupBy(*keys).agg(F.lit(1).alias("_one"))
    if not group:
        # One corpus: a constant key keeps the joins below plain equi-joins.
        corpus_key, *tables = "_all", *(t.withColumn("_all", F.lit(1)) for t in (cluster_totals, clusters))
    else:
        corpus_key, *tables = group, cluster_totals, clusters
    cluster_totals, clusters = tables
    sums = cluster_totals.groupBy(corpus_key).agg(F.sum("cluster_total").alias("total"))
    corpus_totals = clusters.groupBy(corpus_key).agg(F.count(F.lit(1)).alias("clusters"))
    facts = cluster_totals.join(corpus_totals.join(sums, corpus_key), corpus_key)
    facts = _sent(facts.select(*keys, "cluster_total", "clusters", "total"))

    def score(n: Column, term_total: Column) -> Column:
        rarity = F.log(F.lit(1.0) + (F.col("total") / F.col("clusters")) / F.greatest(term_total, F.lit(1)))
        return (n / F.greatest(F.col("cluster_total"), F.lit(1))) * rarity

    def scored(terms: DataFrame) -> DataFrame:
        """Scores in all clusters of the listed terms. Counts of other terms are not moved while the list is short."""
        listed = counts.join(_sent(terms.select(*corpus, "term").distinct()), [*corpus, "term"], "left_semi")
        summed = listed.repartition("term").groupBy(*keys, "term").agg(F.sum("n").alias("n"))
        totalled = summed.withColumn("term_total", F.sum("n").over(Window.partitionBy(*corpus, "term"))).join(facts, keys)
        # Rounded for ordering, so equal scores tie whatever the order of floating-point steps.
        return totalled.select(*keys, "term", "n", F.round(score(F.col("n"), F.col("term_total")), 12).alias("score"))

    # The scores of a cluster's most frequent terms bound its best ones from below. No term occurs less often in its corpus than in its cluster,
    # and such a score grows with the count, so every count has a bound from above, and terms that stay below the others' need no totals.
    above = Window.partitionBy(*keys).orderBy(F.desc("_power"))
    before = powers.withColumn("_before", F.sum("_rows").over(above) - F.col("_rows"))
    # A term may have two rows, so twice as many are taken.
    least = before.where(F.col("_before") < 2 * top).groupBy(*keys).agg(F.min("_power").alias("_least"))
    least = _sent(least)
    # Most counts are far below what any cluster asks for, and leave before the join.
    lowest = least.agg(F.min("_least")).first()[0] or 0
    frequent = counts.where(F.col("n") >= 1 << lowest).join(least, keys).where(F.floor(F.log2("n")) >= F.col("_least"))
    tops = top_n(scored(frequent), keys, [F.desc("score"), F.asc("term")], top, "rank")
    bound = tops.groupBy(*keys).agg(F.min("score").alias("_bound"), F.count(F.lit(1)).alias("_found"))
    bound = bound.select(*keys, F.when(F.col("_found") == top, F.col("_bound") - 1e-11).alias("_bound"))
    most = counts.where("across").groupBy(*keys).agg(F.max("n").alias("_across"))  # reads the pairs across documents only
    limits = _sent(facts.join(bound, keys, "left").join(most, keys, "left"))
    at_most = F.col("n") + F.when(F.col("across"), F.lit(0)).otherwise(F.coalesce("_across", F.lit(0)))
    reaches = F.col("_bound").isNull() | (score(at_most, at_most) >= F.col("_bound"))
    highest = powers.select(*keys, "_power", F.col("_n").alias("n"), F.lit(False).alias("across")).join(limits, keys)
    lowest = highest.where(reaches).agg(F.min("_power")).first()[0] or 0
    possible = counts.where(F.col("n") >= 1 << lowest).join(limits, keys).where(reaches)
    return top_n(scored(possible), keys, [F.desc("score"), F.asc("term")], top, "rank")


def build_name(terms: Column) -> Column:
    """Greedy name from terms in order: skip known words, never over four words, stop at three."""

    def step(chosen: Column, term: Column) -> Column:
        fresh = F.filter(F.split(term, " "), lambda w: ~F.array_contains(chosen, w))
        grown = F.size(chosen) + F.size(fresh)
        skip = (F.size(chosen) >= NAME_ENOUGH) | (F.size(fresh) == 0) | (grown > NAME_MOST)
        return F.when(skip, chosen).otherwise(F.concat(chosen, fresh))

    chosen = F.aggregate(terms, F.array().cast("array<string>"), step)
    return F.array_join(F.transform(chosen, F.initcap), " ")


def name_clusters(df: DataFrame, terms: DataFrame, cluster: str, group: str) -> DataFrame:
    """One name per cluster of ``df``; a cluster without terms is called after its class."""
    listed = terms.groupBy(group, cluster).agg(
        F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t")
    )
    clusters = df.groupBy(group, cluster).agg(F.count(F.lit(1)).alias("members"))
    named = clusters.join(listed, [group, cluster], "left")
    name = build_name(F.transform("_t", lambda t: t["term"]))
    fallback = F.concat(F.col(group).cast("string"), F.lit(" Feedback"))
    return named.withColumn("name", F.coalesce(F.nullif(name, F.lit("")), fallback)).drop("_t")


def unique_names(clusters: DataFrame, creation: Sequence[Column], group: str = "general_class") -> DataFrame:
    """Repeats of a (class, name) get a running number in creation order."""
    w = Window.partitionBy(group, "name").orderBy(*creation)
    n = F.row_number().over(w)
    return clusters.withColumn("_k", n).select(
        *[c for c in clusters.columns if c != "name"],
        F.when(F.col("_k") == 1, F.col("name"))
        .otherwise(F.concat(F.col("name"), F.lit(" ("), F.col("_k").cast("string"), F.lit(")")))
        .alias("name"),
    )


# ---------------------------------------------------------------- representatives
def representatives(
    df: DataFrame, cluster: Sequence[str], similarity: str, id_col: str, text: str = "text", per_cluster: int = 5
) -> DataFrame:
    """Most central texts per cluster, one per text key; those of readable length come first.

    The best row of each (cluster, key hash) is a combined aggregate, so copies of one text do not pile up and
    no text is shuffled; the rank filter then sends a handful of rows per cluster and partition.
    """
    fits = F.length(text).between(REP_MIN_CHARS, REP_MAX_CHARS).cast("int")
    order = F.struct(fits.alias("fits"), F.col(similarity).alias("sim"), (-F.col(id_col)).alias("neg_id"))
    best = df.groupBy(*cluster, F.md5(text_key(F.col(text)).cast("binary")).alias("_key")).agg(F.max(order).alias("_b"))
    flat = best.select(
        *cluster,
        F.col("_b.fits").alias("fits"),
        F.col("_b.sim").alias(similarity),
        (-F.col("_b.neg_id")).alias(id_col),
    )
    return top_n(flat, cluster, [F.desc("fits"), F.desc(similarity), F.asc(id_col)], per_cluster, "position")


# ---------------------------------------------------------------- ids and theme rows
def rank_and_cap(clusters: DataFrame, creation: Sequence[Column], max_themes: int = 25) -> DataFrame:
    """Largest clusters first (ties in creation order), at most ``max_themes``, ids ``theme-1`` onwards.

    The cap makes this a plain top-k; only the rows that survive it are numbered.
    """
    order = [F.desc("members"), *creation]
    top = clusters.orderBy(*order).limit(max_themes)
    position = F.row_number().over(Window.orderBy(*order))
    return top.withColumn("position", position).withColumn("theme_id", F.concat(F.lit("theme-"), F.col("position")))


def assign_theme(reviews: DataFrame, kept: DataFrame, keys: Sequence[str], id_col: str = "row") -> DataFrame:
    """Theme id per review; reviews of clusters beyond the cap have none."""
    side, small = small_table(kept.select(*keys, "theme_id"))
    return reviews.join(F.broadcast(side) if small else side, list(keys), "left")


def theme_stats(reviews: DataFrame, theme: Sequence[str] = ("theme_id",), cfg: Config = Config()) -> DataFrame:
    """Count, mean polarity (two decimals) and the label of the unrounded mean, per theme."""
    stats = (
        reviews.where(F.col(theme[0]).isNotNull())
        .groupBy(*theme)
        .agg(F.count(F.lit(1)).alias("count"), exact_mean(F.col("sentiment_score")).alias("_mean"))
    )
    return stats.select(
        *theme,
        "count",
        label_sentiment(F.col("_mean"), cfg.labels).alias("sentiment"),
        F.round("_mean", 2).alias("sentiment_score"),
    )


def attach_representatives(themes: DataFrame, reps: DataFrame, key: str = "theme_id", id_col: str = "row") -> DataFrame:
    """Representative row numbers as an ordered array; empty where there are none."""
    lists = reps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", id_col))).alias("_r"))
    empty = F.array().cast("array<bigint>")
    return themes.join(lists, key, "left").select(
        *themes.columns,
        F.coalesce(F.transform("_r", lambda r: r[id_col].cast("bigint")), empty).alias("representative_indices"),
    )


def unassigned_count(reviews: DataFrame) -> DataFrame:
    return reviews.agg(F.count_if(F.col("theme_id").isNull()).alias("unassigned_count"))


def theme_invariants(reviews: DataFrame, themes: DataFrame) -> DataFrame:
    """Themes whose stored count differs from the reviews that carry their id, unknown ids included."""
    carried = reviews.where(F.col("theme_id").isNotNull()).groupBy("theme_id").agg(F.count(F.lit(1)).alias("carried"))
    both = themes.select("theme_id", F.col("count").alias("stored")).join(carried, "theme_id", "full_outer")
    return both.where(~F.col("stored").eqNullSafe(F.col("carried")))


# ---------------------------------------------------------------- the whole discovery
def discover_themes(
    scored: DataFrame, cfg: Config = Config(), vector: str = "features", id_col: str = "row"
) -> tuple[DataFrame, DataFrame]:
    """(reviews with theme_id, themes) from classified, embedded and scored reviews.

    Needs ``id_col``, ``text``, ``general_class``, ``sentiment_score`` and an ML vector column. Every class is
    read by itself for its fit, so ``scored`` is best stored partitioned by class.
    """
    clustered = spread(materialised(cluster_rows(scored, "general_class", id_col, vector, "cluster", cfg), "clustered"))
    merged = merge_small(clustered, "general_class", id_col, "cluster", vector, cfg.min_theme_size)
    merged = spread(materialised(merged, "merged"))
    keys = ["general_class", "cluster"]
    terms = ctfidf_terms(merged, "cluster", id_col, group="general_class", stopwords=cfg.stopwords)
    named = name_clusters(merged, terms, "cluster", "general_class")
    class_order = F.array_position(F.array(*[F.lit(c) for c in (*cfg.categories, OTHER)]), F.col("general_class"))
    creation = [class_order.asc(), F.col("cluster").asc()]
    kept = rank_and_cap(unique_names(named, creation), creation, cfg.max_themes)
    kept, _ = small_table(kept, cfg.max_themes)

    assigned = assign_theme(merged, kept, keys, id_col)
    cents = centroids(merged, keys, vector)
    members = merged.join(F.broadcast(kept.select(*keys, "theme_id")), keys)
    cents = cents.join(F.broadcast(kept.select(*keys, "theme_id")), keys).select("theme_id", "centroid")
    sims = similarity_to_centroid(members, cents, "theme_id", id_col, vector, "similarity").withColumn("similarity", F.round("similarity", 9))
    reps = representatives(sims, ["theme_id"], "similarity", id_col, per_cluster=cfg.samples_per_theme)
    themes = theme_stats(assigned, cfg=cfg).join(
        F.broadcast(kept.select("theme_id", "general_class", "name")), "theme_id"
    )
    themes = attach_representatives(themes, reps, "theme_id", id_col)
    return assigned.drop(vector, "cluster"), themes
