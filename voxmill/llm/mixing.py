"""Mixing sources to target weights by Pareto order sampling. Spark expressions only.

Targets: sources in code-point order (null last) take the weights in turn; together they share ``share`` of all words; no
target passes ``most`` times its source's words, and what a source cannot take is reshared by weight among the others. In
the order of "words per weight" that is one pass: the first source whose cap is not reached fixes the level of all later ones.

Documents: a source that needs ``f`` times its words takes ``floor(f)`` whole copies of every document for certain. The
rest is a fixed-size sample with unequal probabilities: every document draws U from the MD5 of its id, and documents are
taken in order of ``(U / (1 - U)) / (p / (1 - p))`` until the words are there (the last one if at least half of it is needed).
The inclusion probability ``p`` of a document is its preference times a factor of its source, chosen so that the expected words,
the sum of ``p`` times size, are the rest. Where the factor would pass 1, the preferred documents come for certain, one more
whole copy each, and the others share what is left with one probability.

The place in that order where a source stops is found by counting words in 4,096 buckets of the order, then in 4,096 buckets
inside the one where the source stops, and at last row by row inside one of those, so no task ever sorts a source.

A null text has size 0. A size-0 document is never counted; its ``taken`` is 0. Rows that repeat a document share their place in the
order and are taken together. A null source is a source of its own; a null id counts as an empty one. Columns besides the
id, text and source are not read by ``mix``; ``mixed_rows`` passes them on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.operators.scale import materialised

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BUCKETS = 4096
# Very short texts are less wanted when only a part of a source is taken.
SHORT_WORDS = 50
SHORT_PREFERENCE = 0.25


def size_of(text: str) -> Column:
    """Number of words in the column."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: ``source, source_size, target, copies, rest`` and the inclusion probabilities of the sample.

    Where ``certain``, preferred documents get one more copy and ``rest`` is what the others have to give; ``p_long`` and ``p_short`` are
    the probabilities of the two kinds of documents. The windows see one row per source.
    """
    short = F.sum(F.when(F.col("size") < SHORT_WORDS, F.col("size")).otherwise(0))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), short.alias("short_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    per = per.withColumn("level", level).withColumn("free", F.col("level") < F.col("cap") / F.col("weight"))
    per = per.withColumn("rank", F.row_number().over(order))
    first = F.min(F.when(F.col("free"), F.struct("rank", "level"))).over(everything)
    per = per.withColumn("first", first)
    free = F.col("rank") >= F.col("first.rank")
    target = F.when(F.coalesce(free, F.lit(False)), F.least(F.col("cap").cast("double"), F.col("first.level") * F.col("weight")))
    per = per.withColumn("target", F.coalesce(target, F.col("cap").cast("double")))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per = per.withColumn("copies", times)
    per = per.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    per = per.withColumn("long_size", F.col("source_size") - F.col("short_size"))
    factor = F.when(F.col("source_size") > 0, F.col("rest") / (F.col("long_size") + SHORT_PREFERENCE * F.col("short_size"))).otherwise(0.0)
    per = per.withColumn("factor", factor).withColumn("certain", F.col("factor") >= 1)
    per = per.withColumn("rest", F.when(F.col("certain"), F.col("rest") - F.col("long_size")).otherwise(F.col("rest")))
    left_over = F.when(F.col("short_size") > 0, F.col("rest") / F.col("short_size")).otherwise(0.0)
    p_short = F.when(F.col("certain"), left_over).otherwise(SHORT_PREFERENCE * F.col("factor"))
    return per.select("source", "source_size", "target", "copies", "rest", "certain", F.col("factor").alias("p_long"), p_short.alias("p_short"))


def draw(id_col: str, seed: str) -> Column:
    """A number between 0 and 1 from the id: 52 bits of its MD5."""
    text = F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _stops(rows: DataFrame) -> DataFrame:
    """``source_key, stop, first``: the last place of the order that is still taken, for sources that take a part."""
    # The order mapped to 0..1, so that buckets of equal width hold documents of every source.
    unit = F.col("order_key") / (1 + F.col("order_key"))
    rows = rows.where(F.col("order_key").isNotNull()).withColumn("_unit", unit).withColumn("_before", F.lit(0).cast("long"))
    for step in (BUCKETS, BUCKETS * BUCKETS):
        # What is left of the last round lies inside one bucket; the next one divides that again.
        bucketed = rows.withColumn("_bucket", F.floor(F.col("_unit") * step).cast("long"))
        counts = bucketed.groupBy("source_key", "_bucket").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"), F.max("_before").alias("_before"))
        run = Window.partitionBy("source_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.col("_before") + F.sum("words").over(run))
        cut = counts.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
        cut = cut.groupBy("source_key").agg(F.min(F.struct("_bucket", (F.col("upto") - F.col("words")).alias("words"))).alias("c"))
        cut = materialised(cut.select("source_key", F.col("c._bucket").alias("_cut"), F.col("c.words").alias("_words")), "cuts")
        rows = bucketed.join(cut, "source_key").where(F.col("_bucket") == F.col("_cut")).withColumn("_before", F.col("_words"))
        rows = rows.drop("_bucket", "_cut", "_words")
    order = Window.partitionBy("source_key").orderBy("order_key", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.col("_before") + F.sum("size").over(order))
    taken = rows.where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    last = taken.groupBy("source_key").agg(F.max(F.struct("order_key", "id")).alias("stop"))
    # No row of the last bucket may be taken: then the source stops right before it.
    none = rows.groupBy("source_key").agg(F.min("order_key").alias("first"))
    return none.join(last, "source_key", "left").select("source_key", "stop", "first")


def _planned(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], share: float, most: int, seed: str
) -> DataFrame:
    """``id, source, size, source_size, target, copies`` of every row."""
    named = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size_of(text_col).alias("size"))
    sizes = materialised(named, "sizes")
    per = materialised(targets(sizes, weights, share, most).withColumn("source_key", _key("source")), "source-targets")
    p = F.when(F.col("size") < SHORT_WORDS, F.col("p_short")).otherwise(F.col("p_long"))
    sure = F.col("certain") & (F.col("size") >= SHORT_WORDS)
    u = draw("id", seed)
    # A probability that rounding lifts to 1 comes first.
    order_key = F.when(~sure & (F.col("rest") > 0) & (p > 0), F.when(p < 1, u / (1 - u) / (p / (1 - p))).otherwise(0.0))
    rows = sizes.withColumn("source_key", _key("source")).join(per.drop("source"), "source_key")
    rows = materialised(rows.withColumn("order_key", order_key), "ordered")
    stops = materialised(_stops(rows), "stops")
    place = F.struct("order_key", "id")
    # Sources without a stop take nothing beyond their whole copies; one without taken rows in its last bucket stops before that.
    sampled = F.coalesce(F.when(F.col("stop").isNotNull(), place <= F.col("stop")).otherwise(F.col("order_key") < F.col("first")), F.lit(False))
    copies = F.col("copies") + F.when(sure | (F.col("order_key").isNotNull() & sampled), 1).otherwise(0)
    out = rows.join(stops, "source_key", "left")
    return out.select("id", F.col("source_key").alias("source"), "size", "source_size", "target", copies.alias("copies"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix",
) -> DataFrame:
    """``id, size, source_size, target, taken`` of every document; ``taken`` is its size times the copies it gets."""
    plan = _planned(docs, id_col, text_col, source_col, weights, share, most, seed)
    return plan.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _key(source: str) -> Column:
    """Never null, so that rows without a source join like all others."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def mixed_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix",
) -> DataFrame:
    """The mix itself: every document once for each copy it gets, with ``copy`` numbered from 1. Documents without words never come.

    Copies follow from id, source and size alone, so rows that share an id but differ in one of the others get their own.
    """
    plan = _planned(docs, id_col, text_col, source_col, weights, share, most, seed).where((F.col("copies") > 0) & (F.col("size") > 0))
    name = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit(""))
    keys = ["__vx_id", "__vx_source", "__vx_size"]
    copies = plan.select(name.alias(keys[0]), F.col("source").alias(keys[1]), F.col("size").alias(keys[2]), F.col("copies").cast("int").alias("__vx_copies"))
    own = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    keyed = docs.withColumns({keys[0]: own, keys[1]: _key(source_col), keys[2]: size_of(text_col)})
    joined = keyed.join(copies.distinct().hint("shuffle_hash"), keys)
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__vx_copies")))).drop(*keys, "__vx_copies")
