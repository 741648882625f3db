"""Sentiment: scoring, labels and summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.config import (
    ENGINE_LABELS,
    LABELS,
    NEGATIVE,
    NEUTRAL,
    POSITIVE,
    STRONGLY_NEGATIVE,
    LabelPreset,
)
from voxmill.functions.numbers import clip_score, exact_mean, let, percent_ints
from voxmill.functions.text import words
from voxmill.operators.patterns import hash_filter, hash_texts, hashed_patterns, known
from voxmill.operators.scale import materialised, salted_join

# The lexicon travels inside the plan, so its size is bounded.
MAX_LEXICON = 20_000
# Published constants of rule-based compound scoring.
NEGATION_FACTOR = -0.74
BOOST = 0.293
BOOST_DECAY = (1.0, 0.95, 0.9)
NORMALISER = 15.0
NEGATIONS = ("not", "no", "never", "cannot", "without", "isn", "wasn", "don", "doesn", "didn", "won", "couldn")
BOOSTERS = ("very", "really", "extremely", "absolutely", "completely", "so", "totally", "incredibly")
DAMPENERS = ("slightly", "somewhat", "barely", "hardly", "almost", "partly")
# What a word does to a hit that follows it, in two bits.
BOOSTS, DAMPENS, NEGATES = 1, 2, 3
# Tokens of a batch that are looked at together, in a task that scores by a table.
TOKENS_AT_ONCE = 1 << 18


def label_sentiment(score: Column, preset: LabelPreset = ENGINE_LABELS) -> Column:
    if preset.inclusive:
        return (
            F.when(score >= preset.positive, POSITIVE)
            .when(score <= preset.strong, STRONGLY_NEGATIVE)
            .when(score <= preset.negative, NEGATIVE)
            .otherwise(NEUTRAL)
        )
    return (
        F.when(score <= preset.strong, STRONGLY_NEGATIVE)
        .when(score < preset.negative, NEGATIVE)
        .when(score <= preset.positive, NEUTRAL)
        .otherwise(POSITIVE)
    )


def overall_label(nss: Column, preset: LabelPreset = ENGINE_LABELS) -> Column:
    low, high = (
        (nss <= -preset.overall, nss >= preset.overall)
        if preset.inclusive
        else (nss < -preset.overall, nss > preset.overall)
    )
    return F.when(low, "Negative Trend").when(high, "Positive Trend").otherwise("Mixed Trend")


def lexicon_score(text: Column, lexicon: Mapping[str, float]) -> Column:
    """Compound polarity in [-1, 1] from a valence lexicon, as one row-local expression.

    Tokens are filtered by a hash set first, so the valence is only looked up for actual hits. A
    negation among the three words before a hit turns it, a booster or dampener shifts it.
    """
    single = {w.lower(): float(v) for w, v in lexicon.items() if " " not in w}
    if not 0 < len(single) <= MAX_LEXICON:
        raise ValueError(f"the lexicon must have 1 to {MAX_LEXICON} single-word terms, got {len(single)}")
    terms = list(single)
    valences = F.map_from_arrays(
        F.array(*[F.lit(w) for w in terms]), F.array(*[F.lit(single[w]) for w in terms])
    )

    def adjusted(hit: Column) -> Column:
        return adjusted_valence(F.element_at(valences, hit["word"]), hit["before"])

    def hits(padded: Column) -> Column:
        """Lexicon words with the three words before each; the first three entries are padding."""
        found = F.transform(
            padded,
            lambda t, i: F.when(
                t.isin(terms), F.struct(t.alias("word"), F.slice(padded, F.greatest(i - 2, F.lit(1)), 3).alias("before"))
            ),
        )
        return F.filter(found, lambda h: h.isNotNull())

    tokens = F.filter(words(text), lambda t: t != "")
    found = let(F.concat(F.array_repeat(F.lit(""), 3), tokens), hits)
    return _compound(F.transform(found, adjusted))


def adjusted_valence(base: Column, before: Column) -> Column:
    """Valence of a hit with the three words before it: turned by a negation, shifted by boosters and dampeners."""
    sign, value = F.signum(base), base
    for distance, decay in enumerate(BOOST_DECAY, start=1):
        word = F.get(before, F.lit(3 - distance))
        shift = F.when(word.isin(*BOOSTERS), BOOST * decay).when(word.isin(*DAMPENERS), -BOOST * decay)
        value = value + sign * F.coalesce(shift, F.lit(0.0))
    negated = F.exists(before, lambda w: F.coalesce(w.isin(*NEGATIONS), F.lit(False)))
    return F.when(negated, value * NEGATION_FACTOR).otherwise(value)


def _valence_after(base: Column, before: Column) -> Column:
    """``adjusted_valence`` where the kinds of the three words before are packed into one number, the nearest in the lowest bits."""
    kinds = [F.shiftright(before, 2 * i).bitwiseAND(3) for i in range(len(BOOST_DECAY))]
    sign, value = F.signum(base), base
    for kind, decay in zip(kinds, BOOST_DECAY, strict=True):
        value = value + sign * F.when(kind == BOOSTS, BOOST * decay).when(kind == DAMPENS, -BOOST * decay).otherwise(0.0)
    return F.when(reduce(or_, [k == NEGATES for k in kinds]), value * NEGATION_FACTOR).otherwise(value)


def _compound(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return let(total, lambda t: clip_score(t / F.sqrt(t * t + F.lit(NORMALISER))))


def _kinds(words: pa.Array) -> np.ndarray:
    out = np.zeros(len(words), dtype=np.int64)
    for kind, listed in ((BOOSTS, BOOSTERS), (DAMPENS, DAMPENERS), (NEGATES, NEGATIONS)):
        out[pc.is_in(words, pa.array(listed, words.type)).to_numpy(zero_copy_only=False)] = kind
    return out


def _hits_of(table: Broadcast[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``id, word, hash, uses``: the places of each possible term in a row, with the kinds of the three words before, packed as ``place * 64 + kinds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            tokens, starts = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            for first in range(0, len(tokens), TOKENS_AT_ONCE):
                # Three more tokens before the first one tell what precedes it.
                low, last = max(first - 3, 0), min(first + TOKENS_AT_ONCE, len(tokens))
                coded = tokens.slice(low, last - low).dictionary_encode()
                words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                h, kind = hash_texts(words), _kinds(words)[code]
                at = np.arange(first, last)
                row = np.searchsorted(starts, at, side="right") - 1
                # The first three tokens of a row are padding.
                hit = known(table.value, h)[code[at - low]] & (at >= starts[row] + 3)
                at, row = at[hit], row[hit]
                before = kind[at - low - 1] | kind[at - low - 2] << 2 | kind[at - low - 3] << 4
                key = row * len(words) + code[at - low]
                order = np.argsort(key, kind="stable")
                begin = np.flatnonzero(np.diff(key[order], prepend=-1))
                word = code[at - low][order[begin]]
                uses = pa.ListArray.from_arrays(np.append(begin, len(at)).astype(np.int32), pa.array(((at - starts[row]) * 64 + before)[order]))
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(row[order[begin]])), words.take(pa.array(word)), pa.array(h[word].view(np.int64)), uses],
                    names=["id", "word", "hash", "uses"],
                )

    return run


def score_lexicon_table(
    df: DataFrame, lexicon: DataFrame, id_col: str, text: str = "text", out: str = "sentiment_score", bits: int | None = None
) -> DataFrame:
    """``id, score`` of every row of ``df`` by a lexicon table (``term, valence``) of any size; scores as ``lexicon_score`` gives them.

    Tokens are probed in a filter of the terms and only possible hits, one row for each word of a text with its places, are joined to
    the table. Terms that hold a space are phrases and count nothing here; of terms that differ in case only the largest valence counts.
    """
    single = lexicon.select(F.lower("term").alias("term"), F.col("valence").cast("double").alias("valence")).where(~F.contains("term", F.lit(" ")))
    single = materialised(single.groupBy("term").agg(F.max("valence").alias("valence")), "lexicon")
    terms = materialised(hashed_patterns(single, "term").select("hash", F.col("pattern").alias("term")).join(single, "term"), "lexicon-terms")
    table = df.sparkSession.sparkContext.broadcast(hash_filter(terms.select("hash"), bits))
    tokens = F.concat(F.array_repeat(F.lit(""), 3), F.filter(words(F.coalesce(F.col(text), F.lit(""))), lambda t: t != ""))
    kind = df.schema[id_col].dataType.simpleString()
    found = df.select(F.col(id_col).alias("id"), tokens.alias("tokens")).mapInArrow(_hits_of(table), f"id {kind}, word string, hash long, uses array<long>")
    found = materialised(found, "lexicon-hits")
    hits = salted_join(found, terms, "hash", "id", "inner").where(F.col("word") == F.col("term"))
    placed = F.transform("uses", lambda u: F.struct(F.shiftright(u, 6).alias("place"), _valence_after(F.col("valence"), u).alias("value")))
    # A row's hits come from its own text and are added up in their order.
    summed = hits.select("id", placed.alias("hits")).groupBy("id").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    summed = summed.select("id", _compound(F.transform(F.array_sort("hits"), lambda h: h["value"])).alias(out))
    ids = df.select(F.col(id_col).alias("id"))
    return ids.join(summed, "id", "left").select(F.col("id").alias(id_col), F.coalesce(out, F.lit(0.0)).alias(out))


def score_lexicon(df: DataFrame, lexicon: Mapping[str, float], text: str = "text", out: str = "sentiment_score") -> DataFrame:
    return df.withColumn(out, lexicon_score(F.col(text), lexicon))


Scorer = Callable[[], Callable[[list[str]], Sequence[dict[str, float]] | Sequence[float]]]
# Numbered class names of older models.
NUMBERED_CLASSES = {"label_0": "negative", "label_1": "neutral", "label_2": "positive"}


def _polarity(result: float | dict[str, float]) -> float:
    if isinstance(result, dict):
        named = {NUMBERED_CLASSES.get(k.lower(), k.lower()): float(v) for k, v in result.items()}
        return named.get("positive", 0.0) - named.get("negative", 0.0)
    return float(result)


def score_external(
    df: DataFrame, scorer: Scorer, text: str = "text", out: str = "sentiment_score"
) -> DataFrame:
    """Polarity from a pluggable model: ``scorer()`` loads it once per task and maps texts to class shares.

    Texts of similar length are put next to each other inside each partition, which keeps padded model
    batches small.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = scorer()
        for batch in batches:
            yield batch.assign(**{out: [_polarity(r) for r in predict(batch[text].tolist())]})

    scored = df.sortWithinPartitions(F.length(text)).mapInPandas(run, schema)
    return scored.withColumn(out, clip_score(F.col(out)))


def score_distinct(
    df: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    id_col: str,
    text: str = "text",
    columns: Sequence[str] = ("sentiment_score",),
) -> DataFrame:
    """Run a costly scorer once per distinct text and give every row its text's result.

    The distinct texts come from a map-side combined aggregate. They are joined back on a 128-bit hash
    with salted hot keys, so copies of one text never meet in a single task.
    """
    hashed = df.withColumn("_text_hash", F.md5(F.col(text).cast("binary")))
    distinct = hashed.groupBy("_text_hash").agg(F.any_value(text).alias(text))
    scored = score(distinct).select("_text_hash", *columns)
    return salted_join(hashed, scored, "_text_hash", salt_from=id_col).drop("_text_hash")


def blend_rating(df: DataFrame, base: str = "sentiment_score", rating: str = "rating", out: str = "blended") -> DataFrame:
    """0.6 of the text score and 0.4 of the rating mapped to [-1, 1]; the text score alone without a rating."""
    score = F.col(base).cast("decimal(18,4)")
    stars = F.col(rating).cast("decimal(18,4)")
    both = score * F.lit("0.6").cast("decimal(2,1)") + (stars - 3) * F.lit("0.2").cast("decimal(2,1)")
    mixed = F.coalesce(both, score)
    one = F.lit(1).cast("decimal(2,1)")
    return df.withColumn(out, F.round(F.greatest(-one, F.least(one, mixed)), 2).cast("double"))


def _counts(label: Column) -> dict[str, Column]:
    """Positive and neutral by name; every other label counts as negative."""
    return {
        "positive": F.count_if(label == POSITIVE),
        "neutral": F.count_if(label == NEUTRAL),
        "negative": F.count_if(~label.isin(POSITIVE, NEUTRAL)),
    }


def summarize_sentiment(df: DataFrame, preset: LabelPreset = ENGINE_LABELS, **more: Column) -> DataFrame:
    """One row: counts, net sentiment score, mean polarity and the overall trend; zeros over no rows.

    ``more`` are further aggregates of the same pass, by name.
    """
    label = F.col("sentiment_label")
    s = df.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        *[c.alias(name) for name, c in _counts(label).items()],
        F.coalesce(exact_mean(F.col("sentiment_score")), F.lit(0.0)).alias("_mean"),
        *[c.alias(name) for name, c in more.items()],
    )
    nss = F.coalesce(F.try_divide((F.col("positive") - F.col("negative")) * 100.0, F.col("total_reviews")), F.lit(0.0))
    return s.select(
        "total_reviews",
        "positive",
        "neutral",
        "negative",
        F.round(nss, 1).alias("net_sentiment_score"),
        F.round("_mean", 4).alias("mean_score"),
        overall_label(nss, preset).alias("overall_sentiment"),
        *more,
    )


def with_percent(counts: DataFrame) -> DataFrame:
    """Add whole percentages to rows that carry positive, neutral and negative counts."""
    names = ["positive", "neutral", "negative"]
    shares = percent_ints([F.col(n) for n in names])
    return counts.withColumns({f"{n}_pct": s for n, s in zip(names, shares)})


def sentiment_percent(df: DataFrame) -> DataFrame:
    counts = df.agg(*[c.alias(n) for n, c in _counts(F.col("sentiment_label")).items()])
    return with_percent(counts).drop(*counts.columns)
