"""Quality rules with thresholds that adapt to each language and source.

One scan measures every whole text. Rates (per 1,000 words) of the texts that pass the base rule then go into mergeable
quantile sketches: histograms over buckets of equal relative width, counted per language and source. Counts add up, so the
sketches of a language or of everything are sums of those of its sources, and any order of merging gives the same result.

The fence of a group is read off its sketch. The anchor is the first quartile ``q1``, the width is ``REACH`` times the spread
below it (``q1`` minus the 5% quantile), at least ``GRAIN``; junk among the texts moves neither, as long as it is less than
three quarters of them, and a source that is noisy throughout has a high anchor. What lies above is counted in octaves, up to 1,
2, 4, 8 ... widths from the anchor. A tail that thins out is ordinary and the fence moves past it; it stops at the first gap,
an octave with at most 1 / ``GAP`` of what lies beyond the octaves so far. A few texts leave gaps by chance, so each source is topped up with
``MIN_GROUP`` texts in the shape of its language, and each language with as many in the shape of everything. A group with
fewer than ``MIN_GROUP`` texts takes the fence of its language, and a small language that of all texts; ``FALLBACK`` counts
only if those are too few as well. The table of fences is joined back to the measured rows; texts take no part in any shuffle.

Null or empty texts have no words and fail the base rule. A null language or source is a group of its own. Repeated
rows are measured and judged one by one. Columns besides the id, text, language and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.arrow_text import SPACE, Piece, bound_batches, pieces, rolling, whole_windows, word_hashes
from voxmill.operators.scale import SMALL_ROWS, lookup_join, materialised

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Symbols, repeated lines and repeated words per 1,000 words, and characters of an average word times 100. The numbers hold only
# where all documents together are fewer than MIN_GROUP.
FALLBACK = {"symbol_rate": 150, "dup_line_rate": 40, "repeat_rate": 250, "word_length": 1500}
REACH = 6
GRAIN = 10
GAP = 10
MIN_GROUP = 50
_OCTAVES = 40
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NONE = "\u0000none"


def _per_row(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    full = [x for x in lines if x.strip()]
    return len(full) - len(set(full))


def _repeat_words(p: Piece) -> np.ndarray:
    """Words inside a three-word window that the same text holds twice or more."""
    covered = np.zeros(len(p.starts), dtype=bool)
    grams = rolling(word_hashes(p), 3)
    at = np.flatnonzero(whole_windows(p.bounds, 3, len(p.starts)))
    if len(at):
        row, gram = p.row_of_word()[at], grams[at]
        order = np.lexsort((gram, row))
        same = (gram[order][1:] == gram[order][:-1]) & (row[order][1:] == row[order][:-1])
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        for k in range(3):
            covered[hit + k] = True
    return _per_row(covered, p.bounds)


def measure(column: pa.Array) -> np.ndarray:
    """The five whole numbers of ``MEASURES`` for each text."""
    parts = [np.zeros((0, 5), dtype=np.int64)]
    for p in pieces(column):
        solid = ~SPACE[p.data] & ((p.data & 0xC0) != 0x80)
        raw = p.data.tobytes()
        lines = [_dup_lines(raw[a:b]) for a, b in zip(p.offsets[:-1], p.offsets[1:], strict=True)]
        parts.append(
            np.column_stack(
                [np.diff(p.bounds), _per_row(solid, p.offsets), _per_row(_SYMBOL[p.data], p.offsets), np.array(lines), _repeat_words(p)]
            )
        )
    return np.concatenate(parts)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang, source`` and the five measures of every row, without the text."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = measure(batch.column(3))
            yield pa.record_batch([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in x.T)], names=[id_col, "lang", "source", *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, lang string, source string, " + ", ".join(f"{m} long" for m in MEASURES)
    return docs.select(id_col, F.col("lang").cast("string"), F.col("source").cast("string"), text_col).mapInArrow(run, schema)


def rates() -> dict[str, Column]:
    per = lambda c, times: F.floor(F.col(c) * times / F.greatest("n_words", F.lit(1))).cast("long")
    return {
        "symbol_rate": per("n_symbols", 1000),
        "dup_line_rate": per("n_dup_lines", 1000),
        "repeat_rate": per("n_repeat_words", 1000),
        "word_length": per("word_chars", 100),
    }


def bucket(value: Column) -> Column:
    """Bucket of a whole number: its 8 leading bits, so a bucket is at most 1/128 of its value wide. Keeps the order."""
    shift = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    return F.call_function("shiftright", value, shift) + F.lit(128) * shift


def bucket_top(b: Column) -> Column:
    """The largest number in a bucket."""
    shift = F.greatest(F.floor(b / 128) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - F.lit(128) * shift + 1, shift) - 1


def base_rule() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(rows: DataFrame) -> DataFrame:
    """``lang, source, rule, bucket, n``: one mergeable sketch per language, source and rule, of texts that pass the base rule."""
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), bucket(v).alias("bucket")) for k, v in rates().items()]))
    named = rows.select(
        *[F.coalesce(c, F.lit(_NONE)).alias(c) for c in ("lang", "source")], (~base_rule()).cast("long").alias("passes"), entries.alias("e")
    )
    return named.groupBy("lang", "source", "e.rule", "e.bucket").agg(F.sum("passes").alias("n"))


def shapes(sketch: DataFrame, group: tuple[str, ...], name: str) -> DataFrame:
    """Merge sketches up to ``group``: number of texts, anchor and width of each rule, and the texts in each octave above the anchor."""
    merged = sketch.groupBy(*group, "rule", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*group, "rule")
    upto = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumns({"total": F.sum("n").over(w), "upto": upto, "top": bucket_top(F.col("bucket"))})
    quantile = lambda share: F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.col("total") * share), F.lit(1)), F.col("top"))).over(w)
    placed = ranked.withColumns({"anchor": quantile(0.25), "low": quantile(0.05)})
    placed = placed.withColumn("width", F.greatest(REACH * (F.col("anchor") - F.col("low")), F.lit(GRAIN)))
    # Within 1 width: 0; up to 2: 1; up to 4: 2; and so on.
    steps = F.floor((F.col("top") - F.col("anchor") - 1) / F.col("width")).cast("long")
    octave = F.when(steps > 0, F.least(F.length(F.bin(steps)), F.lit(_OCTAVES - 1))).otherwise(0)
    facts = [F.col(c).alias(f"{name}_{c}") for c in ("total", "anchor", "width")]
    counted = placed.groupBy(*group, "rule", *facts, octave.alias("octave")).agg(F.sum("n").cast("double").alias("n"))
    full = F.map_from_entries(F.collect_list(F.struct("octave", "n")))
    cells = F.transform(F.sequence(F.lit(0), F.lit(_OCTAVES - 1)), lambda i: F.coalesce(F.col("full")[i], F.lit(0.0)))
    return counted.groupBy(*group, "rule", *[f"{name}_{c}" for c in ("total", "anchor", "width")]).agg(full.alias("full")).withColumn(
        f"{name}_cells", cells
    ).drop("full")


def topped_up(own: str, parent: str) -> Column:
    """The cells of a group and those of ``MIN_GROUP`` texts in the shape of its parent."""
    part = MIN_GROUP / F.greatest(F.col(f"{parent}_total"), F.lit(1))
    return F.zip_with(f"{own}_cells", f"{parent}_cells", lambda a, b: a + b * part)


def fence(name: str, cells: Column) -> Column:
    """Where the tail above the anchor has its first gap; null for groups with too few texts."""
    beyond = lambda i: F.aggregate(F.slice(cells, i + 2, _OCTAVES), F.lit(0.0), lambda a, b: a + b)
    ends = F.filter(F.sequence(F.lit(0), F.lit(_OCTAVES - 2)), lambda i: GAP * F.get(cells, i + 1) <= beyond(i))
    end = F.coalesce(F.get(ends, F.lit(0)), F.lit(_OCTAVES - 1))
    reach = F.col(f"{name}_width") * F.pow(F.lit(2), end).cast("long")
    return F.when(F.col(f"{name}_total") >= MIN_GROUP, F.col(f"{name}_anchor") + reach)


def fences(sketch: DataFrame) -> DataFrame:
    """``lang, source`` and the fence of each rule, ``max_<rule>``."""
    # One row for each rule: broadcast. One for each language and rule.
    everything = F.broadcast(shapes(sketch, (), "all"))
    lang = shapes(sketch, ("lang",), "lang").join(everything, "rule").withColumns(
        {"all_fence": fence("all", F.col("all_cells")), "lang_fence": fence("lang", topped_up("lang", "all"))}
    )
    own = shapes(sketch, ("lang", "source"), "own").join(lang, ["lang", "rule"]).withColumn("own_fence", fence("own", topped_up("own", "lang")))
    fallback = F.create_map(*[F.lit(x) for pair in FALLBACK.items() for x in pair])[F.col("rule")]
    limit = F.coalesce("own_fence", "lang_fence", "all_fence", fallback)
    return own.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rule") == r, limit)).alias(f"max_{r}") for r in FALLBACK])


def _group(lang: Column | str, source: Column | str) -> Column:
    lang, source = (F.col(c) if isinstance(c, str) else c for c in (lang, source))
    return F.concat(F.length(lang), F.lit(":"), lang, source).alias("_group")


def judge(rows: DataFrame, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Add ``base_failed``, one boolean per adaptive rule and ``kept`` to rows of ``measured``.

    The fences go to all tasks while there are few groups; beyond that the rows of large groups are cut into pieces.
    """
    cuts = materialised(fences(materialised(sketches(rows), "quality-sketches")), "quality-fences")
    cuts = cuts.select(_group("lang", "source"), *[f"max_{r}" for r in FALLBACK])
    named = rows.withColumn("_group", _group(*[F.coalesce(c, F.lit(_NONE)) for c in ("lang", "source")]))
    joined = lookup_join(named, cuts, "_group", rows.columns[0], "inner", small_rows).drop("_group")
    judged = joined.withColumn("base_failed", base_rule())
    for rule, rate in rates().items():
        judged = judged.withColumn(f"failed_{rule}", rate > F.col(f"max_{rule}"))
    failed = F.col("base_failed")
    for rule in FALLBACK:
        failed = failed | F.col(f"failed_{rule}")
    return judged.withColumn("kept", ~failed)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return judge(materialised(measured(docs, id_col, text_col), "quality-measures"))
