"""Sentiment-bearing terms inside a text, as non-overlapping spans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.numbers import let
from voxmill.functions.pii import TAGS
from voxmill.functions.text import utf16_length
from voxmill.operators.patterns import Probe, Rolling, bytes_of, candidates, hash_filter, hashed_rows, known_at, pieces, probe_of
from voxmill.operators.scale import materialised, salted_join
from voxmill.operators.sentiment import MAX_LEXICON

_WORD = r"[A-Za-z][A-Za-z'-]*"
_SPAN = "struct<start:int,end:int,score:double,term:string>"
_STATE = f"struct<at:int,out:array<{_SPAN}>>"


def _spans(text: Column, bmp: Column, regex: str, score: Callable[[Column], Column]) -> Column:
    """Spans, in UTF-16 units, of the matches whose ``score`` is not null, left to right.

    ``bmp`` says that no character needs two units, so plain lengths do. One fold over (gap, match) pairs
    keeps the running position; only scored matches are added to the result, so the work is linear in the
    text plus what the few hits cost.
    """

    def units(c: Column) -> Column:
        return F.when(bmp, F.length(c)).otherwise(utf16_length(c))

    gaps = F.split(text, regex, -1)
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    pairs = F.zip_with(
        gaps,
        found,
        lambda g, m: F.struct(
            units(g).alias("gap"),
            F.coalesce(units(m), F.lit(0)).alias("size"),
            score(m).cast("double").alias("score"),
            m.alias("term"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out")).cast(_STATE)

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        end = begin + p["size"]
        span = F.struct(begin.alias("start"), end.alias("end"), p["score"].alias("score"), p["term"].alias("term"))
        grown = F.when(p["score"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span)))
        return F.struct(end.alias("at"), grown.alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _valence(word: Column, terms: list[str], valences: Column) -> Column:
    """Valence of a lower-case word: itself, or the stems of its first matching ending."""

    def known(w: Column) -> Column:
        return F.when(w.isin(terms), F.element_at(valences, w))

    def cut(n: int) -> Column:
        return F.left(word, F.length(word) - n)

    # Endings in the order they are tried, and the stems each one gives.
    stem = (
        F.when(word.endswith("ed"), F.coalesce(known(cut(2)), known(cut(1))))
        .when(word.endswith("ing"), F.coalesce(known(cut(3)), known(F.concat(cut(3), F.lit("e")))))
        .when(word.endswith("es"), F.coalesce(known(cut(2)), known(cut(1))))
        .when(word.endswith("s"), known(cut(1)))
        .when(word.endswith("ly"), known(cut(2)))
    )
    return F.coalesce(known(word), stem)


def _surfaces(terms: list[str]) -> list[str]:
    """All words that may get a valence: the terms and the forms whose endings lead back to one."""
    endings = ("", "ed", "d", "ing", "es", "s", "ly")
    return sorted({t + e for t in terms for e in endings} | {t[:-1] + "ing" for t in terms if t.endswith("e")})


def highlight_terms(
    df: DataFrame, lexicon: Mapping[str, float], text: str = "text", out: str = "highlights", threshold: float = 1.5
) -> DataFrame:
    """Spans (start, end, polarity, term) in UTF-16 units, sorted by start, never inside redaction tags.

    Phrases claim their place first, longest first, then single words. All of it is row-local array work.
    """
    lowered = {k.lower(): float(v) for k, v in lexicon.items()}
    if not 0 < len(lowered) <= MAX_LEXICON:
        raise ValueError(f"the lexicon must have 1 to {MAX_LEXICON} terms, got {len(lowered)}")
    phrases = sorted((k for k in lowered if " " in k and abs(lowered[k]) >= threshold), key=len, reverse=True)
    terms = [k for k in lowered if " " not in k]
    valences = F.map_from_arrays(F.array(*[F.lit(t) for t in terms]), F.array(*[F.lit(lowered[t]) for t in terms]))
    body = F.coalesce(F.col(text), F.lit(""))

    possible = _surfaces(terms)

    def word_score(term: Column) -> Column:
        # One hash-set test settles almost every word; only possible hits look for their valence.
        strong = let(_valence(F.lower(term), terms, valences), lambda v: F.when(F.abs(v) >= threshold, v))
        return F.when(F.lower(term).isin(possible), strong)

    none = F.array().cast(f"array<{_SPAN}>")

    def free(chosen: Column, s: Column) -> Column:
        return ~F.exists(chosen, lambda c: (c["start"] < s["end"]) & (s["start"] < c["end"]))

    def hits(bmp: Column) -> Column:
        any_tag = "|".join(re.escape(t) for t in TAGS)
        tagged = F.when(
            body.contains("_REDACTED]"), _spans(body, bmp, any_tag, lambda m: F.when(m.isNotNull(), 0.0))
        ).otherwise(none)
        claims = [
            F.when(
                F.lower(body).contains(p),
                _spans(body, bmp, "(?iu)" + re.escape(p), lambda m, v=lowered[p]: F.when(m.isNotNull(), F.lit(v))),
            ).otherwise(none)
            for p in phrases
        ]

        def pick(tags: Column) -> Column:
            candidates = F.filter(F.concat(*claims, _spans(body, bmp, _WORD, word_score)), lambda s: free(tags, s))
            # Words never overlap each other, so without phrases there is nothing to settle.
            if not phrases:
                return candidates
            return F.aggregate(
                candidates,
                none,
                lambda chosen, s: F.when(free(chosen, s), F.concat(chosen, F.array(s))).otherwise(chosen),
            )

        return let(tagged, pick)

    rendered = F.transform(
        let(F.length(body) == utf16_length(body), hits),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.when(s["score"] > 0, F.lit("positive")).otherwise(F.lit("negative")).alias("polarity"),
            s["term"].alias("term"),
        ),
    )
    return df.withColumn(out, F.sort_array(rendered))


# ---------------------------------------------------------------- lexicon tables of any size
_CLAIMS = (
    "again boolean, chunk long, strings array<struct<kind: string, hash: long, found: binary, term: string>>, "
    "which array<int>, start array<int>, end array<int>"
)
_STRING = pa.struct([("kind", pa.string()), ("hash", pa.int64()), ("found", pa.binary()), ("term", pa.string())])
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_IN_WORD = _LETTER.copy()
_IN_WORD[[ord("'"), ord("-")]] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[ord("A") : ord("Z") + 1] += 32


def _lowered(text: str) -> str:
    """Lower case, character by character where the whole would be longer."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def word_forms(words: DataFrame) -> DataFrame:
    """``word, valence``: every word that gets a valence from the terms in ``words`` (``term, valence``), by itself or by its ending."""
    t = F.col("term")
    cut = F.left(t, F.length(t) - 1)
    ends_in_e = t.endswith("e")

    def form(word: Column, rank: int, when: Column | None = None) -> Column:
        return F.struct(F.when(when, word).otherwise(F.lit(None)).alias("word") if when is not None else word.alias("word"), F.lit(rank).alias("rank"))

    # The first term that an ending leads to counts: the word itself, then the longer cut, then the other one.
    forms = F.array(
        form(t, 0), form(F.concat(t, F.lit("ed")), 1), form(F.concat(t, F.lit("d")), 2, ends_in_e), form(F.concat(t, F.lit("ing")), 1),
        form(F.concat(cut, F.lit("ing")), 2, ends_in_e), form(F.concat(t, F.lit("es")), 1), form(F.concat(t, F.lit("s")), 2, ends_in_e),
        form(F.concat(t, F.lit("s")), 1, ~ends_in_e), form(F.concat(t, F.lit("ly")), 1),
    )
    rows = words.select("valence", F.inline(forms)).where(F.col("word").isNotNull())
    return rows.groupBy("word").agg(F.min_by("valence", "rank").alias("valence"))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values, pa.int32()))


def _claims(phrases: Probe, words: Broadcast[np.ndarray]):
    """Possible phrases (p) and words (w) of the texts and their tags, in UTF-16 units: one row for each text that has any.

    A chunk is a piece of a batch. Its first row has the different ``strings`` of all its claims, ``which`` counts them from 0; a tag is -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, last in pieces(batch, 1):
                part = batch.slice(first, last - first)
                texts = part.column(1).to_pylist()
                low, offsets = bytes_of(pa.array([_lowered(t) for t in texts], pa.string()))
                data, own = bytes_of(part.column(1))
                raw_low, raw = low.tobytes(), data.tobytes()
                strings: dict[tuple[str, int, bytes, bytes], int] = {}
                rows, which, start, end = ([np.zeros(0, dtype=np.int64)] for _ in range(4))

                def units(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    begins = (raw & 0xC0) != 0x80
                    return np.concatenate([[0], np.cumsum(begins)]), np.concatenate([[0], np.cumsum(begins.astype(np.int64) + (raw >= 0xF0))])

                def claim(row: np.ndarray, keys: Iterable[tuple[str, int, bytes, bytes]], a: np.ndarray, b: np.ndarray) -> None:
                    rows.append(row)
                    which.append(np.array([strings.setdefault(k, len(strings)) for k in keys], dtype=np.int64))
                    start.append(a)
                    end.append(b)

                chars, wide = units(low)
                # Both have the same characters.
                char_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                row_of = np.repeat(np.arange(len(part)), np.diff(offsets))
                for starts, size, h in candidates(low, offsets, phrases):
                    row = row_of[starts]
                    cuts = zip(starts.tolist(), char_at[chars[starts]].tolist(), char_at[chars[starts + size]].tolist(), h.view(np.int64).tolist(), strict=True)
                    base = wide[offsets[row]]
                    claim(row, [("p", x, raw_low[s : s + size], raw[a:b]) for s, a, b, x in cuts], wide[starts] - base, wide[starts + size] - base)
                _, wide = units(data)
                # A word begins at the first letter of a run of letters, apostrophes and hyphens.
                inside = _IN_WORD[data]
                breaks = own[1:-1][own[1:-1] < len(data)]
                head, tail = inside.copy(), inside.copy()
                head[1:] &= ~inside[:-1]
                tail[:-1] &= ~inside[1:]
                head[breaks] = inside[breaks]
                tail[breaks[breaks > 0] - 1] = inside[breaks[breaks > 0] - 1]
                begin, stop, letters = np.flatnonzero(head), np.flatnonzero(tail) + 1, np.flatnonzero(_LETTER[data])
                begin = np.append(letters, len(data))[np.searchsorted(letters, begin)] if len(begin) else begin
                begin, stop = begin[begin < stop], stop[begin < stop]
                small = _SMALL[data]
                raw_small = small.tobytes()
                h = Rolling(small).of(begin, stop - begin)
                hit = known_at(words.value, h)
                begin, stop, h = begin[hit], stop[hit], h[hit].view(np.int64)
                row = np.repeat(np.arange(len(part)), np.diff(own))[begin]
                cuts = zip(begin.tolist(), stop.tolist(), h.tolist(), strict=True)
                base = wide[own[row]]
                claim(row, [("w", x, raw_small[s:e], raw[s:e]) for s, e, x in cuts], wide[begin] - base, wide[stop] - base)
                if b"_REDACTED]" in raw:
                    for r, text in enumerate(texts):
                        for m in _ANY_TAG.finditer(text) if "_REDACTED]" in text else ():
                            a, b = (len(text[:k].encode("utf-16-le")) // 2 for k in m.span())
                            for out, value in ((rows, r), (which, -1), (start, a), (end, b)):
                                out.append(np.array([value]))
                rows, which, start, end = (np.concatenate(c) for c in (rows, which, start, end))
                order = np.argsort(rows, kind="stable")
                texts_of, sizes = np.unique(rows, return_counts=True)
                if not len(texts_of):
                    continue
                kinds, hashes, found, terms = zip(*strings, strict=True) if strings else ((),) * 4
                # A stretch of a text is cut at characters.
                fields = [pa.array(kinds, pa.string()), pa.array(hashes, pa.int64()), pa.array(found, pa.binary()), pa.array(terms, pa.binary()).cast(pa.string())]
                once = pa.ListArray.from_arrays(np.array([0] + [len(strings)] * len(texts_of), dtype=np.int32), pa.StructArray.from_arrays(fields, fields=list(_STRING)))
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(texts_of)), part.column(2).take(pa.array(texts_of)), pa.array(np.full(len(texts_of), chunk)), once,
                        *(_lists(c[order], sizes) for c in (which, start, end)),
                    ], names=["id", "again", "chunk", "strings", "which", "start", "end"],
                )
                chunk += 1

    return run


_ANY_TAG = re.compile("|".join(re.escape(t) for t in TAGS))


def settle(claims: list[dict]) -> list[tuple[int, int, str, str]]:
    """Spans that hold: outside of tags, phrases from the longest on, then words. One pass over a map of what is taken."""
    taken = bytearray(max((c["end"] for c in claims), default=0))

    def take(c: dict) -> bool:
        if taken.find(1, c["start"], c["end"]) >= 0:
            return False
        taken[c["start"] : c["end"]] = b"\x01" * (c["end"] - c["start"])
        return True

    for c in claims:
        if c["kind"] == "t":
            taken[c["start"] : c["end"]] = b"\x01" * (c["end"] - c["start"])
    phrases, upto = [], {}
    for c in sorted((c for c in claims if c["kind"] == "p"), key=lambda c: c["start"]):
        # A phrase is looked for again behind its last place.
        if c["start"] >= upto.get(c["key"], 0):
            upto[c["key"]] = c["end"]
            phrases.append(c)
    phrases.sort(key=lambda c: (-len(c["key"]), c["key"], c["start"]))
    words = sorted((c for c in claims if c["kind"] == "w"), key=lambda c: c["start"])
    held = [c for c in (*phrases, *words) if take(c)]
    return sorted((c["start"], c["end"], "positive" if c["valence"] > 0 else "negative", c["term"]) for c in held)


_HIGHLIGHTS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("polarity", pa.string()), ("term", pa.string())]))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[dict(zip(("start", "end", "polarity", "term"), s, strict=True)) for s in settle(c)] for c in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(spans, _HIGHLIGHTS)], names=["id", "highlights"])


# Rounds in which the claims of a chunk are settled together; what is left then is settled one by one.
ROUNDS = 64


def _places(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of stretches that are not empty, one stretch after the other, and where each begins among them."""
    sizes = end - start
    at = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(at - start, sizes), at


def first_come(start: np.ndarray, end: np.ndarray, taken: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Which stretches hold if each, in the order given, takes its places unless one of them is taken.

    In a round all stretches hold that come before all others left that share a place with them, and those that share one with them go.
    """
    held = np.zeros(len(start), dtype=bool)
    left = np.arange(len(start))
    owner = np.empty(len(taken), dtype=np.int64)
    while True:
        places, at = _places(start[left], end[left])
        if len(left):
            free = ~np.logical_or.reduceat(taken[places], at)
            left = left[free]
        if not len(left):
            return held
        if not rounds:
            break
        rounds -= 1
        places, at = _places(start[left], end[left])
        owner[places] = len(held)
        np.minimum.at(owner, places, np.repeat(left, (end - start)[left]))
        first = np.minimum.reduceat(owner[places], at) == left
        own = left[first]
        held[own] = True
        taken[_places(start[own], end[own])[0]] = True
        left = left[~first]
    for i in left.tolist():
        if not taken[start[i] : end[i]].any():
            held[i] = True
            taken[start[i] : end[i]] = True
    return held


def _settled_chunk(texts: pa.Table, strings: pa.Table) -> pa.Table:
    """``settle`` for all texts of a chunk: ``id, highlights`` of those that have any. ``strings`` are the ones found in the lexicon."""
    if not len(texts):
        return pa.table({"id": texts.column("id"), "highlights": pa.array([], _HIGHLIGHTS)})
    which, start, end = (texts.column(c).combine_chunks() for c in ("which", "start", "end"))
    row = np.repeat(np.arange(len(texts)), np.diff(which.offsets.to_numpy()))
    which, start, end = (c.flatten().to_numpy().astype(np.int64) for c in (which, start, end))
    # Texts lie one after the other.
    sizes = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(sizes, row, end)
    base = (np.cumsum(sizes) - sizes)[row]
    start, end = start + base, end + base
    taken = np.zeros(int(sizes.sum()), dtype=bool)
    tags = which < 0
    taken[_places(start[tags], end[tags])[0]] = True
    # Phrases come in the order of length and text of their key, all words after them.
    kinds, keys, pos = (strings.column(c).to_pylist() for c in ("kind", "key", "pos"))
    order_of = {key: i for i, key in enumerate(sorted({k for kind, k in zip(kinds, keys, strict=True) if kind == "p"}, key=lambda k: (-len(k), k)))}
    line = np.full(max([int(which.max()), *pos]) + 2, -1)
    rank = np.full(len(line), -1)
    line[pos] = np.arange(len(pos))
    rank[pos] = [order_of[k] if kind == "p" else len(order_of) for kind, k in zip(kinds, keys, strict=True)]
    real = np.flatnonzero(rank[which] >= 0)
    real = real[np.lexsort((start[real], rank[which[real]], row[real]))]
    row, which, start, end, base = (c[real] for c in (row, which, start, end, base))
    own = rank[which]
    # A phrase is looked for again behind its last place.
    same = np.append(False, (row[1:] == row[:-1]) & (own[1:] == own[:-1]) & (own[1:] < len(order_of)))
    if (same & np.append(False, start[1:] < end[:-1])).any():
        keep, upto = np.ones(len(own), dtype=bool), 0
        for i, (again, a, b) in enumerate(zip(same.tolist(), start.tolist(), end.tolist(), strict=True)):
            keep[i] = not again or a >= upto
            upto = b if keep[i] else upto
        row, which, start, end, base = (c[keep] for c in (row, which, start, end, base))
    held = np.flatnonzero(first_come(start, end, taken))
    held = held[np.argsort(start[held], kind="stable")]
    row, which, start, end, base = (c[held] for c in (row, which, start, end, base))
    at = pa.array(line[which])
    polarity = pa.array(np.where(strings.column("valence").to_numpy()[line[which]] > 0, "positive", "negative"), pa.string())
    spans = [pa.array(start - base, pa.int32()), pa.array(end - base, pa.int32()), polarity, strings.column("term").combine_chunks().take(at)]
    of, sizes = np.unique(row, return_counts=True)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(spans, names=["start", "end", "polarity", "term"]))
    return pa.table([texts.column("id").combine_chunks().take(pa.array(of)), lists], names=["id", "highlights"])


def _claims_of_ids(found: DataFrame, real: DataFrame) -> DataFrame:
    """``id, claims`` of texts whose ids repeat: the claims of one id come together."""
    single = found.select("id", "chunk", F.inline(F.arrays_zip("which", "start", "end")))
    known = single.join(real.withColumnRenamed("pos", "which"), ["chunk", "which"]).select("id", "kind", "start", "end", "term", "key", "valence")
    no_text = F.lit(None).cast("string")
    tags = single.where("which < 0").select("id", F.lit("t").alias("kind"), "start", "end", no_text.alias("term"), no_text.alias("key"), F.lit(0.0).alias("valence"))
    # The claims of a row are no more than its text has places.
    return known.unionByName(tags).groupBy("id").agg(F.collect_list(F.struct("kind", "start", "end", "term", "key", "valence")).alias("claims"))


def highlight_spans(
    df: DataFrame, lexicon: DataFrame, id_col: str, text: str = "text", threshold: float = 1.5, bits: int | None = None
) -> DataFrame:
    """``id, highlights`` of the rows that have any, by a lexicon table (``term, valence``) of any size.

    The spans are those of ``highlight_terms``; phrases of equal length are settled in the order of their text. Possible phrases and words are
    found by their hashes. The different strings of a chunk of texts, about a megabyte, are joined to the table, and the claims of its texts are
    settled together. Texts are moved only to mark rows whose ids repeat. Of terms that differ in case only the one with the largest valence counts. Ids
    should be unique; the claims of rows with one id are settled together.
    """
    low = lexicon.select(F.lower("term").alias("term"), F.col("valence").cast("double").alias("valence"))
    # Written once, as making a lexicon can take a pass over all texts.
    low = materialised(low.where(F.col("term") != "").groupBy("term").agg(F.max("valence").alias("valence")), "lexicon")
    strong = F.abs("valence") >= threshold
    spaced = F.contains("term", F.lit(" "))
    phrases = low.where(spaced & strong).select(F.col("term").alias("pattern"), F.lit("p").alias("_kind"), "valence")
    words = word_forms(low.where(~spaced)).where(strong).select(F.col("word").alias("pattern"), F.lit("w").alias("_kind"), "valence")
    entries = materialised(hashed_rows(phrases.unionByName(words)), "lexicon-entries")
    of_phrases, of_words = (entries.where(F.col("_kind") == k) for k in ("p", "w"))
    entries = entries.select("_kind", "hash", "pattern", "valence")
    in_tasks = df.sparkSession.sparkContext.broadcast(hash_filter(of_words.select("hash"), bits))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    repeated = materialised(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("_id"), F.lit(True).alias("again")), "repeated-ids")
    unique = repeated.isEmpty()
    if unique:
        marked = rows.withColumn("again", F.lit(False))
    else:
        marked = rows.join(repeated, rows["id"].eqNullSafe(repeated["_id"]), "left").select("id", "text", F.coalesce("again", F.lit(False)).alias("again"))
    found = materialised(marked.mapInArrow(_claims(probe_of(of_phrases, bits), in_tasks), f"id {kind}, {_CLAIMS}"), "claims")
    strings = found.where(F.size("strings") > 0).select("chunk", F.posexplode("strings").alias("pos", "s")).select("chunk", "pos", "s.*")
    joined = salted_join(strings, entries, "hash", "chunk", "inner")
    real = joined.where((F.col("kind") == F.col("_kind")) & (F.col("found") == F.col("pattern").cast("binary")))
    real = real.select("chunk", "pos", "kind", "term", F.col("pattern").alias("key"), "valence")
    if not unique:
        real = materialised(real, "found-strings")
    spans_kind = f"id {kind}, highlights array<struct<start:int,end:int,polarity:string,term:string>>"
    own = found.where(~F.col("again")).select(F.col("chunk").alias("piece"), "id", "which", "start", "end")
    spans = own.groupBy("piece").cogroup(real.groupBy("chunk")).applyInArrow(lambda a, b: _settled_chunk(a, b), spans_kind)
    if not unique:
        spans = spans.unionByName(_claims_of_ids(found.where("again"), real).mapInArrow(_settled, spans_kind))
    return spans.where(F.size("highlights") > 0).withColumnRenamed("id", id_col)


def highlight_counts(highlighted: DataFrame, highlights: str = "highlights") -> DataFrame:
    """Occurrences per term and polarity."""
    # Narrowed before the explode, so the spans are computed once per row and not once per used field.
    narrow = F.transform(highlights, lambda h: F.struct(F.lower(h["term"]).alias("term"), h["polarity"].alias("polarity")))
    return highlighted.select(F.inline(narrow)).groupBy("term", "polarity").agg(F.count(F.lit(1)).alias("hits"))
