"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

For every prefix of a piece of text (what the tokenizer's split pattern yields) there is exactly one token that its
encoding ends with. It is found left to right: the candidates are the tokens that end at this byte, and the right one is
the one that byte-pair encoding does not merge differently with the last token of the prefix before it. So one pass
gives the exact count of *every* prefix, and truncation ("how many characters fit 512 tokens?") or budget questions are
look-ups instead of new encodings.

A text is cut into chunks that start at white space after a non-space; no token and no look-ahead of the pattern
crosses such a place, so counts of chunks add up. The tables of chunks are kept in a bounded cache per task.

Null and empty texts have no tokens. Special strings inside a text become one token each, as the library does by
default. Texts of any length are walked whole; a chunk costs time in proportion to its bytes. Repeated rows
are counted one by one, and columns besides the id and the text are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from voxmill.llm.arrow_text import bound_batches

LIMIT = 512
CACHE = 200_000
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# A chunk that falls into a line feed, one word and punctuation, without asking the pattern.
_SIMPLE = re.compile("(\n?)( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)")
_CHUNK = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
# Characters that some definition calls white space, besides the four that chunks are cut at.
_ODD = "".join(
    map(chr, (0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))
)
_ODD_SPACE = re.compile(f"[{_ODD}]")
_SAFE_CHUNK = re.compile(rf"(?<=[^ \n\t\r{_ODD}])(?=[ \n\t\r])")
_BLANKS = regex.compile(r"\s*")


def _byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable ones stand for themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts of tokens at every prefix, for the byte-level BPE of a ``tokenizers`` file."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = _byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[raw(a), raw(b)] = i
        # Tokens by number: the bytes, then what the merges make, with the merge and the parts of each.
        self.tokens = [bytes([b]) for b in range(256)]
        number = {t: i for i, t in enumerate(self.tokens)}
        self.made, self.left, self.right = [-1] * 256, [-1] * 256, [-1] * 256
        self.merged: dict[int, int] = {}
        for (a, b), rank in self.rank.items():
            self.merged[number[a] << 32 | number[b]] = rank
            if a + b not in number:
                number[a + b] = len(self.tokens)
                self.tokens.append(a + b)
                self.made.append(rank)
                self.left.append(number[a])
                self.right.append(number[b])
        self.finder = ahocorasick.Automaton()
        for i, token in enumerate(self.tokens):
            self.finder.add_word(token.decode("latin-1"), (i, len(token)))
        self.finder.make_automaton()
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.alone: dict[int, bool] = {}
        self.apart: dict[int, bool] = {}
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.size = cache

    def merge(self, piece: bytes) -> list[bytes]:
        """Plain byte-pair encoding of a short piece: merge the pair of lowest rank, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(found)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _whole(self, token: int) -> bool:
        """Whether merging the bytes of a token arrives at the token."""
        self.alone[token] = found = self.merge(self.tokens[token]) == [self.tokens[token]]
        return found

    def _fits(self, pair: int) -> bool:
        """Whether byte-pair encoding keeps two tokens apart when they stand side by side; ``pair`` holds both numbers.

        The merges that made the two are undone from the latest one on. Between any two of these steps the parts that meet at
        the border may not have a merge that comes earlier than the one just undone.
        """
        if len(self.apart) >= 2 * self.size:
            self.apart.clear()
        x, y, limit, found = pair >> 32, pair & 0xFFFFFFFF, 1 << 60, True
        while True:
            if self.merged.get(x << 32 | y, limit) < limit:
                found = False
                break
            if self.made[x] > self.made[y]:
                limit, x = self.made[x], self.right[x]
            elif self.made[y] >= 0:
                # A merge of the same kind further left comes first.
                limit, y = self.made[y] + 1, self.left[y]
            else:
                break
        self.apart[pair] = found
        return found

    def piece(self, data: bytes) -> list[int]:
        """Count at every byte of one piece: entry i belongs to ``data[:i + 1]``."""
        return self._table(data.decode("latin-1"))

    def _table(self, data: str) -> list[int]:
        """``piece`` for bytes that are written as characters."""
        counts: list[int] = []
        last: list[int] = []
        alone, apart, done = self.alone, self.apart, 0
        # The automaton names all tokens that end at each byte, one byte after the other.
        for end, (token, length) in self.finder.iter(data):
            if end < done:
                continue
            start = end + 1 - length
            if start:
                pair = last[start - 1] << 32 | token
                if not (apart[pair] if pair in apart else self._fits(pair)):
                    continue
                counts.append(counts[start - 1] + 1)
            # The whole prefix as one token, if merging really arrives there.
            elif alone[token] if token in alone else self._whole(token):
                counts.append(1)
            else:
                continue
            last.append(token)
            done += 1
        return counts

    def prefixes(self, chunk: str) -> np.ndarray:
        """Count at every character of a chunk (or text without special strings): entry i belongs to ``chunk[:i + 1]``."""
        out: list[int] = []
        before = run_before = run_start = run_end = 0
        run: list[int] = []
        for m in _PATTERN.finditer(chunk):
            text, start = m[0], m.start()
            blank = _BLANKS.match(text).end()
            if blank and start >= run_end:
                run_start, run_end, run_before = start, _BLANKS.match(chunk, start).end(), before
                # A prefix that ends in white space is encoded with its whole run as one piece.
                run = self._at_characters(chunk[run_start:run_end])
            own = self._at_characters(text)
            for i in range(len(text)):
                if i < blank:
                    out.append(run_before + run[start + i - run_start])
                elif i == 1 and text in ("'re", "'ve", "'ll"):
                    out.append(before + 2)  # cut here, a contraction is a quote and a letter
                else:
                    out.append(before + own[i])
            before += own[-1]
        return np.array(out, dtype=np.int32)

    def _at_characters(self, piece: str) -> list[int]:
        counts = self.piece(piece.encode())
        if len(counts) == len(piece):
            return counts
        ends = np.cumsum([len(c.encode()) for c in piece]) - 1
        return [counts[i] for i in ends]

    def count(self, chunk: str) -> int:
        """Tokens of a chunk, from the cache or from its table. What is looked up again survives when the cache is renewed."""
        known = self.counts.get(chunk)
        if known is not None:
            return known
        known = self.older.get(chunk)
        if known is None:
            simple = _SIMPLE.fullmatch(chunk)
            if not simple:
                known = sum(self.piece(m.encode())[-1] for m in _PATTERN.findall(chunk))
            elif simple[1] or simple[3]:
                known = bool(simple[1]) + self.count(simple[2]) + (self.count(simple[3]) if simple[3] else 0)
            else:
                known = (self._table(chunk) if chunk.isascii() else self.piece(chunk.encode()))[-1]
        if len(chunk) <= 64:
            if len(self.counts) >= self.size:
                self.older, self.counts = self.counts, {}
            self.counts[chunk] = known
        return known

    def chunks(self, text: str) -> list[str]:
        return _SAFE_CHUNK.split(text) if _ODD_SPACE.search(text) else _CHUNK.findall(text)

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches of ordinary text and special strings, in order."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def _sum(self, text: str) -> int:
        chunks = self.chunks(text)
        found = list(map(self.counts.get, chunks))
        if None not in found:
            return sum(found)
        return sum([n if n is not None else self.count(chunk) for n, chunk in zip(found, chunks, strict=True)])

    def total(self, text: str) -> int:
        if not any(s in text for s in self.specials):
            return self._sum(text)
        return sum(1 if special else self._sum(part) for part, special in self.parts(text))

    def _units(self, text: str) -> Iterator[tuple[str, bool, str]]:
        """Chunks and special strings, with the chunk that a special string cut short would run on from."""
        tail = ""
        for part, special in self.parts(text):
            for unit in (part,) if special else self.chunks(part):
                yield unit, special, tail
                tail = "" if special else unit

    def every_prefix(self, text: str) -> np.ndarray:
        """Count at every character of a whole text. Where a prefix cuts a special string, what is left of it is plain text."""
        out, before, tail_before = [np.zeros(0, dtype=np.int32)], 0, 0
        for unit, special, tail in self._units(text):
            if special:
                own = self.prefixes(tail + unit)[len(tail) :] + tail_before
                own[-1] = before + 1
            else:
                own = self.prefixes(unit) + before
            out.append(own)
            tail_before, before = (before if not special else before + 1), int(own[-1])
        return np.concatenate(out).astype(np.int32)

    def fitting(self, text: str, limit: int) -> int:
        """Characters of the longest prefix that needs at most ``limit`` tokens; only the chunks near the cut are opened."""
        done, before, tail_before, best = 0, 0, 0, 0
        for unit, special, tail in self._units(text):
            n = before + (1 if special else self.count(unit))
            if special:
                own = self.prefixes(tail + unit)[len(tail) :] + tail_before
                own[-1] = n
            elif n > limit:
                own = self.prefixes(unit) + before
            else:
                own = None
            if own is None:
                best = done + len(unit)
            elif len(good := np.flatnonzero(own <= limit)):
                best = done + int(good[-1]) + 1
            tail_before, before = (before if not special else n), n
            done += len(unit)
            if tail_before > limit:
                break
        return best


_counters: dict[str, PrefixCounter] = {}


def counter_of(path: str) -> PrefixCounter:
    """The counter of a vocabulary, kept for later tasks of the same worker; its caches are bounded."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str | Callable[[], str], limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", store: bool = False) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit, fit_chars``; with ``store`` also ``prefix_tokens``, the count at every character.

    ``path`` is the vocabulary's file, or a function that names it on the machine where a task runs.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path() if callable(path) else path)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = [t or "" for t in part.column(1).to_pylist()]
                tokens = [counter.total(t) for t in texts]
                fit = [len(t) if n <= limit else counter.fitting(t, limit) for t, n in zip(texts, tokens, strict=True)]
                columns = [
                    part.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                    pa.array(fit, pa.int64()),
                ]
                names = [id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"]
                if store:
                    columns.append(pa.array([counter.every_prefix(t) for t in texts], pa.list_(pa.int32())))
                    names.append("prefix_tokens")
                yield pa.record_batch(columns, names=names)

    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_tokens array<int>" * store
    return docs.select(id_col, text_col).mapInArrow(run, schema)
