"""URL filters: glob rules packed into a multiword Shift-And automaton.

A URL is matched in its canonical form ``.host/path``: the host in lower case behind a dot, then the path up to
``?`` or ``#``. A glob matches a prefix of it; ``*`` stands for any run without ``/``, ``**`` for any run. All
globs are laid out one behind the other as bits of a row of 64-bit words. One byte of a URL moves the states of
all globs at once, ``next = (shifted & allowed[byte]) | (state & stays[byte])``, and a batch of URLs moves together.

A rule for ``net`` and ``/`` is the glob ``*.net/``. Among the rules that fit, the longest wins, and the first in the
list among equally long ones. A URL that is null or has no ``://`` has an empty host and path and fits no rule.
Repeated rows are judged one by one; columns besides the id and the URL are not read. URLs of any length are walked to
their end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Rule:
    """Block or allow a host with its subdomains, below a path."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}"


# Words in host names of link farms, pill shops and casinos; only asked where no rule fits.
BLOCK_GLOBS = ("*spam", "*cheap-pills", "*casino", "*free-money", "*viagra", "*porn", "*warez", "*click-farm")

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class Automaton:
    """All globs at once. ``match`` gives a table of URLs by globs."""

    def __init__(self, globs: Sequence[str]) -> None:
        moves: list[tuple[int, int | None]] = []  # bit, byte that leads into it (None: any but "/")
        loops: list[tuple[int, bool]] = []  # bit, whether "/" keeps it as well
        self.starts, self.ends, bit = [], [], 0
        for glob in globs:
            self.starts.append(bit)
            for part in re.findall(rb"\*+|\?|[^*?]+", glob.encode()):
                if part[:1] == b"*":
                    loops.append((bit, len(part) > 1))
                    continue
                for byte in part:
                    bit += 1
                    moves.append((bit, None if part == b"?" else byte))
            self.ends.append(bit)
            loops.append((bit, True))  # a glob that has matched stays so
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.allowed = np.zeros((256, self.words), dtype=np.uint64)
        self.stays = np.zeros((256, self.words), dtype=np.uint64)
        slash = ord("/")
        for at, byte in moves:
            mark = np.uint64(1 << at % 64)
            for b in range(256) if byte is None else (byte,):
                if byte is not None or b != slash:
                    self.allowed[b, at // 64] |= mark
        for at, also_slash in loops:
            mark = np.uint64(1 << at % 64)
            for b in range(256):
                if also_slash or b != slash:
                    self.stays[b, at // 64] |= mark
        self.first = np.zeros(self.words, dtype=np.uint64)
        for at in self.starts:
            self.first[at // 64] |= np.uint64(1 << at % 64)

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        lengths = np.array([len(u) for u in urls], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(urls), dtype=np.uint8)
        start = np.concatenate([[0], np.cumsum(lengths)])[:-1][order] if len(urls) else lengths
        lengths = lengths[order]
        state = np.tile(self.first, (len(urls), 1))
        carry = np.uint64(63)
        # Longest first: the URLs that still have a byte at this place are a prefix of the table.
        longest = int(lengths[0]) if len(urls) else 0
        steps = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
        for at, live in enumerate(steps):
            byte = data[start[:live] + at]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> carry
            state[:live] = (moved & self.allowed[byte]) | (now & self.stays[byte])
        hit = np.empty((len(urls), len(self.ends)), dtype=bool)
        for g, at in enumerate(self.ends):
            hit[order, g] = (state[:, at // 64] >> np.uint64(at % 64)) & np.uint64(1)
        return hit


def judge(
    pages: DataFrame, rules: Sequence[Rule], block_globs: Sequence[str] = BLOCK_GLOBS, id_col: str = "page_id", url_col: str = "url",
    chunk: int = 4096,
) -> DataFrame:
    """``id, host, path, rule, verdict, glob``; the globs decide where no rule fits, and everything else is allowed."""
    # The longest rule first, so the first hit of a row is the one that wins.
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs = tuple(block_globs)
    machine = Automaton([r.glob for r in ranked] + list(globs))
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                split = [split_url(u) for u in part.column(1).to_pylist()]
                hit = machine.match([f".{h}{p}".encode() for h, p in split])
                names, verdicts, by = [], [], []
                for row in hit:
                    found = next((r for r, x in zip(ranked, row, strict=False) if x), None)
                    glob = next((g for g, x in zip(globs, row[len(ranked) :], strict=True) if x), None)
                    names.append(found.name if found else None)
                    by.append(None if found else glob)
                    verdicts.append(found.action if found else "block" if glob else "allow")
                yield pa.record_batch(
                    [part.column(0), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()),
                     pa.array(names, pa.string()), pa.array(verdicts, pa.string()), pa.array(by, pa.string())],
                    names=[id_col, "host", "path", "rule", "verdict", "glob"],
                )

    return pages.select(id_col, url_col).mapInArrow(
        run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, glob string"
    )
