"""Repair of conversations: the cheapest edits that make the roles alternate, and of those the least audit in code-point order.

The roles' initials of a repaired conversation read ``(s?(ua)+)?``. Edits and their costs: keep a row 0, give it the role user or
assistant 1, delete it 2, insert a user or assistant row without text 5; a truncated row that is not deleted adds 5; blank and
duplicate rows have to be deleted. The audit has one letter an edit (K, R, D, I).

1. Rows are dealt by ranges of (conversation, turn, role, text) and sorted, so that a very long conversation lies in many partitions. Each
   partition cuts what it has of a conversation into segments of at most ``SEGMENT_ROWS`` rows and ``SEGMENT_BYTES`` of text.
2. Rows said before are found inside their segment; for conversations of several segments the fingerprints of their rows are grouped too.
3. From here on a row is one byte: the initial of its role and its fault. The bytes of a conversation come together, its texts never do.
4. Cost DP from the end: costs to go of the four states of the grammar, relative to the least one, take few values; each is
   worked out once, and a row is one look-up. The arcs that lie on a cheapest path are known from the costs on both sides of a row.
5. Prefix-doubling path ranking: every node (row, state) is ranked by the least first letter among its cheapest arcs, then by the least 2, 4, 8 ...
   letters: the rank of its first half and of the nodes to which its doubled pointer leads. Nodes that are reached with the same least letters differ
   in state only, so a pointer is a row and a set of states. The arc with the least letter, and among those the one that leads to the node of least
   rank, is taken. Conversations longer than ``BLOCK`` rows are ranked in blocks from the end; a block needs the ranks of the four nodes behind it only.
6. The edits go back to the segments they belong to and are applied there.

Case by case: a null role or text is one space (so a null text is blank). A null conversation id is a conversation of its own; null turns come first. Rows of one
turn come by role and text, in code-point order; equal rows are next to each other, the later ones being duplicates. An empty role has no initial. Texts may be of
any length. No rows give an empty repair; empty tables give empty results. Columns besides those named are not read, so their names do not matter.
One row of the summary holds the audit of its conversation, a byte an edit; nothing larger of a conversation is ever in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.arrow_text import bound_batches
from voxmill.operators.scale import materialised

SEGMENT_ROWS = 4096
SEGMENT_BYTES = 4 << 20
BLOCK = 1 << 15

_BLANKS = " \t\n\x0b\x0c\r"
OTHER, SYSTEM, USER, ASSISTANT = range(4)
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
_ROLES = {USER: "user", ASSISTANT: "assistant"}

# The grammar (s?(ua)+)? as states: nothing yet, after s, after u, after a. The second and third are no ends.
_NEXT = {(0, SYSTEM): 1, (0, USER): 2, (1, USER): 2, (2, ASSISTANT): 3, (3, USER): 2}
_STATES = 4
# An end in a state costs the inserts that are missing.
_CLOSING = {0: (), 1: (USER, ASSISTANT), 2: (ASSISTANT,), 3: ()}

# Edits, in the order of their letters. The code of an edit also says which role it gives.
EDITS = (("D", None), ("I", USER), ("I", ASSISTANT), ("K", None), ("R", USER), ("R", ASSISTANT))
LETTERS = "".join(letter for letter, _ in EDITS)
_LETTER_RANK = np.array([sorted(set(LETTERS)).index(x) for x in LETTERS])
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 2, 1, 5, 5


def _edit(code: int, state: int, symbol: int) -> tuple[int, int] | None:
    """Cost and next state of an edit at a row, or None where it is not allowed."""
    letter, role = EDITS[code]
    initial, fault = symbol & 3, symbol >> 2
    if letter == "D":
        return DELETE_COST, state
    if letter == "I":
        after = _NEXT.get((state, role))
        return None if after is None else (INSERT_COST, after)
    after = _NEXT.get((state, initial if letter == "K" else role))
    if after is None or fault in (BLANK, DUPLICATE):
        return None
    return (REROLE_COST if letter == "R" else 0) + (TRUNCATED_COST if fault == TRUNCATED else 0), after


class Costs:
    """Costs to go before a row, from those behind it. A value is kept once, as its difference to the least of the four states."""

    def __init__(self) -> None:
        self.values: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        # Of a value behind a row and its symbol: bits of the cheapest edits, for each state.
        self.cheapest: dict[tuple[int, int], tuple[int, ...]] = {}
        self.end = self._number(tuple(INSERT_COST * len(_CLOSING[q]) for q in range(_STATES)))

    def _number(self, value: tuple[int, ...]) -> int:
        if value not in self.numbers:
            self.numbers[value] = len(self.values)
            self.values.append(value)
        return self.numbers[value]

    def before(self, behind: int, symbol: int) -> tuple[int, int]:
        """Number of the value before the row, and what its least cost is above the one behind."""
        if (behind, symbol) not in self.steps:
            after = self.values[behind]
            edits = [[_edit(code, q, symbol) for code in range(len(EDITS))] for q in range(_STATES)]
            inserts = [LETTERS[code] == "I" for code in range(len(EDITS))]
            cost = [min(e[0] + after[e[1]] for e, ins in zip(edits[q], inserts, strict=True) if e and not ins) for q in range(_STATES)]
            for _ in range(_STATES):  # inserts lead to another state of the same row
                for q in range(_STATES):
                    cost[q] = min([cost[q], *(e[0] + cost[e[1]] for e, ins in zip(edits[q], inserts, strict=True) if e and ins)])
            bits = tuple(
                sum(1 << c for c, e in enumerate(edits[q]) if e and e[0] + (cost if inserts[c] else after)[e[1]] == cost[q]) for q in range(_STATES)
            )
            least = min(cost)
            self.steps[behind, symbol] = self._number(tuple(c - least for c in cost)), least
            self.cheapest[behind, symbol] = bits
        return self.steps[behind, symbol]


_AFTER = np.array([[[(_edit(c, q, s) or (0, 0))[1] for c in range(len(EDITS))] for q in range(_STATES)] for s in range(16)])


def rank_paths(bits: np.ndarray, symbols: np.ndarray, last: np.ndarray, end_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least paths of several runs of rows at once.

    ``bits[i, q]`` are the cheapest edits at row ``i`` in state ``q``. Rows with ``last`` stand for the end of a run; ``end_rank[i, q]`` are the ranks of what
    comes behind it. Returns the edit to take at every node and the rank of every node among those of all runs.
    """
    rows, states = len(bits), np.arange(_STATES)
    after = _AFTER[symbols]  # row, state, edit
    allowed = (bits[:, :, None] >> np.arange(len(EDITS))) & 1 == 1
    letter = np.where(allowed, _LETTER_RANK, 99).min(axis=2)
    least = allowed & (_LETTER_RANK == letter[:, :, None])
    reached = np.where(least, np.left_shift(1, after), 0)
    mask = np.bitwise_or.reduce(reached, axis=2)
    mask[last] = 1 << states
    insert = _LETTER_RANK[1]
    place = np.arange(rows)[:, None] + ((letter != insert) & ~last[:, None])
    rank = np.where(last[:, None], end_rank, _STATES + letter)
    while True:
        over = bool(last[place].all())
        inside = (mask[:, :, None] >> states) & 1 == 1
        far = np.where(inside, rank[place], np.iinfo(np.int64).max)  # row, state, state behind the doubled pointer
        second = far.min(axis=2)
        taken = inside & (far == second[:, :, None])
        mask = np.bitwise_or.reduce(np.where(taken, mask[place], 0), axis=2)
        place = place[place, np.argmax(taken, axis=2)]
        rank = np.unique(rank * (rank.max() + 1) + second, return_inverse=True)[1].reshape(rows, _STATES)
        if over:
            break
    # Of the cheapest edits with the least letter the one whose node is least.
    onto = np.minimum(np.arange(rows)[:, None, None] + (_LETTER_RANK != insert), rows - 1)
    target = np.where(least, rank[onto, after], np.iinfo(np.int64).max)
    return target.argmin(axis=2).astype(np.uint8), rank


def plan(conversations: list[bytes], costs: Costs | None = None, block: int = BLOCK) -> list[tuple[int, list[list[int]]]]:
    """For each conversation, given as the symbols of its rows: the cost, and for each row the codes of its edits (inserts before it first).

    One more list follows for the inserts behind the last row.
    """
    costs = costs or Costs()
    total: list[int] = []
    behind: list[np.ndarray] = []
    for symbols in conversations:
        value, cost, seen = costs.end, 0, np.empty(len(symbols), dtype=np.int64)
        for i in range(len(symbols) - 1, -1, -1):
            seen[i] = value
            value, more = costs.before(value, symbols[i])
            cost += more
        total.append(cost + costs.values[value][0])
        behind.append(seen)
    table = np.zeros((len(costs.values), 16, _STATES), dtype=np.int64)
    for (value, symbol), bits in costs.cheapest.items():
        table[value, symbol] = bits
    closing = [len(_CLOSING[q]) for q in range(_STATES)]
    choice = [np.empty((len(s), _STATES), dtype=np.uint8) for s in conversations]

    def settle(pieces: list[tuple[int, int, int, list[int]]]) -> list[np.ndarray]:
        """Rank pieces (conversation, from, to, ranks behind) together; returns the ranks of each one's first row."""
        lengths = [b - a for _, a, b, _ in pieces]
        starts = np.concatenate([[0], np.cumsum(np.array(lengths) + 1)])
        rows = int(starts[-1])
        symbols, bits = np.zeros(rows, dtype=np.int64), np.zeros((rows, _STATES), dtype=np.int64)
        last, ranks = np.zeros(rows, dtype=bool), np.zeros((rows, _STATES), dtype=np.int64)
        for (c, a, b, known), at in zip(pieces, starts[:-1], strict=True):
            own = np.frombuffer(conversations[c], dtype=np.uint8)[a:b]
            symbols[at : at + b - a] = own
            bits[at : at + b - a] = table[behind[c][a:b], own]
            last[at + b - a] = True
            ranks[at + b - a] = known
        edit, rank = rank_paths(bits, symbols, last, ranks)
        for (c, a, b, _), at in zip(pieces, starts[:-1], strict=True):
            choice[c][a:b] = edit[at : at + b - a]
        return [np.unique(rank[at], return_inverse=True)[1].tolist() for at in starts[:-1]]

    group: list[tuple[int, int, int, list[int]]] = []
    for c, symbols in enumerate(conversations):
        if len(symbols) > block:
            known = closing
            for upto in range(len(symbols), 0, -block):
                known = settle([(c, max(0, upto - block), upto, known)])[0]
        elif symbols:
            group.append((c, 0, len(symbols), closing))
            if sum(b + 1 for _, _, b, _ in group) > block:
                settle(group)
                group = []
    if group:
        settle(group)
    out = []
    for c, symbols in enumerate(conversations):
        state, edits, own = 0, [], choice[c]
        for i, symbol in enumerate(symbols):
            here = []
            while True:
                code = int(own[i, state])
                here.append(code)
                state = int(_AFTER[symbol, state, code])
                if LETTERS[code] != "I":
                    break
            edits.append(here)
        edits.append([EDITS.index(("I", role)) for role in _CLOSING[state]])
        out.append((total[c], edits))
    return out


# ---------------------------------------------------------------- rows to segments
_SEGMENT = (
    "key string, conv long, seg long, roles array<string>, texts array<string>, symbols binary, hashes binary, first_turn long, last_turn long, n_turns long"
)
_SEGMENT_NAMES = [c.split(" ")[0] for c in _SEGMENT.split(", ")]


def _said(role: str, text: str) -> bytes:
    raw = role.encode()
    return xxhash.xxh3_128_digest(len(raw).to_bytes(8, "little") + raw + text.encode())


def _symbol(role: str, text: str, again: bool) -> int:
    body = text.strip(_BLANKS)
    fault = BLANK if not body else DUPLICATE if again else TRUNCATED if body[-1] not in ".!?" else NO_FAULT
    return fault << 2 | _INITIALS.get(role[:1], OTHER)


class _Segment:
    def __init__(self, key: str, conv: int | None, seg: int) -> None:
        self.head = (key, conv, seg)
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.symbols = bytearray()
        self.hashes: list[bytes] = []
        self.known: set[bytes] = set()
        self.turns: list[int] = []
        self.size = 0

    def put(self, turn: int | None, role: str, text: str) -> None:
        said = _said(role, text)
        self.symbols.append(_symbol(role, text, said in self.known))
        self.known.add(said)
        self.hashes.append(said)
        self.roles.append(role)
        self.texts.append(text)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        self.size += len(text)

    def row(self) -> tuple:
        first, last = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        return (*self.head, self.roles, self.texts, bytes(self.symbols), b"".join(self.hashes), first, last, len(self.turns))


def _cutter(rows: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (key, conv, turn, role, text, part) to segments."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def packed(done: list[tuple]) -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [[]] * len(kinds)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_SEGMENT_NAMES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Segment | None = None
        n = 0
        for batch in batches:
            done = []
            for key, conv, turn, role, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or current.head[0] != key or len(current.roles) >= rows or current.size >= size:
                    if current is not None:
                        done.append(current.row())
                    current, n = _Segment(key, conv, part << 40 | n), n + 1
                current.put(turn, role, text)
            yield packed(done)
        yield packed([current.row()] if current is not None else [])

    return cut


def _segments(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, most_rows: int, most_bytes: int) -> DataFrame:
    space = F.lit(" ")
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("key"), F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"),
    )
    # The number keeps equal rows, which are interchangeable, from being one value of the range.
    order = ["key", "turn", "role", "text", "number"]
    ranged = rows.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("key", "conv", "turn", "role", "text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(
        _cutter(most_rows, most_bytes), _SEGMENT
    )


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of a segment's rows, each once."""
    for batch in batches:
        key, seg, said = [], [], []
        for k, s, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = {hashes[i : i + 16] for i in range(0, len(hashes), 16)}
            key.extend([k] * len(own))
            seg.extend([s] * len(own))
            said.extend(own)
        yield pa.record_batch([pa.array(key, pa.string()), pa.array(seg, pa.int64()), pa.array(said, pa.binary())], names=["key", "seg", "said"])


def _said_before(segments: DataFrame) -> DataFrame:
    """``key, seg, before``: of conversations with several segments, what a segment says that an earlier one has said."""
    several = segments.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("key")
    said = segments.select("key", "seg", "hashes").join(several, "key", "left_semi").mapInArrow(_hash_rows, "key string, seg long, said binary")
    said = materialised(said, "said")
    first = materialised(said.groupBy("key", "said").agg(F.min("seg").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "said-first")
    later = said.join(first, ["key", "said"]).where(F.col("seg") > F.col("first"))
    return later.groupBy("key", "seg").agg(F.collect_list("said").alias("before"))


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbols with the rows said in earlier segments marked as duplicates."""
    for batch in batches:
        out = []
        for symbols, hashes, before in zip(*(batch.column(c).to_pylist() for c in ("symbols", "hashes", "before")), strict=True):
            known = set(before or ())
            marked = bytearray(symbols)
            for i, symbol in enumerate(symbols if known else b""):
                if symbol >> 2 != BLANK and hashes[16 * i : 16 * i + 16] in known:
                    marked[i] = DUPLICATE << 2 | symbol & 3
            out.append(bytes(marked))
        keep = ["key", "conv", "seg", "first_turn", "last_turn", "n_turns"]
        yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "symbols"])


_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_PLAN = (
    "key string, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "parts array<struct<seg: long, edits: string>>"
)


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation with its segments to the counts, the cost, the audit and the edits of each segment."""
    costs = Costs()
    for batch in batches:
        keys, convs, lists = (batch.column(c).to_pylist() for c in ("key", "conv", "segments"))
        symbols = [b"".join(s["symbols"] for s in own) for own in lists]
        columns: dict[str, list] = defaultdict(list)
        for own, line, (cost, edits) in zip(lists, symbols, plan(symbols, costs), strict=True):
            turned = [s for s in own if s["n_turns"]]
            distinct = sum(s["n_turns"] for s in turned) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:], strict=False))
            columns["gaps"].append(turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - distinct if turned else 0)
            faults = np.bincount(np.frombuffer(line, dtype=np.uint8) >> 2, minlength=4)
            for name, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED)):
                columns[name].append(int(faults[fault]))
            columns["illegal"].append(sum((a & 3, b & 3) not in _LEGAL for a, b in zip(line, line[1:], strict=False)))
            columns["cost"].append(cost)
            columns["audit"].append("".join(LETTERS[code] for here in edits for code in here))
            parts, at = [], 0
            for k, s in enumerate(own):
                upto = at + len(s["symbols"]) + (k == len(own) - 1)
                parts.append({"seg": s["seg"], "edits": "".join(str(code) for here in edits[at:upto] for code in here)})
                at = upto
            columns["parts"].append(parts)
        kinds = {n: pa.int64() for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {
            "audit": pa.string(), "parts": pa.list_(pa.struct([("seg", pa.int64()), ("edits", pa.string())])),
        }
        yield pa.record_batch(
            [pa.array(keys, pa.string()), pa.array(convs, pa.int64()), *(pa.array(columns[n], k) for n, k in kinds.items())], names=["key", "conv_id", *kinds]
        )


def apply_edits(roles: list[str], texts: list[str], edits: str) -> tuple[list[str], list[str]]:
    """Roles and texts of a segment after its edits."""
    out_roles, out_texts, i = [], [], 0
    for code in edits:
        letter, role = EDITS[int(code)]
        if letter == "I":
            out_roles.append(_ROLES[role])
            out_texts.append("")
            continue
        if letter != "D":
            out_roles.append(roles[i] if role is None else _ROLES[role])
            out_texts.append(texts[i])
        i += 1
    return out_roles, out_texts


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts_kind = pa.list_(pa.string())
    for batch in batches:
        done = [apply_edits(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("roles", "texts", "edits")), strict=True)]
        keep = ["key", "conv_id", "seg", "segments"]
        yield pa.record_batch(
            [*(batch.column(c) for c in keep), pa.array([r for r, _ in done], texts_kind), pa.array([t for _, t in done], texts_kind)],
            names=[*keep, "roles", "texts"],
        )


@dataclass
class Repair:
    """``summary``: one row a conversation. ``segments``: ``key, conv_id, seg, segments, roles, texts`` of what is left, in the order of ``seg``;
    ``segments`` is how many the conversation has."""

    summary: DataFrame
    segments: DataFrame

    def rows(self) -> DataFrame:
        """``conv_id, seg, place, role, text``, one row each."""
        zipped = F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text"))
        return self.segments.select("conv_id", "seg", F.posexplode(zipped).alias("place", "row")).select("conv_id", "seg", "place", "row.role", "row.text")


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES,
) -> Repair:
    """Repair every conversation in ``turns``. Ids and turns are whole numbers."""
    bound_batches(turns.sparkSession)
    segments = materialised(_segments(turns, conv_col, turn_col, role_col, text_col, segment_rows, segment_bytes), "conversation-segments")
    narrow = segments.drop("roles", "texts").join(_said_before(segments), ["key", "seg"], "left")
    marked = narrow.mapInArrow(_marked, "key string, conv long, seg long, first_turn long, last_turn long, n_turns long, symbols binary")
    # Few bytes a row but much work: the number is given, so that small partitions are not put together.
    marked = marked.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    whole = F.array_sort(F.collect_list(F.struct("seg", "symbols", "first_turn", "last_turn", "n_turns"))).alias("segments")
    planned = materialised(marked.groupBy("key").agg(F.first("conv").alias("conv"), whole).mapInArrow(_planned, _PLAN), "conversation-plans")
    edits = planned.select("key", "conv_id", F.size("parts").alias("segments"), F.inline("parts"))
    joined = segments.select("key", "seg", "roles", "texts").join(edits, ["key", "seg"])
    repaired = joined.mapInArrow(_applied, "key string, conv_id long, seg long, segments int, roles array<string>, texts array<string>")
    return Repair(planned.drop("parts"), repaired)
