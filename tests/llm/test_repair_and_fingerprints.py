"""Conversation repair, multiset fingerprints and spelling variants against plain restatements."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxmill.llm import conversation_repair as repair
from voxmill.llm import multiset_fingerprints as prints
from voxmill.llm import queries as llm_queries
from voxmill.llm import spelling_variants as spelling
from voxmill.llm import successors

BLANK = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- conversation repair
def damage(rows):
    """Rows (conv, turn, role, text) after damage."""
    out = []
    for conv, turn, role, text in rows:
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(BLANK)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying every sequence of edits that is no dearer than deleting everything."""
    marks = faults(rows)
    best = [2 * len(rows), "D" * len(rows), ()]

    def legal(initials):
        return re.fullmatch("(s?(ua)+)?", initials) is not None

    def go(i, cost, audit, out):
        if cost > best[0] or not re.fullmatch("s?(ua)*u?", "".join(r[:1] or "-" for r, _ in out)):
            return
        if i == len(rows) and legal("".join(r[:1] for r, _ in out)) and (cost, audit) < (best[0], best[1]):
            best[:] = [cost, audit, tuple(out)]
        for role in ("user", "assistant"):
            go(i, cost + 5, audit + "I", [*out, (role, "")])
        if i < len(rows):
            role, text = rows[i]
            late = 5 if marks[i] == "truncated" else 0
            go(i + 1, cost + 2, audit + "D", out)
            if marks[i] not in ("blank", "duplicate"):
                go(i + 1, cost + late, audit + "K", [*out, (role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, cost + late + 1, audit + "R", [*out, (other, text)])

    go(0, 0, "", [])
    return best[0], best[1], list(best[2])


def expected(rows):
    """One row a conversation, of rows that are damaged already."""
    out = {}
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        group = list(group)
        turns = [t for _, t, _, _ in group if t is not None]
        said = [(r, t) for _, _, r, t in group]
        mark = Counter(faults(said))
        initials = [r[:1] for r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, kept = cheapest(said)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, mark["blank"], mark["duplicate"], mark["truncated"], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept)))
    return out


def talks(seed=3, conversations=60):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randint(1, 6)):
            turn = None if rng.random() < 0.05 else turn + (rng.random() < 0.2)
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys", "Übung"])
            text = rng.choice(["Ja.", "Nein!", "Was ist das?", "so is", "", None, " \t", "Ende. \n", "long " * 50 + ".", "ja ja\x85", "Gut 😀.", "Gut 😀"])
            rows.append((conv, turn, role, text))
        if rows and rng.random() < 0.4:
            rows.append(rows[-1])
    return rows


def test_repair_equals_trying_all_edits(spark, tmp_path):
    rows = talks()
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, key string").repartition(5).write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    got = {r.conv_id: tuple(r)[1:] for r in llm_queries.op11(spark, str(tmp_path)).collect()}
    want = expected(damage(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", sha(""))
    assert got == {c: want.get(c, nothing) for c in {r[0] for r in rows}}
    assert len({audit for *_, audit, _ in got.values()}) > 20


@pytest.mark.parametrize(("rows", "size"), [(3, 1 << 20), (4096, 12)])
def test_repair_of_cut_conversations(spark, rows, size):
    """Segments of a few rows or bytes, many partitions: duplicates, turns and edits go across them."""
    turns = sorted(talks(8, 12), key=lambda r: (r[0] is not None, r[0] or 0))
    done = repair.repair(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), segment_rows=rows, segment_bytes=size)
    again = [(c, t, *(" " if x is None else x for x in (r, s))) for c, t, r, s in turns]
    again.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    want = expected(again)
    summary = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in done.summary.collect()}
    assert summary == {c: w[:-1] for c, w in want.items()}
    left = sorted(done.rows().collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.seg, r.place))
    for conv, w in want.items():
        assert sha("\n".join(f"{r.role}:{r.text}" for r in left if r.conv_id == conv)) == w[-1]
    assert max(r.segments for r in done.segments.collect()) > 1
    digests = done.summary.join(llm_queries.said_digests(done.segments), "key").collect()
    assert {r.conv_id: r.repaired_sha256 for r in digests} == {c: w[-1] for c, w in want.items()}


def least_by_costs(symbols):
    """(cost, audit) by carrying the least audit of each state from the front."""
    states = {0: (0, "")}

    def inserted(states):
        for _ in range(4):
            for q, (cost, audit) in list(states.items()):
                for role in (repair.USER, repair.ASSISTANT):
                    after = repair._NEXT.get((q, role))
                    if after is not None:
                        states[after] = min(states.get(after, (10**9, "")), (cost + 5, audit + "I"))
        return states

    for symbol in symbols:
        step = {}
        for q, (cost, audit) in inserted(states).items():
            for code, (letter, _) in enumerate(repair.EDITS):
                edit = repair._edit(code, q, symbol)
                if letter != "I" and edit:
                    step[edit[1]] = min(step.get(edit[1], (10**9, "")), (cost + edit[0], audit + letter))
        states = step
    states = inserted(states)
    return min(states[q] for q in (0, 3) if q in states)


@pytest.mark.parametrize("block", [4, 64, 1 << 15])
def test_paths_do_not_depend_on_blocks(block):
    rng = np.random.default_rng(1)
    runs = [bytes(rng.integers(0, 16, n).astype(np.uint8)) for n in [0, 1, 2, 3, 5, 8, 40, 200, 1000] * 4]
    runs.append(bytes([repair.USER, repair.USER | repair.TRUNCATED << 2] * 300))
    for symbols, (cost, edits) in zip(runs, repair.plan(runs, block=block), strict=True):
        assert (cost, "".join(repair.LETTERS[c] for here in edits for c in here)) == least_by_costs(symbols)


def test_repair_of_nothing(spark):
    done = repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert done.summary.count() == done.rows().count() == 0


# ---------------------------------------------------------------- multiset fingerprints
def spark_hash(*values):
    """xxhash64 of Spark over strings, longs and ints (given as numpy scalars); nulls are skipped."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.tobytes(), seed=h)
    return h


def lanes(lines):
    """The 41 words of a fingerprint, as unsigned numbers."""
    equal, n, bits = [0] * 16, 0, [0] * 64
    for line in lines:
        w = [np.uint64(spark_hash(np.int32(i), line)) for i in range(2)]
        for i in range(16):
            equal[i] += spark_hash(*w, np.int32(i)) & 0xFFFFFFFF
        words = re.sub("[\t\x0b\x0c\r]", " ", line).split(" ")
        for a, b in itertools.zip_longest(words, words[1:]):
            h = spark_hash(a, b)
            n += 1
            for i in range(64):
                bits[i] += h >> i & 1
    equal = [x % 2**32 for x in equal]
    return [equal[i + 8] << 32 | equal[i] for i in range(8)] + [n] + [bits[i + 32] << 32 | bits[i] for i in range(32)]


def cosine(a, b):
    if a == b:
        return 1.0
    x, y = (np.array([2 * ((w >> s) & 0xFFFFFFFF) - f[8] for s in (0, 32) for w in f[9:]], dtype=float) for f in (a, b))
    size = np.sqrt((x @ x) * (y @ y))
    return max(0.0, min(1.0, x @ y / size)) if size else 0.0


def as_text(words):
    return "".join(f"{w:016x}" for w in words)


TEXTS = ["one two three\nfour five\n\nsix", "", None, "a", "ab", "b\n" * 40, "ünï cödé 😀 text\twith\ttabs", "x " * 5000, "one two three\nfour five\n\nsix", "tail\r\n"]


def followed(docs):
    """(id, text, next text) in descending order of ids, nulls last."""
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    return [(i, t or "", (order[(k + 1) % len(order)][1] or "")) for k, (i, t) in enumerate(order)]


def test_fingerprints_equal_a_plain_restatement(spark, tmp_path):
    rng = random.Random(2)
    docs = [(7 * k - 30, t) for k, t in enumerate(TEXTS)]
    docs += [(1000 + k, "\n".join(" ".join(rng.choice("abc de f gh ij klm".split()) for _ in range(rng.randint(0, 9))) for _ in range(6))) for k in range(40)]
    docs.append((None, "no id. here"))
    spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, key string, row int").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in llm_queries.op12(spark, str(tmp_path)).collect()}
    want = followed(docs)
    assert len(got) == len(docs)
    for i, text, following in want:
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        own, other, after = (lanes(t.split("\n")) for t in (text, edited, following))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), sha(edited), as_text(own), as_text(other))
        assert r.near_edited == pytest.approx(cosine(own, other), abs=1e-9)
        assert r.near_next == pytest.approx(cosine(own, after), abs=1e-9)


def test_fingerprints_are_homomorphic(spark):
    """Order does not matter, repeats do; deletion undoes insertion; a null paragraph is an empty one; no paragraphs give zero."""
    rows = [(1, ["a b", "c", "c"]), (2, ["c", "a b", "c"]), (3, ["a b", "c"]), (4, ["c"]), (5, []), (6, [None]), (7, [""]), (8, None)]
    table = prints.fingerprints(spark.createDataFrame(rows, "id long, lines array<string>"), ["id"], "lines")
    f = {r.id: r.fingerprint for r in table.collect()}
    assert f[1] == f[2] != f[3]
    assert f[6] == f[7] != f[5] == f[8] == [0] * 41
    pair = spark.createDataFrame([(f[3], f[4], f[1], f[5])], "a array<long>, b array<long>, c array<long>, z array<long>")
    row = pair.select(
        prints.add(F.col("a"), F.col("b")).alias("sum"), prints.subtract(F.col("c"), F.col("b")).alias("rest"), prints.likeness(F.col("c"), F.col("c")).alias("same"),
        prints.likeness(F.col("c"), F.col("z")).alias("none"),
    ).first()
    assert row["sum"] == f[1]
    assert row["rest"] == f[3]
    assert (row["same"], row["none"]) == (1.0, 0.0)


def test_likeness_follows_what_documents_share(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    text = lambda: [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(10)]
    rows = []
    for i in range(60):
        a, b = text(), text()
        rows.append((i, a, a[: 2 + i % 8] + b[2 + i % 8 :]))
    both = [prints.fingerprints(spark.createDataFrame(rows, "id long, a array<string>, b array<string>"), ["id"], c).withColumnRenamed("fingerprint", c) for c in "ab"]
    near = {r.id: r.near for r in both[0].join(both[1], "id").select("id", prints.likeness(F.col("a"), F.col("b")).alias("near")).collect()}
    for i, likeness in near.items():
        assert abs(likeness - (2 + i % 8) / 10) < 0.35
    assert abs(np.mean([near[i] - (2 + i % 8) / 10 for i in near])) < 0.03


def test_next_documents_of_repeated_rows_and_single_ones(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (2, "bb"), (2, "cc"), (None, "zz")], "doc_id long, text string")
    rows = successors.with_next(docs, lambda n: n).collect()
    assert len(rows) == len({r.row for r in rows}) == 5
    starts = {(r.id, r.text): r.start for r in rows}
    assert starts[1, "aa"] == "zz"
    assert starts[None, "zz"] in ("bb", "cc")
    assert {starts[2, "bb"], starts[2, "cc"]} < {"bb", "cc", "aa"}
    one = successors.with_next(spark.createDataFrame([(5, "abc")], "doc_id long, text string"), lambda n: n).collect()
    assert [(r.id, r.start) for r in one] == [(5, "abc")]
    assert successors.with_next(docs.limit(0), lambda n: n).count() == 0


# ---------------------------------------------------------------- spelling variants
def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(counts, ratio=5):
    """word to (form, root, n, n_near, form_n), comparing all pairs."""
    forms, out = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if x != w and one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= ratio * n else None
        out[w] = [forms[w], None, n, len(near), counts[best] if forms[w] else None]
    for w, row in out.items():
        end = w
        while forms[end]:
            end = forms[end]
        row[1] = end
    return {w: tuple(r) for w, r in out.items()}


@pytest.mark.parametrize("alphabet", ["ab", "abcé", "abcdefghijklmnopqrstuvwxyzàÿ😀"])
def test_variants_equal_all_pairs(spark, alphabet):
    rng = random.Random(len(alphabet))
    counts = {}
    for _ in range(250):
        word = "".join(rng.choice(alphabet) for _ in range(rng.randint(6, 9)))
        counts[word] = rng.choice([5, 6, 30, 151, 800, 5000])
        k = rng.randrange(len(word))
        for near in (word[:k] + word[k + 1 :], word[:k] + rng.choice(alphabet) + word[k:], word[:k] + rng.choice(alphabet) + word[k + 1 :]):
            counts.setdefault(near, rng.choice([5, 25, 125, 625]))
    counts = {w: n for w, n in counts.items() if len(w) >= 6}
    table = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, near string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(table).collect()}
    assert got == variants(counts)


def test_variant_query_counts_changed_runs(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeÀé") for _ in range(rng.randint(5, 8))) for _ in range(40)]
    docs = [(i, " ".join(rng.choice([w, w.upper(), w + "1", "x-" + w]) for w in rng.choices(words, k=300))) for i in range(60)]
    docs += [(90, None), (91, ""), (92, "abcdef" * 30_000), (None, "abcdea abcdea"), (93, "ABCDEÉ÷×")]
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, word int").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1 :] if h % 199 == 0 else run] += 1
    want = variants({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in llm_queries.op13(spark, str(tmp_path)).collect()}
    assert got == want


def test_chains_of_forms_and_empty_tables(spark):
    chain = {"aaaaaa" + "b" * k: 5 ** (k + 1) for k in range(12)}
    table = spark.createDataFrame(list(chain.items()), "word string, n long")
    got = {r.word: r.root for r in spelling.group_variants(table).collect()}
    assert set(got.values()) == {"aaaaaa" + "b" * 11}
    assert spelling.group_variants(table.limit(0)).count() == 0
