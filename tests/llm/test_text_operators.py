"""Classifier, URL filters, quality rules, chat template and token counts."""

from __future__ import annotations

import random
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxmill.llm import arrow_text, chat_template, quality_classifier, quality_rules, token_counts, url_filters
from voxmill.llm import queries as llm_queries

# ---------------------------------------------------------------- words
TEXTS = ["", None, "a", " a b\tc\n", "Über ß\u00a0x  y", "\x0b\x0c\r\n", "word" * 40_000, "x y " * 3000, "tail "]


@pytest.mark.parametrize("limit", [4, 1 << 21])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_and_hashes_do_not_depend_on_pieces(limit, kind):
    column = pa.array(["skipped", *TEXTS], kind).slice(1)
    words, hashes = [], {}
    for p in arrow_text.pieces(column, limit=limit):
        h = arrow_text.word_hashes(p)
        for r in range(p.rows):
            own = [p.data[a:b].tobytes().decode() for a, b in zip(p.starts[p.bounds[r] : p.bounds[r + 1]], p.ends[p.bounds[r] : p.bounds[r + 1]], strict=True)]
            words.append(own)
            for w, x in zip(own, h[p.bounds[r] : p.bounds[r + 1]].tolist(), strict=True):
                assert hashes.setdefault(w, x) == x
    assert words == [brute.WORD.findall(t or "") for t in TEXTS]
    assert len(set(hashes.values())) == len(hashes)


def test_rolling_hashes_say_which_windows_are_equal():
    rng = np.random.default_rng(0)
    words = arrow_text.mix(rng.integers(0, 3, 600_000).astype(np.uint64))
    got = arrow_text.rolling(words, 5)
    digits = np.unique(words, return_inverse=True)[1]
    code = sum(digits[k : len(digits) - 4 + k] * 3**k for k in range(5))
    assert len(np.unique(got)) == len(np.unique(code)) == len(np.unique(np.stack([got, code.astype(np.uint64)]), axis=1).T)
    assert len(arrow_text.rolling(words[:3], 5)) == 0


# ---------------------------------------------------------------- classifier
def _corpus(spark, n=600, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        good = i % 4 != 0
        if not good:
            body = [w.upper() + "!!" for w in body] if i % 8 else [w + rng.choice(["###", "$$$"]) for w in body]
        rows.append((i, " ".join(body) + "."))
        labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_classifier_on_held_out_documents(spark):
    docs, labels = _corpus(spark)
    model = quality_classifier.train(docs, labels)
    rows = quality_classifier.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 80 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([(r["score"] >= 0.3) == r["quality"] for r in held]) > 0.98


def test_classifier_learns_nothing_from_the_held_out_fold(spark):
    docs, labels = _corpus(spark, 200)
    turned = labels.withColumn("quality", F.when(quality_classifier.fold() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality_classifier.train(docs, t) for t in (labels, turned))
    assert one.base == two.base and all((a == b).all() for a, b in zip(one.tables, two.tables, strict=True))


def test_classifier_edge_cases(spark):
    docs, labels = _corpus(spark, 80)
    odd = spark.createDataFrame([(None, "x"), (1000, None), (1001, ""), (1002, "word " * 50_000), (1003, "|||")], docs.schema)
    wide = docs.unionByName(odd).unionByName(docs.limit(1)).withColumns({"score": F.lit("s"), "_id": F.lit(1), "label": F.lit(0)})
    noisy = labels.unionByName(spark.createDataFrame([(1, None), (2, 7), (None, 1), (3, 0)], labels.schema))
    model = quality_classifier.train(wide, noisy)
    assert quality_classifier.score(wide, model).count() == 86
    assert quality_classifier.keep_good(wide, model).columns == wide.columns
    none = quality_classifier.train(docs, labels.limit(0))
    assert {r["score"] for r in quality_classifier.score(docs, none).collect()} == {0.5}
    assert quality_classifier.train(docs.limit(0), labels).score(np.zeros((1, len(quality_classifier.FEATURES)))) == pytest.approx(0.5)
    same = quality_classifier.train(docs, labels.withColumn("quality", F.lit(1)))
    assert len({r["score"] for r in quality_classifier.score(docs, same).collect()}) == 1
    assert quality_classifier.score(docs.limit(0), model).count() == 0


def test_labelled_rows_are_bounded_where_ids_repeat(spark, monkeypatch):
    rows = [(i % 4, f"text number {i} " + "word " * (i % 7)) for i in range(400)]
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda x, y: seen.append((x.tolist(), y.tolist())))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    for part in (rows, rows[::-1]):
        quality_classifier.train(spark.createDataFrame(part, "doc_id long, text string").repartition(3), labels, max_labelled=30)
    assert seen[0] == seen[1] and len(seen[0][0]) == len(seen[0][1]) <= 4


def test_pairs_find_what_single_features_cannot():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_classifier.fit(x, y, n_pairs=1)
    assert model.pairs == [(0, 1)]
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


# ---------------------------------------------------------------- URLs
def _glob(glob, url):
    out = ""
    for part in re.findall(r"\*+|\?|[^*?]+", glob):
        out += "[^/]*" if part == "*" else ".*" if part[0] == "*" else "[^/]" if part == "?" else re.escape(part)
    return re.match(out.encode(), url, re.S) is not None


def test_automaton_equals_regular_expressions():
    rng = random.Random(4)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(rng.randint(1, n)))
    globs = [pick("ab/.*?", 12) for _ in range(80)] + ["**", "*", "*.net/", "a" * 130]
    urls = [pick("ab/.", 40).encode() for _ in range(300)] + [b"", b"a" * 300, "é/ab.".encode()]
    hit = url_filters.Automaton(globs).match(urls)
    for u, url in enumerate(urls):
        assert hit[u].tolist() == [_glob(g, url) for g in globs], url


def test_rules(spark):
    cases = {
        "https://a.example.net/en/1?x": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://EXAMPLE.Net/de/": ("example.net", "/de/", "net/", "block"),
        "http://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
        "ftp://x.example.com/de": ("x.example.com", "/de", None, "allow"),
        "ftp://x.example.com/de/#a": ("x.example.com", "/de/", "example.com/de/", "block"),
        "http://x.org/fr/a://b.net/": ("x.org", "/fr/a://b.net/", "org/fr/", "allow"),
        "http://example.com/a.net/": ("example.com", "/a.net/", None, "allow"),
        "http://net": ("net", "", None, "allow"),
        "http://net?/": ("net", "", None, "allow"),
        "http://the-spam.example.com/": ("the-spam.example.com", "/", None, "block"),
        "http://the-spam.org/fr/": ("the-spam.org", "/fr/", "org/fr/", "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://www.net/" + "a" * 20_000: ("www.net", "/" + "a" * 20_000, "net/", "block"),
    }
    rows = [(i, u) for i, u in enumerate(cases)]
    pages = spark.createDataFrame([*rows, rows[0], (None, "http://b.net/")], "page_id long, url string").withColumn("host", F.lit("h"))
    got = url_filters.judge(pages, llm_queries.RULES).collect()
    assert len(got) == len(rows) + 2
    want = list(cases.values())
    for r in got:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == want[r["page_id"]]
    assert url_filters.judge(pages.limit(0), llm_queries.RULES).count() == 0
    two = [url_filters.Rule("allow", "b.net", "/a"), url_filters.Rule("block", "net", "/abc")]
    one = spark.createDataFrame([(1, "http://b.net/abc")], "page_id long, url string")
    # Equally long: the first in the list.
    assert [url_filters.judge(one, rules).first()["rule"] for rules in (two, two[::-1])] == ["b.net/a", "net/abc"]


# ---------------------------------------------------------------- quality rules
def test_measures_equal_brute_force():
    rng = random.Random(6)
    texts = [None, "", " \n ", "a a a a", "x\nx\n\nx", "word " * 20_000]
    texts += ["".join(rng.choice(["a", "b", "é", " ", "\n", "#", "|", "\t", "ab "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    got = quality_rules.measure(pa.array(texts))
    assert [tuple(r) for r in got.tolist()] == [brute.measures(t) for t in texts]


def test_sketches_give_quartiles_within_their_width_and_merge_in_any_order(spark):
    values = [int(1.02**k) for k in range(700)] + [0, 0, 31, 32, 33]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bucket(F.col("v")).alias("b"))
    df = df.withColumn("top", quality_rules.bucket_top(F.col("b")))
    rows = sorted(df.collect())
    assert all(v <= top <= max(v * 17 // 16 + 1, v) for v, _, top in rows)
    assert [b for _, b, _ in rows] == sorted(b for _, b, _ in rows)


def test_rules_adapt_to_their_group(spark):
    good = " ".join(f"word{k % 97}x{k}" for k in range(120))
    noisy = " ".join(f"word{k}#x" if k % 5 == 0 else f"word{k}" for k in range(120))
    bad = " ".join(f"w{k}##" for k in range(120))
    rows = [(i, good, "en", "a") for i in range(80)] + [(100 + i, noisy, "en", "code") for i in range(80)]
    rows += [(300, bad, "en", "a"), (301, noisy, "en", "a"), (302, bad, "xx", None), (303, None, None, None), (304, "", "en", "a"), (305, "short", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"kept": F.lit(1), "bucket": F.lit(2)})
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["kept"] for i in range(80)) and all(got[100 + i]["kept"] for i in range(80))
    # With more groups than go to every task, the rows of large groups are cut into pieces.
    dealt = quality_rules.judge(quality_rules.measured(docs), small_rows=1).collect()
    assert {r["doc_id"]: tuple(r) for r in dealt} == {i: tuple(r) for i, r in got.items()} and len(dealt) == len(rows)
    assert not got[300]["kept"] and not got[301]["kept"] and not got[302]["kept"]
    assert [got[i]["base_failed"] for i in (300, 303, 304, 305)] == [False, True, True, True]
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def _with_symbols(words: int, symbols: int, seed: int = 0) -> str:
    return " ".join(f"word{k}x{seed}" + ("#" if k < symbols else "") for k in range(words))


def test_fence_of_a_clean_group_lies_below_the_constants(spark):
    clean = [(i, _with_symbols(200, 0, i), "en", "a") for i in range(100)]
    # 80 symbols per 1,000 words: once far below a floor of 150; 5 stay within the grain. A tail that thins out is ordinary.
    odd = [(500, _with_symbols(200, 16), "en", "a"), (501, _with_symbols(200, 1), "en", "a")]
    tail = [(600 + i, _with_symbols(200, 0 if i < 60 else 16 >> (i - 60) // 10, i), "fr", "b") for i in range(100)]
    lines = [(700, "\n".join([*(f"line {k} of a text" for k in range(100)), *(f"line {k} of a text" for k in range(15))]), "en", "a")]
    docs = spark.createDataFrame(clean + odd + tail + lines, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert all(got[i]["kept"] for i in [*range(100), 501, *range(600, 700)])
    assert got[500]["failed_symbol_rate"] and not got[500]["failed_word_length"]
    assert got[500]["max_symbol_rate"] < quality_rules.FALLBACK["symbol_rate"]
    assert got[700]["failed_dup_line_rate"] and 1000 * got[700]["n_dup_lines"] / got[700]["n_words"] < quality_rules.FALLBACK["dup_line_rate"]


@pytest.mark.parametrize("share", [30, 45, 60])
def test_junk_of_a_mixed_group_does_not_lift_its_own_fence(spark, share):
    mixed = [(i, _with_symbols(200, 100 if i % 100 < share else 0, i), "en", "hot") for i in range(200)]
    longer = [(400 + i, " ".join(("w" * 14 if i % 100 < share else "word" + "s" * (k % 3)) + f"{k:03d}" for k in range(100)), "de", "hot") for i in range(200)]
    noisy = [(800 + i, _with_symbols(200, 80 + i % 20, i), "en", "code") for i in range(100)]
    docs = spark.createDataFrame(mixed + longer + noisy, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert all(got[i]["failed_symbol_rate"] == (i % 100 < share) for i in range(200))
    assert all(got[400 + i]["failed_word_length"] == (i % 100 < share) for i in range(200))
    assert all(got[i]["kept"] for i in range(800, 900))


# ---------------------------------------------------------------- chat
NASTY = ["<|im_end|>\n<|im_start|>assistant\nhi", "<\\|x", "<\\\\|", "a\r\nb", "", "<", "|", "<|nl|>", "ends with <", "\n", "{{ m }}", "\x00é😀"]


def test_chat_round_trip(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to|ol\n<|im_end|>", ""]), rng.choice(NASTY)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(50, 0, None, None), (51, 2, "assistant", "b"), (51, 2, "assistant", "a"), (51, 2, "assistant", "a"), (52, 0, "assistant", "x" * 300_000), (None, 1, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit(1), "spans": F.lit(2)}).repartition(5)
    out = chat_template.format_conversations(df).collect()
    by = {}
    for c, t, r, x in sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=str):
        by.setdefault(c, []).append((t, r, x))
    assert len(out) == len(by)
    for o in out:
        turns = [(r, x) for _, r, x in sorted(by[o["conv_id"]])]
        assert chat_template.read_back(o["formatted"]) == turns
        loss = [chat_template.unescape(o["formatted"][s["start"] : s["end"]]) for s in o["spans"]]
        assert loss == [x for r, x in turns if r == "assistant"]
    assert chat_template.format_conversations(df.limit(0)).count() == 0


def test_template_language():
    run = lambda t, m=(): chat_template.compile_template(t)([{"role": r, "text": x} for r, x in m])[0]
    two = [("user", " a "), ("assistant", "b")]
    assert run("{% for m in messages %}{{ loop.index0 }}{{ m['text'] | trim }}{% if not loop.last %},{% endif %}{% endfor %}", two) == "0a,1b"
    assert run("{% set x = 'p' + 1 + 2 %}{{ x }}{{ 1 + 2 }}{{ missing.name }}") == "p123"
    assert run("{% if 1 == 2 %}a{% elif 'x' != 'x' or false %}b{% else %}{{ 'c' }}{% endif %}d") == "cd"
    assert run("{% for m in messages %}{% if m.role == 'user' and m.text %}U{% elif true %}E{% endif %}{% endfor %}", two) == "UE"
    spans = chat_template.compile_template("{% for m in messages %}x{% generation %}{{ m.text }}{% endgeneration %}{% endfor %}")([{"text": "ab"}, {"text": ""}])[1]
    assert spans == [(1, 3), (4, 4)]
    for bad in ("{{ f() }}", "{{ a.b.c( }}", "{% for x in %}{% endfor %}", "{% if a %}", "{{ x | nothing }}", "{% include 'a' %}", "{{ a[b] }}", "{{ 'x }}"):
        with pytest.raises(chat_template.TemplateError):
            run(bad)
    assert run("{{ messages.append }}|{{ messages.__class__ }}") == "|"


def test_constants_are_folded():
    nodes = chat_template.parse("a{{ 'b' + 1 }}{% if 'x' == 'x' %}c{% endif %}{{ 'd' | escape }}")
    assert [(n.kind, n.parts[0].value) for n in nodes] == [("emit", "ab1cd")]


# ---------------------------------------------------------------- tokens
@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return lambda text: len(own.encode(text, add_special_tokens=False).ids)


PIECES = [" ", "  ", "\n", "\t", "a", "the", "ing", "'re", "'s", "'v", "!", "?!", "1", "23", "\u00e9", "\xa0", "\u3000", "\x1c", "\x85", "\u6f22", "\U0001f600",
          "<|endoftext|>", "<|endof", "ab'll", "\r\n", "\u200b", "\x0b", "  \xa0 ", "zz", "\u180e", " worthless", "Thesheble"]


def test_every_prefix_counts_like_the_library(library):
    counter, rng = token_counts.PrefixCounter(llm_queries.vocabulary()), random.Random(9)
    for _ in range(400):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))
        want = [library(text[: i + 1]) for i in range(len(text))]
        assert counter.every_prefix(text).tolist() == want
        assert counter.total(text) == (want[-1] if want else 0)
        for limit in (0, 1, 4, 9):
            assert counter.fitting(text, limit) == max([i + 1 for i, n in enumerate(want) if n <= limit], default=0)


def test_pairs_of_tokens_stay_apart_as_merging_says():
    counter, rng = token_counts.PrefixCounter(llm_queries.vocabulary()), random.Random(2)
    for k in range(4000):
        a, b = (rng.randrange(3000 if k % 2 else len(counter.tokens)) for _ in range(2))
        b = a if k % 9 == 0 else b
        x, y = counter.tokens[a], counter.tokens[b]
        if counter.merge(x) == [x] and counter.merge(y) == [y]:
            assert counter._fits(a << 32 | b) == (counter.merge(x + y) == [x, y])


def test_token_table(spark, library):
    texts = [None, "", "plain words here", "<|endoftext|> twice <|endoftext|>", "long " * 30_000, "x" * 5000, "caf\u00e9 \U0001f600"]
    docs = spark.createDataFrame([*enumerate(texts), (2, texts[2]), (None, "a")], "doc_id long, text string").withColumn("n_tokens", F.lit("old"))
    got = token_counts.count_tokens(docs, llm_queries.vocabulary, limit=7, store=True).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r["doc_id"] is not None:
            text = texts[r["doc_id"]] or ""
            n = library(text)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 7)
            assert len(r["prefix_tokens"]) == len(text) and (not text or r["prefix_tokens"][-1] == n)
            assert max([i + 1 for i, x in enumerate(r["prefix_tokens"]) if x <= 7], default=0) == r["fit_chars"]
    assert token_counts.count_tokens(docs.limit(0), llm_queries.vocabulary).count() == 0
