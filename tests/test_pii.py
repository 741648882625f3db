"""Redaction against a brute-force restatement in Python, the golden counts, and single cases."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from voxmill.functions import pii
from voxmill.operators import redaction

CASES = [
    ("write to jo.doe+x@mail.example.co.uk now", {"email": 1}),
    ("ssn 123-45-6789 and 123 45 6789", {"ssn": 2}),
    ("not a ssn: 000-12-3456, 666-12-3456, 912-12-3456, 123-45-67890", {}),
    ("card 4111 1111 1111 1111 ok", {"credit_card": 1}),
    ("card 4111-1111-1111-1111 5500 0000 0000 0004", {"credit_card": 2}),
    ("no card 4111 1111 1111 1112", {}),
    ("from 192.168.0.1 and 256.1.1.1 and 1.2.3.4.5", {"ip_address": 1}),
    ("v6 2001:0db8:85a3:0000:0000:8a2e:0370:7334 ::1", {"ip_address": 1}),
    ("call +1 415-555-0132 or (415) 555-0132 or 4155550132", {"phone": 3}),
    ("mobil +44 20 7946 0958, +91 98765 43210, 98765 43210", {"phone": 3}),
    ("order 12345, room 404, 99.9 percent, 2026-07-01, 10,000 rows", {}),
    ("", {}),
    (None, {}),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(spark, text, want):
    row = redaction.redact(spark.createDataFrame([(text,)], "text string")).first()
    got = {k: row[f"pii_{k}"] for k in pii.TYPES if row[f"pii_{k}"]}
    assert got == want
    assert (row["text"] == (text or "")) == (not want)


@pytest.mark.parametrize("step", [*pii.STRICT, *pii.LENIENT])
def test_gates_are_implied_by_their_patterns(spark, step):
    texts = [t for t, _ in CASES if t] + ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "+4912345678 9", "1.22.33.44"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    matched = df.where(F.regexp_like("text", F.lit(step.regex)))
    assert matched.where(~step.may_match(F.col("text"))).count() == 0


def _luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def _brute(text: str) -> tuple[str, dict[str, int]]:
    counts = dict.fromkeys(pii.TYPES, 0)
    for step in pii.STRICT:

        def swap(m, step=step):
            n = sum(c.isdigit() for c in m.group())
            if step.luhn and not _luhn(m.group()):
                return m.group()
            if step.digits and not step.digits[0] <= n <= step.digits[1]:
                return m.group()
            counts[step.kind] += 1
            return step.tag

        text = re.sub(step.pattern, swap, text)
    return text, counts


@pytest.mark.parametrize("table,key,column", [("documents", "doc_id", "text"), ("pages", "page_id", "html")])
def test_whole_tables_equal_brute_force(spark, table, key, column):
    df = spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet").select(key, column)
    raw = {r[key]: r[column] for r in df.collect()}
    changed = 0
    for row in redaction.redact(df, column).collect():
        text, counts = _brute(raw[row[key]])
        assert row[column] == text
        assert {k: row[f"pii_{k}"] for k in pii.TYPES} == counts
        changed += text != raw[row[key]]
    assert changed == {"documents": 49, "pages": 14}[table]


@pytest.mark.parametrize(
    "table,column,want",
    [
        ("sf0.001/documents", "text", (5, 6, 6, 6)),
        ("sf0.01/documents", "text", (12, 23, 32, 19)),
        ("sf0.1/documents", "text", (186, 177, 180, 159)),
        ("sf0.01/pages", "html", (3, 8, 4, 10)),
        ("sf0.1/pages", "html", (49, 45, 48, 55)),
        ("sf0.01/conversations", "text", (0, 0, 0, 0)),
    ],
)
def test_golden_counts(spark, table, column, want):
    df = spark.read.parquet(f"/root/testdata/{table}.parquet").repartition(16)
    totals = redaction.pii_totals(redaction.redact(df, column)).first()
    assert (totals["email"], totals["credit_card"], totals["ip_address"], totals["phone"]) == want
    assert totals["ssn"] == 0


def test_lenient_profile(spark):
    texts = ["ssn 912-12-3456", "card 4111 1111 1111 1112", "ip 999.1.1.1"]
    df = redaction.redact(spark.createDataFrame([(t,) for t in texts], "text string"), profile="lenient")
    totals = redaction.pii_totals(df).first()
    assert (totals["ssn"], totals["credit_card"], totals["ip_address"], totals["total"]) == (1, 1, 1, 3)


def test_names_from_a_recogniser(spark):
    def recogniser():
        def find(texts):
            return [[m.span() for m in re.finditer(r"Ann|Bo|X", t)] for t in texts]

        return find

    df = redaction.redact(spark.createDataFrame([("Ann met Bo and X",)], "text string"))
    row = redaction.redact_names(df, recogniser).first()
    assert row["text"] == "[PII_REDACTED] met [PII_REDACTED] and X"
    assert row["pii_person"] == 2


def test_output_guard_and_leak_audit(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "mail a@b.co")], "row long, text string")
    guarded, hits = redaction.output_guard(df)
    assert hits.first()["guard_hits"] == 1
    assert {r["row"]: r["text"] for r in guarded.collect()} == {1: "ok", 2: "mail [EMAIL_REDACTED]"}
    assert redaction.leak_audit(guarded, ["a@b.co"], ["text"]).first()["rows_found"] == 0
    assert redaction.leak_audit(df, ["a@b.co"], ["text"]).first()["rows_found"] == 1
    with pytest.raises(ValueError):
        redaction.leak_audit(df, [], ["text"])
