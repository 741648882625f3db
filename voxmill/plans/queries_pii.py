"""Redaction queries over documents, pages and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions.pii import TYPES
from voxmill.operators import redaction
from voxmill.operators.governance import pii_block
from voxmill.plans.catalog import query
from voxmill.plans.views import R, reviews, table, wide_texts

# RE2 has no look-around: boundaries are captured instead, on a text in which every character that is not
# part of a number is doubled, so that neighbouring matches do not take each other's boundary.
_DOUBLED = "regexp_replace({t}, '([^\\d-])', '\\1\\1', 'g')"
_DOUBLED_IP = "regexp_replace({t}, '([^\\d.])', '\\1\\1', 'g')"
_EMAIL = "[A-Za-z0-9._%+\\-]+@[A-Za-z0-9\\-]+(?:\\.[A-Za-z0-9\\-]+)*\\.[A-Za-z]{{2,}}"
_CARD = "(?:^|[^\\d-])((?:\\d(?:  |-)?){{12,18}}\\d)(?:[^\\d-]|$)"
_OCTET = "(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)"
_IP = "(?:^|[^\\d.])((?:" + _OCTET + "\\.){{3}}" + _OCTET + ")(?:$|[^\\d.]|\\.$|\\.[^\\d])"
_W = "\\p{{L}}\\p{{N}}_"
_NANP = "(?:\\+?\\d{{1,3}}[\\s.\\-]?)?(?:\\(\\d{{3}}\\)\\s?|\\d{{3}}[\\s.\\-]?)\\d{{3}}[\\s.\\-]?\\d{{4}}"
_INTL = "\\+\\d{{1,3}}(?:[\\s.\\-]?\\(?\\d{{1,5}}\\)?){{2,5}}"
_FIVE = "[6-9]\\d{{4}}[\\s\\-]?\\d{{5}}"


def _bounded(body: str) -> str:
    return f"(?:^|[^{_W}.])({body})(?:[^{_W}]|$)"


def _found(source: str, id_col: str, text: str) -> str:
    """CTEs ending in ``found(id, email, cards, luhn, ip, phone)`` per row with any candidate."""
    sql = f"""
src AS (SELECT {id_col} AS id, {text} AS t0 FROM {source}),
step1 AS (SELECT id, len(regexp_extract_all(t0, '{_EMAIL}')) AS email,
                 regexp_replace(t0, '{_EMAIL}', '[EMAIL_REDACTED]', 'g') AS t FROM src),
cand AS (SELECT id, unnest(regexp_extract_all({_DOUBLED.format(t='t')}, '{_CARD}', 1)) AS c,
                generate_subscripts(regexp_extract_all({_DOUBLED.format(t='t')}, '{_CARD}', 1), 1) AS k FROM step1),
digit AS (SELECT id, k, d, unnest(range(1, len(d) + 1)) AS i
          FROM (SELECT id, k, regexp_replace(c, '[^0-9]', '', 'g') AS d FROM cand)),
luhn AS (SELECT id, k, sum(CASE WHEN (len(d) - i) % 2 = 0 THEN CAST(substr(d, i, 1) AS INTEGER)
                                WHEN CAST(substr(d, i, 1) AS INTEGER) > 4 THEN CAST(substr(d, i, 1) AS INTEGER) * 2 - 9
                                ELSE CAST(substr(d, i, 1) AS INTEGER) * 2 END) % 10 = 0 AS ok
         FROM digit GROUP BY id, k),
cards AS (SELECT id, count(*) AS cards, count(*) FILTER (WHERE ok) AS luhn FROM luhn GROUP BY id),
phones AS (SELECT id, email, t,
                  len(regexp_extract_all(p, '{_bounded(_NANP)}', 1)) AS nanp,
                  regexp_replace(p, '(^|[^{_W}.]){_NANP}([^{_W}]|$)', '\\1[PHONE]\\2', 'g') AS p2
           FROM (SELECT id, email, t, regexp_replace(t, '(\\d{{4}}[ -]?){{4}}', '[CARD]', 'g') AS p FROM step1)),
found AS (SELECT phones.id, email, coalesce(cards, 0) AS cards, coalesce(luhn, 0) AS luhn,
                 len(regexp_extract_all({_DOUBLED_IP.format(t='t')}, '{_IP}', 1)) AS ip,
                 nanp + len(list_filter(regexp_extract_all(p2, '{_bounded(_INTL)}', 1),
                     lambda x: len(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15))
                      + len(regexp_extract_all(p2, '{_bounded(_FIVE)}', 1)) AS phone
          FROM phones LEFT JOIN cards ON phones.id = cards.id)"""
    return sql.replace("{{", "{").replace("}}", "}")


_DOCS = _found("documents", "doc_id", "text")
_PAGES = _found("pages", "page_id", "html")


def _report(ctes: str) -> str:
    return f"""WITH {ctes}, totals AS (
      SELECT coalesce(sum(email), 0) AS email, coalesce(sum(phone), 0) AS phone, coalesce(sum(luhn), 0) AS card,
             coalesce(sum(ip), 0) AS ip FROM found)
    SELECT type, CAST(entities AS BIGINT) AS entities FROM totals,
      LATERAL (VALUES ('email', email), ('phone', phone), ('credit_card', card), ('ssn', 0), ('ip_address', ip),
                      ('person', 0), ('total', email + phone + card + ip)) AS v(type, entities)"""


@query("pii_email", f"WITH {_DOCS} SELECT id AS doc_id, email AS found FROM found")
def pii_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = wide_texts(spark, sf_dir, "documents")
    return redaction.count_matches(docs, "email").select("doc_id", "found")


@query("pii_ip", f"WITH {_DOCS} SELECT id AS doc_id, ip AS found FROM found")
def pii_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = wide_texts(spark, sf_dir, "documents")
    return redaction.count_matches(docs, "ip_address").select("doc_id", "found")


@query("pii_credit_card", f"WITH {_DOCS} SELECT id AS doc_id, luhn AS found FROM found")
def pii_credit_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = wide_texts(spark, sf_dir, "documents")
    return redaction.count_matches(docs, "credit_card").select("doc_id", "found")


@query("pii_phone", f"WITH {_DOCS} SELECT id AS doc_id, phone AS found FROM found")
def pii_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = redaction.redact(wide_texts(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.col("pii_phone").alias("found"))


@query("pii_report", _report(_DOCS))
def pii_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.pii_report(redaction.redact(wide_texts(spark, sf_dir, "documents")))


@query("pii_report_pages", _report(_PAGES))
def pii_report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.pii_report(redaction.redact(wide_texts(spark, sf_dir, "pages"), "html"))


@query(
    "pii_report_conversations",
    _report(_found("conversations", "conv_id * 100000 + turn", "text")),
)
def pii_report_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.pii_report(redaction.redact(table(spark, sf_dir, "conversations")))


@query("pii_redact")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = redaction.redact(wide_texts(spark, sf_dir, "documents"))
    return masked.select("doc_id", F.md5("text").alias("text_hash"), *[f"pii_{k}" for k in TYPES])


@query("pii_redact_lenient")
def pii_redact_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redaction.pii_report(redaction.redact(wide_texts(spark, sf_dir, "documents"), profile="lenient"))


_REDACTED = """
red AS (SELECT "row", CASE WHEN "row" % 13 <> 0 THEN text
     WHEN "row" % 4 = 0 THEN concat(split_part(text, ' Write to ', 1), ' Write to [EMAIL_REDACTED]')
     WHEN "row" % 4 = 1 THEN replace(text, '4111 1111 1111 1111', '[PII_REDACTED]')
     WHEN "row" % 4 = 2 THEN concat(split_part(text, ' Seen from ', 1), ' Seen from [PII_REDACTED]')
     ELSE concat(split_part(text, ' Call ', 1), ' Call [PHONE_REDACTED]') END AS text,
     CAST("row" % 13 = 0 AS BIGINT) AS entities FROM r)"""


@query("redact_reviews", f"""WITH {R}, {_REDACTED} SELECT "row", text, entities FROM red""")
def redact_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = redaction.redact(reviews(spark, sf_dir, wide=True))
    return masked.select("row", "text", sum((F.col(f"pii_{k}") for k in TYPES[1:]), F.col("pii_email")).alias("entities"))


@query("output_guard", f"WITH {R} SELECT CAST(0 AS BIGINT) AS guard_hits, count(*) AS \"rows\" FROM r")
def output_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = redaction.redact(reviews(spark, sf_dir, wide=True)).select("row", "text")
    return redaction.output_guard(stored)[1]


@query(
    "output_guard_documents",
    "SELECT CAST(0 AS BIGINT) AS guard_hits, count(*) AS \"rows\" FROM documents",
)
def output_guard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = redaction.redact(wide_texts(spark, sf_dir, "documents")).select("doc_id", "text")
    return redaction.output_guard(stored)[1]


@query(
    "output_guard_hits",
    f"""WITH {R} SELECT count(*) FILTER (WHERE "row" % 13 = 0) AS guard_hits, count(*) AS "rows" FROM r""",
)
def output_guard_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard over texts that nobody has redacted: it changes every one that holds a secret."""
    return redaction.output_guard(reviews(spark, sf_dir, wide=True).select("row", "text"))[1]


# A social security number, an IPv6 address, or neither, made of the event's number; every fourth number is one that is never given out.
_RARE = """CASE event_id % 3
    WHEN 0 THEN concat('My number is ', CASE WHEN event_id % 4 = 0 THEN '666' ELSE CAST(100 + event_id % 500 AS STRING) END, '-',
        lpad(CAST(1 + event_id % 99 AS STRING), 2, '0'), '-', lpad(CAST(event_id % 10000 AS STRING), 4, '0'), ' or so.')
    WHEN 1 THEN concat('Seen at 2001:db8:a', CAST(event_id % 900 AS STRING), ':b:c:d:e:f', CAST(event_id % 7 AS STRING), ' twice.')
    ELSE 'Nothing of that kind at 12:30:45.' END"""


@query(
    "pii_rare",
    f"""WITH x AS (SELECT event_id, {_RARE} AS text FROM events)
    SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 4 <> 0 THEN 'My number is [PII_REDACTED] or so.'
        WHEN event_id % 3 = 1 THEN 'Seen at [PII_REDACTED] twice.' ELSE text END AS text,
      CAST(event_id % 3 = 0 AND event_id % 4 <> 0 AS BIGINT) AS ssn, CAST(event_id % 3 = 1 AS BIGINT) AS ip_address FROM x""".replace("STRING", "VARCHAR"),
)
def pii_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "events").select("event_id", F.expr(_RARE).alias("text"))
    masked = redaction.redact(texts)
    return masked.select("event_id", "text", F.col("pii_ssn").alias("ssn"), F.col("pii_ip_address").alias("ip_address"))


_SECRETS = ["4111 1111 1111 1111", "@mail.example.com", "415-555-", "10.20."]


@query(
    "leak_audit",
    f"""WITH {R}, {_REDACTED}, s(secret) AS (VALUES {', '.join(f"('{x}')" for x in _SECRETS)})
    SELECT secret, (SELECT count(*) FROM r WHERE contains(r.text, secret)) AS raw_rows,
           (SELECT count(*) FROM red WHERE contains(red.text, secret)) AS rows_found FROM s""",
)
def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = reviews(spark, sf_dir, wide=True)
    before = redaction.leak_audit(raw, _SECRETS, ["text"]).withColumnRenamed("rows_found", "raw_rows")
    after = redaction.leak_audit(redaction.redact(raw), _SECRETS, ["text", "theme_id", "event_type"])
    return before.join(after, "secret")


# Every document's words 3 to 6 are a secret, as are the texts of the benchmark; both are looked for in all documents and pages.
_MANY_SECRETS = """secrets AS (SELECT array_to_string(string_split(text, ' ')[3:6], ' ') AS secret FROM documents
    UNION SELECT text FROM benchmark UNION SELECT substr(text, 5, 9) FROM documents),
kept AS (SELECT secret FROM secrets WHERE secret <> '')"""


@query(
    "leak_audit_table",
    f"""WITH {_MANY_SECRETS}, texts AS (SELECT text FROM documents UNION ALL SELECT html FROM pages)
    SELECT md5(secret) AS secret_md5, count(text) AS rows_found FROM kept LEFT JOIN texts ON contains(text, secret) GROUP BY secret""",
)
def leak_audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = (wide_texts(spark, sf_dir, t) for t in ("documents", "pages"))
    some = F.array_join(F.slice(F.split("text", " "), 3, 4), " ")
    secrets = docs.select(some.alias("secret")).union(docs.select(F.substring("text", 5, 9))).union(table(spark, sf_dir, "benchmark").select("text"))
    texts = docs.select("text").unionByName(pages.select(F.col("html").alias("text")))
    found = redaction.leak_audit_table(texts, secrets, ["text"])
    return found.select(F.md5("secret").alias("secret_md5"), "rows_found")


@query(
    "governance_pii",
    f"""WITH {R} SELECT count(*) FILTER (WHERE "row" % 13 = 0) AS total_redacted,
      count(*) FILTER (WHERE "row" % 13 = 0 AND "row" % 4 = 0) AS email,
      count(*) FILTER (WHERE "row" % 13 = 0 AND "row" % 4 = 1) AS credit_card,
      count(*) FILTER (WHERE "row" % 13 = 0 AND "row" % 4 = 2) AS ip_address,
      count(*) FILTER (WHERE "row" % 13 = 0 AND "row" % 4 = 3) AS phone, false AS raw_text_stored FROM r""",
)
def governance_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = pii_block(redaction.pii_totals(redaction.redact(reviews(spark, sf_dir, wide=True))))
    kinds = ("email", "credit_card", "ip_address", "phone")
    return block.select("total_redacted", *[F.col("by_type")[k].alias(k) for k in kinds], "raw_text_stored")
