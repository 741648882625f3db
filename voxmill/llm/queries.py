"""One query for each operator with production parameters, over its whole table, and the SQL of those that SQL can say."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import (
    chat_template,
    conversation_repair,
    decontamination,
    line_dedup,
    mixing,
    multiset_fingerprints,
    near_dedup,
    quality_classifier,
    quality_rules,
    spelling_variants,
    substring_dedup,
    successors,
    token_counts,
    url_filters,
)
from voxmill.operators.scale import materialised

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).select(
        "doc_id", (quality_classifier.fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


RULES = (
    url_filters.Rule("block", "net", "/"),
    url_filters.Rule("allow", "example.net", "/en/"),
    url_filters.Rule("block", "example.com", "/de/"),
    url_filters.Rule("allow", "org", "/fr/"),
)

_FITS = " ".join(
    f"WHEN ('.' || host) LIKE '%.{r.host}' AND starts_with(path, '{r.path}') THEN '{r.name}'"
    for r in sorted(RULES, key=lambda r: -len(r.name))
)
_WORDS = " ".join(f"WHEN contains('.' || host, '{g[1:]}') THEN '{g}'" for g in url_filters.BLOCK_GLOBS)


@query(
    "op2_url_filters",
    f"""
    WITH split AS (
        SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS raw,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages
    ), named AS (SELECT page_id, translate(raw, '{_CAPITALS}', '{_SMALL}') AS host, path FROM split
    ), fitted AS (
        SELECT page_id, host, path, CASE {_FITS} END AS rule, CASE {_WORDS} END AS hit FROM named
    )
    SELECT page_id, host, path, rule,
        CASE WHEN rule IN ({", ".join(f"'{r.name}'" for r in RULES if r.action == "block")}) THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow' WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
        CASE WHEN rule IS NULL THEN hit END AS glob
    FROM fitted
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), RULES)


@query(
    "op3_line_dedup",
    f"""
    WITH split AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
        FROM documents
    ), keyed AS (
        SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), '{_CAPITALS}', '{_SMALL}') AS key
        FROM split
    ), repeated AS (
        SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
    ), judged AS (SELECT k.*, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN repeated r USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OWN_TURNS = "<|im_end|><|im_start|>assistant ok"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read each formatted conversation back and take the digests of what it says."""
    for batch in batches:
        rows = []
        for formatted, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            turns = chat_template.read_back(formatted)
            whole = "".join(f"{role}\n{text}\n" for role, text in turns)
            loss = "".join(chat_template.unescape(formatted[s["start"] : s["end"]]) for s in spans)
            rows.append(
                (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
            )
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.record_batch(
            [batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


@query(
    "op5_chat_template",
    rf"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '{OWN_TURNS}'), (-1, 1, 'assistant', '{OWN_TURNS}')
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length(role) + length(text) + 24 + len(regexp_extract_all(text, '<\\*\|')) + len(regexp_extract_all(role, '<\\*\|'))
            + 6 * (length(role) - length(replace(role, chr(10), '')))
            - (length(role) - length(replace(role, chr(10), '')))) AS BIGINT) AS formatted_chars
    FROM turns GROUP BY conv_id
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", OWN_TURNS), (-1, 1, "assistant", OWN_TURNS)], turns.schema)
    formatted = chat_template.format_conversations(turns.unionByName(own))
    return formatted.mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", *quality_rules.MEASURES, "base_failed", "kept", *[f"failed_{r}" for r in quality_rules.FALLBACK]
    )


def vocabulary() -> str:
    """Place of the vocabulary file on this machine; executors ask for themselves."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


@query("op9_substring_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query("op8_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_copies(table(spark, sf_dir, "documents"), size=2, percent=80).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


@query(
    "op6_mixing",
    """
    WITH sized AS (
        SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
    ), per AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(CASE WHEN size < 50 THEN size ELSE 0 END) AS BIGINT) AS short_size
        FROM sized GROUP BY source
    ), weighted AS (
        SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM per
    ), levelled AS (
        SELECT *, row_number() OVER o AS place,
            (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
        FROM weighted
        WINDOW o AS (ORDER BY cap / weight, source NULLS LAST),
            b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), fixed AS (
        SELECT min(place) AS first_place, min_by(level, place) AS first_level FROM levelled WHERE level < cap / weight
    ), aimed AS (
        SELECT source, source_size, short_size,
            CASE WHEN place >= first_place THEN least(CAST(cap AS DOUBLE), first_level * weight) ELSE CAST(cap AS DOUBLE) END AS target
        FROM levelled, fixed
    ), split AS (
        SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM aimed
    ), parted AS (SELECT *, target - copies * source_size AS open FROM split
    ), factored AS (
        SELECT *, CASE WHEN source_size > 0 THEN open / (source_size - short_size + 0.25::DOUBLE * short_size) ELSE 0 END AS factor FROM parted
    ), chances AS (
        SELECT *, CASE WHEN factor >= 1 THEN open - (source_size - short_size) ELSE open END AS rest FROM factored
    ), drawn AS (
        SELECT d.doc_id, d.size, p.source, p.source_size, p.target, p.copies, p.rest, factor >= 1 AND size >= 50 AS sure,
            CASE WHEN size >= 50 THEN factor WHEN factor < 1 THEN 0.25::DOUBLE * factor WHEN short_size > 0 THEN rest / short_size ELSE 0 END AS part,
            (CAST(CAST('0x' || substr(md5('mix' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS u
        FROM sized d JOIN chances p ON d.source IS NOT DISTINCT FROM p.source
    ), ordered AS (
        SELECT *, CASE WHEN sure OR rest <= 0 OR part <= 0 THEN NULL WHEN part < 1 THEN u / (1 - u) / (part / (1 - part)) ELSE 0 END AS k
        FROM drawn
    ), summed AS (
        SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ordered
    )
    SELECT doc_id, size, source_size, target,
        CAST(size * (copies + CASE WHEN sure OR k IS NOT NULL AND upto - size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM summed
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))


@query("op12_multiset_fingerprints")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda n: F.floor(n / 3).cast("long")
    rows = successors.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"), cut)
    kept = F.left("text", (F.col("n") - cut(F.col("n"))).cast("int"))
    rows = rows.select("row", "key", "next_key", "id", "n", "text", "start", kept.alias("kept"))
    lines, whole = multiset_fingerprints.paragraphs(F.col("text")), F.size(multiset_fingerprints.paragraphs(F.col("kept")))
    changed = F.concat(F.substring_index("kept", "\n", -1), F.col("start"))
    # The edit takes the paragraphs from the one it cuts to the end, and puts in those of the rest of that one and the next document's start.
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.slice(lines, F.lit(1), whole - 1).alias("lines")),
        F.struct(F.lit(1).alias("part"), F.slice(lines, whole, F.size(lines)).alias("lines")),
        F.struct(F.lit(2).alias("part"), multiset_fingerprints.paragraphs(changed).alias("lines")),
    )
    edited = F.sha2(F.concat("kept", "start").cast("binary"), 256)
    keys = ["key", "row", "id", "n", "next_key", "edited_sha256"]
    summed = multiset_fingerprints.fingerprints(
        rows.select("key", "row", "id", "n", "next_key", edited.alias("edited_sha256"), F.inline(parts)), [*keys, "part"], "lines"
    )
    part = [F.max(F.when(F.col("part") == i, F.col("fingerprint"))).alias(f"p{i}") for i in range(3)]
    both = summed.groupBy(*keys).agg(*part)
    after_edit, before = multiset_fingerprints.add(F.col("p0"), F.col("p2")), multiset_fingerprints.add(F.col("p0"), F.col("p1"))
    both = materialised(both.select(*keys, before.alias("own"), after_edit.alias("edited")), "fingerprints")
    following = both.groupBy(F.col("key").alias("next_key")).agg(F.min_by("own", "row").alias("following"))
    own, other, after = F.col("own"), F.col("edited"), F.col("following")
    return both.join(following, "next_key").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256",
        multiset_fingerprints.as_text(own).alias("fingerprint"), multiset_fingerprints.as_text(other).alias("edited_fingerprint"),
        multiset_fingerprints.likeness(own, other).alias("near_edited"), multiset_fingerprints.likeness(own, after).alias("near_next"),
    )


# CRC-32 (the reflected polynomial 0xEDB88320) of the bytes of a string of ASCII and Latin-1 letters, which DuckDB does not have.
_CRC_TABLE = """(
        SELECT list(v ORDER BY b) AS crc FROM (
            SELECT b, list_reduce(list_prepend(CAST(b AS UBIGINT), CAST(range(8) AS UBIGINT[])),
                lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS UBIGINT)) ELSE v // 2 END) AS v
            FROM (SELECT unnest(range(256)) AS b))
    )"""


def crc32_sql(text: str, table: str) -> str:
    """SQL of the checksum of ``text``; ``table`` is a list of the 256 values for one byte. Code points below U+0100 only."""
    points = f"list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS UBIGINT))"
    in_utf8 = f"flatten(list_transform({points}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + p // 64, 128 + p % 64] END))"
    step = f"lambda v, b: xor({table}[CAST(xor(v % 256, b) AS BIGINT) + 1], v // 256)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {in_utf8}), {step}), CAST(4294967295 AS UBIGINT))"


def _said_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each conversation from its sorted segments, one segment in memory at a time."""
    key, digest, empty = None, hashlib.sha256(), True
    for batch in batches:
        done = []
        for k, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("key", "roles", "texts")), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest, empty = k, hashlib.sha256(), True
            for role, text in zip(roles, texts, strict=True):
                digest.update(f"{role}:{text}".encode() if empty else f"\n{role}:{text}".encode())
                empty = False
        yield pa.record_batch([pa.array([r[i] for r in done], pa.string()) for i in range(2)], names=["key", "repaired_sha256"])
    if key is not None:
        yield pa.record_batch([pa.array([x], pa.string()) for x in (key, digest.hexdigest())], names=["key", "repaired_sha256"])


def said_digests(segments: DataFrame) -> DataFrame:
    """``key, repaired_sha256``: conversations of one segment where they are, others in a stream over their sorted segments."""
    said = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    short = segments.where(F.col("segments") == 1).select("key", F.sha2(F.array_join(said, "\n").cast("binary"), 256).alias("repaired_sha256"))
    long = segments.where(F.col("segments") > 1).select("key", "seg", "roles", "texts")
    long = long.repartition("key").sortWithinPartitions("key", "seg").mapInArrow(_said_digests, "key string, repaired_sha256 string")
    return short.unionByName(long)


def damaged(turns: DataFrame) -> DataFrame:
    """The conversations with rows dropped, emptied, cut, repeated or given to the user, as the checksum of their place says."""
    space = F.lit(" ")
    place = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    what = (F.crc32(place.cast("binary")) % 20).alias("what")
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), what).where("what <> 0")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("what") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


# One step of the DP in SQL: the least (cost, audit, repaired) of each state. Texts are joined by line breaks that go before each row.
_LINE = "chr(10) || {role} || ':' || {text}"


def _sql_edit(state: str, cost: str, letter: str, line: str = "''") -> str:
    return f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'said': {state}.said || {line}}}"


def _sql_least(*choices: str) -> str:
    return f"list_min([x for x in [{', '.join(choices)}] if x.cost < 1000000000])"


_IMPOSSIBLE = "{'cost': CAST(1000000000 AS BIGINT), 'audit': '', 'said': ''}"


def _sql_row(initial: str, role: str, before: tuple[str, ...], state: str) -> str:
    """The state after a row that is deleted, kept or gets ``role``."""
    kept = [f"CASE WHEN may AND initial = '{initial}' THEN {_sql_edit(p, 'late', 'K', _LINE.format(role='role', text='text'))} ELSE {_IMPOSSIBLE} END" for p in before]
    turned = [f"CASE WHEN may THEN {_sql_edit(p, 'late + 1', 'R', _LINE.format(role=repr(role), text='text'))} ELSE {_IMPOSSIBLE} END" for p in before if role]
    return f"coalesce({_sql_least(_sql_edit(state, '2', 'D'), *kept, *turned)}, {_IMPOSSIBLE})"


def _sql_insert(role: str, before: tuple[str, ...], state: str) -> str:
    inserted = [_sql_edit(p, "5", "I", _LINE.format(role=repr(role), text="''")) for p in before]
    return f"coalesce({_sql_least(state, *inserted)}, {_IMPOSSIBLE})"


@query(
    "op11_conversation_repair",
    f"""
    WITH RECURSIVE crc_table AS {_CRC_TABLE}, hashed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')", "crc")} % 20 AS what
        FROM conversations, crc_table
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
            CASE WHEN what = 1 THEN '' WHEN what = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy
        FROM hashed WHERE what <> 0
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, left(role, 1) AS initial FROM damaged
    ), judged AS (
        SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, again AND NOT blank AS duplicate,
            NOT blank AND NOT duplicate AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS truncated, NOT blank AND NOT duplicate AS may,
            CASE WHEN truncated THEN 5 ELSE 0 END AS late,
            lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS meeting, place > 1 AS meets
        FROM placed
    ), counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
            count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
            count(*) FILTER (WHERE meets AND coalesce(meeting, '') NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS last
        FROM judged GROUP BY conv_id
    ), steps AS (
        SELECT conv_id, CAST(0 AS BIGINT) AS place, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'said': ''}} AS s0, {_IMPOSSIBLE} AS s1,
            {{'cost': CAST(5 AS BIGINT), 'audit': 'I', 'said': chr(10) || 'user:'}} AS s2,
            {{'cost': CAST(10 AS BIGINT), 'audit': 'II', 'said': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3
        FROM counted
        UNION ALL
        SELECT conv_id, place, s0, s1, s2, {_sql_insert("assistant", ("s2",), "s3")} FROM (
            SELECT conv_id, place, s0, s1, {_sql_insert("user", ("s0", "s1", "s3"), "s2")} AS s2, s3 FROM (
                SELECT j.conv_id, j.place, {_sql_edit("s0", "2", "D")} AS s0, {_sql_row("s", "", ("s0",), "s1")} AS s1,
                    {_sql_row("u", "user", ("s0", "s1", "s3"), "s2")} AS s2, {_sql_row("a", "assistant", ("s2",), "s3")} AS s3
                FROM steps t JOIN judged j ON j.conv_id IS NOT DISTINCT FROM t.conv_id AND j.place = t.place + 1))
    ), solved AS (
        SELECT c.*, list_min([s0, s3]) AS best FROM steps s JOIN counted c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND s.place = c.last
    )
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
        sha256(coalesce(best.said[2:], '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired = conversation_repair.repair(damaged(turns))
    whole = repaired.summary.join(said_digests(repaired.segments), "key", "left").drop("key").withColumnRenamed("conv_id", "known_id")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = turns.select("conv_id").distinct().join(whole, F.col("conv_id").eqNullSafe(F.col("known_id")), "left")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


@query(
    "op13_spelling_variants",
    f"""
    WITH RECURSIVE crc_table AS {_CRC_TABLE}, runs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_CAPITALS}', '{_SMALL}'), '[a-zÀ-ÿ]+')) AS run FROM documents
    ), per AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL
    ), hashed AS (
        SELECT run, times, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run", "crc")} AS h FROM per, crc_table
    ), cut AS (
        SELECT times, CASE WHEN h % 199 = 0 THEN run[1:CAST(h % length(run) AS BIGINT)] || run[CAST(h % length(run) AS BIGINT) + 2:] ELSE run END AS word
        FROM hashed
    ), words AS (
        SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
    ), holes AS (
        SELECT word, n, k, word[1:k - 1] || word[k + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
    ), pairs AS (
        SELECT a.word, b.word AS near FROM holes a JOIN holes b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
        UNION SELECT a.word, b.word FROM holes a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word FROM holes a JOIN words b ON a.rest = b.word
    ), best AS (
        SELECT p.word, count(*) AS n_near, min({{'minus': -w.n, 'near': p.near}}) AS b FROM pairs p JOIN words w ON w.word = p.near GROUP BY p.word
    ), judged AS (
        SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.b.minus >= 5 * w.n THEN b.b.near END AS form,
            CASE WHEN -b.b.minus >= 5 * w.n THEN -b.b.minus END AS form_n
        FROM words w LEFT JOIN best b ON w.word = b.word
    ), chain AS (
        SELECT word, word AS root, 0 AS hops FROM judged
        UNION ALL SELECT c.word, j.form, hops + 1 FROM chain c JOIN judged j ON j.word = c.root WHERE j.form IS NOT NULL
    )
    SELECT j.word, form, r.root, n, n_near, form_n
    FROM judged j JOIN (SELECT word, max_by(root, hops) AS root FROM chain GROUP BY word) r ON r.word = j.word
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    said = docs.select("id", F.explode(spelling_variants.runs("text")).alias("run"))
    h, size = F.crc32(F.concat("id", F.lit(":"), "run")), F.length("run")
    hole = (h % size).cast("int")
    without = F.concat(F.substring("run", F.lit(1), hole), F.substring("run", hole + 2, size))
    words = said.select(F.when(h % 199 == 0, without).otherwise(F.col("run")).alias("word"))
    return spelling_variants.group_variants(spelling_variants.count_words(words))
