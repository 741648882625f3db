"""Review files: dialect, column roles, required columns."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from io import StringIO
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.config import Config
from voxmill.errors import InvalidFile, MissingColumn
from voxmill.operators.scale import scan_rows

# Header aliases per role, separators that are looked for, missing-value texts of CSV files.
TEXT_ALIASES = ("review_text", "review", "text", "content", "comment", "feedback", "body")
DATE_ALIASES = ("date", "created_at", "timestamp", "review_date")
RATING_ALIASES = ("rating", "stars", "score")
SEPARATORS = ",;\t"
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
SAMPLE_BYTES = 16_384


def list_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``path, length`` of the files a path, folder or glob stands for.

    The scan lists files and opens none; it passes over those without any byte, which come from the scan's own file list.
    """
    scan = spark.read.format("binaryFile").load(path).select("path", "length")
    names = spark.createDataFrame([(_plain(unquote(f)),) for f in scan.inputFiles()], "path string")
    sized = scan.withColumn("path", F.regexp_replace("path", "^([^:/]+):/+", "$1:/"))
    return names.join(sized, "path", "left").select("path", F.coalesce("length", F.lit(0)).cast("bigint").alias("length"))


def _plain(uri: str) -> str:
    return re.sub(r"^([^:/]+):/+", r"\1:/", uri)


def sniff_dialect(sample: bytes, complete: bool) -> tuple[str, str]:
    """(encoding, separator) of a CSV sample. A character cut off at the end of the sample is left out."""
    encoding, text = "ISO-8859-1", None
    for cut in range(1 if complete else 4):
        try:
            text = sample[: len(sample) - cut].decode("utf-8-sig")
            encoding = "UTF-8"
            break
        except UnicodeDecodeError:
            continue
    if text is None:
        text = sample.decode("latin-1")
    if not text.strip():
        raise InvalidFile("EMPTY_FILE", "the file is empty")
    try:
        return encoding, csv.Sniffer().sniff(text, delimiters=SEPARATORS).delimiter
    except csv.Error:
        return encoding, ","


def map_columns(df: DataFrame) -> dict[str, str | None]:
    """Canonical role to header; the first matching header wins, case and outer spaces do not matter."""
    roles = {"review_text": TEXT_ALIASES, "date": DATE_ALIASES, "rating": RATING_ALIASES}
    found: dict[str, str | None] = dict.fromkeys(roles)
    for header in df.columns:
        name = header.strip().lower()
        for role, aliases in roles.items():
            if found[role] is None and name in aliases:
                found[role] = header
                break
    return found


def require_columns(df: DataFrame, require_date: bool = True) -> dict[str, str | None]:
    mapping = map_columns(df)
    missing = [r for r in ("review_text", "date") if mapping[r] is None and (r == "review_text" or require_date)]
    if missing:
        raise MissingColumn("required columns are missing", missing=missing, found=list(df.columns))
    return mapping


def canonical(df: DataFrame, cfg: Config = Config(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw text columns under their canonical names; a missing optional role is a null column."""
    mapping = require_columns(df, cfg.require_date)
    roles = [
        (F.col(f"`{header}`") if header else F.lit(None)).cast("string").alias(role) for role, header in mapping.items()
    ]
    return df.select(*keep, *roles)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each file and split: its first bytes, and whether all of its lines are UTF-8."""
    seen: dict[tuple[str, int], list] = {}
    for batch in batches:
        paths, starts, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
        for path, start, line in zip(paths, starts, lines, strict=True):
            state = seen.setdefault((path, start), [b"", True])
            data = line.as_py() or b""
            if start == 0 and len(state[0]) < SAMPLE_BYTES:
                state[0] += data + b"\n"
            try:
                data.decode()
            except UnicodeDecodeError:
                state[1] = False
    rows = [(p, s, head, ok) for (p, s), (head, ok) in seen.items()]
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.bool_())
    columns = zip(*rows, strict=True) if rows else ([],) * 4
    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "start", "head", "utf8"])


def _dialects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, head, utf8 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            encoding, sep, header, status = None, None, None, "OK"
            try:
                encoding, sep = sniff_dialect(head, complete=True)
                text = head.decode("utf-8-sig" if encoding == "UTF-8" else "latin-1")
                header = next(csv.reader(StringIO(text), delimiter=sep), None)
                if encoding == "UTF-8" and not utf8:
                    status = "UNREADABLE_FILE"
                elif not header:
                    status = "EMPTY_FILE"
            except InvalidFile as exc:
                status = exc.code
            except csv.Error:
                status = "UNREADABLE_FILE"
            rows.append((path, encoding, sep, header, status))
        kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
        columns = zip(*rows, strict=True) if rows else ([],) * 5
        names = ["path", "encoding", "separator", "header", "status"]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def file_dialects(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``path, encoding, separator, header, status`` of every CSV file, each judged by itself.

    Separator, header and encoding come from the file's own first lines; then every line has to decode. A file that starts as
    UTF-8 and goes on otherwise is UNREADABLE_FILE. One pass over the files, split like any other scan.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line")
    )
    heads = lines.mapInArrow(_heads, "path string, start long, head binary, utf8 boolean")
    files = heads.groupBy("path").agg(F.min_by("head", "start").alias("head"), F.bool_and("utf8").alias("utf8"))
    return files.mapInArrow(_dialects, "path string, encoding string, separator string, header array<string>, status string")


def _csv_groups(spark: SparkSession, path: str | Sequence[str], multi_line: bool, on_bad: str) -> list[DataFrame]:
    """One scan for each set of files that share separator, encoding and header."""
    try:
        found = sorted(file_dialects(spark, path).collect(), key=lambda r: r["path"])
    except AnalysisException as exc:
        raise InvalidFile("FILE_NOT_FOUND", f"no file at {path}") from exc
    bad = {r["path"]: r["status"] for r in found if r["status"] != "OK"}
    if bad and on_bad == "raise" or found and len(bad) == len(found):
        raise InvalidFile(next(iter(bad.values())), "files cannot be read", files=bad)
    groups: dict[tuple, list[str]] = {}
    for r in found:
        if r["status"] == "OK":
            groups.setdefault((r["encoding"], r["separator"], tuple(r["header"])), []).append(r["path"])
    if not groups:
        raise InvalidFile("EMPTY_FILE", f"no readable file at {path}")
    return [
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("inferSchema", False)
        .csv(files)
        for (encoding, sep, _), files in groups.items()
    ]


def read_reviews(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "csv",
    cfg: Config = Config(),
    multi_line: bool = True,
    na_values: tuple[str, ...] = NA_VALUES,
    on_bad: str = "raise",
) -> DataFrame:
    """Raw reviews as text columns ``review_text``, ``date``, ``rating`` plus their position ``source_row``.

    CSV files of one folder may differ in separator, encoding and columns: files that agree are one scan with
    their own header, and the scans are united by role. Unreadable files raise, or are left out with ``on_bad="skip"``
    (``file_dialects`` names them). Quoted line breaks need ``multi_line``, which makes every CSV file one task;
    very large files without such texts are split when it is off.
    """
    if fmt == "csv":
        parts = [canonical(raw, cfg) for raw in _csv_groups(spark, path, multi_line, on_bad)]
        parts = [p.select(*[F.when(~F.col(c).isin(*na_values), F.col(c)).alias(c) for c in p.columns]) for p in parts]
    else:
        raw = spark.read.json(path) if fmt == "json" else spark.read.format(fmt).load(path)
        parts = [canonical(raw, cfg)]
    named = parts[0]
    for part in parts[1:]:
        named = named.unionByName(part)
    return scan_rows(named, "source_row").select("source_row", "review_text", "date", "rating")
