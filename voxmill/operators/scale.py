"""Building blocks that keep wide operators safe on skewed and very large tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is sent to every executor only when it has at most this many rows ...
SMALL_ROWS = 10_000
# ... and a key with more than this part of all rows is cut into pieces of that size.
HOT_PIECES = 1024
# Compressed input that one task of a costly step reads at the most.
TASK_BYTES = 1 << 24
# An estimate beyond this is Spark's stand-in for a size it does not know, as that of rows from the driver.
UNKNOWN_BYTES = 1 << 50
# Width of the row-number buckets of ``dense_rows``: the most rows one window group can hold.
ROW_BUCKET = 1 << 14
PAGE_DIRECT = 10_000
QUANTILE_DIRECT = 1_000_000
_QUANTILE_BUCKETS = 1024


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="voxmill-checkpoint-"))
    return sc.getCheckpointDir()


_scope: ContextVar[str | None] = ContextVar("scratch_scope", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables: inside the current scope, or else in the application's own folder."""
    inside = _scope.get() or f"voxmill-{spark.sparkContext.applicationId}"
    return f"{checkpoint_root(spark).rstrip('/')}/{inside}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are deleted at the end, whether it succeeds or fails.

    Only for work whose results are written (or small and collected) before the scope ends.
    """
    inside = f"scope-{uuid.uuid4().hex}"
    token = _scope.set(inside)
    try:
        yield
    finally:
        _scope.reset(token)
        _delete(spark, f"{checkpoint_root(spark).rstrip('/')}/{inside}")


def drop_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables that this application has written outside of scopes. Tables read from them are lost."""
    _delete(spark, f"{checkpoint_root(spark).rstrip('/')}/voxmill-{spark.sparkContext.applicationId}")


def materialised(df: DataFrame, name: str = "table", partition_by: Sequence[str] = ()) -> DataFrame:
    """Cut the lineage with a table written to the shared checkpoint folder.

    Unlike ``checkpoint()`` the plan runs once, later readers take only the columns and partitions they
    need, and lost executors cost nothing that was already written.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan; for a plain scan this is the size of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Deal rows out to at least four tasks for each core, and to so many that none reads more than ``task_bytes`` of compressed input.

    A split of a scan can hold a hundred times the rows that a task should work on, and a file's row groups are not cut at all. Only a
    scan with as many splits as that is left alone.
    """
    spark = df.sparkSession
    size = input_bytes(df)
    size = 0 if size > UNKNOWN_BYTES else size
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-size // task_bytes))
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728b")
    )
    return df if size >= tasks * split else df.repartition(tasks)


def small_table(df: DataFrame, max_rows: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Materialise a table that has at most ``max_rows`` rows; returns it and whether it was small.

    At most ``max_rows + 1`` rows ever reach the driver. A larger table comes back unchanged, and the
    caller joins it by shuffling.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def hot_keys(df: DataFrame, key: str) -> dict:
    """Keys with more than one in ``HOT_PIECES`` of the rows, and into how many pieces of about that size each is to be cut.

    One exact, map-side combined count with a top-k; there are fewer than ``HOT_PIECES`` such keys whatever the size.
    """
    return hottest(df.where(F.col(key).isNotNull()).groupBy(key).count(), key)


def hottest(counts: DataFrame, key: str) -> dict:
    """``hot_keys`` from the ``count`` of every key."""
    seen = Observation()
    counts = counts.observe(seen, F.sum("count").alias("rows"))
    top = counts.orderBy(F.desc("count"), F.asc(key)).limit(HOT_PIECES).collect()
    total = seen.get["rows"] or 0
    return {r[0]: -(-r[1] * HOT_PIECES // total) for r in top if r[1] * HOT_PIECES > total}


def lookup_join(
    big: DataFrame, unique: DataFrame, key: str, salt_from: str, how: str = "left", small_rows: int = SMALL_ROWS
) -> DataFrame:
    """Join rows to a table that has one row per ``key``.

    A small table is broadcast. Otherwise the rows of hot keys are spread over salts and only the hot
    rows of ``unique`` are repeated, so no task gets a whole hot key.
    """
    side, small = small_table(unique, small_rows)
    if small:
        return big.join(F.broadcast(side), key, how)
    return salted_join(big, unique, key, salt_from, how)


def salted_join(big: DataFrame, unique: DataFrame, key: str, salt_from: str, how: str = "left", hot: dict | None = None) -> DataFrame:
    """Join to a table with one row per ``key``; hot keys are cut into pieces by their own counts, so no task gets more than a piece.

    ``hot`` are the ``hot_keys`` of ``big`` where the caller knows them.
    """
    kind = big.schema[key].dataType
    fields = T.StructType([T.StructField(key, kind), T.StructField("_pieces", T.LongType())])
    cut = F.broadcast(big.sparkSession.createDataFrame(list((hot_keys(big, key) if hot is None else hot).items()), fields))  # fewer rows than HOT_PIECES
    # Rows without a key match nothing but would all go to one task, so they are spread as well.
    pieces = F.when(F.col(key).isNull(), F.lit(HOT_PIECES)).otherwise(F.coalesce("_pieces", F.lit(1)))
    left = big.join(cut, key, "left").withColumn("_salt", F.pmod(F.xxhash64(salt_from), pieces)).drop("_pieces")
    right = unique.join(cut, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1)) - 1)))
    return left.join(right.drop("_pieces"), [key, "_salt"], how).drop("_salt")


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "_rank") -> DataFrame:
    """First ``n`` rows per group.

    The rank filter right above the window lets Spark keep only ``n`` rows per group and input
    partition before the shuffle, so even a group with a third of all rows sends few rows.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def dense_rows(df: DataFrame, id_col: str, out: str = "row", width: int = ROW_BUCKET) -> DataFrame:
    """Dense 0-based numbering in the order of a unique whole-number id, without a global window.

    Ids fall into fixed-width buckets (at most ``width`` rows each); the bucket counts are summed up to
    offsets and rows are numbered inside their bucket. The id alone decides the bucket, so a recomputed
    task gives the same numbers.
    """
    bucketed = df.withColumn("_bucket", F.floor(F.col(id_col) / F.lit(width)).cast("long"))
    # Written once: both levels below read it, and the rows themselves are counted a single time.
    counts = materialised(bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")), "buckets")
    # Second level: offsets are summed inside groups of buckets first, so this window stays small as well.
    counts = counts.withColumn("_super", F.floor(F.col("_bucket") / F.lit(4096)).cast("long"))
    supers = counts.groupBy("_super").agg(F.sum("_n").alias("_sn"))
    before = Window.orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select("_super", F.coalesce(F.sum("_sn").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_super").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("_offset", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(supers, "_super")
        .select("_bucket", (F.col("_base") + F.col("_offset")).alias("_offset"))
    )
    numbered = Window.partitionBy("_bucket").orderBy(id_col)
    return (
        bucketed.withColumn("_i", F.row_number().over(numbered))
        .join(offsets, "_bucket")
        .withColumn(out, (F.col("_offset") + F.col("_i") - 1).cast("long"))
        .drop("_bucket", "_i", "_offset")
    )


def scan_rows(df: DataFrame, out: str = "source_row") -> DataFrame:
    """Dense 0-based position of every row of a file scan, without moving any row.

    Only for plans without a shuffle, whose partitions and row order are fixed by the files. Each split is
    counted once and its rows get the number of rows in the splits before it. The offsets have one row of 16 bytes per
    split, 16 MB for a million splits, and always go to the rows; texts are never shuffled.
    """
    marked = df.withColumn("_mono", F.monotonically_increasing_id())
    marked = marked.withColumn("_split", F.shiftright("_mono", 33))
    counts = marked.groupBy("_split").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = marked.join(F.broadcast(offsets), "_split")
    local = F.col("_mono") - F.shiftleft("_split", 33)
    return joined.withColumn(out, (F.col("_offset") + local).cast("long")).drop("_mono", "_split", "_offset")


def sorted_slice(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a total order.

    Shallow pages are a plain top-k. For deep pages the rows are range-partitioned once, whole partitions
    before the page are skipped by their counts, and the search goes on inside the rest.
    """
    if limit <= 0:
        return df.limit(0)
    if offset + limit <= PAGE_DIRECT:
        return df.orderBy(*order).offset(offset).limit(limit)
    ranged = materialised(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "sorted")
    counts = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    before, parts, start = 0, [], None
    for part in sorted(counts):
        upto = before + counts[part]
        if upto > offset and before < offset + limit:
            parts.append(part)
            start = before if start is None else start
        before = upto
    if not parts:
        return df.limit(0)
    if sum(counts[p] for p in parts) == sum(counts.values()):
        return df.orderBy(*order).offset(offset).limit(limit)
    rest = ranged.where(F.col("_part").isin(parts)).drop("_part")
    return sorted_slice(rest, order, offset - start, limit)


def exact_quantiles(
    df: DataFrame, column: str, probs: Sequence[float], direct: int = QUANTILE_DIRECT
) -> list[float]:
    """Exact, linearly interpolated quantiles.

    Up to ``direct`` values one built-in aggregate does it. Beyond that the wanted ranks are narrowed down
    by repeated counting into buckets: every round is one map-side combined count, and the driver sees
    only bucket counts.
    """
    values = df.select(F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    n, low, high = values.agg(F.count("_v"), F.min("_v"), F.max("_v")).first()
    if not n:
        return []
    if n <= direct:
        return list(values.agg(F.percentile("_v", [float(p) for p in probs])).first()[0])
    positions = [p * (n - 1) for p in probs]
    found: dict[int, float] = {}
    # (low, high, rows before, wanted ranks)
    open_ranges = [(low, high, 0, sorted({int(p) for p in positions} | {min(int(p) + 1, n - 1) for p in positions}))]
    while open_ranges:
        for lo, _, _, ranks in [r for r in open_ranges if r[0] == r[1]]:
            found.update(dict.fromkeys(ranks, lo))
        open_ranges = [r for r in open_ranges if r[0] != r[1]]
        if not open_ranges:
            break
        which = F.coalesce(
            *[F.when(F.col("_v").between(lo, hi), F.lit(i)) for i, (lo, hi, _, _) in enumerate(open_ranges)]
        )
        lows = F.array(*[F.lit(float(r[0])) for r in open_ranges])
        widths = F.array(*[F.lit(float(r[1]) - float(r[0])) for r in open_ranges])
        share = (F.col("_v") - F.get(lows, F.col("_i"))) / F.get(widths, F.col("_i"))
        buckets = (
            values.withColumn("_i", which)
            .where(F.col("_i").isNotNull())
            .groupBy("_i", F.floor(share * F.lit(_QUANTILE_BUCKETS)).alias("_b"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
            .collect()
        )
        narrowed = []
        for i, (_, _, before, ranks) in enumerate(open_ranges):
            seen = before
            for b in sorted((b for b in buckets if b["_i"] == i), key=lambda b: b["_b"]):
                inside = [r for r in ranks if seen <= r < seen + b["n"]]
                if inside:
                    narrowed.append((b["lo"], b["hi"], seen, inside))
                seen += b["n"]
        if narrowed == open_ranges:
            raise ValueError(f"{column} holds values that cannot be bucketed (infinite or NaN)")
        open_ranges = narrowed
    out = []
    for p in positions:
        a, b = found[int(p)], found[min(int(p) + 1, n - 1)]
        out.append(a + (b - a) * (p - int(p)))
    return out
