"""Stored order of a theme's reviews, so that a page far behind costs what the first one does.

For every theme with at least ``from_rows`` reviews, and for each of its labels with as many, a row's place in each of the sort orders is
stored in buckets of consecutive places. As many buckets as make up ``FILE_ROWS`` places share a file, sorted by place, so that the number
of files stays small when buckets are. A page opens the one or two files that hold its places, and then takes the reviews with these
row numbers. Smaller themes need no index: their pages are a plain top-k.

Places are counted by ranges: rows are dealt by ranges of the order and written in order with their place in the range, and ranges are
counted. No task sorts a whole theme, and no row is dealt or sorted a second time to be numbered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.operators.analytics import MAX_PAGE, VERBATIM_SORTS, verbatim_order
from voxmill.operators.scale import PAGE_DIRECT, materialised

BUCKET = 10_000
FILE_ROWS = 1 << 17
ALL = "all"
KEYS = ["job_id", "theme_id", "label"]


def file_places(bucket: int) -> int:
    """Places in one file of the index: whole buckets."""
    return max(1, FILE_ROWS // bucket) * bucket


def label_name(label: str | None) -> str:
    """The folder of a label."""
    return ALL if label is None else label.replace(" ", "_")


def rank_index(reviews: DataFrame, partials: DataFrame, sort: str, from_rows: int = PAGE_DIRECT, bucket: int = BUCKET) -> DataFrame:
    """``job_id, theme_id, label, sort, bucket, rank, row`` of the large themes; ranks count from 0."""
    name = F.regexp_replace("sentiment_label", " ", "_")
    sizes = partials.where(F.col("theme_id").isNotNull())
    by_label = sizes.groupBy("job_id", "theme_id", name.alias("label")).agg(F.sum("reviews").alias("n"))
    whole = sizes.groupBy("job_id", "theme_id").agg(F.sum("reviews").alias("n")).select("job_id", "theme_id", F.lit(ALL).alias("label"), "n")
    # A few rows for each theme; partials are no larger either.
    large = by_label.unionByName(whole).where((F.col("n") >= from_rows) & F.col("label").isNotNull()).select(*KEYS)
    rows = reviews.select("job_id", "theme_id", F.explode(F.array(F.lit(ALL), name)).alias("label"), "row", "sentiment_score", "date")
    chosen = rows.join(F.broadcast(large), KEYS)
    order = verbatim_order(sort)
    # Rows of a range are written in order with their place among all rows of their task, so that they are dealt and sorted once.
    dealt = chosen.repartitionByRange(*KEYS, *order).sortWithinPartitions(*KEYS, *order)
    place = F.monotonically_increasing_id()
    placed = dealt.select(*KEYS, "row", F.spark_partition_id().alias("part"), place.alias("place"))
    ranged = materialised(placed, "ranged-reviews")
    # A row for each theme and range.
    counts = ranged.groupBy(*KEYS, "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.partitionBy(*KEYS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*KEYS, "part", "first", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = ranged.join(F.broadcast(counts), [*KEYS, "part"]).withColumn("rank", F.col("before") + F.col("place") - F.col("first"))
    return ranked.select(*KEYS, F.lit(sort).alias("sort"), F.floor(F.col("rank") / F.lit(bucket)).cast("long").alias("bucket"), "rank", "row")


def write_index(
    reviews: DataFrame, partials: DataFrame, path: str, from_rows: int = PAGE_DIRECT, bucket: int = BUCKET, sorts: Sequence[str] = VERBATIM_SORTS
) -> None:
    """Store the index of these runs; ``file_places`` consecutive places are one file."""
    enough = partials.where(F.col("theme_id").isNotNull()).groupBy("job_id", "theme_id").agg(F.sum("reviews").alias("n")).where(F.col("n") >= from_rows)
    if not enough.limit(1).count():
        return
    folders = ["job_id", "theme_id", "label", "sort", "part"]
    part = F.floor(F.col("rank") / F.lit(file_places(bucket))).cast("long")
    for sort in sorts:
        index = rank_index(reviews, partials, sort, from_rows, bucket).withColumn("part", part).drop("bucket")
        index.repartition(*folders).sortWithinPartitions(*folders, "rank").write.mode("append").partitionBy(*folders).parquet(path)


def page_rows(
    spark: SparkSession, path: str, job_id: str, theme_id: str, sort: str, offset: int, limit: int, label: str | None = None, bucket: int = BUCKET
) -> DataFrame | None:
    """``rank, row`` of a page from the files of its places alone, or None if the theme has no index. A page past the end is empty."""
    base = f"{path}/job_id={job_id}/theme_id={theme_id}/label={label_name(label)}/sort={sort}"
    found, places = None, file_places(bucket)
    for part in range(offset // places, (offset + limit - 1) // places + 1):
        try:
            one = spark.read.schema("rank long, row long").parquet(f"{base}/part={part}")
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in (exc.getCondition() or ""):
                raise
            continue
        found = one if found is None else found.unionByName(one)
    if found is None:
        try:
            spark.read.schema("rank long, row long").parquet(f"{base}/part=0")
        except AnalysisException:
            return None
        return spark.createDataFrame([], "rank long, row long")
    return found.where(F.col("rank").between(offset, offset + limit - 1))


def indexed_page(reviews: DataFrame, places: DataFrame) -> DataFrame:
    """The reviews at these places (at most a page of them), in their order."""
    ranks = {r["row"]: r["rank"] for r in places.limit(MAX_PAGE).collect()}
    # Row numbers go into the scan's filter, which skips the row groups without them.
    rows = reviews.where(F.col("row").isin(list(ranks)))
    if ranks:
        rows = rows.orderBy(F.element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), F.col("row")))
    return rows.withColumn("id", F.concat(F.lit("v"), F.col("row")))
