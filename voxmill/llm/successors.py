"""Each document beside the next one in descending order of ids, without a window over all rows. Spark expressions only.

Keys alone are put in order: they are dealt by ranges of the id and written, each range learns the next key inside, and the last key of
a range takes the first one of the next range (one row a range). Then texts are dealt by key once, and of the next text
only as many characters move as are asked for.

Rows equal in id and text are one document in this order, and all of them have the same next one. Rows that share an id only
follow each other by the MD5 of the text. Null ids come last. The last document is followed by the first, a single one by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.operators.scale import materialised


def _key(id_col: str, text_col: str) -> Column:
    name = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat(name, F.lit("\n"), F.col(text_col)).cast("binary")))


def next_keys(keys: DataFrame) -> DataFrame:
    """``key, id, n, next_key`` for a table ``id, key, n`` of different keys."""
    descending = [F.col("id").desc_nulls_last(), F.col("key").desc()]
    ranged = materialised(keys.repartitionByRange(*descending).withColumn("part", F.spark_partition_id()), "ordered-keys")
    # One row for each range, that is for each partition of the shuffle above.
    firsts = ranged.groupBy("part").agg(F.max(F.struct("id", "key")).alias("first"))
    by_part, all_parts = Window.orderBy("part"), Window.partitionBy()
    after = F.coalesce(F.lead("first").over(by_part), F.max("first").over(all_parts))
    borders = firsts.select("part", after["key"].alias("beyond"))
    inside = F.lead("key").over(Window.partitionBy("part").orderBy(*descending))
    return ranged.withColumn("inside", inside).join(F.broadcast(borders), "part").select("key", "id", "n", F.coalesce("inside", "beyond").alias("next_key"))


def with_next(docs: DataFrame, wanted: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, key, next_key, id, text, n, start``: ``start`` is the beginning of the next text, ``wanted(n)`` characters or all; ``row`` numbers the rows."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = texts.withColumn("key", _key("id", "text"))
    keys = texts.groupBy("key").agg(F.first("id").alias("id"), F.first(F.length("text").cast("long")).alias("n"))
    order = materialised(next_keys(keys), "next-keys")
    # Both uses below read the same columns, so that Spark deals the texts out once and reads that exchange twice.
    dealt = texts.select("key", F.monotonically_increasing_id().alias("row"), "text")
    asked = order.select(F.col("next_key").alias("key"), F.col("key").alias("for_key"), wanted(F.col("n")).alias("chars"))
    starts = dealt.join(asked, "key").select("for_key", "row", F.left("text", F.col("chars").cast("int")).alias("start"))
    starts = starts.groupBy(F.col("for_key").alias("key")).agg(F.min_by("start", "row").alias("start"))
    return dealt.join(order, "key").join(starts, "key").select("row", "key", "next_key", "id", "text", "n", "start")
