"""One status row per input file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.config import Config
from voxmill.sources.reviews import list_files

# Allowed endings and the first bytes of a spreadsheet.
EXTENSIONS = ("csv", "xlsx")
ZIP_MAGIC = "504B0304"


def file_manifest(spark: SparkSession, path: str, cfg: Config = Config()) -> DataFrame:
    """path, extension, size, sha256 and a status code per file.

    Oversized files are recognised from their listing alone; the reader skips their content.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    fits = files.where(F.col("length") <= cfg.max_file_bytes).select(
        "path",
        ending.alias("extension"),
        F.col("length").alias("size"),
        F.sha2("content", 256).alias("sha256"),
        F.hex(F.substring("content", 1, 4)).alias("_magic"),
        # Blank means nothing but white space, byte order mark included.
        F.regexp_replace(F.hex("content"), "^EFBBBF", "").rlike("^(?:20|09|0A|0B|0C|0D)*$").alias("_blank"),
    )
    zipped = F.col("_magic") == ZIP_MAGIC
    status = (
        F.when(~F.col("extension").isin(*EXTENSIONS), "INVALID_FILE_FORMAT")
        .when((F.col("extension") == "xlsx") & ~zipped, "INVALID_FILE_FORMAT")
        .when((F.col("extension") == "csv") & zipped, "INVALID_FILE_FORMAT")
        .when((F.col("extension") == "csv") & F.col("_blank"), "EMPTY_FILE")
        .otherwise("OK")
    )
    checked = fits.withColumn("status", status).drop("_magic", "_blank")
    too_large = files.where(F.col("length") > cfg.max_file_bytes).select(
        "path",
        ending.alias("extension"),
        F.col("length").alias("size"),
        F.lit(None).cast("string").alias("sha256"),
        F.lit("FILE_TOO_LARGE").alias("status"),
    )
    # A scan that reads contents passes over files without any byte, so those come from the listing.
    empty = list_files(spark, path).where("length = 0").select(
        "path",
        ending.alias("extension"),
        F.lit(0).cast("bigint").alias("size"),
        F.sha2(F.lit("").cast("binary"), 256).alias("sha256"),
        F.when(~F.col("extension").isin(*EXTENSIONS), "INVALID_FILE_FORMAT").otherwise("EMPTY_FILE").alias("status"),
    )
    return checked.unionByName(too_large).unionByName(empty)
