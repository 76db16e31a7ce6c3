"""Media file listing; file contents are never read."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalar import VIDEO_EXTENSIONS, suffix


def select_media(paths: DataFrame, *, extensions: list[str] = VIDEO_EXTENSIONS, root: str = "",
                 dir_regex: str | None = None) -> DataFrame:
    """Paths with a media extension; optionally only first-level folders that match in full.

    ``order_key`` is the lower-cased path, the listing order.
    """
    kept = paths.where(F.lower(suffix(F.col("path"))).isin(*extensions))
    if dir_regex:
        rest = F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 2 if root else 1), F.length("path"))
        kept = kept.where(rest.contains("/") & F.substring_index(rest, "/", 1).rlike(f"^(?:{dir_regex})$"))
    return kept.withColumn("order_key", F.lower("path"))


def list_media(spark: SparkSession, root: str, *, extensions: list[str] = VIDEO_EXTENSIONS,
               dir_regex: str | None = None) -> DataFrame:
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "length", "modificationTime"))
    return select_media(files, extensions=extensions, root=root, dir_regex=dir_regex).orderBy("order_key")
