"""Per-frame metric text and tool logs as rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

METRIC = r"psnr_avg:([\d.]+)"


def metric_values(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines that carry a PSNR average, with its value; other lines drop out."""
    found = F.regexp_extract(text, METRIC, 1)
    return lines.where(found != "").withColumn("psnr", found.try_cast("double")).drop(text)


def read_metric_lines(spark: SparkSession, path: str) -> DataFrame:
    return metric_values(spark.read.text(path).withColumn("source", F.input_file_name()))
