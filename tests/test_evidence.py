"""The text a class is explained by."""
from pyspark.sql import functions as F

from archlens.functions import scalar as s


def test_evidence_prints_the_exact_value(spark):
    """Decimals that end in half a unit: the double lies below, above or on the half."""
    values = [1.0635625, 1.1386375, 2.0 ** -7, 3 * 2.0 ** -7, 0.0000005, 0.3000005, 0.2500015, 0.0, 12.5]
    rows = spark.createDataFrame([(v, f"{v:.6f}") for v in values], "x double, t string")
    assert rows.where(s.six_places(F.col("x")) != F.col("t")).collect() == []
    said = rows.where("x >= 0.25").select("t", s.class_evidence(F.lit("h264"), F.col("x")).alias("e")).collect()
    assert [r.e for r in said] == [f"normalized_ob {r.t} >= high_min 0.25" for r in said]
