"""Arrow batches bounded by bytes, as texts differ in length by orders of magnitude."""
from __future__ import annotations

from pyspark.sql import DataFrame

BYTES = 4 << 20
BYTES_CONF = "spark.archlens.arrowBatchBytes"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, after its session's Arrow batches were limited to ``spark.archlens.arrowBatchBytes`` (4 MB).

    A row longer than that is a batch of its own, so a task holds about one such
    batch, or one text, on each side.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", conf.get(BYTES_CONF, str(BYTES)))
    return df
