"""Session settings the operators rely on, and lineage cutting."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A hot key must not be pinned to one task because an earlier join or group
# already hash-partitioned by a prefix of the wanted keys; the third setting
# makes Spark reshuffle on the full key set, and AQE may split skewed joins
# even when that costs a further exchange. Rows that carry sample arrays are
# wide, so few of them make an Arrow batch. The file sources prune by filters,
# which Spark hands them only where the last setting is on.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench."""
    return configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("archlens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate())


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Where none is set, a local session (tests, bench) gets a temporary folder of
    its own; on a cluster that would be a different disk on every machine, so
    there it is an error.
    """
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession) -> str:
    """A new folder name below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/archlens-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application has written below the shared folder; call it when results are read."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(
        f"{shared_dir(spark).rstrip('/')}/archlens-{spark.sparkContext.applicationId}-*")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(pattern) or []:
        files.delete(found.getPath(), True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder, and read back.

    Later steps reread it instead of recomputing, and a lost executor costs a
    reread. Computed once, unlike a checkpoint, which runs its last stage twice.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
