"""Session settings the operators rely on, and lineage cutting that survives executor loss."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does the broadcast choice (by measured size) and splits hot shuffle
# partitions, so no operator carries a broadcast or repartition hint of its own.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # a checkpoint goes when nothing refers to it
    "spark.sql.session.timeZone": "UTC",
    "spark.python.sql.dataFrameDebugging.enabled": "false",  # no call-site capture per column
}


def builder(app: str = "fleetscope") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    for key, value in RECOMMENDED.items():
        b = b.config(key, value)
    return b


def _shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="fleetscope-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and return it with its lineage cut."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(_shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, for streaming sinks and their offsets."""
    import uuid

    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = _shared_dir(spark)
    return f"{_scratch[app].rstrip('/')}/{name}-{uuid.uuid4().hex}"
