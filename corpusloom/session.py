"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that matter for correctness (time zone) or for memory safety with
#: long texts (Arrow batches bounded by bytes, not only by rows).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    # The rule adds a size test of every exploded array below the explode. Here those
    # arrays are built from whole texts in the same stage, so the test would build
    # each of them a second time, and again for every step it is pushed through.
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the runtime options that a session created elsewhere leaves open; what it has set itself stays."""
    own = spark._jsparkSession.sessionState().conf()
    for key, value in SETTINGS.items():
        if not own.contains(key):
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
