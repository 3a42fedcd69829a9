"""The append logs as streams: turns, feedback, resumed work, arriving shards.

State and progress live in the checkpoint of each query, so a restarted query goes on
where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions import constants as K
from ..functions.text import question_title, strip
from ..operators.conversations import accepted_turns


def turn_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    raw = spark.readStream.schema(schemas.TURNS).option("maxFilesPerTrigger", max_files).json(folder)
    return accepted_turns(raw)


def live_index(turns: DataFrame) -> DataFrame:
    """Conversation index over a turn stream: one small state row per conversation."""
    named = turns.withColumn("_t", F.struct("ts", question_title("q").alias("title")))
    return named.groupBy(F.col("conversation_id").alias("id")).agg(
        F.min("_t")["title"].alias("title"), F.max("ts").alias("updated_ts")
    )


def feedback_rows(feedback: DataFrame) -> DataFrame:
    """Valid feedback with at most twenty sources; ratings outside -1..1 are refused."""
    data = F.col("data")
    return feedback.filter(data["rating"].between(-1, 1) & (strip(data["message_id"]) != "")).select(
        data["message_id"].alias("message_id"),
        data["rating"].alias("rating"),
        F.slice(F.coalesce(data["sources"], F.array().cast("array<string>")), 1, K.SOURCES_CAP).alias("sources"),
        "timestamp",
    )


def feedback_counts(feedback: DataFrame) -> DataFrame:
    return feedback_rows(feedback).groupBy("rating").agg(F.count("*").alias("n"))


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a log, each row once, taking what is there and stopping."""
    return (
        rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).outputMode("append").start()
    )


def new_units(units: DataFrame, at: str | None = None, within: str = "7 days") -> DataFrame:
    """Units seen for the first time, across restarts.

    With the time column ``at``, ids are forgotten once they are older than ``within``, so the state stays bounded.
    """
    if at is None:
        return units.dropDuplicates(["unit_id"])
    return units.withWatermark(at, within).dropDuplicatesWithinWatermark(["unit_id"])


def shard_sink(chunks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Arriving chunk rows go to the table of ``latest_shards``, batch by batch.

    Rows of a book and ``version`` (0 where there is none) add up over batches. A batch writes folders of its own, so
    one that runs again after a failure replaces what it wrote.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = batch if "version" in batch.columns else batch.withColumn("version", F.lit(0).cast("bigint"))
        out = rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("book", "version", "batch").parquet(path)

    return (
        chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_shards(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a table of ``shard_sink``: of every book those of its highest version."""
    rows = spark.read.parquet(path).withColumn("book", F.col("book").cast("string"))
    last = rows.groupBy("book").agg(F.max("version").alias("version"))
    return rows.join(last, ["book", "version"]).drop("batch")
