"""The live conversation index: bounded state per conversation, merged batch by batch into versions of a stored table.

A conversation's state is one small row. A timer at its latest turn plus ``idle`` drops it once the watermark has passed
that time, so the state holds the conversations of late only. What was dropped is not lost: every change goes to the
stored index, and a conversation that goes on later is merged with its row there.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.conversations import upsert_index
from ..sources.files import path_exists

#: What a state store must be for timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "id string, first_ts bigint, q string, updated_ts bigint"
#: Parts of the stored index; a batch writes those anew that it touches.
BUCKETS = 64


class LiveConversation(StatefulProcessor):
    """First question and latest time of a conversation; forgotten ``idle`` milliseconds after its latest turn."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("conversation", "first_ts bigint, q string, updated_ts bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        first, question, latest = self.state.get() if self.state.exists() else (None, None, None)
        before = latest
        for frame in rows:
            for ts, q in zip(frame["ts"].tolist(), frame["q"].tolist()):
                if first is None or (ts, q) < (first, question):
                    first, question = int(ts), q
                latest = int(ts) if latest is None else max(latest, int(ts))
        self.state.update((first, question, latest))
        if latest != before:
            if before is not None:
                self.handle.deleteTimer(before + self.idle)
            self.handle.registerTimer(latest + self.idle)
        yield pd.DataFrame({"id": [key[0]], "first_ts": [first], "q": [question], "updated_ts": [latest]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        self.state.clear()
        yield pd.DataFrame({"id": [], "first_ts": [], "q": [], "updated_ts": []}).astype({"id": str, "first_ts": "int64", "q": str, "updated_ts": "int64"})

    def close(self) -> None:
        pass


def live_conversations(turns: DataFrame, late: str = "1 hour", idle: int = 7 * 86_400_000) -> DataFrame:
    """Changed conversations of a turn stream (conversation_id, ts in milliseconds, q): id, first_ts, q, updated_ts.

    Turns more than ``late`` behind the newest one may be left out. Needs ``STATE_STORE`` as the session's provider.
    """
    named = turns.select(F.lower("conversation_id").alias("id"), "ts", "q", F.timestamp_millis("ts").alias("at"))
    timed = named.withWatermark("at", late)
    return timed.groupBy("id").transformWithStateInPandas(LiveConversation(idle), ROW, "Update", "EventTime")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")


def _committed(spark: SparkSession, folder: str) -> int:
    """The highest batch that was written as a whole; -1 before the first."""
    if not path_exists(spark, f"{folder}/commits"):
        return -1
    last = spark.read.schema("version bigint").json(f"{folder}/commits").agg(F.max("version")).first()[0]
    return -1 if last is None else last


def stored_index(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame:
    """The stored index: of each bucket its newest version among those of whole batches (before batch ``below``)."""
    last = _committed(spark, folder)
    if below is not None:
        last = min(last, below - 1)
    kind = "id string, title string, updated_ts bigint, bucket int, version bigint"
    if last < 0:
        return spark.createDataFrame([], kind).drop("bucket", "version")
    rows = spark.read.schema(kind).parquet(f"{folder}/rows").where(F.col("version") <= last)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(newest, ["bucket", "version"]).select("id", "title", "updated_ts")


def merge_batch(changes: DataFrame, number: int, folder: str) -> None:
    """Merge a batch of changed conversations into the stored index; the same batch again changes nothing.

    Only the buckets of changed conversations are read and written. A batch starts from what earlier batches left,
    whatever it may have written before a failure, and counts once its commit is there.
    """
    spark = changes.sparkSession
    if number <= _committed(spark, folder):
        return
    changed = changes.groupBy("id").agg(F.min(F.struct("first_ts", "q")).alias("f"), F.max("updated_ts").alias("ts"))
    changed = changed.withColumn("bucket", _bucket()).persist()
    try:
        touched = [r.bucket for r in changed.select("bucket").distinct().collect()]  # BUCKETS at most
        if touched:
            known = stored_index(spark, folder, number).withColumn("bucket", _bucket()).where(F.col("bucket").isin(touched)).drop("bucket")
            turns = changed.select(F.col("id").alias("conversation_id"), "ts", F.col("f.q").alias("q"))
            merged = upsert_index(known, turns).withColumns({"bucket": _bucket(), "version": F.lit(number).cast("bigint")})
            out = merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.partitionBy("bucket", "version").parquet(f"{folder}/rows")
        spark.range(1).select(F.lit(number).cast("bigint").alias("version")).coalesce(1).write.mode("append").json(f"{folder}/commits")
    finally:
        changed.unpersist()


def index_sink(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the stored index of ``folder`` up with a stream of changed conversations."""
    return (
        changes.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, folder)).outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def feedback_over_time(feedback: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Ratings per window of event time: ``start, rating, n``; ``feedback`` has rating and timestamp (milliseconds).

    On a stream a window is final, and its state gone, once the watermark has passed its end; rows that come later than
    ``late`` after newer ones may be left out. A table of the same rows gives the same counts, late rows included.
    """
    timed = feedback.select("rating", F.timestamp_millis("timestamp").alias("at"))
    if timed.isStreaming:
        timed = timed.withWatermark("at", late)
    counted = timed.groupBy(F.window("at", window).alias("w"), "rating").agg(F.count("*").alias("n"))
    return counted.select(F.unix_millis("w.start").alias("start"), "rating", "n")
