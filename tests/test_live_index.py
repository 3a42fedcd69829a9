import json

import pytest

from corpusloom.operators.conversations import upsert_index
from corpusloom.streaming import index as I
from corpusloom.streaming import logs

DAY = 86_400_000


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("conversation_id", "ts", "q", "a", "latency_ms"), r))) for r in rows) + "\n")


def uuid(n):
    return f"00000000-0000-4000-8000-{n:012d}"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", I.STATE_STORE)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def table(frame):
    return sorted(tuple(r) for r in frame.select("id", "title", "updated_ts").collect())


def test_stream_with_restarts_and_eviction_equals_the_batch(rocks, tmp_path):
    inbox, out, check = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "check")
    rounds = [
        [(uuid(1), 10, "first question of one", "a", 1), (uuid(2), 20, "two", "b", 1), (uuid(1), 15, "more", "c", 1)],
        [(uuid(1), 5 * DAY, "later", "d", 1), (uuid(3), 5 * DAY, "three", "e", 1)],
        # two has been idle for its two days when this comes: its state is gone, its row isn't
        [(uuid(4), 9 * DAY, "four", "f", 1)],
        [(uuid(2), 9 * DAY + 5, "two goes on", "g", 1), (uuid(5), 9 * DAY, "five", "h", 1)],
    ]
    for n, rows in enumerate(rounds):
        put(inbox, f"{n}.json", rows)
        turns = logs.turn_stream(rocks, str(inbox), max_files=1)
        query = I.index_sink(I.live_conversations(turns, idle=2 * DAY), out, check)
        assert query.awaitTermination(240)
    everything = rocks.createDataFrame([r for rows in rounds for r in rows], "conversation_id string, ts bigint, q string, a string, latency_ms bigint")
    empty = rocks.createDataFrame([], "id string, title string, updated_ts bigint")
    assert table(I.stored_index(rocks, out)) == table(upsert_index(empty, everything))
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] < 5 * 2


def test_a_repeated_or_broken_batch_changes_nothing(spark, tmp_path):
    out = str(tmp_path / "index")
    ddl = "id string, first_ts bigint, q string, updated_ts bigint"
    one = spark.createDataFrame([(uuid(1), 5, "one", 9), (uuid(2), 6, "two", 6)], ddl)
    two = spark.createDataFrame([(uuid(1), 5, "one", 20), (uuid(3), 7, "three", 7)], ddl)
    I.merge_batch(one, 0, out)
    first = table(I.stored_index(spark, out))
    I.merge_batch(one, 0, out)
    assert table(I.stored_index(spark, out)) == first and len(first) == 2
    I.merge_batch(two, 1, out)
    want = table(I.stored_index(spark, out))
    assert [r[2] for r in want] == [20, 6, 7]
    # a batch that wrote rows but no commit: readers don't see it, and it starts over
    broken = spark.createDataFrame([(uuid(1), 1, "zero", 99)], ddl)
    lost = broken.select("id", I.F.lit("half").alias("title"), "updated_ts", I._bucket().alias("bucket"), I.F.lit(2).cast("bigint").alias("version"))
    lost.write.mode("append").partitionBy("bucket", "version").parquet(f"{out}/rows")
    assert table(I.stored_index(spark, out)) == want
    I.merge_batch(two, 2, out)
    assert table(I.stored_index(spark, out)) == want
    I.merge_batch(spark.createDataFrame([], ddl), 3, out)
    assert table(I.stored_index(spark, out)) == want


def test_feedback_windows_drop_state_and_equal_the_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    hour = 3_600_000
    rounds = [[(1, 10), (1, hour - 1), (-1, 20)], [(0, 3 * hour), (1, hour + 5)], [(1, 30)], [(1, 9 * hour)]]
    found = []
    for n, rows in enumerate(rounds):
        (inbox / f"{n}.json").write_text("\n".join(json.dumps({"rating": r, "timestamp": t}) for r, t in rows))
        stream = spark.readStream.schema("rating int, timestamp bigint").json(str(inbox))
        query = (
            I.feedback_over_time(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
            .foreachBatch(lambda b, _: found.extend(tuple(r) for r in b.collect())).trigger(availableNow=True).start()
        )
        assert query.awaitTermination(120)
    # the row of the third file came after its window was final
    timely = [r for n, rows in enumerate(rounds) for r in rows if n != 2]
    batch = I.feedback_over_time(spark.createDataFrame(timely, "rating int, timestamp bigint"))
    final = [tuple(r) for r in batch.collect() if r.start < 9 * hour]
    assert sorted(found) == sorted(final)


def test_the_log_is_read_once_for_all_batches(spark, tmp_path, monkeypatch):
    from corpusloom.plans import conversations as P

    n, seen = 400, spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(uuid(i % 7), 10 * i, f"q{i}", "a", 1, i) for i in range(n)], "conversation_id string, ts bigint, q string, a string, latency_ms bigint, event_id bigint")
    monkeypatch.setattr(P, "turn_log", lambda *_: rows.mapInArrow(counted, rows.schema))
    found = table(P.live_index_batches(spark, "unused"))
    assert found == [(uuid(i), f"q{i}", max(10 * k for k in range(n) if k % 7 == i)) for i in range(7)]
    # once for the cuts, once for the batches
    assert seen.value == 2 * n
