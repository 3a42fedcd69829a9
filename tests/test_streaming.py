import json

from corpusloom import schemas
from corpusloom.streaming import logs

CID = "11111111-1111-4111-8111-111111111111"


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")


def drain(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_live_index(spark, tmp_path):
    write(tmp_path / "in/a.json", [
        {"conversation_id": CID.upper(), "ts": 5, "q": "second", "a": "x"},
        {"conversation_id": CID, "ts": 2, "q": " first  question ", "a": "x"},
        {"conversation_id": CID, "ts": 9, "q": "ignored", "a": "(no answer)"},
        {"conversation_id": "bad", "ts": 9, "q": "ignored", "a": "x"},
    ])
    got = drain(spark, logs.live_index(logs.turn_stream(spark, str(tmp_path / "in"))), "live", "complete").collect()
    assert [(r.id, r.title, r.updated_ts) for r in got] == [(CID, "first question", 5)]


def test_append_resumes_without_repeats(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    write(tmp_path / "in/a.json", [{"conversation_id": CID, "ts": 1, "q": "q", "a": "a"}])
    logs.append_stream(logs.turn_stream(spark, source), out, check).awaitTermination(120)
    write(tmp_path / "in/b.json", [{"conversation_id": CID, "ts": 2, "q": "q", "a": "a"}])
    logs.append_stream(logs.turn_stream(spark, source), out, check).awaitTermination(120)
    assert sorted(r.ts for r in spark.read.json(out).collect()) == [1, 2]


def test_feedback_and_units(spark, tmp_path):
    write(tmp_path / "f/a.json", [
        {"data": {"message_id": "m", "rating": 1, "sources": ["s"] * 30}, "timestamp": 1},
        {"data": {"message_id": "m", "rating": 5}, "timestamp": 1},
        {"data": {"message_id": "n", "rating": 1}, "timestamp": 2},
    ])
    raw = spark.readStream.schema(schemas.FEEDBACK).json(str(tmp_path / "f"))
    got = drain(spark, logs.feedback_counts(raw), "fb", "complete").collect()
    assert [(r.rating, r.n) for r in got] == [(1, 2)]
    batch = spark.read.schema(schemas.FEEDBACK).json(str(tmp_path / "f"))
    assert max(len(r.sources) for r in logs.feedback_rows(batch).collect()) == 20
    write(tmp_path / "u/a.json", [{"unit_id": "1#a"}, {"unit_id": "1#a"}, {"unit_id": "1#b"}])
    units = spark.readStream.schema("unit_id string").json(str(tmp_path / "u"))
    assert drain(spark, logs.new_units(units), "un", "append").count() == 2


def test_shards_add_up_and_a_new_version_replaces_its_book(spark, tmp_path):
    write(tmp_path / "c/a.json", [{"book": "an1", "version": 1, "text": "one"}, {"book": "an2", "version": 1, "text": "two"}])
    path, check = str(tmp_path / "index"), str(tmp_path / "check")

    def run():
        logs.shard_sink(spark.readStream.schema("book string, version bigint, text string").json(str(tmp_path / "c")), path, check).awaitTermination(120)
        return sorted((r.book, r.text) for r in logs.latest_shards(spark, path).collect())

    run()
    write(tmp_path / "c/b.json", [{"book": "an1", "version": 1, "text": "more"}])
    assert run() == [("an1", "more"), ("an1", "one"), ("an2", "two")]
    write(tmp_path / "c/d.json", [{"book": "an1", "version": 2, "text": "new"}])
    assert run() == [("an1", "new"), ("an2", "two")]


def test_old_units_are_forgotten(spark, tmp_path):
    write(tmp_path / "u/a.json", [{"unit_id": "1#a", "at": "2024-01-01T00:00:00"}, {"unit_id": "1#a", "at": "2024-01-02T00:00:00"}])
    units = spark.readStream.schema("unit_id string, at timestamp").json(str(tmp_path / "u"))
    assert drain(spark, logs.new_units(units, "at"), "old", "append").count() == 1
