import json

import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import conversations as C
from corpusloom.sources import bundles, files, sinks, snapshots


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_transcripts_sorted_and_filtered(spark, tmp_path):
    for name in ("b talk.txt", "a+é.txt", "All_Transcripts.txt", "c.md"):
        put(tmp_path / name, name)
    rows = files.read_transcripts(spark, str(tmp_path)).orderBy("file_ord").collect()
    assert [(r.file_ord, r.file_name, r.text) for r in rows] == [(0, "a+é.txt", "a+é.txt"), (1, "b talk.txt", "b talk.txt")]


def test_line_numbers_across_blocks(spark, tmp_path):
    body = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    put(tmp_path / "f.jsonl", "\n".join(body) + "\n")
    put(tmp_path / "g.jsonl", "only\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    mine = sorted((r.line_no, r.value) for r in got if r.path.endswith("f.jsonl"))
    assert mine == [(i + 1, v) for i, v in enumerate(body)]
    assert [(r.line_no, r.value) for r in got if r.path.endswith("g.jsonl")] == [(1, "only")]


def test_chat_lines_lenient_and_fallback_id(spark, tmp_path):
    lines = [
        "", "{broken", '["list"]',
        json.dumps({"source": "s", "conversation_id": "x", "messages": [{"role": "user", "content": " hi "}, {"role": "assistant", "content": ""}]}),
        json.dumps({"messages": [{"role": "user", "content": "q"}]}),
        json.dumps({"conversation_id": "empty", "messages": []}),
    ]
    put(tmp_path / "a.chat.jsonl", "\n".join(lines))
    rows = files.read_chat_texts(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.conversation_id, r.text) for r in rows] == [
        ("x", "[source=s conversation_id=x]\n\nUSER: hi"),
        ("a.chat-line-5", "[source= conversation_id=]\n\nUSER: q"),
    ]


def test_strict_reader_fails(spark, tmp_path):
    put(tmp_path / "a.jsonl", '{"canon_id":"an1.1"}\n{oops\n')
    assert files.read_json_lines(spark, str(tmp_path), schemas.CANON_CORPUS).count() == 1
    with pytest.raises(Exception, match="no JSON at line 2 of .*a.jsonl"):
        files.read_json_lines(spark, str(tmp_path), schemas.CANON_CORPUS, strict=True).collect()


def test_record_files_order_repair_and_salvage(spark, tmp_path):
    put(tmp_path / "an10.json", json.dumps([{"sutta_id": "10.1", "sutta": "ten"}, "text", 3]))
    put(tmp_path / "an2.json", '[{"suttaid": "AN 2.1", "sutta": "two"\n "commentry": "c", },]')
    put(tmp_path / "an3.json", '[{"suttaid": "AN 3.1",\n"sutta": "say \\"x\\"",\n"commentary": "first\nsecond",\n}\n{"suttaid": "AN 3.2",\n"commentary_id": "cc",\n"commentry": open\n more\n}')
    put(tmp_path / "other.json", "[]")
    put(tmp_path / "anx.json", '{"not": "a list"}')
    rows = files.read_record_files(spark, str(tmp_path)).orderBy("file_ord", "file_name", "rec_i").collect()
    assert [(r.file_ord, r.sutta_id or r.suttaid, r.sutta, r.commentry) for r in rows] == [
        (2, "AN 2.1", "two", "c"),
        (3, "AN 3.1", 'say \\"x\\"', rows[1].commentry),
        (3, "AN 3.2", "", rows[2].commentry),
        (10, "10.1", "ten", None),
    ]
    assert rows[1].commentry.startswith('"first') and "second" in rows[1].commentry
    assert rows[2].commentry.startswith("open\nmore") and rows[2].commentary_id == "cc"


def test_export_and_agent_transcripts(spark, tmp_path):
    def resp(sender, message, at):
        return {"response": {"sender": sender, "message": message, "create_time": at}}

    export = {"conversations": [
        {"conversation": {"id": "c1", "title": "t", "create_time": "x"}, "responses": [
            resp("human", "b", "2026-04-09T07:11:35Z"), resp("ASSISTANT", "c", "2026-04-09T07:11:36Z"),
            resp("human", "a", "bad"), resp("human", "b", "2026-04-09T07:11:35Z"), resp("bot", "z", None), resp("human", " ", None)]},
        {"conversation": {"id": "c2"}, "responses": []},
        {"conversation": {"id": "c3"}},
    ]}
    put(tmp_path / "e.json", json.dumps(export))
    conv = C.from_export(files.read_export(spark, str(tmp_path / "e.json")))
    got = {r.conversation_id: [(m.role, m.content) for m in r.messages] for r in conv.collect()}
    assert got == {"c1": [("user", "a"), ("user", "b"), ("assistant", "c")], "c2": [], "c3": []}
    counts = C.conversion_counts(conv).first()
    assert (counts.total_conversations, counts.written, counts.skipped_empty) == (3, 1, 2)
    seen = sinks.write_conversations(conv, str(tmp_path / "out"))
    assert seen == {"total": 3, "written": 1, "skipped": 2}
    assert files.read_json_lines(spark, str(tmp_path / "out"), schemas.CHAT).count() == 1

    def line(role, *texts):
        return json.dumps({"role": role, "message": {"content": [{"type": "text", "text": t} for t in texts] + [{"type": "tool", "text": "no"}]}})

    put(tmp_path / "agents/u1/u1.jsonl", "\n".join([line("user", "a", " b "), line("User", "a", "b"), "x", line("tool", "n"), line("assistant", "z")]))
    msgs = C.from_agent_lines(files.read_agent_transcripts(spark, str(tmp_path / "agents")))
    rows = msgs.orderBy("turn").collect()
    assert [(r.conversation_id, r.role, r.text) for r in rows] == [("u1", "user", "a\n\nb"), ("u1", "user", "a\n\nb"), ("u1", "assistant", "z")]
    nested = C.nest_turns(msgs, "conversation_id").withColumn("messages", C.drop_repeats(F.col("messages"))).first()
    assert [(m.role, m.content) for m in nested.messages] == [("user", "a\n\nb"), ("assistant", "z")]


def chunk_rows(spark):
    return spark.createDataFrame(
        [("an1", "sutta", "AN 1.1", "cAN 1.1", "s", "one", [1.0, 0.0]), ("an2", "sutta", "AN 2.1", "cAN 2.1", "s", "two", [0.0, 1.0])],
        "book string, kind string, suttaid string, commentary_id string, source string, text string, embedding array<double>",
    )


def test_shards_round_trip_and_single_book_rebuild(spark, tmp_path):
    folder = str(tmp_path / "corpus")
    manifest = sinks.write_shards(chunk_rows(spark), folder, "m1")
    assert [(s["book"], s["chunk_count"]) for s in manifest["shards"]] == [("an1", 1), ("an2", 1)]
    back = bundles.read_manifest_rows(spark, folder + "/manifest.json")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, chunk_rows(spark).collect()))
    assert bundles.bundle_metadata(manifest)["manifest_shard_count"] == 2

    whole = str(tmp_path / "whole")
    assert sinks.write_bundle(chunk_rows(spark), whole, "m1")["shards"][0]["chunk_count"] == 2
    assert bundles.read_manifest_rows(spark, whole + "/manifest.json").count() == 2

    index = str(tmp_path / "index")
    sinks.write_index(chunk_rows(spark), index)
    sinks.write_index(chunk_rows(spark).filter("book = 'an2'").withColumn("text", F.lit("new")), index)
    assert sorted(r.text for r in files.read_vector_table(spark, index).collect()) == ["new", "one"]
    status = files.index_status(spark, {"an1": index, "an2": str(tmp_path / "none")}).orderBy("book").collect()
    assert [(r.exists, r["count"]) for r in status] == [(True, 2), (False, 0)]


def test_shard_objects_are_checked(spark, tmp_path):
    chunk = {"book": "an1", "kind": "sutta", "suttaid": "AN 1.1", "commentary_id": "", "source": "s", "text": "t", "embedding": [1, 0]}

    def setup(name, shard, fmt="vector_manifest_v1"):
        put(tmp_path / name / "s.json", json.dumps(shard))
        put(tmp_path / name / "manifest.json", json.dumps(
            {"format": fmt, "version": 1, "embedding_model": "m", "shards": [{"book": "an1", "uri": "s.json", "chunk_count": 1}]}))
        return str(tmp_path / name / "manifest.json")

    good = {"format": "vector_shard_v1", "book": "an1", "embedding_model": "m", "chunks": [chunk]}
    assert bundles.read_manifest_rows(spark, setup("good", good)).first().text == "t"
    for i, bad in enumerate([{**good, "format": "x"}, {**good, "embedding_model": "other"}, {**good, "chunks": []}]):
        with pytest.raises(Exception):
            bundles.read_manifest_rows(spark, setup(f"bad{i}", bad)).collect()
    with pytest.raises(ValueError):
        bundles.read_manifest(spark, setup("fmt", good, fmt="nope"))


def test_load_order(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        bundles.load_first(spark, str(tmp_path))
    chunk = {"book": "an1", "text": "bundle", "embedding": [1]}
    put(tmp_path / "vector_bundle.json", json.dumps({"format": "vector_bundle_v2", "chunks": [chunk]}))
    assert bundles.load_first(spark, str(tmp_path)).first().text == "bundle"
    sinks.write_shards(chunk_rows(spark), str(tmp_path / "vector_corpus"), "m")
    assert bundles.load_first(spark, str(tmp_path)).count() == 2
    missing = str(tmp_path / "no.json")
    assert bundles.load_first(spark, "", manifest_uri=missing, bundle_uri=str(tmp_path / "vector_bundle.json")).count() == 1
    assert bundles.resolve("gs://b/x.json", "gs://b/m/") == "gs://b/x.json"
    assert bundles.resolve("x.json", bundles.parent_of("gs://b/m/manifest.json")) == "gs://b/m/x.json"


def test_snapshots(spark, tmp_path):
    put(tmp_path / "sujato/an1.1.json", json.dumps({"keys_order": ["b", "a", "x"], "translation_text": {"a": " two", "b": "one"}}))
    put(tmp_path / "sujato/an1.2.json", json.dumps({"translation_text": {"a": "p", "b": "q"}}))
    put(tmp_path / "sujato/an1.3.json", "{")
    rows = {r.canon_id: r.canon_text for r in snapshots.read_snapshots(spark, str(tmp_path)).collect()}
    assert rows == {"an1.1": "one two", "an1.2": "p q"}
    spaced = {r.canon_id: r.canon_text for r in snapshots.read_snapshots(spark, str(tmp_path), " ").collect()}
    assert spaced["an1.1"] == "one two"
    known = snapshots.read_snapshots(spark, str(tmp_path))
    wanted = spark.createDataFrame([("an1.1",), ("an9.9",), ("",), ("an9.9",)], "canon_id string")
    assert snapshots.fetch_missing(wanted, known).count() == 2
    more = snapshots.fetch_missing(wanted, known, lambda i: f"text of {i}").collect()
    assert sorted(r.canon_id for r in more) == ["an1.1", "an1.2", "an9.9"]
    raw = spark.createDataFrame([("Su jato", "AN1/1", ["a"], {"a": "x"})], "author string, canon_id string, keys_order array<string>, translation_text map<string,string>")
    sinks.write_snapshots(raw, str(tmp_path / "snap"))
    assert spark.read.json(str(tmp_path / "snap")).first().canon_id == "an1_1"


def test_small_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "é")], "a int, b string")
    assert sinks.export_pretty(df, str(tmp_path / "o.json")) == 1
    assert json.loads((tmp_path / "o.json").read_text(encoding="utf-8")) == [{"a": 1, "b": "é"}]
    assert sinks.export_pretty(spark.range(3), str(tmp_path / "p.json")) == 3
    assert json.loads((tmp_path / "p.json").read_text()) == [{"id": 0}, {"id": 1}, {"id": 2}]
    assert sinks.export_pretty(spark.range(0), str(tmp_path / "q.json")) == 0 and (tmp_path / "q.json").read_text() == "[]\n"
    sinks.write_tsv(df, str(tmp_path / "t"))
    sinks.append_json(df, str(tmp_path / "log"))
    sinks.append_json(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.write_lines(df.select(F.col("b").alias("line")), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).first().value == "é"


def test_index_and_turn_logs(spark, tmp_path):
    cid = "11111111-1111-4111-8111-111111111111"
    put(tmp_path / f"{cid}.jsonl", '{"ts": 5, "q": "Q", "a": "A", "latency_ms": 1}\nbad\n')
    put(tmp_path / "index.json", json.dumps([{"id": cid, "title": "New chat", "updated_ts": 1}, "x", {"id": cid, "title": "Topic X", "updated_ts": 9}]))
    turns = files.read_turns(spark, str(tmp_path))
    index = files.read_index(spark, str(tmp_path / "index.json"))
    out = C.compact_index(index, turns).collect()
    assert [(r.id, r.title, r.updated_ts) for r in out] == [(cid, "Topic X", 9)]
    listed = C.list_conversations(index).collect()
    assert [(r.title, r.updated_ts) for r in listed] == [("Topic X", 9)]
    saved = sinks.write_conversation_index(C.compact_index(index, turns), str(tmp_path / "idx"), 2)
    assert spark.read.json(saved).first().title == "Topic X"
    assert C.conversation_messages(turns, cid.upper()).count() == 1
    assert C.new_conversation(spark, " ").first().title == "New chat"
    with pytest.raises(ValueError):
        C.conversation_messages(turns, "../etc")


def test_overlapping_patterns_name_a_file_once(spark, tmp_path):
    put(tmp_path / "a b.chat.jsonl", "1\n2\n3")
    put(tmp_path / "sub/c.jsonl", "4\n5")
    paths = [str(tmp_path / "*.jsonl"), str(tmp_path / "*.chat.jsonl"), str(tmp_path / "sub/*.jsonl"), str(tmp_path / "*/c.jsonl")]
    rows = files.numbered_lines(spark, paths).collect()
    assert sorted((r.value, r.line_no) for r in rows) == [("1", 1), ("2", 2), ("3", 3), ("4", 1), ("5", 2)]


def test_equal_names_in_two_folders(spark, tmp_path):
    put(tmp_path / "x/t.txt", "one")
    put(tmp_path / "y/t.txt", "two")
    rows = files.read_transcripts(spark, str(tmp_path / "*")).collect()
    assert sorted((r.file_ord, r.file_name, r.text) for r in rows) == [(0, "t.txt", "one"), (1, "t.txt", "two")]


def test_segments_round_trip(spark, tmp_path):
    ddl = "transcript_id string, canon_id string"
    rows = [("b.json", i, f"t{i}", None if i % 2 else f"an1.{i}") for i in range(12)] + [("a.json", 0, "x", "y")]
    df = spark.createDataFrame(rows, "json_file string, segment_index int, " + ddl)
    sinks.write_segments(df.orderBy(F.desc("segment_index")), str(tmp_path / "s"))
    back = files.read_json_arrays(spark, str(tmp_path / "s/*"), ddl)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_shards_evaluate_their_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for part in rows:
            seen.add(len(part))
            yield part

    counted = chunk_rows(spark).mapInPandas(count, chunk_rows(spark).schema)
    assert [s["chunk_count"] for s in sinks.write_shards(counted, str(tmp_path / "a"), "m")["shards"]] == [1, 1] and seen.value == 2
    assert sinks.write_bundle(counted, str(tmp_path / "b"), "m")["shards"][0]["chunk_count"] == 2 and seen.value == 4
