import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import arrays, bundles, files, sinks

DDL = "a string, b string, c int, d array<struct<x:int,y:string>>"
ODD = ['plain', 'comma, and "quote"', "back\\slash", "brackets ]}[{,", '\\"', "line\nbreak", "é,日本", "", '","', "\\\\", "{\"a\":1,"]


def objects(seed, n):
    r = random.Random(seed)
    return [{"a": r.choice(ODD), "b": r.choice(ODD) * r.randint(1, 5), "c": i, "d": [{"x": k, "y": r.choice(ODD)} for k in range(r.randint(0, 3))]} for i in range(n)]


@pytest.fixture
def folder(tmp_path):
    r = random.Random(1)
    put = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8")
    put("compact.json", json.dumps(objects(1, 300), ensure_ascii=False, separators=(",", ":")))
    put("pretty file.json", json.dumps(objects(2, 60), indent=2))
    put("bom.json", "﻿" + json.dumps(objects(9, 5)))
    put("mixed.json", json.dumps([1, {"a": "x"}, None, "s,t", [{"a": "in, side"}], {"b": "y"}, True]))
    put("empty.json", "[]")
    put("blank.json", " \n ")
    put("nothing.json", "")
    put("one.json", '[ {"a": "only"} ] \n')
    put("lines.json", "\n".join(json.dumps(o) for o in objects(3, 40)) + "\n\n")
    put("lines with junk.json", '{"a": "1"}\nno json,\n\n{"a": "2"}\n')
    put("object.json", json.dumps({"a": "1", "c": 3}))
    put("object lines.json", json.dumps({"a": "1", "c": 3}, indent=1))
    put("trailing comma.json", '[{"a": "1"},\n{"a": "2"},\n]')
    put("open string.json", '[{"a": "1"},\n{"a": "2}\n]')
    put("open.json", '[{"a": "1"},\n{"a": "2"}\n')
    put("two.json", '[{"a": "1"}]\n[{"a": "2"}]')
    put("behind.json", '[{"a": "1"}] x')
    put("other.txt", '[{"a": "no"}]')
    put("many.json", "[" + ",".join(json.dumps(o, indent=r.choice([None, 1])) for o in objects(5, 200)) + "]")
    return tmp_path


def by_place(frame):
    return sorted((str(r.json_file), r.segment_index, json.dumps(r.asDict(recursive=True), sort_keys=True)) for r in frame.collect())


@pytest.mark.parametrize("size", ["128m", "500"])
def test_equals_the_reader_of_whole_files(spark, folder, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = arrays.read_array_files(spark, str(folder), DDL)
        want = files.read_json_arrays(spark, str(folder), DDL)
        assert by_place(got.where("json_file <> 'bom.json'")) == by_place(want)
        assert got.where("json_file = 'bom.json'").count() == 5
        if size == "500":
            # one file is read by many tasks
            ranges = arrays._pieces(spark, str(folder / "compact.json"), "*").select("block").distinct().count()
            assert ranges > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_the_text_of_one_file_never_meets_in_one_task(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(objects(6, 400)))
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        rows = arrays.read_array_files(spark, str(tmp_path), DDL)
        counts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == 400 and max(counts) < 200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("before", [True, False])
def test_bundle_object(spark, tmp_path, before):
    r = random.Random(3)
    rows = [{"book": f"an{i % 3}", "kind": "sutta", "suttaid": f"{i}", "text": r.choice(ODD), "embedding": [1.0, i / 7]} for i in range(50)]
    chunks = spark.createDataFrame(rows, "book string, kind string, suttaid string, text string, embedding array<double>").repartition(6)
    path = str(tmp_path / "bundle.json")
    assert sinks.write_bundle_object(chunks, path, 'mo"del') == 50
    data = json.loads((tmp_path / "bundle.json").read_text(encoding="utf-8"))
    assert data["embedding_model"] == 'mo"del' and len(data["chunks"]) == 50
    meta = {"format": "f", "tags": ["a,b", "c"], "chunks": data["chunks"]} if before else {"chunks": data["chunks"], "info": {"k": [1, [2]]}, "z": "chunks"}
    (tmp_path / "other.json").write_text(json.dumps(meta, indent=None if before else 2), encoding="utf-8")
    for name in ("bundle.json", "other.json"):
        place = str(tmp_path / name)
        assert sorted(map(str, arrays.read_bundle_object(spark, place).collect())) == sorted(map(str, bundles.read_bundle(spark, place).collect()))
    (tmp_path / "none.json").write_text('{"format": "f", "chunks": []}')
    with pytest.raises(ValueError):
        arrays.read_bundle_object(spark, str(tmp_path / "none.json"))
    assert [p.name for p in tmp_path.iterdir() if "_parts" in p.name] == []


@pytest.mark.parametrize("n", [0, 1, 25])
def test_export_is_one_pretty_array(spark, tmp_path, n):
    rows = objects(4, n)
    frame = spark.createDataFrame(rows, DDL) if rows else spark.createDataFrame([], DDL)
    assert sinks.export_pretty(frame.repartition(4, "c"), str(tmp_path / "all.json")) == n
    text = (tmp_path / "all.json").read_text(encoding="utf-8")
    found = json.loads(text)
    assert sorted(found, key=lambda o: o["c"]) == rows
    assert text == (json.dumps(found, ensure_ascii=False, indent=2) + "\n" if n else "[]\n")


def test_merged_books_keep_their_text(spark, tmp_path):
    from corpusloom.operators.subtitles import merge_by_book

    rows = spark.createDataFrame([("BOOK 01 - a.txt", "Text one, \nline"), ("AN 1 b.txt", "two"), ("c.txt", "three")], "file_name string, text string")
    pieces = merge_by_book(rows)
    want: dict = {}
    for r in pieces.orderBy("book", "ord", "file_name").collect():
        want[r.book] = want.get(r.book, "") + r.text
    sinks.write_merged_books(pieces, str(tmp_path / "m"))
    found = {int(p.name.split("=")[1]): "".join(f.read_text() for f in sorted(p.glob("part-*"))) for p in (tmp_path / "m").glob("book=*")}
    assert found == want and len(found) == 11
