import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import packing, pii, positional, pst, toolcalls
from llm_samples import edge_texts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return [*WORD.findall((text or "").translate(LOW)), "\n"]


def plain_tree(train):
    """The tree by plain counting: log10 of a byte's probability after the bytes before it."""
    counts = [defaultdict(Counter) for _ in range(pst.DEPTH + 1)]
    data = [("\n" * pst.DEPTH + "".join(w + " " for w in t[:-1]) + "\n").encode() for t in train]
    for d in data:
        for i in range(pst.DEPTH, len(d)):
            for n in range(pst.DEPTH + 1):
                counts[n][d[i - n : i]][d[i]] += 1
    pairs = sum(counts[0][b""].values())
    kept: set = set()

    def p(context, byte):
        if not context:
            return (counts[0][b""][byte] + 1) / (pairs + 256)
        own = counts[len(context)].get(context, Counter())
        return (own[byte] + pst.PRIOR * p(context[1:], byte)) / (sum(own.values()) + pst.PRIOR)

    for n in range(pst.DEPTH, 1, -1):
        for context, own in counts[n].items():
            total = sum(own.values())
            gain = sum(c * math.log(c / total / p(context[1:], b)) for b, c in own.items())
            if gain >= pst.DIVERGENCE:
                kept.update(context[-k:] for k in range(2, n + 1))

    def score(before, byte):
        n = 1
        while n < pst.DEPTH and before[-n - 1 :] in kept:
            n += 1
        return math.log10(p(before[-n:], byte))

    return score


def test_scores_equal_plain_counting(docs):
    texts = [t for t in edge_texts() if t is None or len(t) < 1500] + [words(s, 25) for s in range(40)]
    rows = {r.doc_id: r for r in pst.scores(docs(texts)).collect()}
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    all_ = [tokens(t) for t in texts]
    train = [t for t, h in zip(all_, held) if not h]
    count = Counter(w for t in train for w in t)
    n, v, once = sum(count.values()), len(count), sum(c == 1 for c in count.values())
    new = min(0.5, max(once, 0.5) / n)
    tree = plain_tree(train)
    for i, t in enumerate(all_):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(count[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
        before, total = b"\n" * pst.DEPTH, 0.0
        for w in t:
            spelt = 0.0
            for byte in w.encode() + (b" " if w != "\n" else b""):
                spelt += tree(before[-pst.DEPTH :], byte)
                before += bytes([byte])
            total += math.log10((1 - new) * ((1 - pst.TREE) * count[w] / n + pst.TREE * 10**spelt)) if count[w] else math.log10(new)
        assert r.score == pytest.approx(total, rel=1e-5)


def test_held_out_texts_are_likelier_than_by_words(docs):
    rows = pst.scores(docs([words(s, 60) + f" thing{s} and onthing{s * 7}" for s in range(300)])).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_scores_of_nothing_and_odd_rows(docs):
    assert pst.scores(docs([])).count() == 0
    rows = pst.scores(docs([None, "a", "a"], [None, 5, 5])).collect()
    assert len(rows) == 3 and all(r.train_tokens == 5 for r in rows)


SCHEMAS = [("f", "x", "integer", True, 0.0, 9.0), ("f", "s", "string", False, None, 3.0), ("g", "o", "object", True, None, None), ("g", "a", "array", False, None, None)]


@pytest.fixture
def link(spark):
    def run(calls, results, schemas=SCHEMAS):
        return toolcalls.link(
            spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, depends array<string>"),
            spark.createDataFrame(results, "call_id string, content string"),
            spark.createDataFrame(schemas, "name string, field string, kind string, required boolean, low double, high double"),
        )

    return run


def test_linking_orders_validates_and_serialises(link):
    calls = [
        (1, 3, "c", "f", '{"s": "abcd", "x": 12}', ["b", "b", "zz"]),
        (1, 2, "b", "f", '{ "x" : 5,\n"s":"é\\n\\"" }', ["a"]),
        (1, 9, "a", "g", '{"o": {"z": 1, "b": [1.5, null, true]}, "a": [], "q": 0}', None),
        (1, 4, "d", "f", '{"x": "5"}', []),
        (1, 5, "e", "h", "{}", []),
        (1, 6, "g", "f", "{broken", []),
        (2, 0, "l1", "f", '{"x": null}', ["l2"]),
        (2, 1, "l2", "g", "[1]", ["l1"]),
        (2, 2, "d", "f", '{"x": 1}', []),
        (2, 3, None, "f", '{"x": 1}', []),
        (None, None, "n", None, None, None),
    ]
    rows = {r.call_id: r for r in link(calls, [("a", "two"), ("a", "one"), ("c", ""), ("no", "x"), (None, "y"), ("b", None)]).collect()}
    assert sorted(rows) == ["a", "b", "c", "d", "e", "g", "l1", "l2", "n"]
    assert [rows[c].level for c in ("a", "b", "c", "d", "l1", "l2")] == [0, 1, 2, 0, None, None]
    assert [c for c, _ in sorted(((c, rows[c].place) for c in ("a", "b", "c", "d", "e", "g")), key=lambda x: x[1])] == ["d", "e", "g", "a", "b", "c"]
    assert rows["c"].errors == ["range of s", "range of x"] and rows["b"].errors == [] and rows["a"].errors == ["unknown q"]
    assert rows["d"].errors == ["kind of x"] and rows["e"].errors == ["no such tool"] and rows["g"].errors == ["no object"]
    assert rows["l1"].errors == ["missing x"] and rows["n"].errors == ["no object"]
    assert rows["a"].linked and rows["b"].linked and not rows["d"].linked
    assert json.loads(rows["a"].line) == {"arguments": {"a": [], "o": {"b": [1.5, None, True], "z": 1}, "q": 0}, "call_id": "a", "depends": [], "name": "g", "result": "one"}
    assert rows["b"].line == '{"arguments":{"s":"é\\n\\"","x":5},"call_id":"b","depends":["a"],"name":"f"}'
    assert json.loads(rows["g"].line)["arguments"] == "{broken"


def test_a_long_conversation_is_numbered_over_blocks(link, monkeypatch):
    monkeypatch.setattr(toolcalls, "BLOCK", 3)
    calls = [(1, t, f"c{t}", "f", '{"x": 1}', [f"c{t // 2}"] if t else []) for t in range(40)]
    rows = sorted(link(calls, []).collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(40))
    keys = [(r.level, r.turn) for r in rows]
    assert keys == sorted(keys)
    assert link([], []).count() == 0


def test_pipeline_stages_equal_brute_force(spark, docs, tmp_path):
    r = random.Random(9)
    item = words(500, 40)
    texts = [words(s, r.randint(30, 90)) for s in range(120)]
    texts += [texts[3], texts[4] + " tail", item + " " + words(600, 10), words(700, 20) + " a.b@c.example.org end", None, ""]
    toxic = [int(i % 5 == 1) for i in range(120)]
    texts = [t + " grumbus vileword" if i < 120 and toxic[i] else t for i, t in enumerate(texts)]
    frame = docs(texts)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, str(tmp_path))
        assert out.columns == frame.columns
        given = spark.createDataFrame(out.collect(), frame.schema)
        kept.append({x.doc_id: x.text for x in given.collect()})
    expected = {i for i in range(len(texts)) if i >= 120 or not toxic[i]}
    assert set(kept[0]) == expected
    assert set(kept[1]) == expected - {120, 121}
    assert set(kept[2]) == expected - {120, 121, 122}
    assert kept[3][123].endswith("[EMAIL] end") and {i: t for i, t in kept[3].items() if i != 123} == {i: t for i, t in kept[2].items() if i != 123}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == set(kept[3])
    assert sum(x.length for x in packed) == sum(x.doc_tokens for x in {x.doc_id: x for x in packed}.values())
    assert (positional, pii, packing, np) and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_drops_rows_not_ids(spark, docs, tmp_path):
    item = words(500, 40)
    texts = [words(1, 60), words(1, 60), words(2, 60), words(3, 60), words(3, 60), words(3, 60), words(4, 60), item, words(5, 60), None, None, words(6, 60)]
    ids = [1, 2, 2, None, None, None, 5, 5, 5, None, None, None]
    frame = docs(texts, ids).withColumn("lang", F.when(F.col("text") == texts[0], F.concat("lang", F.col("doc_id").cast("string"))).otherwise(F.col("lang")))
    frame = frame.unionByName(docs([words(6, 60) + " end", words(4, 60)], [9, 5]))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.drop_near_duplicates(spark, frame, str(tmp_path))
    assert out.columns == frame.columns
    kept = [(1, texts[0]), (2, texts[2]), (None, texts[3]), (5, texts[6]), (5, item), (5, texts[8]), (None, None), (None, None), (9, texts[11] + " end")]
    assert sorted(map(str, kept)) == sorted(str((x.doc_id, x.text)) for x in out.collect())
    out = corpus_pipeline.drop_contaminated(spark, frame, str(tmp_path)).collect()
    assert len(out) == 13 and item not in {x.text for x in out}
