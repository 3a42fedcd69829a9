import random

import pytest

from corpusloom.operators import substring as S


def texts(seed=1, n=400):
    r = random.Random(seed)
    out = ["".join(r.choice("abcdé ß") for _ in range(r.choice([0, 1, 2, 3, 40, 200]))) for _ in range(n)]
    out += [None, "", "ab", "abc", "ABC", "needle in the Hay", "😀😀😀x", "a" * 3000, "tab\tand\nline", "abcabc"]
    return out + out[-3:]


@pytest.mark.parametrize("case_sensitive", [False, True])
def test_equals_a_scan_of_all_rows(spark, monkeypatch, case_sensitive):
    monkeypatch.setattr(S, "SEGMENT_BITS", 4)
    own = texts()
    rows = spark.createDataFrame([(7 * i, t, "x") for i, t in enumerate(own)], "pos long, text string, kind string").repartition(3)
    index = S.build(rows, case_sensitive)
    terms = ["abc", "é ß", "needle", "NEEDLE", "😀😀", "😀😀😀", "aaaaaaaa", "zzz", "a", "", "dé", "abcd", "\tand\n", "ab ab ab ab"]
    found = {(r.pos, r.term) for r in S.find(index, terms).collect()}
    spell = (lambda t: t) if case_sensitive else str.lower
    assert found == {(7 * i, k) for i, t in enumerate(own) for k, q in enumerate(terms) if spell(q) in spell(t or "")}
    assert S.find(index, []).count() == 0


def test_rare_terms_read_few_rows(spark):
    own = [" ".join(random.Random(i).choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(i * k % 97) for k in range(30)) for i in range(1500)]
    own[700] += " quicksilver"
    index = S.build(spark.createDataFrame(list(enumerate(own)), "pos long, text string"))
    few = S.candidates(index, ["quicksilver", "ega96 al"])
    count = {r.term: r["count"] for r in few.groupBy("term").count().collect()}
    assert count[0] == 1 and count.get(1, 0) < 0.1 * len(own)
    plan = index.postings.where("bucket in (3) and tri in ('abc')")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(tri" in plan or "EqualTo(tri,abc)" in plan


def test_lists_of_many_rows_meet_in_one_row():
    """Before lists are shuffled, a trigram's rows are put together; texts longer than a turn are taken in pieces."""
    import pyarrow as pa

    own = texts(2, 40) + ["ab" * 300]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(own))), pa.array([(t or "").encode() for t in own])], ["row", "text"])
    told = [(tri, row) for part in S._partial_lists([batch], 13, 50) for tri, row in zip(part["tri"].to_pylist(), part["offsets"].to_pylist())]
    found = {(tri, row) for tri, rows in told for row in rows}
    assert found == {(t[i : i + 3], row) for row, t in enumerate(own) for i in range(len(t or "") - 2)}
    assert sum(part.num_rows for part in S._partial_lists([batch], 13, 1 << 21)) == len({tri for tri, _ in found})


def test_broken_text_is_found_by_its_sound_parts(spark):
    rows = spark.range(1).selectExpr("id as pos", "cast(concat(X'ff', cast('needle' as binary), X'c3') as string) as text")
    assert [r.term for r in S.find(S.build(rows), ["needle", "need le"]).collect()] == [0]


def test_rows_are_computed_once(spark):
    """The index numbers rows where they come, so what they are made of is not computed a second time for their order."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    rows = spark.range(200).repartition(4).select(F.col("id").alias("pos"), F.udf(count)(F.concat(F.lit("row "), F.col("id").cast("string"))).alias("text"))
    index = S.build(rows)
    assert seen.value == 200
    assert {r.pos for r in S.find(index, ["row 19"]).collect()} == {19, *range(190, 200)}


def test_lists_in_several_turns_equal_a_scan(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT_BITS", 5)
    monkeypatch.setattr(S, "CHARS", 60)
    own = texts(3, 120) + ["ab" * 200 + "needle"]
    rows = spark.createDataFrame(list(enumerate(own)), "pos long, text string").repartition(2)
    index = S.build(rows)
    assert index.postings.groupBy("tri", "segment").count().where("count > 1").count() > 0
    terms = ["abc", "aba", "b a", "needle", "babababab"]
    found = sorted((r.pos, r.term) for r in S.find(index, terms).collect())
    assert found == sorted((i, k) for i, t in enumerate(own) for k, q in enumerate(terms) if q in (t or "").lower())


def test_lists_of_texts_with_very_many_characters():
    import numpy as np

    points = np.append(np.arange(1, 0xD800), np.arange(0xE000, 0x50000)).astype(np.uint32)
    own = np.array_split(points, 100)
    parts = list(S._lists(own, list(range(100)), 13))
    told = {(tri, row) for part in parts for tri, rows in zip(part["tri"].to_pylist(), part["offsets"].to_pylist()) for row in rows}
    spelt = [t.tobytes().decode("utf-32-le") for t in own]
    assert told == {(t[i : i + 3], row) for row, t in enumerate(spelt) for i in range(len(t) - 2)}
    assert len(parts) > 1
