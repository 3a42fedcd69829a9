import random

import numpy as np
import pytest

from corpusloom.operators import vectorindex as X

SCHEMA = "pos long, embedding array<float>"


def some(spark, n=700, size=12, seed=1, clusters=9):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, size)) * 3
    rows = [(i, (centres[i % clusters] + r.normal(size=size)).astype("float32").tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0, 2.0]), (n + 3, [0.0] * size), (n + 4, rows[3][1]), (n + 5, [None] * size), (n + 6, [float("nan")] * size)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def brute(rows, vector, n, metric, size):
    out = []
    for pos, v in rows:
        if v is None or len(v) != size or any(x is None or np.isnan(x) for x in v) or metric == "cosine" and not any(v):
            continue
        a, b = np.array(v, "float64"), np.array(vector, "float64")
        d = ((a - b) ** 2).sum() if metric == "l2" else 1 - a @ b / np.sqrt((a @ a) * (b @ b))
        out.append((round(d, 9), pos))
    return [p for _, p in sorted(out)[:n]]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_all_lists_give_the_exact_result(spark, monkeypatch, metric):
    monkeypatch.setattr(X, "TILE", 30)
    monkeypatch.setattr(X, "BLOCK", 3)
    rows, vectors = some(spark)
    index = X.build(vectors, 8, metric)
    asked = [(i, rows[i][1]) for i in range(0, 200, 20)] + [(1000, [1.0] * 12), (1001, [1.0]), (1002, None)]
    queries = spark.createDataFrame(asked, "qid long, vector array<float>")
    found = {}
    for r in X.search(index, queries, 15).orderBy("qid", "rank").collect():
        found.setdefault(r.qid, []).append(r.pos)
    assert found == {q: brute(rows, v, 15, metric, 12) for q, v in asked if v and len(v) == 12}
    # far fewer vectors than there are were read whole, and far lists not at all
    read = X.candidates(index, queries, 15).count()
    assert read < 0.2 * len(rows) * len(found)
    assert X.probed(index, queries, 15).count() < 8 * len(found)


def test_more_than_there_are(spark):
    rows, vectors = some(spark, n=30)
    index = X.build(vectors, 3)
    queries = spark.createDataFrame([(0, rows[0][1])], "qid long, vector array<float>")
    assert [r.pos for r in X.search(index, queries, 500).orderBy("rank").collect()] == brute(rows, rows[0][1], 500, "l2", 12)


def test_few_lists_keep_most_of_clustered_vectors_and_read_their_folders_only(spark):
    rows, vectors = some(spark, clusters=12, seed=4)
    index = X.build(vectors, 12)
    r = random.Random(2)
    asked = [(i, rows[i][1]) for i in r.sample(range(600), 25)]
    queries = spark.createDataFrame(asked, "qid long, vector array<float>")
    found = {}
    for x in X.search(index, queries, 10, probes=3).collect():
        found.setdefault(x.qid, set()).add(x.pos)
    recall = [len(found[q] & set(brute(rows, v, 10, "l2", 12))) / 10 for q, v in asked]
    assert sum(recall) / len(recall) >= 0.9
    one = spark.createDataFrame(asked[:1], "qid long, vector array<float>")
    wanted = {x.list for x in X.probed(index, one, 10, 2).collect()}
    plan = index.tiles.where(X.F.col("list").isin(list(wanted)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1]


def test_wrong_arguments(spark):
    _, vectors = some(spark, n=20)
    with pytest.raises(ValueError):
        X.build(vectors, 4, "dot")
    with pytest.raises(ValueError):
        X.build(vectors.limit(0), 4)
    with pytest.raises(ValueError):
        X.build(vectors, 1 << 24)
