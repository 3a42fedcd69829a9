import random
import re

import numpy as np
import pytest

from corpusloom.llm import sketchjoin, spotsigs
from llm_samples import edge_texts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def varied(seed, n):
    """Groups of near copies of many sizes around the threshold, chains of them, shared passages, short texts."""
    r = random.Random(seed)
    out = edge_texts()
    passage = words(77, 60)
    for g in range(n):
        base = words(1000 * seed + g, r.choice([4, 5, 7, 8, 11, 20, 33, 60, 130, 260])).split(" ")
        for _ in range(r.randint(1, 6)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                own[r.randrange(len(own))] = f"w{r.randrange(10**6)}"
            if r.random() < 0.3:
                own = own[: r.randint(1, len(own))]
            out.append(" ".join(own))
            base = own if r.random() < 0.4 and len(own) > 3 else base
        if r.random() < 0.5:
            out.append(passage + " " + words(5000 + g, r.choice([10, 30, 80])))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(docs, seed):
    texts = varied(seed, 90)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in sketchjoin.near_duplicates(docs(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)


def test_small_groups_and_blocks(docs, monkeypatch):
    monkeypatch.setattr(sketchjoin, "GROUP", 3)
    monkeypatch.setattr(sketchjoin, "KEYS_SENT", 2)
    monkeypatch.setattr(sketchjoin, "MORE", 2)
    monkeypatch.setattr(sketchjoin, "AT_ONCE", 7)
    texts = varied(3, 40)
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in sketchjoin.near_duplicates(docs(texts)).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)


def test_parts_name_sets_by_their_whole_hash(docs):
    frame = docs(varied(4, 20))
    hashes = {x.h for x in sketchjoin.described(frame).where("n > 0").collect()}
    named = {x.s for x in sketchjoin.shared_parts(sketchjoin.part_entries(frame, 7)).collect()}
    assert len(named) > 20 and named <= hashes


def one_group(docs, texts, blocks=1):
    """All texts' sets as one group of sets that share a part, each its own component."""
    F = sketchjoin.F
    sets = sketchjoin.described(docs(texts)).where("n > 0").dropDuplicates(["h"])
    return sets.select(F.lit(1).cast("long").alias("k"), "h", F.col("n").cast("long").alias("n"), F.col("h").alias("root"), F.col("h").alias("now"), "bits", F.lit(blocks).alias("blocks"), F.array(F.xxhash64(F.lit(1).cast("long"))).alias("marks"))


@pytest.mark.parametrize("blocks", [1, 3])
def test_unrelated_long_sets_of_one_group_are_told_apart(docs, blocks):
    texts = [" ".join(f"w{(i * 7919 + k * 104729) % 999983}" for k in range(1100 + 13 * (i % 40))) for i in range(200)]
    group = one_group(docs, texts, blocks)
    assert group.count() == 200 and group.agg(sketchjoin.F.min("n")).first()[0] > 1000
    assert sketchjoin._offers(group, 0, 1).collect() == []


@pytest.mark.parametrize("blocks", [1, 4])
def test_each_set_offers_its_nearest_first_and_all_in_the_end(docs, blocks):
    r = random.Random(8)
    base = words(9, 400).split(" ")
    texts = []
    for _ in range(40):
        own = list(base)
        for _ in range(r.randint(0, 12)):
            own[r.randrange(len(own))] = f"w{r.randrange(10**6)}"
        texts.append(" ".join(own[: r.choice([400, 400, 360, 250, 90])]))
    group = one_group(docs, texts, blocks)
    sets = {s for s in map(shingles, texts)}
    similar = sum(100 * len(a & b) >= 75 * len(a | b) for a in sets for b in sets if a is not b) // 2
    low, high, seen = 0, 1, set()
    while True:
        found = sketchjoin._offers(group, low, high).collect()
        pairs = {(x.a, x.b) for x in found if x.a is not None}
        assert len(pairs) <= len(sets) * (high - low) * blocks
        seen |= pairs
        if all(x.a is not None for x in found):
            break
        low, high = high, high * sketchjoin.MORE + 1
    assert len(seen) >= similar > 100 and low > 0


def test_pairs_of_several_groups_come_out_of_one(docs):
    F = sketchjoin.F
    base = words(9, 300).split(" ")
    texts = [" ".join(base[:i] + [f"w{i}"] + base[i + 1 :]) for i in range(0, 300, 12)]
    one = one_group(docs, texts).drop("k", "marks")
    groups = one.crossJoin(docs([""] * 5).select(F.col("doc_id").alias("k")))
    marks = groups.groupBy("h").agg(F.array_sort(F.collect_list(F.xxhash64("k"))).alias("marks"))
    found = sketchjoin._offers(groups.join(marks, "h"), 0, 1000).collect()
    assert len(found) == len({(x.a, x.b) for x in found}) == 25 * 24 // 2
    # the marks don't tell of any common group: all groups offer the pair
    apart = groups.withColumn("marks", F.array(F.xxhash64("h", "k")))
    assert len(sketchjoin._offers(apart, 0, 1000).collect()) == 5 * 25 * 24 // 2


def test_sketches_bound_the_difference():
    r = random.Random(5)
    for n in list(range(1, 70)) + [97, 192, 193, 500]:
        inst = sketchjoin.instances(np.array([n]))
        top = n * 4 // 3
        for m in range(n, top + 1):
            d = sketchjoin.most_apart(n, m)
            # every pair of sizes that can be similar meets in an instance whose d is large enough, if they can differ
            both = [(a.number[0], a.parts[0], a.reach[0]) for a in inst if a.member[0]]
            other = [(a.number[0], a.parts[0], a.reach[0]) for a in sketchjoin.instances(np.array([m])) if a.member[0]]
            shared = [x for x in both for y in other if x[:2] == y[:2] and min(x[2], y[2]) >= d]
            assert shared or d == 0, (n, m)
    assert r


def test_no_links_and_empty(docs):
    rows = sketchjoin.near_duplicates(docs([None, "", "a b c", "d e f", "a b c"])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(0, 0, 0), (1, 0, 1), (2, 1, 2), (3, 1, 3), (4, 1, 2)]
    assert sketchjoin.near_duplicates(docs([])).count() == 0


def test_repeated_rows_and_clashing_columns(docs):
    frame = docs([words(1, 30), words(1, 30), None], [4, 4, 2]).withColumnRenamed("source", "h").withColumnRenamed("lang", "k")
    rows = sketchjoin.near_duplicates(frame).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(2, 2), (4, 4), (4, 4)]


def python_signs(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    common = set(spotsigs.ANCHORS)
    spots = [("^", 0)] * bool(w) + [(x, i + 1) for i, x in enumerate(w) if x in common]
    return {(x, tuple(y for y in w[i : i + spotsigs.REACH] if y not in common)[: spotsigs.CHAIN]) for x, i in spots}


def test_spot_signatures_equal_plain_python(docs):
    texts = ["The cat and the dog of a house", "", None, "no", words(3, 200), "und der Hund, die Katze_x", edge_texts()[-1]]
    rows = docs(texts).select("doc_id", spotsigs.signatures(spotsigs.F.col("text")).alias("s")).collect()
    for r in rows:
        assert len(r.s) == len(python_signs(texts[r.doc_id])) and r.s == sorted(set(r.s))


def test_edited_fingerprints(docs):
    import hashlib

    texts = edge_texts()
    ids = [3 * i for i in range(len(texts))]
    rows = {r.doc_id: r for r in spotsigs.edited_fingerprints(docs(texts, ids)).collect()}
    assert len(rows) == len(texts)
    for k, i in enumerate(ids):
        text, after = texts[k] or "", texts[k - 1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.next_doc_id == ids[k - 1]
        a, b, c = (set(x.split()) for x in (r.fingerprint, r.edited_fingerprint, rows[ids[k - 1]].fingerprint))
        jaccard = lambda x, y: 1.0 if x == y else len(x & y) / len(x | y)
        assert abs(r.near_edited - jaccard(a, b)) < 1e-12 and abs(r.near_next - jaccard(a, c)) < 1e-12
    assert rows[ids[5]].fingerprint == rows[ids[6]].fingerprint


def test_edited_fingerprints_of_few_and_repeated_rows(docs):
    assert spotsigs.edited_fingerprints(docs([])).count() == 0
    one = spotsigs.edited_fingerprints(docs(["the one text"])).first()
    assert one.next_doc_id == 0 and one.near_next == 1.0
    rows = spotsigs.edited_fingerprints(docs(["same the", "same the", "other of", None], [1, 1, 1, None])).collect()
    assert len(rows) == 4


def test_similar_fingerprints_equal_brute_force(spark, docs):
    r = random.Random(4)
    sets = [sorted(r.sample(range(60), r.randint(0, 12))) for _ in range(40)]
    sets += [s[: len(s) - 1] for s in sets if len(s) > 3]
    distinct = [list(s) for s in dict.fromkeys(map(tuple, sets))]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(distinct)], "fp long, signs array<int>")
    for threshold in (0.5, 0.75):
        rows = {(min(x.a, x.b), max(x.a, x.b)) for x in spotsigs.similar_fingerprints(frame, threshold).collect()}
        expected = {(i, j) for j, b in enumerate(distinct) for i, a in enumerate(distinct[:j]) if a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= threshold}
        assert rows == expected
