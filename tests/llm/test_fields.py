import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np

from corpusloom.llm import pii, toxicity
from corpusloom.llm.common import free_name, row_key, without, word_hash
from corpusloom.llm.crf import Crf, batches, padded
from llm_samples import edge_texts, words


def all_paths(crf, e):
    for y in itertools.product(range(e.shape[1]), repeat=len(e)):
        path = [0, *y, 0]
        yield y, sum(crf.move[a, b] for a, b in zip(path, path[1:])) + sum(e[i, c] for i, c in enumerate(y))


def test_inference_equals_enumeration():
    rng = np.random.default_rng(0)
    crf = Crf(rng.normal(size=(4, 3)), rng.normal(size=(3, 3)))
    e, lengths = rng.normal(size=(5, 4, 3)), np.array([1, 2, 3, 4, 4])
    p, moves, z = crf.marginals(e, lengths)
    best = crf.viterbi(e, lengths)
    for i, n in enumerate(lengths):
        paths = list(all_paths(crf, e[i, :n]))
        total = sum(np.exp(s) for _, s in paths)
        assert abs(np.log(total) - z[i]) < 1e-9
        assert tuple(best[i, :n]) == max(paths, key=lambda x: x[1])[0] and not best[i, n:].any()
        for t in range(n):
            for c in range(3):
                assert abs(p[i, t, c] - sum(np.exp(s) for y, s in paths if y[t] == c) / total) < 1e-9
        pairs = sum(np.exp(s) * sum(a == 1 and b == 2 for a, b in zip([0, *y], [*y, 0])) for y, s in paths) / total
        assert abs(moves[i, 1, 2] - pairs) < 1e-9


def test_batches_cover_all():
    lengths = np.random.default_rng(1).integers(1, 50, 200)
    got = list(batches(lengths, 256))
    assert sorted(np.concatenate(got)) == list(range(200))
    assert all(len(b) * lengths[b].max() <= 256 or len(b) == 1 for b in got)
    assert padded(np.arange(6), np.array([0, 4]), np.array([3, 2])).tolist() == [[0, 1, 2], [4, 5, -1]]


def plain_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), m.end(), 0))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), m.end(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_patterns_equal_plain_search():
    r = random.Random(6)
    parts = ["a.b", "@", "x@y.z", ".", "..", "10.0.0.1", "256.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (415) 555-2671", "+", " ", "é", "-", "0", "9", "@@", "a@b", "com", "_", "%", "1.2.3", "00000000255.1.1.1"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        assert pii.base_spans(text) == plain_base(text), text


def test_base_patterns_equal_plain_search_on_any_characters():
    r = random.Random(8)
    for alphabet in ("0129.", "01 -4", "+0( )-.9", "a@.0_", "0.@+- a9é"):
        for _ in range(3000):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert pii.base_spans(text) == plain_base(text), text


def test_luhn_and_shapes_equal_the_plain_rules():
    r = random.Random(9)
    for _ in range(500):
        d = [r.randrange(10) for _ in range(r.randint(1, 30))]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1]))
        assert pii.luhn("".join(map(str, d))) == (total % 10 == 0)
        word = "".join(r.choice("aAbÉß0123.@-二") for _ in range(r.randint(0, 90)))
        out = []
        for c in word:
            s = "9" if c in "0123456789" else ("A" if c.isupper() else "a") if c.isalpha() else c
            if not (s in "Aa" and out[-1:] == [s] or s == "9" and out[-5:] == ["9"] * 5):
                out.append(s)
        assert pii.shape(word) == "".join(out)


def test_very_long_texts_take_linear_time():
    field, n = pii.Tagger.train(), 1_000_000
    texts = ["7" * n, "7." * (n // 2), "1.2." * (n // 4), "+" * n, "+1(" * (n // 3), "a" * n + "@" + "b" * n, "@" * n, "a@b." * (n // 4), "7 " * (n // 20), "4-" * (n // 2), "a9" * (n // 2)]
    for text in texts:
        start = time.perf_counter()
        base = pii.base_spans(text)
        field.added([text])
        assert time.perf_counter() - start < 10, text[:9]
        assert all(0 <= a < b <= len(text) for a, b, _ in base)
    assert pii.base_spans("7" * n + " 10.0.0.1 " + "+" * n) == [(n + 1, n + 9, 1)]


def test_labelled_table_is_learnt():
    tagger = pii.Tagger.train()
    for marked in pii.LABELLED:
        text = re.sub(r"\[(\w+)\|([^\]]*)\]", r"\2", marked)
        kinds = [pii.KINDS[k] for _, _, k in tagger.added([text])[0]]
        assert kinds == re.findall(r"\[(\w+)\|", marked), text


def test_spans_are_added_and_base_ones_stay(docs):
    texts = edge_texts() + ["call (415) 555-9911 now", "é +1 (269) 555-3296 4524132264652876 and", "token = \"1beb58b8af68854f0e01\" 3.", "x" * 90_000 + " a@b.cd"]
    rows = {r.doc_id: r for r in pii.find_spans(docs(texts)).collect()}
    for i, t in enumerate(texts):
        base = [(s.start, s.end, pii.KINDS.index(s.kind)) for s in rows[i].base]
        spans = [(s.start, s.end, pii.KINDS.index(s.kind)) for s in rows[i].spans]
        assert base == plain_base(t or "") and set(base) <= set(spans) and rows[i].text == (t or "")
    n = len(texts)
    assert [(s.kind, texts[n - 4][s.start : s.end]) for s in rows[n - 4].spans] == [("phone", "(415) 555-9911")]
    assert ("phone", "+1 (269) 555-3296") in [(s.kind, texts[n - 3][s.start : s.end]) for s in rows[n - 3].spans]
    assert rows[n - 2].spans == []
    assert pii.find_spans(docs([])).count() == 0


def test_redaction_keeps_the_rest(docs):
    texts = [None, "", "a.b@c.example.org and 10.0.0.1!", "plain"]
    rows = sorted(pii.redacted(docs(texts)).collect())
    assert [r.text for r in rows] == [None, "", "[EMAIL] and [IP]!", "plain"]
    assert [r.n_chars for r in rows] == [None, 0, 17, 5] and rows[0].lang == "en"


def toxic_corpus(n):
    r = random.Random(7)
    texts, toxic = [], []
    for i in range(n):
        w = words(i, r.randint(5, 80)).split(" ")
        bad = i % 4 == 0
        for _ in range(r.randint(1, 3) if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(["grumbus", "Vileword", "nastyton", "nastyta,"]))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return texts, toxic


def labels_frame(spark, toxic, ids=None):
    return spark.createDataFrame([(i, 1, t) for i, t in zip(ids or range(len(toxic)), toxic)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, docs):
    texts, toxic = toxic_corpus(600)
    frame = docs(texts)
    model = toxicity.train(frame, labels_frame(spark, toxic))
    rows = toxicity.scores(frame, model, spans=True).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.toxic_score >= 0.5) == bool(toxic[r.doc_id]) for r in held)
    assert len(held) > 80 and right / len(held) > 0.97
    for r in rows:
        for s in r.toxic_spans:
            word = r.text.encode()[s.start : s.end].decode().lower()
            assert word.startswith(("grumb", "vile", "nasty")) and 0.5 <= s.p <= 1


def test_held_out_labels_are_never_learnt(spark, docs):
    texts, toxic = toxic_corpus(300)
    flipped = [1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t for i, t in enumerate(toxic)]
    frame = docs(texts)
    a, b = (toxicity.scores(frame, toxicity.train(frame, labels_frame(spark, x))).collect() for x in (toxic, flipped))
    assert sorted((r.doc_id, r.toxic_score) for r in a) == sorted((r.doc_id, r.toxic_score) for r in b)


def test_toxicity_without_labels_and_with_odd_rows(spark, docs):
    frame = docs([None, "", words(1, 9)], [1, None, 3]).withColumnRenamed("source", "toxic_score")
    model = toxicity.train(frame, labels_frame(spark, []))
    rows = toxicity.scores(frame, model).collect()
    assert all(0 <= r.toxic_score < 0.5 for r in rows) and len(rows) == 3
    some = toxicity.train(docs(["a b", "c d"]), labels_frame(spark, [1, 1, None, 0], [0, 0, 1, None]))
    assert 0 <= toxicity.scores(docs(["a b"]), some).first().toxic_score <= 1


def test_the_sample_is_bounded_in_rows_where_ids_repeat(spark, docs):
    texts, toxic = toxic_corpus(60)
    frame = docs(texts * 3 + [None], [*range(60)] * 3 + [1])
    labels = labels_frame(spark, toxic)
    rows = toxicity.sample(frame, labels, 10).collect()
    assert sorted(Counter(r.toxic for r in rows).values()) == [10, 10]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, toxicity.sample(docs(texts), labels, 10).collect()))


def test_columns_named_like_results_stay(spark, docs):
    assert free_name(["A", "b", "b_"], "B") == "B__" and free_name(["A"], "c") == "c"
    frame = docs([words(1, 9), None]).withColumnRenamed("source", "toxic_score").withColumnRenamed("lang", "__row")
    model = toxicity.train(frame, labels_frame(spark, []))
    rows = toxicity.scores(frame, model, name=free_name(frame.columns, "toxic_score")).collect()
    assert [(r.toxic_score, 0 <= r.toxic_score_ < 0.5) for r in rows] == [("s", True)] * 2
    rest = without(frame, frame.where("text IS NULL").select(row_key(frame).alias("key")))
    assert rest.columns == frame.columns and [r["__row"] for r in rest.collect()] == ["en"]


def test_long_stretches_are_trained_on_in_pieces(spark):
    model = toxicity.Model(*toxicity_terms(["bad", "worse"]), np.zeros((toxicity.Model.N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(4))
    texts = [("bad worse " * 75, 1), ("bad " * 64, 1), ("a bad end", 0), ("worse " * 65, 0)]
    rows = toxicity._training_stretches(spark.createDataFrame(texts, "text string, toxic int"), model)
    seen = Counter()
    for r in rows:
        seen[len(r.y), max(r.y)] += r["count"]
    assert seen == {(64, 1): 3, (22, 1): 1, (1, 0): 2, (64, 0): 1}


def toxicity_terms(terms):
    keys = np.sort(word_hash([t.encode() for t in terms]))
    return keys, np.full(len(keys), 3.0)
