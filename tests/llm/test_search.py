import hashlib
import random
import re

from corpusloom.llm import positional

from llm_samples import edge_texts, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(text):
    return WORD.findall((text or "").translate(LOW))


def brute(texts, items, width, slop=0):
    out = []
    for text in texts:
        w = split(text)
        hit, found = [0] * len(w), set()
        for name, item in items:
            t = split(item)
            for a in range(max(1, len(t) - width + 1) if t else 0):
                window = t[a : a + width]
                for i in range(len(w) - len(window) + 1):
                    if w[i : i + len(window)] == window:
                        found.add(str(name))
                        hit[i : i + len(window)] = [1] * len(window)
        out.append((len(w), sum(hit), sorted(found)))
    return out


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_windows_equal_brute_force(spark, docs):
    r = random.Random(2)
    texts = edge_texts() + [" ".join(r.choice("ab c D é 1".split()) for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts.append(words(1, 150).upper().replace(" ", ", "))
    items = [(3, words(1, 150)[30:260]), (12, "a b"), (7, None), (8, ""), (1, "a b c d a"), (12, "c D é 1"), (5, "x" * 700)]
    rows = {x.doc_id: x for x in positional.contamination(docs(texts), items_frame(spark, items), width=5).collect()}
    for i, (n, hit, found) in enumerate(brute(texts, items, 5)):
        assert (rows[i].n_words, rows[i].n_hit, rows[i]["items"]) == (n, hit, found)


def test_blocks_of_items_are_united(spark, docs, monkeypatch):
    texts = [words(1, 80), words(9, 40), None, words(1, 30) + " " + words(9, 20)]
    items = [(i, words(1, 80)[20 * i : 20 * i + 120]) for i in range(8)] + [(20, words(9, 15))]
    one = positional.contamination(docs(texts), items_frame(spark, items)).select("doc_id", "n_words", "n_hit", "items").collect()
    monkeypatch.setattr(positional.phrase_blocks, "__defaults__", (30,))
    many = positional.contamination(docs(texts), items_frame(spark, items)).select("doc_id", "n_words", "n_hit", "items").collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and any(x.n_hit for x in one)


def test_blocks_keep_rows_that_share_an_id(spark, docs, monkeypatch):
    texts = [words(1, 80), words(2, 80), words(3, 80), words(1, 80), None, None]
    frame = docs(texts, [4, 4, None, None, None, None])
    items = items_frame(spark, [(1, words(1, 80)[:200]), (2, words(3, 80)[:200]), (3, words(2, 80)[60:300])])
    one = positional.contamination(frame, items).collect()
    monkeypatch.setattr(positional.phrase_blocks, "__defaults__", (7,))
    many = positional.contamination(frame, items).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(many) == 6


def test_items_without_words_do_not_end_the_search(spark, docs, monkeypatch):
    text = words(6, 60)
    items = spark.createDataFrame([(1, words(7, 20)), (2, " ." * 40), (3, " ." * 40), (4, text)], "item_id long, text string").coalesce(1)
    monkeypatch.setattr(positional.phrase_blocks, "__defaults__", (8,))
    row = positional.contamination(docs([text]), items).first()
    assert row["items"] == ["4"] and row.n_hit == row.n_words == len(split(text))


def test_long_items_are_cut_into_overlapping_runs(spark, docs, monkeypatch):
    monkeypatch.setattr(positional, "CHUNK_BYTES", 50)
    monkeypatch.setattr(positional, "RUN_WINDOWS", 4)
    texts = [words(8, 120), words(8, 120)[33:300], "x" * 300 + " y", None]
    items = [(1, words(8, 120)), (2, words(8, 120)[100:]), (3, "x" * 300 + " Y"), (4, "y")]
    rows = {x.doc_id: x for x in positional.contamination(docs(texts), items_frame(spark, items), width=5).collect()}
    for i, (n, hit, found) in enumerate(brute(texts, items, 5)):
        assert (rows[i].n_words, rows[i].n_hit, rows[i]["items"]) == (n, hit, found)


def test_proximity(spark, docs):
    texts = ["one two three four", "one x two three four", "one x x two three four", "four three two one", None]
    rows = positional.contamination(docs(texts), items_frame(spark, [(1, "one two three four")]), slop=1).collect()
    assert {r.doc_id for r in rows if r["items"]} == {0, 1}


def test_empty_tables(spark, docs):
    assert positional.contamination(docs([]), items_frame(spark, [(1, "a b")])).count() == 0
    rows = positional.contamination(docs(["a b c"]), items_frame(spark, [])).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in rows] == [(3, 0, [])]


def test_digest():
    assert positional.items_digest(["1", "12"]) == hashlib.sha256(b"1,12").hexdigest()
