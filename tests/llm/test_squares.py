import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from corpusloom.llm import squares
from llm_samples import edge_texts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, periods=4, least=6):
    """Runs by definition: every maximal stretch of every period, of which only smallest periods count."""
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        a = 0
        while a < n - q:
            if words[a] != words[a + q]:
                a += 1
                continue
            b = a
            while b < n - q and words[b] == words[b + q]:
                b += 1
            size = b - a + q
            if size >= max(least, periods * q) and not any(
                all(words[k] == words[k + s] for k in range(a, a + size - s)) for s in range(1, q)
            ):
                out.append((a, size, q))
            a = b
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for a, size, q in runs for k in range(a + q, a + size)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def caught(texts):
    ids = {}
    values = np.array([ids.setdefault(w, len(ids)) for t in texts for w in t], np.uint64)
    borders = np.append(0, np.cumsum([len(t) for t in texts]))
    out = [[] for _ in texts]
    for text, *run in squares.catch(squares.mix(values + np.uint64(9)), borders).tolist():
        out[text].append(tuple(run))
    return out


def periodic(r, n):
    """A text of repeated roots, some with a fault, of nested and neighbouring runs."""
    out = []
    while len(out) < n:
        root = [r.choice("abc") for _ in range(r.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 16, 17]))]
        part = root * r.randint(1, 6) + root[: r.randint(0, len(root))]
        if r.random() < 0.2:
            part = part * 5
        if r.random() < 0.3:
            part[r.randrange(len(part))] = r.choice("xyz")
        out += part
    return out[: r.randint(0, n)]


@pytest.mark.parametrize("seed", range(6))
def test_catchers_equal_brute_force(seed):
    r = random.Random(seed)
    texts = [periodic(r, r.choice([8, 30, 90, 250])) for _ in range(60)] + [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 200, ["a", "b"] * 64]
    assert caught(texts) == [brute(t) for t in texts]


def test_random_words_over_two_letters():
    r = random.Random(11)
    texts = [[r.choice("ab") for _ in range(r.randint(0, 120))] for _ in range(150)]
    assert caught(texts) == [brute(t) for t in texts]


def test_hash_collisions_are_verified(monkeypatch):
    texts = [["a", "b", "c", "d"] * 6, ["a"] * 9 + ["b"] * 9]
    right = [brute(t) for t in texts]
    values = np.array([ord(w) for t in texts for w in t], np.uint64)
    assert squares._verified(values, 0, 24, 4) == (0, 24, 4)
    assert squares._verified(values, 20, 34, 1) == (24, 33, 1) and squares._verified(values, 0, 6, 3) is None
    assert caught(texts) == right


def test_one_word_repeated_in_a_very_long_text():
    assert caught([["a"] * 300_000 + ["b"] * 3]) == [[(0, 300_000, 1)]]


def test_operator(docs):
    r = random.Random(3)
    texts = edge_texts() + [" ".join(periodic(r, 60)) for _ in range(30)] + ["ja  é " * 9, " \t\n ", "A a " * 4]
    texts += texts[-3:]
    rows = {x.doc_id: x for x in squares.periodic_runs(docs(texts).withColumnRenamed("source", "runs")).collect()}
    for i, t in enumerate(texts):
        own = WORD.findall(t or "")
        runs = brute(own) if len(own) < 2000 else [tuple(x) for x in rows[i].runs]
        assert ([tuple(x) for x in rows[i].runs], rows[i].n_words, rows[i].collapsed) == (runs, len(own), collapsed(own, runs))
    assert squares.periodic_runs(docs([])).count() == 0
    with pytest.raises(ValueError):
        squares.catch(np.zeros(3, np.uint64), np.array([0, 3]), periods=3)


def test_query(docs, spark, tmp_path):
    from corpusloom.llm.queries import QUERIES

    r = random.Random(5)
    texts = [words(i, r.choice([1, 2, 9, 40, 130])) for i in range(60)] + [None, "", " "] + [" ".join(periodic(r, 80)) for _ in range(30)]
    docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {x.doc_id: x for x in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    planted = 0
    for i, t in enumerate(texts):
        own = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(own)
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = [own[k] if k < a else own[a + (k - a) % p] for k in range(n)]
        runs = brute(own)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        lines = "".join(f"{a},{size},{q}\n" for a, size, q in runs)
        assert tuple(rows[i])[1:] == (len(runs), *want, sha(lines), sha(collapsed(own, runs)))
    assert planted > 4
