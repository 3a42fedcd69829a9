import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import induced, repeats
from llm_samples import edge_texts, words


def marked(data: bytes, length: int):
    seen = Counter(data[i : i + length] for i in range(len(data) - length + 1))
    return [i + length <= len(data) and seen[data[i : i + length]] > 1 for i in range(len(data))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 6), st.sampled_from([0, 40, 1 << 20]))
def test_repeated_equals_counting(values, length, budget):
    data = np.array(values, np.uint8)
    assert induced.repeated(data, length, budget).tolist() == marked(bytes(values), length)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=60))
def test_suffixes_come_in_order_with_their_prefixes(values):
    data = np.array(values, np.uint8)
    text = bytes(values)
    groups: dict = {}
    for place, lcp in induced.suffixes(data, 200):
        for p, n in zip(place.tolist(), lcp.tolist()):
            i = p
            while i + 1 < len(text) and text[i + 1] == text[p]:
                i += 1
            small = i + 1 < len(text) and text[i + 1] > text[p]
            groups.setdefault((text[p], small), []).append((p, n))
    assert sum(map(len, groups.values())) == len(text)
    for (_, small), own in groups.items():
        order = sorted((p for p, _ in own), key=lambda p: text[p:], reverse=small)
        assert [p for p, _ in own] == order
        for (a, _), (b, n) in zip(own, own[1:]):
            common = next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or not text[a + k : a + k + 1]), 0)
            assert n == common


def test_large_text_with_a_small_budget():
    text = "\n".join(words(s, 400) for s in (1, 2, 1, 3)).encode()
    data = np.frombuffer(text, np.uint8)
    assert induced.repeated(data, 200, 1000).tolist() == marked(text, 200)


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def cases():
    r = random.Random(3)
    passage = words(50, 70)
    out = edge_texts() + ["ab" * 300, "z" * 199, "z" * 200, "z" * 201]
    for s in range(30):
        out.append(words(100 + s, 40)[: r.randint(0, 300)] + passage[r.randint(0, 40) :] + words(200 + s, 30))
    long = words(300, 900)
    for s in range(8):
        a = r.randint(0, 2000)
        out.append(long[a : a + r.randint(150, 1500)])
    return out


@pytest.mark.parametrize("hot", [512, 3])
def test_spans_equal_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = cases()
    rows = {r.doc_id: r for r in repeats.repeated_spans(docs(texts), with_text=True).collect()}
    for i, expected in enumerate(brute(texts)):
        r = rows[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected, i
        assert len(r.spans) == r.n_spans and sum(b - a for a, b in r.spans) == r.n_removed
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_long_documents_are_looked_at_in_steps(docs, monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 97)
    texts = cases()
    rows = {r.doc_id: r for r in repeats.repeated_spans(docs(texts)).collect()}
    assert [(rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) for i in range(len(texts))] == brute(texts)


def test_empty_and_repeated_rows(docs):
    assert repeats.repeated_spans(docs([])).count() == 0
    rows = repeats.repeated_spans(docs(["q" * 10 + words(1, 90), "q" * 10 + words(1, 90), None], [1, 1, None])).collect()
    assert sorted(r.n_removed == r.n_bytes for r in rows) == [True, True, True]
