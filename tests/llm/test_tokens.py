import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import bitpack, packing, tokens

from llm_samples import edge_texts, words


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.default_tokenizer())


def plain(encoder, texts):
    return [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_library(encoder):
    texts = [t or "" for t in edge_texts()]
    ids, borders = encoder.encode_column(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:])] == plain(encoder, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sé ß中1.,!?\n\t  “<|>")), max_size=20), max_size=8))
def test_encoder_equals_library_on_any_text(texts):
    encoder = tokens.Encoder(tokens.default_tokenizer())
    ids, borders = encoder.encode_column(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(borders, borders[1:])] == plain(encoder, texts)


def test_memo_starts_afresh(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 3)
    for seed in range(4):
        text = words(seed, 50)
        ids, _ = encoder.encode_column(pa.array([text]))
        assert ids.tolist() == plain(encoder, [text])[0]


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 31, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 640, dtype=np.uint64).astype(np.uint32)
    data = bitpack.pack(ids, bits)
    assert len(data) == 10 * bits * 8 and (bitpack.unpack(data, bits) == ids).all()
    assert bitpack.bits_for(50257) == 16 and bitpack.bits_for(2) == 1


def test_files_random_access(tmp_path):
    path = str(tmp_path / "a.tok")
    ids = np.random.default_rng(0).integers(0, 50257, 10_000).astype(np.uint32)
    writer = bitpack.Writer(pa.OSFile(path, "wb"), 16)
    writer.add([5, None], ids[:9000], np.array([8999, 1]))
    writer.add([7], ids[9000:], np.array([1000]))
    writer.close()
    reader = bitpack.Reader(path)
    assert reader.docs.tolist() == [5, -(1 << 63), 7] and reader.doc_offsets.tolist() == [0, 8999, 9000, 10_000]
    for a, n in ((0, 10_000), (4095, 2), (8191, 1), (9999, 1), (3, 0)):
        assert (reader.read(a, n) == ids[a : a + n]).all()
    with open(str(tmp_path / "b"), "wb") as f:
        f.write(b"x" * 200)
    with pytest.raises(ValueError):
        bitpack.Reader(str(tmp_path / "b"))


def test_token_files(spark, docs, encoder):
    texts = edge_texts()
    ids = [*range(100, 100 + len(texts) - 1), None]
    manifest = bitpack.write_tokens(docs(texts, ids), parts=3)
    rows = {r.doc_id: r for r in bitpack.read_tokens(manifest).collect()}
    expected = dict(zip(ids, plain(encoder, [t or "" for t in texts])))
    start = 0
    for i in sorted(ids, key=lambda x: -1 if x is None else x):
        own = np.array([*expected[i], 0], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert bitpack.read_tokens(bitpack.write_tokens(docs([]))).count() == 0


def test_repeated_ids_stand_in_order_of_text(docs):
    rows = bitpack.read_tokens(bitpack.write_tokens(docs(["b", "a", "a"], [1, 1, 1]))).orderBy("start").collect()
    assert [r.start for r in rows] == [0, 2, 4] and rows[0].ids_crc32 == rows[1].ids_crc32


def test_differencing_is_whole_and_even():
    r = random.Random(1)
    for _ in range(30):
        sizes = np.array([r.randint(1, 512) for _ in range(r.randint(1, 60))])
        k = r.randint(1, 9)
        window = packing.differencing(sizes, k)
        assert len(window) == len(sizes) and window.min() >= 0 and window.max() < k
        if len(sizes) >= 6 * k:
            sums = np.bincount(window, sizes, minlength=k)
            assert sums.max() - sums.min() <= sizes.max()
    # the classic example: 8 7 6 5 4 in two windows differ by 2
    sums = np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])
    assert sorted(sums) == [14, 16]


def test_window_count_rises_when_one_overflows():
    window, k = packing.windows(np.array([6, 6, 6]), 9)
    assert k == 3 and sorted(window) == [0, 1, 2]


def test_packing_holds_each_id_once(docs, encoder):
    texts = edge_texts() * 3
    rows = packing.pack(docs(texts), capacity=256, piece=64, with_ids=True).collect()
    expected = plain(encoder, [t or "" for t in texts])
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    for i, ids in enumerate(expected):
        got = b"".join(r.ids for r in sorted(by_doc[i], key=lambda r: r.start))
        assert got == np.array([*ids, 1], "<u4").tobytes() and {r.doc_tokens for r in by_doc[i]} == {len(ids) + 1}
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack(docs([])).count() == 0


def test_packing_leaves_little_padding(docs):
    texts = [words(s, 30 + 37 * (s % 19)) for s in range(400)]
    rows = packing.pack(docs(texts).coalesce(1)).groupBy("sequence_id").sum("length").collect()
    used = sum(r[1] for r in rows)
    assert 1 - used / (2048 * len(rows)) < 0.03


def test_tokenizer_path_is_a_parameter(docs):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert os.path.exists(path)
    rows = packing.pack(docs(["Two words", None]), tokenizer=path).collect()
    assert sorted(r.doc_tokens for r in rows) == [1, 3]
