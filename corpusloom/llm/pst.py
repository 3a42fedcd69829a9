"""Language-model scores by a probabilistic suffix tree over the bytes of a text's words.

A text is its lower-cased words, each with a blank after it, and an end mark. The tree's contexts are up to ``DEPTH``
bytes long; a longer context is kept only if its next-byte counts diverge from what its suffix predicts, and a byte
is scored in the longest kept suffix of what stands before it. The bytes of a word and its blank (or the end mark)
give the tree's probability p of a token.

Scores are over the symbols of ``base_score``: the words of the training texts, and one symbol for all others. That
one has the share u of training tokens that are the only one of their word (what was new once); a known token has
(1 - u) ((1 - b) c / N + b p), with c its count, N that of all tokens and b = ``TREE``. The sum over all symbols is at
most 1.

Counts are exact over all training documents. Documents are dealt to blocks; each block asks for the words and byte
runs that its texts hold, shard by shard, once each. A shard owns a part of the words and whole subtrees, sums the
counts, grows its subtrees, and answers each block. So neither counts nor tree are ever in one place, and what moves
grows with the input. Only the counts of byte pairs (65,536 at most) go through the driver.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, SPACE_BYTES, Words, column_bytes, fold, lean, lean_group, mix, pieces, plan_bytes

DEPTH = 5
#: The weight of the shorter context's prediction, in counts; least divergence (nats times count) of a kept context.
PRIOR, DIVERGENCE = 2.0, 3.0
#: The tree's weight in a known token's probability.
TREE = 0.3
#: The end of a text, as a byte (no word holds it) and as a word's key.
END, END_KEY = 0x0A, np.uint64(0xE2D)
BLANK = 0x20


def symbols(w: Words, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte runs of ``DEPTH`` + 1 as integers, one for each byte of the texts; their document; the number of the token.

    Before its first byte a text has end marks. Tokens are numbered as they stand, end marks included.
    """
    size = w.end - w.start
    words = np.diff(w.first)
    body = np.bincount(w.doc, size + 1, minlength=docs).astype(np.int64) + 1
    first = np.cumsum(body + DEPTH) - body
    out = np.full(int((body + DEPTH).sum()), END, np.uint8)
    ends = np.cumsum(size + 1)
    before = np.append(0, ends)[w.first[:-1]]
    place = ends - (size + 1) - before[w.doc] + first[w.doc]
    shift = np.repeat(w.start - place, size)
    at = np.repeat(place - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out[at] = w.data[at + shift]
    out[place + size] = BLANK
    doc = np.repeat(np.arange(docs), body)
    here = np.repeat(first - (np.cumsum(body) - body), body) + np.arange(int(body.sum()))
    keys = np.zeros(len(here), np.uint64)
    for back in range(DEPTH, -1, -1):
        keys = (keys << np.uint64(8)) | out[here - back].astype(np.uint64)
    lengths = np.ones(len(size) + docs, np.int64)
    lengths[np.arange(len(size)) + w.doc] = size + 1
    return keys, doc, np.repeat(np.arange(len(lengths)), lengths)


def word_keys(w: Words, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and documents of all tokens, the end marks where they stand."""
    keys = np.full(len(w.hash) + docs, END_KEY)
    doc = np.zeros(len(keys), np.int64)
    doc[w.first[1:] + np.arange(docs)] = np.arange(docs)
    at = np.arange(len(w.hash)) + w.doc
    keys[at], doc[at] = w.hash, w.doc
    return keys, doc


def _chunks(column):
    data, borders = column_bytes(column)
    for low, high in pieces(borders, CHUNK_BYTES):
        cut = borders[low : high + 1]
        yield low, high, Words(data[cut[0] : cut[-1]], cut - cut[0], SPACE_BYTES)


def _counted(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and summed counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    distinct, back = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(back, counts, minlength=len(distinct)).astype(np.int64)


def pair_counts(docs: DataFrame) -> np.ndarray:
    """Counts of byte pairs (before, byte) in the training texts: the tree's first two levels."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for low, high, w in _chunks(batch.column(0)):
                keys, _, _ = symbols(w, high - low)
                total += np.bincount((keys & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["pair", "n"])

    rows = docs.where("NOT held").select("text").mapInArrow(lean(count), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << 16)
    for r in rows:
        out[r.pair] = r.n
    return out.reshape(256, 256)


def shallow(pairs: np.ndarray) -> np.ndarray:
    """Probability of a byte after one byte, smoothed by its plain frequency, that by one count each."""
    plain = (pairs.sum(0) + 1) / (pairs.sum() + 256)
    return (pairs + PRIOR * plain) / (pairs.sum(1, keepdims=True) + PRIOR)


def grow(keys: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 probability of each byte run's last byte in its longest kept context.

    ``keys`` are distinct runs with their training counts, all those that share their last two context bytes with one
    of them; ``first`` the probabilities of ``shallow``.
    """
    mask = lambda d: np.uint64((1 << 8 * d) - 1)
    p = first[(keys >> np.uint64(8) & np.uint64(0xFF)).astype(np.int64), (keys & np.uint64(0xFF)).astype(np.int64)]
    level, passed, context = [p], [], []
    for d in range(2, DEPTH + 1):
        run, run_of = np.unique(keys & mask(d + 1), return_inverse=True)
        c = np.bincount(run_of, counts, minlength=len(run))
        ctx, ctx_of_run = np.unique(run >> np.uint64(8), return_inverse=True)
        n = np.bincount(ctx_of_run, c, minlength=len(ctx))
        parent = np.zeros(len(run))
        parent[run_of] = level[-1]
        seen = c > 0
        gain = np.where(seen, c * np.log(np.where(seen, c, 1) / np.maximum(n[ctx_of_run], 1) / parent), 0)
        passed.append(np.bincount(ctx_of_run, gain, minlength=len(ctx)) >= DIVERGENCE)
        context.append(ctx_of_run[run_of])
        level.append(((c + PRIOR * parent) / (n[ctx_of_run] + PRIOR))[run_of])
    # a context is kept if it diverges or a longer kept one ends in it
    kept = [None] * len(passed)
    below = np.zeros(len(keys), bool)
    for i in range(len(passed) - 1, -1, -1):
        keep = passed[i].copy()
        keep[context[i][below]] = True
        kept[i] = below = keep[context[i]]
    out = level[0]
    for i, keep in enumerate(kept):
        out = np.where(keep, level[i + 1], out)
    return np.log10(out)


def _blobs(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple[bytes, bytes]]:
    by = np.lexsort((keys, shard))
    cuts = np.searchsorted(shard[by], np.arange(shards + 1))
    keys, counts = keys[by].astype("<u8"), counts[by].astype("<u4")
    return [(keys[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]


def _numbers(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a binary column end to end, and how many each row has."""
    data, borders = column_bytes(column)
    return data.copy().view(kind), np.diff(borders) // np.dtype(kind).itemsize


ASKED = "shard int, block int, words binary, word_counts binary, runs binary, run_counts binary"


def asked(blocks: DataFrame, shards: int) -> DataFrame:
    """Per block and shard the distinct words and byte runs of its texts, with their counts in training texts."""

    def ask(key, table):
        import pyarrow as pa

        words, grams = [], []
        train = ~np.array(table.column("held").to_pylist(), bool)
        for low, high, w in _chunks(table.column("text")):
            for held, (keys, doc) in ((words, word_keys(w, high - low)), (grams, symbols(w, high - low)[:2])):
                seen = np.unique(keys)
                learnt, n = np.unique(keys[train[low:high][doc]], return_counts=True)
                held += [(seen, np.zeros(len(seen))), (learnt, n)]
        word, n_word = _counted(words)
        run, n_run = _counted(grams)
        w = _blobs((word % np.uint64(shards)).astype(np.int64), word, n_word, shards)
        owner = mix(run >> np.uint64(8) & np.uint64(0xFFFF)) % np.uint64(shards)
        g = _blobs(owner.astype(np.int64), run, n_run, shards)
        # every shard is asked, be it for nothing: its answer also holds its part of N and V
        columns = [pa.array(range(shards), pa.int32()), pa.array([key[0].as_py()] * shards, pa.int32())]
        columns += [pa.array([x[j] for x in blobs], pa.binary()) for blobs in (w, g) for j in (0, 1)]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in ASKED.split(", ")])

    return blocks.groupBy("block").applyInArrow(lean_group(ask), ASKED)


def _sums(table) -> SimpleNamespace:
    word, n_words = _numbers(table.column("words"), "<u8")
    run, n_runs = _numbers(table.column("runs"), "<u8")
    word_count, _ = _numbers(table.column("word_counts"), "<u4")
    run_count, _ = _numbers(table.column("run_counts"), "<u4")
    words, word_of = np.unique(word, return_inverse=True)
    runs, run_of = np.unique(run, return_inverse=True)
    return SimpleNamespace(
        words=words, word_of=word_of, n_words=n_words, c=np.bincount(word_of, word_count, minlength=len(words)),
        runs=runs, run_of=run_of, n_runs=n_runs, r=np.bincount(run_of, run_count, minlength=len(runs)),
    )


def answered(asks: DataFrame, first: np.ndarray) -> DataFrame:
    """Per shard and block: the block's words with their training counts, its byte runs with their log10 probabilities."""

    def answer(key, table):
        import pyarrow as pa

        s = _sums(table)
        counts = s.c[s.word_of].astype("<u8")
        scores = (grow(s.runs, s.r, first) if len(s.runs) else np.zeros(0))[s.run_of].astype("<f4")
        cut = lambda x, n: [part.tobytes() for part in np.split(x, np.cumsum(n)[:-1])]
        shares = [int(s.c.sum()), int((s.c > 0).sum()), int((s.c == 1).sum())]
        columns = [table.column("block").combine_chunks(), *(pa.array([x] * table.num_rows) for x in shares), table.column("words").combine_chunks(), pa.array(cut(counts, s.n_words), pa.binary()), table.column("runs").combine_chunks(), pa.array(cut(scores, s.n_runs), pa.binary())]
        return pa.Table.from_arrays(columns, ["block", "n", "v", "once", "words", "counts", "runs", "scores"])

    return asks.groupBy("shard").applyInArrow(lean_group(answer), "block int, n long, v long, once long, words binary, counts binary, runs binary, scores binary")


def scores(docs: DataFrame, modulus: int = 10, block_bytes: int = 6 << 20) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text), learnt from those whose crc32 of the id as text isn't 0 modulo ``modulus``.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null texts count as empty: their
    only token is the end. A null id is learnt from (it has no crc32) and not held out; repeated rows count each.
    Without training texts every token is the new symbol, of probability 1.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, plan_bytes(docs) // block_bytes + 1)
    shards = max(256, blocks)
    held = F.coalesce(F.pmod(fold(), F.lit(modulus)) == 0, F.lit(False))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", held.alias("held"), text.cast("binary").alias("text"), F.pmod(F.xxhash64("doc_id", text), F.lit(blocks)).cast("int").alias("block"))
    first = shallow(pair_counts(rows))
    asks = asked(rows, shards)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(key, texts, answers):
        import pyarrow as pa

        def table(keys: str, values: str, kind: str):
            k, v = _numbers(answers.column(keys), "<u8")[0], _numbers(answers.column(values), kind)[0]
            by = np.argsort(k)
            return k[by], v[by]

        words, counts = table("words", "counts", "<u8")
        runs, logs = table("runs", "scores", "<f4")
        all_, distinct_words, once = (sum(answers.column(c).to_pylist()) for c in ("n", "v", "once"))
        new = min(0.5, max(once, 0.5) / all_) if all_ else 1.0
        out: list[list] = [[] for _ in range(5)]
        for low, high, w in _chunks(texts.column("text")):
            n = high - low
            keys, doc = word_keys(w, n)
            distinct, back = np.unique(keys, return_inverse=True)
            c = counts[np.searchsorted(words, distinct)][back].astype(np.float64)
            keys, _, token = symbols(w, n)
            distinct, back = np.unique(keys, return_inverse=True)
            spelt = np.bincount(token, logs[np.searchsorted(runs, distinct)][back].astype(np.float64), minlength=len(c))
            known = (1 - new) * ((1 - TREE) * c / max(all_, 1) + TREE * 10.0**spelt)
            mixed = np.log10(np.where(c > 0, known, new))
            base = np.log10((c + 0.1) / (all_ + 0.1 * (distinct_words + 1)))
            per_doc = lambda x: np.bincount(doc, x, minlength=n)  # noqa: E731, B023
            for held, x in zip(out, (per_doc(np.ones(len(c))), per_doc(c > 0), np.full(n, all_), per_doc(base), per_doc(mixed))):
                held.append(x)
        columns = [pa.array(np.concatenate(x).astype(k) if x else np.zeros(0, k)) for x, k in zip(out, (np.int64, np.int64, np.int64, np.float64, np.float64))]
        return pa.Table.from_arrays([texts.column("doc_id").combine_chunks(), texts.column("held").combine_chunks(), *columns], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = answered(asks, first)
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean_group(score), schema)
