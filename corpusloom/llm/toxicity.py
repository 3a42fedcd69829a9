"""Toxic spans by a conditional random field; its marginals add up to a document's score.

Training looks at a bounded sample of labelled documents only. Words, and beginnings of words, that mark toxic
documents there (likelihood ratio) are the field's vocabulary; a word with none of them can only be "outside", so a
document falls into short stretches that are decoded exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, NON_WORD_BYTES, Words, column_bytes, fold, free_name, lean, mix, pieces, stored
from .crf import Crf, batches, padded

#: Labelled documents of each kind that training looks at, at most (the ones of least hash).
SAMPLE = 6000
#: Terms of the vocabulary, stretches of training, at most (the strongest, the most frequent).
TERMS, STRETCHES = 5000, 20_000
#: Words of a stretch that training holds together; a longer one is trained on in pieces.
PIECE = 64
#: Bytes of a word's beginnings that count as terms of their own.
PREFIXES = (4, 5, 6)
#: Least likelihood ratio (G squared) and log-odds of a term, log-odds of a word that is labelled toxic.
LEAST_G, LEAST_ODDS, TOXIC_ODDS = 18.0, 1.5, 2.5
#: Borders between classes of log-odds; a term's class is its feature.
CLASSES = np.array([1.5, 2.5, 3.5, 4.5, 6.0])


def term_keys(w: Words) -> list[np.ndarray]:
    """64-bit keys of each word and of its beginnings (0 where the word is no longer than that)."""
    keys = [w.hash]
    padded_data = np.concatenate([w.data, np.zeros(8, np.uint8)]).astype(np.uint64)
    size = w.end - w.start
    for n in PREFIXES:
        key = np.full(len(size), np.uint64(n))
        for i in range(n):
            key = (key << np.uint64(8)) | padded_data[w.start + i]
        keys.append(np.where(size > n, mix(key), np.uint64(0)))
    return keys


def _documents(batch, column: int) -> Iterator[tuple[int, int, Words]]:
    data, borders = column_bytes(batch.column(column))
    for low, high in pieces(borders, CHUNK_BYTES):
        cut = borders[low : high + 1]
        yield low, high, Words(data[cut[0] : cut[-1]], cut - cut[0], NON_WORD_BYTES)


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """At most ``size`` labelled documents of either kind, none of them held out: text, toxic.

    A document with several labels is toxic if one of them says so; null labels, ids and texts don't count. Of rows that
    share an id the text of least hash is the document, so that the bound holds for rows too.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(F.pmod(fold(), F.lit(5)) != 0)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = [known.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for c in ("toxic > 0", "toxic <= 0")]
    picked = some[0].unionByName(some[1])
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), "doc_id")
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")
    return rows.groupBy("doc_id", "toxic").agg(least).select("least.text", "toxic")


def vocabulary(chosen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of terms that mark toxic documents, and their log-odds."""

    def count(batches_: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches_:
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            for low, high, w in _documents(batch, 0):
                for keys in term_keys(w):
                    pair = np.unique(np.stack([keys, w.doc.astype(np.uint64)]), axis=1)
                    pair = pair[:, pair[0] != 0]
                    key, back = np.unique(pair[0], return_inverse=True)
                    bad = np.bincount(back, toxic[low + pair[1].astype(np.int64)], minlength=len(key))
                    all_ = np.bincount(back, minlength=len(key))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(bad.astype(np.int64)), pa.array(all_)], ["key", "bad", "n"])

    sizes = chosen.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.count("*").alias("n")).first()
    n_bad, n_good = int(sizes.bad), int(sizes.n - sizes.bad)
    if not n_bad or not n_good:
        return np.zeros(0, np.uint64), np.zeros(0)
    counts = chosen.select(F.col("text").cast("binary"), "toxic").mapInArrow(lean(count), "key long, bad long, n long")
    counts = counts.groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).where("bad >= 3")
    good = F.col("n") - F.col("bad")
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((good + 0.5) / (n_good + 1.0))
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    share = n_bad / (n_bad + n_good)
    g = 2 * (part(F.col("bad"), F.col("n") * share) + part(good, F.col("n") * (1 - share)))
    strong = counts.select("key", odds.alias("odds"), g.alias("g")).where((F.col("odds") >= LEAST_ODDS) & (F.col("g") >= LEAST_G))
    rows = strong.orderBy(F.desc("g"), "key").limit(TERMS).collect()
    keys = np.array([r.key for r in rows], np.int64).view(np.uint64)
    by = np.argsort(keys)
    return keys[by], np.array([r.odds for r in rows])[by]


class Model:
    """Vocabulary, field and the weights that turn a document's marginals into a score."""

    def __init__(self, keys, odds, emit, move, weights):
        self.keys, self.odds, self.crf, self.weights = keys, odds, Crf(emit, move), weights

    def parts(self):
        return self.keys, self.odds, self.crf.emit, self.crf.move, self.weights

    def features(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that may be toxic, their features (one per kind of term), their greatest log-odds."""
        found, best = [], np.full(len(w.hash), -1.0)
        n = len(CLASSES) + 1
        for kind, keys in enumerate(term_keys(w)):
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            hit = (self.keys[at] == keys) & (keys != 0) if len(self.keys) else np.zeros(len(keys), bool)
            odds = np.where(hit, self.odds[at], -1.0) if len(self.keys) else np.full(len(keys), -1.0)
            found.append(np.where(hit, kind * n + np.searchsorted(CLASSES, odds, "right"), -1))
            best = np.maximum(best, odds)
        may = np.flatnonzero(best >= 0)
        # one more feature for how many kinds of terms agree
        agree = (1 + len(PREFIXES)) * n + sum((f[may] >= 0).astype(np.int64) for f in found)
        return may, np.stack([*(f[may] for f in found), agree], axis=1), best[may]

    N_FEATURES = (1 + len(PREFIXES)) * (len(CLASSES) + 1) + 2 + len(PREFIXES)

    @staticmethod
    def stretches(may: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place (in ``may``) and length of each run of neighbouring words of one document."""
        if not len(may):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.ones(len(may), bool)
        new[1:] = (np.diff(may) != 1) | (doc[may[1:]] != doc[may[:-1]])
        first = np.flatnonzero(new)
        return first, np.diff(np.append(first, len(may)))

    def marginals(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words that may be toxic and the probability of each that it is."""
        may, features, _ = self.features(w)
        first, lengths = self.stretches(may, w.doc)
        p = np.zeros(len(may))
        for pick in batches(lengths, 1 << 18) if len(first) else ():
            e = self.crf.scores(padded(features, first[pick], lengths[pick]))
            got, _, _ = self.crf.marginals(e, lengths[pick])
            inside = np.arange(e.shape[1]) < lengths[pick][:, None]
            p[(first[pick][:, None] + np.arange(e.shape[1]))[inside]] = got[..., 1][inside]
        return may, p

    def evidence(self, w: Words, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document what the score is made of; also ``marginals``."""
        may, p = self.marginals(w)
        doc = w.doc[may]
        most, total = np.zeros(docs), np.bincount(doc, p, minlength=docs)
        np.maximum.at(most, doc, p)
        rate = 100 * total / np.maximum(np.diff(w.first), 20)
        return np.stack([np.ones(docs), most, np.log1p(total), np.log1p(rate)], axis=1), may, p

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.weights, -30, 30)))


def _training_stretches(chosen: DataFrame, model: Model) -> list:
    parts = model.parts()

    def cut(batches_: Iterator) -> Iterator:
        import pyarrow as pa

        m = Model(*parts)
        for batch in batches_:
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            for low, _, w in _documents(batch, 0):
                may, features, odds = m.features(w)
                label = (odds >= TOXIC_ODDS) & (toxic[low + w.doc[may]] > 0)
                first, lengths = m.stretches(may, w.doc)
                cuts = [(at, min(at + PIECE, a + n)) for a, n in zip(first.tolist(), lengths.tolist()) for at in range(a, a + n, PIECE)]
                rows = [features[a:b].ravel().tolist() for a, b in cuts]
                labels = [label[a:b].astype(int).tolist() for a, b in cuts]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64())), pa.array(labels, pa.list_(pa.int64()))], ["f", "y"])

    runs = chosen.select(F.col("text").cast("binary"), "toxic").mapInArrow(lean(cut), "f array<long>, y array<long>")
    return runs.groupBy("f", "y").count().orderBy(F.desc("count"), "f", "y").limit(STRETCHES).collect()


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Fit vocabulary, field and score on a bounded sample; without labels of both kinds every score is the share of toxic ones (0 without any)."""
    chosen = stored(sample(docs, labels, size), "toxic-sample")
    keys, odds = vocabulary(chosen)
    width = 2 + len(PREFIXES)
    model = Model(keys, odds, np.zeros((Model.N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(4))
    rows = _training_stretches(chosen, model) if len(keys) else []
    if rows:
        lengths = np.array([len(r.y) for r in rows])
        features = np.full((len(rows), lengths.max(), width), -1, np.int64)
        gold = np.zeros((len(rows), lengths.max()), np.int64)
        for i, r in enumerate(rows):
            features[i, : lengths[i]] = np.array(r.f).reshape(-1, width)
            gold[i, : lengths[i]] = r.y
        weight = np.array([r["count"] for r in rows], float)
        model.crf = Crf.fit(features, gold, lengths, weight, Model.N_FEATURES, 2)
    parts = model.parts()

    def look(batches_: Iterator) -> Iterator:
        import pyarrow as pa

        m = Model(*parts)
        for batch in batches_:
            for low, high, w in _documents(batch, 0):
                e, _, _ = m.evidence(w, high - low)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in e.T), batch.column(1).slice(low, high - low)], ["a", "b", "c", "d", "toxic"])

    seen = chosen.select(F.col("text").cast("binary"), "toxic").mapInArrow(lean(look), "a double, b double, c double, d double, toxic int").toPandas()
    x, y = seen[["a", "b", "c", "d"]].to_numpy(), (seen["toxic"].to_numpy() > 0).astype(float)
    model.weights = _logistic(x, y) if len(y) else np.array([-30.0, 0, 0, 0])
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge (none on the constant)."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[0.05] * (x.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def scores(docs: DataFrame, model: Model, spans: bool = False, name: str = "toxic_score") -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1) as ``name``; with ``spans`` also toxic_spans: start, end, probability.

    Spans are words of probability one half or more, in bytes of the text's UTF-8. A null text counts as empty; an
    empty one has the score of a text without offending words; every row, also one that repeats or has no id, is scored
    for itself; an empty table gives no rows. A column of ``docs`` that has the name of a result is replaced; give
    another ``name`` (``free_name``) to keep it. Nothing is shuffled.
    """
    import pyarrow as pa

    parts = model.parts()
    made = [name, *["toxic_spans"] * spans]
    kept = [c for c in docs.columns if c.lower() not in made]
    raw = free_name(kept, "__bytes")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def tag(batches_: Iterator) -> Iterator:
        m = Model(*parts)
        for batch in batches_:
            n = batch.num_columns - 1
            for low, high, w in _documents(batch, n):
                e, may, p = m.evidence(w, high - low)
                part = batch.slice(low, high - low)
                columns = [*part.columns[:n], pa.array(m.score(e))]
                if spans:
                    data, borders = column_bytes(part.column(n))
                    rows: list[list] = [[] for _ in range(high - low)]
                    for i, q in zip(may.tolist(), p.tolist()):
                        if q >= 0.5:
                            d = int(w.doc[i])
                            rows[d].append({"start": int(w.start[i] - borders[d]), "end": int(w.end[i] - borders[d]), "p": q})
                    columns.append(pa.array(rows, kind))
                yield pa.RecordBatch.from_arrays(columns, [*kept, *made])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    schema = f"{fields}, `{name}` double" + (", toxic_spans array<struct<start:long,end:long,p:double>>" if spans else "")
    given = docs.select(*kept, F.coalesce("text", F.lit("")).cast("binary").alias(raw))
    return given.mapInArrow(lean(tag), schema)
