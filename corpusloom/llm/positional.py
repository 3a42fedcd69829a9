"""Decontamination over a positional inverted index.

The index is cut by documents: a segment holds the postings of a few MB of text, every term's positions in it, and
is one stored row. Phrases are found segment by segment, so a term in a third of all documents is as well spread as
any other, and no postings are shuffled. Only where the test windows fill several blocks are the matches, one narrow
row per document, shuffled to be united.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, NON_WORD_BYTES, Words, column_bytes, lean, pieces, shared_folder, stored

#: Empty positions between two documents of a segment; no phrase or slop may be longer.
GAP = 1024
#: Test windows sent to every task at once; a larger test set is searched for in several blocks.
BLOCK_WINDOWS = 500_000
#: Test windows of one stored word run.
RUN_WINDOWS = 1 << 16
#: Test windows met with a segment's postings at once.
FIND_WINDOWS = 1 << 16

SEGMENT = "segment long, docs binary, doc_starts binary, doc_words binary, terms binary, term_starts binary, postings binary"
MATCH = "segment long, place int, doc_id long, n_words long, spans array<array<long>>, items array<string>"


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of the positional index of ``docs`` (doc_id, text), every term with all its positions.

    Null texts have no words. Null ids are kept as the least long. Rows that share an id are documents of their own:
    a document is known by its segment's number and its place there. Numbers are given anew by each run, so an index
    is stored before it is used twice.
    """

    def segments(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, borders = column_bytes(batch.column(1))
            ids = np.array([-(1 << 63) if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            for low, high in pieces(borders, CHUNK_BYTES):
                cut = borders[low : high + 1]
                w = Words(data[cut[0] : cut[-1]], cut - cut[0], NON_WORD_BYTES)
                counts = np.diff(w.first)
                starts = w.first[:-1] + GAP * np.arange(len(counts))
                place = (np.arange(len(w.hash)) + GAP * w.doc).astype(np.uint32)
                by = np.argsort(w.hash, kind="stable")
                terms, first = np.unique(w.hash[by], return_index=True)
                row = [ids[low:high], starts.astype(np.int64), counts.astype(np.int64), terms, first.astype(np.uint32), place[by]]
                columns = [pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in row)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SEGMENT.split(", ")])
                number += 1

    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(lean(segments), SEGMENT)


class Phrases:
    """Test windows: for each its item, length and place in ``words``, which numbers the hashed terms of ``vocabulary``.

    Made of (item, hashed words) runs; a run of fewer than ``width`` words is one window.
    """

    def __init__(self, runs: list[tuple[str, np.ndarray]], width: int):
        sizes = np.array([len(h) for _, h in runs], np.int64)
        windows = np.maximum(sizes - width + 1, 1)
        numbers = {name: n for n, name in enumerate(dict.fromkeys(name for name, _ in runs))}
        self.width = width
        self.names = list(numbers)
        self.item = np.repeat(np.array([numbers[name] for name, _ in runs], np.int64), windows)
        self.length = np.repeat(np.minimum(sizes, width), windows)
        self.start = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        self.vocabulary, words = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h in runs)]), return_inverse=True)
        self.words = words.astype(np.int32)


def find(segment: dict[str, np.ndarray], phrases: Phrases | SimpleNamespace, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, position of its first word) of all matches in a segment.

    The postings of a phrase's rarest term in the segment give its candidates; those of each further term, shifted
    by its offset, are met with them, in the order of their length. With ``slop`` a term may stand up to that many
    words off its place (proximity).
    """
    terms, starts, postings = segment["terms"], segment["term_starts"].astype(np.int64), segment["postings"].astype(np.int64)
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(phrases.item):
        return none, none
    ends = np.append(starts[1:], len(postings))
    number = np.searchsorted(terms, phrases.vocabulary)
    number[number == len(terms)] = 0
    known = np.append(0, np.cumsum((terms[number] == phrases.vocabulary)[phrases.words]))
    alive = np.flatnonzero(known[phrases.start + phrases.length] - known[phrases.start] == phrases.length)
    if not len(alive):
        return none, none
    keys = np.repeat(np.arange(len(terms)), ends - starts) << 32 | postings
    found = [_met(alive[a : a + FIND_WINDOWS], phrases, number, starts, ends, postings, keys, slop) for a in range(0, len(alive), FIND_WINDOWS)]
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _met(alive: np.ndarray, phrases: Phrases | SimpleNamespace, number: np.ndarray, starts: np.ndarray, ends: np.ndarray, postings: np.ndarray, keys: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """``find`` for the windows ``alive``, all of whose terms the segment has."""
    width = phrases.width
    length = phrases.length[alive][:, None]
    used = np.arange(width) < length
    term = number[phrases.words[phrases.start[alive][:, None] + np.minimum(np.arange(width), length - 1)]]
    count = np.where(used, (ends - starts)[term], np.iinfo(np.int64).max)
    order = np.argsort(count, axis=1, kind="stable")
    rows = np.arange(len(alive))
    rare = order[:, 0]
    t = term[rows, rare]
    size = (ends - starts)[t]
    phrase = np.repeat(rows, size)
    at = np.repeat(starts[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    place = postings[at] - rare[phrase]
    for rank in range(1, width):
        off = order[phrase, rank]
        real = used[phrase, off]
        want = term[phrase, off] << 32 | np.maximum(place + off - slop, 0)
        got = np.searchsorted(keys, want)
        hit = got < len(keys)
        hit[hit] = keys[got[hit]] <= want[hit] + (slop + np.minimum(place + off, slop))[hit] if slop else keys[got[hit]] == want[hit]
        keep = (~real | hit) & ((place >= 0) | (slop > 0))
        phrase, place = phrase[keep], place[keep]
    keep = place >= 0 if not slop else np.ones(len(place), bool)
    return alive[phrase[keep]], place[keep]


def _hashes(data: np.ndarray) -> Iterator[np.ndarray]:
    """The hashed words of a text in order, piece by piece; no piece ends inside a word."""
    outside = np.zeros(256, bool)
    outside[np.frombuffer(NON_WORD_BYTES, np.uint8)] = True
    low = 0
    while low < len(data):
        high = min(low + CHUNK_BYTES, len(data))
        while high < len(data) and not outside[data[high]]:
            ends = np.flatnonzero(outside[data[high : high + CHUNK_BYTES]])
            high = high + int(ends[0]) if len(ends) else min(high + CHUNK_BYTES, len(data))
        yield Words(data[low:high], np.array([0, high - low], np.int64), NON_WORD_BYTES).hash
        low = high


def word_runs(items: DataFrame, width: int) -> DataFrame:
    """(item, words): hashed words of the items in runs of a bounded number of windows, which overlap by ``width`` - 1 words.

    An item of fewer than ``width`` words, but not none, is one run.
    """

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def runs(data: np.ndarray) -> Iterator[np.ndarray]:
            held, whole = np.zeros(0, np.uint64), True
            for more in _hashes(data):
                held = np.concatenate([held, more])
                while len(held) >= width:
                    windows = min(len(held) - width + 1, RUN_WINDOWS)
                    yield held[: windows + width - 1]
                    held, whole = held[windows:], False
            if whole and len(held):
                yield held

        def rows(names: list, blobs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(blobs, pa.binary())], ["item", "words"])

        for batch in batches:
            data, borders = column_bytes(batch.column(1))
            names, blobs, size = [], [], 0
            for i, name in enumerate(batch.column(0).to_pylist()):
                for run in runs(data[borders[i] : borders[i + 1]]):
                    names.append(name)
                    blobs.append(run.tobytes())
                    size += len(blobs[-1])
                    if size >= CHUNK_BYTES:
                        yield rows(names, blobs)
                        names, blobs, size = [], [], 0
            if names:
                yield rows(names, blobs)

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return named.mapInArrow(lean(cut), "item string, words binary")


def phrase_blocks(items: DataFrame, width: int, block_windows: int = BLOCK_WINDOWS) -> Iterator[Phrases]:
    """All test windows in blocks of ``block_windows``; the last may have fewer, and none only if there are none at all."""
    held, windows, some = [], 0, False
    for row in stored(word_runs(items, width), "windows").toLocalIterator():
        h = np.frombuffer(row.words, np.uint64)
        while len(h):
            take = min(max(1, len(h) - width + 1), block_windows - windows)
            held.append((row.item, h[: take + width - 1]))
            windows += take
            h = h[take:] if len(h) - take >= width else h[:0]
            if windows >= block_windows:
                yield Phrases(held, width)
                held, windows, some = [], 0, True
    if held or not some:
        yield Phrases(held, width)


def matches(index: DataFrame, phrases: Phrases, slop: int = 0) -> DataFrame:
    """Per document with words or not: segment, place in it, doc_id, n_words, hit spans [from, to) in words, and items, of one block of phrases."""
    shared = index.sparkSession.sparkContext.broadcast(vars(phrases))
    kinds = {"docs": "<i8", "doc_starts": "<i8", "doc_words": "<i8", "terms": "<u8", "term_starts": "<u4", "postings": "<u4"}

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        p = SimpleNamespace(**shared.value)
        for batch in batches:
            for n in range(batch.num_rows):
                s = {k: np.frombuffer(batch.column(k)[n].as_buffer(), kind) for k, kind in kinds.items()}
                phrase, place = find(s, p, slop)
                place = np.maximum(place, 0)
                doc = np.searchsorted(s["doc_starts"], place, "right") - 1
                spans: list[list] = [[] for _ in s["docs"]]
                items: list[set] = [set() for _ in s["docs"]]
                low = place - s["doc_starts"][doc]
                high = low + p.length[phrase]
                by = np.lexsort((high, low, doc))
                for d, i, a, b in zip(doc[by].tolist(), p.item[phrase[by]].tolist(), low[by].tolist(), high[by].tolist()):
                    items[d].add(i)
                    if spans[d] and a <= spans[d][-1][1]:
                        spans[d][-1][1] = max(b, spans[d][-1][1])
                    else:
                        spans[d].append([a, b])
                docs = [None if d == -(1 << 63) else d for d in s["docs"].tolist()]
                number = [batch.column("segment")[n].as_py()] * len(docs)
                yield pa.RecordBatch.from_pydict({"segment": pa.array(number, pa.int64()), "place": pa.array(range(len(docs)), pa.int32()), "doc_id": pa.array(docs, pa.int64()), "n_words": pa.array(s["doc_words"], pa.int64()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "items": pa.array([sorted({p.names[i] for i in x}) for x in items], pa.list_(pa.string()))})

    return index.mapInArrow(lean(search), MATCH)


def _united(found: DataFrame) -> DataFrame:
    """The matches of several blocks as one row per document (segment and place), as one block would give them."""

    def unite(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            spans, items = [], []
            for parts in batch.column(4).to_pylist():
                one: list[list] = []
                for a, b in sorted(x for part in parts for x in part):
                    if one and a <= one[-1][1]:
                        one[-1][1] = max(b, one[-1][1])
                    else:
                        one.append([a, b])
                spans.append(one)
            for parts in batch.column(5).to_pylist():
                items.append(sorted({x for part in parts for x in part}))
            columns = [*batch.columns[:4], pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in MATCH.split(", ")])

    groups = found.groupBy("segment", "place", "doc_id", "n_words").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    return groups.mapInArrow(lean(unite), MATCH)


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, slop: int = 0) -> DataFrame:
    """Exact (``slop`` 0) or proximity matches of the items' windows in ``docs``.

    Returns one row per row of ``docs``: doc_id, n_words, n_hit (words inside a match), spans, items (ids as strings,
    sorted). An item of fewer than ``width`` words, but not none, is one window; null and empty texts have no words; an
    empty item table leaves every document with no hits. A test set beyond ``BLOCK_WINDOWS`` is searched for block by
    block, and the spans are united per row, whatever its id.
    """
    index = stored(build_index(docs), "postings")
    blocks = phrase_blocks(items, width)
    found = matches(index, next(blocks), slop)
    path = None
    for phrases in blocks:
        if path is None:
            path = shared_folder(docs.sparkSession, "matches")
            found.write.parquet(path)
        matches(index, phrases, slop).where(F.size("spans") > 0).write.mode("append").parquet(path)
    if path is not None:
        found = _united(docs.sparkSession.read.schema(MATCH).parquet(path))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])
    return found.withColumn("n_hit", hit).select("doc_id", "n_words", "n_hit", "spans", "items")


def is_contaminated(n_hit, n_words):
    """A twentieth of the words or more, and at least one, inside test windows."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
