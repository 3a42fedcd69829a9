"""Periodic runs of words by online dyadic square catching.

A text is read word by word. Whenever a block of L words (L a power of two) is complete, a catcher watches the next L
words: with each appended word the text's last L words are compared with the block, by rolling hash. If they agree
after d words, the block and its copy hold a square of period d (they overlap or touch, as d is at most L), which is
reported and merged into its run: the longest stretch around it whose words d apart are identical, found by binary
search over hashed suffixes and prefixes and then verified word by word.

Catchers of level L report periods over L/2 and up to L, so levels share the periods out. Blocks begin at every quarter
of L: a run of four periods or more then holds a whole block of its level with its copy, wherever it starts. A
square inside a run of a lower level has no primitive root and is passed over. All catchers of one level, over all
texts of a batch, take their appended words together: row after row of one matrix of comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, SPACE_BYTES, Words, column_bytes, lean, mix, pieces, powers

#: A run has at least so many periods (blocks at quarters of L serve 4 and more) and so many words.
PERIODS, LEAST = 4, 6
#: Comparisons of catchers with appended words that are made at once.
AT_ONCE = 1 << 22


def catch(values: np.ndarray, borders: np.ndarray, periods: int = PERIODS, least: int = LEAST) -> np.ndarray:
    """Runs of several texts: rows of (text, start, length, period), sorted; ``start`` counts from the text's first word.

    ``values`` has one 64-bit number per word, equal where words are; ``borders`` cuts them into texts.
    """
    if periods < 4:
        raise ValueError("catchers at quarters of their blocks need at least four periods")
    counts = np.diff(borders)
    found = [np.zeros((0, 4), np.int64)]
    level = 1
    while True:
        shortest = level // 2 + 1
        long_enough = np.flatnonzero(counts >= periods * shortest)
        if not len(long_enough):
            break
        # texts too short for this level's periods are left out from here on
        take = np.repeat(np.isin(np.arange(len(counts)), long_enough), counts)
        own, first = values[take], np.append(0, np.cumsum(counts[long_enough]))
        known = np.concatenate(found)
        at = np.searchsorted(long_enough, known[:, 0])
        known = known[np.append(long_enough, -1)[at] == known[:, 0]]
        new = _level(own, first, level, _covered(known, long_enough, first, len(own)))
        new = new[new[:, 2] >= periods * new[:, 3]]
        new[:, 0] = long_enough[new[:, 0]]
        found.append(new)
        level *= 2
    runs = np.concatenate(found)
    runs = runs[runs[:, 2] >= least]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _covered(known: np.ndarray, texts: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """For each word the furthest end of a known run that starts at it or before it."""
    start = first[np.searchsorted(texts, known[:, 0])] + known[:, 1]
    reach = np.zeros(n + 1, np.int64)
    np.maximum.at(reach, start, start + known[:, 2])
    return np.maximum.accumulate(reach)


def _level(values: np.ndarray, first: np.ndarray, level: int, covered: np.ndarray) -> np.ndarray:
    """Maximal stretches of periods over ``level`` / 2 and up to ``level`` around the squares that the catchers report."""
    n = len(values)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])

    def hashed(start, size):
        return (sums[start + size] - sums[start]) * down[start]

    ends = np.repeat(first[1:], np.diff(first))  # of the text of each word
    starts = np.repeat(first[:-1], np.diff(first))
    suffix = hashed(np.arange(n - level + 1), level) if n >= level else np.zeros(0, np.uint64)
    lags = np.arange(level // 2 + 1, level + 1)
    # blocks start at quarters of the level, counted from their text's start
    step = max(1, level // 4)
    block = np.flatnonzero((np.arange(n) - starts) % step == 0)
    block = block[block + level + lags[0] <= ends[block]]
    blocks, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = max(1, AT_ONCE // len(lags))
    for low in range(0, len(block), rows):
        some = block[low : low + rows]
        place = some[:, None] + lags[None]
        same = (place + level <= ends[some][:, None]) & (suffix[np.minimum(place, len(suffix) - 1)] == suffix[some][:, None])
        i, j = np.nonzero(same)
        i, d = some[i], lags[j]
        fresh = covered[i] < i + level + d
        blocks.append(i[fresh])
        periods.append(d[fresh])
    i, d = np.concatenate(blocks), np.concatenate(periods)
    # merge the squares of one run: of one period, each beginning before the one before it ends
    by = np.lexsort((i, d))
    i, d = i[by], d[by]
    head = np.append(True, (d[1:] != d[:-1]) | (i[1:] > i[:-1] + level)) if len(i) else np.zeros(0, bool)
    i, d = i[head], d[head]
    right = _furthest(lambda k: hashed(i, k) == hashed(i + d, k), ends[i] - i - d) if len(i) else i
    left = _furthest(lambda k: hashed(i - k, k) == hashed(i + d - k, k), i - starts[i]) if len(i) else i
    a, b = i - left, i + d + right
    stretch = np.unique(np.stack([a, b, d], axis=1), axis=0)
    checked = [_verified(values, *s) for s in stretch.tolist()]
    out = np.array([s for s in checked if s], np.int64).reshape(-1, 3)
    text = np.searchsorted(first, out[:, 0], "right") - 1
    return np.stack([text, out[:, 0] - first[text], out[:, 1] - out[:, 0], out[:, 2]], axis=1)


def _furthest(agree, most: np.ndarray) -> np.ndarray:
    """The largest k, up to ``most``, for which ``agree``(k) holds, by binary search (it holds for all smaller ones)."""
    low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        ok = agree(middle)
        low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
    return low


def _verified(values: np.ndarray, a: int, b: int, d: int) -> tuple[int, int, int] | None:
    """The stretch if its words ``d`` apart are identical; after a collision of hashes its longest part that is right."""
    wrong = np.flatnonzero(values[a : b - d] != values[a + d : b])
    if not len(wrong):
        return a, b, d
    cuts = np.concatenate([[-1], wrong, [b - d - a]])
    k = int(np.argmax(np.diff(cuts)))
    start = a + int(cuts[k]) + 1
    end = a + int(cuts[k + 1]) + d
    return (start, end, d) if end - start >= 2 * d else None


def repeated_words(runs: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Which words some run contains after its first period."""
    n = int(borders[-1])
    start = borders[runs[:, 0]] + runs[:, 1]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start + runs[:, 3], 1)
    np.add.at(step, start + runs[:, 2], -1)
    return np.cumsum(step[:-1]) > 0


def _joined(w: Words, data: np.ndarray, keep: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text, with single blanks between them, and where each text ends."""
    start, size, doc = w.start[keep], (w.end - w.start)[keep], w.doc[keep]
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    wide = size + ~last
    to = np.cumsum(wide) - wide
    out = np.full(int(wide.sum()), 0x20, np.uint8)
    inside = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    target = np.repeat(to - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    out[target] = data[inside]
    return out, np.append(0, np.cumsum(np.bincount(doc, weights=wide, minlength=docs).astype(np.int64)))


def periodic_runs(docs: DataFrame, periods: int = PERIODS, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period) and collapsed of ``docs`` (doc_id, text).

    Words are stretches without white space (bytes 9 to 13 and 32), told apart with their case, by 64-bit hash. A run is
    a stretch of at least ``least`` words and ``periods`` times its smallest period that can't be longer on either side.
    ``collapsed`` has the words that no run contains after its first period, joined by one blank. A null or empty text,
    or one of white space only, has no words, no runs and an empty ``collapsed``; rows that repeat each get their own
    result; texts are read whole, of any length; further columns don't matter; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            data, borders = column_bytes(batch.column(1))
            for low, high in pieces(borders, CHUNK_BYTES):
                cut = borders[low : high + 1]
                own = data[cut[0] : cut[-1]]
                w = Words(own, cut - cut[0], SPACE_BYTES, lower=False)
                runs = catch(mix(w.hash), w.first, periods, least)
                text, ends = _joined(w, own, ~repeated_words(runs, w.first), high - low)
                offsets = np.append(0, np.cumsum(np.bincount(runs[:, 0], minlength=high - low))).astype(np.int32)
                each = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(offsets), each)
                texts = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(text.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.diff(w.first).astype(np.int64)), listed, texts],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(lean(look), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
