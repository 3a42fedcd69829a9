"""Packing by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .tokens import Encoder, default_tokenizer

#: Longest piece of the part of a document that doesn't fill a window of its own.
PIECE = 512
#: Windows per differencing; more windows balance a little better and cost their square.
WINDOWS = 128
#: How full a batch of windows is meant to be before it is differenced.
FILL = 0.996


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each item, by the largest differencing method.

    Every item starts as a partition of its own into ``k`` windows, all but one empty. The two partitions with the
    widest spread are merged again and again, the fullest windows of one onto the emptiest of the other, so that
    their imbalances cancel. Ties go by age, so the result is the same on every run.
    """
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(-sizes, kind="stable")
    start = np.zeros(k, np.int64)
    heap = []
    for age, i in enumerate(order):
        sums, nodes = start.copy(), np.full(k, -1, np.int64)
        sums[-1], nodes[-1] = sizes[i], i
        heap.append((-int(sizes[i]), age, sums, nodes))
    heapq.heapify(heap)
    left, right = [np.full(n, -1, np.int64)], [np.full(n, -1, np.int64)]
    made, age = n, n
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        sums, bn = a + b[::-1], bn[::-1]
        both = np.flatnonzero((an >= 0) & (bn >= 0))
        nodes = np.where(an >= 0, an, bn)
        if len(both):
            left.append(an[both])
            right.append(bn[both])
            nodes[both] = made + np.arange(len(both))
            made += len(both)
        by = np.argsort(sums, kind="stable")
        sums, nodes = sums[by], nodes[by]
        # What all windows share doesn't count towards a spread; sums stay whole all the same.
        heapq.heappush(heap, (int(sums[0] - sums[-1]), age, sums, nodes))
        age += 1
    _, _, _, roots = heap[0]
    left_all, right_all = np.concatenate(left), np.concatenate(right)
    window = np.full(made, -1, np.int64)
    at = np.flatnonzero(roots >= 0)
    window[roots[at]] = at
    for node in range(made - 1, n - 1, -1):
        window[left_all[node]] = window[right_all[node]] = window[node]
    return window[:n]


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Near-equal windows of at most ``capacity``: as few as the sum needs, one more while one overflows."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, sizes, minlength=k).max(initial=0) <= capacity:
            return window, k
        k += 1


class Packer:
    """Cuts documents into pieces and deals the pieces to windows; holds one batch of pieces."""

    def __init__(self, capacity: int, piece: int = PIECE, batch: int = WINDOWS, fill: float = FILL):
        self.capacity, self.piece, self.goal = capacity, min(piece, capacity), int(capacity * batch * fill)
        self.next_window = 0
        self.held: list[tuple[int, int, int]] = []
        self.sum = 0

    def _deal(self) -> list[tuple[int, int, int, int, int]]:
        sizes = np.array([h[2] for h in self.held], np.int64)
        window, k = windows(sizes, self.capacity)
        used = np.zeros(k, np.int64)
        out = []
        for (doc, start, size), w in zip(self.held, window.tolist()):
            out.append((doc, start, size, self.next_window + w, int(used[w])))
            used[w] += size
        self.next_window += k
        self.held, self.sum = [], 0
        return out

    def add(self, doc: int, length: int) -> list[tuple[int, int, int, int, int]]:
        """Finished pieces (doc, start, length, window, offset) after one more document."""
        out, start = [], 0
        while length - start >= self.capacity:
            out.append((doc, start, self.capacity, self.next_window, 0))
            self.next_window += 1
            start += self.capacity
        while start < length:
            size = min(self.piece, length - start, self.goal - self.sum)
            self.held.append((doc, start, size))
            self.sum += size
            start += size
            if self.sum >= self.goal:
                out += self._deal()
        return out

    def finish(self) -> list[tuple[int, int, int, int, int]]:
        return self._deal() if self.held else []


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, tokenizer: str | None = None, piece: int = PIECE, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in windows of at most ``capacity`` ids.

    Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (binary, little-endian
    unsigned 32-bit) if ``with_ids``. Each scan partition is packed on its own, so no text is shuffled; a partition
    holds one batch of pieces. Null texts count as empty (the end id alone); null ids and repeated rows are documents
    like others. An empty table gives no rows.
    """
    tokenizer = tokenizer or default_tokenizer()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, packer = Encoder(tokenizer), Packer(capacity, piece)
        base = TaskContext.get().partitionId() << 32
        names, ids = {}, {}
        number = 0

        def rows(done):
            if not done:
                return
            cols = list(zip(*done))
            cut = [ids[d][4 * s : 4 * (s + n)] for d, s, n in zip(*cols[:3])]
            data = {
                "doc_id": pa.array([names[d] for d in cols[0]], pa.int64()),
                "start": pa.array(cols[1], pa.int64()),
                "length": pa.array(cols[2], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(c) for c in cut], pa.int64()),
                "doc_tokens": pa.array([len(ids[d]) // 4 for d in cols[0]], pa.int64()),
                "sequence_id": pa.array([base + w for w in cols[3]], pa.int64()),
                "offset": pa.array(cols[4], pa.int64()),
            }
            if with_ids:
                data["ids"] = pa.array(cut, pa.binary())
            yield pa.RecordBatch.from_pydict(data)
            keep = {h[0] for h in packer.held}
            for d in [d for d in ids if d not in keep]:
                del ids[d], names[d]

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                done = []
                got, borders = encoder.encode_column(part.column(1))
                flat = np.insert(got, borders[1:], end_id)
                borders = borders + np.arange(len(borders))
                for name, a, b in zip(part.column(0).to_pylist(), borders[:-1].tolist(), borders[1:].tolist()):
                    ids[number], names[number] = flat[a:b].tobytes(), name
                    done += packer.add(number, b - a)
                    number += 1
                yield from rows(done)
        yield from rows(packer.finish())

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(pieces), schema)
