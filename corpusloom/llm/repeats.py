"""Removal of long byte strings that start more than once in the corpus.

Equal strings of ``LENGTH`` bytes choose the same anchor: the run of ``GRAM`` bytes of least hash within them. A run of
neighbouring strings with one anchor is kept together with its bytes, and runs are met by anchor, shard by shard, so
all places of a string are in one shard. There, equal runs are told at once by their bytes; runs that share an anchor
but differ are laid end to end and suffix-sorted (``induced``), and neighbours with a common prefix of ``LENGTH`` mark
strings that occur again. An anchor with more than ``HOT`` runs (a passage in a great part of all documents) would
make its shard too large; its strings are counted by their hash instead, spread over all shards. Nothing is capped.

Documents are dealt to blocks once. A block asks which anchors occur again, sends the runs of those, and applies the
answers to its own texts; every question and answer names strings by their hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, byte_codes, column_bytes, lean_group, mix, pieces, plan_bytes, powers
from .induced import repeated

LENGTH, GRAM = 200, 50
#: Runs of an anchor from which its strings are counted by hash.
HOT = 512
#: String starts looked at in one go (an anchor's place must fit 24 bits).
STEP = 4 << 20


class Runs:
    """Runs of neighbouring strings of ``LENGTH`` bytes with one anchor: first and last start, the anchor's hash."""

    def __init__(self, data: np.ndarray, borders: np.ndarray):
        n = len(data)
        self.data = data
        none = np.zeros(0, np.int64)
        self.first, self.last, self.anchor = none, none, none.astype(np.uint64)
        if n < LENGTH:
            return
        up, down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte_codes()[data] * up[:n], out=self.sums[1:])
        gram = self.hashes(np.arange(n - GRAM + 1), GRAM)
        outside = np.zeros(n + 1, np.int8)
        low = np.maximum(borders[1:] - LENGTH + 1, borders[:-1])
        some = borders[1:] > low
        outside[low[some]] += 1
        outside[borders[1:][some]] -= 1
        valid = np.cumsum(outside[:n], dtype=np.int8)[: n - LENGTH + 1] == 0
        first, last, anchor = [], [], []
        width = LENGTH - GRAM + 1
        for a in range(0, n - LENGTH + 1, STEP):
            b = min(a + STEP, n - LENGTH + 1)
            size = b - a + width - 1
            least = (gram[a : a + size] >> np.uint64(24) << np.uint64(24)) | np.arange(size, dtype=np.uint64)
            span = 1
            while 2 * span <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            least = np.minimum(least[: b - a], least[width - span :][: b - a])
            place = (least & np.uint64(0xFFFFFF)).astype(np.int64) + a
            ok = valid[a:b]
            new = ok & np.append(True, (place[1:] != place[:-1]) | ~ok[:-1])
            end = ok & np.append((place[1:] != place[:-1]) | ~ok[1:], True)
            start = np.flatnonzero(new)
            first.append(start + a)
            last.append(np.flatnonzero(end) + a)
            anchor.append(gram[place[start]])
        self.first, self.last, self.anchor = np.concatenate(first), np.concatenate(last), np.concatenate(anchor)

    def hashes(self, start: np.ndarray, size) -> np.ndarray:
        down = powers(len(self.sums))[1]
        return mix((self.sums[start + size] - self.sums[start]) * down[start] + np.uint64(1) * np.asarray(size, np.uint64))

    def content(self, some: np.ndarray) -> np.ndarray:
        """Hash of a run's anchor and bytes."""
        return mix(self.hashes(self.first[some], self.last[some] - self.first[some] + LENGTH) ^ mix(self.anchor[some]))


def _chunks(column):
    data, borders = column_bytes(column)
    for low, high in pieces(borders, CHUNK_BYTES):
        cut = borders[low : high + 1]
        yield low, high, Runs(data[cut[0] : cut[-1]], cut - cut[0]), cut - cut[0]


def _among(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys


def _u8(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(b or b"" for b in blobs), "<u8").astype(np.uint64)


def _u4(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(b or b"" for b in blobs), "<u4").astype(np.int64)


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    distinct, back = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(back, counts, minlength=len(distinct)).astype(np.int64)


def _by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``keys`` by shard, and where each shard begins in it."""
    shard = (keys % np.uint64(shards)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    return by, np.searchsorted(shard[by], np.arange(shards + 1))


def anchors_asked(blocks: DataFrame, shards: int) -> DataFrame:
    def ask(key, table):
        import pyarrow as pa

        parts = []
        for _, _, runs, _ in _chunks(table.column("text")):
            parts.append(np.unique(runs.anchor, return_counts=True))
        keys, counts = _merged(parts)
        by, cuts = _by_shard(keys, shards)
        some = np.flatnonzero(np.diff(cuts))
        cut = lambda x, kind: pa.array([x[by[cuts[i] : cuts[i + 1]]].astype(kind).tobytes() for i in some], pa.binary())
        return pa.Table.from_arrays([pa.array(some.astype(np.int32)), pa.array([key[0].as_py()] * len(some), pa.int32()), cut(keys, "<u8"), cut(counts, "<u4")], ["shard", "block", "keys", "counts"])

    return blocks.groupBy("block").applyInArrow(lean_group(ask), "shard int, block int, keys binary, counts binary")


def anchors_answered(asks: DataFrame) -> DataFrame:
    """Per block those of its anchors that several runs have (``again``) and that more than ``HOT`` have (``hot``)."""

    def answer(key, table):
        import pyarrow as pa

        blobs = table.column("keys").to_pylist()
        keys, back = np.unique(_u8(blobs), return_inverse=True)
        total = np.bincount(back, _u4(table.column("counts").to_pylist()), minlength=len(keys))[back]
        cuts = np.cumsum([0, *(len(b) // 8 for b in blobs)])
        again, hot = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own, n = keys[back[a:b]], total[a:b]
            again.append(own[(n > 1) & (n <= HOT)].astype("<u8").tobytes())
            hot.append(own[n > HOT].astype("<u8").tobytes())
        out = pa.Table.from_arrays([table.column("block").combine_chunks(), pa.array(again, pa.binary()), pa.array(hot, pa.binary())], ["block", "again", "hot"])
        return out.filter(pa.array([bool(x or y) for x, y in zip(again, hot)], pa.bool_()))

    return asks.groupBy("shard").applyInArrow(lean_group(answer), "block int, again binary, hot binary")


SENT = "shard int, block int, anchors binary, contents binary, counts binary, sizes binary, bytes binary, strings binary, string_counts binary, hot binary"


def runs_sent(blocks: DataFrame, answers: DataFrame, shards: int) -> DataFrame:
    """Per block and shard: distinct runs with a shared anchor, strings of hot anchors by hash; the hot anchors to one shard."""

    def send(key, texts, found):
        import pyarrow as pa

        again, hot = (np.unique(_u8(found.column(c).to_pylist())) for c in ("again", "hot"))
        if not len(again) + len(hot):
            return pa.Table.from_pylist([], pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.binary()) for c in SENT.split(", ")]))
        number: dict[int, int] = {}
        anchors, contents, counts, data, strings = [], [], [], [], []
        for _, _, runs, _ in _chunks(texts.column("text")):
            some = np.flatnonzero(_among(again, runs.anchor))
            for i, c in zip(some.tolist(), runs.content(some).tolist()) if len(some) else ():
                at = number.setdefault(c, len(data))
                if at == len(data):
                    anchors.append(runs.anchor[i])
                    contents.append(c)
                    counts.append(0)
                    data.append(runs.data[runs.first[i] : runs.last[i] + LENGTH].tobytes())
                counts[at] += 1
            some = np.flatnonzero(_among(hot, runs.anchor))
            if len(some):
                strings.append(np.unique(runs.hashes(_spread(runs.first[some], runs.last[some])[0], LENGTH), return_counts=True))
        anchor, content, count = np.array(anchors, np.uint64), np.array(contents, np.uint64), np.array(counts, np.int64)
        string, times = _merged(strings)
        by, cuts = _by_shard(anchor, shards)
        by_s, cuts_s = _by_shard(string, shards)
        rows = []
        home = key[0].as_py() % shards
        for s in range(shards):
            own, own_s = by[cuts[s] : cuts[s + 1]], by_s[cuts_s[s] : cuts_s[s + 1]]
            if len(own) or len(own_s) or s == home and len(hot):
                blobs = [data[i] for i in own.tolist()]
                row = [anchor[own].astype("<u8"), content[own].astype("<u8"), count[own].astype("<u4"), np.array([len(b) for b in blobs], "<u4")]
                rows.append([s, key[0].as_py(), *(x.tobytes() for x in row), b"".join(blobs), string[own_s].astype("<u8").tobytes(), times[own_s].astype("<u4").tobytes(), hot.astype("<u8").tobytes() if s == home else b""])
        names = [c.split()[0] for c in SENT.split(", ")]
        return pa.Table.from_arrays([pa.array(c, pa.int32() if i < 2 else pa.binary()) for i, c in enumerate(zip(*rows))] if rows else [pa.array([], pa.int32() if i < 2 else pa.binary()) for i in range(len(names))], names)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean_group(send), SENT)


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [first, last], and the range of each."""
    size = last - first + 1
    which = np.repeat(np.arange(len(size)), size)
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum())), which


def repeats_found(sent: DataFrame) -> DataFrame:
    """Per block: its runs with repeated strings (content, starts as pairs of first and last within the run), repeated hot strings, hot anchors."""

    def find(key, table):
        import pyarrow as pa

        column = {c: table.column(c).to_pylist() for c in table.column_names}
        sizes = [len(b) // 8 for b in column["contents"]]
        anchors, contents = _u8(column["anchors"]), _u8(column["contents"])
        counts, lengths = _u4(column["counts"]), _u4(column["sizes"])
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(column["bytes"]), np.uint8)
        distinct, sample, back = np.unique(contents, return_index=True, return_inverse=True)
        total = np.bincount(back, counts, minlength=len(distinct))
        # an anchor with one content has nothing to be compared with
        _, group, size = np.unique(anchors[sample], return_inverse=True, return_counts=True)
        compared = np.flatnonzero((size[group] > 1) if len(sample) else np.zeros(0, bool))
        ranges: dict[int, list[int]] = {int(i): [0, int(lengths[sample[i]]) - LENGTH] for i in np.flatnonzero(total > 1)}
        if len(compared):
            laid, first, at = [], {}, 0
            for i in compared.tolist():
                s = sample[i]
                laid += [data[ends[s] - lengths[s] : ends[s]], np.array([0xFF], np.uint8)]
                first[i] = at
                at += int(lengths[s]) + 1
            marked = repeated(np.concatenate(laid), LENGTH)
            for i, at in first.items():
                if i not in ranges:
                    own = marked[at : at + int(lengths[sample[i]]) - LENGTH + 1]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                    if len(edge):
                        ranges[i] = (edge - np.arange(len(edge)) % 2).tolist()
        string, back_s = np.unique(_u8(column["strings"]), return_inverse=True)
        many = np.bincount(back_s, _u4(column["string_counts"]), minlength=len(string)) > 1
        out, at, at_s = [], 0, 0
        for k, (block, n) in enumerate(zip(column["block"], sizes)):
            hits = [(int(contents[j]), ranges[int(back[j])]) for j in range(at, at + n) if int(back[j]) in ranges]
            own = back_s[at_s : at_s + len(column["strings"][k]) // 8]
            at, at_s = at + n, at_s + len(own)
            own = string[own[many[own]]]
            if hits or len(own) or column["hot"][k]:
                out.append([block, np.array([c for c, _ in hits], "<u8").tobytes(), np.array([len(r) for _, r in hits], "<u4").tobytes(), np.array([x for _, r in hits for x in r], "<u4").tobytes(), own.astype("<u8").tobytes(), column["hot"][k]])
        kinds = [pa.int32(), *[pa.binary()] * 5]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(6)], ["block", "contents", "counts", "ranges", "strings", "hot"])

    return sent.groupBy("shard").applyInArrow(lean_group(find), "block int, contents binary, counts binary, ranges binary, strings binary, hot binary")


def repeated_spans(docs: DataFrame, block_bytes: int = 12 << 20, with_text: bool = False) -> DataFrame:
    """What remains of ``docs`` (doc_id, text) when each byte covered by a repeated string of 200 bytes goes.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and, ``with_text``, spans (byte
    pairs from, to) and kept (binary). Texts are bytes of UTF-8; strings never cross documents and are judged on what is
    given. A null text counts as empty. Rows that repeat are documents of their own, so they remove each other's long
    strings. An empty table gives no rows.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(parts, plan_bytes(docs) // block_bytes + 1)
    shards = max(256, blocks)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.cast("binary").alias("text"), F.pmod(F.xxhash64("doc_id", text), F.lit(blocks)).cast("int").alias("block"))
    answers = anchors_answered(anchors_asked(rows, shards))
    found = repeats_found(runs_sent(rows, answers, shards))
    kind = docs.schema["doc_id"].dataType.simpleString()
    pair = pa.list_(pa.list_(pa.int64()))

    def cut(key, texts, answer):
        contents, counts, ranges = _u8(answer.column("contents").to_pylist()), _u4(answer.column("counts").to_pylist()), _u4(answer.column("ranges").to_pylist())
        first_range = np.cumsum(counts) - counts
        by = np.argsort(contents)
        contents, counts, first_range = contents[by], counts[by], first_range[by]
        strings, hot = (np.unique(_u8(answer.column(c).to_pylist())) for c in ("strings", "hot"))
        n_bytes, n_removed, n_spans, digests, spans, kept = [], [], [], [], [], []
        for low, high, runs, borders in _chunks(texts.column("text")):
            n = len(runs.data)
            starts, stops = [], []
            if len(contents) and len(runs.first):
                content = runs.content(np.arange(len(runs.first)))
                hit = np.flatnonzero(_among(contents, content))
                at = np.searchsorted(contents, content[hit])
                place, which = _spread(first_range[at], first_range[at] + counts[at] - 1)
                value = ranges[place] + runs.first[hit][which]
                starts.append(value[0::2])
                stops.append(value[1::2] + LENGTH)
            some = np.flatnonzero(_among(hot, runs.anchor)) if len(hot) else []
            if len(some):
                place, _ = _spread(runs.first[some], runs.last[some])
                place = place[_among(strings, runs.hashes(place, LENGTH))]
                starts.append(place)
                stops.append(place + LENGTH)
            depth = np.zeros(n + 1, np.int64)
            if starts:
                depth += np.bincount(np.concatenate(starts), minlength=n + 1) - np.bincount(np.concatenate(stops), minlength=n + 1)
            gone = np.cumsum(depth[:n]) > 0
            before = np.append(False, gone[:-1]) if n else gone
            begin = gone & ~before
            inner = borders[:-1][borders[:-1] < n]
            begin[inner] = gone[inner]
            left = runs.data[~gone]
            sums = np.append(0, np.cumsum(gone))[borders]
            removed = np.diff(sums)
            edges = borders - sums
            n_bytes.append(np.diff(borders))
            n_removed.append(removed)
            n_spans.append(np.diff(np.append(0, np.cumsum(begin))[borders]))
            parts = [left[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            digests += [hashlib.sha256(p).hexdigest() for p in parts]
            if with_text:
                kept += parts
                for a, b in zip(borders[:-1], borders[1:]):
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]])))
                    spans.append(edge.reshape(-1, 2).tolist())
        join = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
        columns = [texts.column("doc_id").combine_chunks(), join(n_bytes), join(n_removed), join(n_spans), pa.array(digests, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns += [pa.array(spans, pair), pa.array(kept, pa.binary())]
            names += ["spans", "kept"]
        return pa.Table.from_arrays(columns, names)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<array<long>>, kept binary" if with_text else "")
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lean_group(cut), schema)
