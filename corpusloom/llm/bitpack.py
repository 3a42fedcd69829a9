"""Token files: ids in fixed-width bit fields, in blocks whose places are listed.

A file is ``CLTK``, the payload, and a footer (see ``Writer.close``). A block holds ``BLOCK`` ids (the last one may
be padded with zeros) in ``BLOCK * bits / 64`` little-endian 64-bit words; ``block_offsets`` are byte places in the
file, ``doc_offsets`` the first id of each document, so any range of ids is read from the blocks that hold it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import lean, shared_folder, stored
from .tokens import Encoder, default_tokenizer

BLOCK = 4096
MAGIC = b"CLTK"
TAIL = np.dtype([("bits", "<u4"), ("docs", "<u4"), ("blocks", "<u4"), ("block", "<u4"), ("ids", "<u8")])


def bits_for(vocabulary: int) -> int:
    """The least bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Whole groups of 64 ids, each in ``bits`` 64-bit words."""
    v = ids.astype(np.uint64).reshape(-1, 64)
    out = np.zeros((len(v), bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= v[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes, bits: int) -> np.ndarray:
    """The inverse of ``pack``."""
    w = np.frombuffer(data, "<u8").astype(np.uint64).reshape(-1, bits)
    out = np.zeros((len(w), 64), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, j] = w[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            out[:, j] |= w[:, word + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << bits) - 1)).astype(np.uint32).ravel()


def file_system(path: str):
    """Arrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer:
    """Appends documents to one file; holds one block and the document offsets in memory."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.rest = np.zeros(0, np.uint32)
        self.docs: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.blocks: list[int] = []
        self.place = len(MAGIC)
        self.ids = 0
        stream.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs.append(np.array([-(1 << 63) if d is None else d for d in doc_ids], "<i8"))
        self.lengths += lengths.tolist()
        flat = np.concatenate([self.rest, ids])
        self.ids += len(ids)
        full = len(flat) // BLOCK * BLOCK
        self._put(flat[:full])
        self.rest = flat[full:]

    def _put(self, ids: np.ndarray) -> None:
        if len(ids):
            data, size = pack(ids, self.bits), BLOCK * self.bits // 8
            self.blocks += [self.place + k * size for k in range(len(ids) // BLOCK)]
            self.stream.write(data)
            self.place += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._put(np.concatenate([self.rest, np.zeros(-len(self.rest) % BLOCK, np.uint32)]))
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, "<i8")
        offsets = np.zeros(len(docs) + 1, "<u8")
        offsets[1:] = np.cumsum(self.lengths)
        tail = np.array([(self.bits, len(docs), len(self.blocks), BLOCK, self.ids)], TAIL)
        self.stream.write(docs.tobytes() + offsets.tobytes() + np.array(self.blocks, "<u8").tobytes() + tail.tobytes() + MAGIC)
        self.stream.close()


class Reader:
    """Random access to one file."""

    def __init__(self, path: str):
        files, place = file_system(path)
        self.file = files.open_input_file(place)
        size = self.file.size()
        end = self._at(size - TAIL.itemsize - len(MAGIC), TAIL.itemsize + len(MAGIC))
        if end[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{path} is no token file")
        tail = np.frombuffer(end[: -len(MAGIC)], TAIL)[0]
        self.bits, self.block, self.ids = int(tail["bits"]), int(tail["block"]), int(tail["ids"])
        n, k = int(tail["docs"]), int(tail["blocks"])
        foot = self._at(size - len(end) - 8 * (2 * n + 1 + k), 8 * (2 * n + 1 + k))
        self.docs = np.frombuffer(foot, "<i8", n)
        self.doc_offsets = np.frombuffer(foot, "<u8", n + 1, 8 * n).astype(np.int64)
        self.block_offsets = np.frombuffer(foot, "<u8", k, 8 * (2 * n + 1)).astype(np.int64)

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def read(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from the ``start``-th on."""
        if count <= 0:
            return np.zeros(0, np.uint32)
        low, high = start // self.block, (start + count - 1) // self.block + 1
        size = self.block * self.bits // 8
        data = self._at(int(self.block_offsets[low]), (high - low) * size)
        return unpack(data, self.bits)[start - low * self.block :][:count]

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 0, parts: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into token files in ascending doc_id order; one row per file.

    Null texts count as empty, a null id as the least, rows that share an id stand in the order of their texts; each
    document ends with ``end_id``. A task writes a file of a name of its own, and only the files that the stored
    manifest names are read, so a task that runs twice does no harm. An empty table gives no files.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    tokenizer = tokenizer or default_tokenizer()
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    files, place = file_system(folder)
    files.create_dir(place, recursive=True)

    def shard(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        writer, encoder = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                if writer is None:
                    path = f"{folder}/{uuid.uuid4().hex}.tok"
                    files, place = file_system(path)
                    encoder = Encoder(tokenizer)
                    writer = Writer(files.open_output_stream(place), bits_for(max(encoder.vocabulary, end_id + 1)))
                part = batch.slice(at, 512)
                ids, borders = encoder.encode_column(part.column(1))
                writer.add(part.column(0).to_pylist(), np.insert(ids, borders[1:], end_id), np.diff(borders) + 1)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "n_docs": pa.array([len(writer.lengths)], pa.int64()), "n_ids": pa.array([writer.ids], pa.int64())})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stored(ranged.mapInArrow(lean(shard), "part int, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """The documents of token files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def documents(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(path)
                for at in range(0, len(reader.docs), 1024):
                    offsets = reader.doc_offsets[at : at + 1025]
                    ids = reader.read(int(offsets[0]), int(offsets[-1] - offsets[0]))
                    local = offsets - offsets[0]
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(local[:-1], local[1:])]
                    docs = [None if d == -(1 << 63) else int(d) for d in reader.docs[at : at + 1024]]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(offsets[:-1] + base, pa.int64()), "n_tokens": pa.array(np.diff(offsets), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
                reader.close()

    spread = manifest.select("path", "start").repartition(max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    return spread.mapInArrow(lean(documents), "doc_id long, start long, n_tokens long, ids_crc32 long")
