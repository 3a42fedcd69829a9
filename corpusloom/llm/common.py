"""Helpers shared by the operators: shared storage, chunked bytes, hashed words, sizes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests, one machine).
OWN_FOLDER = "file:///tmp/checkpoints"

#: Bytes of a stored table's row groups.
ROW_GROUP = 8 << 20

#: Text bytes handled at once inside a task.
CHUNK_BYTES = 1 << 19

#: Word borders: any byte of these ends a word; bytes of 0x80 and above always belong to one.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
NON_WORD_BYTES = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


#: What keeps a task's memory small where texts are long: smaller batches between Spark and Python and from
#: Parquet, smaller row groups.
MEMORY = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "1024",
    "parquet.block.size": str(16 << 20),
}


def small_batches(spark: SparkSession, smaller: dict[str, str] | None = None) -> SparkSession:
    """Set ``MEMORY``, changed by ``smaller``, where the session leaves it open."""
    own = spark._jsparkSession.sessionState().conf()
    for key, value in {**MEMORY, **(smaller or {})}.items():
        if not own.contains(key):
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach."""
    root = spark.conf.get("spark.checkpoint.dir", None) or OWN_FOLDER
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once and survives lost executors.

    Row groups are small, as a task holds one of them whole and some rows here are as long as a MB.
    """
    path = shared_folder(df.sparkSession, what)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(docs: DataFrame) -> int:
    """Size of ``docs`` in bytes: of its files where it is read from such, else of its texts, counted."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size < 1 << 50 and not any(word in plan.toString() for word in ("Join", "Generate", "Aggregate", "Union")):
        return size
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n


def groups_for(df: DataFrame, bytes_each: int) -> int:
    """How many hash groups keep a group of ``df`` near ``bytes_each``; never under the shuffle partitions."""
    spark = df.sparkSession
    return max(256, int(spark.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df) // bytes_each + 1)


def fold(column: str = "doc_id") -> Column:
    """The crc32 of an id as text, by which rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task keeps little."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(fn):
    """A function over record batches that gives memory back when its task ends."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def lean_group(fn):
    """A function of a group's key and one or two tables that gives memory back after it."""

    def held(*tables):
        try:
            return fn(*tables)
        finally:
            give_back()

    # Spark counts the parameters
    if fn.__code__.co_argcount == 3:
        return lambda key, left, right: held(key, left, right)
    return lambda key, table: held(key, table)


def column_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary array end to end, and the n + 1 borders."""
    import pyarrow as pa

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    large = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    borders = np.frombuffer(offsets, np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[borders[0] : borders[-1]], borders - borders[0]


def pieces(borders: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes; a longer document stands alone."""
    first = 0
    while first < len(borders) - 1:
        last = int(np.searchsorted(borders, borders[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(borders) - 1)
        yield first, last
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE`` and its inverse to the powers 0 to n - 1, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 2)
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def byte_codes() -> np.ndarray:
    """A fixed random 64-bit code for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lower_table() -> np.ndarray:
    """Bytes to bytes, A-Z to a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


class Words:
    """The words of several documents, found in their bytes.

    ``start`` and ``end`` are byte places in ``data``, ``doc`` the document's number, ``hash`` a 64-bit value of the
    word (lower-cased, A-Z only, if ``lower``), ``first`` the number of the first word of each document (n + 1 entries).
    """

    def __init__(self, data: np.ndarray, borders: np.ndarray, outside: bytes, lower: bool = True):
        n = len(data)
        inside = np.ones(256, bool)
        inside[np.frombuffer(outside, np.uint8)] = False
        self.data = lower_table()[data] if lower else data
        is_word = np.zeros(n + 2, bool)
        is_word[1:-1] = inside[self.data]
        start = is_word[1:-1] & ~is_word[:-2]
        end = is_word[1:-1] & ~is_word[2:]
        cuts = borders[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        start[cuts] = is_word[1:-1][cuts]
        end[cuts - 1] = is_word[1:-1][cuts - 1]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, borders)
        self.doc = np.repeat(np.arange(len(borders) - 1), np.diff(self.first))
        up, _ = powers(n + 1)
        self.sums = sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte_codes()[self.data] * up[:n], out=sums[1:])
        self.hash = self.part_hash(self.start, self.end)

    def part_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash that the bytes from ``start`` to ``end`` have as a word."""
        down = powers(len(self.sums))[1]
        return mix((self.sums[end] - self.sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hash(words: list[bytes]) -> np.ndarray:
    """The values ``Words.hash`` gives to lower-cased words."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    if not words:
        return np.zeros(0, np.uint64)
    return Words(data, np.array([0, len(data)], np.int64), b" ").hash


def runs(doc: np.ndarray, values: np.ndarray, width: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` consecutive words within a document, and its document.

    A document with fewer words, but not none, has its whole sequence as one run.
    """
    n = len(values)
    counts = np.diff(first)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    starts = np.arange(max(n - width + 1, 0))
    starts = starts[doc[starts] == doc[starts + width - 1]]
    full = mix((sums[starts + width] - sums[starts]) * down[starts])
    short = np.flatnonzero((counts > 0) & (counts < width))
    low = first[:-1][short]
    whole = mix((sums[low + counts[short]] - sums[low]) * down[low] + counts[short].astype(np.uint64) * np.uint64(BASE))
    return np.concatenate([full, whole]), np.concatenate([doc[starts], short])


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column is called so (case doesn't count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Row keys that are sent to every task at most (8 bytes each); with more, rows are shuffled to them.
IDS_SENT = 1_000_000


def row_key(docs: DataFrame) -> Column:
    """A 64-bit hash of all columns and of which are null: rows of one key are equal, and it is the same in every run."""
    return F.xxhash64(*docs.columns, *(F.col(c).isNull() for c in docs.columns))


def without(docs: DataFrame, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """``docs`` but for the rows whose ``row_key`` is in ``gone`` (key); of equal rows whose key is in ``once``, one stays.

    Texts are only shuffled for the rows in ``once`` and if a list is long. Columns of any name stay as they are.
    """
    row = free_name(docs.columns, "__row")

    def listed(keys: DataFrame) -> tuple[DataFrame, int]:
        keys = stored(keys.select(F.col("key").alias(row)).distinct(), "rows")
        n = keys.limit(IDS_SENT + 1).count()
        return F.broadcast(keys) if n <= IDS_SENT else keys, n

    keyed = docs.withColumn(row, row_key(docs))
    rest = keyed.join(listed(gone if once is None else gone.select("key").unionByName(once.select("key")))[0], row, "left_anti").select(*docs.columns)
    if once is None:
        return rest
    single, n = listed(once)
    return rest.unionByName(keyed.join(single, row, "left_semi").dropDuplicates([row]).select(*docs.columns)) if n else rest
