"""A stored substring index: posting lists of character trigrams in segments of rows, intersected and verified.

Rows are numbered as they are stored and cut into segments. For each trigram and segment there are lists of the
segment's rows that hold it, one for each turn of its characters, so a list never outgrows its segment, however common
the trigram. A term's rows are in the lists of all its trigrams: these are intersected segment by segment, the shortest
first, and what is left is verified on the text. Only folders that hold such rows are read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_or_blank
from ..storage import shared_folder, stored

#: Rows of a segment, as a power of two (at most 15); folders of posting lists.
SEGMENT_BITS, BUCKETS = 13, 64
#: Characters whose trigrams are sorted at a time.
CHARS = 1 << 22


@dataclass(frozen=True)
class SubstringIndex:
    """``postings`` (tri, segment, n, offsets, bucket) and ``rows`` (the indexed columns, row, folder)."""

    postings: DataFrame
    rows: DataFrame
    case_sensitive: bool


def _hay(case_sensitive: bool) -> Column:
    return text_or_blank("text") if case_sensitive else F.lower(text_or_blank("text"))


def _codes(text: bytes) -> np.ndarray:
    """The code points of UTF-8 bytes; each broken sequence counts as one odd character."""
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def _lists(texts: list[np.ndarray], rows: list[int], bits: int) -> Iterator[pa.RecordBatch]:
    """``tri, segment, offsets``: for each trigram of some texts (as code points) of one segment the rows that hold it."""
    flat = np.concatenate(texts)
    # the characters that occur are numbered, so that a trigram and its text are one number
    seen = np.zeros(0x110000, bool)
    seen[flat] = True
    alphabet = np.flatnonzero(seen)
    wide, low = max(1, (len(alphabet) - 1).bit_length()), (len(texts) - 1).bit_length()
    if 3 * wide + low > 63:
        half = len(texts) // 2
        yield from _lists(texts[:half], rows[:half], bits)
        yield from _lists(texts[half:], rows[half:], bits)
        return
    number = np.zeros(0x110000, np.int32)
    number[alphabet] = np.arange(len(alphabet))
    own = number[flat].astype(np.int64)
    place = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    keys = (own[:-2] << 2 * wide | own[1:-1] << wide | own[2:]) << low | place[2:]
    keys = keys[place[:-2] == place[2:]]
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    tri = keys >> low
    at = np.flatnonzero(np.append(True, tri[1:] != tri[:-1]))
    offsets = (np.array(rows, np.int64) & (1 << bits) - 1).astype(np.int16)[keys & (1 << low) - 1]
    tri, mask = tri[at], (1 << wide) - 1
    points = alphabet[np.stack([tri >> 2 * wide, tri >> wide & mask, tri & mask], axis=1)].astype(np.uint32)
    spelt = points.tobytes().decode("utf-32-le")
    names = pa.array([spelt[i : i + 3] for i in range(0, len(spelt), 3)], pa.string())
    segment = pa.array(np.full(len(at), rows[0] >> bits, np.int64))
    ends = pa.array(np.append(at, len(keys)).astype(np.int32))
    yield pa.RecordBatch.from_arrays([names, segment, pa.ListArray.from_arrays(ends, pa.array(offsets))], ["tri", "segment", "offsets"])


def _partial_lists(batches: Iterator[pa.RecordBatch], bits: int, chars: int) -> Iterator[pa.RecordBatch]:
    """Lists of a segment, or of ``chars`` characters of it at a time; long texts are taken piece by piece."""
    texts, rows, size = [], [], 0
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if texts and row >> bits != rows[0] >> bits:
                yield from _lists(texts, rows, bits)
                texts, rows, size = [], [], 0
            codes = _codes(text)
            for start in range(0, max(len(codes) - 2, 0), chars):
                piece = codes[start : start + chars + 2]
                texts.append(piece)
                rows.append(row)
                size += len(piece)
                if size >= chars:
                    yield from _lists(texts, rows, bits)
                    texts, rows, size = [], [], 0
    if texts:
        yield from _lists(texts, rows, bits)


def _bucket(tri: Column) -> Column:
    return F.pmod(F.xxhash64(tri), F.lit(BUCKETS)).cast("int")


def build(rows: DataFrame, case_sensitive: bool = False) -> SubstringIndex:
    """Index ``rows`` (text and any further columns but row, folder, segment). Null texts count as empty.

    Rows are computed once, in the partitions in which they come; each of these is a folder.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "substring-index")
    placed = rows.withColumns({"row": F.monotonically_increasing_id(), "folder": F.spark_partition_id()})
    placed.write.partitionBy("folder").parquet(f"{folder}/rows")
    kept = spark.read.schema(placed.schema).parquet(f"{folder}/rows")
    some = kept.select("row", _hay(case_sensitive).cast("binary").alias("text")).mapInArrow(partial(_partial_lists, bits=SEGMENT_BITS, chars=CHARS), "tri string, segment long, offsets array<smallint>")
    # a folder's lists are dealt to several tasks, by segment too, as a common trigram has many
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("tri", "segment"), F.lit(max(1, 4 * n // BUCKETS))).cast("int")
    dealt = some.withColumns({"bucket": _bucket(F.col("tri")), "part": part}).repartition("bucket", "part")
    listed = dealt.select("tri", "segment", F.size("offsets").alias("n"), "offsets", "bucket")
    # sorted by trigram, so a scan skips row groups
    listed.sortWithinPartitions("bucket", "tri", "segment").write.partitionBy("bucket").parquet(f"{folder}/postings")
    postings = spark.read.schema("tri string, segment long, n int, offsets array<smallint>, bucket int").parquet(f"{folder}/postings")
    return SubstringIndex(postings, kept.select(*rows.columns, "row", "folder"), case_sensitive)


def candidates(index: SubstringIndex, terms: list[str]) -> DataFrame:
    """(term, row, folder): rows that hold all trigrams of a term (its number); terms under three characters have none."""
    spark = index.rows.sparkSession
    told = [(i, t[a : a + 3]) for i, t in enumerate(terms) for a in range(len(t) - 2)]
    told = sorted(set(told))
    need = {i: sum(1 for j, _ in told if j == i) for i, _ in told}
    wanted = spark.createDataFrame([(i, tri, need[i]) for i, tri in told], "term int, tri string, need int")
    names = sorted({tri for _, tri in told})
    # literals, so that folders and row groups without these trigrams are not read
    buckets = [r.b for r in wanted.select(_bucket(F.col("tri")).alias("b")).distinct().collect()]
    lists = index.postings.where(F.col("bucket").isin(buckets) & F.col("tri").isin(names))
    lists = lists.groupBy("tri", "segment").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("offsets")).alias("offsets"))
    group = lists.join(F.broadcast(wanted), "tri").groupBy("term", "segment")
    met = group.agg(F.count("*").alias("have"), F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct("n", "offsets"))).alias("lists"))
    both = F.aggregate(F.slice("lists", 2, 1 << 30), F.col("lists")[0].offsets, lambda acc, one: F.array_intersect(acc, one.offsets))
    found = met.where("have = need").select("term", "segment", F.explode(F.array_distinct(both)).alias("offset"))
    row = F.shiftleft("segment", SEGMENT_BITS) + F.col("offset")
    return found.select("term", row.alias("row"), F.shiftright(row, 33).cast("int").alias("folder"))


def find(index: SubstringIndex, terms: list[str]) -> DataFrame:
    """The rows that contain a term, once for each, with ``term``: its number. Equal to testing all rows.

    Terms of less than three characters have no trigram; for these all rows are tested. An empty term is in every row.
    """
    spelt = [t if index.case_sensitive else t.lower() for t in terms]
    hay = _hay(index.case_sensitive)
    columns = [c for c in index.rows.columns if c not in ("row", "folder")]
    short = [(i, t) for i, t in enumerate(spelt) if len(t) < 3]
    out = None
    if len(short) < len(spelt):
        few = stored(candidates(index, spelt), "candidates")
        folders = [r.folder for r in few.select("folder").distinct().collect()]  # one per range of rows
        words = F.array(*[F.lit(t) for t in spelt])
        met = index.rows.where(F.col("folder").isin(folders)).join(few.drop("folder"), "row")
        out = met.where(F.contains(hay, F.get(words, F.col("term")))).select(*columns, "term")
    if short:
        found = F.array_compact(F.array(*[F.when(F.contains(hay, F.lit(t)), F.lit(i)) for i, t in short]))
        scanned = index.rows.select(*columns, F.explode(found).alias("term"))
        out = scanned if out is None else out.unionByName(scanned)
    if out is None:
        return index.rows.limit(0).select(*columns, F.lit(0).alias("term"))
    return out
