"""Writers. A table is never written over the files it is being read from."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import safe_name, strip
from .bundles import parent_of

def write_index(chunks: DataFrame, path: str) -> None:
    """Rebuild a chunk table; only the books present in ``chunks`` are replaced."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book").parquet(path)


def write_shards(chunks: DataFrame, folder: str, embedding_model: str) -> dict:
    """Chunk lines per book and a manifest of all books in the folder; returns the manifest.

    ``chunks`` is evaluated once: the counts are those of the lines written.
    """
    spark = chunks.sparkSession
    by_shard = chunks.withColumn("_shard", F.col("book")).write.mode("overwrite")
    by_shard.option("partitionOverwriteMode", "dynamic").partitionBy("_shard").json(f"{folder}/shards")
    lines = spark.read.schema("value string, _shard string").text(f"{folder}/shards")
    counts = lines.groupBy(F.col("_shard").alias("book")).agg(F.count("*").alias("n")).orderBy("book").collect()
    manifest = {
        "format": K.MANIFEST_FORMAT,
        "version": 1,
        "embedding_model": embedding_model,
        "shards": [{"book": r.book, "uri": f"shards/_shard={r.book}", "chunk_count": r.n} for r in counts],
    }
    _write_text(chunks.sparkSession, f"{folder}/manifest.json", json.dumps(manifest, ensure_ascii=False))
    return manifest


def write_bundle(chunks: DataFrame, folder: str, embedding_model: str) -> dict:
    """One portable table for all books: chunk lines below ``folder`` and a header naming them; returns the header.

    The rows stay in as many files as there are tasks; no task or value holds them all.
    """
    seen = Observation("bundle")
    chunks.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{folder}/chunks")
    header = {
        "format": K.MANIFEST_FORMAT,
        "version": 1,
        "embedding_model": embedding_model,
        "shards": [{"book": "all", "uri": "chunks", "chunk_count": seen.get["n"]}],
    }
    _write_text(chunks.sparkSession, f"{folder}/manifest.json", json.dumps(header, ensure_ascii=False))
    return header


def write_conversation_index(index: DataFrame, folder: str, version: int) -> str:
    """A new version of the conversation index beside the one it was computed from."""
    path = f"{folder}/v={version}"
    index.select("id", "title", "updated_ts").write.mode("overwrite").json(path)
    return path


def _write_text(spark, path: str, text: str) -> None:
    """One small file through the Hadoop file system of its path."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def append_json(rows: DataFrame, path: str) -> None:
    """Append log lines."""
    rows.write.mode("append").json(path)


def write_conversations(conversations: DataFrame, path: str) -> dict:
    """Conversations with messages as JSON lines; returns the counters of the same pass."""
    from ..operators.conversations import has_messages

    seen = Observation("conversations")
    observed = conversations.observe(
        seen,
        F.count(F.lit(1)).alias("total"),
        F.count_if(has_messages()).alias("written"),
        F.count_if(~has_messages()).alias("skipped"),
    )
    observed.filter(has_messages()).write.mode("overwrite").json(path)
    return seen.get


def _joined(spark, head: str, folder: str, between: str, tail: str, path: str) -> None:
    """The part files of ``folder`` as one file, with text before, between and behind; it appears when it is whole.

    Where the file system can concatenate files (as HDFS does), only their names pass here; elsewhere the parts are
    copied as streams of bytes.
    """
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop
    conf = spark._jsc.hadoopConfiguration()
    target, place = hadoop.fs.Path(path), hadoop.fs.Path(folder)
    fs = place.getFileSystem(conf)
    parts = sorted((f.getPath() for f in fs.listStatus(place) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda p: p.getName())

    def small(name: str, text: str):
        file = hadoop.fs.Path(f"{folder}/{name}")
        out = fs.create(file, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        return file

    whole = small("_whole", head)
    pieces = [p for i, part in enumerate(parts) for p in ([small(f"_between-{i}", between)] if i and between else []) + [part]]
    pieces.append(small("_tail", tail))
    array = spark.sparkContext._gateway.new_array(hadoop.fs.Path, len(pieces))
    for i, piece in enumerate(pieces):
        array[i] = piece
    try:
        fs.concat(whole, array)
    except UnsupportedOperationException:
        whole = hadoop.fs.Path(f"{folder}/_copied")
        out = fs.create(whole, True)
        try:
            for piece in [hadoop.fs.Path(f"{folder}/_whole"), *pieces]:
                source = fs.open(piece)
                hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                source.close()
        finally:
            out.close()
    fs.delete(target, False)
    if not fs.rename(whole, target):
        raise OSError(f"can't move the finished file to {path}")
    fs.delete(place, True)


def _json_parts(rows: DataFrame, folder: str, indent: int | None, before: str) -> int:
    """Rows as JSON text in part files, encoded in their tasks: after ``before``, with commas between; returns their number."""
    import pyarrow as pa

    def encode(batches):
        first = True
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                shown = json.dumps(json.loads(text), ensure_ascii=False, indent=indent).replace("\n", before if indent else "\n")
                # the writer ends each row with its brace
                out.append(("" if first else ",") + before + shown[:-1])
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    seen = Observation("rows")
    lines = rows.select(F.to_json(F.struct("*")).alias("x")).observe(seen, F.count(F.lit(1)).alias("n")).mapInArrow(encode, "value string")
    lines.write.option("lineSep", "}").text(folder)
    return seen.get["n"]


def export_pretty(rows: DataFrame, path: str) -> int:
    """All rows as one pretty JSON array, as a person reads it; returns their number. Tasks encode it part by part."""
    folder = f"{parent_of(path)}_parts-{uuid.uuid4().hex}"
    n = _json_parts(rows, folder, 2, "\n  ")
    _joined(rows.sparkSession, "[", folder, ",", "\n]\n" if n else "]\n", path)
    return n


def write_bundle_object(chunks: DataFrame, path: str, embedding_model: str) -> int:
    """One portable table as a single JSON object, as ``read_bundle`` reads it; returns the number of chunks."""
    folder = f"{parent_of(path)}_parts-{uuid.uuid4().hex}"
    n = _json_parts(chunks, folder, None, "\n")
    head = json.dumps({"format": K.BUNDLE_FORMAT, "embedding_model": embedding_model}, ensure_ascii=False)[:-1]
    _joined(chunks.sparkSession, head + ', "chunks": [', folder, ",", "\n]}\n", path)
    return n


def write_segments(segments: DataFrame, path: str) -> None:
    """Segments as JSON lines in one folder per source file, in order; ``read_json_arrays`` reads them back."""
    ordered = segments.repartition("json_file").sortWithinPartitions("json_file", "segment_index")
    ordered.drop("segment_index").write.mode("overwrite").partitionBy("json_file").json(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """A short ordered report (one ``line`` column) as one text file."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_merged_books(pieces: DataFrame, path: str) -> None:
    """Merged transcripts: a folder per book whose files, in name order, hold its pieces in order.

    Pieces end with a line break, which is the one the writer adds.
    """
    whole = F.when(F.endswith("text", F.lit("\n")), F.substr("text", F.lit(1), F.length("text") - 1))
    text = F.coalesce(whole, F.raise_error(F.lit("a piece without a line break at its end")).cast("string"))
    ordered = pieces.repartitionByRange("book", "ord", "file_name").sortWithinPartitions("book", "ord", "file_name")
    ordered.select("book", text.alias("text")).write.mode("overwrite").partitionBy("book").text(path)


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """Append translation snapshots (``author, canon_id, keys_order, translation_text``) by author."""
    named = snapshots.withColumn("author", safe_name(F.lower(strip("author")), keep=r"\-")).withColumn(
        "canon_id", safe_name(F.lower(strip("canon_id")))
    )
    named.filter("canon_id <> ''").write.mode("append").partitionBy("author").json(path)
