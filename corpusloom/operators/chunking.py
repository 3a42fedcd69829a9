"""Index build: overlapping chunks, chunk numbering, chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import native
from .ordered import with_running_start


def chunk_rows(df: DataFrame, text: str = "text", size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk: every other column, ``chunk_index`` and the chunk in place of the text."""
    others = [c for c in df.columns if c != text]
    return (
        df.withColumn("_chunks", native.chunk_texts(F.col(text), size, overlap))
        .select(*others, F.posexplode("_chunks").alias("chunk_index", text))
    )


def number_chunks(df: DataFrame, order: str, text: str = "text", size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Chunks with their table-wide running number.

    ``order`` is a unique integral position of each document. Texts are cut once; the
    chunks stay with their document while its start is summed.
    """
    others = [c for c in df.columns if c != text]
    cut = df.withColumn("_chunks", native.chunk_texts(F.col(text), size, overlap))
    counted = cut.select(*others, "_chunks", F.size("_chunks").alias("_count"))
    return (
        with_running_start(counted, order, "_count", "_start")
        .select(*others, "_start", F.posexplode("_chunks").alias("chunk_index", text))
        .withColumn("global_chunk_index", F.col("_start") + F.col("chunk_index"))
        .drop("_start")
    )


#: Characters of a piece that are taken at once, and chunks that are given on at once.
STRIDE, TOGETHER = 1 << 16, 256


def chunk_pieces(
    pieces: DataFrame, group: str, order: list[str], text: str = "text", between: str = "\n\n",
    size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
) -> DataFrame:
    """Chunks of texts that are given in ordered pieces: ``group, chunk_index`` and the chunk in place of the piece.

    The same chunks as those of the pieces joined by ``between``, but the joined text never exists: pieces pass in
    order, and a chunk is cut as soon as what decides its end has been seen. Null pieces count as empty ones.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap must be smaller than half the chunk size")
    ahead = size + max(K.SENTENCE_SLACK, K.SPACE_SLACK)
    kind = pieces.schema[group].dataType.simpleString()

    def cut(batches):
        import pyarrow as pa

        held = {"key": None, "open": False, "buffer": "", "n": 0, "blank": [], "words": False}
        keys, numbers, texts = [], [], []

        def give(chunk: str) -> None:
            # a text of blanks has no chunk: they wait until something else follows them
            held["blank"].append(chunk)
            held["words"] = held["words"] or chunk.strip() != ""
            for one in held["blank"] if held["words"] else []:
                keys.append(held["key"])
                numbers.append(held["n"])
                texts.append(one)
                held["n"] += 1
            if held["words"]:
                held["blank"] = []

        def add(part: str) -> None:
            buffer = held["buffer"] + part
            at = 0
            while len(buffer) - at > ahead:
                start, stop = next(native.chunk_spans(buffer[at : at + ahead + 1], size, overlap))
                give(buffer[at : at + stop])
                at += stop - overlap
            held["buffer"] = buffer[at:]

        def end() -> None:
            for start, stop in native.chunk_spans(held["buffer"], size, overlap):
                give(held["buffer"][start:stop])

        def batch():
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, pieces_type[0]), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], [group, "chunk_index", text]
            )
            for column in (keys, numbers, texts):
                column.clear()
            return out

        pieces_type: list = []
        for b in batches:
            pieces_type[:] = [b.schema.field(0).type]
            for key, piece in zip(b.column(0).to_pylist(), b.column(1)):
                piece = piece.as_py() or ""
                if not held["open"] or key != held["key"]:
                    if held["open"]:
                        end()
                    held.update(key=key, open=True, buffer="", n=0, blank=[], words=False)
                else:
                    add(between)
                for low in range(0, len(piece), STRIDE):
                    add(piece[low : low + STRIDE])
                    if len(keys) >= TOGETHER:
                        yield batch()
        if held["open"]:
            end()
            yield batch()

    rows = pieces.select(group, *order, text).repartition(group).sortWithinPartitions(group, *order).select(group, text)
    return rows.mapInArrow(cut, f"{group} {kind}, chunk_index int, {text} string")


def transcript_chunk_id(stem: Column, prefix: str = "txt") -> Column:
    return F.concat(
        F.lit(f"{prefix}-"), stem, F.lit("-c"), F.col("chunk_index").cast("string"),
        F.lit("-g"), F.col("global_chunk_index").cast("string"),
    )


def record_chunk_id(book: Column) -> Column:
    return F.concat(
        book, F.lit("-"), F.col("kind"), F.lit("-"), F.col("rec_i").cast("string"),
        F.lit("-c"), F.col("chunk_index").cast("string"),
        F.lit("-g"), F.col("global_chunk_index").cast("string"),
    )


def build_transcript_index(files: DataFrame, embed=None) -> DataFrame:
    """Chunk table of transcript files (``file_ord, file_name, text``), embedded when a model is given."""
    numbered = number_chunks(files, "file_ord")
    stem = F.regexp_replace("file_name", r"\.[^.]*\z", "")
    out = numbered.select(
        transcript_chunk_id(stem).alias("id"),
        F.col("file_name").alias("source"),
        F.lit("").alias("conversation_id"),
        F.lit("transcript_txt").alias("kind"),
        "chunk_index",
        "global_chunk_index",
        "text",
    )
    return out if embed is None else out.withColumn("embedding", embed(F.col("text")))


def build_record_index(docs: DataFrame, book: str, source: str, embed=None) -> DataFrame:
    """Chunk table of record documents (``rec_i, doc_ord, kind, suttaid, commentary_id, text``)."""
    placed = docs.withColumn("_pos", F.col("rec_i").cast("bigint") * 4 + F.col("doc_ord"))
    numbered = number_chunks(placed, "_pos").drop("_pos")
    out = numbered.select(
        record_chunk_id(F.lit(book)).alias("id"),
        F.lit(source).alias("source"),
        "suttaid", "commentary_id", "kind", "chunk_index", "global_chunk_index", "text",
    )
    return out if embed is None else out.withColumn("embedding", embed(F.col("text")))


def chunk_specs(docs: DataFrame, book: str, source: str) -> DataFrame:
    """Portable chunk rows without vectors."""
    return chunk_rows(docs).select(
        F.lit(book).alias("book"), "kind", "suttaid", "commentary_id", F.lit(source).alias("source"),
        "rec_i", "doc_ord", "chunk_index", "text",
    )


def chunk_counts(chunks: DataFrame, by: str = "source") -> DataFrame:
    return chunks.groupBy(by).agg(
        F.count("*").alias("chunk_count"),
        F.sum(F.length("text")).alias("chars"),
        F.max(F.length("text")).alias("longest"),
    )
