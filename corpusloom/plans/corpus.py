"""Index build over the given documents: chunks, record documents, merges by book."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import records as R
from ..sources.arrays import read_array_files, read_bundle_object
from ..sources.sinks import export_pretty, write_bundle_object
from ..storage import shared_folder
from .registry import query, table
from .standins import RECORDS_SQL, SQL_WS, records, sql_strip, transcripts


def chunks_sql(source: str, name: str = "chunks") -> str:
    """Recursive ``spans`` and ``chunks`` (or ``name``) CTEs over a relation with ``k`` and ``text``."""
    return f"""spans AS (
      SELECT k, length(text) AS n, 0 AS i, 0 AS s,
        CASE WHEN 1500 >= length(text) THEN length(text) ELSE 0 END AS e0, text FROM {source}
      WHERE NOT regexp_full_match(text, '{SQL_WS}*')
      UNION ALL
      SELECT k, n, i + 1, e - 400, 0, text FROM (SELECT *, {_stop('s')} AS e FROM spans) WHERE s + 1500 < n AND e - 400 < n
    ), {name} AS (
      SELECT k, i AS chunk_index, substring(text, s + 1, {_stop('s')} - s) AS chunk FROM spans
      WHERE NOT (s + 1500 >= n AND regexp_full_match(substring(text, s + 1), '{SQL_WS}*')))"""


def _stop(s: str) -> str:
    w1 = f"substring(text, {s} + 751, 950)"
    w2 = f"substring(text, {s} + 751, 850)"
    return f"""CASE WHEN {s} + 1500 >= n THEN n
      WHEN contains({w1}, '. ') THEN {s} + 750 + length(regexp_extract({w1}, '(?s)^(.*)[.] ', 1)) + 2
      WHEN contains({w2}, ' ') THEN {s} + 750 + length(regexp_extract({w2}, '(?s)^(.*) ', 1)) + 1
      ELSE {s} + 1500 END"""


DOC_CHUNKS = f"WITH RECURSIVE src AS (SELECT doc_id AS k, text FROM documents), {chunks_sql('src')}"


@query(
    "chunk_documents",
    DOC_CHUNKS + " SELECT k AS doc_id, chunk_index, length(chunk) AS n_chars, md5(chunk) AS chunk_md5 FROM chunks",
)
def chunk_documents(spark, sf):
    cut = C.chunk_rows(table(spark, sf, "documents", spread_by="doc_id").select("doc_id", "text"))
    return cut.select("doc_id", "chunk_index", F.length("text").alias("n_chars"), F.md5("text").alias("chunk_md5"))


@query(
    "chunk_numbering",
    DOC_CHUNKS
    + """ SELECT 'txt-talk_' || k || '-c' || chunk_index || '-g' || g AS id, 'talk_' || k || '.txt' AS source,
      chunk_index, g AS global_chunk_index, md5(chunk) AS chunk_md5
      FROM (SELECT *, row_number() OVER (ORDER BY k, chunk_index) - 1 AS g FROM chunks)""",
)
def chunk_numbering(spark, sf):
    built = C.build_transcript_index(transcripts(spark, sf))
    return built.select("id", "source", "chunk_index", "global_chunk_index", F.md5("text").alias("chunk_md5"))


@query(
    "chunk_counts_by_source",
    "WITH RECURSIVE src AS (SELECT doc_id AS k, text FROM documents), "
    + chunks_sql("src")
    + """ SELECT source, count(*) AS chunk_count, sum(length(chunk))::BIGINT AS chars, max(length(chunk))::INT AS longest
      FROM chunks JOIN documents ON k = doc_id GROUP BY source""",
)
def chunk_counts_by_source(spark, sf):
    return C.chunk_counts(C.chunk_rows(table(spark, sf, "documents", spread_by="doc_id").select("source", "text")))


def docs_sql() -> str:
    head = "'SUTTAID: ' || suttaid || chr(10) || 'COMMENTARY_ID: c' || suttaid"
    return f"""{RECORDS_SQL}, trimmed AS (SELECT pos, suttaid, chained, category, items, is_ordered,
        {sql_strip('sutta')} AS st, {sql_strip('commentary')} AS cm FROM records), docs AS (
      SELECT pos, suttaid, 0 AS ord, 'sutta' AS kind, {head} || chr(10) || chr(10) || 'SUTTA:' || chr(10) || st AS text
        FROM trimmed WHERE st <> ''
      UNION ALL
      SELECT pos, suttaid, 1, 'commentary', {head} || chr(10) || chr(10) || 'TEACHER COMMENTARY:' || chr(10) || cm
        FROM trimmed WHERE cm <> ''
      UNION ALL
      SELECT pos, suttaid, 2, 'chain', {head} || chr(10) || chr(10)
        || 'CHAIN (enumerated links / topics for this discourse; not verbatim scripture):' || chr(10)
        || 'Category: ' || category || chr(10) || 'Ordered pair: ' || CASE WHEN is_ordered THEN 'yes' ELSE 'no' END
        || chr(10) || 'Items:' || CASE WHEN len(items) = 0 THEN '' ELSE chr(10) || array_to_string(list_transform(items,
          lambda x, i: '  ' || i || '. ' || x), chr(10)) END FROM trimmed WHERE chained
      UNION ALL
      SELECT pos, suttaid, 3, 'combined', {head} || chr(10) || chr(10) || 'SUTTA:' || chr(10) || st
        FROM trimmed WHERE st = '' AND cm = '' AND NOT chained)"""


@query(
    "record_to_docs",
    f"WITH {docs_sql()} SELECT pos, suttaid, 'c' || suttaid AS commentary_id, kind, text FROM docs",
)
def record_to_docs(spark, sf):
    return R.to_documents(records(spark, sf)).select("pos", "suttaid", "commentary_id", "kind", "text")


@query(
    "record_chunk_index",
    f"WITH RECURSIVE {docs_sql()}, src AS (SELECT pos * 4 + ord AS k, text, pos, kind, suttaid FROM docs), "
    + chunks_sql("src")
    + """ SELECT 'an1-' || kind || '-' || pos || '-c' || chunk_index || '-g' || g AS id, suttaid, kind, chunk_index,
      g AS global_chunk_index, length(chunk) AS n_chars FROM (
        SELECT c.*, s.pos, s.kind, s.suttaid, row_number() OVER (ORDER BY c.k, chunk_index) - 1 AS g
        FROM chunks c JOIN src s ON c.k = s.k)""",
)
def record_chunk_index(spark, sf):
    docs = R.to_documents(records(spark, sf).drop("pos", "source", "lang"))
    built = C.build_record_index(docs, "an1", "records/an1.json")
    return built.select("id", "suttaid", "kind", "chunk_index", "global_chunk_index", F.length("text").alias("n_chars"))


@query(
    "chunk_specs",
    f"WITH RECURSIVE {docs_sql()}, src AS (SELECT pos * 4 + ord AS k, text, kind, suttaid FROM docs), "
    + chunks_sql("src")
    + """ SELECT 'an2' AS book, kind, suttaid, 'c' || suttaid AS commentary_id, 'records/an2.json' AS source,
      c.chunk_index, md5(chunk) AS chunk_md5 FROM chunks c JOIN src s ON c.k = s.k""",
)
def chunk_specs(spark, sf):
    docs = R.to_documents(records(spark, sf).drop("pos", "source", "lang"), variant="b")
    specs = C.chunk_specs(docs, "an2", "records/an2.json")
    return specs.select(
        "book", "kind", "suttaid", "commentary_id", "source", "chunk_index", F.md5("text").alias("chunk_md5")
    )


@query("json_array_read", "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def json_array_read(spark, sf):
    """Documents written as one JSON array by many tasks, and that file read by many tasks."""
    docs = table(spark, sf, "documents").select("doc_id", "text").where("text IS NOT NULL")
    path = f"{shared_folder(spark, 'array')}/all.json"
    export_pretty(docs, path)
    back = read_array_files(spark, path, "doc_id bigint, text string")
    return back.select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "bundle_object_read",
    "SELECT CAST(vec_id AS VARCHAR) AS suttaid, CAST(label AS VARCHAR) AS book, len(embedding) AS dims FROM embeddings",
)
def bundle_object_read(spark, sf):
    """Stored vectors written as one bundle object by many tasks, and read back in parallel."""
    rows = table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("book"), F.lit("sutta").alias("kind"), F.col("vec_id").cast("string").alias("suttaid"),
        F.lit("").alias("text"), "embedding",
    )
    path = f"{shared_folder(spark, 'bundle')}/vectors.json"
    write_bundle_object(rows, path, "stored")
    return read_bundle_object(spark, path).select("suttaid", "book", F.size("embedding").alias("dims"))


@query(
    "conversation_chunks_from_turns",
    "WITH RECURSIVE src AS (SELECT conv_id AS k, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id), "
    + chunks_sql("src")
    + " SELECT k AS conv_id, chunk_index, length(chunk) AS n_chars, md5(chunk) AS chunk_md5 FROM chunks",
)
def conversation_chunks_from_turns(spark, sf):
    """Chunks of whole conversations, cut from their turns as they pass, without joining a conversation's text."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("text"))
    cut = C.chunk_pieces(turns, "conv_id", ["turn"])
    return cut.select("conv_id", "chunk_index", F.char_length("text").alias("n_chars"), F.md5("text").alias("chunk_md5"))
