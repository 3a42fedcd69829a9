"""Readers for transcripts, chat logs, structured records and canon files."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.ids import file_order
from ..functions.text import strip, text_or_blank
from ..operators.conversations import flatten_messages
from .lenient import repair_json, salvage_records

SKIPPED_TRANSCRIPT = "all_transcripts.txt"


def file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def decoded(c: Column) -> Column:
    """File names come back from paths percent-encoded."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def stem(name: Column | str) -> Column:
    return F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"\.[^.]*\z", "")


def read_transcripts(spark: SparkSession, path: str, contains: str | None = None) -> DataFrame:
    """``*.txt`` files, one row each (``file_ord, file_name, text``), numbered in the order of names, then of paths.

    The numbering sorts and counts the paths alone, in parallel.
    """
    files = (
        spark.read.option("pathGlobFilter", "*.txt")
        .text(path, wholetext=True)
        .select(decoded(file_name()).alias("file_name"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        .filter(F.lower("file_name") != SKIPPED_TRANSCRIPT)
    )
    if contains:
        files = files.filter(F.contains("file_name", F.lit(contains)))
    names = files.select("file_name", "path").sort("file_name", "path").rdd.zipWithIndex()
    order = spark.createDataFrame(names.map(lambda r: (r[0].path, r[1])), "path string, file_ord bigint")
    return files.join(order, "path").select("file_ord", "file_name", "text")


def unique_files(spark: SparkSession, paths: str | list[str]) -> str | list[str]:
    """``paths``, or, where several patterns may name a file twice, the files they name."""
    if isinstance(paths, str) or len(paths) < 2:
        return paths
    return sorted({unquote(f) for f in spark.read.text(paths).inputFiles()})


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files with their file and line number: ``path, line_no, value``.

    Large files stay split: a line's number is the count of lines in earlier blocks of
    its file plus its place in its own block. A file that several paths name counts once.
    """
    raw = spark.read.text(unique_files(spark, paths)).select(
        decoded(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    blocks = raw.groupBy("path", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return raw.join(starts, ["path", "_block"]).select(
        "path", (F.col("_start") + F.col("_id") - F.col("_first") + 1).cast("int").alias("line_no"), "value"
    )


def json_objects(lines: DataFrame, ddl: str) -> DataFrame:
    """Lines that hold a JSON object, parsed; blank, broken and other lines are skipped."""
    parsed = lines.withColumn("_v", F.try_parse_json(strip("value")))
    objects = parsed.filter(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")))
    keep = [c for c in lines.columns if c != "value"]
    return objects.select(*keep, F.from_json("value", ddl).alias("_o")).select(*keep, "_o.*")


def read_chat(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Unified chat lines with their file and line number."""
    lines = numbered_lines(spark, paths).withColumnRenamed("path", "file_path")
    return json_objects(lines, schemas.CHAT)


def read_chat_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Flattened conversations for indexing; a missing id becomes ``<file>-line-<n>``."""
    chat = read_chat(spark, paths)
    name = F.element_at(F.split("file_path", "/"), -1)
    text = flatten_messages("source", "conversation_id", "messages")
    cid = F.coalesce(
        F.nullif(F.col("conversation_id"), F.lit("")), F.concat(stem(name), F.lit("-line-"), F.col("line_no").cast("string"))
    )
    return chat.select(name.alias("file_name"), "line_no", cid.alias("conversation_id"), text.alias("text")).filter(
        F.col("text").isNotNull()
    )


def read_json_lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; broken lines are dropped, or stop the read with their file and number when ``strict``."""
    if not strict:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    lines = numbered_lines(spark, path).filter(strip("value") != "")
    where = F.concat(F.lit("no JSON at line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("path"))
    fine = F.when(F.try_parse_json("value").isNull(), F.raise_error(where).cast("string")).otherwise(F.col("value"))
    return lines.select(F.from_json(fine, schema).alias("_o")).select("_o.*")


def read_record_files(spark: SparkSession, path: str, pattern: str = "an*.json") -> DataFrame:
    """Structured records of ``an<N>.json`` arrays, in book order.

    A file that is no valid JSON is repaired, and failing that read line by line.
    ``file_ord, file_name, rec_i`` give the order. Only objects of an array count.
    """
    files = (
        spark.read.option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(decoded(file_name()).alias("file_name"), F.col("value").alias("raw"))
    )
    ready = files.withColumn("json", repair_json(F.col("raw")))
    items = F.try_variant_get(F.try_parse_json("json"), "$", "array<variant>")
    parsed = F.when(
        F.col("json").isNotNull(),
        F.transform(
            F.filter(items, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))),
            lambda v: F.from_json(F.to_json(v), f"struct<{schemas.RECORDS}>"),
        ),
    ).otherwise(salvage_records(F.when(F.col("json").isNull(), F.col("raw"))))
    return ready.select(
        file_order("file_name").alias("file_ord"), "file_name", F.posexplode(parsed).alias("rec_i", "_r")
    ).select("file_ord", "file_name", "rec_i", "_r.*")


def read_json_arrays(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """Files of JSON objects, one array or one object per line: ``json_file, segment_index`` and the fields.

    A folder ``json_file=<name>``, as ``write_segments`` makes it, names the file.
    """
    folder = F.regexp_extract(decoded(F.col("_metadata.file_path")), "/json_file=([^/]*)/", 1)
    files = (
        spark.read.option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(F.coalesce(F.nullif(folder, F.lit("")), decoded(file_name())).alias("json_file"), F.col("value").alias("raw"))
    )
    whole = F.try_variant_get(F.try_parse_json("raw"), "$", "array<variant>")
    lines = F.transform(F.filter(F.split("raw", "\n"), lambda x: strip(x) != ""), F.try_parse_json)
    items = F.coalesce(whole, lines)
    objects = F.transform(
        items,
        lambda v: F.when(
            F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.from_json(F.to_json(v), f"struct<{schema}>")
        ),
    )
    rows = files.select("json_file", F.posexplode(objects).alias("segment_index", "_r"))
    return rows.filter(F.col("_r").isNotNull()).select("json_file", "segment_index", "_r.*")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Nested chat exports, one JSON object per file."""
    return spark.read.schema(schemas.CHAT_EXPORT).option("multiLine", True).json(path)


def read_agent_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """Agent transcripts ``<id>/<file>.jsonl``: one row per line, the folder naming the conversation."""
    lines = numbered_lines(spark, f"{root}/*/*.jsonl")
    parsed = json_objects(lines, schemas.AGENT_LINE)
    return parsed.withColumn("conversation_id", F.element_at(F.split("path", "/"), -2))


def read_canon_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Canon lines with their order in ``pos``; rows without id or text are dropped."""
    lines = numbered_lines(spark, path)
    rows = json_objects(lines.select(F.col("line_no").cast("bigint").alias("pos"), "value"), schemas.CANON_CORPUS)
    return rows.filter((text_or_blank("canon_id") != "") & (text_or_blank("canon_content") != ""))


def read_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turn logs ``<conversation id>.jsonl`` of one folder."""
    lines = numbered_lines(spark, f"{folder}/*.jsonl")
    rows = json_objects(lines, schemas.TURN_LINE)
    return rows.select(stem(F.element_at(F.split("path", "/"), -1)).alias("conversation_id"), "line_no", "ts", "q", "a", "latency_ms")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Conversation index (a JSON array) with the row order in ``pos``."""
    rows = read_json_arrays(spark, path, schemas.CONVERSATION_INDEX)
    return rows.select(F.col("segment_index").alias("pos"), "id", "title", "updated_ts")


def read_vector_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored chunk table, or None where there is none."""
    if not path_exists(spark, path):
        return None
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def index_status(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Existence and row count per book; a missing table counts zero."""
    parts = []
    for book, path in paths.items():
        stored = read_vector_table(spark, path)
        counted = spark.range(1).select(F.lit(0).cast("bigint").alias("n")) if stored is None else stored.agg(F.count("*").alias("n"))
        parts.append(counted.select(F.lit(book).alias("book"), (F.col("n") > 0).alias("exists"), F.col("n").alias("count")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
