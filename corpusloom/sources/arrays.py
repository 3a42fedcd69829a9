"""JSON arrays and bundles that many tasks read together.

A file is read as text cut at commas, so Spark splits it into byte ranges like any text file, on any store it can read.
Whether a comma lies in a string, and how deep in brackets it lies, follows from all that comes before it; both are
running sums: of quotes (odd: inside a string) and of brackets outside of strings. Each range sums its own pieces for
either state it may begin in, one row per range carries the states on, and so every task finds the borders of the
items. An item's pieces then meet, never a file's.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import strip
from .files import decoded, numbered_lines

#: Lines that are counted in one window.
LINES = 65_536


def _pieces(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    """Text between commas: path, block (where its byte range begins), id (in order inside the range), value."""
    raw = spark.read.option("pathGlobFilter", pattern).option("lineSep", ",").text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value",
    )


def _counted(pieces: DataFrame) -> DataFrame:
    """With ``odd`` (quotes are odd) and the change of depth if the piece begins outside (``out0``) or inside a string (``out1``)."""
    # the comma that ended the piece may itself have been escaped, which no valid file does
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    parts = F.split(plain, '"', -1)

    def depth(first: int) -> Column:
        outside = F.array_join(F.filter(parts, lambda _, i: i % 2 == first), " ")
        opens = F.length(outside) - F.length(F.translate(outside, "[{", ""))
        return opens - (F.length(outside) - F.length(F.translate(outside, "]}", "")))

    return pieces.select("*", ((F.size(parts) - 1) % 2).alias("odd"), depth(0).alias("out0"), depth(1).alias("out1"))


def _items(spark: SparkSession, path: str | list[str], pattern: str, level: int) -> DataFrame:
    """(path, item, text, rest): the file's text cut at commas of ``level`` brackets or fewer outside of strings.

    ``rest`` is the depth after the item. Inside a bundle (level 2) the keys of the object are items too. Files in
    which quotes or brackets don't match have none.
    """
    inside = Window.partitionBy("path", "block").orderBy("id")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = _counted(_pieces(spark, path, pattern))
    # whether the piece begins in another state than its range
    rows = rows.withColumn("flip", (F.sum("odd").over(upto) - F.col("odd")) % 2)
    for s in (0, 1):
        change = F.when((F.col("flip") + s) % 2 == 1, F.col("out1")).otherwise(F.col("out0"))
        rows = rows.withColumn(f"depth{s}", F.sum(change).over(upto))
    ranges = rows.groupBy("path", "block").agg(
        F.sum("odd").alias("odd"), F.max_by("depth0", "id").alias("depth0"), F.max_by("depth1", "id").alias("depth1")
    )
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("state", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    own = F.when(F.col("state") == 1, F.col("depth1")).otherwise(F.col("depth0"))
    whole = Window.partitionBy("path")
    sound = (F.sum("odd").over(whole) % 2 == 0) & (F.sum("own").over(whole) == 0)
    begins = ranges.withColumn("own", own).select("path", "block", "state", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("start"), sound.alias("sound"))

    # a file whose quotes and brackets don't come out even has no items, so that its rest doesn't become one
    known = rows.join(begins.where("sound"), ["path", "block"])
    after = F.col("start") + F.when(F.col("state") == 1, F.col("depth1")).otherwise(F.col("depth0"))
    outside = (F.col("flip") + F.col("odd") + F.col("state")) % 2 == 0
    known = known.select("path", "block", "id", "value", after.alias("after"), (outside & (after <= level)).cast("int").alias("cut"))
    known = known.withColumn("number", F.sum("cut").over(upto) - F.col("cut"))
    totals = known.groupBy("path", "block").agg(F.sum("cut").alias("cuts"))
    totals = totals.select("path", "block", F.coalesce(F.sum("cuts").over(before), F.lit(0)).alias("first"))
    numbered = known.join(totals, ["path", "block"]).withColumn("item", F.col("first") + F.col("number"))
    parts = F.array_sort(F.collect_list(F.struct("block", "id", "value", "after")))
    met = numbered.groupBy("path", "item").agg(parts.alias("parts"))
    return met.select("path", "item", F.array_join("parts.value", ",").alias("text"), F.element_at("parts", -1).after.alias("rest"))


def _closed(text: Column, level: Column, rest: Column) -> Column:
    """An item without the brackets behind it that close what is around it."""
    extra = F.greatest(level - rest, F.lit(0))
    return F.regexp_replace(text, F.concat(F.lit(r"(\s*[\]}]){"), extra.cast("string"), F.lit(r"}\s*\z")), F.lit(""))


def _objects(v: Column, schema: str) -> Column:
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.from_json(F.to_json(v), f"struct<{schema}>"))


def read_array_files(spark: SparkSession, path: str | list[str], schema: str, pattern: str = "*.json") -> DataFrame:
    """What ``files.read_json_arrays`` gives, with every file read by several tasks.

    A file that is no valid array as a whole counts as one object per line, as there. A byte-order mark before an
    array is passed over, as Spark's reader of lines does.
    """
    items = _items(spark, path, pattern, 1)
    text = _closed(F.col("text"), F.lit(1), F.col("rest"))
    opened = F.when(F.col("item") == 0, F.regexp_replace(text, r"^\s*\[", "")).otherwise(text)
    begins = (F.col("item") > 0) | F.col("text").rlike(r"^\s*\[")
    parsed = items.select("path", "item", "rest", begins.alias("begins"), opened.alias("text"), F.try_parse_json(opened).alias("v"))
    valid = F.bool_and(F.col("v").isNotNull()) | ((F.count("*") == 1) & F.bool_and(strip("text") == ""))
    whole = parsed.groupBy("path").agg((F.bool_and("begins") & (F.max_by("rest", "item") == 0) & valid).alias("ok")).where("ok").select("path")

    folder = F.regexp_extract("path", "/json_file=([^/]*)/", 1)
    name = F.coalesce(F.nullif(folder, F.lit("")), F.element_at(F.split("path", "/"), -1))
    # a row per file, as many as Spark lists on the driver; a shuffle by path would bring a file's text to one task
    rows = parsed.join(F.broadcast(whole), "path", "left_semi").withColumn("path", decoded(F.col("path")))
    rows = rows.select(name.alias("json_file"), F.col("item").cast("int").alias("segment_index"), _objects(F.col("v"), schema).alias("_r"))

    lines = numbered_lines(spark, path).join(F.broadcast(whole.select(decoded(F.col("path")).alias("path"))), "path", "left_anti")
    lines = lines.where(F.element_at(F.split("path", "/"), -1).rlike(fnmatch.translate(pattern)) & (strip("value") != ""))
    counted = lines.withColumn("_block", F.floor(F.col("line_no") / LINES))
    place = F.row_number().over(Window.partitionBy("path", "_block").orderBy("line_no")) - 1
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy("path", "_block").count().select("path", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    by_line = counted.withColumn("_place", place).join(starts, ["path", "_block"])
    spare = by_line.select(name.alias("json_file"), (F.col("_first") + F.col("_place")).cast("int").alias("segment_index"), _objects(F.try_parse_json("value"), schema).alias("_r"))
    return rows.unionByName(spare).where("_r IS NOT NULL").select("json_file", "segment_index", "_r.*")


def read_bundle_object(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of one bundle object, as ``bundles.read_bundle`` gives them, in parallel; an empty bundle is an error."""
    items = _items(spark, path, "*", 2)
    key = r'^\s*\{?\s*"chunks"\s*:\s*\['
    head = items.where(F.col("text").rlike(key)).groupBy("path").agg(F.min("item").alias("first"))
    after = items.join(head, "path").where("item >= first")
    # the array ends with the first item behind which it is closed
    ends = after.where("rest < 2").groupBy("path").agg(F.min("item").alias("last"))
    mine = after.join(ends, "path").where("item <= last")
    text = _closed(F.col("text"), F.lit(2), F.col("rest"))
    text = F.when(F.col("item") == F.col("first"), F.regexp_replace(text, key, "")).otherwise(text)
    rows = mine.where(strip("text") != "").select(F.from_json(text, schemas.BUNDLE_CHUNK_DDL).alias("c")).where("c IS NOT NULL").select("c.*")
    if rows.isEmpty():
        raise ValueError("bundle without chunks")
    return rows
