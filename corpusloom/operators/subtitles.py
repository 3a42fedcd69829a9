"""Subtitle cleaning, playlist rows, transcripts merged by book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.ids import book_from_filename
from ..functions.scalars import numbered_name
from ..functions.text import let, strip, text_or_blank

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
BOOK_RANGE = (1, 11)


def clean_subtitles(c: Column | str) -> Column:
    """Spoken text of a subtitle file: headers, cue lines and tags dropped, repeated lines once.

    Works on the line array of one file, so no shuffle. Only cue lines with a point
    before the milliseconds are recognised.
    """
    lines = F.transform(F.split(text_or_blank(c), LINE_BREAK), strip)
    spoken = F.filter(
        lines,
        lambda x: (x != "")
        & ~x.startswith("WEBVTT")
        & ~x.startswith("Kind:")
        & ~x.startswith("Language:")
        & ~F.rlike(x, F.lit(rf"\A\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}}[{K.WS_CLASS}]*-->")),
    )
    bare = F.filter(F.transform(spoken, lambda x: strip(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != "")
    kept = let(bare, lambda b: F.filter(b, lambda x, i: (i == 0) | (x != F.get(b, i - 1))))
    return F.array_join(kept, " ")


def playlist_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """``index|||title|||id`` lines; lines with another number of parts are dropped."""
    parts = F.split(F.col(column), r"\|\|\|")
    return lines.filter(F.size(parts) == 3).select(
        *[strip(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(["idx", "title", "video_id"])]
    ).withColumn("file_stem", numbered_name("idx", "title"))


def merge_by_book(files: DataFrame) -> DataFrame:
    """Transcripts of each of the eleven books under source headings: ``book, ord, text``.

    Every book is present even without a file. The pieces stay separate rows in file
    order (``ord``; 0 is the heading), so the size of a book is not limited by one
    value; concatenated in that order they are the merged text.
    """
    low, high = BOOK_RANGE
    spark = files.sparkSession
    heads = spark.range(low, high + 1).select(
        F.col("id").cast("int").alias("book"),
        F.lit(0).alias("ord"),
        F.lit("").alias("file_name"),
        F.concat(F.lit("===== MERGED BOOK "), F.col("id").cast("string"), F.lit(" =====\n")).alias("text"),
    )
    body = F.concat(
        F.lit("\n\n===== SOURCE: "), "file_name", F.lit(" =====\n"),
        F.rtrim(text_or_blank("text"), F.lit(K.WS_CHARS)), F.lit("\n"),
    )
    placed = files.select(book_from_filename("file_name").alias("book"), F.lit(1).alias("ord"), "file_name", body.alias("text"))
    return heads.unionByName(placed.filter(F.col("book").between(low, high)))
