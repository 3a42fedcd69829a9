"""Transcript segmenting: tagging, splitting, id inference, canon enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.ids import (
    REFERENCE,
    book_from_filename,
    book_from_reference,
    book_with_fallback,
    canon_id,
    id_from_reference,
    infer_id,
    is_transition_only,
    tag_references,
    text_supports_id,
)
from ..functions.text import is_blank, let, or_none, strip, text_or_blank


def split_segments(tagged: Column) -> Column:
    """``array<struct<ref,body>>`` of a tagged text: a non-blank lead, then one entry per header."""
    refs = F.regexp_extract_all(tagged, F.lit(REFERENCE), F.lit(1))
    bodies = F.transform(F.split(tagged, REFERENCE), strip)

    def entry(ref: Column, body: Column) -> Column:
        return F.struct(strip(ref).alias("ref"), body.alias("body"))

    def assemble(parts: Column) -> Column:
        lead = F.get(parts, F.lit(0))
        headed = F.transform(refs, lambda r, i: entry(r, F.get(parts, i + 1)))
        return F.when(lead != "", F.concat(F.array(entry(F.lit(""), lead)), headed)).otherwise(headed)

    return let(bodies, assemble)


def segment_files(files: DataFrame, markers: dict[str, str] | None = None) -> DataFrame:
    """Segments of transcript files (``file_name, text``), one row each, ids inferred where a header gives none.

    A file is one row, so the following segment is looked up inside its own array:
    no shuffle and no window.
    """
    others = [c for c in files.columns if c not in ("file_name", "text")]
    name = F.col("file_name")
    tagged = files.withColumn("_tagged", tag_references("text", name, markers))
    pieces = tagged.withColumn("_segs", split_segments(F.col("_tagged")))
    following = let(
        F.col("_segs"),
        lambda segs: F.transform(
            segs,
            lambda s, i: F.struct(
                s["ref"].alias("ref"), s["body"].alias("body"),
                F.coalesce(F.get(segs, i + 1)["body"], F.lit("")).alias("next"),
            ),
        ),
    )
    rows = pieces.select(
        *others,
        F.concat(F.regexp_replace(name, r"\.[^.]*\z", ""), F.lit(".json")).alias("json_file"),
        book_from_filename(name).alias("_file_book"),
        F.posexplode(following).alias("segment_index", "_s"),
    ).select("*", "_s.*").drop("_s")
    tid = id_from_reference("ref")
    shaped = rows.select(
        *others, "json_file", "segment_index",
        tid.alias("transcript_id"),
        canon_id(tid).alias("canon_id"),
        book_with_fallback(book_from_reference("ref"), F.col("_file_book")).alias("book"),
        F.col("body").alias("transcript_content"),
        F.col("next").alias("_next"),
    )
    return fill_missing_ids(shaped, "_next").drop("_next")


def fill_missing_ids(segments: DataFrame, next_text: str) -> DataFrame:
    """Infer blank ids from the segment's own opening, else from it together with the next segment."""
    body, after = strip("transcript_content"), strip(next_text)
    missing = is_blank("transcript_id")
    # Only rows without an id reach the inference; their lead is all it reads.
    own = infer_id(F.when(missing, body))
    peek = infer_id(F.when(missing & (after != "") & ~is_transition_only(body), F.concat(body, F.lit(" "), after)))
    named = segments.withColumns({"_own": own, "_peek": peek})
    found = F.when(F.col("_own") != "", F.col("_own")).otherwise(F.col("_peek"))
    named = named.withColumn("_tid", F.when(missing, found).otherwise(F.lit(""))).drop("_own", "_peek")
    has = F.col("_tid") != ""
    head = F.regexp_extract("_tid", r"\A(\d+)", 1).try_cast("int")
    return named.withColumns(
        {
            "transcript_id": F.when(has, F.col("_tid")).otherwise(F.col("transcript_id")),
            "canon_id": F.when(has, canon_id("_tid")).otherwise(F.col("canon_id")),
            "book": F.when(has & (head > 0), head).otherwise(F.col("book")),
        }
    ).drop("_tid")


def infer_from_neighbours(segments: DataFrame) -> DataFrame:
    """The same inference for a flat segment table (``json_file, segment_index``, without gaps).

    The next row is found by an equi-join on its number, so a large file needs no single task.
    """
    lead = F.substring(strip("transcript_content"), 1, K.LEAD_CHARS)
    following = segments.select(
        "json_file", (F.col("segment_index") - 1).alias("segment_index"), lead.alias("_next")
    )
    return fill_missing_ids(segments.join(following, ["json_file", "segment_index"], "left"), "_next").drop("_next")


def keep_previous_canon(new: DataFrame, old: DataFrame) -> DataFrame:
    """Carry non-empty canon texts over a rebuild: same place and ids first, else the last row with the same ids."""
    ids = ["transcript_id", "canon_id"]
    trimmed = {c: strip(c) for c in ids}
    before = old.withColumns({**trimmed, "_text": strip("canon_content")}).filter(F.col("_text") != "")
    placed = before.select("json_file", "segment_index", *ids, F.col("_text").alias("_same"))
    last = before.groupBy("json_file", *ids).agg(F.max_by("_text", "segment_index").alias("_keyed"))
    mine = new.withColumns({f"_{c}": v for c, v in trimmed.items()})
    keys = {c: f"_{c}" for c in ids}
    placed = placed.withColumnsRenamed(keys)
    last = last.withColumnsRenamed(keys)
    joined = mine.join(placed, ["json_file", "segment_index", *keys.values()], "left").join(
        last, ["json_file", *keys.values()], "left"
    )
    kept = F.coalesce(or_none(strip("canon_content")), F.col("_same"), F.col("_keyed"), F.lit(""))
    value = F.when(is_blank("canon_content"), kept).otherwise(F.col("canon_content"))
    return joined.withColumn("canon_content", value).select(*new.columns)


def enrich(
    segments: DataFrame, canon: DataFrame, *, spread: str | list[str], only_missing: bool = False, check_support: bool = True,
    column: str = "canon_content",
) -> DataFrame:
    """Canon text per segment by canon id, blank where the text does not mention its id.

    ``canon`` is ``canon_id, canon_text``. Rows that need no text get a key of their own,
    made from ``spread`` (unique columns), so they do not pile up on one blank key.
    """
    unique = [spread] if isinstance(spread, str) else spread
    cid, tid = strip("canon_id"), strip("transcript_id")
    if check_support:
        wanted = (cid != "") & ((tid == "") | text_supports_id(tid, "transcript_content"))
    else:
        wanted = cid != ""
    flagged = segments.withColumn("_wanted", wanted)
    present = F.lit(False)
    if only_missing and column in segments.columns:
        present = ~is_blank(column)
    needs = F.col("_wanted") & ~present
    filler = F.concat(F.lit("\u0000"), F.xxhash64(*unique).cast("string"))
    keyed = flagged.withColumn("_key", F.when(needs, cid).otherwise(filler))
    texts = canon.groupBy(strip("canon_id").alias("_key")).agg(F.max("canon_text").alias("_text"))
    joined = keyed.join(texts, "_key", "left")
    value = F.when(~F.col("_wanted"), F.lit("")).when(present, F.col(column) if column in segments.columns else F.lit(""))
    value = value.otherwise(text_or_blank("_text"))
    out = [c for c in segments.columns if c != column]
    return joined.withColumn("_value", value).select(*out, F.col("_value").alias(column))


def missing_canon() -> Column:
    return ~is_blank("canon_id") & is_blank("canon_content")


def drop_missing_canon(segments: DataFrame) -> DataFrame:
    return segments.filter(~missing_canon())


def missing_rows(segments: DataFrame) -> DataFrame:
    return segments.filter(missing_canon()).select(
        "json_file", "segment_index", strip("transcript_id").alias("transcript_id"), strip("canon_id").alias("canon_id")
    )


def missing_pairs(segments: DataFrame) -> DataFrame:
    tid = F.coalesce(or_none(F.col("transcript_id")), F.lit("(empty)"))
    return missing_rows(segments).select("canon_id", tid.alias("transcript_id")).distinct()


def missing_counts(segments: DataFrame) -> DataFrame:
    tid = F.coalesce(or_none(F.col("transcript_id")), F.lit("(empty)"))
    return missing_rows(segments).agg(
        F.count("*").alias("segments"),
        F.count_distinct(F.struct("canon_id", tid)).alias("pairs"),
        F.count_distinct("canon_id").alias("canon_ids"),
    )


def missing_lines(segments: DataFrame) -> DataFrame:
    """The missing report as ordered lines: counts, unique pairs, distinct ids and the full list."""
    rows = missing_rows(segments).withColumn("transcript_id", F.coalesce("transcript_id", F.lit("")))
    heads = [
        (0, F.concat(F.lit("Total segments with canon_id but empty canon_content: "), F.col("segments").cast("string"))),
        (1, F.lit("")),
        (2, F.lit("Unique (canon_id, transcript_id) pairs — tab-separated columns:")),
        (3, F.concat(F.lit("Count: "), F.col("pairs").cast("string"))),
        (4, F.lit("canon_id\ttranscript_id")),
        (6, F.lit("")),
        (7, F.concat(F.lit("Distinct canon_id only (count "), F.col("canon_ids").cast("string"), F.lit("):"))),
        (9, F.lit("")),
        (10, F.lit("--- Full segment list (tab-separated) ---")),
        (11, F.lit("json_file\tsegment_index\ttranscript_id\tcanon_id")),
    ]
    head = missing_counts(segments).select(F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), line.alias("line")) for i, line in heads])).alias("h")).select("h.ord", "h.line")

    def part(df: DataFrame, number: int, line: Column, a: str = "", n: Column | None = None, b: str = "") -> DataFrame:
        named = lambda c: F.col(c) if c else F.lit("")
        return df.select(F.lit(number).alias("ord"), named(a).alias("a"), (F.lit(0) if n is None else n).cast("bigint").alias("n"), named(b).alias("b"), line.alias("line"))

    tabbed = lambda *names: F.concat_ws("\t", *[F.col(c).cast("string") for c in names])
    lines = head.select("ord", F.lit("").alias("a"), F.lit(0).cast("bigint").alias("n"), F.lit("").alias("b"), "line")
    lines = lines.unionByName(part(missing_pairs(segments), 5, tabbed("canon_id", "transcript_id"), "canon_id", None, "transcript_id"))
    lines = lines.unionByName(part(rows.select("canon_id").distinct(), 8, F.col("canon_id"), "canon_id"))
    lines = lines.unionByName(part(rows, 12, tabbed("json_file", "segment_index", "transcript_id", "canon_id"), "json_file", F.col("segment_index"), "transcript_id"))
    return lines.orderBy("ord", "a", "n", "b").select("line")


def fill_simple(rows: DataFrame, canon: DataFrame, spread: str | list[str]) -> DataFrame:
    """Id and canon text per row by the plain rules: longer lead, no strict pass, no support check."""
    tid = infer_id("transcript_content", chars=K.LEAD_CHARS_SIMPLE, strict_first=False)
    named = rows.withColumn("transcript_id", tid).withColumn("canon_id", canon_id("transcript_id"))
    return enrich(named, canon, spread=spread, check_support=False, column="canon_sutta")


def fill_counts(filled: DataFrame, by: str = "json_file") -> DataFrame:
    return filled.groupBy(by).agg(
        F.count("*").alias("rows"),
        F.count_if((F.col("canon_id") != "") & (F.col("canon_sutta") != "")).alias("filled"),
    )
