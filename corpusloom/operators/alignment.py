"""Agreement between transcript and canon, quality, chains, census and review reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.chains import extract_chains
from ..functions.ids import book_or_zero
from ..functions.scoring import agreement, agreement_inputs, quality_class, quality_reason
from ..functions.text import canon_opening, is_blank, one_line, strip, text_or_blank, transcript_opening


def annotate(segments: DataFrame, ok_min: float = K.MAP_OK_MIN, suspect_min: float = K.MAP_SUSPECT_MIN) -> DataFrame:
    """Add use, agreement score, quality with reason, and chains (books 3 to 6 with good quality only).

    Only rows with canon text reach the similarity code.
    """
    canon = strip("canon_content")
    has = canon != ""
    left, right = agreement_inputs(
        F.when(has, strip("transcript_content")), F.when(has, canon)
    )
    scored = segments.withColumns({"_l": left, "_r": right}).withColumn(
        "_score", agreement(F.when(has, F.col("_l")), F.when(has, F.col("_r")))
    )
    quality = quality_class(F.col("_score"), ok_min, suspect_min)
    reason = quality_reason(F.col("_score"), ok_min, suspect_min)
    book = book_or_zero("book")
    none = F.array().cast("array<array<string>>")
    wanted = has & book.isin(*K.CHAIN_BOOKS) & (quality == "ok")
    judged = scored.withColumn("_chains", extract_chains(F.when(wanted, canon)))
    return judged.withColumns(
        {
            "use": F.when(has, F.lit("yes")).otherwise(F.lit("no")),
            "mapping_agreement_score": F.when(has, F.round("_score", 4)),
            "mapping_quality": F.when(has, quality).otherwise(F.lit("bad")),
            "mapping_quality_reason": F.when(has, reason).otherwise(F.lit("empty_canon_text")),
            "chains": F.when(wanted, F.col("_chains.chains")).otherwise(none),
            "chain_extraction": F.when(~has, F.lit("empty_canon"))
            .when(~book.isin(*K.CHAIN_BOOKS), F.lit("skipped_book"))
            .when(quality != "ok", F.lit("skipped_mapping_quality"))
            .otherwise(F.col("_chains.method")),
        }
    ).drop("_l", "_r", "_score", "_chains")


def census(annotated: DataFrame) -> DataFrame:
    """All census counts in one pass, as one row."""
    with_id = ~is_blank("canon_id")
    quality = text_or_blank("mapping_quality")
    chain_book = book_or_zero("book").isin(*K.CHAIN_BOOKS)
    filled = F.coalesce(F.exists("chains", lambda c: F.size(c) > 0), F.lit(False))
    counts: list[Column] = [
        F.count("*").alias("total_segments"),
        F.count_if(with_id).alias("segments_with_canon_id"),
        F.count_if(with_id & is_blank("canon_content")).alias("empty_canon_with_canon_id"),
        F.count_if(F.col("use") == "yes").alias("use_yes"),
        F.count_if(F.col("use") == "no").alias("use_no"),
    ]
    for name in ("ok", "suspect", "bad"):
        counts.append(F.count_if(quality == name).alias(f"quality_{name}"))
        counts.append(F.count_if((quality == name) & with_id).alias(f"quality_{name}_with_id"))
    counts += [
        F.count_if(chain_book).alias("segments_books_3_to_6"),
        F.count_if(chain_book & filled).alias("chains_nonempty_books_3_6"),
        F.count_if(chain_book & (F.col("chain_extraction") == "unmatched_needs_review")).alias("chains_unmatched_books_3_6"),
    ]
    return annotated.agg(*counts)


def chain_methods(annotated: DataFrame) -> DataFrame:
    return (
        annotated.filter(book_or_zero("book").isin(*K.CHAIN_BOOKS))
        .groupBy(text_or_blank("chain_extraction").alias("chain_extraction"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "chain_extraction")
    )


def census_lines(annotated: DataFrame) -> DataFrame:
    """The census as ordered ``name: value`` lines."""
    c = census(annotated)
    names = [n for n in c.columns]
    pairs = F.array(*[F.struct(F.lit(i).alias("ord"), F.concat(F.lit(f"{n}: "), F.col(n).cast("string")).alias("line")) for i, n in enumerate(names)])
    scalars = c.select(F.explode(pairs).alias("p")).select("p.ord", F.lit("").alias("key"), F.lit(0).cast("bigint").alias("n"), "p.line")
    methods = chain_methods(annotated).select(
        F.lit(len(names)).alias("ord"), F.col("chain_extraction").alias("key"), (-F.col("n")).alias("n"),
        F.concat(F.lit("  "), "chain_extraction", F.lit(": "), F.col("n").cast("string")).alias("line"),
    )
    return scalars.unionByName(methods).orderBy("ord", "n", "key").select("line")


REPORT_COLUMNS = [
    "json_file", "segment_index", "transcript_id", "canon_id", "book", "use", "mapping_quality",
    "mapping_agreement_score", "chain_extraction",
]


def alignment_report(annotated: DataFrame) -> DataFrame:
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("None" if c == "mapping_agreement_score" else "")).alias(c) for c in REPORT_COLUMNS]
    return annotated.select(*shown)


def review_report(annotated: DataFrame) -> DataFrame:
    """Doubtful segments of the review book with both openings on one line."""
    doubtful = (book_or_zero("book") == K.REVIEW_BOOK) & F.col("mapping_quality").isin("suspect", "bad")
    return annotated.filter(doubtful).select(
        "json_file", "segment_index",
        strip("transcript_id").alias("transcript_id"),
        strip("canon_id").alias("canon_id"),
        "mapping_quality",
        one_line(transcript_opening("transcript_content")).alias("transcript_opening"),
        one_line(canon_opening("canon_content")).alias("canon_opening"),
        one_line("mapping_quality_reason", 400).alias("mismatch_reason"),
    )
