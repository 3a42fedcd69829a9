"""Semantic mapping: teacher rows, units, canon candidates, status and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import native
from ..functions.ids import ID3, book_from_canon_id
from ..functions.scalars import unit_suffix
from ..functions.scoring import clean_match_type, mapping_status
from ..functions.text import (
    let,
    normalize_for_markers,
    normalize_for_similarity,
    squeeze,
    strip,
    text_or_blank,
    title_and_opening,
)
from ..storage import stored
from .dedup import keep_first, top_per_key

#: Canon entries of a tile and texts of a block, which meet as one row.
TILE, TEXTS = 64, 128
#: Order values, and parts of a book's texts, that are numbered in one window.
SPAN, SALTS = 65_536, 64


def teacher_rows(files: DataFrame, text: str = "text") -> DataFrame:
    """Text sliced at every three-part id; what precedes the first id is dropped."""
    others = [c for c in files.columns if c != text]
    body = text_or_blank(text)
    ids = F.regexp_extract_all(body, F.lit(ID3), F.lit(1))
    slices = let(
        F.split(body, ID3),
        lambda pieces: F.transform(
            ids, lambda tid, i: F.struct(tid.alias("tid"), strip(F.concat(tid, F.get(pieces, i + 1))).alias("text"))
        ),
    )
    return files.select(*others, F.posexplode(slices).alias("row_ord", "_r")).select(
        *others, "row_ord", F.col("_r.tid").alias("teacher_id"),
        F.regexp_extract("_r.tid", r"\A([0-9]+)", 1).try_cast("int").alias("book"),
        F.col("_r.text").alias("text"),
    )


def unit_texts(c: Column | str, min_row: int = K.MIN_ROW_CHARS, max_units: int = K.MAX_UNITS_PER_ROW) -> Column:
    """Up to ``max_units`` units of a row, cut after end markers that have enough text on both sides.

    Short rows keep their case; longer ones come back normalised.
    """
    flat = squeeze(c)
    long_row = let(normalize_for_markers(flat), lambda norm: _cut_units(norm, max_units))
    return F.when(F.length(flat) < min_row, F.array(flat)).otherwise(long_row)


def _cut_units(norm: Column, max_units: int) -> Column:
    n = F.length(norm)

    def ends(marker: str) -> Column:
        pieces = F.split(norm, marker)
        lengths = F.transform(pieces, lambda p: F.length(p) + len(marker))
        sums = F.aggregate(
            lengths,
            F.array(F.lit(0)),
            lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x),
        )
        # The first entry is the start, the last lies behind the final piece.
        return F.when(F.size(pieces) > 1, F.slice(sums, F.lit(2), F.size(pieces) - 1)).otherwise(
            F.array().cast("array<int>")
        )

    boundaries = F.array_sort(F.array_distinct(F.concat(*[ends(m) for m in K.SPLIT_MARKERS])))
    room = max(1, max_units - 1)

    def cut(acc: Column, b: Column) -> Column:
        last = acc["last"]
        ok = (
            (F.size(acc["cuts"]) < room)
            & (b > last)
            & (b - last >= K.MIN_UNIT_BEFORE)
            & (n - b >= K.MIN_UNIT_AFTER)
        )
        return F.struct(
            F.when(ok, b).otherwise(last).alias("last"),
            F.when(ok, F.array_append(acc["cuts"], F.struct(last.alias("s"), b.alias("e")))).otherwise(acc["cuts"]).alias("cuts"),
        )

    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<s:int,e:int>>").alias("cuts"))
    spans = F.aggregate(
        boundaries, start, cut, lambda acc: F.array_append(acc["cuts"], F.struct(acc["last"].alias("s"), n.alias("e")))
    )
    pieces = F.transform(spans, lambda x: F.btrim(F.substr(norm, x["s"] + 1, x["e"] - x["s"]), F.lit(" ")))
    if max_units == 1:
        pieces = F.array(F.array_join(F.filter(pieces, lambda p: p != ""), " "))
    kept = F.slice(F.filter(pieces, lambda p: F.length(p) >= K.MIN_UNIT_CHARS), 1, max_units)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(norm))


def split_units(rows: DataFrame, min_row: int = K.MIN_ROW_CHARS, max_units: int = K.MAX_UNITS_PER_ROW) -> DataFrame:
    others = [c for c in rows.columns if c != "text"]
    prepared = rows.withColumn("_units", unit_texts("text", min_row, max_units))
    return prepared.select(*others, F.posexplode("_units").alias("unit_ord", "text")).withColumn(
        "unit_id", F.concat("teacher_id", F.lit("#"), unit_suffix(F.col("unit_ord")))
    )


def keywords(title: Column, opening: Column) -> Column:
    """The twelve most frequent words of title and opening, by count then alphabet."""
    source = F.lower(F.concat(title, F.lit(" "), opening))
    words = F.regexp_extract_all(source, F.lit("[a-z\u0080-ɏ']{3,}"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in K.KEYWORD_STOPWORDS])
    kept = F.filter(words, lambda w: ~F.array_contains(stop, w))
    counted = let(
        kept,
        lambda ws: F.transform(
            F.array_distinct(ws),
            lambda w: F.struct((-F.size(F.filter(ws, lambda x: x == w))).alias("n"), w.alias("w")),
        ),
    )
    return F.transform(F.slice(F.array_sort(counted), 1, K.KEYWORDS_MAX), lambda p: p["w"])


def canon_index(corpus: DataFrame) -> DataFrame:
    """Canon rows with book, title, opening and keywords; rows without id, text or book are dropped."""
    usable = corpus.filter((text_or_blank("canon_id") != "") & (text_or_blank("canon_content") != ""))
    placed = usable.withColumn("book", book_from_canon_id("canon_id")).filter(F.col("book") > 0)
    parts = placed.withColumn("_p", title_and_opening("canon_content"))
    others = [c for c in corpus.columns if c not in ("canon_id", "canon_content", "book")]
    return parts.select(
        *others, "canon_id", "book", F.col("_p.title").alias("title"), F.col("_p.opening").alias("opening"),
        F.when(F.col("_p.quoted"), keywords(F.col("_p.title"), F.col("_p.opening")))
        .otherwise(F.array().cast("array<string>"))
        .alias("keywords"),
    )


def similarity_key(c: Column | str, chars: int = K.SIMILARITY_CHARS) -> Column:
    """The first characters of the normalised text; where a text's start has enough of them, the rest isn't normalised.

    Each step works character by character or on runs, so a start's form is the start of the whole's; only the case of a
    capital sigma hangs on what follows.
    """
    t = text_or_blank(c)
    n = chars + chars // 2
    start = F.substring(t, 1, n)
    sure = ~F.contains(start, F.lit("Σ"))
    early = let(
        normalize_for_similarity(start),
        lambda key: F.when(((F.length(key) >= chars) & sure) | (F.length(t) <= n), key),
    )
    return F.substring(F.coalesce(early, normalize_for_similarity(t)), 1, chars)


def _meetings(units: DataFrame, canon: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Keyed units, and what came of the blocks of texts and tiles of openings that met: ``book, _keys, _pairs, _best, _scored``.

    Both sides are in order of length. A block first meets the tile nearest to it in length; its k-th scores are the
    floors with which it meets the other tiles of the book, but for those whose lengths alone keep them below.
    """
    # texts are normalised once, for the blocks and for the units' rows
    keyed = stored(units.select("unit_id", "book", similarity_key("text").alias("_key")), "keys")
    openings = canon.select("book", "pos", similarity_key("opening").alias("opening"))
    spans = openings.where("opening IS NOT NULL").withColumn("_span", F.floor(F.col("pos") / SPAN))
    place = F.row_number().over(Window.partitionBy("book", "_span").orderBy(F.length("opening"), "pos")) - 1
    lengths = lambda c: (F.min(F.length(c)).alias("_low"), F.max(F.length(c)).alias("_high"))
    tiles = spans.withColumn("_tile", F.floor(place / TILE)).groupBy("book", "_span", "_tile").agg(
        F.array_sort(F.collect_list(F.struct("pos", "opening"))).alias("_entries"), *lengths("opening")
    )
    texts = keyed.select("book", "_key").filter(F.col("_key").isNotNull()).distinct()
    salted = texts.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)))
    number = F.row_number().over(Window.partitionBy("book", "_salt").orderBy(F.length("_key"), "_key")) - 1
    blocks = salted.withColumn("_block", F.floor(number / TEXTS)).groupBy("book", "_salt", "_block").agg(
        F.collect_list("_key").alias("_keys"), *lengths("_key")
    )
    tiles, blocks = stored(tiles, "tiles"), stored(blocks, "blocks")

    # the keys are few bytes and the comparison dear, so the meetings are dealt out evenly
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile_key, block_key = ["book", "_span", "_tile"], ["book", "_salt", "_block"]

    def met(meet: DataFrame, floors: Column) -> DataFrame:
        done = meet.repartition(n).withColumn("_met", native.best_in_tile(F.col("_keys"), floors, F.col("_entries"), k))
        pairs = F.size("_keys").cast("long") * F.size("_entries")
        return done.select(*block_key, "_span", "_tile", "_keys", pairs.alias("_pairs"), F.col("_met.best").alias("_best"), F.col("_met.scored").alias("_scored"))

    ends = tiles.select(*tile_key, F.col("_low").alias("_tl"), F.col("_high").alias("_th"))
    away = F.abs(F.col("_low") + F.col("_high") - F.col("_tl") - F.col("_th"))
    both = blocks.drop("_keys").join(ends, "book").withColumn("_away", away)
    near = top_per_key(both, block_key, ["_away", "_span", "_tile"], 1).select(*block_key, "_span", "_tile")
    none = F.transform("_keys", lambda _: F.lit(0.0))
    first = stored(met(near.join(blocks, block_key).join(tiles.select(*tile_key, "_entries"), tile_key), none), "met")
    kth = F.transform("_best", lambda top: F.when(F.size(top) == k, F.get(top, F.lit(k - 1)).score).otherwise(0.0))
    floors = first.select(*block_key, kth.alias("_floors"))
    # twice the shorter length over both bounds the ratio
    short = F.least("_th", "_high")
    reach = F.coalesce(F.try_divide(2.0 * short, short + F.greatest("_tl", "_low", short)), F.lit(1.0))
    later = both.join(near, [*block_key, "_span", "_tile"], "left_anti").join(floors, block_key)
    later = later.where(reach >= F.array_min("_floors")).select(*block_key, "_span", "_tile", "_floors")
    rest = met(later.join(blocks, block_key).join(tiles.select(*tile_key, "_entries"), tile_key), F.col("_floors"))
    return keyed, first.unionByName(rest)


def candidate_scores(units: DataFrame, canon: DataFrame, k: int = K.TOP_K_DEFAULT) -> DataFrame:
    """The ``k`` canon openings of the same book most similar to each unit: ``unit_id, pos, score, rank``.

    Equal texts are scored once: units are first reduced to distinct (book, key). Canon
    entries are packed into tiles by length, texts into blocks, and a block meets a tile
    as one row that yields at most ``k`` entries per text; so a tile travels once per
    block, and no task ever holds a whole book. ``canon`` carries its order in ``pos``.
    """
    keyed, met = _meetings(units, canon, k)
    each = met.select("book", F.explode(F.arrays_zip("_keys", "_best")).alias("_r"))
    scored = each.select("book", F.col("_r._keys").alias("_key"), F.explode("_r._best").alias("_b")).select(
        "book", "_key", F.col("_b.pos").alias("pos"), F.col("_b.score").alias("score")
    )
    best = top_per_key(scored, ["book", "_key"], [F.desc("score"), F.asc("pos")], k)
    packed = best.groupBy("book", "_key").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "pos"))).alias("_list")
    )
    joined = keyed.select("unit_id", "book", "_key").join(packed, ["book", "_key"])
    return joined.select("unit_id", "book", F.posexplode("_list").alias("rank", "_c")).select(
        "unit_id", "book", F.col("_c.pos").alias("pos"), (-F.col("_c.o")).alias("score"), (F.col("rank") + 1).alias("rank")
    )


def candidate_work(units: DataFrame, canon: DataFrame, k: int = K.TOP_K_DEFAULT) -> DataFrame:
    """``book, pairs, scored``: pairs of distinct texts and openings that met, and how many of them had to be scored."""
    met = _meetings(units, canon, k)[1]
    return met.groupBy("book").agg(F.sum("_pairs").alias("pairs"), F.sum("_scored").alias("scored"))


def top_gap(scores: DataFrame) -> DataFrame:
    """Top score and the gap to the second per unit; one candidate alone has no second."""
    first = F.max(F.when(F.col("rank") == 1, F.col("score")))
    second = F.max(F.when(F.col("rank") == 2, F.col("score")))
    return scores.groupBy("unit_id").agg(
        first.alias("top_score"),
        second.alias("second_score"),
        F.min_by("pos", "rank").alias("top_pos"),
        F.count("*").alias("n_candidates"),
    )


def candidate_block(canon: DataFrame, scores: DataFrame) -> DataFrame:
    """Numbered candidate text per unit (at most ``k`` entries each)."""
    entry = F.concat(
        F.col("rank").cast("string"), F.lit(". canon_id: "), "canon_id", F.lit("\ntitle: "), "title",
        F.lit("\nopening: "), "opening", F.lit("\nkeywords: "), F.array_join("keywords", ", "), F.lit("\n"),
    )
    joined = scores.join(canon.select("pos", "canon_id", "title", "opening", "keywords"), "pos")
    blocks = joined.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["e"]), "")
    return blocks.select("unit_id", F.rtrim(text, F.lit(K.WS_CHARS)).alias("block"))


def pending_units(units: DataFrame, done: DataFrame, order: list[str]) -> DataFrame:
    """Units not processed before, the first row of each id."""
    first = keep_first(units, ["unit_id"], order)
    return first.join(done.select(F.col("unit_id").cast("string")).distinct(), "unit_id", "left_anti")


def apply_fallback(mapped: DataFrame) -> DataFrame:
    """Replace an empty unknown choice by a clearly best candidate.

    Needs ``top_score``, ``second_score`` and ``top_canon_id`` next to the choice columns.
    """
    gap = F.col("top_score") - F.coalesce("second_score", F.lit(0.0))
    fires = (
        (F.coalesce("match_type", F.lit("unknown")) == "unknown")
        & F.coalesce(F.size("best_canon_ids") <= 0, F.lit(True))
        & (text_or_blank("top_canon_id") != "")
        & (F.col("top_score") >= K.FALLBACK_SCORE_MIN)
        & (gap >= K.FALLBACK_GAP_MIN)
    )
    fires = F.coalesce(fires, F.lit(False))
    text = F.format_string(
        "Heuristic fallback: top candidate by retrieval (score=%.3f, gap=%.3f).", F.col("top_score"), gap
    )
    none = F.array().cast("array<string>")
    marked = mapped.withColumn("fallback_used", fires)
    f = F.col("fallback_used")
    return marked.withColumns(
        {
            "best_canon_ids": F.when(f, F.array("top_canon_id")).otherwise(F.col("best_canon_ids")),
            "primary_canon_id": F.when(f, F.col("top_canon_id")).otherwise(F.col("primary_canon_id")),
            "confidence": F.when(f, F.round(F.least(F.lit(0.85), F.lit(0.60) + F.col("top_score")), 3)).otherwise(F.col("confidence")),
            "is_mixed": F.when(f, F.lit(False)).otherwise(F.col("is_mixed")),
            "needs_review": F.when(f, F.lit(False)).otherwise(F.col("needs_review")),
            "evidence_phrases": F.when(f, none).otherwise(F.col("evidence_phrases")),
            "reason": F.when(f, text).otherwise(F.col("reason")),
            "match_type": F.when(f, F.lit("probable")).otherwise(F.col("match_type")),
        }
    )


def assign_status(mapped: DataFrame) -> DataFrame:
    """Validated choice fields and the final status."""
    none = F.array().cast("array<string>")
    best = F.coalesce("best_canon_ids", none)
    clean = mapped.withColumns(
        {
            "best_canon_ids": best,
            "primary_canon_id": F.coalesce(F.col("primary_canon_id"), F.get(best, F.lit(0))),
            "confidence": F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)),
            "is_mixed": F.coalesce("is_mixed", F.lit(False)),
            "_flagged": F.coalesce("needs_review", F.lit(False)),
            "evidence_phrases": F.filter(F.coalesce("evidence_phrases", none), lambda p: text_or_blank(p) != ""),
            "reason": text_or_blank("reason"),
            "match_type": clean_match_type("match_type"),
        }
    )
    status = mapping_status(
        F.col("primary_canon_id"), F.col("best_canon_ids"), F.col("confidence"), F.col("is_mixed"), F.col("_flagged"),
        F.col("evidence_phrases"), F.col("match_type"),
    )
    return clean.withColumn("status", status).withColumn("needs_review", F.col("status") != "accept").drop("_flagged")


def run_counts(results: DataFrame) -> DataFrame:
    """Counters of a run. ``returned_unknown`` and ``chose_nonempty`` describe the choice before the fallback."""
    gap = F.when(F.col("second_score").isNull(), F.lit(1.0)).otherwise(F.col("top_score") - F.col("second_score"))
    return results.agg(
        F.count("*").alias("total_units"),
        F.count_if("chose_nonempty").alias("chose_nonempty"),
        F.count_if("returned_unknown").alias("returned_unknown"),
        F.count_if("fallback_used").alias("fallback_used"),
        F.count_if(F.col("status") == "accept").alias("accepted"),
        F.count_if(F.col("status") == "accept_with_flag").alias("accept_with_flag"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("top_score") < K.FALLBACK_SCORE_MIN).alias("low_top_score_units"),
        F.count_if(gap <= K.SMALL_GAP_MAX).alias("small_gap_units"),
    )


def sample_ids(results: DataFrame, condition: Column, order: str, n: int = K.SAMPLE_IDS) -> DataFrame:
    """The first unit ids meeting a condition, in run order."""
    return results.filter(condition).orderBy(order).limit(n).select(order, "unit_id")


def primary_frequency(results: DataFrame, order: str, n: int = 15) -> DataFrame:
    """Most frequent primary ids; ties by first appearance."""
    named = results.withColumn("primary_canon_id", strip("primary_canon_id")).filter(F.col("primary_canon_id") != "")
    counted = named.groupBy("primary_canon_id").agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counted.orderBy(F.desc("n"), "_first").limit(n).drop("_first")


def review_rates(results: DataFrame, n: int = 10) -> DataFrame:
    waiting = F.col("status") == "needs_review"
    return (
        results.groupBy("book")
        .agg(F.count_if(waiting).alias("needs_review"), F.count("*").alias("total"))
        .withColumn("review_rate", F.col("needs_review") / F.col("total"))
        .orderBy(F.desc("review_rate"), "book")
        .limit(n)
    )
