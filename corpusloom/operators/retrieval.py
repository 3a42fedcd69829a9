"""Vector, keyword and hybrid retrieval with quota, pair and kind rules.

A chunk table has ``pos`` (unique, insertion order), ``source, suttaid,
commentary_id, kind, book, conversation_id, text`` and ``embedding``. Every scan
over it ends in a top-n whose size follows from ``k`` alone. That small result is
fetched once (``bounded``), so the rules that look at neighbours do not repeat the
scan, and the ids they ask for reach the next scan as literals. Where every stored
vector competes, one map-only pass measures and scores all chunks and stores those
that compete (``scored``); cuts and rules read columns of that table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import native
from ..functions.scoring import lexical_score
from ..functions.text import search_terms, text_or_blank
from ..functions.vectors import usable_vector
from ..storage import stored
from .dedup import keep_first, prefix_key, top_per_key

#: Parts of a term's rows that are cut on their own before they meet.
PARTS = 256

PAYLOAD = ["pos", "source", "suttaid", "commentary_id", "conversation_id", "kind", "book", "text"]


@dataclass(frozen=True)
class Profile:
    """What differs between the search front ends."""

    key: tuple[str, ...]
    boost: bool
    metric: str
    nearest_only: bool  # vector candidates are a top-n, and each term has a fetch limit
    case_sensitive: bool


TRANSCRIPTS = Profile(("source", "conversation_id"), False, "l2", True, True)
COMMAND_LINE = Profile(("source",), False, "l2", True, True)
SCRIPTURE = Profile(("source", "suttaid"), True, "l2", True, True)
BUNDLE = Profile(("source", "suttaid", "book"), True, "cosine", False, False)


def vector_limit(k: int) -> int:
    return min(max(k * 10, 50), 200)


def term_limit(k: int) -> int:
    return min(200, max(50, k * 20))


def candidate_limit(k: int) -> int:
    return max(k * 4, 20)


def bounded(df: DataFrame, limit: int) -> DataFrame:
    """Materialise a result of at most ``limit`` rows; a larger one is an error, never cut."""
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        raise ValueError(f"expected at most {limit} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)


# --- candidate sources --------------------------------------------------------


def nearest(chunks: DataFrame, vector: list[float], n: int, metric: str = "l2") -> DataFrame:
    """The ``n`` rows nearest to a query vector, exactly: each task keeps its own best ``n``."""
    return with_distance(chunks, vector, metric).orderBy("distance", "pos").limit(n)


def with_distance(chunks: DataFrame, vector: list[float], metric: str) -> DataFrame:
    usable = chunks.filter(usable_vector("embedding"))
    return usable.withColumn("distance", native.distance_to(F.col("embedding"), vector, metric)).drop("embedding")


def _found(terms: list[str], case_sensitive: bool) -> Column:
    """Indexes of the terms a row's text holds, in order."""
    hay = text_or_blank("text") if case_sensitive else F.lower(text_or_blank("text"))
    if not terms:
        return F.array().cast("array<int>")
    return F.array_compact(F.array(*[F.when(hay.contains(t if case_sensitive else t.lower()), F.lit(i)) for i, t in enumerate(terms)]))


def keyword_rows(chunks: DataFrame, terms: list[str], *, case_sensitive: bool, per_term: int | None) -> DataFrame:
    """Rows holding a term, with the index of the term that found them (``term``).

    All terms are tested in one scan. With a fetch limit, every term yields its first
    rows by position; a row cut for one term may still enter through a later one.
    """
    hit = chunks.withColumn("_found", _found(terms, case_sensitive)).filter(F.size("_found") > 0)
    if per_term is None:
        return hit.withColumn("term", F.array_min("_found")).drop("_found")
    each = hit.withColumn("term", F.explode("_found")).drop("_found")
    # a term in every row meets in one task: first the parts of each term are cut, then the term
    parts = top_per_key(each.withColumn("_part", F.pmod("pos", F.lit(PARTS))), ["term", "_part"], ["pos"], per_term)
    return top_per_key(parts.drop("_part"), ["term"], ["pos"], per_term)


def scored(chunks: DataFrame, query: str, vector: list[float], profile: Profile) -> DataFrame:
    """Chunks with a usable vector (term -1, distance) or else a query term (its index, no distance), and their lexical
    score: one pass without a shuffle, stored."""
    terms = search_terms(query, boost=profile.boost)
    usable = usable_vector("embedding")
    # a text is looked through only where no vector lets the row compete
    measured = chunks.withColumn("term", F.when(usable, F.lit(-1)).otherwise(F.array_min(_found(terms, profile.case_sensitive))))
    measured = measured.filter(F.col("term").isNotNull())
    distance = F.when(F.col("term") < 0, native.distance_to(F.when(usable, F.col("embedding")), vector, profile.metric))
    columns = [c for c in chunks.columns if c != "embedding"]
    return stored(measured.select(*columns, distance.alias("distance"), "term", lexical_score("text", query).alias("lexical")), "candidates")


def candidates(chunks: DataFrame, query: str, vector: list[float], k: int, profile: Profile) -> DataFrame:
    """Vector rows and the keyword rows they do not already cover, with their lexical score."""
    if not 1 <= k <= 20:
        raise ValueError("k must lie between 1 and 20")
    columns = [c for c in PAYLOAD if c in chunks.columns]
    base = chunks.select(*columns, "embedding")
    if profile.nearest_only:
        near = bounded(nearest(base, vector, vector_limit(k), profile.metric).withColumn("term", F.lit(-1)), vector_limit(k))
        terms = search_terms(query, boost=profile.boost)
        words = keyword_rows(base, terms, case_sensitive=profile.case_sensitive, per_term=term_limit(k)).drop("embedding")
        words = words.withColumn("distance", F.lit(None).cast("double"))
    else:
        both = scored(base, query, vector, profile)
        near, words = both.filter("term < 0"), both.filter("term >= 0")

    key = prefix_key(200, *profile.key)
    names = [f"_p{i}" for i in range(len(key))]
    words = keep_first(words, key, ["term", "pos"]).withColumns(dict(zip(names, key)))
    covered = near.select(*[c.alias(n) for n, c in zip(names, key)]).distinct()
    pool = near.unionByName(words.join(covered, names, "left_anti").drop(*names))
    if profile.nearest_only:
        pool = bounded(pool.withColumn("lexical", lexical_score("text", query)), vector_limit(k) + K.TERMS_SCRIPTURE * term_limit(k))
    return pool


def rank_order() -> list[Column]:
    """Lexical score first, then distance; keyword-only rows count as far away."""
    return [
        F.desc("lexical"),
        F.asc(F.coalesce("distance", F.lit(K.MISSING_DISTANCE))),
        F.asc("term"),
        F.asc("pos"),
    ]


def best(cands: DataFrame, n: int) -> DataFrame:
    """The best ``n`` candidates with their ``rank`` (from 1)."""
    top = cands.orderBy(*rank_order()).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())))


def rerank(ranked: DataFrame, query: str, k: int, scorer=None) -> DataFrame:
    """Reorder by a pair scorer when there are more candidates than results, and cut to ``k``."""
    if scorer is None:
        return ranked.filter(F.col("rank") <= k)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scored = ranked.withColumn("_s", scorer(query, F.col("text"))).withColumn("_n", F.count("*").over(everything))
    order = Window.orderBy(F.asc(F.when(F.col("_n") > k, -F.col("_s")).otherwise(F.lit(0.0))), "rank")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("_s", "_n")


# --- rules over bounded results -----------------------------------------------


def _kind() -> Column:
    return F.lower(text_or_blank("kind"))


def dedup_results(rows: DataFrame, cap: int | None = K.RESULT_CAP) -> DataFrame:
    """Drop repeats of (source, id, kind, text start), renumber and cap (None: all). Bounded input."""
    key = prefix_key(120, "source", "suttaid") + [_kind()]
    kept = renumber(keep_first(rows, key, ["rank"]))
    return kept if cap is None else kept.filter(F.col("rank") <= cap)


def renumber(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("rank", "pos")))


def quota_pick(ranked: DataFrame, k: int) -> DataFrame:
    """``k`` rows shared evenly over the books present, then filled up in rank order. Bounded input."""
    book = F.lower(F.coalesce(F.nullif(F.col("book"), F.lit("")), F.lit(K.BOOKS[0])))
    known = F.when(book.isin(*K.BOOKS), book)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.coalesce(F.min(known).over(whole), F.lit(K.BOOKS[0]))
    placed = ranked.withColumn("_first", first).withColumn("_known", known)
    placed = placed.withColumn("_n", F.greatest(F.size(F.collect_set("_known").over(whole)), F.lit(1)))
    placed = placed.withColumn("_b", F.coalesce("_known", "_first"))
    placed = placed.withColumn("_i", F.dense_rank().over(Window.orderBy("_b")))
    quota = F.floor(F.lit(k) / F.col("_n")) + F.when(F.col("_i") <= F.lit(k) % F.col("_n"), 1).otherwise(0)
    key = prefix_key(180, "source", "suttaid") + [_kind(), book]
    unique = keep_first(placed, key, ["rank"])
    numbered = unique.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("rank")))
    fill = (F.col("_r") > quota).cast("int")
    picked = numbered.withColumn("_o", F.row_number().over(Window.orderBy(fill, "rank")))
    return (
        picked.filter(F.col("_o") <= k)
        .withColumn("rank", F.col("_o"))
        .drop("_first", "_known", "_n", "_b", "_i", "_r", "_o")
    )


def neighbours(top: DataFrame, pool: DataFrame) -> DataFrame:
    """From one pass over the pool: the best reading and commentary of every id in the result
    (``_for`` = id) and of the pool as a whole (``_for`` = ``*``). At most two rows per result row plus two."""
    ids = sorted({r.suttaid for r in top.select("suttaid").collect() if r.suttaid})
    mine = F.when(F.col("suttaid").isin(ids), F.concat(F.lit("="), "suttaid")) if ids else F.lit(None).cast("string")
    side = pool.withColumn("_kind", _kind()).filter(F.col("_kind").isin("commentary", "sutta"))
    keyed = side.withColumn("_for", F.explode(F.array_compact(F.array(mine, F.lit("*")))))
    return bounded(top_per_key(keyed, ["_for", "_kind"], rank_order()), 2 * len(ids) + 2)


def inject_pairs(top: DataFrame, near: DataFrame, cap: int = K.RESULT_CAP) -> DataFrame:
    """Add the missing reading or commentary of every id in the result, best-ranked first.

    ``near`` comes from :func:`neighbours`. Added rows follow in the order of their id's
    first rank, commentary before reading.
    """
    kept = dedup_results(top, cap=None)
    ids = (
        kept.filter(text_or_blank("suttaid") != "")
        .groupBy("suttaid")
        .agg(F.min("rank").alias("_at"), F.collect_set(_kind()).alias("_have"))
    )
    later = F.when(F.col("_kind") == "commentary", F.lit(0)).otherwise(F.lit(1))
    found = (
        near.filter(F.col("_for") != "*")
        .join(ids, "suttaid")
        .filter(~F.array_contains("_have", F.col("_kind")))
        .withColumn("rank", F.lit(1_000_000) + F.col("_at") * 2 + later)
    )
    return dedup_results(kept.unionByName(found.select(*kept.columns)), cap)


def guarantee_kind(top: DataFrame, near: DataFrame, kind: str, k: int) -> DataFrame:
    """Replace the tail with the best pool row of a kind the result lacks. Bounded input."""
    extra = (
        near.filter((F.col("_for") == "*") & (F.col("_kind") == kind))
        .withColumn("rank", F.lit(1_000_000))
        .select(*top.columns)
    )
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = top.withColumn("_x", F.lit(False)).unionByName(extra.withColumn("_x", F.lit(True)))
    both = both.withColumn("_has", F.max(~F.col("_x") & (_kind() == kind)).over(whole)).withColumn(
        "_extra", F.max("_x").over(whole)
    )
    keep = F.when(F.col("_has") | ~F.col("_extra"), ~F.col("_x")).otherwise(
        F.col("_x") | (F.col("rank") <= max(0, k - 1))
    )
    return renumber(both.filter(keep).drop("_x", "_has", "_extra"))


# --- front ends ---------------------------------------------------------------


def _finish(top: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    near = neighbours(top, pool)
    top = inject_pairs(top, near)
    for kind in ("commentary", "sutta"):
        top = guarantee_kind(top, near, kind, k)
    return dedup_results(top)


def search_bundle(chunks: DataFrame, query: str, vector: list[float], k: int = K.FORCED_K) -> DataFrame:
    """Portable vector table: every stored vector competes. One pass over the table."""
    pool = candidates(chunks, query, vector, k, BUNDLE)
    return _finish(bounded(quota_pick(best(pool, candidate_limit(k)), k), k), pool, k)


def search_book(chunks: DataFrame, query: str, vector: list[float], k: int, scorer=None) -> DataFrame:
    """One local index: nearest vectors and limited keyword rows, reranked when a scorer is given."""
    pool = candidates(chunks, query, vector, k, SCRIPTURE)
    top = bounded(rerank(best(pool, candidate_limit(k)), query, k, scorer), k)
    return _finish(top, pool, k)


def search_books(chunks: DataFrame, query: str, vector: list[float], k: int = K.FORCED_K, scorer=None) -> DataFrame:
    """Both local indexes with about half the budget each, merged by quota and pair rules."""
    first = max(1, (k + 1) // 2)
    budgets = {K.BOOKS[0]: first, K.BOOKS[1]: max(1, k - first)}
    parts = []
    for i, (book, share) in enumerate(budgets.items()):
        part = search_book(chunks.filter(F.col("book") == book), query, vector, share, scorer)
        parts.append(part.withColumn("rank", F.col("rank") + 1000 * i))
    merged = bounded(dedup_results(parts[0].unionByName(parts[1]), cap=None), 2 * K.RESULT_CAP)
    order = [F.desc("lexical"), F.asc(F.coalesce("distance", F.lit(K.MISSING_DISTANCE))), F.asc("rank")]
    ranked = merged.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    top = bounded(quota_pick(ranked.filter(F.col("rank") <= candidate_limit(k)), k), k)
    # The merged list is itself the pool; its rank stands in for the position on ties.
    pool = ranked.withColumn("term", F.col("rank")).drop("rank")
    return dedup_results(inject_pairs(top, neighbours(top, pool)))


def search_transcripts(chunks: DataFrame, query: str, vector: list[float], k: int, scorer=None) -> DataFrame:
    pool = candidates(chunks, query, vector, k, TRANSCRIPTS)
    return rerank(best(pool, candidate_limit(k)), query, k, scorer)


def search_command_line(chunks: DataFrame, query: str, vector: list[float], k: int = 5) -> DataFrame:
    return best(candidates(chunks, query, vector, k, COMMAND_LINE), k)


def expand_context(result: DataFrame, chunks: DataFrame, cap: int = K.CONTEXT_CAP) -> DataFrame:
    """Append rows of the first hit's conversation, else of its source, up to ``cap`` rows in all.

    The first hit is one row; its key enters the scan as a scalar and can be pushed down.
    """
    first = result.orderBy("rank").limit(1)
    conversation = first.select(text_or_blank("conversation_id")).scalar()
    source = first.select(text_or_blank("source")).scalar()
    same = F.when(F.trim(conversation) != "", F.col("conversation_id") == conversation).otherwise(
        (source != "") & (F.col("source") == source)
    )
    around = chunks.filter(same).orderBy("pos").limit(K.CONTEXT_FETCH)
    shaped = around.select(
        *[c for c in PAYLOAD if c in chunks.columns],
        F.lit(None).cast("double").alias("distance"),
        F.lit(0).alias("term"),
        F.lit(0).alias("lexical"),
        (F.lit(1_000_000) + F.row_number().over(Window.orderBy("pos"))).alias("rank"),
    )
    both = result.withColumn("_new", F.lit(0)).unionByName(shaped.withColumn("_new", F.lit(1)))
    key = prefix_key(200, "source", "conversation_id")
    names = [f"_p{i}" for i in range(len(key))]
    w = Window.partitionBy(*names).orderBy("rank")
    seen = both.withColumns(dict(zip(names, key))).withColumn("_rn", F.row_number().over(w))
    kept = seen.filter((F.col("_new") == 0) | (F.col("_rn") == 1)).drop("_new", "_rn", *names)
    return renumber(kept).filter(F.col("rank") <= cap)


def order_passages(rows: DataFrame, max_n: int = K.PASSAGE_CAP, include_chain: bool | None = None) -> DataFrame:
    """Passages grouped by id in rank order: one reading, two commentaries, one chain; then what is left.

    Bounded input (the result of a search). Chains take part when any row is a chain,
    unless ``include_chain`` says otherwise.
    """
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = dedup_results(rows, cap=None).withColumn("_kind", _kind())
    chains = F.max(F.col("_kind") == "chain").over(whole) if include_chain is None else F.lit(include_chain)
    d = d.withColumn("_chains", chains).withColumn("_sid", F.btrim(text_or_blank("suttaid"), F.lit(K.WS_CHARS)))
    d = d.withColumn("_at", F.min("rank").over(Window.partitionBy("_sid"))).withColumn(
        "_rn", F.row_number().over(Window.partitionBy("_sid", "_kind").orderBy("rank"))
    )
    kind_ord = (
        F.when((F.col("_kind") == "sutta") & (F.col("_rn") <= 1), 0)
        .when((F.col("_kind") == "commentary") & (F.col("_rn") <= 2), 1)
        .when((F.col("_kind") == "chain") & (F.col("_rn") <= 1) & F.col("_chains"), 2)
    )
    d = d.withColumn("_ko", F.when(F.col("_sid") != "", kind_ord))
    paired = F.col("_ko").isNotNull()
    d = d.withColumn(
        "_o",
        F.row_number().over(
            Window.orderBy(
                F.asc((~paired).cast("int")),
                F.asc(F.when(paired, F.col("_at"))),
                F.asc("_ko"),
                F.asc("rank"),
            )
        ),
    )
    # A left-over row repeats an earlier one when the first 80 characters agree.
    key = prefix_key(80, "source", "suttaid") + [F.col("_kind")]
    names = [f"_p{i}" for i in range(len(key))]
    cut = d.filter(paired & (F.col("_o") <= max_n) | ~paired)
    cut = cut.withColumns(dict(zip(names, key)))
    again = F.row_number().over(Window.partitionBy(*names).orderBy("_o"))
    kept = cut.withColumn("_again", again).filter(F.col("_ko").isNotNull() | (F.col("_again") == 1))
    numbered = kept.withColumn("rank", F.row_number().over(Window.orderBy("_o"))).filter(F.col("rank") <= max_n)
    return numbered.drop("_kind", "_chains", "_sid", "_at", "_rn", "_ko", "_o", "_again", *names)


def source_keys(rows: DataFrame) -> DataFrame:
    """Distinct ``id:kind[:commentary id]`` keys of a bounded result, in order, as one array."""
    sid, cid = (F.btrim(text_or_blank(c), F.lit(K.WS_CHARS)) for c in ("suttaid", "commentary_id"))
    kind = F.coalesce(F.nullif(F.btrim(text_or_blank("kind"), F.lit(K.WS_CHARS)), F.lit("")), F.lit("unknown"))
    key = F.concat(sid, F.lit(":"), kind, F.when(cid != "", F.concat(F.lit(":"), cid)).otherwise(F.lit("")))
    pairs = F.array_sort(F.collect_list(F.when(sid != "", F.struct("rank", key.alias("key")))))
    return rows.agg(F.array_distinct(F.transform(pairs, lambda p: p["key"])).alias("sources"))
