"""Topic search over structured rows: score, rank, distinct top rows, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.chains import column_title
from ..functions.ids import book_from_record_id
from ..functions.scoring import (
    Topic,
    category_equals,
    chain_bonus,
    has_chain,
    lead_has_phrase,
    text_bonus,
    token_score,
)
from ..functions.text import text_or_blank
from .dedup import top_per_key


def score_rows(rows: DataFrame, query: str) -> DataFrame:
    """Add ``category_match`` and ``score``; one pass of built-in expressions."""
    topic = Topic(query)
    items = F.col("chain.items")
    category = F.col("chain.category")
    prepared = rows.withColumns(
        {
            "_sut": F.lower(text_or_blank("sutta")),
            "_com": F.lower(text_or_blank("commentary")),
            "_chn": F.lower(text_or_blank(F.array_join(items, " "))),
        }
    )
    lexical = text_bonus(F.col("sutta"), F.col("_sut"), F.col("_com"), topic) + token_score(
        F.col("_chn"), F.col("_com"), F.col("_sut"), topic
    )
    scored = prepared.withColumns(
        {"_lex": lexical, "_chain": chain_bonus(category, items, topic)}
    )
    damped = ~has_chain(items) & (F.col("_lex") > 0) & ~lead_has_phrase(F.col("sutta"), topic)
    lex = F.when(damped, F.col("_lex") * K.NO_CHAIN_FACTOR).otherwise(F.col("_lex"))
    return scored.withColumns(
        {
            "category_match": category_equals(category, topic),
            "score": F.col("_chain") * K.CHAIN_SCALE + lex,
        }
    ).drop("_sut", "_com", "_chn", "_lex", "_chain")


def topic_hits(rows: DataFrame, query: str, max_columns: int = K.MAX_COLUMNS_DEFAULT) -> DataFrame:
    """Best distinct rows for a topic, category matches first. ``rows`` carries a unique ``pos``."""
    if not 1 <= max_columns <= 10:
        raise ValueError("max_columns must lie between 1 and 10")
    if not Topic(query).tokens:
        rows = rows.limit(0)
    order = [F.desc("category_match"), F.desc("score"), F.asc("pos")]
    # Ranking moves four narrow columns only; a row without a score never outranks one
    # with a score, so they are dropped after it, where the filter does not repeat the
    # scoring. The texts of the at most ten winners are joined afterwards.
    scored = score_rows(rows, query).select("pos", text_or_blank("sutta_id").alias("_id"), "category_match", "score")
    best = top_per_key(scored, ["_id"], order).filter(F.col("score") > 0)
    top = best.orderBy(*order).limit(max_columns).drop("_id")
    return rows.join(F.broadcast(top), "pos").orderBy(*order)


def to_hits(rows: DataFrame) -> DataFrame:
    return rows.select(
        "sutta_id",
        F.when(F.col("chain").isNotNull(), column_title(F.col("chain.category"), F.col("chain.items")))
        .otherwise(F.lit("Chain"))
        .alias("title"),
        book_from_record_id("sutta_id").alias("book"),
        "chain",
        text_or_blank("sutta").alias("sutta"),
        text_or_blank("commentary").alias("commentary"),
        "category_match",
        "score",
        "pos",
    )


def topic_summary(hits: DataFrame, query: str) -> DataFrame:
    """One summary line over the hits: their categories, else their chain items.

    ``hits`` is the bounded result of :func:`topic_hits` (at most ten rows). The scan
    stops after the row that brings the fifth category; within a row items are taken
    until ten are known, at least one per row.
    """
    shown = (query or "").strip()
    disp = shown or "(topic)"
    if not Topic(query).tokens:
        return hits.sparkSession.createDataFrame([(f"BOT: {disp} (enter a topic)",)], "bot_summary string")
    strings = F.array().cast("array<string>")
    ranked = F.array_sort(
        F.collect_list(
            F.struct(
                (~F.col("category_match")).alias("o"),
                (-F.col("score")).alias("s"),
                "pos",
                F.col("chain.category").alias("category"),
                F.coalesce(F.col("chain.items"), strings).alias("items"),
                F.col("chain").isNotNull().alias("known"),
            )
        )
    )

    def add_item(acc, item):
        s = F.btrim(text_or_blank(item), F.lit(K.WS_CHARS))
        tags = acc["tags"]
        fresh = (s != "") & ~F.exists(tags, lambda t: F.lower(t) == F.lower(s))
        grown = F.when(~acc["full"] & fresh, F.array_append(tags, s)).otherwise(tags)
        return F.struct(
            grown.alias("tags"),
            (acc["full"] | (F.size(grown) >= 10)).alias("full"),
        )

    def add_row(acc, row):
        cats = acc["cats"]
        go = ~acc["done"] & row["known"]
        fresh = (text_or_blank(row["category"]) != "") & ~F.array_contains(cats, text_or_blank(row["category"]))
        cats2 = F.when(go & fresh, F.array_append(cats, row["category"])).otherwise(cats)
        folded = F.aggregate(
            row["items"], F.struct(acc["tags"].alias("tags"), F.lit(False).alias("full")), add_item
        )
        return F.struct(
            cats2.alias("cats"),
            F.when(go, folded["tags"]).otherwise(acc["tags"]).alias("tags"),
            (acc["done"] | (go & (F.size(cats2) >= 5))).alias("done"),
        )

    start = F.struct(strings.alias("cats"), strings.alias("tags"), F.lit(False).alias("done"))
    state = F.aggregate("_rows", start, add_row)
    tail = (
        F.when(F.size("_state.cats") > 0, F.array_join(F.slice("_state.cats", 1, 6), ", "))
        .when(F.size("_state.tags") > 0, F.array_join(F.slice("_state.tags", 1, 8), ", "))
        .otherwise(F.lit("no chain tags"))
    )
    line = F.when(F.size("_rows") == 0, F.lit(f"BOT: {shown} (no matches)")).otherwise(
        F.concat(F.lit(f"BOT: {disp} ("), tail, F.lit(")"))
    )
    return (
        hits.agg(ranked.alias("_rows")).withColumn("_state", state).select(line.alias("bot_summary"))
    )
