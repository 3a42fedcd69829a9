"""Structured records: items, documents, point lookups, item search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.chains import chain_block, chain_json
from ..functions.text import ellipsis, is_blank, or_none, squeeze, strip, text_or_blank
from .dedup import keep_first


#: Document kinds in the order a record yields them.
KINDS = ["sutta", "commentary", "chain", "combined"]


def commentary_body(commentary: Column | str = "commentary", misspelt: Column | str = "commentry") -> Column:
    return strip(F.coalesce(or_none(text_or_blank(commentary)), text_or_blank(misspelt)))


def commentary_id(explicit: Column | str, suttaid: Column | str) -> Column:
    sid = strip(suttaid)
    derived = F.when(sid != "", F.concat(F.lit("c"), sid)).otherwise(F.lit(""))
    return F.coalesce(or_none(strip(explicit)), derived)


def prefixed_id(c: Column | str) -> Column:
    """``2.1.2`` and ``an 2.1.2`` as ``AN 2.1.2``; blank stays blank."""
    s = strip(c)
    tail = strip(F.regexp_replace(s, r"(?iU)\AAN\s+", ""))
    return F.when(tail != "", F.concat(F.lit("AN "), tail)).otherwise(F.lit(""))


def to_items(records: DataFrame, book: str) -> DataFrame:
    """Normalised items of one book; rows without id or text are dropped.

    Book ``an1`` carries its own ids, the others use ``sutta_id`` and a derived commentary id.
    """
    if book == "an1":
        sid = strip("suttaid")
        cid = commentary_id("commentary_id", "suttaid")
    else:
        sid = prefixed_id(F.coalesce(or_none(text_or_blank("sutta_id")), F.col("suttaid")))
        cid = F.when(sid != "", F.concat(F.lit("c"), sid)).otherwise(F.lit(""))
    extra = [c for c in ("pos",) if c in records.columns]
    return records.select(
        F.lit(book).alias("book"),
        *extra,
        sid.alias("suttaid"),
        strip("sutta").alias("sutta"),
        commentary_body().alias("commentry"),
        cid.alias("commentary_id"),
        "chain",
    ).filter((F.col("suttaid") != "") & (F.col("sutta") != ""))


def for_book(items: DataFrame, book: str | None) -> DataFrame:
    """Items of one book; anything but a known book name means all."""
    b = (book or "").strip().lower()
    return items.filter(F.col("book") == b) if b in K.BOOKS else items


def merge_items(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of ``first``; rows of ``second`` with an id not seen before, each id once."""
    once = keep_first(second, ["suttaid"], ["pos"])
    fresh = once.join(first.select("suttaid").distinct(), "suttaid", "left_anti")
    return first.unionByName(fresh)


def find_item(items: DataFrame, column: str, value: str) -> DataFrame:
    """First item with this id, the earlier book first; a blank id finds nothing."""
    want = (value or "").strip()
    hits = items.filter(strip(column) == want) if want else items.limit(0)
    return hits.orderBy("book", "pos").limit(1)


def item_title(c: Column | str) -> Column:
    return ellipsis(squeeze(c), 72)


def search_items(items: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring search over all fields of an item, chain included."""
    q = (query or "").strip().lower()
    if not q:
        return items
    blob = F.array_join(
        F.array(
            text_or_blank("suttaid"),
            text_or_blank("sutta"),
            text_or_blank("commentry"),
            text_or_blank("commentary_id"),
            chain_json(F.col("chain")),
        ),
        "\n",
    )
    return items.filter(F.lower(blob).contains(q))


def item_summaries(items: DataFrame) -> DataFrame:
    return items.select(
        "suttaid",
        item_title("sutta").alias("title"),
        (~is_blank("commentry")).alias("has_commentary"),
    )


def to_documents(records: DataFrame, rec_i: str = "rec_i", variant: str = "a") -> DataFrame:
    """One row per record and kind (sutta, commentary, chain), else one ``combined`` row.

    Row-local: the candidate documents form an array that is exploded, so no shuffle.
    """
    if variant == "a":
        sid = strip("suttaid")
        cid = commentary_id("commentary_id", "suttaid")
    else:
        sid = prefixed_id(F.coalesce(or_none(text_or_blank("sutta_id")), F.col("suttaid")))
        cid = F.when(sid != "", F.concat(F.lit("c"), sid)).otherwise(F.lit(""))
    base = records.select(
        *[c for c in records.columns if c not in ("suttaid", "commentary_id", "sutta", "commentary", "commentry", "sutta_id")],
        sid.alias("suttaid"),
        cid.alias("commentary_id"),
        strip("sutta").alias("_sutta"),
        commentary_body().alias("_comm"),
    )
    head = F.concat(F.lit("SUTTAID: "), F.col("suttaid"), F.lit("\nCOMMENTARY_ID: "), F.col("commentary_id"))
    sutta_part = F.concat(F.lit("\n\nSUTTA:\n"), F.col("_sutta"))
    comm_part = F.concat(F.lit("\n\nTEACHER COMMENTARY:\n"), F.col("_comm"))

    def doc(kind: str, text: Column) -> Column:
        return F.struct(F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), text.alias("text"))

    docs = F.array_compact(
        F.array(
            F.when(F.col("_sutta") != "", doc("sutta", F.concat(head, sutta_part))),
            F.when(F.col("_comm") != "", doc("commentary", F.concat(head, comm_part))),
            F.when(
                F.col("chain").isNotNull(),
                doc("chain", chain_block(F.col("suttaid"), F.col("commentary_id"), F.col("chain"))),
            ),
        )
    )
    fallback = F.array(
        doc(
            "combined",
            F.concat(head, sutta_part, F.when(F.col("_comm") != "", comm_part).otherwise(F.lit(""))),
        )
    )
    keep = [c for c in base.columns if c not in ("_sutta", "_comm", "chain")]
    return (
        base.filter(F.col("suttaid") != "")
        .withColumn("_docs", docs)
        .withColumn("_docs", F.when(F.size("_docs") > 0, F.col("_docs")).otherwise(fallback))
        .select(*keep, F.explode("_docs").alias("_d"))
        .select(*keep, F.col("_d.ord").alias("doc_ord"), F.col("_d.kind").alias("kind"), F.col("_d.text").alias("text"))
    )
