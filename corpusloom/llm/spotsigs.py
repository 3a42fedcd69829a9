"""SpotSigs fingerprints, in column expressions only.

A signature is a common word (the anchor) with the chain of the next content words after it; the start of a text is
an anchor too. A fingerprint is the sorted set of 32-bit signatures, written as numbers with blanks in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Common words that serve as anchors and never as content, four languages.
ANCHORS = (
    "the of and to in a is that it for on was be with as this by are an from "
    "der die das und den von zu mit ist im für auf ein eine nicht des sich dem auch es "
    "le la les de et un une que est dans pour du pas au qui sur ne se ce il "
    "el los las y en lo por con su para como una al más pero sus o este sí porque"
).split()

#: Content words of a chain, and how many words after the anchor they are looked for in.
CHAIN, REACH = 3, 10


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def signatures(text: Column, anchors: list[str] | None = None) -> Column:
    """Sorted distinct signatures of a text (array of int); empty for a null, empty or wordless text."""
    common = list(dict.fromkeys(anchors or ANCHORS))
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def spots(w: Column) -> Column:
        def chain(first: Column) -> Column:
            return F.slice(F.filter(F.slice(w, first, REACH), lambda x: ~x.isin(common)), 1, CHAIN)

        marks = F.transform(w, lambda x, i: F.when(x.isin(common), F.hash(x, chain(i + 2))))
        start = F.when(F.size(w) > 0, F.hash(F.lit("^"), chain(F.lit(1))))
        return F.sort_array(F.array_distinct(F.array_compact(F.concat(F.array(start), marks))))

    return bind(words, spots)


def written(signs: Column) -> Column:
    return F.array_join(signs.cast("array<string>"), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two fingerprints; of two empty ones 1, of an empty and another 0."""
    both = bind(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both.cast("double"))


def successors(docs: DataFrame) -> DataFrame:
    """(key, need, next_key): each document's successor by descending doc_id, the last one's being the first.

    ``docs`` has key, doc_id and n (characters). Ids are cut into blocks at quantiles, of which there are as many as
    shuffle partitions (256 at most); only a block's first row meets other blocks'.
    """
    spark = docs.sparkSession
    blocks = min(256, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    borders = sorted(set(docs.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 0.25 / blocks)))
    block = F.size(F.filter(F.array(*map(F.lit, borders)).cast("array<double>"), lambda b: b < F.col("doc_id"))) if borders else F.lit(0)
    order = Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), "key")
    rows = docs.withColumn("block", F.coalesce(block, F.lit(-1))).withColumns({"next_key": F.lead("key").over(order), "rank": F.row_number().over(order)})
    heads = rows.where("rank = 1").select("block", F.col("key").alias("head"))
    turn = Window.orderBy(F.desc("block"))
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("block", F.coalesce(F.lead("head").over(turn), F.first("head").over(whole)).alias("after"))
    return rows.join(F.broadcast(heads), "block").select("key", F.floor(F.col("n") / 3).cast("int").alias("need"), F.coalesce("next_key", "after").alias("next_key"))


def edited_fingerprints(docs: DataFrame, anchors: list[str] | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third gives way to the next document's beginning.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id. The
    next document is the one with the next lower doc_id, the highest after the lowest; null ids come last. Rows that
    share an id are documents of their own, in the order of a hash of their texts; rows that repeat wholly stand for
    one document and have the same result each. Null texts count as empty. The texts are shuffled once.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("key"))
    narrow = keyed.select("key", "doc_id", F.char_length("text").alias("n")).distinct()
    after = successors(narrow)
    wide = keyed.select("key", "doc_id", "text", signatures(F.col("text"), anchors).alias("signs"))
    # not a rank, for which Spark would limit the rows before the shuffle of one branch and so shuffle the texts twice
    repeat = F.lag(F.lit(True)).over(Window.partitionBy("key").orderBy("key"))
    wide = wide.withColumn("repeat", F.coalesce(repeat, F.lit(False)))
    asked = after.select(F.col("next_key").alias("key"), F.col("key").alias("asker"), "need")
    given = wide.where("NOT repeat").join(asked, "key").select(
        F.col("asker").alias("key"), F.col("doc_id").alias("next_doc_id"), F.expr("substring(text, 1, need)").alias("prefix"), F.col("signs").alias("next_signs")
    )
    both = wide.join(given, "key").withColumn("n_chars", F.char_length("text"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, n_chars - cast(floor(n_chars / 3) as int))"), "prefix"))
    both = both.withColumn("edited_signs", signatures(F.col("edited"), anchors))
    return both.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("signs")).alias("fingerprint"),
        written(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
        "next_doc_id",
    )


def similar_fingerprints(prints: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(a, b, near): pairs of different fingerprints with a Jaccard of ``threshold`` or more.

    ``prints`` has fp (an id) and signs, one row per distinct fingerprint; empty ones pair with none. Fingerprints are
    partitioned by set length (bands a factor 1/threshold wide, met with the band below), joined on the signatures of
    their prefixes, rarest first, and compared where their lengths allow the threshold.
    """
    size = F.size("signs")
    sized = prints.where(size > 0).withColumns({"size": size, "band": F.floor(F.log(size) / F.log(F.lit(1 / threshold)) + 1e-9)})
    flat = sized.select("fp", "size", "band", F.explode("signs").alias("sign"))
    counted = flat.join(flat.groupBy("sign").agg(F.count("*").alias("c")).where("c > 1"), "sign")
    # signatures that no other has come first in every prefix; only the shared rest is joined
    alone = F.col("size") - F.count("*").over(Window.partitionBy("fp"))
    rank = F.row_number().over(Window.partitionBy("fp").orderBy("c", "sign"))
    prefix = counted.withColumns({"alone": alone, "rank": rank}).where(F.col("rank") + F.col("alone") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1)
    low = prefix.select(F.col("fp").alias("a"), F.col("size").alias("na"), "sign", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    high = prefix.select(F.col("fp").alias("b"), F.col("size").alias("nb"), "sign", "band")
    fits = (F.col("na") <= F.col("nb")) & (F.col("na") >= F.col("nb") * threshold - 1e-9) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b")))
    pairs = low.join(high, ["sign", "band"]).where(fits).select("a", "b").distinct()
    left, right = (prints.select(F.col("fp").alias(x), F.col("signs").alias(f"s{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("near")).where(F.col("near") >= threshold)
