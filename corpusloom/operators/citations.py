"""Citations in generated answers and the items they point to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze, text_or_blank

_PAREN = r"[(](?:[cC][aA][nN]|AN)[^)]{0,160}[)]"
_BARE = r"\b(?:[cC][aA][nN]|AN)\s*\d+(?:\.\d+)*\b"


def normalize_citation(c: Column | str) -> Column:
    """``can 1.2`` as ``cAN 1.2`` and ``an1.2`` as ``AN 1.2``; other text only trimmed."""
    t = squeeze(c)
    kind = F.regexp_extract(t, r"(?i)\A(cAN|AN)\s*(\d+(?:\.\d+)*)\s*\z", 1)
    number = F.regexp_extract(t, r"(?i)\A(cAN|AN)\s*(\d+(?:\.\d+)*)\s*\z", 2)
    return (
        F.when(F.lower(kind) == "can", F.concat(F.lit("cAN "), number))
        .when(F.lower(kind) == "an", F.concat(F.lit("AN "), number))
        .otherwise(t)
    )


def citations(answers: DataFrame, text: str = "text") -> DataFrame:
    """One row per citation outside code fences: in parentheses or bare, in order."""
    others = [c for c in answers.columns if c != text]
    parts = F.split(text_or_blank(text), "```")
    outside = F.array_join(F.filter(parts, lambda p, i: i % 2 == 0), "\n\u0000\n")
    found = F.regexp_extract_all(outside, F.lit(f"{_PAREN}|{_BARE}"), F.lit(0))
    rows = answers.select(*others, F.posexplode(found).alias("ord", "_c"))
    inner = F.regexp_replace("_c", r"\A[(]|[)]\z", "")
    commentary = F.lower(F.substring(inner, 1, 3)) == "can"
    return rows.select(
        *others, "ord",
        F.when(commentary, F.lit("commentary")).otherwise(F.lit("sutta")).alias("kind"),
        normalize_citation(inner).alias("ref"),
    )


def resolve(cites: DataFrame, items: DataFrame) -> DataFrame:
    """The item of every citation: readings by id, commentaries by commentary id, earlier book first."""
    def targets(column: str, kind: str) -> DataFrame:
        first = F.min_by("suttaid", F.struct("book", "pos")).alias("suttaid")
        return items.groupBy(F.col(column).alias("ref")).agg(first).withColumn("kind", F.lit(kind))

    known = targets("suttaid", "sutta").unionByName(targets("commentary_id", "commentary"))
    return cites.join(known, ["kind", "ref"], "left")
