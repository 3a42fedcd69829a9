"""Conversations repaired with the cheapest edits; see ``audits.py`` for the dynamic programming.

Turns are put in order by range partitioning, so a conversation of any length is spread over blocks. Only one character
per turn - its role's initial and its fault - meets in one place: block by block, then the blocks of a conversation. The
texts stay where they are until the edits, one row each, are joined to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import audits
from .blocks import ordered_rows
from .common import lean, stored

#: White space of turns, as characters to trim.
SPACE = " \t\n\x0b\x0c\r"
#: Edits that are given on at once.
AT_ONCE = 1 << 16


def in_order(turns: DataFrame) -> DataFrame:
    """Turns by conversation and turn (nulls first), then role, the text's first 32 characters and its hash; nulls are empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    trimmed = F.rtrim("text", F.lit(SPACE))
    initial = F.left("role", F.lit(1))
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    whole = F.right(trimmed, F.lit(1)).isin(".", "!", "?")
    rows = rows.select("*", F.md5(F.col("text").cast("binary")).alias("digest"), place.alias("initial"), (trimmed == "").alias("blank"), whole.alias("whole"))
    return ordered_rows(rows, ["conv_id", "turn", "role", F.left("text", F.lit(32)), F.xxhash64("text")], "turns")


def codes(rows: DataFrame) -> DataFrame:
    """(conv_id, parts) of ``in_order`` rows: by block, the number of its first turn and the codes of its turns."""
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), audits.BLANK).when(F.col("first").isNull(), audits.DUPLICATE).when(~F.col("whole"), audits.TRUNCATED).otherwise(audits.SOUND)
    code = F.char(65 + 4 * F.col("initial") + fault)
    coded = rows.select("at", "block", "conv_id", "initial", "blank", "whole").join(first, "at", "left").select("at", "block", "conv_id", code.alias("code"))
    inside = coded.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("turns"))
    inside = inside.select("conv_id", F.struct(F.col("turns")[0].at.alias("at"), F.array_join("turns.code", "").alias("codes")).alias("part"))
    return inside.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))


def _audited(coded: DataFrame) -> DataFrame:
    kind = coded.schema["conv_id"].dataType.simpleString()

    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [audits.audit("".join(p["codes"] for p in parts)) for parts in batch.column("parts").to_pylist()]
            columns = zip(*found) if found else [[]] * 4
            made = [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("parts"), *made], ["conv_id", "parts", "illegal", "cost", "audit", "roles"])

    parts = coded.schema["parts"].dataType.simpleString()
    return coded.mapInArrow(lean(look), f"conv_id {kind}, parts {parts}, illegal long, cost long, audit string, roles string")


def _edits(audited: DataFrame) -> DataFrame:
    """One row per edit: conv_id, place, edit, role (null: the turn's own), at (the turn's number; null: inserted)."""
    kind = audited.schema["conv_id"].dataType.simpleString()

    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = {" ": None, "u": "user", "a": "assistant"}
        for batch in batches:
            for conv, parts, edits, roles in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3))):
                turns = (p["at"] + k for p in parts for k in range(len(p["codes"])))
                for low in range(0, len(edits), AT_ONCE):
                    some = edits[low : low + AT_ONCE]
                    at = [None if e == "I" else next(turns) for e in some]
                    set_ = [names[r] for r in roles[low : low + AT_ONCE]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(conv, len(some)), pa.array(range(low, low + len(some)), pa.int64()), pa.array(list(some), pa.string()), pa.array(set_, pa.string()), pa.array(at, pa.int64())],
                        ["conv_id", "place", "edit", "role", "at"],
                    )

    return audited.select("conv_id", "parts", "audit", "roles").mapInArrow(lean(look), f"conv_id {kind}, place long, edit string, role string, at long")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report and repaired turns of ``turns`` (conv_id, turn, role, text).

    The report has one row per conversation: conv_id, gaps (turn numbers missing between the least and the greatest),
    blank, duplicate, truncated (turns by their first fault), illegal (adjacent turns whose roles may not follow each
    other), cost and audit (the cheapest edits, of those the least in ASCII). The repaired turns: conv_id, place, edit,
    role, text; deleted turns aren't among them.

    Turns are taken by turn number, null ones first, then by role and text (see ``in_order``); rows that repeat are
    duplicates. A null role or text counts as empty, a null conv_id as a conversation of its own. Texts of any length stay whole.
    Further columns don't matter; an empty table gives empty tables. The audit of a conversation is one value, a
    character per edit, and is made in one task; its texts never meet.
    """
    rows = in_order(turns)
    audited = stored(_audited(codes(rows)), "audits")
    spans = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    all_codes = F.array_join("parts.codes", "")
    count = lambda fault: (F.length(all_codes) - F.length(F.translate(all_codes, "".join(chr(65 + 4 * i + fault) for i in range(4)), ""))).cast("long")
    counts = {name: count(fault) for name, fault in (("blank", audits.BLANK), ("duplicate", audits.DUPLICATE), ("truncated", audits.TRUNCATED))}
    told = audited.withColumns(counts).withColumnRenamed("conv_id", "conv")
    report = spans.join(told, F.col("conv_id").eqNullSafe(F.col("conv"))).select("conv_id", "gaps", *counts, "illegal", "cost", "audit")

    edits = _edits(audited).where("edit <> 'D'")
    texts = rows.select("at", F.col("role").alias("own"), "text")
    stay = edits.where("at IS NOT NULL").join(texts, "at").select("conv_id", "place", "edit", F.coalesce("role", "own").alias("role"), "text")
    new = edits.where("at IS NULL").select("conv_id", "place", "edit", "role", F.lit("").alias("text"))
    return report, stay.unionByName(new)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of each conversation's ``role:text`` lines in order; read as a sorted stream, never held whole."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def row(conv, digest):
            return pa.RecordBatch.from_arrays([pa.array([conv.as_py()], conv.type), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

        last, digest = None, None
        for batch in batches:
            done = []
            for conv, line in zip(batch.column(0), batch.column(1)):
                if digest is None or conv != last:
                    if digest is not None:
                        done.append(row(last, digest))
                    last, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(line.as_buffer())
            yield from done
        if digest is not None:
            yield row(last, digest)

    lines = repaired.select("conv_id", "place", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    sorted_ = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "line")
    return sorted_.mapInArrow(lean(look), f"conv_id {kind}, repaired_sha256 string")
