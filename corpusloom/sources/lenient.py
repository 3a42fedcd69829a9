"""Record files that are not valid JSON."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import text_or_blank

# Neighbouring keys between which hand-edited files lack a comma.
COMMA_AFTER = [
    ("sutta", "commentry"),
    ("sutta", "commentary_id"),
    ("commentary_id", "commentary"),
    ("sutta", "commentary"),
]


def _valid(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def repair_json(c: Column) -> Column:
    """The text itself when it is JSON, else with control characters, missing and trailing commas mended; NULL if still broken."""
    t = F.regexp_replace(F.ltrim(text_or_blank(c), F.lit("\ufeff")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for before, after in COMMA_AFTER:
        value = rf'("{before}"\s*:\s*"(?:[^"\\]++|\\\\.)*+")'
        t = F.regexp_replace(t, value + rf'(\s*\n\s*"{after}"\s*:)', "$1,$2")
    t = F.regexp_replace(t, r",(\s*[}\]])", "$1")
    return F.when(_valid(c), c).when(_valid(t), t)


_ID = re.compile(r'"suttaid"\s*:\s*"([^"]+)"')
_COMMENTARY_ID = re.compile(r'"commentary_id"\s*:\s*"([^"]*)"')
_TEXT_KEYS = ("commentry", "commentary")


def _closed(key: str, line: str):
    return re.search(rf'"{key}"\s*:\s*"(.*)"\s*,?\s*$', line)


def _bare(value: str) -> str:
    value = value.strip().rstrip(",")
    return value[1:-1] if len(value) >= 2 and value[0] == value[-1] == '"' else value


def _opens(line: str) -> tuple[str, str] | None:
    """Field and value a line begins, if it begins a text field."""
    whole = _closed("sutta", line)
    if whole:
        return "sutta", whole.group(1)
    for key in _TEXT_KEYS:
        if f'"{key}"' in line:
            whole = _closed(key, line)
            rest = re.search(rf'"{key}"\s*:\s*(.*)$', line)
            return key, whole.group(1) if whole else (_bare(rest.group(1)) if rest else "")
    return None


def records_from_lines(raw: str) -> list[dict]:
    """Records of a broken file, read line by line; a line without a key continues the field before it."""
    records: list[dict] = []
    field = None
    for line in filter(None, (part.strip() for part in raw.splitlines())):
        if '"suttaid"' in line:
            found = _ID.search(line)
            records.append({"suttaid": found.group(1) if found else ""})
            field = None
            continue
        if not records:
            records.append({"suttaid": ""})
        current = records[-1]
        if '"commentary_id"' in line:
            found = _COMMENTARY_ID.search(line)
            if found:
                current["commentary_id"] = found.group(1)
            continue
        opened = _opens(line)
        if opened:
            field, current[opened[0]] = opened
        elif field:
            current[field] = current.get(field, "") + "\n" + _bare(line)
    shaped = []
    for r in records:
        body = (r.get("commentary") or r.get("commentry") or "").strip()
        if r["suttaid"] and (r.get("sutta") or body):
            shaped.append(
                {
                    "suttaid": r["suttaid"].strip(), "sutta_id": None, "sutta": (r.get("sutta") or "").strip(),
                    "commentary": None, "commentry": body, "commentary_id": (r.get("commentary_id") or "").strip() or None,
                    "chain": None,
                }
            )
    return shaped


def salvage_records(c: Column) -> Column:
    """Records of a file that stayed broken, as an array of record structs."""

    @F.arrow_udf(f"array<struct<{schemas.RECORDS}>>")
    def salvage(batch: pa.Array) -> pa.Array:
        chain = pa.struct(
            [("items", pa.list_(pa.string())), ("count", pa.int32()), ("is_ordered", pa.bool_()), ("category", pa.string())]
        )
        names = ["suttaid", "sutta_id", "sutta", "commentary", "commentry", "commentary_id"]
        record = pa.struct([(n, pa.string()) for n in names] + [("chain", chain)])
        rows = [None if raw is None else records_from_lines(raw) for raw in batch.to_pylist()]
        return pa.array(rows, pa.list_(record))

    return salvage(c)
