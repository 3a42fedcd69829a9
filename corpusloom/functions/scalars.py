"""Dates, roles, casts and other small scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import is_blank, strip, text_or_blank

UUID = r"\A[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\z"


def micros(c: Column | str) -> Column:
    """ISO-8601 time as epoch micros; missing or unparsable is 0."""
    t = text_or_blank(c)
    return F.coalesce(F.unix_micros(F.try_to_timestamp(F.nullif(t, F.lit("")))), F.lit(0).cast("bigint"))


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def show_millis(c: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_millis(F.col(c) if isinstance(c, str) else c), pattern)


def role_from_sender(c: Column | str) -> Column:
    """``human`` is a user; unknown senders have no role."""
    s = F.lower(strip(c))
    return (
        F.when(s.isin("human", "user"), F.lit("user"))
        .when(s == "assistant", F.lit("assistant"))
        .when(s == "system", F.lit("system"))
    )


def known_role(c: Column | str) -> Column:
    s = F.lower(strip(c))
    return F.when(s.isin("user", "assistant", "system"), s)


def canonical_uuid(c: Column | str) -> Column:
    """Lower-case hyphenated form of a UUID in any accepted spelling, NULL for anything else."""
    t = F.lower(strip(c))
    t = F.regexp_replace(F.regexp_replace(t, "urn:|uuid:", ""), r"\A[{}]+|[{}]+\z", "")
    digits = F.replace(t, F.lit("-"), F.lit(""))
    hyphenated = F.regexp_replace(digits, r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5")
    return F.when(F.rlike(digits, F.lit(r"\A[0-9a-f]{32}\z")), hyphenated)


def is_uuid(c: Column | str) -> Column:
    return canonical_uuid(c).isNotNull()


def valid_turn(q: Column | str, a: Column | str) -> Column:
    return ~is_blank(q) & ~is_blank(a) & (strip(a) != K.NO_ANSWER)


def weak_reply(c: Column | str) -> Column:
    return F.length(strip(c)) < K.MIN_REPLY_CHARS


def normal_book(c: Column | str, default: str = "an1") -> Column:
    b = F.lower(strip(c))
    return F.when(b.isin(*K.BOOKS), b).otherwise(F.lit(default))


def infer_book(book: Column | str, source: Column | str, default: str = "") -> Column:
    """Book of a stored chunk: its own value if valid, else from the source name, else the default."""
    b = F.lower(strip(book))
    return (
        F.when(b.isin(*K.BOOKS), b)
        .when(F.lower(text_or_blank(source)).contains("an2"), F.lit("an2"))
        .otherwise(F.lit(default))
    )


def safe_title(c: Column | str, limit: int = 120) -> Column:
    return F.substring(F.regexp_replace(text_or_blank(c), r'[<>:"/\\|?*]', ""), 1, limit)


def numbered_name(index: Column | str, title: Column | str) -> Column:
    i = strip(index)
    n = F.when(F.rlike(i, F.lit(r"\A[0-9]+\z")), i.try_cast("int")).otherwise(F.lit(0))
    padded = F.when(n >= 1000, n.cast("string")).otherwise(F.lpad(n.cast("string"), 3, "0"))
    return F.concat(padded, F.lit("_"), safe_title(title))


def unit_suffix(i: Column) -> Column:
    return F.char(F.lit(97) + i)


def json_list(c: Column | str) -> Column:
    """A JSON array of strings, NULL when the text is no JSON array. Non-string members become NULL."""
    t = text_or_blank(c)
    parsed = F.try_parse_json(t)
    items = F.try_variant_get(parsed, "$", "array<variant>")
    return F.transform(
        items,
        lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")),
    )


def suggestion_list(items: Column) -> Column:
    """Non-blank strings of bounded length, at most five."""
    stripped = F.transform(items, lambda s: F.when(s.isNotNull(), strip(s)))
    kept = F.filter(
        stripped, lambda s: s.isNotNull() & (s != "") & (F.length(s) <= K.MAX_SUGGESTION_CHARS)
    )
    return F.slice(kept, 1, K.MAX_SUGGESTIONS)


def reply_and_suggestions(c: Column | str) -> Column:
    """Visible reply and follow-up questions of a generated answer."""
    raw = strip(c)
    mark = F.lit(K.SUGGESTIONS_MARKER)
    has = F.contains(raw, mark)
    tail_raw = F.substring_index(raw, K.SUGGESTIONS_MARKER, -1)
    head = F.substr(raw, F.lit(1), F.length(raw) - F.length(tail_raw) - len(K.SUGGESTIONS_MARKER))
    head = F.rtrim(head, F.lit(K.WS_CHARS))
    tail = strip(tail_raw)
    items = json_list(tail)
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(~has, raw).when((tail == "") | items.isNotNull(), head).otherwise(raw).alias("reply"),
        F.when(has & items.isNotNull(), suggestion_list(items)).otherwise(none).alias("suggestions"),
    )


def starter_questions(c: Column | str) -> Column:
    """Questions of a ``{"questions": [...]}`` reply, with or without a code fence."""
    from .text import drop_code_fence

    parsed = F.try_parse_json(drop_code_fence(c))
    items = F.try_variant_get(parsed, "$.questions", "array<variant>")
    texts = F.transform(
        items,
        lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")),
    )
    return F.coalesce(suggestion_list(texts), F.array().cast("array<string>"))


def salvage_object(c: Column | str, schema: str) -> Column:
    """A JSON object parsed strictly, else from the first ``{`` to the last ``}``; NULL when neither works."""
    t = strip(c)
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    def as_object(x: Column) -> Column:
        parsed = F.try_parse_json(x)
        return F.when(
            F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.from_json(x, schema)
        )
    return F.coalesce(as_object(t), as_object(inner))
