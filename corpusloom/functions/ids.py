"""Identifier grammar: dotted ids, spoken ids, canon ids, books."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from . import native
from .text import strip, text_or_blank

ID3 = r"(?U)(?<!\d)(\d{1,2}\.\d{1,3}\.\d{1,3})(?!\d)"
ID2 = r"(?U)(?<!\d)(\d{1,2}\.\d{1,3})(?!\.\d)(?!\d)"
BOOK1_ID3 = r"(?U)(?<!\d)(1\.\d+\.\d+)(?!\d)"
BOOK1_ID2 = r"(?U)(?<!\d)(1\.\d+)(?!\.\d)(?!\d)"
REFERENCE = r"(?iU)###\s*REFERENCE:\s*(AN\s+[\d.]+(?:\s*\([^)]*\))?)\s*"


def join_spaced_ids(c: Column | str) -> Column:
    """``4.19 186`` as ``4.19.186``, unless the third number starts a decimal."""
    return F.regexp_replace(
        text_or_blank(c),
        r"(?U)(?<!\d)(\d{1,2})\.(\d{1,3})\s+(\d{1,3})(?!\.\d)(?!\d)",
        "$1.$2.$3",
    )


def write_out_ids(c: Column | str, *, strict_first: bool = True) -> Column:
    """All id spellings as dotted numbers. Only rows with the word ``point`` visit Python."""
    t = text_or_blank(c)
    spoken = native.spoken_ids(
        F.when(F.lower(t).contains("point"), t), strict_first=strict_first
    )
    return F.coalesce(spoken, join_spaced_ids(t))


def first_id(c: Column) -> Column:
    """First three-part id of a text, else the first two-part id, else blank."""
    return F.coalesce(
        F.nullif(F.regexp_extract(c, ID3, 1), F.lit("")), F.regexp_extract(c, ID2, 1)
    )


def infer_id(c: Column | str, *, chars: int = K.LEAD_CHARS, strict_first: bool = True) -> Column:
    lead = F.substring(text_or_blank(c), 1, chars)
    return first_id(write_out_ids(lead, strict_first=strict_first))


def canon_id(c: Column | str) -> Column:
    """``4.8.79`` and ``4.79`` both as ``an4.79``."""
    compact = F.replace(F.lower(strip(c)), F.lit(" "), F.lit(""))
    parts = F.filter(F.split(compact, r"\."), lambda p: p != "")
    n = F.size(parts)
    return (
        F.when(n == 0, F.lit(""))
        .when(n == 1, F.concat(F.lit("an"), F.get(parts, F.lit(0))))
        .otherwise(F.concat(F.lit("an"), F.get(parts, F.lit(0)), F.lit("."), F.get(parts, n - 1)))
    )


def _int_or(c: Column, default: int | None) -> Column:
    value = F.nullif(c, F.lit("")).try_cast("int")
    return value if default is None else F.coalesce(value, F.lit(default))


def book_from_reference(c: Column | str) -> Column:
    return _int_or(F.regexp_extract(text_or_blank(c), r"(?iU)AN\s+(\d+)", 1), 0)


def id_from_reference(c: Column | str) -> Column:
    return F.regexp_extract(text_or_blank(c), r"(?iU)AN\s+([\d.]+)", 1)


def book_from_filename(c: Column | str) -> Column:
    return _int_or(F.regexp_extract(text_or_blank(c), r"(?iU)Book\s+(\d+)([A-Za-z])?", 1), 0)


def is_first_book_file(c: Column | str) -> Column:
    return F.rlike(text_or_blank(c), F.lit(r"(?iU)Book\s+1[ABCD]\b"))


def book_from_record_id(c: Column | str) -> Column:
    """``11.16`` is in book 11; anything not starting with a number and a dot has no book."""
    return _int_or(F.regexp_extract(strip(c), r"(?U)\A(\d+)\.", 1), None)


def book_from_canon_id(c: Column | str) -> Column:
    return _int_or(F.regexp_extract(F.lower(strip(c)), r"(?U)\Aan(\d+)\.", 1), 0)


def book_or_zero(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).try_cast("int"), F.lit(0))


def book_with_fallback(reference_book: Column, file_book: Column) -> Column:
    return F.when(reference_book > 0, reference_book).when(file_book > 0, file_book).otherwise(F.lit(0))


def file_order(name: Column | str) -> Column:
    """Numeric order of ``an<N>.json`` files, others last."""
    return _int_or(F.regexp_extract(text_or_blank(name), r"(?iU)\Aan(\d+)\.json\z", 1), 999)


def is_transition_only(c: Column | str) -> Column:
    return F.rlike(F.lower(strip(c)), F.lit(r"\A(the )?next (sutta|sura|sultana) is\.?\z"))


def text_supports_id(tid: Column | str, content: Column | str) -> Column:
    """Whether a segment's own text mentions its id, as spoken or as written."""
    t = strip(tid)
    body = text_or_blank(content)
    head = F.substring(body, 1, K.SUPPORT_CHARS)
    compact = F.regexp_replace(head, f"[{K.WS_CLASS}]+", "")
    return (
        (t != "")
        & (strip(body) != "")
        & ((infer_id(body) == t) | F.contains(head, t) | F.contains(compact, t))
    )


def insert_headers(c: Column, pattern: str) -> Column:
    """A reference header before each id, unless one stands within the window before it."""
    gap = K.HEADER_WINDOW - len(K.HEADER)
    # The window is looked at only where a digit stands.
    guarded = pattern.replace("(?U)(?<!\\d)", rf"(?U)(?=\d)(?<!\d)(?<!{K.HEADER}[\s\S]{{0,{gap}}})", 1)
    return F.regexp_replace(c, guarded, f"\n\n{K.HEADER} AN $1\n\n$1")


def tag_references(text: Column | str, filename: Column | str, markers: dict[str, str] | None = None) -> Column:
    """Header insertion by the rules for the file's book, then the fixed marker overrides."""
    t = write_out_ids(text)
    first_book = insert_headers(insert_headers(t, BOOK1_ID3), BOOK1_ID2)
    any_book = insert_headers(insert_headers(t, ID3), ID2)
    tagged = (
        F.when(is_first_book_file(filename), first_book)
        .when(book_from_filename(filename) > 0, any_book)
        .otherwise(t)
    )
    for pattern, canonical in (K.MARKERS if markers is None else markers).items():
        tagged = F.regexp_replace(tagged, pattern, f"\n\n{K.HEADER} {canonical}\n\n")
    return tagged


def translation_text(keys: Column, texts: Column, separator: str = "") -> Column:
    """Text of a translation snapshot, in key order where one is given.

    With a blank separator pieces are joined as they are; otherwise each is stripped and blanks dropped.
    """
    ordered = F.transform(keys, lambda k: F.coalesce(F.get(F.transform(F.array(k), lambda x: texts[x]), F.lit(0)), F.lit("")))
    pieces = F.when(F.coalesce(F.size(keys), F.lit(0)) > 0, ordered).otherwise(F.map_values(texts))
    if separator:
        pieces = F.filter(F.transform(pieces, strip), lambda p: p != "")
        joined = F.array_join(pieces, separator)
    else:
        joined = F.when(F.coalesce(F.size(keys), F.lit(0)) > 0, F.array_join(pieces, "")).otherwise(
            F.array_join(pieces, " ")
        )
    return F.when(texts.isNull(), F.lit("")).otherwise(strip(joined))
