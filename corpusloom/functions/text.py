"""String scalars (Column -> Column) and the few query-string helpers that run on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

_WS_RUN = f"[{K.WS_CLASS}]+"


def text_or_blank(c: Column | str) -> Column:
    """NULL behaves like the empty string everywhere in this library."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    A column used inside a lambda over an array is otherwise evaluated again for
    every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Drop leading and trailing Unicode white space."""
    return F.btrim(text_or_blank(c), F.lit(K.WS_CHARS))


def squeeze(c: Column | str) -> Column:
    """Collapse white-space runs to one space and strip."""
    return F.btrim(F.regexp_replace(text_or_blank(c), _WS_RUN, " "), F.lit(" "))


def normalize(c: Column | str) -> Column:
    return F.lower(squeeze(c))


def is_blank(c: Column | str) -> Column:
    return strip(c) == ""


def or_none(c: Column) -> Column:
    """NULL for the empty string."""
    return F.nullif(c, F.lit(""))


def ascii_apostrophes(c: Column | str) -> Column:
    return F.translate(text_or_blank(c), "’‘", "''")


def repair_speech_errors(c: Column | str) -> Column:
    """Mis-heard forms of the split markers' key word, repaired before marker search."""
    t = ascii_apostrophes(c)
    for pattern, replacement in (
        (r"suta", "sutta"),
        (r"utah", "sutta"),
        (r"nexuta|nexus", "next sutta"),
        (r"end of the so", "end of the sutta"),
    ):
        t = F.regexp_replace(t, rf"(?iU)\b(?:{pattern})\b", replacement)
    return t


def normalize_for_markers(c: Column | str) -> Column:
    return F.lower(squeeze(repair_speech_errors(c)))


def normalize_for_similarity(c: Column | str) -> Column:
    t = F.lower(squeeze(ascii_apostrophes(c)))
    return squeeze(F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}_{K.WS_FLAT}\u0080-ɏ]", " "))


def hyphen_loose(c: Column | str) -> Column:
    return strip(F.replace(text_or_blank(c), F.lit("-"), F.lit(" ")))


def count_occurrences(hay: Column, needle: Column | str) -> Column:
    """Non-overlapping occurrences of an already normalised needle in an already normalised text."""
    tok = F.lit(needle) if isinstance(needle, str) else needle
    removed = F.length(hay) - F.length(F.replace(hay, tok, F.lit("")))
    return F.when(F.length(tok) > 0, (removed / F.length(tok)).cast("int")).otherwise(F.lit(0))


def truncate(c: Column | str, limit: int) -> Column:
    """At most ``limit`` characters, the last three being dots when text was cut."""
    t = text_or_blank(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 3), F.lit("...")))


def one_line(c: Column | str, limit: int = 600) -> Column:
    return truncate(F.translate(text_or_blank(c), "\t\r\n", "   "), limit)


def ellipsis(c: Column, limit: int) -> Column:
    """The first ``limit`` characters and one ellipsis character when text was cut."""
    return F.concat(F.substring(c, 1, limit), F.when(F.length(c) > limit, F.lit("…")).otherwise(F.lit("")))


def chat_probe(c: Column | str) -> Column:
    t = F.regexp_replace(F.lower(strip(c)), r"[!?.]+\z", "")
    return F.regexp_replace(t, _WS_RUN, " ")


def sanitize_answer(c: Column | str) -> Column:
    t = text_or_blank(c)
    cleaned = F.regexp_replace(t, rf"(?U)\b[Ee]xcerpt[{K.WS_CLASS}]*\d+\b", "")
    cleaned = strip(F.regexp_replace(cleaned, r"\n{3,}", "\n\n"))
    return F.when(is_blank(t), t).otherwise(cleaned)


def mask_triple_ids(c: Column | str, limit: int = K.MAX_UNIT_PROMPT_CHARS) -> Column:
    masked = F.regexp_replace(
        text_or_blank(c), r"(?U)(?<!\d)\d{1,2}\.\d{1,3}\.\d{1,3}(?!\d)", "[id]"
    )
    return F.substring(masked, 1, limit)


def question_title(c: Column | str, limit: int = 56) -> Column:
    return ellipsis(squeeze(c), limit)


def escape_html(c: Column | str) -> Column:
    t = text_or_blank(c)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(raw), F.lit(entity))
    return t


def drop_code_fence(c: Column | str) -> Column:
    t = strip(c)
    inner = F.regexp_replace(t, rf"\A```[a-zA-Z]*[{K.WS_CLASS}]*", "")
    inner = strip(F.regexp_replace(inner, rf"[{K.WS_CLASS}]*```\z", ""))
    return F.when(F.startswith(t, F.lit("```")), inner).otherwise(t)


def safe_name(c: Column | str, keep: str = r".\-") -> Column:
    """File-name form of an identifier: word characters and ``keep`` stay."""
    return F.regexp_replace(text_or_blank(c), rf"[^\p{{L}}\p{{N}}_{keep}]", "_")


def transcript_opening(c: Column | str, limit: int = K.TRANSCRIPT_OPENING_CHARS) -> Column:
    body = F.regexp_replace(strip(c), rf"(?U)\A[{K.WS_CLASS}]*(?:\d+\.)+\d+[{K.WS_CLASS}]+", "")
    return F.substring(body, 1, limit)


def canon_opening(c: Column | str, limit: int = K.CANON_OPENING_CHARS) -> Column:
    """From the first word ``Then``, else from the first opening quote, else from the start."""
    t = strip(c)
    before_then = F.regexp_extract(t, r"(?sU)\A(.*?)\bThen\b", 1)
    has_then = F.rlike(t, F.lit(r"(?U)\bThen\b"))
    before_quote = F.regexp_extract(t, r"(?s)\A([^“\"]*)[“\"]", 1)
    has_quote = F.rlike(t, F.lit(r"[“\"]"))
    start = (
        F.when(has_then, F.length(before_then))
        .when(has_quote, F.length(before_quote))
        .otherwise(F.lit(0))
    )
    return F.substr(t, start + 1, F.lit(limit))


def title_and_opening(c: Column | str) -> Column:
    """Heuristic title and opening of a canon text, as ``struct<title,opening,quoted>``."""
    t = text_or_blank(c)
    before = F.regexp_extract(t, r"(?s)\A([^“\"]*)[“\"]", 1)
    quoted = F.rlike(t, F.lit(r"[“\"]"))
    flat = squeeze(t)

    head = F.translate(strip(before), "\n", " ")
    bare = F.regexp_replace(head, rf"(?iU)\A[{K.WS_CLASS}]*Numbered[{K.WS_CLASS}]+Discourses[{K.WS_CLASS}]+", "")
    bare = strip(
        F.regexp_replace(bare, rf"(?U)\A[\d.]+[{K.WS_CLASS}]+\d+\.[{K.WS_CLASS}]+", "")
    )
    head_tail = strip(F.right(head, F.lit(K.TITLE_CHARS)))
    title = F.substring(F.when(bare == "", head_tail).otherwise(bare), 1, K.TITLE_CHARS)
    opening = squeeze(F.substr(t, F.length(before) + 2, F.lit(K.OPENING_CHARS)))
    return F.struct(
        F.when(quoted, title).otherwise(F.substring(flat, 1, K.TITLE_CHARS)).alias("title"),
        F.when(quoted, opening).otherwise(F.substring(flat, 1, K.OPENING_CHARS)).alias("opening"),
        quoted.alias("quoted"),
    )


def token_array(c: Column | str) -> Column:
    """Search tokens of a question column: words of three or more letters outside the stop list, first twelve."""
    words = F.regexp_extract_all(F.lower(text_or_blank(c)), F.lit("[a-z0-9']+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in K.QUERY_STOPWORDS])
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))
    return F.slice(kept, 1, K.MAX_QUERY_TOKENS)


# --- driver-side helpers over one query string --------------------------------


def squeeze_query(q: str | None) -> str:
    return " ".join((q or "").split()).lower()


def loose_query(norm: str) -> str:
    return norm.replace("-", " ").strip()


def query_tokens(q: str | None) -> list[str]:
    words = re.findall(r"[a-z0-9']+", (q or "").lower())
    stop = set(K.QUERY_STOPWORDS)
    return [w for w in words if len(w) >= 3 and w not in stop][: K.MAX_QUERY_TOKENS]


def topic_tokens(q: str | None) -> list[str]:
    """All white-space tokens of two or more characters; duplicates count again."""
    return [w for w in (q or "").split() if len(w) >= 2]


#: Which words in a question add which literal search phrase: every rule is
#: (words that must all occur, phrase); the first rule of a tuple that fires wins.
BOOST_RULES: list[list[tuple[list[str], str]]] = [
    [(["thorough attention"], "thorough attention")],
    [(["yoniso"], "Yoniso")],
    [(["manasikara"], "Manasikara")],
    [(["feature of beauty"], "feature of beauty")],
    [(["subha-nimitta"], "Subha-nimitta"), (["nimitta", "subha"], "Subha-nimitta")],
    [(["smell"], "scent"), (["scent"], "scent"), (["odor"], "scent"), (["fragrance"], "scent")],
    [(["sound"], "sound")],
    [(["touch"], "touch")],
    [(["taste"], "taste")],
    [(["oyster"], "oysters")],
    [(["pool", "water"], "pool of water"), (["water"], "pool of water")],
]


def boost_phrases(q: str | None) -> list[str]:
    low = (q or "").lower()
    found = []
    for alternatives in BOOST_RULES:
        hit = next((phrase for words, phrase in alternatives if all(w in low for w in words)), None)
        if hit:
            found.append(hit)
    return list(dict.fromkeys(found))


def search_terms(q: str | None, *, boost: bool = False) -> list[str]:
    """Distinct literal terms of a keyword pass: boosts, then the short phrase, then the tokens."""
    phrase = (q or "").strip().lower()
    terms = boost_phrases(q) if boost else []
    if phrase and len(phrase) <= K.PHRASE_MAX_CHARS and len(phrase.split()) >= 2:
        terms.append(phrase)
    terms += query_tokens(q)
    return list(dict.fromkeys(terms))[: K.TERMS_SCRIPTURE if boost else K.TERMS_BASE]
