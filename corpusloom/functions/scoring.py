"""Ranking and quality scores as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from . import native
from .text import (
    canon_opening,
    count_occurrences,
    hyphen_loose,
    is_blank,
    let,
    loose_query,
    normalize,
    query_tokens,
    squeeze,
    squeeze_query,
    strip,
    text_or_blank,
    topic_tokens,
    transcript_opening,
)


def _total(parts: list[Column], zero: Column) -> Column:
    return reduce(add, parts, zero)


# --- lexical score ------------------------------------------------------------


def lexical_score(text: Column | str, query: str) -> Column:
    """Points for the literal short question plus a share of its tokens; a token matches as a substring."""
    q = (query or "").strip().lower()
    if not q:
        return F.lit(0)
    low = F.lower(text_or_blank(text))
    tokens = query_tokens(q)
    points = F.lit(0)
    if len(q) <= K.PHRASE_MAX_CHARS:
        points = F.when(low.contains(q), F.lit(K.EXACT_PHRASE_POINTS)).otherwise(F.lit(0))
    if tokens:
        matched = _total([low.contains(t).cast("int") for t in tokens], F.lit(0))
        ratios = [m / len(tokens) for m in range(len(tokens) + 1)]
        table = [int(r * K.TOKEN_POINTS) if r >= K.TOKEN_RATIO_MIN else 0 for r in ratios]
        points = points + F.get(F.array(*[F.lit(p) for p in table]), matched)
    return points


# --- topic score --------------------------------------------------------------


class Topic:
    """A topic query prepared once: its tokens and both normal forms."""

    def __init__(self, query: str):
        self.query = query or ""
        self.tokens = topic_tokens(query)
        self.norm = squeeze_query(query)
        self.loose = loose_query(self.norm)
        self.n = len(self.norm)

    def within(self, norm: Column, loose: Column) -> Column:
        """The question occurs in a text, with hyphens tolerated."""
        return norm.contains(self.norm) | loose.contains(self.loose)

    def occurs(self, lowered: Column) -> Column:
        """The question occurs in a long lower-case text whose white space is not yet collapsed.

        Only a text holding every word of the question is normalised at all.
        """
        squeezed = squeeze(lowered)
        words = [F.contains(lowered, F.lit(w)) for w in dict.fromkeys(self.loose.split())]
        return F.when(
            reduce(and_, words, F.lit(True)), self.within(squeezed, hyphen_loose(squeezed))
        ).otherwise(F.lit(False))

    def covers(self, norm: Column, loose: Column) -> Column:
        """A text occurs in the question, with hyphens tolerated."""
        return F.contains(F.lit(self.norm), norm) | F.contains(F.lit(self.loose), loose)

    def equals(self, norm: Column, loose: Column) -> Column:
        return (norm == self.norm) | (loose == self.loose)


def has_chain(items: Column) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def category_equals(category: Column, topic: Topic) -> Column:
    if not topic.norm:
        return F.lit(False)
    norm = normalize(category)
    return (text_or_blank(category) != "") & topic.equals(norm, hyphen_loose(norm))


def chain_bonus(category: Column, items: Column, topic: Topic) -> Column:
    if topic.n < 2:
        return F.lit(0.0)
    none = F.array().cast("array<string>")
    cat = normalize(category)
    cat_loose = hyphen_loose(cat)
    norms = F.transform(F.coalesce(items, none), normalize)
    blob = squeeze(F.concat_ws(" ", cat, F.array_join(norms, " ")))

    by_category = F.when(topic.equals(cat, cat_loose), F.lit(K.BONUS_CATEGORY_EQ))
    if topic.n >= 5:
        by_category = by_category.when(
            topic.within(cat, cat_loose) | topic.covers(cat, cat_loose), F.lit(K.BONUS_CATEGORY_PHRASE)
        )
    by_category = F.when(cat != "", by_category.otherwise(F.lit(0.0))).otherwise(F.lit(0.0))

    by_blob = F.lit(0.0)
    if topic.n >= 6:
        by_blob = F.when(
            (blob != "") & topic.within(blob, hyphen_loose(blob)), F.lit(K.BONUS_QUERY_IN_CHAIN)
        ).otherwise(F.lit(0.0))

    def by_item(item: Column) -> Column:
        loose = hyphen_loose(item)
        value = F.when(item == "", F.lit(0.0)).when(topic.equals(item, loose), F.lit(K.BONUS_ITEM_EQ))
        if topic.n >= 5:
            value = value.when(topic.within(item, loose), F.lit(K.BONUS_ITEM_PHRASE))
        return value.when(
            (F.length(item) >= 8) & topic.covers(item, loose), F.lit(K.BONUS_ITEM_CONTAINED)
        ).otherwise(F.lit(0.0))

    by_items = F.aggregate(F.transform(norms, by_item), F.lit(0.0), lambda acc, x: acc + x)
    return by_category + by_blob + by_items


def lead_has_phrase(sutta: Column, topic: Topic) -> Column:
    if topic.n < 12:
        return F.lit(False)
    lead = normalize(F.substring(text_or_blank(sutta), 1, K.LEAD_IN_CHARS))
    return topic.within(lead, hyphen_loose(lead))


def text_bonus(sutta: Column, sutta_low: Column, commentary_low: Column, topic: Topic) -> Column:
    if topic.n < 2:
        return F.lit(0.0)
    by_text = F.when(lead_has_phrase(sutta, topic), F.lit(K.BONUS_LEAD_IN))
    if topic.n >= 6:
        value = K.BONUS_TEXT_LONG if topic.n >= 10 else K.BONUS_TEXT_MEDIUM
        by_text = by_text.when(topic.occurs(sutta_low), F.lit(value))
    by_text = by_text.otherwise(F.lit(0.0))
    if topic.n < 10:
        return by_text
    return by_text + F.when(topic.occurs(commentary_low), F.lit(K.BONUS_COMMENTARY)).otherwise(F.lit(0.0))


def token_score(chain_low: Column, commentary_low: Column, sutta_low: Column, topic: Topic) -> Column:
    """Weighted occurrence counts. Tokens hold no white space, so lower-case texts need no collapsing."""
    parts = []
    for token in topic.tokens:
        t = squeeze_query(token)
        if len(t) < 2:
            continue
        parts.append(F.lit(K.WEIGHT_CHAIN) * count_occurrences(chain_low, t))
        parts.append(F.lit(K.WEIGHT_COMMENTARY) * count_occurrences(commentary_low, t))
        parts.append(F.lit(K.WEIGHT_SUTTA) * count_occurrences(sutta_low, t))
    return _total(parts, F.lit(0)).cast("double")


# --- alignment ----------------------------------------------------------------


def alignment_words(c: Column | str) -> Column:
    return native.alignment_text(F.col(c) if isinstance(c, str) else c)


def word_set(norm: Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm, " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common words of two normalised texts; 0 when either has none."""
    def share(sets: Column) -> Column:
        wa, wb = sets["a"], sets["b"]
        return let(
            F.size(F.array_intersect(wa, wb)),
            lambda both: F.when(
                (F.size(wa) > 0) & (F.size(wb) > 0), both / (F.size(wa) + F.size(wb) - both)
            ).otherwise(F.lit(0.0)),
        )

    return let(F.struct(word_set(a).alias("a"), word_set(b).alias("b")), share)


def keyword_overlap(transcript_norm: Column, canon_norm: Column) -> Column:
    """Share of the first forty longer canon words that occur in the transcript opening."""
    def share(words: Column) -> Column:
        hits = F.size(F.filter(words, lambda w: F.contains(transcript_norm, w)))
        return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(F.lit(0.0))

    return let(F.slice(F.filter(F.split(canon_norm, " "), lambda w: F.length(w) >= 4), 1, 40), share)


def agreement_inputs(transcript: Column | str, canon: Column | str) -> tuple[Column, Column]:
    return (
        alignment_words(transcript_opening(transcript)),
        alignment_words(canon_opening(canon)),
    )


def agreement(transcript_norm: Column, canon_norm: Column) -> Column:
    blend = (
        F.lit(0.2) * jaccard(transcript_norm, canon_norm)
        + F.lit(0.2) * native.sequence_ratio(transcript_norm, canon_norm)
        + F.lit(0.6) * keyword_overlap(transcript_norm, canon_norm)
    )
    return F.when((transcript_norm == "") | (canon_norm == ""), F.lit(0.0)).otherwise(blend)


def quality_class(score: Column, ok_min: float = K.MAP_OK_MIN, suspect_min: float = K.MAP_SUSPECT_MIN) -> Column:
    return (
        F.when(score >= ok_min, F.lit("ok"))
        .when(score >= suspect_min, F.lit("suspect"))
        .otherwise(F.lit("bad"))
    )


def quality_reason(score: Column, ok_min: float = K.MAP_OK_MIN, suspect_min: float = K.MAP_SUSPECT_MIN) -> Column:
    shown = F.format_string("agreement_score=%.3f", score)
    return (
        F.when(score >= ok_min, F.concat(shown, F.lit(f">={ok_min}")))
        .when(
            score >= suspect_min,
            F.concat(shown, F.lit(f" in [{suspect_min},{ok_min}) (possible topic mismatch)")),
        )
        .otherwise(F.concat(shown, F.lit(f"<{suspect_min} (likely wrong sutta or garbled text)")))
    )


# --- mapping status -----------------------------------------------------------


def content_words(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text_or_blank(c)), F.lit("[a-z\u0080-ɏ']{3,}"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in K.KEYWORD_STOPWORDS])
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def evidence_generic(evidence: Column) -> Column:
    """No evidence phrase has two content words."""
    return ~F.coalesce(F.exists(evidence, lambda p: F.size(content_words(p)) >= 2), F.lit(False))


def clean_match_type(c: Column | str) -> Column:
    t = F.col(c) if isinstance(c, str) else c
    return F.when(t.isin(*K.MATCH_TYPES), t).otherwise(F.lit("unknown"))


def mapping_status(
    primary: Column, best: Column, confidence: Column, is_mixed: Column, flagged: Column,
    evidence: Column, match_type: Column,
) -> Column:
    must_review = (
        primary.isNull()
        | F.coalesce(F.size(best) <= 0, F.lit(True))
        | (match_type == "unknown")
        | is_mixed
        | evidence_generic(evidence)
    )
    return (
        F.when(must_review, F.lit("needs_review"))
        .when((confidence >= 0.90) & ~flagged, F.lit("accept"))
        .when((confidence >= 0.75) & match_type.isin("exact", "probable"), F.lit("accept_with_flag"))
        .otherwise(F.lit("needs_review"))
    )


# --- small talk ---------------------------------------------------------------


def is_small_talk(c: Column | str) -> Column:
    """A short greeting or thanks that needs no retrieval."""
    q = strip(c)
    low = F.lower(q)
    probe = F.regexp_replace(F.regexp_replace(low, r"[!?.]+\z", ""), f"[{K.WS_CLASS}]+", " ")
    tokens = F.regexp_extract_all(probe, F.lit("[a-z']+"), F.lit(0))
    small = F.array(*[F.lit(w) for w in K.GREETING_TOKENS])
    only_small = (
        (F.length(probe) <= 10)
        & (F.size(tokens) > 0)
        & (F.size(tokens) <= 5)
        & F.forall(tokens, lambda t: F.array_contains(small, t))
    )
    refused = (
        is_blank(q)
        | (F.length(q) > K.GREETING_MAX_CHARS)
        | F.rlike(q, F.lit(r"(?U)\d"))
        | (q.contains("?") & ~F.rlike(low, F.lit(r"(?U)how\s+are\s+you")))
        | F.rlike(low, F.lit(f"(?iU){K.SUBSTANTIVE}"))
    )
    return ~refused & (probe.isin(*K.GREETING_PHRASES) | only_small)
