"""Prompt packing and the model stages around retrieval.

Every stage is a column or a small ordered aggregate over a bounded result; the
model itself is passed in (see ``models``). Prompt wording is this library's own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import reply_and_suggestions, salvage_object, starter_questions, weak_reply
from ..functions.scoring import is_small_talk
from ..functions.text import drop_code_fence, is_blank, mask_triple_ids, or_none, sanitize_answer, strip, text_or_blank, truncate
from .mapping import candidate_block

ONLY_EXCERPTS = (
    "Answer from the numbered excerpts alone. Quote the words that support each statement. "
    "If no excerpt answers the question, say that the excerpts do not contain the answer."
)
EXTRACT_FACTS = (
    "List the statements of the excerpt that bear on the question, each with its exact words. "
    "If there are none, reply NOT_RELEVANT."
)
# Fixed replies: their wording is part of the results.
NO_ANSWER_FOUND = "The provided excerpts do not contain information to answer this question."
NO_PASSAGES = "No passages were retrieved for this question. Try Rebuild or rephrase."
GREETING_REPLY = "Hello. Ask about a discourse, a commentary or a theme, or open a citation to read it in full."
CHAT_FALLBACK = "No answer could be formed from the excerpts shown. Try another result or other words."
TOPIC_RULES = (
    "Use only the readings and commentaries below and name their ids. Close with one short question. "
    f"Then, on the last line, write {K.SUGGESTIONS_MARKER} followed by a JSON array of two to four questions."
)
STARTER_RULES = 'Suggest follow-up questions for this search. Reply with JSON only: {"questions": ["...", "..."]}'
MAPPING_RULES = (
    "Choose the canon texts the segment explains. Judge by content, never by numbering, and only among the candidates. "
    "Reply with one JSON object with the fields of the result schema."
)
CHOICE_SCHEMA = (
    "best_canon_ids array<string>, primary_canon_id string, confidence double, is_mixed boolean, needs_review boolean,"
    " evidence_phrases array<string>, reason string, match_type string"
)
KIND_HINTS = {
    "sutta": "Cite as (AN ...): this block holds the reading only.",
    "commentary": "Cite as (cAN ...): this block holds the teacher's commentary only.",
    "chain": "A list of linked topics, not scripture: do not quote it as a reading.",
}
OTHER_HINT = "Cite readings as (AN ...) and commentary as (cAN ...)."


def _dash(c: Column | str) -> Column:
    return F.coalesce(or_none(text_or_blank(c)), F.lit("-"))


def passage(index: Column | str) -> Column:
    """Prompt form of a scripture chunk."""
    kind = F.lower(text_or_blank("kind"))
    hint = F.lit(OTHER_HINT)
    for name, text in KIND_HINTS.items():
        hint = F.when(kind == name, F.lit(text)).otherwise(hint)
    book = strip("book")
    return F.concat(
        F.lit("["), F.col(index) if isinstance(index, str) else index, F.lit(" | "),
        F.when(book != "", F.concat(F.lit("book: "), book, F.lit(" | "))).otherwise(F.lit("")),
        F.lit("suttaid: "), _dash("suttaid"), F.lit(" | commentary_id: "), _dash("commentary_id"),
        F.lit(" | kind: "), _dash("kind"), F.lit("]\n"), hint, F.lit("\n"), text_or_blank("text"),
    )


def excerpt(index: Column | str) -> Column:
    """Prompt form of a transcript chunk."""
    return F.concat(
        F.lit("[Excerpt "), F.col(index) if isinstance(index, str) else index, F.lit(" | source: "), text_or_blank("source"),
        F.lit(" | conv: "), _dash("conversation_id"), F.lit("]\n"), text_or_blank("text"),
    )


def pack(rows: DataFrame, block: Column, order: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Blocks of a bounded result joined by a blank line, in order: ``n, excerpts`` (per group of ``by``)."""
    listed = F.array_sort(F.collect_list(F.struct(order, block.alias("b"))))
    grouped = rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), listed.alias("_l"))
    return grouped.withColumn("excerpts", F.array_join(F.transform("_l", lambda x: x["b"]), "\n\n")).drop("_l")


def question_prompt(question: Column, excerpts: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nExcerpts:\n"), excerpts)


def answer(rows: DataFrame, question: str, generate, block: Column | None = None) -> DataFrame:
    """One reply from a bounded, ranked result; greetings and empty results get their fixed replies."""
    q = F.lit(question)
    packed = pack(rows, excerpt("rank") if block is None else block)
    ask = (F.col("n") > 0) & ~is_small_talk(q)
    reply = generate(F.lit(ONLY_EXCERPTS), F.when(ask, question_prompt(q, F.col("excerpts"))))
    return packed.select(
        F.when(is_small_talk(q), F.lit(GREETING_REPLY))
        .when(F.col("n") == 0, F.lit(NO_PASSAGES))
        .otherwise(sanitize_answer(reply))
        .alias("answer"),
        (~is_small_talk(q)).alias("used_model"),
    )


def relevant(extracted: Column | str) -> Column:
    return ~F.upper(text_or_blank(extracted)).contains("NOT_RELEVANT")


def map_reduce_answer(rows: DataFrame, question: str, generate) -> DataFrame:
    """Facts extracted per chunk in parallel, irrelevant ones dropped, the rest combined in one call."""
    q = F.lit(question)
    notes = rows.withColumn("_x", generate(F.lit(EXTRACT_FACTS), question_prompt(q, excerpt("rank"))))
    note = F.concat(
        F.lit("[From excerpt "), "rank", F.lit(" | source: "), text_or_blank("source"), F.lit("]\n"), text_or_blank("_x")
    )
    packed = pack(notes.filter(relevant("_x")), note)
    reply = generate(F.lit(ONLY_EXCERPTS), F.when(F.col("n") > 0, question_prompt(q, F.col("excerpts"))))
    return packed.select(
        F.when(F.col("n") == 0, F.lit(NO_ANSWER_FOUND)).otherwise(reply).alias("answer"), F.col("n").alias("notes")
    )


# --- topic chat ------------------------------------------------------------------


def segment_block(title: Column, sutta: Column, commentary: Column, limit: int) -> Column:
    return F.concat(
        F.lit("<"), title, F.lit(">\nReading: "), truncate(sutta, limit), F.lit("\nExplained: "), truncate(commentary, limit), F.lit("\n</>")
    )


def topic_prompt(hits: DataFrame) -> DataFrame:
    """System prompt from the hits of a topic search: the first in full length, up to three related ones at half."""
    filled = hits.filter(F.coalesce(F.length("sutta"), F.lit(0)) + F.coalesce(F.length("commentary"), F.lit(0)) > 0)
    sid = F.coalesce(or_none(text_or_blank("sutta_id")), F.lit("?"))
    first = F.concat(F.lit("best match id="), sid)
    related = F.concat(F.lit("also fits no="), (F.col("rank") - 1).cast("string"), F.lit(" id="), sid)
    block = F.when(F.col("rank") == 1, segment_block(first, F.col("sutta"), F.col("commentary"), K.MAX_CONTEXT_CHARS)).otherwise(
        segment_block(related, F.col("sutta"), F.col("commentary"), K.MAX_CONTEXT_CHARS // 2)
    )
    packed = pack(filled.filter(F.col("rank") <= 4), block)
    return packed.select(F.concat(F.lit(TOPIC_RULES + "\n\n"), "excerpts").alias("system"))


def chat_reply(prompts: DataFrame, generate, system: str = "system", user: str = "user") -> DataFrame:
    """Reply with suggestions; a weak reply is asked for once more and the better one kept."""
    first = prompts.withColumn("_a", reply_and_suggestions(generate(F.col(system), F.col(user))))
    strict = F.concat(F.lit("The last reply was too short. Write at least three sentences.\n\n"), F.col(system))
    weak = weak_reply("_a.reply")
    second = first.withColumn("_b", reply_and_suggestions(generate(strict, F.when(weak, F.col(user)))))
    better = weak & (
        ~weak_reply("_b.reply") | (F.length(text_or_blank("_b.reply")) > F.length(text_or_blank("_a.reply")))
    )
    chosen = second.withColumn("_c", F.when(better, F.col("_b")).otherwise(F.col("_a")))
    return chosen.withColumns(
        {
            "reply": F.when(is_blank("_c.reply"), F.lit(CHAT_FALLBACK)).otherwise(F.col("_c.reply")),
            "suggestions": F.col("_c.suggestions"),
        }
    ).drop("_a", "_b", "_c")


def starter_prompt(query: str, sutta_ids: list[str], earlier: list[str]) -> str:
    """What the reader looked for, saw and asked before, as JSON, for the follow-up questions."""
    seen = list(filter(None, map(str.strip, sutta_ids[:8])))
    asked = list(filter(None, map(str.strip, earlier)))[-5:]
    facts = {"looked_for": query.strip(), "saw": seen, "asked_before": [p[:500] for p in asked]}
    return json.dumps({k: v for k, v in facts.items() if v}, ensure_ascii=False)


def starters(prompts: DataFrame, generate, user: str = "user") -> DataFrame:
    return prompts.withColumn("questions", starter_questions(generate(F.lit(STARTER_RULES), F.col(user))))


# --- mapping choice ----------------------------------------------------------------


def choose_canon(units: DataFrame, canon: DataFrame, scores: DataFrame, generate) -> DataFrame:
    """Ask for the canon texts of every unit with enough candidates; others get an empty unknown choice.

    Unit text goes out with its three-part ids masked and cut.
    """
    blocks = candidate_block(canon, scores)
    enough = scores.groupBy("unit_id").agg(F.count("*").alias("n_candidates"))
    asked = units.join(blocks, "unit_id", "left").join(enough, "unit_id", "left")
    prompt = F.concat(F.lit("Segment:\n"), mask_triple_ids("text"), F.lit("\n\nCandidates:\n"), F.col("block"))
    ready = F.coalesce(F.col("n_candidates") >= K.MIN_CANDIDATES, F.lit(False))
    raw = generate(F.lit(MAPPING_RULES), F.when(ready, prompt))
    parsed = asked.withColumn("_raw", raw).withColumn("_j", salvage_object(drop_code_fence("_raw"), CHOICE_SCHEMA))
    best = F.coalesce("_j.best_canon_ids", F.array().cast("array<string>"))
    # a claimed match that names no text is none, and a reply that can't be read is looked at by a person
    empty = F.coalesce(F.col("_j.match_type").isin("exact", "probable", "mixed"), F.lit(False)) & (F.size(best) == 0)
    unread = ready & F.col("_j").isNull()
    said = text_or_blank("_j.reason")
    reason = (
        F.when(~ready, F.lit("No sufficient candidates retrieved from canon."))
        .when(unread, F.lit("The reply could not be read."))
        .when(empty, strip(F.concat(said, F.lit(" Empty best_canon_ids invalidated."))))
        .otherwise(said)
    )
    return parsed.select(
        *units.columns,
        best.alias("best_canon_ids"),
        "_j.primary_canon_id",
        F.coalesce("_j.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("_j.is_mixed", F.lit(False)).alias("is_mixed"),
        F.when(empty | unread, F.lit(True)).otherwise(F.coalesce("_j.needs_review", ~ready)).alias("needs_review"),
        F.coalesce("_j.evidence_phrases", F.array().cast("array<string>")).alias("evidence_phrases"),
        reason.alias("reason"),
        F.when(empty, F.lit("unknown")).otherwise(F.coalesce("_j.match_type", F.lit("unknown"))).alias("match_type"),
    )


def sub_queries(reply: Column | str, question: Column | str) -> Column:
    """Search queries from a decomposition reply, one per line; the question itself when none is usable."""
    lines = F.split(text_or_blank(reply), r"\r\n|[\n\r]")
    bare = F.transform(lines, lambda x: F.btrim(strip(x), F.lit("-•*0123456789.")))
    kept = F.slice(F.filter(bare, lambda x: F.length(x) >= 5), 1, 3)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.col(question) if isinstance(question, str) else question))
