"""Chat logs: nesting, flattening, role mapping, exports, history index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import canonical_uuid, known_role, micros, role_from_sender, valid_turn
from ..functions.text import is_blank, let, or_none, question_title, strip, text_or_blank
from .dedup import top_per_key
from .ordered import BLOCK, with_next

MESSAGES = "array<struct<role:string,content:string>>"


# --- message arrays (row-local) -------------------------------------------------


def nest_turns(turns: DataFrame, group: str = "conv_id", order: str = "turn") -> DataFrame:
    """Flat turns as message arrays, one row per conversation.

    Blocks of turns are sorted first, each in its own task, so that a long conversation
    meets as few sorted blocks, not as single turns. A conversation is one record, as in
    the files it comes from.
    """
    packed = F.collect_list(F.struct(order, "role", F.col("text").alias("content")))
    block = F.floor(F.col(order) / BLOCK).alias("_block")
    blocks = turns.groupBy(group, block).agg(F.array_sort(packed).alias("_m"))
    whole = blocks.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_block", "_m"))).alias("_all"))
    plain = F.transform(F.flatten("_all._m"), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return whole.select(group, plain.alias("messages"))


def drop_repeats(messages: Column) -> Column:
    """Drop a message equal to the one before it."""

    def same(a: Column, b: Column) -> Column:
        equal = a["role"].eqNullSafe(b["role"]) & a["content"].eqNullSafe(b["content"])
        return F.coalesce(equal, F.lit(False))

    return let(messages, lambda ms: F.filter(ms, lambda m, i: (i == 0) | ~same(F.get(ms, i - 1), m)))


def has_messages(c: Column | str = "messages") -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def flatten_messages(source: Column | str, conversation_id: Column | str, messages: Column | str) -> Column:
    """Plain text of a conversation: a header and ``ROLE: content`` blocks; NULL without a usable message."""
    m = F.col(messages) if isinstance(messages, str) else messages
    usable = F.filter(m, lambda x: ~is_blank(x["content"]))
    blocks = F.transform(
        usable,
        lambda x: F.concat(
            F.upper(F.coalesce(or_none(text_or_blank(x["role"])), F.lit("unknown"))), F.lit(": "), strip(x["content"])
        ),
    )
    header = F.concat(
        F.lit("[source="), text_or_blank(source), F.lit(" conversation_id="), text_or_blank(conversation_id), F.lit("]")
    )
    body = F.concat(header, F.lit("\n\n"), F.array_join(blocks, "\n\n"))
    return F.when(F.coalesce(F.size(blocks) > 0, F.lit(False)), body)


def merge_conversations(*parts: DataFrame) -> DataFrame:
    """All conversations that have messages, missing columns filled with NULL."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.filter(has_messages())


def text_blocks(content: Column) -> Column:
    """Text parts of a structured message, joined by a blank line."""
    texts = F.filter(content, lambda c: (c["type"] == "text") & ~is_blank(c["text"]))
    return strip(F.array_join(F.transform(texts, lambda c: strip(c["text"])), "\n\n"))


def export_messages(responses: Column) -> Column:
    """Messages of a nested export: known roles, non-blank, by time (unreadable times first), repeats dropped."""
    rows = F.transform(
        responses,
        lambda r, i: F.struct(
            micros(r["response"]["create_time"]).alias("at"),
            i.alias("pos"),
            role_from_sender(r["response"]["sender"]).alias("role"),
            strip(r["response"]["message"]).alias("content"),
        ),
    )
    usable = F.filter(rows, lambda m: m["role"].isNotNull() & (m["content"] != ""))
    plain = F.transform(
        F.array_sort(usable), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
    )
    return drop_repeats(plain)


def from_export(export: DataFrame, source: str = "grok") -> DataFrame:
    """Conversations of a nested export (one JSON object per row), empty ones kept for the counters."""
    each = export.select(F.explode("conversations").alias("c")).filter(F.col("c").isNotNull())
    meta = F.col("c.conversation")
    messages = F.coalesce(export_messages(F.col("c.responses")), F.array().cast(MESSAGES))
    return each.select(
        F.lit(source).alias("source"),
        text_or_blank(meta["id"]).alias("conversation_id"),
        text_or_blank(meta["title"]).alias("title"),
        text_or_blank(meta["create_time"]).alias("created_at"),
        messages.alias("messages"),
    )


def from_agent_lines(lines: DataFrame, source: str = "cursor") -> DataFrame:
    """Messages of agent transcripts (``path, conversation_id, line_no, role, message``), one row each."""
    return lines.select(
        F.lit(source).alias("source"),
        "conversation_id",
        "path",
        F.col("line_no").alias("turn"),
        known_role("role").alias("role"),
        text_blocks(F.col("message.content")).alias("text"),
    ).filter(F.col("role").isNotNull() & (F.col("text") != ""))


def conversion_counts(conversations: DataFrame) -> DataFrame:
    return conversations.agg(
        F.count("*").alias("total_conversations"),
        F.count_if(has_messages()).alias("written"),
        F.count_if(~has_messages()).alias("skipped_empty"),
    )


def turn_counts(turns: DataFrame, group: str = "conv_id") -> DataFrame:
    """The counts of ``conversion_counts`` for conversations made of flat turns, without gathering their texts."""
    each = turns.groupBy(group).agg(F.count_if(F.col("role").isNotNull() | F.col("text").isNotNull()).alias("n"))
    return each.agg(
        F.count("*").alias("total_conversations"),
        F.count_if(F.col("n") > 0).alias("written"),
        F.count_if(F.col("n") == 0).alias("skipped_empty"),
    )


# --- turns ----------------------------------------------------------------------


def turn_pairs(turns: DataFrame, group: str = "conv_id", order: str = "turn") -> DataFrame:
    """Question and answer rows: every user turn with the assistant turn right after it."""
    peeked = with_next(turns.select(group, order, "role", "text"), [group], order, ["role", "text"], "_next")
    answer = F.when(F.col("_next.role") == "assistant", F.col("_next.text"))
    return peeked.filter(F.col("role") == "user").select(
        group, order, F.col("text").alias("q"), text_or_blank(answer).alias("a")
    )


def history_messages(pairs: DataFrame, *keep: str) -> DataFrame:
    """Question rows as user and assistant messages; a blank answer shows as ``(no answer)``."""
    shown = F.when(is_blank("a"), F.lit(K.NO_ANSWER)).otherwise(F.col("a"))
    both = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("user").alias("role"), F.col("q").alias("content")),
        F.struct(F.lit(1).alias("ord"), F.lit("assistant").alias("role"), shown.alias("content")),
    )
    return (
        pairs.filter(~(is_blank("q") & is_blank("a")))
        .select(*keep, F.explode(both).alias("_m"))
        .filter((F.col("_m.ord") == 1) | ~is_blank(F.col("_m.content")))
        .select(*keep, "_m.ord", "_m.role", "_m.content")
    )


def recent_messages(turns: DataFrame, group: str = "conv_id", order: str = "turn", n: int = K.HISTORY_CAP) -> DataFrame:
    return top_per_key(turns, [group], [F.desc(order)], n)


# --- history index --------------------------------------------------------------


def _line_no(turns: DataFrame) -> list[str]:
    """The log's line number, which orders turns of one time, where it is known."""
    return ["line_no"] if "line_no" in turns.columns else []


def accepted_turns(turns: DataFrame) -> DataFrame:
    """Turns fit to be stored, trimmed, under the canonical conversation id; a latency over an hour refuses the turn."""
    timely = F.coalesce(F.col("latency_ms") <= K.LATENCY_MAX_MS, F.lit(True))
    return turns.filter(valid_turn("q", "a") & timely).select(
        canonical_uuid("conversation_id").alias("conversation_id"),
        "ts",
        strip("q").alias("q"),
        strip("a").alias("a"),
        F.greatest(F.lit(0).cast("bigint"), F.coalesce("latency_ms", F.lit(0).cast("bigint"))).alias("latency_ms"),
        *_line_no(turns),
    ).filter(F.col("conversation_id").isNotNull())


def upsert_index(index: DataFrame, turns: DataFrame) -> DataFrame:
    """Index after appending turns: time of the latest turn; a title is set once, from the first question.

    Both sides are reduced per id before they meet, so a busy conversation adds one row.
    """
    fresh = turns.groupBy(F.lower("conversation_id").alias("id")).agg(
        F.max("ts").alias("_ts"), F.min_by("q", F.struct("ts", *_line_no(turns))).alias("_q")
    )
    known = index.withColumn("id", F.lower("id"))
    title = strip("title")
    unnamed = F.col("title").isNull() | (title == "") | (title == K.NEW_CHAT_TITLE)
    snippet = question_title("_q")
    return known.join(fresh, "id", "full").select(
        "id",
        F.when(F.col("_ts").isNotNull() & unnamed, F.coalesce(or_none(snippet), F.lit(K.DEFAULT_CHAT_TITLE)))
        .otherwise(F.col("title"))
        .alias("title"),
        F.coalesce("_ts", "updated_ts").alias("updated_ts"),
    )


def compact_index(index: DataFrame, turns: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Index with one row per conversation that has a valid turn; others are dropped.

    The time is the latest of turns, file times (``conversation_id, mtime``) and index
    rows. The title is the first that is not the default one, else the first non-blank.
    ``index`` carries its row order in ``pos``.
    """
    title = strip("title")
    named = (title != "") & (title != K.NEW_CHAT_TITLE)
    rows = (
        index.withColumn("_id", canonical_uuid("id"))
        .filter(F.col("_id").isNotNull())
        .groupBy("_id")
        .agg(
            F.max(F.coalesce("updated_ts", F.lit(0).cast("bigint"))).alias("_index_ts"),
            F.min_by(F.when(named, title), F.when(named, F.col("pos"))).alias("_named"),
            F.min_by(F.when(title != "", title), F.when(title != "", F.col("pos"))).alias("_any"),
        )
    )
    spoken = (
        turns.withColumn("_id", canonical_uuid("conversation_id"))
        .filter(F.col("_id").isNotNull())
        .groupBy("_id")
        .agg(
            F.max(F.coalesce("ts", F.lit(0).cast("bigint"))).alias("_turn_ts"),
            F.bool_or(valid_turn("q", "a")).alias("_valid"),
        )
        .filter("_valid")
    )
    out = spoken.join(rows, "_id", "left")
    latest = [F.col("_turn_ts"), F.coalesce("_index_ts", F.lit(0).cast("bigint"))]
    if files is not None:
        times = files.groupBy(canonical_uuid("conversation_id").alias("_id")).agg(F.max("mtime").alias("_mtime"))
        out = out.join(times, "_id", "left")
        latest.append(F.coalesce("_mtime", F.lit(0).cast("bigint")))
    return out.select(
        F.col("_id").alias("id"),
        F.coalesce("_named", "_any", F.lit(K.DEFAULT_CHAT_TITLE)).alias("title"),
        F.greatest(*latest).alias("updated_ts"),
    )


def list_conversations(index: DataFrame) -> DataFrame:
    """Last row per id wins, newest conversation first."""
    last = (
        index.withColumn("_id", F.lower(strip("id")))
        .filter(canonical_uuid("_id").isNotNull())
        .groupBy("_id")
        .agg(F.max_by(F.struct("title", "updated_ts"), "pos").alias("_r"))
    )
    return last.select(
        F.col("_id").alias("id"),
        F.coalesce(or_none(strip("_r.title")), F.lit(K.DEFAULT_CHAT_TITLE)).alias("title"),
        F.coalesce("_r.updated_ts", F.lit(0).cast("bigint")).alias("updated_ts"),
    ).orderBy(F.desc("updated_ts"), "id")


def new_conversation(spark, title: str = "") -> DataFrame:
    """One new index row with a random id."""
    if len(title or "") > 240:
        raise ValueError("title is longer than 240 characters")
    shown = (title or "").strip() or K.NEW_CHAT_TITLE
    return spark.range(1).select(
        F.uuid().alias("id"), F.lit(shown).alias("title"), F.unix_millis(F.current_timestamp()).alias("updated_ts")
    )


def conversation_messages(turns: DataFrame, conversation_id: str) -> DataFrame:
    """Stored turns of one conversation; an invalid id is refused."""
    import uuid

    wanted = str(uuid.UUID(conversation_id))
    return turns.filter(F.lower("conversation_id") == wanted).orderBy("ts", *_line_no(turns))
