"""Chat-log queries over the given conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import canonical_uuid, role_from_sender, show_millis, valid_turn, weak_reply
from ..functions.scoring import is_small_talk
from ..functions.text import escape_html, question_title
from ..operators import conversations as C
from ..operators.ordered import drop_consecutive
from ..storage import shared_folder, stored
from ..streaming.index import feedback_over_time, merge_batch, stored_index
from .registry import query, table
from .search import sql_quote
from .standins import sql_squeeze, sql_strip


def nested(spark: SparkSession, sf: str) -> DataFrame:
    n = C.nest_turns(table(spark, sf, "conversations"))
    return n.select(
        F.lit("chat").alias("source"), F.col("conv_id").cast("string").alias("conversation_id"), "messages"
    )


@query(
    "conversation_flatten",
    f"""SELECT conv_id::VARCHAR AS conversation_id,
    '[source=chat conversation_id=' || conv_id || ']' || chr(10) || chr(10) ||
      string_agg(upper(role) || ': ' || {sql_strip('text')}, chr(10) || chr(10) ORDER BY turn) AS text
    FROM conversations WHERE {sql_strip('text')} <> '' GROUP BY conv_id""",
)
def conversation_flatten(spark, sf):
    text = C.flatten_messages("source", "conversation_id", "messages")
    return nested(spark, sf).select("conversation_id", text.alias("text")).filter("text IS NOT NULL")


@query(
    "conversation_dedup_consecutive",
    """SELECT conv_id, pos, role, text FROM (SELECT *, lag(role) OVER w AS pr, lag(text) OVER w AS pt FROM (
      SELECT conv_id, turn * 2 + c AS pos, role, text FROM conversations, (VALUES (0), (1)) t(c))
      WINDOW w AS (PARTITION BY conv_id ORDER BY pos))
    WHERE NOT (pr IS NOT DISTINCT FROM role AND pt IS NOT DISTINCT FROM text)""",
)
def conversation_dedup_consecutive(spark, sf):
    """Every turn is written twice, as retries do; the repeats go again."""
    copies = table(spark, sf, "conversations").withColumn("_c", F.explode(F.array(F.lit(0), F.lit(1))))
    doubled = copies.select("conv_id", (F.col("turn") * 2 + F.col("_c")).alias("pos"), "role", "text")
    return drop_consecutive(doubled, ["conv_id"], "pos", ["role", "text"])


@query(
    "conversation_merge",
    """SELECT source, conversation_id, title, n_messages, first_content FROM (
      SELECT CASE role WHEN 'user' THEN 'questions' WHEN 'assistant' THEN 'answers' ELSE 'notes' END AS source,
        conv_id::VARCHAR AS conversation_id,
        CASE WHEN role = 'user' THEN 'asked' ELSE '' END AS title, count(*)::INT AS n_messages,
        arg_min(text, turn) AS first_content
      FROM conversations GROUP BY ALL)""",
)
def conversation_merge(spark, sf):
    c = table(spark, sf, "conversations")

    def part(rows, source):
        return C.nest_turns(rows).select(
            F.lit(source).alias("source"), F.col("conv_id").cast("string").alias("conversation_id"), "messages"
        )

    merged = C.merge_conversations(
        part(c.filter("role = 'user'"), "questions").withColumn("title", F.lit("asked")),
        part(c.filter("role = 'assistant'"), "answers"),
        part(c.filter("role NOT IN ('user', 'assistant')"), "notes"),
    )
    return merged.select(
        "source", "conversation_id", F.coalesce("title", F.lit("")).alias("title"),
        F.size("messages").alias("n_messages"), F.get("messages", F.lit(0))["content"].alias("first_content"),
    )


@query(
    "conversation_role_map",
    """SELECT conv_id, turn, CASE lower(trim(sender)) WHEN 'human' THEN 'user' WHEN 'user' THEN 'user'
      WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' ELSE '(dropped)' END AS role FROM (
      SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN ' Human ' WHEN turn % 3 = 1 THEN upper(role) ELSE 'bot' END AS sender
      FROM conversations)""",
)
def conversation_role_map(spark, sf):
    sender = (
        F.when(F.col("turn") % 3 == 0, F.lit(" Human ")).when(F.col("turn") % 3 == 1, F.upper("role")).otherwise("bot")
    )
    role = F.coalesce(role_from_sender(sender), F.lit("(dropped)"))
    return table(spark, sf, "conversations").select("conv_id", "turn", role.alias("role"))


@query(
    "conversation_drop_repeats_nested",
    """SELECT conv_id, string_agg(role || ':' || text, '|' ORDER BY pos) AS body FROM (
      SELECT *, lag(role) OVER w AS pr, lag(text) OVER w AS pt FROM (
      SELECT conv_id, turn * 2 + c AS pos, role, text FROM conversations, (VALUES (0), (1)) t(c))
      WINDOW w AS (PARTITION BY conv_id ORDER BY pos))
    WHERE NOT (pr IS NOT DISTINCT FROM role AND pt IS NOT DISTINCT FROM text) GROUP BY ALL""",
)
def conversation_drop_repeats_nested(spark, sf):
    """Every turn is written twice; the repeats go before the message arrays are made, and what is left inside them."""
    twice = table(spark, sf, "conversations").withColumn("_c", F.explode(F.array(F.lit(0), F.lit(1))))
    flat = drop_consecutive(twice.withColumn("turn", F.col("turn") * 2 + F.col("_c")), ["conv_id"], "turn", ["role", "text"])
    kept = C.nest_turns(flat).withColumn("messages", C.drop_repeats(F.col("messages")))
    body = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return kept.select("conv_id", body.alias("body"))


PAIRS_SQL = """pairs AS (SELECT conv_id, turn, text AS q, CASE WHEN nr = 'assistant' THEN nt ELSE '' END AS a FROM (
    SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user')"""


@query("turn_pairs", f"WITH {PAIRS_SQL} SELECT * FROM pairs")
def turn_pairs(spark, sf):
    return C.turn_pairs(table(spark, sf, "conversations"))


@query(
    "history_messages",
    f"""WITH {PAIRS_SQL} SELECT conv_id, turn, 0 AS ord, 'user' AS role, q AS content FROM pairs WHERE {sql_strip('q')} <> ''
    UNION ALL SELECT conv_id, turn, 1, 'assistant', CASE WHEN {sql_strip('a')} = '' THEN '(no answer)' ELSE a END FROM pairs
    WHERE {sql_strip('q')} <> '' OR {sql_strip('a')} <> ''""",
)
def history_messages(spark, sf):
    return C.history_messages(C.turn_pairs(table(spark, sf, "conversations")), "conv_id", "turn")


@query(
    "recent_messages",
    """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
    FROM conversations) WHERE rn <= 3""",
)
def recent_messages(spark, sf):
    return C.recent_messages(table(spark, sf, "conversations"), n=3).select("conv_id", "turn", "role")


#: Phrases that every conversation's turns are tried with besides their own text.
TRIED = ["Hello There!!", " thanks  ", "how are you?", "whats up", "ok, thanks a lot", "What is the path?", "an 4.12"]


@query(
    "greeting_classifier",
    f"""WITH said AS (
      SELECT conv_id, turn, -1 AS tried, text AS v FROM conversations
      UNION ALL SELECT conv_id, turn, i, p || CASE WHEN i = 1 THEN role ELSE '' END FROM conversations,
        (VALUES {', '.join(f"({i}, {sql_quote(t)})" for i, t in enumerate(TRIED))}) AS t(i, p)
      UNION ALL SELECT conv_id, turn, {len(TRIED)}, text || ' hi' FROM conversations),
    base AS (SELECT conv_id, turn, tried, {sql_strip('v')} AS q FROM said),
    probe AS (SELECT *, lower(q) AS low, regexp_replace(regexp_replace(lower(q), '[!?.]+$', ''), '[ \\t\\n\\r]+', ' ', 'g') AS p FROM base),
    tok AS (SELECT *, regexp_extract_all(p, '[a-z'']+') AS t FROM probe)
    SELECT conv_id, turn, tried, NOT (q = '' OR length(q) > 140 OR regexp_matches(q, '[0-9]')
        OR (contains(q, '?') AND NOT regexp_matches(low, 'how\\s+are\\s+you'))
        OR regexp_matches(low, {sql_quote(K.SUBSTANTIVE)}))
      AND (list_contains([{', '.join(sql_quote(x) for x in K.GREETING_PHRASES)}], p)
        OR (length(p) <= 10 AND len(t) BETWEEN 1 AND 5
          AND len(list_filter(t, lambda x: NOT list_contains([{', '.join(sql_quote(x) for x in K.GREETING_TOKENS)}], x))) = 0)) AS small_talk
    FROM tok""",
)
def greeting_classifier(spark, sf):
    """Every turn's whole text, the same with a greeting behind it, and fixed phrases."""
    texts = [F.col("text"), *[F.concat(F.lit(t), "role") if i == 1 else F.lit(t) for i, t in enumerate(TRIED)], F.concat("text", F.lit(" hi"))]
    said = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.array(*texts)).alias("tried", "said"))
    return said.select("conv_id", "turn", (F.col("tried") - 1).alias("tried"), is_small_talk("said").alias("small_talk"))


@query(
    "question_titles",
    f"""SELECT conv_id, turn, left({sql_squeeze('text')}, 56) || CASE WHEN length({sql_squeeze('text')}) > 56 THEN '…' ELSE '' END AS title,
    length({sql_strip('text')}) < 42 AS weak FROM conversations""",
)
def question_titles(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", question_title("text").alias("title"), weak_reply("text").alias("weak")
    )


# --- history index: users are conversations, events are turns ---------------------

UUID_SQL = "'00000000-0000-4000-8000-' || lpad(user_id::VARCHAR, 12, '0')"
TURNS_SQL = f"""turns AS (SELECT {UUID_SQL} AS id, (epoch_us(ts) // 1000) AS ts, event_type AS q,
    CASE WHEN event_type = 'error' THEN '(no answer)' WHEN value < 0.5 THEN ' ' ELSE 'a' || round(value, 2)::VARCHAR END AS a,
    event_id FROM events)"""
INDEX_SQL = f"""idx AS (SELECT upper({UUID_SQL}) AS id, event_id AS pos, (epoch_us(ts) // 1000) + 5000 AS updated_ts,
    CASE event_type WHEN 'click' THEN 'New chat' WHEN 'view' THEN ' ' ELSE event_type || ' ' || event_id END AS title
    FROM events WHERE event_type <> 'signup' UNION ALL
    SELECT 'not-an-id', -1, 1, 'x')"""


def turn_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    uid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("user_id").cast("string"), 12, "0"))
    a = (
        F.when(F.col("event_type") == "error", K.NO_ANSWER).when(F.col("value") < 0.5, " ")
        .otherwise(F.concat(F.lit("a"), F.round("value", 2).cast("string")))
    )
    return e.select(
        uid.alias("conversation_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("q"), a.alias("a"),
        F.lit(None).cast("bigint").alias("latency_ms"), "event_id",
    )


def index_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = turn_log(spark, sf).filter("q <> 'signup'")
    title = (
        F.when(F.col("q") == "click", K.NEW_CHAT_TITLE).when(F.col("q") == "view", " ")
        .otherwise(F.concat("q", F.lit(" "), F.col("event_id").cast("string")))
    )
    rows = t.select(
        F.upper("conversation_id").alias("id"), F.col("event_id").alias("pos"), (F.col("ts") + 5000).alias("updated_ts"),
        title.alias("title"),
    )
    stray = spark.range(1).select(
        F.lit("not-an-id").alias("id"), F.lit(-1).cast("bigint").alias("pos"), F.lit(1).cast("bigint").alias("updated_ts"),
        F.lit("x").alias("title"),
    )
    return rows.unionByName(stray)


@query(
    "conversation_index_compact",
    f"""WITH {TURNS_SQL}, {INDEX_SQL}, v AS (SELECT id, max(ts) AS ts FROM turns GROUP BY id
      HAVING bool_or(trim(q) <> '' AND trim(a) <> '' AND trim(a) <> '(no answer)')),
    i AS (SELECT lower(id) AS id, max(updated_ts) AS ts, arg_min(trim(title), pos) FILTER (trim(title) NOT IN ('', 'New chat')) AS named,
      arg_min(trim(title), pos) FILTER (trim(title) <> '') AS any_title FROM idx WHERE length(id) = 36 GROUP BY lower(id))
    SELECT v.id, coalesce(named, any_title, 'Chat') AS title, greatest(v.ts, coalesce(i.ts, 0)) AS updated_ts FROM v LEFT JOIN i ON i.id = v.id""",
)
def conversation_index_compact(spark, sf):
    return C.compact_index(index_rows(spark, sf), turn_log(spark, sf))


@query(
    "conversation_list",
    f"""WITH {INDEX_SQL} SELECT lower(id) AS id, coalesce(nullif(trim(arg_max(title, pos)), ''), 'Chat') AS title,
    arg_max(updated_ts, pos) AS updated_ts FROM idx WHERE length(id) = 36 GROUP BY lower(id)""",
)
def conversation_list(spark, sf):
    return C.list_conversations(index_rows(spark, sf))


KNOWN_SQL = f"""known AS (SELECT DISTINCT upper({UUID_SQL}) AS id, user_id,
    CASE user_id % 4 WHEN 0 THEN 'New chat' WHEN 1 THEN ' ' ELSE 'Kept ' || user_id END AS title, 7::BIGINT AS updated_ts
    FROM events WHERE user_id % 3 <> 1 UNION ALL SELECT '00000000-0000-4000-8000-zzzzzzzzzzzz', -1, 'Gone', 9::BIGINT)"""


@query(
    "history_index_upsert",
    f"""WITH {TURNS_SQL}, {KNOWN_SQL}, ok AS (SELECT * FROM turns WHERE trim(q) <> '' AND trim(a) <> '' AND trim(a) <> '(no answer)'),
    f AS (SELECT id, max(ts) AS ts, min((lpad(ts::VARCHAR, 20, '0') || lpad(event_id::VARCHAR, 20, '0') || q)) AS q FROM ok GROUP BY id)
    SELECT coalesce(lower(k.id), f.id) AS id,
      CASE WHEN f.id IS NOT NULL AND coalesce(trim(k.title), '') IN ('', 'New chat') THEN substr(f.q, 41) ELSE k.title END AS title,
      coalesce(f.ts, k.updated_ts) AS updated_ts
    FROM known k FULL JOIN f ON lower(k.id) = f.id""",
)
def history_index_upsert(spark, sf):
    """Turns appended to an index that holds two users in three: kept titles, blank ones, ``New chat``, one without turns."""
    turns = C.accepted_turns(turn_log(spark, sf).withColumnRenamed("event_id", "line_no"))
    n = F.col("user_id")
    title = F.when(n % 4 == 0, K.NEW_CHAT_TITLE).when(n % 4 == 1, " ").otherwise(F.concat(F.lit("Kept "), n.cast("string")))
    uid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0"))
    known = table(spark, sf, "events").filter("user_id % 3 <> 1").select("user_id").distinct()
    known = known.select(F.upper(uid).alias("id"), title.alias("title"), F.lit(7).cast("bigint").alias("updated_ts"))
    gone = spark.range(1).select(
        F.lit("00000000-0000-4000-8000-zzzzzzzzzzzz").alias("id"), F.lit("Gone").alias("title"), F.lit(9).cast("bigint").alias("updated_ts")
    )
    return C.upsert_index(known.unionByName(gone), turns)


@query(
    "live_index_batches",
    f"""WITH {TURNS_SQL}, ok AS (SELECT * FROM turns WHERE trim(q) <> '' AND trim(a) <> '' AND trim(a) <> '(no answer)')
    SELECT id, substr(min(lpad(ts::VARCHAR, 20, '0') || q), 21) AS title, max(ts) AS updated_ts FROM ok GROUP BY id""",
)
def live_index_batches(spark, sf):
    """The log merged into the stored index quarter by quarter, one quarter twice, as the stream's batches are."""
    log = turn_log(spark, sf)
    turns = C.accepted_turns(log).select(F.col("conversation_id").alias("id"), "ts", "q")
    cuts = log.approxQuantile("ts", [0.25, 0.5, 0.75], 0.01) or [0.0]
    folder = shared_folder(spark, "live-index")
    part = sum((F.col("ts") >= c).cast("int") for c in cuts)
    # the log is read once: a row per conversation and quarter is what a batch brings
    each = turns.groupBy(part.alias("part"), "id").agg(F.min(F.struct("ts", "q")).alias("f"), F.max("ts").alias("updated_ts"))
    each = stored(each.select("part", "id", F.col("f.ts").alias("first_ts"), F.col("f.q").alias("q"), "updated_ts"), "live-batches")
    for number in [*range(len(cuts) + 1), 1]:
        merge_batch(each.where(F.col("part") == number).drop("part"), number, folder)
    return stored_index(spark, folder)


@query(
    "feedback_windows",
    """SELECT (epoch_us(ts) // 1000 // 3600000) * 3600000 AS start,
    CASE WHEN value < 30 THEN -1 WHEN value < 60 THEN 0 ELSE 1 END AS rating, count(*) AS n FROM events GROUP BY ALL""",
)
def feedback_windows(spark, sf):
    """Ratings per hour of event time: the batch twin of the stream's windows."""
    rating = F.when(F.col("value") < 30, -1).when(F.col("value") < 60, 0).otherwise(1)
    rows = table(spark, sf, "events").select(rating.alias("rating"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"))
    return feedback_over_time(rows)


@query(
    "append_log_counts",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, sum((props->>'$.k')::INT)::BIGINT AS k_total,
    sum(CASE WHEN value >= 50 THEN 1 ELSE -1 END)::BIGINT AS rating FROM events GROUP BY ALL""",
)
def append_log_counts(spark, sf):
    e = table(spark, sf, "events")
    k = F.from_json("props", "k int")["k"]
    day = show_millis(F.unix_millis(F.col("ts").cast("timestamp")), "yyyy-MM-dd")
    return e.groupBy(day.alias("day"), "event_type").agg(
        F.count("*").alias("n"), F.sum(k.cast("bigint")).alias("k_total"),
        F.sum(F.when(F.col("value") >= 50, 1).otherwise(-1).cast("bigint")).alias("rating"),
    )


@query(
    "uuid_and_turn_checks",
    """SELECT event_id, user_id % 2 = 0 AS id_ok, event_type <> 'error' AND value >= 0.5 AS turn_ok FROM events""",
)
def uuid_and_turn_checks(spark, sf):
    t = turn_log(spark, sf)
    n = F.substring("conversation_id", -12, 12).cast("bigint")
    odd = F.concat(F.lit("x"), "conversation_id")
    shown = F.when(n % 2 == 0, F.concat(F.lit("{"), F.upper("conversation_id"), F.lit("}"))).otherwise(odd)
    return t.select(
        "event_id", canonical_uuid(shown).isNotNull().alias("id_ok"), valid_turn("q", "a").alias("turn_ok")
    )


@query(
    "html_escaped",
    """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped_md5
    FROM pages""",
)
def html_escaped(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(escape_html("html")).alias("escaped_md5"))


@query(
    "conversation_counts",
    """SELECT count(*) AS total_conversations, count(*) AS written, 0::BIGINT AS skipped_empty FROM (SELECT DISTINCT conv_id FROM conversations)""",
)
def conversation_counts(spark, sf):
    return C.turn_counts(table(spark, sf, "conversations").select("conv_id", "role", "text"))
