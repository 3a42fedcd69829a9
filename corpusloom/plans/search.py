"""Lexical and topic search over the given documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scoring import Topic, lexical_score
from ..functions.text import loose_query, query_tokens, search_terms, squeeze_query
from ..operators import records as R
from ..operators import topic as T
from .registry import query, table
from .standins import RECORDS_SQL, records, sql_norm, sql_squeeze, sql_strip

LEXICAL_QUERY = "where is the thand of ration"
PHRASE_QUERY = "and the"
TOPIC_CATEGORY = "en src1"
TOPIC_WORDS = "the and of"


def sql_quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lexical_sql(text: str, q: str) -> str:
    """SQL form of the lexical score."""
    low = f"lower({text})"
    probe = q.strip().lower()
    phrase = f"CASE WHEN contains({low}, {sql_quote(probe)}) THEN 100 ELSE 0 END" if len(probe) <= 60 else "0"
    toks = query_tokens(q)
    if not toks:
        return phrase
    matched = " + ".join(f"contains({low}, {sql_quote(t)})::INT" for t in toks)
    ratio = f"(({matched})::DOUBLE / {len(toks)})"
    return f"({phrase} + CASE WHEN {ratio} >= 0.6 THEN floor({ratio} * 20)::INT ELSE 0 END)"


def topic_score_sql(q: str) -> str:
    """``scored`` CTE: the topic score of every record."""
    norm = squeeze_query(q)
    loose = loose_query(norm)
    n, qn, ql = len(norm), sql_quote(norm), sql_quote(loose)

    def lo(e):
        return f"trim(replace({e}, '-', ' '), ' ')"

    def inside(e):
        return f"(contains({e}, {qn}) OR contains({lo(e)}, {ql}))"

    def covers(e):
        return f"(contains({qn}, {e}) OR contains({ql}, {lo(e)}))"

    def same(e):
        return f"({e} = {qn} OR {lo(e)} = {ql})"

    category = f"CASE WHEN cat = '' THEN 0 WHEN {same('cat')} THEN 130"
    if n >= 5:
        category += f" WHEN {inside('cat')} OR {covers('cat')} THEN 70"
    category += " ELSE 0 END"
    blob = f"CASE WHEN blob <> '' AND {inside('blob')} THEN 85 ELSE 0 END" if n >= 6 else "0"
    item = f"CASE WHEN i = '' THEN 0.0::DOUBLE WHEN {same('i')} THEN 110.0"
    if n >= 5:
        item += f" WHEN {inside('i')} THEN 50.0"
    item += f" WHEN length(i) >= 8 AND {covers('i')} THEN 37.5 ELSE 0.0 END"
    lead = f"CASE WHEN {inside('lead')} THEN TRUE ELSE FALSE END" if n >= 12 else "FALSE"
    text = f"CASE WHEN {lead} THEN 320"
    if n >= 10:
        text += f" WHEN {inside('sut')} THEN 95"
    elif n >= 6:
        text += f" WHEN {inside('sut')} THEN 72"
    text += " ELSE 0 END"
    if n >= 10:
        text += f" + CASE WHEN {inside('com')} THEN 38 ELSE 0 END"
    parts = []
    for tok in Topic(q).tokens:
        t = squeeze_query(tok)
        for col, weight in (("chn", 3), ("com", 1), ("sut", 1)):
            parts.append(f"{weight} * ((length({col}) - length(replace({col}, {sql_quote(t)}, ''))) // {len(t)})")
    tokens = " + ".join(parts)
    return f"""{RECORDS_SQL}, prep AS (
      SELECT *, {sql_norm('sutta')} AS sut, {sql_norm('commentary')} AS com,
        {sql_norm("array_to_string(items, ' ')")} AS chn, {sql_norm('category')} AS cat,
        list_transform(coalesce(items, []), lambda x: {sql_norm('x')}) AS norms,
        {sql_norm('substring(sutta, 1, 260)')} AS lead
      FROM records), prep2 AS (
      SELECT *, {sql_squeeze("cat || ' ' || array_to_string(norms, ' ')")} AS blob FROM prep), parts AS (
      SELECT *, ({text} + {tokens})::DOUBLE AS lex,
        ({category} + {blob})::DOUBLE + list_sum(list_concat([0.0::DOUBLE], list_transform(norms, lambda i: {item}))) AS bonus,
        cat <> '' AND {same('cat')} AS category_match, {lead} AS led
      FROM prep2), scored AS (
      SELECT *, bonus * 1000 + CASE WHEN (items IS NULL OR len(items) = 0) AND lex > 0 AND NOT led
        THEN lex * 0.82::DOUBLE ELSE lex END AS score FROM parts)"""


def topic_top_sql(q: str, k: int) -> str:
    return f"""WITH {topic_score_sql(q)}, best AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sutta_id
        ORDER BY category_match DESC, score DESC, pos) AS rn FROM scored WHERE score > 0) WHERE rn = 1),
      top AS (SELECT * FROM best ORDER BY category_match DESC, score DESC, pos LIMIT {k})"""


TITLE_SQL = """CASE WHEN NOT chained THEN 'Chain' WHEN coalesce(category, '') <> '' THEN trim(replace(category, '_', ' '))
    WHEN len(items) > 0 THEN left(trim(items[1]), 80) || CASE WHEN length(trim(items[1])) > 80 THEN '…' ELSE '' END
    ELSE 'Chain' END"""


@query(
    "lexical_search_topk",
    f"""SELECT doc_id, source, {lexical_sql('text', LEXICAL_QUERY)} AS lexical FROM documents
    ORDER BY lexical DESC, doc_id LIMIT 20""",
)
def lexical_search_topk(spark, sf):
    d = table(spark, sf, "documents")
    return (
        d.select("doc_id", "source", lexical_score("text", LEXICAL_QUERY).alias("lexical"))
        .orderBy(F.desc("lexical"), "doc_id")
        .limit(20)
    )


@query(
    "lexical_phrase_scores",
    f"""SELECT doc_id, {lexical_sql('text', PHRASE_QUERY)} AS lexical FROM documents""",
)
def lexical_phrase_scores(spark, sf):
    return table(spark, sf, "documents").select("doc_id", lexical_score("text", PHRASE_QUERY).alias("lexical"))


def _hits_sql(q: str, k: int) -> str:
    return topic_top_sql(q, k) + f"""
      SELECT sutta_id, {TITLE_SQL} AS title, (split_part(sutta_id, '.', 1))::INT AS book, sutta,
        commentary, category_match, round(score, 6) AS score, pos FROM top"""


def _hits(spark, sf, q, k):
    hits = T.to_hits(T.topic_hits(records(spark, sf), q, k))
    return hits.withColumn("score", F.round("score", 6)).drop("chain")


@query("topic_search_category", _hits_sql(TOPIC_CATEGORY, 5))
def topic_search_category(spark, sf):
    return _hits(spark, sf, TOPIC_CATEGORY, 5)


@query("topic_search_words", _hits_sql(TOPIC_WORDS, 10))
def topic_search_words(spark, sf):
    return _hits(spark, sf, TOPIC_WORDS, 10)


@query(
    "topic_scores",
    f"WITH {topic_score_sql('erthand the eron')} SELECT pos, category_match, round(score, 6) AS score FROM scored WHERE score > 0",
)
def topic_scores(spark, sf):
    scored = T.score_rows(records(spark, sf), "erthand the eron").filter("score > 0")
    return scored.select("pos", "category_match", F.round("score", 6).alias("score"))


@query(
    "topic_summary",
    topic_top_sql(TOPIC_CATEGORY, 5)
    + f""", cats AS (SELECT category, min(o) AS o FROM (
        SELECT category, row_number() OVER (ORDER BY category_match DESC, score DESC, pos) AS o FROM top
        WHERE category IS NOT NULL) GROUP BY category)
    SELECT 'BOT: {TOPIC_CATEGORY} (' || coalesce(string_agg(category, ', ' ORDER BY o), 'no chain tags') || ')' AS bot_summary
    FROM (SELECT * FROM cats ORDER BY o LIMIT 5)""",
)
def topic_summary(spark, sf):
    return T.topic_summary(T.topic_hits(records(spark, sf), TOPIC_CATEGORY, 5), TOPIC_CATEGORY)


def items_of(spark, sf):
    return R.to_items(records(spark, sf), "an1")


ITEMS_SQL = f"""{RECORDS_SQL}, items AS (SELECT pos, suttaid, {sql_strip('sutta')} AS sutta,
    {sql_strip('commentary')} AS commentry, 'c' || suttaid AS commentary_id, chained, items AS chain_items, category,
    is_ordered FROM records WHERE {sql_strip('sutta')} <> '')"""

CHAIN_JSON_SQL = """CASE WHEN chained THEN '{"items": [' || array_to_string(list_transform(chain_items,
      lambda x: to_json(x)::VARCHAR), ', ') || '], "count": ' || len(chain_items)::VARCHAR || ', "is_ordered": '
      || CASE WHEN is_ordered THEN 'true' ELSE 'false' END || ', "category": "' || category || '"}' ELSE '' END"""

TITLE72_SQL = f"""left({sql_squeeze('sutta')}, 72) || CASE WHEN length({sql_squeeze('sutta')}) > 72 THEN '…' ELSE '' END"""


@query(
    "substring_search_items",
    f"""WITH {ITEMS_SQL} SELECT suttaid, {TITLE72_SQL} AS title, commentry <> '' AS has_commentary FROM items
    WHERE contains(lower(suttaid || chr(10) || sutta || chr(10) || commentry || chr(10) || commentary_id || chr(10)
      || {CHAIN_JSON_SQL}), '"is_ordered": true, "category": "en-src1')""",
)
def substring_search_items(spark, sf):
    hits = R.search_items(items_of(spark, sf), '"is_ordered": TRUE, "category": "en-src1')
    return R.item_summaries(hits)


@query(
    "item_summaries",
    f"WITH {ITEMS_SQL} SELECT suttaid, {TITLE72_SQL} AS title, commentry <> '' AS has_commentary FROM items",
)
def item_summaries(spark, sf):
    return R.item_summaries(items_of(spark, sf))


@query(
    "item_by_commentary_id",
    f"""WITH {ITEMS_SQL} SELECT pos, suttaid, sutta, commentry, commentary_id FROM items
    WHERE commentary_id = 'cAN 3.7' ORDER BY pos LIMIT 1""",
)
def item_by_commentary_id(spark, sf):
    found = R.find_item(items_of(spark, sf), "commentary_id", " cAN 3.7 ")
    return found.select("pos", "suttaid", "sutta", "commentry", "commentary_id")


@query(
    "merge_items_priority",
    f"""WITH {RECORDS_SQL}, a AS (SELECT 'an1' AS book, pos, suttaid FROM records WHERE lang = 'en' AND {sql_strip('sutta')} <> ''),
    b AS (SELECT 'an2' AS book, pos, 'AN ' || sutta_id AS suttaid,
        row_number() OVER (PARTITION BY sutta_id ORDER BY pos) AS rn
      FROM records WHERE lang <> 'en' AND {sql_strip('sutta')} <> '')
    SELECT * FROM a UNION ALL SELECT book, pos, suttaid FROM b WHERE rn = 1 AND suttaid NOT IN (SELECT suttaid FROM a)""",
)
def merge_items_priority(spark, sf):
    r = records(spark, sf)
    first = R.to_items(r.filter("lang = 'en'"), "an1")
    second = R.to_items(r.filter("lang <> 'en'"), "an2")
    return R.merge_items(first, second).select("book", "pos", "suttaid")


def terms_sql(q: str, limit: int) -> str:
    return "[" + ", ".join(sql_quote(t) for t in search_terms(q)) + "]"


@query(
    "query_token_array",
    f"""SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'),
      lambda w: length(w) >= 3 AND NOT list_contains([{', '.join(sql_quote(w) for w in K.QUERY_STOPWORDS)}], w))[1:12], ' ') AS tokens
    FROM conversations""",
)
def query_token_array(spark, sf):
    from ..functions.text import token_array

    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_join(token_array("text"), " ").alias("tokens")
    )
