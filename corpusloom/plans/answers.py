"""Subtitles, merges by book, citations and prompt packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.chains import chain_caption, chain_display
from ..functions.scalars import reply_and_suggestions
from ..functions.text import drop_code_fence, safe_name, sanitize_answer, truncate
from ..operators import answers as A
from ..operators import citations as Ci
from ..operators import models as Mo
from ..operators import retrieval as V
from ..operators import subtitles as S
from ..operators import topic as T
from .alignment import TALKS_SQL, talk_files
from .registry import query, table
from .retrieval import BUNDLE_SQL, PASSAGE_SQL, QUESTION, K_RESULTS, chunk_table, query_vector
from .search import ITEMS_SQL, TOPIC_CATEGORY, items_of, topic_top_sql
from .standins import RECORDS_SQL, SQL_WS, records, sql_strip


@query(
    "subtitle_clean",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(v, chr(10))) AS x, unnest(range(len(string_split(v, chr(10))))) AS i FROM (
      SELECT doc_id, 'WEBVTT' || chr(10) || 'Kind: captions' || chr(10) || replace(text, '. ', chr(10) || '00:00:01.000 --> 00:00:02.000' || chr(10) || '<c>') AS v FROM documents)),
    s AS (SELECT doc_id, i, {sql_strip('x')} AS x FROM l), f AS (SELECT doc_id, i, {sql_strip("regexp_replace(x, '<[^>]+>', '', 'g')")} AS x FROM s WHERE x <> ''
      AND NOT starts_with(x, 'WEBVTT') AND NOT starts_with(x, 'Kind:') AND NOT starts_with(x, 'Language:') AND NOT regexp_matches(x, '^[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}[.][0-9]{{3}}\\s*-->')),
    d AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM f WHERE x <> ''),
    g AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS clean FROM d WHERE p IS DISTINCT FROM x GROUP BY doc_id)
    SELECT doc_id, coalesce(clean, '') AS clean FROM documents LEFT JOIN g USING (doc_id)""",
)
def subtitle_clean(spark, sf):
    cues = F.replace("text", F.lit(". "), F.lit("\n00:00:01.000 --> 00:00:02.000\n<c>"))
    d = table(spark, sf, "documents", spread_by="doc_id")
    v = F.concat(F.lit("WEBVTT\nKind: captions\n"), cues)
    return d.select("doc_id", S.clean_subtitles(v).alias("clean"))


@query(
    "subtitle_clean_pages",
    f"""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS x, unnest(range(len(string_split(html, chr(10))))) AS i FROM pages),
    s AS (SELECT page_id, i, {sql_strip('x')} AS x FROM l), f AS (SELECT page_id, i, {sql_strip("regexp_replace(x, '<[^>]+>', '', 'g')")} AS x FROM s WHERE x <> ''),
    d AS (SELECT *, lag(x) OVER (PARTITION BY page_id ORDER BY i) AS p FROM f WHERE x <> '')
    SELECT page_id, md5(string_agg(x, ' ' ORDER BY i)) AS clean_md5 FROM d WHERE p IS DISTINCT FROM x GROUP BY page_id""",
)
def subtitle_clean_pages(spark, sf):
    c = table(spark, sf, "pages", spread_by="page_id").select("page_id", S.clean_subtitles("html").alias("c"))
    return c.filter("c <> ''").select("page_id", F.md5("c").alias("clean_md5"))


@query(
    "merged_by_book",
    f"""WITH {TALKS_SQL} SELECT b::INT AS book, 0 AS ord, '' AS file_name, md5('===== MERGED BOOK ' || b || ' =====' || chr(10)) AS text_md5 FROM range(1, 12) t(b)
    UNION ALL SELECT book, 1, file_name, md5(chr(10) || chr(10) || '===== SOURCE: ' || file_name || ' =====' || chr(10) || regexp_replace(text, '{SQL_WS}+$', '') || chr(10)) FROM talks""",
)
def merged_by_book(spark, sf):
    m = S.merge_by_book(talk_files(spark, sf).select("file_name", "text"))
    return m.select("book", "ord", "file_name", F.md5("text").alias("text_md5"))


@query(
    "playlist_names",
    """SELECT doc_id::VARCHAR AS idx, source || '/' || lang AS title, 'v' || doc_id AS video_id,
    CASE WHEN doc_id >= 1000 THEN doc_id::VARCHAR ELSE lpad(doc_id::VARCHAR, 3, '0') END || '_' || source || lang AS file_stem FROM documents WHERE lang <> 'fr'""",
)
def playlist_names(spark, sf):
    extra = F.when(F.col("lang") == "fr", F.lit("|||x")).otherwise(F.lit(""))
    line = F.concat(
        F.lit(" "), F.col("doc_id").cast("string"), F.lit("|||"), "source", F.lit("/"), "lang", F.lit(" |||v"), F.col("doc_id").cast("string"), extra
    )
    return S.playlist_rows(table(spark, sf, "documents").select(line.alias("value")))


# --- citations ----------------------------------------------------------------------

ANSWERS_SQL = f"""{ITEMS_SQL}, ans AS (SELECT pos, suttaid, 'See (' || suttaid || ') and c' || lower(suttaid) || ' here ```(AN 9.9) AN 8.8``` then ' || replace(suttaid, ' ', '') || ' end' AS text FROM items)"""


def answer_rows(spark, sf):
    i = items_of(spark, sf)
    text = F.concat(
        F.lit("See ("), "suttaid", F.lit(") and c"), F.lower("suttaid"), F.lit(" here ```(AN 9.9) AN 8.8``` then "),
        F.replace("suttaid", F.lit(" "), F.lit("")), F.lit(" end"),
    )
    return i.select("pos", text.alias("text")), i


@query(
    "citations_extract",
    f"""WITH {ANSWERS_SQL}, parts AS (SELECT pos, string_split(text, '```') AS p FROM ans),
    f AS (SELECT pos, regexp_extract_all(p[1] || chr(10) || p[3], '[(](?:[cC][aA][nN]|AN)[^)]*[)]|\\b(?:[cC][aA][nN]|AN)\\s*[0-9]+(?:[.][0-9]+)*\\b') AS m FROM parts)
    SELECT pos, (i - 1)::INT AS ord, CASE WHEN lower(left(c, 3)) = 'can' THEN 'commentary' ELSE 'sutta' END AS kind,
      CASE WHEN lower(left(c, 3)) = 'can' THEN 'cAN ' ELSE 'AN ' END || regexp_extract(c, '[0-9.]+') AS ref
    FROM (SELECT pos, unnest(range(1, len(m) + 1)) AS i, trim(unnest(m), '()') AS c FROM f)""",
)
def citations_extract(spark, sf):
    return Ci.citations(answer_rows(spark, sf)[0])


@query(
    "citations_resolve",
    f"""WITH {ANSWERS_SQL}, k AS (SELECT suttaid, min(pos) AS p FROM items GROUP BY suttaid)
    SELECT a.pos, o.ord::INT AS ord, CASE WHEN o.ord = 1 THEN 'commentary' ELSE 'sutta' END AS kind, k.suttaid FROM ans a, (VALUES (0), (1), (2)) o(ord)
    JOIN k ON k.suttaid = a.suttaid""",
)
def citations_resolve(spark, sf):
    answers, items = answer_rows(spark, sf)
    return Ci.resolve(Ci.citations(answers), items).select("pos", "ord", "kind", "suttaid")


# --- prompts -----------------------------------------------------------------------


@query(
    "prompt_excerpts",
    f"""WITH {BUNDLE_SQL} SELECT count(*) AS n, md5(string_agg('[Excerpt ' || rank || ' | source: ' || source || ' | conv: ' || conversation_id || ']' || chr(10) || text,
      chr(10) || chr(10) ORDER BY rank)) AS excerpts_md5 FROM final""",
)
def prompt_excerpts(spark, sf):
    found = V.search_bundle(chunk_table(spark, sf), QUESTION, query_vector(spark, sf), K_RESULTS)
    packed = A.pack(found, A.excerpt(F.col("rank").cast("string")))
    return packed.select("n", F.md5("excerpts").alias("excerpts_md5"))


@query(
    "prompt_passages",
    f"""WITH {PASSAGE_SQL} SELECT count(*) AS n, md5(string_agg('[' || rank || ' | book: ' || book || ' | suttaid: ' || suttaid || ' | commentary_id: c' || suttaid || ' | kind: ' || kind || ']' || chr(10)
      || CASE kind WHEN 'sutta' THEN '{A.KIND_HINTS['sutta']}' WHEN 'commentary' THEN '{A.KIND_HINTS['commentary'].replace("'", "''")}' ELSE '{A.KIND_HINTS['chain']}' END
      || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS excerpts_md5 FROM passages""",
)
def prompt_passages(spark, sf):
    found = V.search_bundle(chunk_table(spark, sf), QUESTION, query_vector(spark, sf), K_RESULTS)
    packed = A.pack(V.order_passages(found), A.passage(F.col("rank").cast("string")))
    return packed.select("n", F.md5("excerpts").alias("excerpts_md5"))


def trunc_sql(e: str, n: int) -> str:
    return f"CASE WHEN length({e}) <= {n} THEN {e} ELSE left({e}, {n - 3}) || '...' END"


@query(
    "prompt_topic",
    f"""{topic_top_sql(TOPIC_CATEGORY, 4)}, r AS (SELECT *, row_number() OVER (ORDER BY category_match DESC, score DESC, pos) AS rank FROM top WHERE length(sutta) + length(commentary) > 0)
    SELECT md5('{A.TOPIC_RULES}' || chr(10) || chr(10) || string_agg('<' || CASE WHEN rank = 1 THEN 'best match id=' || sutta_id ELSE 'also fits no=' || (rank - 1) || ' id=' || sutta_id END
      || '>' || chr(10) || 'Reading: ' || CASE WHEN rank = 1 THEN {trunc_sql('sutta', 12000)} ELSE {trunc_sql('sutta', 6000)} END || chr(10) || 'Explained: '
      || CASE WHEN rank = 1 THEN {trunc_sql('commentary', 12000)} ELSE {trunc_sql('commentary', 6000)} END || chr(10) || '</>', chr(10) || chr(10) ORDER BY rank)) AS prompt_md5 FROM r""",
)
def prompt_topic(spark, sf):
    from pyspark.sql import Window

    hits = T.to_hits(T.topic_hits(records(spark, sf), TOPIC_CATEGORY, 4))
    order = Window.orderBy(F.desc("category_match"), F.desc("score"), "pos")
    return A.topic_prompt(hits.withColumn("rank", F.row_number().over(order))).select(F.md5("system").alias("prompt_md5"))


@query("answer_single_shot")
def answer_single_shot(spark, sf):
    found = V.search_transcripts(chunk_table(spark, sf), QUESTION, query_vector(spark, sf), 6)
    return A.answer(V.bounded(found, 6), QUESTION, Mo.generate_column())


@query("answer_map_reduce")
def answer_map_reduce(spark, sf):
    found = V.search_transcripts(chunk_table(spark, sf), QUESTION, query_vector(spark, sf), 6)
    return A.map_reduce_answer(V.bounded(found, 6), QUESTION, Mo.generate_column())


@query("hybrid_retrieve_reranked")
def hybrid_retrieve_reranked(spark, sf):
    found = V.search_transcripts(chunk_table(spark, sf), QUESTION, query_vector(spark, sf), 6, scorer=Mo.pair_scorer())
    return found.select("rank", "pos", "source", "suttaid")


@query("embed_documents")
def embed_documents(spark, sf):
    d = table(spark, sf, "documents", spread_by="doc_id").select("doc_id", Mo.embed_column()(F.col("text")).alias("v"))
    return d.select("doc_id", F.size("v").alias("dims"), F.round(F.get("v", F.lit(0)).cast("double"), 5).alias("v0"))


# --- replies -------------------------------------------------------------------------


@query(
    "reply_suggestions",
    f"""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN {sql_strip("replace(text, '\"', '')")} WHEN 1 THEN {sql_strip("replace(text, '\"', '')")} || ' SUGGESTIONS_JSON: [oops' ELSE {sql_strip("replace(text, '\"', '')")} END AS reply,
    CASE turn % 3 WHEN 0 THEN 'a?|' || role ELSE '' END AS suggestions FROM conversations""",
)
def reply_suggestions(spark, sf):
    body = F.replace("text", F.lit('"'), F.lit(""))
    tail = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit(' SUGGESTIONS_JSON: ["a?", "", 3, " '), "role", F.lit('"]')))
        .when(F.col("turn") % 3 == 1, F.lit(" SUGGESTIONS_JSON: [oops")).otherwise(F.lit(""))
    )
    trimmed = F.regexp_replace(body, r"\s+\z", "")
    c = table(spark, sf, "conversations").select("conv_id", "turn", reply_and_suggestions(F.concat(trimmed, tail)).alias("r"))
    return c.select("conv_id", "turn", "r.reply", F.array_join("r.suggestions", "|").alias("suggestions"))


@query(
    "answer_cleanup",
    f"""SELECT conv_id, turn, {sql_strip("regexp_replace(regexp_replace(text || ' Excerpt 12 ' || chr(10) || chr(10) || chr(10) || chr(10) || 'x', '\\b[Ee]xcerpt\\s*[0-9]+\\b', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS answer,
    {trunc_sql('text', 40)} AS short, regexp_replace(role || '/' || text, '[^\\p{{L}}\\p{{N}}_.\\-]', '_', 'g') AS name,
    {sql_strip('text')} AS unfenced FROM conversations""",
)
def answer_cleanup(spark, sf):
    raw = F.concat("text", F.lit(" Excerpt 12 \n\n\n\nx"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", sanitize_answer(raw).alias("answer"), truncate("text", 40).alias("short"),
        safe_name(F.concat("role", F.lit("/"), "text")).alias("name"),
        drop_code_fence(F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).alias("unfenced"),
    )


@query(
    "chain_display",
    f"""WITH {RECORDS_SQL} SELECT pos, CASE WHEN is_ordered THEN array_to_string(items, ' → ') ELSE array_to_string(items, ' ↓ ') END AS shown,
    'Category: ' || category || ' · ' || CASE WHEN is_ordered THEN 'Ordered' ELSE 'Unordered' END || CASE WHEN len(items) > 0 THEN ' · ' || len(items) || ' items' ELSE '' END AS caption
    FROM records WHERE chained""",
)
def chain_display_query(spark, sf):
    r = records(spark, sf).filter("chain IS NOT NULL")
    c = lambda n: F.col(f"chain.{n}")
    return r.select(
        "pos", chain_display(c("items"), c("is_ordered")).alias("shown"),
        chain_caption(c("category"), c("items"), c("count"), c("is_ordered")).alias("caption"),
    )
