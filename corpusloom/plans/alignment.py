"""Segmenting, alignment and mapping queries over documents, benchmark, labels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.chains import extract_chains
from ..functions.ids import canon_id, infer_id, translation_text
from ..functions.scoring import (
    alignment_words,
    evidence_generic,
    jaccard,
    keyword_overlap,
    quality_class,
    quality_reason,
)
from ..functions.text import canon_opening, mask_triple_ids, normalize_for_similarity, transcript_opening
from ..operators import alignment as A
from ..operators import mapping as M
from ..operators import segments as S
from .registry import query, table
from .search import sql_quote
from .standins import SQL_WS, sql_norm, sql_squeeze, sql_strip

# --- stand-ins --------------------------------------------------------------------


def talk_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as talk files of eleven books; English ones open with their id."""
    d = table(spark, sf, "documents", spread_by="doc_id")
    book = F.col("doc_id") % 11 + 1
    tid = F.concat_ws(".", book.cast("string"), F.floor(F.col("doc_id") / 22).cast("string"), (F.col("doc_id") % 22).cast("string"))
    name = F.concat(
        F.lit("Book "), book.cast("string"), F.when(book == 1, F.lit("A")).otherwise(F.lit("")),
        F.lit(" talk "), F.col("doc_id").cast("string"), F.lit(".txt"),
    )
    text = F.when(F.col("lang") == "en", F.concat(tid, F.lit(" "), "text")).otherwise(F.col("text"))
    return d.select("doc_id", "lang", name.alias("file_name"), tid.alias("tid"), book.cast("int").alias("book"), text.alias("text"))


TALKS_SQL = """talks AS (SELECT doc_id, lang, (doc_id % 11 + 1)::INT AS book,
    'Book ' || (doc_id % 11 + 1) || CASE WHEN doc_id % 11 = 0 THEN 'A' ELSE '' END || ' talk ' || doc_id || '.txt' AS file_name,
    (doc_id % 11 + 1) || '.' || (doc_id // 22) || '.' || (doc_id % 22) AS tid,
    CASE WHEN lang = 'en' THEN (doc_id % 11 + 1) || '.' || (doc_id // 22) || '.' || (doc_id % 22) || ' ' || text ELSE text END AS text
  FROM documents)"""


def canon(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as canon texts, with a numbered heading and an opening quote."""
    b = table(spark, sf, "benchmark")
    book, n = F.col("item_id") % 11 + 1, F.floor(F.col("item_id") / 11)
    head = F.concat(
        F.lit("Numbered Discourses "), book.cast("string"), F.lit("."), n.cast("string"), F.lit(" "),
        (n + 1).cast("string"), F.lit(". "), F.substring("text", 1, 40),
    )
    return b.select(
        F.col("item_id").alias("pos"),
        F.concat(F.lit("an"), book.cast("string"), F.lit("."), n.cast("string")).alias("canon_id"),
        F.concat(head, F.lit(" “"), "text", F.lit("”")).alias("canon_content"),
    )


CANON_SQL = """canon AS (SELECT item_id AS pos, 'an' || (item_id % 11 + 1) || '.' || (item_id // 11) AS canon_id, (item_id % 11 + 1)::INT AS book,
    'Numbered Discourses ' || (item_id % 11 + 1) || '.' || (item_id // 11) || ' ' || (item_id // 11 + 1) || '. ' || left(text, 40)
      || ' “' || text || '”' AS canon_content, left(text, 40) AS head, text FROM benchmark)"""


def flat_segments(spark: SparkSession, sf: str) -> DataFrame:
    """One segment per talk with the id its number suggests, supported by the text or not."""
    t = talk_files(spark, sf)
    return t.select(
        "doc_id", F.concat(F.lit("book"), F.col("book").cast("string"), F.lit(".json")).alias("json_file"),
        F.floor(F.col("doc_id") / 11).cast("int").alias("segment_index"),
        F.when(F.col("lang") == "de", F.lit("")).otherwise(F.col("tid")).alias("transcript_id"),
        F.when(F.col("lang") == "de", F.lit("")).otherwise(canon_id("tid")).alias("canon_id"),
        "book", F.col("text").alias("transcript_content"),
    )


SEGMENTS_SQL = f"""{TALKS_SQL}, {CANON_SQL}, segs AS (SELECT doc_id, 'book' || book || '.json' AS json_file,
    (doc_id // 11)::INT AS segment_index, CASE WHEN lang = 'de' THEN '' ELSE tid END AS transcript_id,
    CASE WHEN lang = 'de' THEN '' ELSE 'an' || book || '.' || (doc_id % 22) END AS canon_id, book, text AS transcript_content
    FROM talks), enriched AS (SELECT s.*, CASE WHEN s.canon_id = '' THEN ''
      WHEN contains(left({sql_strip('transcript_content')}, 2000), transcript_id)
        OR contains(regexp_replace(left({sql_strip('transcript_content')}, 2000), '{SQL_WS}+', '', 'g'), transcript_id)
      THEN coalesce(c.canon_content, '') ELSE '' END AS canon_content
    FROM segs s LEFT JOIN canon c ON c.canon_id = s.canon_id)"""


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    c = canon(spark, sf).select("canon_id", F.col("canon_content").alias("canon_text"))
    return S.enrich(flat_segments(spark, sf), c, spread="doc_id")


ID3_SQL = "(^|[^0-9])([0-9]{1,2}[.][0-9]{1,3}[.][0-9]{1,3})([^0-9]|$)"
ID2_SQL = "(^|[^0-9])([0-9]{1,2}[.][0-9]{1,3})($|[^0-9.]|[.]($|[^0-9]))"


def infer_sql(expr: str, chars: int = 560) -> str:
    joined = f"regexp_replace(left({expr}, {chars}), '(^|[^0-9])([0-9]{{1,2}})[.]([0-9]{{1,3}}){SQL_WS}+([0-9]{{1,3}})($|[^0-9.]|[.]($|[^0-9]))', '\\1\\2.\\3.\\4\\5', 'g')"
    return f"coalesce(nullif(regexp_extract({joined}, '{ID3_SQL}', 2), ''), regexp_extract({joined}, '{ID2_SQL}', 2))"


# --- identifiers and segments ------------------------------------------------------


@query("infer_ids", f"WITH {TALKS_SQL} SELECT doc_id, {infer_sql('text')} AS transcript_id FROM talks")
def infer_ids(spark, sf):
    return talk_files(spark, sf).select("doc_id", infer_id("text").alias("transcript_id"))


@query(
    "segments_by_dotted_id",
    f"""WITH {TALKS_SQL}, cut AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '{ID3_SQL}', '\\1' || chr(1) || '\\2\\3', 'g'), chr(1))[2:]) AS t,
      unnest(range(len(string_split(regexp_replace(text, '{ID3_SQL}', '\\1' || chr(1) || '\\2\\3', 'g'), chr(1))) - 1)) AS row_ord FROM talks)
    SELECT doc_id, row_ord::INT AS row_ord, regexp_extract(t, '^[0-9]{{1,2}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}') AS teacher_id,
      regexp_extract(t, '^([0-9]+)', 1)::INT AS book, md5({sql_strip('t')}) AS text_md5,
      'an' || regexp_extract(t, '^([0-9]+)[.]', 1) || '.' || regexp_extract(t, '^[0-9]+[.][0-9]+[.]([0-9]{{1,3}})', 1) AS canon_id FROM cut""",
)
def segments_by_dotted_id(spark, sf):
    rows = M.teacher_rows(talk_files(spark, sf).select("doc_id", "text"))
    return rows.select(
        "doc_id", "row_ord", "teacher_id", "book", F.md5("text").alias("text_md5"), canon_id("teacher_id").alias("canon_id")
    )


@query("reference_tag_split")
def reference_tag_split(spark, sf):
    files = talk_files(spark, sf).select("doc_id", "file_name", "text")
    segs = S.segment_files(files)
    return segs.select(
        "doc_id", "json_file", "segment_index", "transcript_id", "canon_id", "book", F.md5("transcript_content").alias("content_md5")
    )


@query(
    "infer_id_from_next",
    f"""WITH {TALKS_SQL}, s AS (SELECT doc_id, book, {sql_strip("text")} AS body FROM talks),
    n AS (SELECT *, left(coalesce(lead(body) OVER (PARTITION BY book ORDER BY doc_id), ''), 560) AS nxt FROM s),
    f AS (SELECT *, {infer_sql('body')} AS own, CASE WHEN nxt <> '' THEN {infer_sql("body || ' ' || nxt")} ELSE '' END AS peek FROM n),
    t AS (SELECT *, CASE WHEN own <> '' THEN own ELSE peek END AS tid FROM f)
    SELECT doc_id, tid AS transcript_id, CASE WHEN tid = '' THEN '' ELSE 'an' || split_part(tid, '.', 1) || '.' || regexp_extract(tid, '([0-9]+)$', 1) END AS canon_id,
      CASE WHEN tid <> '' AND split_part(tid, '.', 1)::INT > 0 THEN split_part(tid, '.', 1)::INT ELSE 0 END AS book FROM t""",
)
def infer_id_from_next(spark, sf):
    t = talk_files(spark, sf)
    segs = t.select(
        "doc_id", F.col("book").cast("string").alias("json_file"), F.floor(F.col("doc_id") / 11).alias("segment_index"),
        F.lit("").alias("transcript_id"), F.lit("").alias("canon_id"), F.lit(0).alias("book"), F.col("text").alias("transcript_content"),
    )
    return S.infer_from_neighbours(segs).select("doc_id", "transcript_id", "canon_id", "book")


@query("enrich_left_join", f"WITH {SEGMENTS_SQL} SELECT doc_id, canon_id, md5(canon_content) AS canon_md5 FROM enriched")
def enrich_left_join(spark, sf):
    return enriched(spark, sf).select("doc_id", "canon_id", F.md5("canon_content").alias("canon_md5"))


@query(
    "fill_counts_by_file",
    f"""WITH {TALKS_SQL}, {CANON_SQL}, f AS (SELECT doc_id, book, {infer_sql('text', 800)} AS tid FROM talks),
    g AS (SELECT *, CASE WHEN tid = '' THEN '' ELSE 'an' || split_part(tid, '.', 1) || '.' || regexp_extract(tid, '([0-9]+)$', 1) END AS cid FROM f)
    SELECT 'book' || g.book || '.json' AS json_file, count(*) AS rows, count(*) FILTER (c.canon_content <> '') AS filled
    FROM g LEFT JOIN canon c ON c.canon_id = g.cid GROUP BY g.book""",
)
def fill_counts_by_file(spark, sf):
    c = canon(spark, sf).select("canon_id", F.col("canon_content").alias("canon_text"))
    rows = flat_segments(spark, sf).drop("transcript_id", "canon_id")
    return S.fill_counts(S.fill_simple(rows, c, "doc_id"))


@query(
    "preserve_previous",
    f"""WITH {SEGMENTS_SQL}, old AS (SELECT doc_id, json_file, CASE WHEN book % 2 = 0 THEN segment_index ELSE segment_index + 1 END AS segment_index,
      transcript_id, canon_id, 'kept ' || doc_id AS canon_content FROM segs WHERE transcript_id <> '' OR segment_index > 3),
    last AS (SELECT json_file, transcript_id, canon_id, arg_max(canon_content, segment_index) AS t FROM old GROUP BY ALL)
    SELECT s.doc_id, coalesce(o.canon_content, l.t, '') AS canon_content FROM segs s
    LEFT JOIN old o ON o.json_file = s.json_file AND o.segment_index = s.segment_index AND o.transcript_id = s.transcript_id AND o.canon_id = s.canon_id
    LEFT JOIN last l ON l.json_file = s.json_file AND l.transcript_id = s.transcript_id AND l.canon_id = s.canon_id""",
)
def preserve_previous(spark, sf):
    new = flat_segments(spark, sf).withColumn("canon_content", F.lit(""))
    moved = F.when(F.col("book") % 2 == 0, F.col("segment_index")).otherwise(F.col("segment_index") + 1)
    old = (
        new.filter((F.col("transcript_id") != "") | (F.col("segment_index") > 3))
        .withColumn("segment_index", moved)
        .withColumn("canon_content", F.concat(F.lit("kept "), F.col("doc_id").cast("string")))
        .select("json_file", "segment_index", "transcript_id", "canon_id", "canon_content")
    )
    return S.keep_previous_canon(new, old).select("doc_id", "canon_content")


@query(
    "missing_pairs",
    f"WITH {SEGMENTS_SQL} SELECT DISTINCT canon_id, transcript_id FROM enriched WHERE canon_id <> '' AND canon_content = ''",
)
def missing_pairs(spark, sf):
    return S.missing_pairs(enriched(spark, sf))


@query(
    "missing_report",
    f"""WITH {SEGMENTS_SQL} SELECT count(*) AS segments, count(DISTINCT canon_id || '|' || transcript_id) AS pairs,
    count(DISTINCT canon_id) AS canon_ids FROM enriched WHERE canon_id <> '' AND canon_content = ''""",
)
def missing_report(spark, sf):
    return S.missing_counts(enriched(spark, sf))


@query(
    "missing_dropped",
    f"WITH {SEGMENTS_SQL} SELECT json_file, count(*) AS kept FROM enriched WHERE NOT (canon_id <> '' AND canon_content = '') GROUP BY json_file",
)
def missing_dropped(spark, sf):
    return S.drop_missing_canon(enriched(spark, sf)).groupBy("json_file").agg(F.count("*").alias("kept"))


@query("missing_report_from_raw")
def missing_report_from_raw(spark, sf):
    c = canon(spark, sf).select("canon_id", F.col("canon_content").alias("canon_text"))
    segs = S.segment_files(talk_files(spark, sf).select("file_name", "text"))
    return S.missing_counts(S.enrich(segs, c, spread=["json_file", "segment_index"]))


# --- agreement and quality -----------------------------------------------------------

def words_sql(expr: str) -> str:
    return sql_squeeze(
        f"regexp_replace(replace(lower(strip_accents({expr})), '<j>', ' '), '[^\\p{{L}}\\p{{N}}_\\x{{09}}-\\x{{0D}}\\x{{1C}}-\\x{{20}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{100}}-\\x{{24F}}]', ' ', 'g')"
    )


ALIGNED_SQL = f"""{SEGMENTS_SQL}, openings AS (SELECT e.doc_id,
    left(regexp_replace({sql_strip('e.transcript_content')}, '^([0-9]+[.])+[0-9]+{SQL_WS}+', ''), 650) AS t_open,
    CASE WHEN regexp_matches(c.canon_content, '\\bThen\\b') THEN left(substring(c.canon_content, length(regexp_extract(c.canon_content, '(?s)^(.*?)\\bThen\\b', 1)) + 1), 700)
      ELSE left(substring(c.canon_content, instr(c.canon_content, '“')), 700) END AS c_open
    FROM segs e JOIN canon c ON c.canon_id = e.canon_id), aligned AS (SELECT doc_id, c_open, {words_sql('t_open')} AS t, {words_sql('c_open')} AS c FROM openings),
  sets AS (SELECT *, list_filter(list_distinct(string_split(t, ' ')), lambda w: w <> '') AS wt, list_filter(list_distinct(string_split(c, ' ')), lambda w: w <> '') AS wc,
    list_filter(string_split(c, ' '), lambda w: length(w) >= 4)[1:40] AS kw FROM aligned)"""


def with_own_canon(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with the canon text of their id."""
    return flat_segments(spark, sf).join(canon(spark, sf).drop("pos"), "canon_id")


@query(
    "agreement_parts",
    f"""WITH {ALIGNED_SQL} SELECT doc_id, md5(c) AS canon_md5,
    round(CASE WHEN len(wt) > 0 AND len(wc) > 0 THEN len(list_intersect(wt, wc))::DOUBLE / len(list_distinct(list_concat(wt, wc))) ELSE 0 END, 6) AS jaccard,
    round(CASE WHEN len(kw) > 0 THEN len(list_filter(kw, lambda w: contains(t, w)))::DOUBLE / len(kw) ELSE 0 END, 6) AS overlap FROM sets""",
)
def agreement_parts(spark, sf):
    p = with_own_canon(spark, sf).select(
        "doc_id",
        alignment_words(transcript_opening("transcript_content")).alias("t"),
        alignment_words(canon_opening("canon_content")).alias("c"),
    )
    return p.select(
        "doc_id", F.md5("c").alias("canon_md5"),
        F.round(jaccard(F.col("t"), F.col("c")), 6).alias("jaccard"),
        F.round(keyword_overlap(F.col("t"), F.col("c")), 6).alias("overlap"),
    )


@query("segment_annotations")
def segment_annotations(spark, sf):
    a = A.annotate(enriched(spark, sf))
    return a.select(
        "doc_id", "use", "mapping_agreement_score", "mapping_quality", "mapping_quality_reason", "chain_extraction",
        F.size("chains").alias("n_chains"),
    )


@query(
    "quality_class",
    """SELECT doc_id, CASE WHEN s >= 0.2 THEN 'ok' WHEN s >= 0.1 THEN 'suspect' ELSE 'bad' END AS mapping_quality,
    'agreement_score=' || format('{:.3f}', s) || CASE WHEN s >= 0.2 THEN '>=0.2' WHEN s >= 0.1 THEN ' in [0.1,0.2) (possible topic mismatch)'
      ELSE '<0.1 (likely wrong sutta or garbled text)' END AS reason
    FROM (SELECT d.doc_id, (d.n_chars % 400) / 1000.0::DOUBLE + coalesce(quality, 0) * 0.05::DOUBLE AS s FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
)
def quality_class_query(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    s = (F.col("n_chars") % 400) / F.lit(1000.0) + F.coalesce("quality", F.lit(0)) * F.lit(0.05)
    return d.select("doc_id", quality_class(s).alias("mapping_quality"), quality_reason(s).alias("reason"))


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with annotations taken from the labels, for the census."""
    l = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "lang", "text", "n_chars").join(l, "doc_id", "left")
    has = F.col("quality").isNotNull()
    book = F.col("doc_id") % 11 + 1
    return d.select(
        F.when(has | (F.col("lang") == "en"), F.concat(F.lit("an"), F.col("doc_id").cast("string"))).otherwise("").alias("canon_id"),
        F.when(has, F.col("text")).otherwise("").alias("canon_content"), "text",
        F.when(has, "yes").otherwise("no").alias("use"),
        F.when(F.col("quality") == 1, "ok").when(has, "suspect").otherwise("bad").alias("mapping_quality"),
        book.cast("string").alias("book"),
        F.when(F.col("toxic") == 1, F.array(F.array(F.lit("a")))).otherwise(F.array().cast("array<array<string>>")).alias("chains"),
        F.when(has, F.concat(F.lit("family_"), F.col("lang"))).otherwise("unmatched_needs_review").alias("chain_extraction"),
        F.concat(F.lit("f"), (F.col("doc_id") % 7).cast("string")).alias("json_file"), F.col("doc_id").alias("segment_index"),
        F.lit("1.1").alias("transcript_id"), F.lit(None).cast("double").alias("mapping_agreement_score"),
        F.col("text").alias("transcript_content"), F.col("lang").alias("mapping_quality_reason"),
    )


JUDGED_SQL = f"""j AS (SELECT d.doc_id, d.lang, d.text, quality, toxic, (d.doc_id % 11 + 1)::INT AS book, quality IS NOT NULL AS has,
    quality IS NOT NULL OR lang = 'en' AS with_id, CASE WHEN quality = 1 THEN 'ok' WHEN quality IS NOT NULL THEN 'suspect' ELSE 'bad' END AS mq,
    CASE WHEN quality IS NOT NULL THEN 'family_' || lang ELSE 'unmatched_needs_review' END AS ce,
    CASE WHEN quality IS NOT NULL THEN {sql_strip("d.text")} ELSE '' END AS cc
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


@query(
    "census",
    f"""WITH {JUDGED_SQL} SELECT count(*) AS total_segments, count(*) FILTER (with_id) AS segments_with_canon_id,
    count(*) FILTER (with_id AND cc = '') AS empty_canon_with_canon_id, count(*) FILTER (has) AS use_yes, count(*) FILTER (NOT has) AS use_no,
    count(*) FILTER (mq = 'ok') AS quality_ok, count(*) FILTER (mq = 'ok' AND with_id) AS quality_ok_with_id,
    count(*) FILTER (mq = 'suspect') AS quality_suspect, count(*) FILTER (mq = 'suspect' AND with_id) AS quality_suspect_with_id,
    count(*) FILTER (mq = 'bad') AS quality_bad, count(*) FILTER (mq = 'bad' AND with_id) AS quality_bad_with_id,
    count(*) FILTER (book BETWEEN 3 AND 6) AS segments_books_3_to_6,
    count(*) FILTER (book BETWEEN 3 AND 6 AND toxic = 1) AS chains_nonempty_books_3_6,
    count(*) FILTER (book BETWEEN 3 AND 6 AND ce = 'unmatched_needs_review') AS chains_unmatched_books_3_6 FROM j""",
)
def census(spark, sf):
    return A.census(judged(spark, sf))


@query(
    "chain_methods",
    f"WITH {JUDGED_SQL} SELECT ce AS chain_extraction, count(*) AS n FROM j WHERE book BETWEEN 3 AND 6 GROUP BY ce",
)
def chain_methods(spark, sf):
    return A.chain_methods(judged(spark, sf))


@query(
    "alignment_report",
    f"""WITH {JUDGED_SQL} SELECT 'f' || (doc_id % 7) AS json_file, doc_id::VARCHAR AS segment_index, '1.1' AS transcript_id,
    CASE WHEN with_id THEN 'an' || doc_id ELSE '' END AS canon_id, book::VARCHAR AS book, CASE WHEN has THEN 'yes' ELSE 'no' END AS use,
    mq AS mapping_quality, 'None' AS mapping_agreement_score, ce AS chain_extraction FROM j""",
)
def alignment_report(spark, sf):
    return A.alignment_report(judged(spark, sf))


def one_line_sql(e: str, n: int) -> str:
    t = f"translate({e}, chr(9) || chr(13) || chr(10), '   ')"
    return f"CASE WHEN length({t}) > {n} THEN left({t}, {n - 3}) || '...' ELSE {t} END"


@query(
    "review_report",
    f"""WITH {JUDGED_SQL} SELECT 'f' || (doc_id % 7) AS json_file, doc_id AS segment_index, '1.1' AS transcript_id,
    CASE WHEN with_id THEN 'an' || doc_id ELSE '' END AS canon_id, mq AS mapping_quality,
    {one_line_sql("left(regexp_replace(" + sql_strip('text') + f", '^([0-9]+[.])+[0-9]+{SQL_WS}+', ''), 650)", 600)} AS transcript_opening,
    {one_line_sql('cc', 600)} AS canon_opening, lang AS mismatch_reason FROM j WHERE book = 7 AND mq <> 'ok'""",
)
def review_report(spark, sf):
    return A.review_report(judged(spark, sf))


CHAIN_CASES = [
    ("deeds are the field, consciousness is the seed, craving is the moisture", "field_seed_moisture", 4),
    ("Higher Ethics, the higher mind, and the higher wisdom", "three_higher_trainings", 3),
    ("gone for refuge to the Buddha", "fragrance_virtue", 4),
    ("precepts and observances are Fruitful", "precepts_fruitful", 3),
    ("A fool is known by three things: hurtful deeds", "fool_astute_three", 3),
    ("Three kinds of fragrance: roots<j>heartwood", "three_fragrances_wind", 3),
    (
        "Experiential confidence in the Buddha: a. Experiential confidence in the teaching: b. Experiential confidence in the Saṅgha: c",
        "experiential_confidence_three",
        3,
    ),
]


@query(
    "chain_extract",
    "SELECT item_id, CASE item_id % 8 "
    + " ".join(f"WHEN {i} THEN '{m}:{n}'" for i, (_, m, n) in enumerate(CHAIN_CASES))
    + " ELSE 'unmatched_needs_review:0' END AS found FROM benchmark",
)
def chain_extract(spark, sf):
    passage = F.lit("")
    for i, (text, _, _) in enumerate(CHAIN_CASES):
        passage = F.when(F.col("item_id") % 8 == i, F.lit(text)).otherwise(passage)
    c = extract_chains(F.concat("text", F.lit(" "), passage))
    b = table(spark, sf, "benchmark").select("item_id", c.alias("c"))
    n = F.coalesce(F.size(F.get("c.chains", F.lit(0))), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    return b.select("item_id", F.concat("c.method", F.lit(":"), n.cast("string")).alias("found"))


# --- canon index and mapping ------------------------------------------------------------

TITLES_SQL = f"""{CANON_SQL}, titled AS (SELECT *, left(replace({sql_strip('head')}, chr(10), ' '), 120) AS title, {sql_squeeze("left(text || '”', 300)")} AS opening FROM canon)"""


@query("title_opening", f"WITH {TITLES_SQL} SELECT canon_id, book, title, opening FROM titled")
def title_opening(spark, sf):
    return M.canon_index(canon(spark, sf)).select("canon_id", "book", "title", "opening")


@query(
    "keywords_top12",
    f"""WITH {TITLES_SQL}, w AS (SELECT canon_id, unnest(regexp_extract_all(lower(title || ' ' || opening), '[a-z\\x{{80}}-\\x{{24F}}'']{{3,}}')) AS w FROM titled),
    c AS (SELECT canon_id, w, count(*) AS n FROM w WHERE w NOT IN ({', '.join(sql_quote(x) for x in K.KEYWORD_STOPWORDS)}) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY canon_id ORDER BY n DESC, w) AS rn FROM c)
    SELECT canon_id, string_agg(w, ' ' ORDER BY rn) AS keywords FROM r WHERE rn <= 12 GROUP BY canon_id""",
)
def keywords_top12(spark, sf):
    return M.canon_index(canon(spark, sf)).select("canon_id", F.array_join("keywords", " ").alias("keywords"))


def units(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.teacher_rows(talk_files(spark, sf).select("doc_id", "text"))
    return M.split_units(rows)


@query("unit_split")
def unit_split(spark, sf):
    return units(spark, sf).select("doc_id", "row_ord", "unit_id", "book", F.md5("text").alias("text_md5"))


def doc_units(spark: SparkSession, sf: str) -> DataFrame:
    """Every talk as one unit, so that each book has texts to compare."""
    return talk_files(spark, sf).select(
        F.concat("tid", F.lit("#a")).alias("unit_id"), "doc_id", "book", "text", "tid"
    )


@query("candidate_topk_by_book")
def candidate_topk_by_book(spark, sf):
    scores = M.candidate_scores(doc_units(spark, sf), M.canon_index(canon(spark, sf)), 3)
    return scores.select("unit_id", "book", "pos", "rank", F.round("score", 6).alias("score"))


@query("candidate_blocks")
def candidate_blocks(spark, sf):
    index = M.canon_index(canon(spark, sf))
    return M.candidate_block(index, M.candidate_scores(doc_units(spark, sf), index, 2)).select(
        "unit_id", F.md5("block").alias("block_md5")
    )


@query("similarity_keys", f"""SELECT doc_id, left({sql_squeeze("regexp_replace(" + sql_norm("translate(text, '’‘', '''''')") + ", '[^\\p{L}\\p{N}_ \\x{80}-\\x{24F}]', ' ', 'g')")}, 320) AS key FROM documents""")
def similarity_keys(spark, sf):
    return table(spark, sf, "documents", spread_by="doc_id").select(
        "doc_id", F.substring(normalize_for_similarity("text"), 1, 320).alias("key")
    )


@query(
    "masked_unit_text",
    f"WITH {TALKS_SQL} SELECT doc_id, left(regexp_replace(text, '{ID3_SQL}', '\\1[id]\\3', 'g'), 2000) AS masked FROM talks",
)
def masked_unit_text(spark, sf):
    return talk_files(spark, sf).select("doc_id", mask_triple_ids("text").alias("masked"))


def choices(spark: SparkSession, sf: str) -> DataFrame:
    """Events as model choices: value, type and key decide the fields."""
    e = table(spark, sf, "events")
    k = F.from_json("props", "k int")["k"]
    cid = F.concat(F.lit("an"), (k % 11 + 1).cast("string"), F.lit("."), k.cast("string"))
    kind = F.when(F.col("event_type") == "click", "exact").when(F.col("event_type") == "view", "probable")
    kind = kind.when(F.col("event_type") == "purchase", "mixed").when(F.col("event_type") == "signup", "weird").otherwise("unknown")
    none = F.array().cast("array<string>")
    top = (k % 50) / F.lit(100.0)
    return e.select(
        F.col("event_id"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("unit_id"), (k % 11 + 1).alias("book"),
        F.when((F.col("event_type") == "error") | (k % 13 == 0), none).otherwise(F.array(cid)).alias("best_canon_ids"),
        F.when(k % 2 == 0, cid).alias("primary_canon_id"),
        F.least(F.col("value") / 50.0, F.lit(1.0)).alias("confidence"), (k % 17 == 0).alias("is_mixed"), (k % 5 == 0).alias("needs_review"),
        F.when(k % 3 == 0, F.array(F.lit("seven powers mindfulness"))).when(k % 3 == 1, F.array(F.lit("the so"), F.lit("powers of"), F.lit("")))
        .otherwise(F.array(F.lit("noble"), F.lit("right effort"))).alias("evidence_phrases"),
        F.lit(None).cast("string").alias("reason"), kind.alias("match_type"),
        top.alias("top_score"), F.when(k % 7 != 0, top - (k % 9) / F.lit(100.0)).alias("second_score"), cid.alias("top_canon_id"),
    )


CHOICES_SQL = """c0 AS (SELECT *, (props->>'$.k')::INT AS k FROM events), c1 AS (SELECT event_id, 'u' || event_id AS unit_id, k % 11 + 1 AS book,
    'an' || (k % 11 + 1) || '.' || k AS cid, event_type = 'error' OR k % 13 = 0 AS none, k % 2 = 0 AS named, least(value / 50.0, 1.0) AS conf,
    k % 17 = 0 AS mixed, k % 5 = 0 AS flagged, k % 3 <> 1 AS rich, k,
    CASE event_type WHEN 'click' THEN 'exact' WHEN 'view' THEN 'probable' WHEN 'purchase' THEN 'mixed' ELSE 'unknown' END AS mt,
    event_type = 'error' AS raw_unknown,
    (k % 50) / 100.0::DOUBLE AS top, CASE WHEN k % 7 <> 0 THEN (k % 50) / 100.0::DOUBLE - (k % 9) / 100.0::DOUBLE END AS second FROM c0),
  c2 AS (SELECT *, raw_unknown AND none AND top >= 0.22::DOUBLE AND top - coalesce(second, 0) >= 0.03::DOUBLE AS fb FROM c1),
  c3 AS (SELECT event_id, unit_id, book, k, raw_unknown, none, fb, top, second, CASE WHEN fb THEN false ELSE none END AS nobest,
    CASE WHEN fb OR named OR NOT none THEN cid END AS prim, CASE WHEN fb THEN round(least(0.85::DOUBLE, 0.60::DOUBLE + top), 3) ELSE conf END AS confidence,
    CASE WHEN fb THEN 'probable' ELSE mt END AS match_type, CASE WHEN fb THEN false ELSE mixed END AS mixed, CASE WHEN fb THEN false ELSE flagged END AS flagged,
    CASE WHEN fb THEN false ELSE rich END AS rich,
    CASE WHEN fb THEN 'Heuristic fallback: top candidate by retrieval (score=' || format('{:.3f}', top) || ', gap=' || format('{:.3f}', top - coalesce(second, 0)) || ').' ELSE '' END AS reason FROM c2),
  c4 AS (SELECT *, CASE WHEN prim IS NULL OR nobest OR match_type = 'unknown' OR mixed OR NOT rich THEN 'needs_review'
    WHEN confidence >= 0.9 AND NOT flagged THEN 'accept' WHEN confidence >= 0.75 AND match_type IN ('exact', 'probable') THEN 'accept_with_flag'
    ELSE 'needs_review' END AS status FROM c3)"""


def mapped(spark: SparkSession, sf: str) -> DataFrame:
    c = choices(spark, sf)
    c = c.withColumns(
        {"chose_nonempty": F.size("best_canon_ids") > 0, "returned_unknown": F.coalesce(F.col("match_type"), F.lit("unknown")) == "unknown"}
    )
    return M.assign_status(M.apply_fallback(c))


@query(
    "mapping_status",
    f"""WITH {CHOICES_SQL} SELECT event_id, unit_id, book, coalesce(prim, '') AS primary_canon_id, round(confidence, 6) AS confidence, mixed AS is_mixed,
    status <> 'accept' AS needs_review, reason, match_type, fb AS fallback_used, status FROM c4""",
)
def mapping_status(spark, sf):
    return mapped(spark, sf).select(
        "event_id", "unit_id", "book", F.coalesce("primary_canon_id", F.lit("")).alias("primary_canon_id"),
        F.round("confidence", 6).alias("confidence"), "is_mixed", "needs_review", "reason", "match_type", "fallback_used", "status",
    )


@query(
    "mapping_run_counts",
    f"""WITH {CHOICES_SQL} SELECT count(*) AS total_units, count(*) FILTER (NOT none) AS chose_nonempty, count(*) FILTER (raw_unknown) AS returned_unknown,
    count(*) FILTER (fb) AS fallback_used, count(*) FILTER (status = 'accept') AS accepted, count(*) FILTER (status = 'accept_with_flag') AS accept_with_flag,
    count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (top < 0.22::DOUBLE) AS low_top_score_units,
    count(*) FILTER (CASE WHEN second IS NULL THEN 1 ELSE top - second END <= 0.02::DOUBLE) AS small_gap_units FROM c4""",
)
def mapping_run_counts(spark, sf):
    return M.run_counts(mapped(spark, sf))


@query(
    "review_rate_by_book",
    f"""WITH {CHOICES_SQL} SELECT book, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) AS total,
    round(count(*) FILTER (status = 'needs_review') / count(*)::DOUBLE, 6) AS review_rate FROM c4 GROUP BY book
    ORDER BY count(*) FILTER (status = 'needs_review') / count(*)::DOUBLE DESC, book LIMIT 10""",
)
def review_rate_by_book(spark, sf):
    return M.review_rates(mapped(spark, sf)).withColumn("review_rate", F.round("review_rate", 6))


@query(
    "primary_frequency",
    f"""WITH {CHOICES_SQL} SELECT prim AS primary_canon_id, count(*) AS n FROM c4 WHERE prim IS NOT NULL GROUP BY prim
    ORDER BY n DESC, min(event_id) LIMIT 15""",
)
def primary_frequency(spark, sf):
    return M.primary_frequency(mapped(spark, sf), "event_id")


@query(
    "low_score_samples",
    f"WITH {CHOICES_SQL} SELECT event_id, unit_id FROM c4 WHERE top < 0.22::DOUBLE ORDER BY event_id LIMIT 12",
)
def low_score_samples(spark, sf):
    return M.sample_ids(mapped(spark, sf), F.col("top_score") < K.FALLBACK_SCORE_MIN, "event_id")


@query(
    "evidence_checks",
    f"WITH {CHOICES_SQL} SELECT event_id, k % 3 = 1 AS generic FROM c4",
)
def evidence_checks(spark, sf):
    return choices(spark, sf).select("event_id", evidence_generic(F.col("evidence_phrases")).alias("generic"))


@query(
    "resume_anti_join",
    """SELECT unit_id, min(doc_id) AS doc_id FROM (SELECT source || '#' || lang AS unit_id, doc_id FROM documents)
    WHERE unit_id NOT IN (SELECT d.source || '#' || d.lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1)
    GROUP BY unit_id""",
)
def resume_anti_join(spark, sf):
    d = table(spark, sf, "documents").select(F.concat("source", F.lit("#"), "lang").alias("unit_id"), "doc_id")
    done = d.join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id").select("unit_id")
    return M.pending_units(d, done, ["doc_id"])


@query(
    "canon_snapshot_text",
    f"""SELECT conv_id, {sql_strip("string_agg(text, '' ORDER BY turn DESC)")} AS plain FROM conversations GROUP BY conv_id""",
)
def canon_snapshot_text(spark, sf):
    """Turns as keyed pieces of a translation, assembled in the reverse of their numbers."""
    from ..operators.conversations import nest_turns

    n = nest_turns(table(spark, sf, "conversations"))
    keyed = F.transform("messages", lambda m, i: F.struct(i.cast("string").alias("k"), m["content"].alias("v")))
    texts = F.map_from_entries(keyed)
    keys = F.reverse(F.transform("messages", lambda m, i: i.cast("string")))
    return n.select("conv_id", translation_text(keys, texts).alias("plain"))


#: Number words: one to nineteen, and the tens.
ONES = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


@query(
    "spoken_ids_written_out",
    """SELECT doc_id, md5(head || (20 + 10 * (doc_id % 8)) || ' and so ' || text) AS tagged_md5,
      md5(head || (21 + 10 * (doc_id % 8) + doc_id % 9) || ' and so ' || text) AS plain_md5
    FROM (SELECT doc_id, text, (doc_id % 11 + 1) || '.' || (doc_id % 19 + 1) || '.' AS head FROM documents)""",
)
def spoken_ids_written_out(spark, sf):
    """Every text behind an id that is spoken out, for the tagging rules and for the plain ones."""
    from ..functions.ids import write_out_ids

    def word(words, n):
        return F.element_at(F.array(*map(F.lit, words)), (n + 1).cast("int"))

    d = F.col("doc_id")
    head = F.concat_ws(" point ", word(ONES, d % 11), word(ONES, d % 19), word(TENS, d % 8))
    rest = F.concat(F.lit(" and so "), "text")
    one_more = F.concat(F.lit(" "), word(ONES, d % 9))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(write_out_ids(F.concat(head, rest))).alias("tagged_md5"),
        F.md5(write_out_ids(F.concat(head, one_more, rest), strict_first=False)).alias("plain_md5"),
    )


@query(
    "unit_split_at_markers",
    f"""WITH b AS (SELECT doc_id, {sql_squeeze('text')} AS f FROM documents),
    u AS (SELECT doc_id, CASE WHEN 2 * length(f) + 27 < 300 THEN [f || ' that is the end of the so ' || f]
      WHEN length(f) >= 121 THEN [lower(replace(replace(f, '’', chr(39)), '‘', chr(39))) || ' that is the end of the sutta', lower(replace(replace(f, '’', chr(39)), '‘', chr(39)))]
      ELSE [lower(replace(replace(f, '’', chr(39)), '‘', chr(39))) || ' that is the end of the sutta ' || lower(replace(replace(f, '’', chr(39)), '‘', chr(39)))] END AS units FROM b)
    SELECT doc_id, (i - 1)::INT AS unit_ord, md5(units[i]) AS text_md5 FROM u, unnest(range(1, len(units) + 1)) t(i)""",
)
def unit_split_at_markers(spark, sf):
    """Every text twice with a mis-heard end marker in between: long ones are cut there."""
    twice = F.concat("text", F.lit(" that is the end of the so "), "text")
    rows = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("teacher_id"), twice.alias("text"))
    return M.split_units(rows).select("doc_id", "unit_ord", F.md5("text").alias("text_md5"))
