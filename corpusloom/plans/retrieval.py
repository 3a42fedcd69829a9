"""Vector and hybrid retrieval over chunk rows made of documents and stored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_terms
from ..functions.vectors import cosine_distance, squared_l2
from ..operators import records as R
from ..operators import retrieval as V
from ..operators import substring as S
from ..operators import vectorindex as VX
from ..operators.chunking import chunk_rows
from .corpus import chunks_sql, docs_sql
from .registry import query, table
from .search import lexical_sql, sql_quote
from .standins import records

QUESTION = "thand the ration"
K_RESULTS = 8
SHOWN = ["rank", "pos", "source", "suttaid", "kind", "book", "distance", "lexical"]


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    """The vector asked for: one stored row, read on the driver."""
    row = table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row.embedding]


#: Chunks of one record document that positions leave room for.
CHUNK_ROOM = 1 << 20


def placed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of record documents with the id of their vector; no vector has a negative one."""
    cut = chunk_rows(R.to_documents(records(spark, sf).drop("rec_i")))
    first = (F.col("doc_ord") == 0) & (F.col("chunk_index") == 0)
    # rows without a vector get keys of their own, so that they don't meet in one task
    place = (F.col("pos") * 4 + F.col("doc_ord")) * CHUNK_ROOM + F.col("chunk_index")
    return cut.withColumn("vec_id", F.when(first, F.col("pos")).otherwise(-1 - place)).withColumn("pos", place)


def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of record documents; the first chunk of a record's reading has the vector with ``vec_id = doc_id``."""
    placed = placed_chunks(spark, sf)
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return placed.join(vectors, "vec_id", "left").select(
        "pos", "source", "suttaid", "commentary_id", F.col("lang").alias("conversation_id"), "kind",
        F.when(F.col("lang") == "en", "an1").otherwise("an2").alias("book"), "text", "embedding",
    )


CHUNKS_SQL = f"""RECURSIVE {docs_sql()}, src AS (SELECT pos * 4 + ord AS k, text FROM docs),
  {chunks_sql('src', 'pieces')}, chunks AS (
    SELECT k * {CHUNK_ROOM} + chunk_index AS pos, d.source, suttaid, d.lang AS conversation_id, kind,
      CASE WHEN d.lang = 'en' THEN 'an1' ELSE 'an2' END AS book, chunk AS text, e.embedding::DOUBLE[] AS v
    FROM pieces JOIN docs ON docs.pos = k // 4 AND docs.ord = k % 4 JOIN documents d ON d.doc_id = docs.pos
    LEFT JOIN embeddings e ON e.vec_id = docs.pos AND ord = 0 AND chunk_index = 0),
  q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0)"""


def pool_sql(profile: V.Profile, k: int, source: str = "chunks", tag: str = "") -> str:
    """``pool`` CTE: the candidates of a front end."""
    dist = "1 - list_cosine_similarity(v, qv)" if profile.metric == "cosine" else "list_distance(v, qv) ** 2"
    near = f"SELECT pos, source, suttaid, conversation_id, kind, book, text, {dist} AS distance, -1 AS term FROM {source}, q WHERE v IS NOT NULL"
    terms = search_terms(QUESTION, boost=profile.boost)
    unions = []
    for i, t in enumerate(terms):
        hay, probe = ("text", t) if profile.case_sensitive else ("lower(text)", t.lower())
        only = "" if profile.nearest_only else " AND v IS NULL"
        cut = f" ORDER BY pos LIMIT {V.term_limit(k)}" if profile.nearest_only else ""
        unions.append(
            f"(SELECT pos, source, suttaid, conversation_id, kind, book, text, NULL::DOUBLE AS distance, {i} AS term FROM {source} WHERE contains({hay}, {sql_quote(probe)}){only}{cut})"
        )
    if profile.nearest_only:
        near += f" ORDER BY distance, pos LIMIT {V.vector_limit(k)}"
    key = ", ".join(profile.key) + ", left(text, 200)"
    match = " AND ".join(f"n.{c} = w.{c}" for c in profile.key) + " AND left(n.text, 200) = left(w.text, 200)"
    return f"""near{tag} AS ({near}), words{tag} AS (
      SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY term, pos) AS rn
        FROM ({' UNION ALL '.join(unions)})) WHERE rn = 1), pool{tag} AS (
      SELECT *, {lexical_sql('text', QUESTION)} AS lexical FROM (
        SELECT * FROM near{tag} UNION ALL
        SELECT * FROM words{tag} w WHERE NOT EXISTS (SELECT 1 FROM near{tag} n WHERE {match})))"""


ORDER = "lexical DESC, coalesce(distance, 1e9), term, pos"


def best_sql(n: int, tag: str = "") -> str:
    return f"""best{tag} AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS rank FROM pool{tag}
      ORDER BY rank LIMIT {n})"""


def quota_sql(source: str, k: int, name: str) -> str:
    key = "source, suttaid, kind, book, left(text, 180)"
    return f"""{name}_u AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY rank) AS rn
        FROM {source}) WHERE rn = 1),
      {name}_b AS (SELECT book, row_number() OVER (ORDER BY book) AS i, count(*) OVER () AS n
        FROM (SELECT DISTINCT book FROM {source})),
      {name}_q AS (SELECT u.*, CASE WHEN row_number() OVER (PARTITION BY u.book ORDER BY rank)
          <= {k} // b.n + CASE WHEN b.i <= {k} % b.n THEN 1 ELSE 0 END THEN 0 ELSE 1 END AS fill
        FROM {name}_u u JOIN {name}_b b ON u.book = b.book),
      {name} AS (SELECT * EXCLUDE (fill, rank), row_number() OVER (ORDER BY fill, rank) AS rank FROM {name}_q
        ORDER BY rank LIMIT {k})"""


def dedup_sql(source: str, name: str, cap: int = 14) -> str:
    return f"""{name} AS (SELECT * EXCLUDE (rn, rank), row_number() OVER (ORDER BY rank, pos) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY source, suttaid, kind, left(text, 120) ORDER BY rank) AS rn
        FROM {source}) WHERE rn = 1 ORDER BY rank LIMIT {cap})"""


def pairs_sql(source: str, pool: str, name: str, order: str = ORDER) -> str:
    return f"""{dedup_sql(source, name + '_k', 1000000)},
      {name}_all AS (SELECT suttaid, kd, o FROM (SELECT s.suttaid, t.kd, s.fst * 2 + t.ko AS o
          FROM (SELECT suttaid, min(rank) AS fst FROM {name}_k GROUP BY suttaid) s, (VALUES ('commentary', 0), ('sutta', 1)) t(kd, ko)) a
        WHERE (suttaid, kd) NOT IN (SELECT (suttaid, kind) FROM {name}_k)),
      {name}_found AS (SELECT * EXCLUDE (rn, o), 1000000 + o AS rank FROM (SELECT p.*, n.o,
          row_number() OVER (PARTITION BY p.suttaid, p.kind ORDER BY {order}) AS rn
        FROM {pool} p JOIN {name}_all n ON p.suttaid = n.suttaid AND p.kind = n.kd) WHERE rn = 1),
      {name}_both AS (SELECT * FROM {name}_k UNION ALL BY NAME SELECT * FROM {name}_found),
      {dedup_sql(name + '_both', name)}"""


def kind_sql(source: str, pool: str, kind: str, k: int, name: str) -> str:
    return f"""{name}_x AS (SELECT *, 1000000 AS rank FROM {pool} WHERE kind = '{kind}' ORDER BY {ORDER} LIMIT 1),
      {name}_f AS (SELECT (SELECT count(*) FROM {source} WHERE kind = '{kind}') > 0
        OR (SELECT count(*) FROM {name}_x) = 0 AS keep),
      {name} AS (SELECT * EXCLUDE (rank), row_number() OVER (ORDER BY rank) AS rank FROM (
        SELECT s.* FROM {source} s, {name}_f WHERE keep OR rank <= {k - 1}
        UNION ALL BY NAME SELECT x.* FROM {name}_x x, {name}_f WHERE NOT keep))"""


def shown_sql(name: str) -> str:
    return f"SELECT rank, pos, source, suttaid, kind, book, round(coalesce(distance, -1), 6) AS distance, lexical FROM {name}"


def shown(df: DataFrame) -> DataFrame:
    return df.select(
        "rank", "pos", "source", "suttaid", "kind", "book",
        F.round(F.coalesce("distance", F.lit(-1.0)), 6).alias("distance"), "lexical",
    )


def _vector_rows(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("pos"), F.col("label").cast("string").alias("book"), "embedding")


@query(
    "vector_topk_cosine",
    """SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) AS distance FROM embeddings,
    (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
    ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q), vec_id LIMIT 50""",
)
def vector_topk_cosine(spark, sf):
    top = V.nearest(_vector_rows(spark, sf), query_vector(spark, sf), 50, "cosine")
    return top.select(F.col("pos").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query(
    "vector_topk_l2",
    """SELECT vec_id, round(list_distance(embedding::DOUBLE[], q) ** 2, 6) AS distance FROM embeddings,
    (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
    ORDER BY list_distance(embedding::DOUBLE[], q) ** 2, vec_id LIMIT 80""",
)
def vector_topk_l2(spark, sf):
    top = V.nearest(_vector_rows(spark, sf), query_vector(spark, sf), V.vector_limit(8))
    return top.select(F.col("pos").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query(
    "vector_pair_distances",
    """SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine,
    round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2, 6) AS l2
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def vector_pair_distances(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select(
        "vec_id",
        F.round(cosine_distance("embedding", "other"), 6).alias("cosine"),
        F.round(squared_l2("embedding", "other"), 6).alias("l2"),
    )


TERMS = search_terms(QUESTION)


@query(
    "keyword_scan_terms",
    f"""WITH {CHUNKS_SQL}, hits AS (SELECT pos, suttaid, min(term) AS term FROM (
      {' UNION ALL '.join(f"SELECT pos, suttaid, {i} AS term FROM chunks WHERE contains(lower(text), {sql_quote(t)})" for i, t in enumerate(TERMS))}
    ) GROUP BY pos, suttaid) SELECT * FROM hits""",
)
def keyword_scan_terms(spark, sf):
    rows = V.keyword_rows(chunk_table(spark, sf), TERMS, case_sensitive=False, per_term=None)
    return rows.select("pos", "suttaid", "term")


@query(
    "keyword_scan_limited",
    f"""WITH {CHUNKS_SQL} SELECT * FROM (
      {' UNION ALL '.join(f"(SELECT pos, {i} AS term FROM chunks WHERE contains(text, {sql_quote(t)}) ORDER BY pos LIMIT 160)" for i, t in enumerate(TERMS))})""",
)
def keyword_scan_limited(spark, sf):
    rows = V.keyword_rows(chunk_table(spark, sf), TERMS, case_sensitive=True, per_term=V.term_limit(8))
    return rows.select("pos", "term")


@query(
    "hybrid_retrieve_command_line",
    f"WITH {CHUNKS_SQL}, {pool_sql(V.COMMAND_LINE, 5)}, {best_sql(5)} {shown_sql('best')}",
)
def hybrid_retrieve_command_line(spark, sf):
    return shown(V.search_command_line(chunk_table(spark, sf), QUESTION, query_vector(spark, sf), 5))


@query(
    "hybrid_candidates_bundle",
    f"WITH {CHUNKS_SQL}, {pool_sql(V.BUNDLE, 8)}, {best_sql(32)} {shown_sql('best')}",
)
def hybrid_candidates_bundle(spark, sf):
    pool = V.candidates(chunk_table(spark, sf), QUESTION, query_vector(spark, sf), 8, V.BUNDLE)
    return shown(V.best(pool, V.candidate_limit(8)))


@query(
    "vector_quota_pick",
    f"WITH {CHUNKS_SQL}, {pool_sql(V.BUNDLE, 8)}, {best_sql(32)}, {quota_sql('best', 8, 'picked')} {shown_sql('picked')}",
)
def vector_quota_pick(spark, sf):
    pool = V.candidates(chunk_table(spark, sf), QUESTION, query_vector(spark, sf), 8, V.BUNDLE)
    return shown(V.quota_pick(V.best(pool, V.candidate_limit(8)), 8))


BUNDLE_STEPS = f"""{CHUNKS_SQL}, {pool_sql(V.BUNDLE, 8)}, {best_sql(32)}, {quota_sql('best', 8, 'picked')},
  {pairs_sql('picked', 'pool', 'paired')}"""


@query("pair_injection", f"WITH {BUNDLE_STEPS} {shown_sql('paired')}")
def pair_injection(spark, sf):
    pool = V.candidates(chunk_table(spark, sf), QUESTION, query_vector(spark, sf), 8, V.BUNDLE)
    top = V.bounded(V.quota_pick(V.best(pool, V.candidate_limit(8)), 8), 8)
    return shown(V.inject_pairs(top, V.neighbours(top, pool)))


BUNDLE_SQL = f"""{BUNDLE_STEPS}, {kind_sql('paired', 'pool', 'commentary', 8, 'withc')},
  {kind_sql('withc', 'pool', 'sutta', 8, 'withs')}, {dedup_sql('withs', 'final')}"""


@query("hybrid_retrieve_bundle", f"WITH {BUNDLE_SQL} {shown_sql('final')}")
def hybrid_retrieve_bundle(spark, sf):
    return shown(V.search_bundle(chunk_table(spark, sf), QUESTION, query_vector(spark, sf), K_RESULTS))


@query(
    "kind_guarantee",
    f"""WITH {CHUNKS_SQL}, {pool_sql(V.BUNDLE, 8)}, best AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS rank
      FROM pool WHERE kind = 'chain' ORDER BY rank LIMIT 6), {kind_sql('best', 'pool', 'commentary', 6, 'withc')},
    {kind_sql('withc', 'pool', 'sutta', 6, 'withs')} {shown_sql('withs')}""",
)
def kind_guarantee(spark, sf):
    pool = V.candidates(chunk_table(spark, sf), QUESTION, query_vector(spark, sf), 8, V.BUNDLE)
    top = V.bounded(V.best(pool.filter("kind = 'chain'"), 6), 6)
    near = V.neighbours(top, pool)
    for kind in ("commentary", "sutta"):
        top = V.guarantee_kind(top, near, kind, 6)
    return shown(top)


def book_sql(book: str, k: int) -> str:
    t = f"_{book}"
    return f"""c{t} AS (SELECT * FROM chunks WHERE book = '{book}'), {pool_sql(V.SCRIPTURE, k, 'c' + t, t)},
      {best_sql(max(4 * k, 20), t)}, cut{t} AS (SELECT * FROM best{t} WHERE rank <= {k}),
      {pairs_sql('cut' + t, 'pool' + t, 'paired' + t)}, {kind_sql('paired' + t, 'pool' + t, 'commentary', k, 'wc' + t)},
      {kind_sql('wc' + t, 'pool' + t, 'sutta', k, 'ws' + t)}, {dedup_sql('ws' + t, 'final' + t)}"""


@query(
    "hybrid_retrieve_books",
    f"""WITH {CHUNKS_SQL}, {book_sql('an1', 4)}, {book_sql('an2', 4)}, joined AS (
      SELECT * FROM final_an1 UNION ALL BY NAME SELECT * REPLACE (rank + 1000 AS rank) FROM final_an2),
    {dedup_sql('joined', 'merged', 1000000)}, ranked AS (SELECT * EXCLUDE (rank), row_number() OVER (
      ORDER BY lexical DESC, coalesce(distance, 1e9), rank) AS rank FROM merged),
    {quota_sql('ranked', 8, 'picked')}, rpool AS (SELECT * EXCLUDE (rank) REPLACE (rank AS term) FROM ranked),
    {pairs_sql('picked', 'rpool', 'pp')}, {dedup_sql('pp', 'final')} {shown_sql('final')}""",
)
def hybrid_retrieve_books(spark, sf):
    return shown(V.search_books(chunk_table(spark, sf), QUESTION, query_vector(spark, sf), 8))


TRANSCRIPT_SQL = f"WITH {CHUNKS_SQL}, {pool_sql(V.TRANSCRIPTS, 6)}, {best_sql(24)}, cut AS (SELECT * FROM best WHERE rank <= 6)"


@query("hybrid_retrieve_transcripts", f"{TRANSCRIPT_SQL} {shown_sql('cut')}")
def hybrid_retrieve_transcripts(spark, sf):
    return shown(V.search_transcripts(chunk_table(spark, sf), QUESTION, query_vector(spark, sf), 6))


@query(
    "context_expand",
    f"""{TRANSCRIPT_SQL}, around AS (SELECT * FROM chunks WHERE conversation_id = (SELECT conversation_id FROM cut WHERE rank = 1)
      ORDER BY pos LIMIT 50), both_rows AS (
      SELECT pos, source, conversation_id, text, rank, 0 AS fresh FROM cut UNION ALL
      SELECT pos, source, conversation_id, text, 1000000 + row_number() OVER (ORDER BY pos), 1 FROM around)
    SELECT row_number() OVER (ORDER BY rank) AS rank, pos, source FROM (
      SELECT *, row_number() OVER (PARTITION BY source, conversation_id, left(text, 200) ORDER BY rank) AS rn FROM both_rows)
    WHERE fresh = 0 OR rn = 1 ORDER BY rank LIMIT 8""",
)
def context_expand(spark, sf):
    chunks = chunk_table(spark, sf)
    found = V.search_transcripts(chunks, QUESTION, query_vector(spark, sf), 6)
    return V.expand_context(found, chunks).select("rank", "pos", "source")


PASSAGE_SQL = f"""{BUNDLE_SQL}, ex AS (SELECT *, min(rank) OVER (PARTITION BY suttaid) AS fst,
      row_number() OVER (PARTITION BY suttaid, kind ORDER BY rank) AS rn, (max(CASE WHEN kind = 'chain' THEN 1 ELSE 0 END) OVER ()) = 1 AS chains
      FROM final), ko AS (SELECT *, CASE WHEN kind = 'sutta' AND rn = 1 THEN 0 WHEN kind = 'commentary' AND rn <= 2 THEN 1
      WHEN kind = 'chain' AND rn = 1 AND chains THEN 2 END AS ko FROM ex), od AS (SELECT *, row_number() OVER (
      ORDER BY (ko IS NULL)::INT, CASE WHEN ko IS NOT NULL THEN fst END, ko, rank) AS o FROM ko), lf AS (
      SELECT *, row_number() OVER (PARTITION BY source, suttaid, kind, left(text, 80) ORDER BY o) AS again FROM od
      WHERE ko IS NULL OR o <= 10), passages AS (SELECT * EXCLUDE (rank), row_number() OVER (ORDER BY o) AS rank FROM lf
      WHERE ko IS NOT NULL OR again = 1 ORDER BY rank LIMIT 10)"""


@query("passage_order", f"WITH {PASSAGE_SQL} SELECT rank, pos, suttaid, kind, book FROM passages")
def passage_order(spark, sf):
    found = V.search_bundle(chunk_table(spark, sf), QUESTION, query_vector(spark, sf), K_RESULTS)
    return V.order_passages(found).select("rank", "pos", "suttaid", "kind", "book")


@query(
    "source_keys",
    f"""WITH {BUNDLE_SQL} SELECT string_agg(suttaid || ':' || kind || ':c' || suttaid, '|' ORDER BY rank) AS sources FROM (
      SELECT suttaid, kind, min(rank) AS rank FROM final GROUP BY suttaid, kind)""",
)
def source_keys(spark, sf):
    found = V.search_bundle(chunk_table(spark, sf), QUESTION, query_vector(spark, sf), K_RESULTS)
    return V.source_keys(found).select(F.array_join("sources", "|").alias("sources"))


#: Lists of the stored vector index and results per query.
INDEX_LISTS, INDEX_N = 16, 50


@query(
    "vector_index_many",
    f"""WITH p AS (SELECT q.vec_id AS qid, e.vec_id, list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) ** 2 AS d
      FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) AS rank FROM p)
    SELECT qid, vec_id, rank, round(d, 6) AS distance FROM r WHERE rank <= {INDEX_N}""",
)
def vector_index_many(spark, sf):
    """The vectors nearest to every twentieth one, by the stored index over all its lists: the exact result."""
    rows = _vector_rows(spark, sf).select("pos", "embedding")
    queries = rows.where(F.col("pos") % 20 == 0).select(F.col("pos").alias("qid"), F.col("embedding").alias("vector"))
    found = VX.search(VX.build(rows, INDEX_LISTS), queries, INDEX_N)
    return found.select("qid", F.col("pos").alias("vec_id"), "rank", F.round("distance", 6).alias("distance"))


@query(
    "vector_index_cosine",
    """SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) AS distance FROM embeddings,
    (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
    ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q), vec_id LIMIT 50""",
)
def vector_index_cosine(spark, sf):
    """The exact scan's result from the stored index, by directions."""
    rows = _vector_rows(spark, sf).select("pos", "embedding")
    query = rows.where("pos = 0").select(F.col("pos").alias("qid"), F.col("embedding").alias("vector"))
    found = VX.search(VX.build(rows, INDEX_LISTS, "cosine"), query, 50)
    return found.select(F.col("pos").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query(
    "substring_index_terms",
    f"""WITH {CHUNKS_SQL}, hits AS (SELECT pos, suttaid, min(term) AS term FROM (
      {' UNION ALL '.join(f"SELECT pos, suttaid, {i} AS term FROM chunks WHERE contains(lower(text), {sql_quote(t)})" for i, t in enumerate(TERMS))}
    ) GROUP BY pos, suttaid) SELECT * FROM hits""",
)
def substring_index_terms(spark, sf):
    """Chunks that hold a term, through the trigram index of all chunks."""
    # without their vectors: a chunk that had several would still be one row here
    chunks = placed_chunks(spark, sf).select("pos", "suttaid", "text")
    found = S.find(S.build(chunks), [t for t in TERMS])
    return found.groupBy("pos", "suttaid").agg(F.min("term").alias("term"))


#: Rare and short terms, in any case.
RARE_TERMS = ["Copyright", "password", "@example", "zq", "tionsh the"]


@query(
    "substring_index_counts",
    f"""WITH {CHUNKS_SQL} SELECT * FROM (
      {' UNION ALL '.join(f"SELECT {i} AS term, count(*) AS n, sum(pos) AS places FROM chunks WHERE contains(lower(text), {sql_quote(t.lower())}) HAVING count(*) > 0" for i, t in enumerate(RARE_TERMS))})""",
)
def substring_index_counts(spark, sf):
    """How many chunks hold each of several rare terms, and where, through the trigram index."""
    chunks = chunk_table(spark, sf).select("pos", "text")
    found = S.find(S.build(chunks), RARE_TERMS)
    return found.groupBy("term").agg(F.count("*").alias("n"), F.sum("pos").alias("places"))
