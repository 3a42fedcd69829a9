"""The registered queries of the subpackage: thin, each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, conversation_repair, packing, pii, positional, pst, repeats, sketchjoin, spotsigs, squares, toolcalls, toxicity, urlrules
from .common import fold, small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_bit_packed_tokens")
def bit_packed_tokens(spark, sf_dir):
    """Token files with fixed-width bit fields, written and read back."""
    return bitpack.read_tokens(bitpack.write_tokens(table(spark, sf_dir, "documents")))


@query("op3_decontamination")
def decontamination(spark, sf_dir):
    """Benchmark windows of 13 words found in the documents through a positional index."""
    found = positional.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        positional.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@query("op10_packed_windows")
def packed_windows(spark, sf_dir):
    """Sequences of at most 2048 tokens by multiway differencing."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_personal_data")
def personal_data(spark, sf_dir):
    """Fixed patterns of personal data, and spans that a conditional random field adds."""
    found = pii.find_spans(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op6_toxicity")
def toxic_documents(spark, sf_dir):
    """Toxicity of every document by marginals of a conditional random field."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(F.pmod(fold(), F.lit(5)) == 0, F.lit(False)).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op9_near_duplicates")
def near_duplicates(spark, sf_dir):
    """Classes of documents under five-word-shingle Jaccard of 0.75 or more, through parity sketches."""
    return sketchjoin.near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_spot_signatures")
def spot_signatures(spark, sf_dir):
    """SpotSigs fingerprints of texts and edited texts, and their likeness."""
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op7_suffix_tree_scores")
def suffix_tree_scores(spark, sf_dir):
    """log10 probabilities of every text by a probabilistic suffix tree, and by single words."""
    return pst.scores(table(spark, sf_dir, "documents"))


@query("op5_repeated_strings")
def repeated_strings(spark, sf_dir):
    """Bytes in 200-byte strings that start elsewhere too, by induced suffix sorting of the runs that share an anchor."""
    return repeats.repeated_spans(table(spark, sf_dir, "documents"))


#: Stand-in tools for the calls made of conversations.
TOOLS = [
    ("search", "query", "string", True, 1.0, 400.0),
    ("search", "limit", "integer", True, 1.0, 50.0),
    ("note", "text", "string", True, None, None),
    ("note", "pinned", "boolean", False, None, None),
]

OP8_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id, text,
         CASE WHEN length(text) % 3 = 0 THEN 'search' WHEN length(text) % 3 = 1 THEN 'note' ELSE 'drop' END AS name,
         CASE WHEN turn > 0 THEN conv_id || ':' || (turn // 2) END AS before
  FROM conversations WHERE role = 'user'),
known AS (SELECT c.*, b.call_id AS dep FROM calls c LEFT JOIN calls b ON b.call_id = c.before),
lv AS (
  SELECT call_id, 0 AS level FROM known WHERE dep IS NULL
  UNION ALL
  SELECT k.call_id, lv.level + 1 FROM known k JOIN lv ON k.dep = lv.call_id),
results AS (SELECT conv_id || ':' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant')
SELECT k.conv_id, k.call_id, k.turn, lv.level,
       row_number() OVER (PARTITION BY k.conv_id ORDER BY lv.level, k.turn) - 1 AS place, k.name,
       CASE k.name
         WHEN 'search' THEN concat_ws(', ',
              CASE WHEN k.turn % 60 < 1 OR k.turn % 60 > 50 THEN 'range of limit' END,
              CASE WHEN length(k.text) < 1 OR length(k.text) > 400 THEN 'range of query' END)
         WHEN 'note' THEN CASE WHEN k.turn % 5 = 0 THEN 'kind of pinned, missing text' ELSE '' END
         ELSE 'no such tool' END AS errors,
       r.call_id IS NOT NULL AS linked,
       '{"arguments":' || CASE k.name
         WHEN 'search' THEN '{"limit":' || (k.turn % 60) || ',"query":' || to_json(k.text) || '}'
         WHEN 'note' THEN CASE WHEN k.turn % 5 = 0 THEN '{"pinned":"yes"}' ELSE '{"pinned":false,"text":' || to_json(k.text) || '}' END
         ELSE '{}' END
       || ',"call_id":' || to_json(k.call_id) || ',"depends":[' || coalesce(to_json(k.dep)::VARCHAR, '') || '],"name":' || to_json(k.name)
       || CASE WHEN r.call_id IS NOT NULL THEN ',"result":' || to_json(r.content) ELSE '' END || '}' AS line
FROM known k JOIN lv USING (call_id) LEFT JOIN results r ON r.call_id = k.call_id
"""


@query("op8_tool_calls", OP8_SQL)
def tool_calls(spark, sf_dir):
    """User turns as tool calls (a call depends on that of half its turn), assistant turns as results of the turn before."""
    turns = table(spark, sf_dir, "conversations")
    at = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    turn, size = F.col("turn"), F.length("text") % 3
    name = F.when(size == 0, "search").when(size == 1, "note").otherwise("drop")
    note = F.when(turn % 5 == 0, F.lit('{"pinned": "yes"}')).otherwise(F.to_json(F.struct("text", F.lit(False).alias("pinned"))))
    arguments = F.when(size == 0, F.to_json(F.struct(F.col("text").alias("query"), (turn % 60).alias("limit")))).when(size == 1, note).otherwise("{ }")
    half = F.when(turn > 0, F.array(at(F.floor(turn / 2)))).otherwise(F.array().cast("array<string>"))
    calls = turns.where("role = 'user'").select("conv_id", "turn", at(turn).alias("call_id"), name.alias("name"), arguments.alias("arguments"), half.alias("depends"))
    results = turns.where("role = 'assistant'").select(at(turn - 1).alias("call_id"), F.col("text").alias("content"))
    schemas = spark.createDataFrame(TOOLS, "name string, field string, kind string, required boolean, low double, high double")
    linked = toolcalls.link(calls, results, schemas)
    return linked.withColumn("errors", F.array_join("errors", ", "))


#: Rules of the URL filter: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

OP13_SQL = """
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                               ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests),
fits AS (
  SELECT c.page_id, max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(r.v, length(r.h || r.p)) AS verdict
  FROM cut c JOIN rules r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p)
  GROUP BY c.page_id)
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM cut c LEFT JOIN fits f USING (page_id)
"""


@query("op13_url_rules", OP13_SQL)
def url_rules(spark, sf_dir):
    """Verdict of the longest rule on every page's URL, by a sort-merge sweep over reversed-host keys."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judged(table(spark, sf_dir, "pages"), rules)


def damaged_words(docs):
    """``docs`` (doc_id, text) with the words of every tenth document, by hash of its id, repeating from some word on."""
    h = fold()
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    planted = F.coalesce((h % 10 == 0) & (F.size("words") > 0), F.lit(False))
    n = F.size("words").cast("long")
    first = g % n
    period = 1 + F.floor((n - first) / (3 + g % 8))
    place = lambda i: F.when(i < F.col("first"), i).otherwise(F.col("first") + (i - F.col("first")) % F.col("period"))
    repeated = F.array_join(F.transform("words", lambda _, i: F.get("words", place(i.cast("long")).cast("int"))), " ")
    cut = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"))
    at = cut.select("*", planted.alias("planted"), F.when(planted, first).alias("first"), F.when(planted, period).alias("period"))
    return at.select("doc_id", F.when(F.col("planted"), repeated).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def periodic_runs(spark, sf_dir):
    """Maximal runs of repeating words in every text, by square catchers over power-of-two blocks."""
    found = squares.periodic_runs(damaged_words(table(spark, sf_dir, "documents")))
    key = lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))
    best = F.array_max(F.transform("runs", key))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    found = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def damaged_turns(turns):
    """``turns`` with faults dealt by a hash of conversation and turn; nulls become one blank."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(h == 3, 2).otherwise(1)))
    rows = turns.where(h != 0).select("conv_id", "turn", F.when(h == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"), copies.alias("copy"))
    return rows.drop("copy")


@query("op11_conversation_repair")
def conversation_repair_(spark, sf_dir):
    """Damaged conversations: their faults, the cheapest edits that repair them, and a digest of the repaired turns."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, repaired = conversation_repair.repair(damaged_turns(turns))
    hashed = conversation_repair.digests(repaired)
    all_ = turns.select("conv_id").distinct()
    same = lambda other: F.col("conv_id").eqNullSafe(F.col(other))
    joined = all_.join(report.withColumnRenamed("conv_id", "told"), same("told"), "left").join(hashed.withColumnRenamed("conv_id", "hashed"), same("hashed"), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
