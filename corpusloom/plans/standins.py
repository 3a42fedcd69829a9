"""How the given tables stand in for the application's own data.

``documents`` plays the structured records and the transcripts, ``benchmark`` the
canon corpus, ``conversations`` the chat log, ``embeddings`` the stored vectors
(``vec_id = doc_id`` is a convention of this repository), ``labels`` earlier
annotations, ``events`` the append log and ``pages`` the marked-up text.
Every derivation has a SQL twin below, used by the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import strip
from .registry import table

#: White space for the SQL side: the same code points as the library's own class.
SQL_WS = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def sql_squeeze(expr: str) -> str:
    return f"trim(regexp_replace(coalesce({expr}, ''), '{SQL_WS}+', ' ', 'g'), ' ')"


def sql_strip(expr: str) -> str:
    return f"regexp_replace(coalesce({expr}, ''), '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


def sql_norm(expr: str) -> str:
    return f"lower({sql_squeeze(expr)})"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records: first line as reading, the rest as commentary, first words as chain items."""
    d = table(spark, sf_dir, "documents", spread_by="doc_id")
    number = F.concat(
        (F.col("doc_id") % 11 + 1).cast("string"), F.lit("."), F.floor(F.col("doc_id") / 22).cast("string")
    )
    cut = F.instr("text", "\n")
    words = F.split(strip("text"), f"[{K.WS_CLASS}]+", 4)
    items = F.filter(F.slice(words, 1, 3), lambda w: w != "")
    chain = F.struct(
        items.alias("items"),
        F.size(items).alias("count"),
        (F.col("lang") == "en").alias("is_ordered"),
        F.concat("lang", F.lit("-"), "source").alias("category"),
    )
    return d.select(
        F.col("doc_id").alias("pos"),
        F.col("doc_id").alias("rec_i"),
        number.alias("sutta_id"),
        F.concat(F.lit("AN "), number).alias("suttaid"),
        F.lit("").alias("commentary_id"),
        F.when(cut > 0, F.substr("text", F.lit(1), cut - 1)).otherwise(F.col("text")).alias("sutta"),
        F.when(cut > 0, F.substr("text", cut + 1)).otherwise(F.lit("")).alias("commentary"),
        F.lit("").alias("commentry"),
        F.when(F.col("lang") != "de", chain).alias("chain"),
        "source",
        "lang",
    )


RECORDS_SQL = f"""records AS (
  SELECT doc_id AS pos, doc_id AS rec_i,
    (doc_id % 11 + 1)::VARCHAR || '.' || (doc_id // 22)::VARCHAR AS sutta_id,
    'AN ' || (doc_id % 11 + 1)::VARCHAR || '.' || (doc_id // 22)::VARCHAR AS suttaid,
    CASE WHEN instr(text, chr(10)) > 0 THEN substring(text, 1, instr(text, chr(10)) - 1) ELSE text END AS sutta,
    CASE WHEN instr(text, chr(10)) > 0 THEN substring(text, instr(text, chr(10)) + 1) ELSE '' END AS commentary,
    lang <> 'de' AS chained,
    CASE WHEN lang <> 'de' THEN list_filter(string_split({sql_squeeze('text')}, ' '), lambda w: w <> '')[1:3] END AS items,
    CASE WHEN lang <> 'de' THEN lang || '-' || source END AS category,
    lang = 'en' AS is_ordered, source, lang
  FROM documents)"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript files: one text per document."""
    return table(spark, sf_dir, "documents", spread_by="doc_id").select(
        F.col("doc_id").alias("file_ord"),
        F.concat(F.lit("talk_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        "text",
    )


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
