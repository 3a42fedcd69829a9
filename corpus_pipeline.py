"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; its result is written and read again as the next one's
``docs``. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import packing, pii, positional, sketchjoin, toxicity
from corpusloom.llm.common import free_name, row_key, small_batches, stored, without


#: All stages run in one session, whose memory grows from stage to stage: their batches are half as large as usual.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def _small(spark: SparkSession) -> SparkSession:
    """``BATCHES`` where the session leaves them open, else what it has set itself."""
    return small_batches(spark, BATCHES)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _small(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half, with their columns as given (also one named toxic_score);
    trained on the labels of those at hand."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    name = free_name([*docs.columns, "toxic_spans"], "toxic_score")
    return toxicity.scores(docs, model, name=name).where(F.col(name) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row: that of least doc_id (null ids last), and of least row key among these.

    Rows are told apart by all their columns, whatever their ids; of rows equal in all, one stays too. Documents without
    words are in no class and all stay.
    """
    _small(spark)
    named = docs.withColumn("doc_id", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", row_key(docs).alias("key")))
    classes = sketchjoin.near_duplicates(named).where("n_shingles > 0")
    moved = F.col("doc_id.key") != F.col("component_id.key")
    rows = classes.groupBy(F.col("doc_id.key").alias("key")).agg(F.max(moved).alias("gone"), F.count("*").alias("n"))
    rows = stored(rows.where("gone OR n > 1"), "copies")
    return without(docs, rows.where("gone"), rows.where("NOT gone"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words lie in benchmark windows, whatever their ids."""
    benchmark = _table(spark, sf_dir, "benchmark")
    found = positional.contamination(docs.select(row_key(docs).alias("doc_id"), "text"), benchmark)
    return without(docs, found.where(positional.is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("key")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data in their texts replaced by its kind; n_chars is that of the new text."""
    _small(spark)
    return pii.redacted(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in near-equal windows of at most 2048."""
    _small(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_windows),
]

#: The random fields, the tokenizer and differencing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
