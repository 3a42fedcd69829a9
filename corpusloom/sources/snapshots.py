"""Canon translations kept as snapshots, one JSON object per author and id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.ids import translation_text
from ..functions.text import safe_name, strip
from .files import decoded


def read_snapshots(spark: SparkSession, folder: str, separator: str = "") -> DataFrame:
    """``author, canon_id, canon_text`` of ``<author>/<id>.json``; unreadable files are left out."""
    raw = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(folder, wholetext=True)
    parts = F.split(decoded(F.col("_metadata.file_path")), "/")
    parsed = raw.select(
        F.element_at(parts, -2).alias("author"),
        F.regexp_replace(F.element_at(parts, -1), r"\.json\z", "").alias("canon_id"),
        F.from_json("value", schemas.CANON_SNAPSHOT).alias("s"),
        F.try_parse_json("value").isNotNull().alias("ok"),
    )
    text = translation_text(F.col("s.keys_order"), F.col("s.translation_text"), separator)
    return parsed.filter("ok").select("author", "canon_id", text.alias("canon_text"))


def snapshot_key(column: str = "canon_id"):
    """File-name form of a canon id."""
    return safe_name(F.lower(strip(column)))


def fetch_missing(
    wanted: DataFrame, known: DataFrame, fetch: Callable[[str], str | None] | None = None
) -> DataFrame:
    """Known texts plus those an injected ``fetch`` returns for the distinct ids not known.

    Without ``fetch`` nothing is looked up.
    """
    have = known.select("canon_id", "canon_text")
    if fetch is None:
        return have
    ids = wanted.select(strip("canon_id").alias("canon_id")).filter(F.col("canon_id") != "").distinct()
    missing = ids.join(have, "canon_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"canon_id": part["canon_id"], "canon_text": [fetch(i) or "" for i in part["canon_id"]]})

    return have.unionByName(missing.mapInPandas(run, "canon_id string, canon_text string"))
