"""Portable vector tables: manifest with shards, single bundles, resolution order."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import constants as K
from .files import path_exists


def parent_of(uri: str) -> str:
    """The folder of an object, with its trailing slash."""
    return re.sub(r"[^/]+$", "", uri.strip())


def resolve(uri: str, base: str) -> str:
    """A shard's own location: absolute as given, else below the manifest's folder."""
    u = (uri or "").strip()
    if not u:
        raise ValueError("shard entry without uri")
    return u if re.match(r"^([a-z][a-z0-9+.-]*:|/)", u) else base.rstrip("/") + "/" + u.lstrip("/")


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.explode("chunks").alias("c")).filter(F.col("c").isNotNull()).select("c.*")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of one bundle object; an empty bundle is an error."""
    rows = _rows(spark.read.schema(schemas.BUNDLE).option("multiLine", True).json(path))
    if rows.isEmpty():
        raise ValueError("bundle without chunks")
    return rows


def read_manifest(spark: SparkSession, path: str, formats: tuple[str, ...] = (K.MANIFEST_FORMAT,)) -> dict:
    row = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path).first()
    if row is None or (row.format or "").strip() not in formats:
        raise ValueError(f"unsupported manifest format: {row.format if row else None!r}")
    if not row.shards:
        raise ValueError("manifest without shards")
    return row.asDict(recursive=True)


def read_manifest_rows(
    spark: SparkSession,
    path: str,
    formats: tuple[str, ...] = (K.MANIFEST_FORMAT,),
    shard_formats: tuple[str, ...] = (K.SHARD_FORMAT,),
) -> DataFrame:
    """Chunk rows of all shards of a manifest.

    A shard is a JSON object with ``chunks`` or a folder of chunk lines as written by
    this library. Format and embedding model are checked while the rows are read.
    """
    manifest = read_manifest(spark, path, formats)
    model = (manifest["embedding_model"] or "").strip()
    base = parent_of(path)
    objects, folders = [], []
    for shard in manifest["shards"]:
        place = resolve(shard["uri"], base)
        (objects if place.endswith(".json") else folders).append(place)
    parts = []
    if objects:
        raw = spark.read.schema(schemas.SHARD).option("multiLine", True).json(objects)
        fits = F.trim(F.coalesce("format", F.lit(""))).isin(*shard_formats)
        same = F.lit(model == "") | (F.trim(F.coalesce("embedding_model", F.lit(""))).isin("", model))
        full = F.coalesce(F.size("chunks") > 0, F.lit(False))
        checked = raw.withColumn(
            "chunks",
            F.when(~fits, F.raise_error(F.lit("unsupported shard format")))
            .when(~same, F.raise_error(F.lit("embedding model of shard and manifest differ")))
            .when(~full, F.raise_error(F.lit("shard without chunks")))
            .otherwise(F.col("chunks")),
        )
        parts.append(_rows(checked))
    if folders:
        ddl = "book string, kind string, suttaid string, commentary_id string, source string, text string, embedding array<double>"
        parts.append(spark.read.schema(ddl).json(folders))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bundle_metadata(manifest: dict) -> dict:
    return {
        "embedding_model": manifest.get("embedding_model") or "",
        "format": f"{manifest.get('format')}+merged",
        "manifest_shard_count": len(manifest.get("shards") or []),
        "manifest_version": manifest.get("version"),
    }


def load_first(spark: SparkSession, folder: str, manifest: str = "", manifest_uri: str = "", bundle: str = "", bundle_uri: str = "") -> DataFrame:
    """The vector table from the first place that names one.

    Order: given manifest, manifest by URI (falling back to the bundle URI if that
    fails), given bundle, bundle by URI, then the conventional names in ``folder``.
    """
    if manifest:
        return read_manifest_rows(spark, manifest)
    if manifest_uri:
        try:
            return read_manifest_rows(spark, manifest_uri)
        except Exception:
            if bundle_uri:
                return read_bundle(spark, bundle_uri)
            raise
    choices: list[tuple[str, Callable[[SparkSession, str], DataFrame]]] = [
        (bundle, read_bundle),
        (bundle_uri, read_bundle),
    ]
    for place, read in choices:
        if place:
            return read(spark, place)
    for name, read in (("vector_corpus/manifest.json", read_manifest_rows), ("vector_bundle.json", read_bundle)):
        place = f"{folder.rstrip('/')}/{name}"
        if path_exists(spark, place):
            return read(spark, place)
    raise FileNotFoundError(f"no vector table in {folder}")
