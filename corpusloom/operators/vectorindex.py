"""A stored vector index: inverted lists around trained centroids, with one-byte codes that bound every distance.

Each vector belongs to the list of its nearest centroid and is kept twice: as a code - its difference to the centroid,
one byte per dimension, with the length of what the rounding lost - and whole. A search takes the lists nearest to the
query, without those whose radius shows that they hold nothing near enough. The codes of these lists give each
vector's distance from below and from above. Only vectors that may still be among the first ``n`` are read whole. So
over all lists the result is that of the exact scan; over fewer lists it lacks only what lies in other lists.

Lists are partitions of the stored tables, so a search reads the folders of its lists only. Codes are packed in
tiles of bounded size, and queries in blocks; a block meets a tile as one row, so neither a long list nor many
queries for one list end in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, squared_l2, usable_vector
from ..storage import shared_folder, stored
from .dedup import top_per_key

#: Vectors of one tile, queries of one block.
TILE, BLOCK = 1024, 64
#: Vectors that centroids are trained on, per list; and the most bytes of centroids that are sent to tasks.
SAMPLE, SENT = 256, 64 << 20
#: Room for the rounding of sums.
EPSILON = 1e-9

CODE = "array<struct<pos:long,scale:double,slack:double,code:binary>>"


@dataclass(frozen=True)
class VectorIndex:
    """The tables of an index: ``lists`` (list, centroid, radius, n), ``tiles`` (list, tile, rows), ``vectors`` (list, pos, embedding)."""

    lists: DataFrame
    tiles: DataFrame
    vectors: DataFrame
    metric: str
    size: int


def _directions(rows: np.ndarray, metric: str) -> np.ndarray:
    """What is compared by Euclidean distance: the vectors, or their directions for the cosine."""
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None] if metric == "cosine" else rows


def _matrix(column, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def comparable(vectors: DataFrame, size: int, metric: str) -> DataFrame:
    """Vectors that have a distance to a query of ``size`` numbers; the exact scan puts all others last."""
    rows = vectors.where(usable_vector("embedding") & (F.size("embedding") == size))
    rows = rows.where(~F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.where(F.exists("embedding", lambda x: x != 0)) if metric == "cosine" else rows


def train(rows: DataFrame, lists: int, metric: str, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Centroids by k-means over the ``lists * sample`` vectors (all, if there are fewer) whose hashed positions are least."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    doubles = F.transform("embedding", lambda x: x.cast("double"))
    if metric == "cosine":
        length = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x))
        doubles = F.transform(doubles, lambda x: x / length)
    some = rows.orderBy(F.xxhash64("pos"), "pos").limit(lists * sample).select(array_to_vector(doubles).alias("features"))
    some = stored(some.select("features"), "sample")
    model = KMeans(k=lists, seed=seed, maxIter=10, initMode="random").fit(some)
    return np.array(model.clusterCenters(), np.float64)


def build(vectors: DataFrame, lists: int, metric: str = "l2", sample: int = SAMPLE) -> VectorIndex:
    """Index ``vectors`` (pos: unique, embedding). Training sees a bounded sample, the index holds every comparable vector.

    The number of dimensions is that of most vectors; vectors of another, empty, null or (for the cosine) zero vectors are
    not comparable and not in the index.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError("the metric is l2 or cosine")
    spark = vectors.sparkSession
    common = vectors.where(usable_vector("embedding")).groupBy(F.size("embedding").alias("size")).count()
    first = common.orderBy(F.desc("count"), "size").first()
    if first is None:
        raise ValueError("there is no vector to index")
    size = first["size"]
    if lists * size * 8 > SENT:
        raise ValueError(f"centroids of more than {SENT} bytes can't be sent to tasks; use fewer lists")
    rows = comparable(vectors.select("pos", "embedding"), size, metric)
    sent = spark.sparkContext.broadcast(train(rows, lists, metric, sample))

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        centroids = sent.value
        length = (centroids * centroids).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _directions(_matrix(batch.column("embedding"), size), metric)
            own = (length[None] - 2 * x @ centroids.T).argmin(axis=1)
            rest = x - centroids[own]
            scale = np.maximum(np.abs(rest).max(axis=1) / 127, 1e-300)
            code = np.rint(rest / scale[:, None]).astype(np.int8)
            slack = np.sqrt(((rest - code * scale[:, None]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own.astype(np.int32)), batch.column("pos"), pa.array(np.sqrt((rest * rest).sum(axis=1))), pa.array(scale), pa.array(slack),
                    pa.array([c.tobytes() for c in code], pa.binary()), batch.column("embedding"),
                ],
                ["list", "pos", "rest", "scale", "slack", "code", "embedding"],
            )

    kind = rows.schema["embedding"].dataType.simpleString()
    placed = rows.select(F.col("pos").cast("long"), "embedding").mapInArrow(assign, f"list int, pos long, rest double, scale double, slack double, code binary, embedding {kind}")
    placed = stored(placed, "placed")
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(sent.value)], "list int, centroid array<double>")
    told = placed.groupBy("list").agg(F.max("rest").alias("radius"), F.count("*").alias("n"))
    known = stored(centres.join(told, "list"), "lists")
    # tiles by hash: a long list has more of them, and is written by more tasks
    dealt = placed.join(F.broadcast(known.select("list", "n")), "list")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("pos"), F.ceil(F.col("n") / TILE)).cast("int"))
    packed = dealt.groupBy("list", "tile").agg(F.collect_list(F.struct("pos", "scale", "slack", "code")).alias("rows"))
    folder = shared_folder(spark, "vector-index")
    packed.repartitionByRange("list", "tile").write.partitionBy("list").parquet(f"{folder}/tiles")
    ranged = placed.select("list", "pos", "embedding").repartitionByRange("list", "pos").sortWithinPartitions("list", "pos")
    ranged.write.partitionBy("list").parquet(f"{folder}/vectors")
    tiles = spark.read.schema(f"tile int, rows {CODE}, list int").parquet(f"{folder}/tiles")
    whole = spark.read.schema(f"pos long, embedding {kind}, list int").parquet(f"{folder}/vectors")
    return VectorIndex(known, tiles, whole, metric, size)


def probed(index: VectorIndex, queries: DataFrame, n: int, probes: int | None = None) -> DataFrame:
    """(qid, list, offset): the ``probes`` lists nearest to each query (all, if None) but for those too far away.

    A list is too far if its nearest possible vector is beyond the farthest possible one of the lists that hold the
    first ``n`` vectors. ``offset`` is the query less the centroid.
    """
    known = index.lists.orderBy("list").collect()  # bounded: as many rows as centroids were sent
    sent = queries.sparkSession.sparkContext.broadcast(
        (np.array([r.list for r in known], np.int32), np.array([r.centroid for r in known], np.float64).reshape(len(known), index.size), np.array([r.radius for r in known]), np.array([r.n for r in known]))
    )
    size, metric = index.size, index.metric

    def choose(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, centroids, radius, count = sent.value
        for batch in batches:
            x = _directions(_matrix(batch.column("vector"), size), metric)
            for qid, q in zip(batch.column("qid"), x):
                offset = q[None] - centroids
                away = np.sqrt((offset * offset).sum(axis=1))
                by = np.argsort(away, kind="stable")[:probes]
                reach = away + radius
                # by farthest possible vector: the lists that surely hold n vectors within reach
                sure = by[np.argsort(reach[by], kind="stable")]
                enough = np.searchsorted(np.cumsum(count[sure]), n)
                bound = reach[sure[enough]] if enough < len(sure) else np.inf
                by = by[away[by] - radius[by] <= bound + EPSILON]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qid.as_py()] * len(by), qid.type), pa.array(ids[by]), pa.array(list(offset[by]), pa.list_(pa.float64()))], ["qid", "list", "offset"]
                )

    kind = queries.schema["qid"].dataType.simpleString()
    asked = comparable(queries.withColumnRenamed("vector", "embedding"), size, metric).select("qid", F.col("embedding").alias("vector"))
    return asked.mapInArrow(choose, f"qid {kind}, list int, offset array<double>")


def candidates(index: VectorIndex, queries: DataFrame, n: int, probes: int | None = None) -> DataFrame:
    """(qid, list, pos): the vectors that may be among the first ``n`` of each query, by their codes."""
    size = index.size
    kind = queries.schema["qid"].dataType.simpleString()
    asked = stored(probed(index, queries, n, probes), "probes")
    wanted = [r.list for r in asked.select("list").distinct().collect()]  # bounded by the number of lists
    blocks = asked.groupBy("list", F.pmod(F.xxhash64("qid"), F.lit(queries.count() // BLOCK + 1)).alias("block"))
    blocks = blocks.agg(F.collect_list(F.struct("qid", "offset")).alias("queries"))
    meet = index.tiles.where(F.col("list").isin(wanted)).join(blocks, "list").select("list", "rows", "queries")

    def bounds(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for list_, rows, asking in zip(batch.column(0), batch.column(1), batch.column(2)):
                rows, asking = rows.values, asking.values
                pos, scale, slack = (np.asarray(rows.field(c)) for c in ("pos", "scale", "slack"))
                code = np.frombuffer(b"".join(rows.field("code").to_pylist()), np.int8).reshape(-1, size).astype(np.float64) * scale[:, None]
                length = (code * code).sum(axis=1)
                offsets = _matrix(asking.field("offset"), size)
                ids = asking.field("qid")
                about = np.maximum((offsets * offsets).sum(axis=1)[:, None] - 2 * offsets @ code.T + length[None], 0)
                about = np.sqrt(about)
                low, high = np.maximum(about - slack, 0) - EPSILON, about + slack + EPSILON
                limit = np.partition(high, n - 1, axis=1)[:, n - 1 : n] if high.shape[1] > n else np.full((len(high), 1), np.inf)
                q, v = np.nonzero(low <= limit)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(q)), pa.repeat(list_, len(q)), pa.array(pos[v]), pa.array(low[q, v]), pa.array(high[q, v])], ["qid", "list", "pos", "low", "high"]
                )

    found = stored(meet.mapInArrow(bounds, f"qid {kind}, list int, pos long, low double, high double"), "bounds")
    limit = top_per_key(found, ["qid"], ["high"], n).groupBy("qid").agg(F.max("high").alias("limit"))
    return found.join(limit, "qid").where("low <= limit").select("qid", "list", "pos")


def search(index: VectorIndex, queries: DataFrame, n: int, probes: int | None = None) -> DataFrame:
    """(qid, pos, distance, rank): the ``n`` vectors nearest to each query (qid: unique, vector), ties by position.

    With ``probes`` None the result equals an exact scan of the comparable vectors. A query that isn't comparable with the
    index's vectors has no rows.
    """
    few = candidates(index, queries, n, probes)
    asked = queries.select("qid", "vector")
    distance = cosine_distance if index.metric == "cosine" else squared_l2
    scored = index.vectors.join(few, ["list", "pos"]).join(asked, "qid").select("qid", "pos", distance("embedding", "vector").alias("distance"))
    best = top_per_key(scored, ["qid"], ["distance", "pos"], n)
    return best.withColumn("rank", F.row_number().over(_ranked()))


def _ranked():
    from pyspark.sql import Window

    return Window.partitionBy("qid").orderBy("distance", "pos")
