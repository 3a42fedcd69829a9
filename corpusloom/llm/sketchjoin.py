"""Near-duplicate documents by an exact Jaccard join over parity sketches.

A document's set of shingles is dealt by hash into parts, and each part's shingles are XORed: its parity. Every
shingle of the symmetric difference of two sets changes one part at most, so sets that differ in at most d shingles
agree in all but d parts. Sets are compared within size bands (``instances``), whose largest difference d at the
threshold gives the number of parts, a little over d. Two similar sets then agree in one of the d + 1 rarest parts of
either (pigeonhole over the sketch, rarest first), so parts that no other set has are never joined. Candidates are
verified on the whole sets.

Sets are joined, not documents: equal sets are one class from the start, however many documents it has. Of a group of
sets that share a part, one pivot, whose parts are shared most, is compared with the others, and components are formed.
In groups that still hold several components, sets of different ones are tested by sketches of single bits, two blocks
of a group in a task. A size band's sketch has at least four times as many bits as similar sets of it can have
differences, so unrelated sets are told apart at every size. Of the sets that are near enough, each first offers the
nearest only; these are verified, components are formed anew, and the next nearest follow, many more each round,
until none in another component is left. Sets that share several groups are compared in one of them, as far as the
first few groups of either (by hash) tell. So no group emits all its pairs, and no link between different components
is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, CHUNK_BYTES, SPACE_BYTES, Words, column_bytes, groups_for, lean, lean_group, mix, pieces, runs, stored

#: The shingle length and the threshold (numerator, denominator).
WIDTH, NUM, DEN = 5, 3, 4
#: Parts per possible difference; more for small sets, whose parts are often empty.
SPARE, SMALL, SPARE_SMALL = 1.25, 64, 4
#: Bits of a sketch per possible difference of its band: candidate pairs are tested by it before their sets are met.
BITS = 4
#: Wanted sets whose keys are sent to every task (8 bytes each); with more, all sets are shuffled and semi-joined.
KEYS_SENT = 1_000_000
#: Sets of one block of a group in the later rounds; how many times more candidates each may offer a round later; groups
#: that a set is marked with; pairs that are compared at once.
GROUP, MORE, MARKS, AT_ONCE = 1024, 64, 8, 1 << 18


def most_apart(a, b):
    """The largest symmetric difference of similar sets with ``a`` and ``b`` shingles."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def instances(n: np.ndarray) -> list[SimpleNamespace]:
    """The sketches a set of ``n`` shingles takes part in: its own band's, and those that bridge to its neighbours.

    Bands end at 3, 6, 12, and so on. The bridge at r holds the sizes that can be similar to one beyond r on the other
    side. Each has a number, the parts, the difference d a member must reckon with, and whether the set is a member.
    """
    band = np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / 3) - 1e-9)).astype(np.int64)
    out = []
    for kind, number in (("own", band), ("bridge", band - 1), ("bridge", band)):
        r = 3 << np.maximum(number, 0)
        beyond = r * DEN // NUM
        if kind == "own":
            most, member = most_apart(r, r), most_apart(r, r) > 0
        else:
            most = most_apart(r, beyond)
            member = (number >= 0) & (n * DEN >= NUM * (r + 1)) & (n <= beyond) & (most > 0)
        parts = np.ceil(np.where(r <= SMALL, SPARE_SMALL, SPARE) * (most + 1)).astype(np.int64)
        reach = np.minimum(most, most_apart(n, n * DEN // NUM))
        tag = np.zeros_like(number) if kind == "own" else 1 + number % 2
        out.append(SimpleNamespace(number=2 * np.maximum(number, 0) + (kind == "bridge"), tag=tag, parts=parts, reach=reach, member=member & (n > 0)))
    return out


def sketch_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the sketch of sets of ``n`` shingles: a power of two, the same for a size band."""
    band = np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / 3) - 1e-9)).astype(np.int64)
    r = 3 << band
    bits = BITS * np.maximum(1, most_apart(r, r * DEN // NUM))
    return 1 << np.maximum(0, np.ceil(np.log2(bits / 64) - 1e-9)).astype(np.int64)


def sketches(s: SimpleNamespace) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of several sets end to end, and where each begins (docs + 1 entries): bit i is the parity of the
    shingles whose hash is i modulo the sketch's bits, so a sketch folds into one of half the bits by XOR of its halves."""
    words = sketch_words(s.n)
    first = np.append(0, np.cumsum(words))
    place = mix(s.value + np.uint64(3)) & (words[s.doc].astype(np.uint64) * np.uint64(64) - np.uint64(1))
    at = first[s.doc].astype(np.uint64) * np.uint64(64) + place
    odd = np.zeros(int(first[-1]) * 64, np.uint8)
    at, times = np.unique(at, return_counts=True)
    odd[at.astype(np.int64)] = times & 1
    return np.packbits(odd.reshape(-1, 64), axis=1).view(np.int64).ravel(), first


def shingle_sets(data: np.ndarray, borders: np.ndarray) -> SimpleNamespace:
    """Distinct shingles (54-bit values, sorted) of up to 1024 documents, their document, sizes and set hashes."""
    docs = len(borders) - 1
    w = Words(data, borders, SPACE_BYTES)
    values, doc = runs(w.doc, w.hash, WIDTH, w.first)
    both = np.unique((doc.astype(np.uint64) << np.uint64(54)) | (values >> np.uint64(10)))
    doc, value = (both >> np.uint64(54)).astype(np.int64), both & np.uint64((1 << 54) - 1)
    n = np.bincount(doc, minlength=docs)
    first = np.cumsum(n) - n
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value + np.uint64(1)), out=sums[1:])
    whole = mix(sums[first + n] - sums[first] + n.astype(np.uint64) * np.uint64(BASE))
    return SimpleNamespace(doc=doc, value=value, n=n, first=first, whole=whole)


def parities(s: SimpleNamespace, some: np.ndarray) -> Iterator[tuple[SimpleNamespace, np.ndarray, np.ndarray]]:
    """For each kind of instance: it, the document and the 64-bit key (instance, part, parity) of each part with shingles."""
    for inst in instances(s.n):
        take = (inst.member & some)[s.doc]
        doc, value = s.doc[take], s.value[take]
        if not len(doc):
            yield inst, doc, value
            continue
        spread = mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        part = ((spread >> np.uint64(32)) * inst.parts[doc].astype(np.uint64)) >> np.uint64(32)
        place = (doc.astype(np.uint64) << np.uint64(32)) | part
        by = np.argsort(place, kind="stable")
        place = place[by]
        start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        parity = np.bitwise_xor.reduceat(mix(value[by] + np.uint64(77)), start)
        doc = (place[start] >> np.uint64(32)).astype(np.int64)
        part = place[start] & np.uint64(0xFFFFFFFF)
        yield inst, doc, mix(parity ^ mix(inst.number[doc].astype(np.uint64) * np.uint64(BASE) + part))


def _chunks(batch, column: int) -> Iterator[tuple[int, int, SimpleNamespace]]:
    data, borders = column_bytes(batch.column(column))
    for low, high in pieces(borders, CHUNK_BYTES):
        for a in range(low, high, 1024):
            b = min(a + 1024, high)
            cut = borders[a : b + 1]
            yield a, b, shingle_sets(data[cut[0] : cut[-1]], cut - cut[0])


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n (shingles), h (hash of the set), bits (its parity sketch), and per kind of instance its filled parts."""

    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for a, b, s in _chunks(batch, 1):
                held = [np.bincount(doc, minlength=b - a) for _, doc, _ in parities(s, np.ones(b - a, bool))]
                words, first = sketches(s)
                bits = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(s.n.astype(np.int64)), pa.array(s.whole.view(np.int64)), bits, *(pa.array(e.astype(np.int32)) for e in held)],
                    ["doc_id", "n", "h", "bits", "e0", "e1", "e2"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs, "doc_id").mapInArrow(lean(look), f"doc_id {kind}, n long, h long, bits array<long>, e0 int, e1 int, e2 int")


#: A part's key within its shard: 38 bits of hash and 2 of the kind of instance, then the 64 bits of the set's hash.
ENTRY = 13


def part_entries(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, blob of entries) for all parts of all sets, each set once per task and thin sets under one key."""

    def emit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen, held, count = set(), [], 0

        def flush():
            keys, sets, tags = (np.concatenate(x) for x in zip(*held))
            shard = (keys % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            shard = shard[by]
            row = np.zeros((len(by), ENTRY), np.uint8)
            row[:, :5] = ((keys[by] >> np.uint64(26) << np.uint64(2)) | tags[by]).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
            row[:, 5:] = sets[by].astype(">u8").view(np.uint8).reshape(-1, 8)
            start = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            ends = np.append(start, len(shard)).astype(np.int32) * ENTRY
            blob = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(row.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(shard[start].astype(np.int32)), blob], ["shard", "blob"])

        for batch in batches:
            for a, b, s in _chunks(batch, 0):
                new = np.zeros(b - a, bool)
                for i, (h, n) in enumerate(zip(s.whole.tolist(), s.n.tolist())):
                    if n >= 3 and h not in seen:
                        seen.add(h)
                        new[i] = True
                for inst, doc, keys in parities(s, new):
                    tag = inst.tag[doc].astype(np.uint64)
                    held.append((keys, s.whole[doc], tag))
                    # sets with no more filled parts than differences may agree in empty parts only, with others such
                    filled = np.bincount(doc, minlength=b - a)
                    thin = np.flatnonzero(inst.member & new & (filled <= inst.reach))
                    held.append((mix(inst.number[thin].astype(np.uint64) + np.uint64(0x7417)), s.whole[thin], inst.tag[thin].astype(np.uint64)))
                    count += len(keys)
                if count >= 1_000_000:
                    yield flush()
                    held, count = [], 0
        if any(len(keys) for keys, _, _ in held):
            yield flush()

    return _texts(docs).mapInArrow(lean(emit), "shard int, blob binary")


def shared_parts(entries: DataFrame) -> DataFrame:
    """(k, tag, s, c): parts that several sets have, each such set (its hash) and how many there are."""

    def group(key, table):
        import pyarrow as pa

        shard = key[0].as_py()
        raw = np.frombuffer(b"".join(table.column("blob").to_pylist()), np.uint8).reshape(-1, ENTRY)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, 3:] = raw[:, :5]
        keys = wide.view(">u8").ravel().astype(np.uint64)
        sets = np.ascontiguousarray(raw[:, 5:]).view(">u8").ravel().astype(np.uint64)
        by = np.argsort(keys, kind="stable")
        keys, sets = keys[by], sets[by]
        some = np.zeros(len(keys), bool)
        same = keys[1:] == keys[:-1]
        some[1:] |= same
        some[:-1] |= same
        keys, sets = keys[some], sets[some]
        by = np.lexsort((sets, keys))
        keys, sets = keys[by], sets[by]
        if len(keys):
            new = np.append(True, (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1]))
            keys, sets = keys[new], sets[new]
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            size = np.diff(np.append(start, len(keys)))
            count = np.repeat(size, size)
            keep = count > 1
            keys, sets, count = keys[keep], sets[keep], count[keep]
        else:
            count = np.zeros(0, np.int64)
        k = (np.uint64(shard) << np.uint64(40)) | keys
        return pa.Table.from_arrays([pa.array(k.view(np.int64)), pa.array((keys & np.uint64(3)).astype(np.int32)), pa.array(sets.view(np.int64)), pa.array(count.astype(np.int64))], ["k", "tag", "s", "c"])

    return entries.groupBy("shard").applyInArrow(lean_group(group), "k long, tag int, s long, c long")


def set_values(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, n, v): the shingles of the wanted sets (h), 40 bits each, once per set."""
    spark = docs.sparkSession
    few = wanted.limit(KEYS_SENT + 1).count() <= KEYS_SENT
    sent = spark.sparkContext.broadcast(np.sort(np.array([r.h for r in wanted.collect()], np.int64)) if few else None)

    def emit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, seen = sent.value, set()
        for batch in batches:
            for a, b, s in _chunks(batch, 0):
                h = s.whole.view(np.int64)
                take = s.n > 0
                if keys is not None:
                    at = np.searchsorted(keys, h)
                    at[at == len(keys)] = 0
                    take &= keys[at] == h if len(keys) else False
                take = [i for i in np.flatnonzero(take).tolist() if not (h[i] in seen or seen.add(h[i]))]
                packed = (s.value >> np.uint64(14)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
                blobs = [packed[s.first[i] : s.first[i] + s.n[i]].tobytes() for i in take]
                yield pa.RecordBatch.from_arrays([pa.array(h[take]), pa.array(s.n[take].astype(np.int64)), pa.array(blobs, pa.binary())], ["h", "n", "v"])

    sets = _texts(docs).mapInArrow(lean(emit), "h long, n long, v binary")
    return (sets if few else sets.join(wanted, "h", "left_semi")).dropDuplicates(["h"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar."""
    left, right = (sets.select(F.col("h").alias(x), F.col("v").alias(f"v{x}")) for x in "ab")

    def test(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def values(blob: bytes) -> np.ndarray:
            wide = np.zeros((len(blob) // 5, 8), np.uint8)
            wide[:, 3:] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
            return wide.view(">u8").ravel()

        for batch in batches:
            keep = []
            for va, vb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = values(va), values(vb)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb")
    return both.mapInArrow(lean(test), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(h, root): the least node reachable from each node of ``edges`` (a, b), by large-star and small-star steps."""
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = stored(links, "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.withColumnRenamed("m", "v"))
        new = stored(small.where("u <> v").distinct(), "links")
        changed = new.exceptAll(links).limit(1).count() + links.exceptAll(new).limit(1).count()
        links = new
        if not changed:
            break
    return links.select(F.col("u").alias("h"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Classes of ``docs`` (doc_id, text) under links of Jaccard 0.75 or more between sets of five-word shingles.

    Returns doc_id, n_shingles, component_id (the least doc_id reachable). Words are lower-cased (A-Z only); a text of
    one to four words has its whole sequence as one shingle; a null or empty text, or one without words, has none and
    is a class of its own. Rows that repeat count as documents of the same class; an empty table gives no rows.
    """
    table = stored(described(docs), "sets")
    classes = stored(table.where("n > 0").groupBy("h").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), *(F.first(e).alias(e) for e in ("bits", "e0", "e1", "e2"))), "classes")
    entries = part_entries(docs, groups_for(docs, 16 << 20))
    shared = stored(shared_parts(entries), "shared")
    rows = stored(_rarest(shared, classes), "rarest")
    roots = _roots(docs, rows, classes)
    known = table.where("n > 0").select("doc_id", "n", "h")
    named = classes.select("h", "least") if roots is None else classes.join(roots, "h", "left").select("h", "least", F.coalesce("root", "h").alias("root"))
    if roots is not None:
        lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
        named = named.join(lowest, "root").select("h", "component_id")
    else:
        named = named.withColumnRenamed("least", "component_id")
    full = known.join(named, "h").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = table.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(none)


def _rarest(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(k, h, n, heft): of each set and instance the shared parts among its d + 1 rarest (those shared with none come first).

    ``heft`` is how often the set's parts are shared in all: the middle of a group of near copies has the most.
    """

    size = F.col("n")
    top = lambda r: 3 * F.pow(F.lit(2.0), r)
    band = F.greatest(F.lit(0.0), F.ceil(F.log2(size / 3) - 1e-9).cast("double"))
    number = F.when(F.col("tag") == 0, band).when((band % 2 + 1) == F.col("tag"), band).otherwise(band - 1)
    r = top(number)
    floor = lambda x: F.floor(x + 1e-9)
    limit = F.when(F.col("tag") == 0, floor(2 * r / 7)).otherwise(floor((r + floor(r * 4 / 3)) / 7))
    reach = F.least(limit, floor((size + floor(size * 4 / 3)) / 7))
    filled = F.when(F.col("tag") == 0, F.col("e0")).when(number == band, F.col("e2")).otherwise(F.col("e1"))
    by_set = Window.partitionBy("s", "tag")
    sums = shared.groupBy("s", "tag").agg(F.count("*").alias("many"), F.sum("c").alias("heft"))
    keyed = classes.select("h", "n", "e0", "e1", "e2", F.col("h").alias("s"))
    # a set with more unshared parts than it can have differences needs none of its shared ones
    few = sums.join(keyed, "s").withColumn("keep", (reach + 1 - F.greatest(F.lit(0), filled - F.col("many"))).cast("int")).where("keep > 0")
    few = few.select("s", "tag", "h", "n", "heft", "keep")
    ranked = shared.join(few.select("s", "tag").distinct(), ["s", "tag"], "left_semi").withColumn("rank", F.row_number().over(by_set.orderBy("c", "k")))
    return ranked.join(few, ["s", "tag"]).where("rank <= keep").select("k", "h", "n", "heft")


def _roots(docs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(h, root) of the linked sets; None if there are no candidates. See the module's head for the two rounds."""
    sizes = rows.groupBy("k").agg(F.count("*").alias("c")).where("c > 1")
    now = stored(rows.join(sizes.select("k"), "k", "left_semi"), "groups")
    sets = stored(set_values(docs, now.select("h").distinct()), "values")
    bits = classes.select("h", "bits")
    one = now.groupBy("k").agg(F.max(F.struct("heft", "h", "n")).alias("p"))
    pivots = one.select("k", F.col("p.h").alias("ph"), F.col("p.n").alias("pn"))
    fits = (F.col("n") * DEN >= F.col("pn") * NUM) & (F.col("pn") * DEN >= F.col("n") * NUM)
    pairs = now.join(pivots, "k").where((F.col("h") != F.col("ph")) & fits).select(F.greatest("h", "ph").alias("a"), F.least("h", "ph").alias("b"), (F.col("n") + F.col("pn")).alias("sum")).distinct()
    tried = stored(pairs, "pairs")
    links = stored(verified(_near(tried, bits), sets), "found")
    roots = components(links)
    named = now.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    mixed = named.groupBy("k").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("c")).where("x <> y").select("k", "c")
    rows = named.join(mixed, "k").select("k", "h", "n", "root", F.ceil(F.col("c") / GROUP).cast("int").alias("blocks"))
    rows = stored(rows, "rows")
    marks = rows.groupBy("h").agg(F.slice(F.array_sort(F.collect_list(F.xxhash64("k"))), 1, MARKS).alias("marks"))
    open_ = stored(rows.join(bits.join(marks, "h"), "h"), "open")
    low, high, found, merges = 0, 1, [], None
    while True:
        moved = None if merges is None else components(merges).select(F.col("h").alias("root"), F.col("root").alias("into"))
        current = open_.withColumn("now", F.col("root")) if moved is None else open_.join(moved, "root", "left").withColumn("now", F.coalesce("into", "root"))
        offers = stored(_offers(current, low, high).distinct(), "pairs")
        pairs = offers.where("a IS NOT NULL").join(tried, ["a", "b"], "left_anti")
        new = stored(verified(pairs, sets), "found")
        merged = new.limit(1).count() > 0
        if merged:
            found.append(new)
        if not offers.where("a IS NULL").limit(1).count():
            break
        if merged:
            by_root = offers.join(new, ["a", "b"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
            merges = stored(by_root if merges is None else merges.unionByName(by_root), "merges")
        low, high = high, high * MORE + 1
    for new in found:
        links = links.unionByName(new)
    return components(links) if found else roots


def _offers(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Pairs of a group's sets, of different components now, whose sketches are as near as those of similar sets must be.

    (a, b, root_a, root_b), with the components as they were at first; of a set's candidates in its block (those of
    other components at first, nearest first) the pairs whose number, with either of the two, is ``low`` or more and
    under ``high``. A row of nulls says that others follow. A group of many blocks is spread over tasks by pairs of
    blocks; a task holds two blocks. ``rows``: k, h, n, root, now, blocks, bits, marks (the least hashes of its groups).
    """

    def test(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def ragged(column):
            return np.asarray(column.flatten()).view(np.uint64), np.diff(np.asarray(column.offsets).astype(np.int64))

        def table(batch):
            words, sizes = ragged(batch.column(8))
            bits = np.array(np.split(words, np.cumsum(sizes)[:-1]) + [None], object)[:-1]
            named, sizes = ragged(batch.column(9))
            marks = np.zeros((batch.num_rows, MARKS), np.int64)
            there = np.arange(MARKS)[None] < sizes[:, None]
            marks[there] = named.view(np.int64)
            return [np.asarray(batch.column(i)) for i in range(8)] + [bits, marks, np.asarray(batch.column(10)), there]

        def together(cuts, own, first, second):
            """All pairs (left block, right block) of the groups between ``cuts``, some groups at a time."""
            left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
            a, b = np.searchsorted(left, cuts), np.searchsorted(right, cuts)
            n, m = np.diff(a), np.diff(b)
            sizes = n * m
            group, last = 0, len(sizes)
            while group < last:
                upto = max(group + 1, int(np.searchsorted(np.cumsum(sizes[group:]), AT_ONCE)) + group)
                sets_ = np.arange(a[group], a[upto])
                of = np.repeat(np.arange(group, upto), n[group:upto])
                times = m[of]
                i = np.repeat(sets_, times)
                j = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(b[of], times)
                yield left[i], right[j], np.repeat(of, times)
                group = upto

        def apart(i, j, tables, width, row):
            """Differing bits of pairs of sketches, the wider of two folded to the narrower."""
            out = np.zeros(len(i), np.int64)
            for w, left in tables.items():
                here = np.flatnonzero(width[i] == w)
                for v in (w // 2, w, 2 * w):
                    if v not in tables:
                        continue
                    some = here[width[j[here]] == v]
                    if not len(some):
                        continue
                    right = tables[v][:, :w] ^ tables[v][:, w:] if v > w else tables[v]
                    own = left[:, :v] ^ left[:, v:] if v < w else left
                    step = max(1, (1 << 20) // w)
                    for at in range(0, len(some), step):
                        part = some[at : at + step]
                        out[part] = np.bitwise_count(own[row[i[part]]] ^ right[row[j[part]]]).sum(axis=1)
            return out

        def candidates(cuts, g):
            first, second, n, root, own, bits, marks, mark, there = g[1], g[2], g[4], g[5], g[7], g[8], g[9], g[10], g[11]
            width = np.array([len(w) for w in bits])
            tables, row = {}, np.zeros(len(bits), np.int64)
            for w in np.unique(width).tolist():
                mine = np.flatnonzero(width == w)
                tables[w], row[mine] = np.stack(bits[mine]), np.arange(len(mine))
            kept = [np.zeros((4, 0), np.int64)]
            for i, j, of in together(cuts, own, first, second):
                small, great = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                ok = (root[i] != root[j]) & (small * DEN >= great * NUM) & ((first[i] != second[i]) | (i < j))
                i, j, of = i[ok], j[ok], of[ok]
                bits_apart = apart(i, j, tables, width, row)
                near = bits_apart <= most_apart(n[i], n[j])
                i, j, of, bits_apart = i[near], j[near], of[near], bits_apart[near]
                # left to an earlier group that both are marked with
                shared = (marks[i][:, :, None] == marks[j][:, None, :]) & (there[i] & (marks[i] < mark[i][:, None]))[:, :, None] & there[j][:, None, :]
                mine = ~shared.any(axis=(1, 2))
                kept.append(np.stack([i[mine], j[mine], of[mine], bits_apart[mine]]))
            return np.concatenate(kept, axis=1)

        def number(own, far, other):
            """The place of each pair among those of ``own``, nearest first."""
            by = np.lexsort((other, far, own))
            start = np.maximum.accumulate(np.where(np.append(True, own[by][1:] != own[by][:-1]), np.arange(len(by)), 0)) if len(by) else by
            place = np.zeros(len(by), np.int64)
            place[by] = np.arange(len(by)) - start
            return place

        def out(cuts, g):
            h, now, root = g[3], g[6], g[5]
            i, j, _, far = candidates(cuts, g)
            both = number(np.append(i, j), np.append(far, far), h[np.append(j, i)])
            place = np.minimum(both[: len(i)], both[len(i) :])
            other = now[i] != now[j]
            take = other & (place >= low) & (place < high)
            more = bool((other & (place >= high)).any())
            i, j = i[take], j[take]
            swap = h[i] < h[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            columns = [pa.array(c) for c in (h[i], h[j], root[i], root[j])]
            if more:
                columns = [pa.concat_arrays([c, pa.nulls(1, pa.int64())]) for c in columns]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "root_a", "root_b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = table(batch)
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            key = np.stack(held[:3])
            cuts = np.append(0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1)
            if len(cuts) > 1:
                yield out(cuts, [c[: cuts[-1]] for c in held])
                held = [c[cuts[-1] :] for c in held]
        if held is not None and len(held[0]):
            yield out(np.array([0, len(held[0])]), held)

    own = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("k", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "h", "n", "root", "now", "own", "bits", "marks", F.xxhash64("k").alias("mark"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "k", "low", "high").sortWithinPartitions("k", "low", "high").mapInArrow(lean(test), "a long, b long, root_a long, root_b long")


def _near(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b, sum of sizes) whose sketches differ in no more bits than similar sets may in shingles."""
    left, right = (bits.select(F.col("h").alias(x), F.col("bits").alias(f"bits_{x}")) for x in "ab")

    def folded(own, other):
        half = F.size(own) / 2
        halves = F.zip_with(F.slice(own, 1, half.cast("int")), F.slice(own, (half + 1).cast("int"), half.cast("int")), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(own) > F.size(other), halves).otherwise(own)

    both = F.zip_with(folded(F.col("bits_a"), F.col("bits_b")), folded(F.col("bits_b"), F.col("bits_a")), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    apart = F.aggregate(both, F.lit(0).cast("long"), lambda n, x: n + x)
    return pairs.join(left, "a").join(right, "b").where(apart <= F.floor(F.col("sum") * (DEN - NUM) / (DEN + NUM) + 1e-9)).select("a", "b")
