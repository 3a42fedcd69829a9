"""The few scalars Spark has no expression for, as Arrow UDFs over one column batch.

Each takes and returns plain columns, so Spark partitions and schedules the work;
callers hand over NULL for rows that need no Python, which keeps them out of the
computation.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .sequences import Bounds, Prepared, Texts, ratio

# --- spoken identifiers -------------------------------------------------------

_VALUES = {word: n for n, word in enumerate(K.SPOKEN_NUMBERS)} | K.SPOKEN_TENS
_UNIT = "|".join(K.SPOKEN_NUMBERS[1:10])
_HEAD = "(" + "|".join(K.SPOKEN_NUMBERS) + ")"
_LOOSE_TAIL = rf"(\d{{1,3}}|(?:{'|'.join(K.SPOKEN_TENS)})\s+(?:{_UNIT})|(?:{'|'.join(_VALUES)}))"
_SPOKEN_STRICT = re.compile(rf"\b{_HEAD}\s+point\s+{_HEAD}\s+point\s+{_HEAD}\b", re.I)
_SPOKEN_LOOSE = re.compile(rf"\b{_HEAD}\s+point\s+{_HEAD}\s+point\s+{_LOOSE_TAIL}\b", re.I)
_SPACED = re.compile(r"(?<!\d)(\d{1,2})\.(\d{1,3})\s+(\d{1,3})(?!\.\d)(?!\d)")


def _spoken_value(words: str) -> int:
    return int(words) if words.isdigit() else sum(_VALUES[w] for w in words.lower().split())


def _dotted(match: re.Match) -> str:
    return ".".join(str(_spoken_value(part)) for part in match.groups())


def write_out_ids(text: str, strict_first: bool = True) -> str:
    """Spoken (``two point three point ten``) and spaced (``4.19 186``) ids as dotted numbers."""
    if strict_first:
        text = _SPOKEN_STRICT.sub(_dotted, text)
    text = _SPACED.sub(r"\1.\2.\3", text)
    return _SPOKEN_LOOSE.sub(_dotted, text)


def _mapper(fn, arrow_type: pa.DataType):
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([None if v is None else fn(v) for v in batch.to_pylist()], arrow_type)

    return run


def spoken_ids(c: Column, *, strict_first: bool = True) -> Column:
    def one(text: str) -> str:
        return write_out_ids(text, strict_first)

    run = _mapper(one, pa.string())

    @F.arrow_udf("string")
    def spoken(batch: pa.Array) -> pa.Array:
        return run(batch)

    return spoken(c)


# --- diacritics ---------------------------------------------------------------


def drop_marks(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", text) if unicodedata.category(ch) != "Mn")


_OTHER = re.compile(r"[^\w\s\u0100-\u024f]")


def plain_words(text: str) -> str:
    return " ".join(_OTHER.sub(" ", drop_marks(text).lower().replace("<j>", " ")).split())


def alignment_text(c: Column) -> Column:
    """Text form for alignment: no diacritics, lower case, words only.

    All of it is done here, so that the expressions after it refer to a finished column.
    """
    run = _mapper(plain_words, pa.string())

    @F.arrow_udf("string")
    def words(batch: pa.Array) -> pa.Array:
        return run(batch)

    return words(c)


# --- sequence similarity ------------------------------------------------------


def sequence_ratio(a: Column, b: Column) -> Column:
    """Matching-block similarity of two short strings (library defaults, argument order matters)."""

    @F.arrow_udf("double")
    def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(left.to_pylist(), right.to_pylist())
        return pa.array([None if x is None or y is None else ratio(x, Prepared(y)) for x, y in pairs], pa.float64())

    return similarity(a, b)


def best_in_tile(block: Column, floors: Column, tile: Column, k: int) -> Column:
    """For each text of a block the ``k`` entries of a tile most similar to it, and how many pairs were scored.

    ``block`` is ``array<string>``, ``floors`` the k-th score that each text has elsewhere (0: none), ``tile``
    ``array<struct<pos:bigint,opening:string>>``, all of bounded length. A text meets the entries in the order of the
    upper bounds of their ratios, until the bound is below the k-th score so far; entries below the floor may
    be missing, so the answer is the same as scoring all of them.
    """
    scores = pa.list_(pa.list_(pa.struct([("score", pa.float64()), ("pos", pa.int64())])))

    @F.arrow_udf("struct<best:array<array<struct<score:double,pos:bigint>>>,scored:bigint>")
    def best(blocks: pa.Array, floors: pa.Array, tiles: pa.Array) -> pa.Array:
        shaped, scored = [], []
        prepared: dict = {}
        for texts, least, entries in zip(blocks.to_pylist(), floors.to_pylist(), tiles.to_pylist()):
            if prepared.get("entries") != entries:
                openings = [Prepared(e["opening"]) for e in entries]
                prepared = {"entries": entries, "openings": openings, "bounds": Bounds([o.text for o in openings], openings)}
            openings, n = prepared["openings"], 0
            bounds = Bounds(texts).to(prepared["bounds"])
            numbered = Texts(texts)
            tables = [o.tables(numbered) if o.plain else None for o in openings]
            out = []
            for i, (text, own, bound, order) in enumerate(zip(texts, least, bounds.tolist(), (-bounds).argsort(axis=1, kind="stable").tolist())):
                top: list = []
                for j in order:
                    floor = max(own, top[-1][0]) if len(top) == k else own
                    if bound[j] < floor:
                        break
                    n += 1
                    table = numbered.table(i, tables[j]) if openings[j].plain else None
                    score = ratio(text, openings[j], floor, table=table)
                    if score is not None:
                        top.append((score, entries[j]["pos"]))
                        top.sort(key=lambda pair: (-pair[0], pair[1]))
                        del top[k:]
                out.append([{"score": s, "pos": p} for s, p in top])
            shaped.append(out)
            scored.append(n)
        return pa.StructArray.from_arrays([pa.array(shaped, scores), pa.array(scored, pa.int64())], ["best", "scored"])

    return best(block, floors, tile)


# --- chunk spans --------------------------------------------------------------


def chunk_spans(text: str, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP):
    """Yield ``(start, stop)`` of overlapping windows that end after a sentence or a word where possible."""
    total, start = len(text), 0
    while start < total:
        stop = start + size
        if stop < total:
            half = start + size // 2
            for mark, slack in ((". ", K.SENTENCE_SLACK), (" ", K.SPACE_SLACK)):
                found = text.rfind(mark, half, stop + slack)
                if found >= 0:
                    stop = found + len(mark)
                    break
            yield start, stop
            start = stop - overlap
        else:
            if text[start:].strip():
                yield start, total
            return


def chunk_texts(c: Column, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> Column:
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap must be smaller than half the chunk size")

    @F.arrow_udf("array<string>")
    def chunks(batch: pa.Array) -> pa.Array:
        out = []
        for text in batch.to_pylist():
            usable = text is not None and text.strip() != ""
            out.append([text[a:b] for a, b in chunk_spans(text, size, overlap)] if usable else [])
        return pa.array(out, pa.list_(pa.string()))

    return chunks(c)


# --- vectors ------------------------------------------------------------------


def distance_to(c: Column, query: list[float], metric: str = "cosine") -> Column:
    """Distance of every stored vector to one fixed query vector.

    A missing, empty, zero or differently sized vector gets the sentinel distance.
    """
    import numpy as np

    target = np.asarray(query, dtype="float64")
    norm = float(np.sqrt((target * target).sum()))

    @F.arrow_udf("double")
    def distance(batch: pa.Array) -> pa.Array:
        result = np.full(len(batch), K.MISSING_DISTANCE)
        sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        fits = np.flatnonzero(sizes == len(target))
        if len(fits) and len(target):
            flat = batch.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
            rows = flat.astype("float64").reshape(len(fits), len(target))
            if metric == "l2":
                result[fits] = ((rows - target) ** 2).sum(axis=1)
            else:
                norms = np.sqrt((rows * rows).sum(axis=1))
                usable = (norms > 0) & (norm > 0)
                dots = rows @ target
                result[fits[usable]] = 1.0 - dots[usable] / (norms[usable] * norm)
        result = np.where(np.isnan(result), K.MISSING_DISTANCE, result)
        return pa.array(result)

    return distance(c)
