"""Pluggable models: embedding, pair scoring and text generation.

A model is handed over as a zero-argument factory and built once per Python worker.
The stand-ins need no files or network and always give the same output.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EMBED_BATCH = 64


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class PairScorer(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, system: str, user: str) -> str: ...


class HashEmbedder:
    """Unit vector of hashed words."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.size
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out


class SharedWordScorer:
    """Share of the question's words found in the text."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        words = set(query.lower().split())
        return [len(words & set(t.lower().split())) / max(1, len(words)) for t in texts]


class FirstLineGenerator:
    """Answers with the first non-blank line of the user prompt."""

    def generate(self, system: str, user: str) -> str:
        return next((line for line in user.splitlines() if line.strip()), "")


def embed_column(factory: Callable[[], Embedder] = HashEmbedder, batch: int = EMBED_BATCH) -> Callable[[Column], Column]:
    """A column function that embeds texts in batches of the given size."""

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for part in batches:
            texts = [t or "" for t in part.to_pylist()]
            vectors: list[list[float]] = []
            for i in range(0, len(texts), batch):
                vectors += model.embed(texts[i : i + batch])
            yield pa.array(vectors, pa.list_(pa.float32()))

    return embed


def pair_scorer(factory: Callable[[], PairScorer] = SharedWordScorer) -> Callable[[str, Column], Column]:
    """A function of question and text column giving a relevance score per row."""

    def make(query: str, text: Column) -> Column:
        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = factory()
            for part in batches:
                yield pa.array([float(x) for x in model.score(query, [t or "" for t in part.to_pylist()])], pa.float64())

        return score(text)

    return make


def generate_column(factory: Callable[[], Generator] = FirstLineGenerator) -> Callable[[Column, Column], Column]:
    """A function of system and user prompt columns giving the reply; a NULL user prompt is not sent."""

    @F.arrow_udf("string")
    def reply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = factory()
        for systems, users in batches:
            yield pa.array(
                [None if u is None else model.generate(s or "", u) for s, u in zip(systems.to_pylist(), users.to_pylist())],
                pa.string(),
            )

    return reply
