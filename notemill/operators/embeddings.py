"""Vectors of note chunks from a pluggable provider."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    """Makes vectors; an instance is sent to the workers and loads its model there, once per task."""

    model: str
    dimension: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class HashProvider:
    """Deterministic vectors without a model: signed counts of hashed words, scaled to length 1."""

    def __init__(self, dimension: int = 384):
        self.model, self.dimension = f"hash-{dimension}", dimension

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:16], 16)
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)


class TrainedProvider:
    """Vectors of a model trained on the notes themselves: hashed words, weighed by rarity, projected on their main directions.

    :meth:`fit` takes document frequencies and the words' joint sums from at most ``sample`` texts; memory is ``features`` squared.
    """

    def __init__(self, rarity: np.ndarray, axes: np.ndarray, name: str = "trained"):
        self.rarity, self.axes, self.dimension = rarity, axes, axes.shape[1]
        self.model = f"{name}-{self.dimension}"

    @staticmethod
    def _counts(texts: Sequence[str], features: int) -> np.ndarray:
        out = np.zeros((len(texts), features), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                out[i, zlib.crc32(w.encode()) % features] += 1
        return np.log1p(out)

    @classmethod
    def fit(cls, texts: DataFrame, text: str = "text", dimension: int = 384, features: int = 2048, sample: int = 20_000, seed: int = 7) -> TrainedProvider:
        """Train on the ``sample`` texts of lowest hash; null and empty texts do not count."""
        rows = texts.where(F.length(text) > 0).select(F.col(text).alias("t")).orderBy(F.xxhash64("t", F.lit(seed)), "t").limit(sample)

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, df, joint = 0, np.zeros(features), np.zeros((features, features), np.float32)
            for f in frames:
                for at in range(0, len(f), 1000):
                    x = cls._counts(f["t"].iloc[at : at + 1000].tolist(), features)
                    n, df, joint = n + len(x), df + (x > 0).sum(0), joint + x.T @ x
            yield pd.DataFrame({"n": [n], "df": [df.tobytes()], "joint": [joint.tobytes()]})

        # one part: the sample is bounded
        got = rows.coalesce(1).mapInPandas(sums, "n bigint, df binary, joint binary").first()
        n, df, joint = got["n"], np.frombuffer(got["df"]), np.frombuffer(got["joint"], np.float32).reshape(features, features).astype(np.float64)
        rarity = np.log((1 + n) / (1 + df)) + 1
        _, axes = np.linalg.eigh(joint * rarity[:, None] * rarity[None, :])
        return cls(rarity.astype(np.float32), axes[:, ::-1][:, : min(dimension, features)].astype(np.float32))

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        x = (self._counts(texts, len(self.rarity)) * self.rarity) @ self.axes
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(length == 0, 1, length)


def embedded(notes: DataFrame, provider: Provider, batch: int = 100, known: DataFrame | None = None) -> DataFrame:
    """(vault, path, chunk_ix, model, embedding) of every chunk; equal texts are embedded once.

    The distinct texts are keyed by digest, embedded in Arrow batches and joined back.  ``known`` (key, model, embedding) holds
    vectors made before; only texts that it lacks visit the provider (see :func:`new_vectors`).
    """
    chunks = notes.select("vault", "path", F.posexplode("chunks").alias("chunk_ix", "text")).withColumn("key", F.sha2("text", 256))
    vectors = new_vectors(notes, provider, batch, known)
    if known is not None:
        vectors = vectors.unionByName(known.where(F.col("model") == provider.model).select("key", "model", "embedding"))
    return chunks.join(vectors.drop("model"), "key").select("vault", "path", "chunk_ix", F.lit(provider.model).alias("model"), "embedding")


def new_vectors(notes: DataFrame, provider: Provider, batch: int = 100, known: DataFrame | None = None) -> DataFrame:
    """(key, model, embedding) of the distinct chunk texts that ``known`` lacks: append them to it, and it is a cache."""
    texts = notes.select(F.explode("chunks").alias("text")).where(F.col("text").isNotNull()).groupBy(F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"))
    if known is not None:
        texts = texts.join(known.where(F.col("model") == provider.model).select("key"), "key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield pd.DataFrame({"key": part["key"], "embedding": list(provider.embed(part["text"].tolist()))})

    return texts.mapInPandas(run, "key string, embedding array<float>").select("key", F.lit(provider.model).alias("model"), "embedding")


def best_chunks(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """(vault, path, score): the greatest cosine of a note's vectors with a query vector, at least 0."""
    from notemill.functions.vectors import cosine

    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.groupBy("vault", "path").agg(F.max(F.greatest(cosine("embedding", q), F.lit(0.0))).alias("score"))
