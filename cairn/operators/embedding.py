"""Texts to vectors, by a pluggable provider, and only those not known yet."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.shipping import ship

#: Texts, and bytes of them, that a provider gets at a time.
BATCH, SIZE = 256, 8 << 20


class Embedder(Protocol):
    model_id: str
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """float32 of shape (len(texts), dim), not normalised."""


class HashedWords:
    """A provider without a model file: signed hashes of words and of character trigrams, of all words or the first ``most``."""

    def __init__(self, dim: int = 384, most: int | None = None):
        self.dim, self.most, self.model_id = dim, most, f"hashed-words-{dim}-{most or 'all'}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            counts = Counter(text.lower().split()[: self.most])
            parts: Counter = Counter()
            for w, n in counts.items():
                parts[w] += n
                for i in range(len(w) - 2):
                    parts[w[i : i + 3]] += 0.25 * n
            h = np.fromiter((zlib.crc32(p.encode("utf-8", "surrogatepass")) for p in parts), np.int64, len(parts))
            row += np.bincount(h % self.dim, np.fromiter(parts.values(), float, len(parts)) * np.where(h >> 31, 1, -1), self.dim)
        return out


class FromModel:
    """A provider that a model backs: ``load()`` runs once in each worker, when the first text comes, and returns a
    function from a list of texts to an array of shape (texts, dim).

    What travels is ``load`` itself, never the model; it should open a file that all workers have (``SparkFiles.get`` of one that was
    added by ``spark.sparkContext.addFile``). Cutting texts to the model's length is the function's business.
    """

    def __init__(self, model_id: str, dim: int, load: Callable[[], Callable[[list[str]], np.ndarray]]):
        self.model_id, self.dim, self.load = model_id, dim, load

    def embed(self, texts: list[str]) -> np.ndarray:
        model = _models.get(self.model_id)
        if model is None:
            model = _models[self.model_id] = self.load()
        out = np.asarray(model(texts), np.float32)
        if out.shape != (len(texts), self.dim):
            raise ValueError(f"{self.model_id} gave {out.shape}, not {(len(texts), self.dim)}")
        return out


#: The models that this worker has loaded.
_models: dict[str, Callable[[list[str]], np.ndarray]] = {}


def embed(chunks: DataFrame, embedder: Embedder, text: str = "content") -> DataFrame:
    """``chunks`` with ``vector`` and ``norm``; the provider is made once a worker and fed ``embedder.texts`` (or else BATCH) texts at a time
    at most, fewer where they are long.

    An Arrow batch of texts is turned into Python values piece by piece, and each piece's vectors leave as
    they are made, so a worker holds one batch as it came and one piece.
    """
    most = getattr(embedder, "texts", BATCH)

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for start, end in spans(texts, most):
                made = np.asarray(embedder.embed(texts.slice(start, end - start).fill_null("").to_pylist()), np.float32)
                if made.ndim != 2 or len(made) != end - start:
                    raise ValueError(f"{embedder.model_id} gave {made.shape} for {end - start} texts")
                yield pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1], made.ravel())

    from cairn.operators.vectors import with_norm

    ship(chunks.sparkSession)
    return with_norm(chunks.withColumn("vector", run(F.col(text))))


def spans(texts: pa.Array, most: int, size: int = SIZE) -> Iterator[tuple[int, int]]:
    """Places of pieces of ``texts``: ``most`` texts and ``size`` bytes at most, or one longer text."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if i - start == most or i > start and held + n > size:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def known(chunks: DataFrame, cache: DataFrame, model_id: str, dim: int) -> DataFrame:
    """``chunks`` with their cached ``vector``, null where there is none; a cached vector of another size doesn't count."""
    valid = cache.where((F.col("model_id") == model_id) & (F.size("vector") == dim)).select("chunk_hash", "vector").dropDuplicates(["chunk_hash"])
    return chunks.join(valid, "chunk_hash", "left")


def split_known(chunks: DataFrame, cache: DataFrame, model_id: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(chunks with their cached vector, distinct chunks without one), of one join."""
    joined = known(chunks, cache, model_id, dim)
    return joined.where("vector is not null"), joined.where("vector is null").drop("vector").dropDuplicates(["chunk_hash"])
