"""Exact cosine search that leaves parts of the rows unread.

Rows are written in parts: by their nearest pivot, and by rings of the angle to it.
For each part and each pivot the least and greatest angle are known. Angles obey
the triangle inequality, so a row of a part whose angles to pivot p lie between lo and hi is at least
lo - a and a - hi away from a query at angle a to p: a part that thereby can't hold one of the k best is never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.vectors import _matrix, top_k
from cairn.shared import staged
from cairn.shipping import ship

#: Pivots, rings around each, and vectors of the sample that pivots are taken from.
PIVOTS, RINGS, SAMPLE = 8, 8, 2_000
#: What angles are off by at most, as stored.
SLACK = 1e-5


def spread(unit: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of these unit vectors, each the farthest from those before."""
    picked = [0]
    near = unit @ unit[0]
    while len(picked) < n and near.min() < 1 - 1e-9:
        picked.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[picked[-1]])
    return unit[picked]


@dataclass(frozen=True)
class PivotIndex:
    """``rows`` are parted by ``_part``; ``low`` and ``high`` have the angles of ``parts`` (each with its number of rows) to ``pivots``."""

    rows: DataFrame
    pivots: np.ndarray
    parts: np.ndarray
    counts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def search(self, query: list[float], k: int = 3, key: str = "chunk_hash", column: str = "vector") -> tuple[DataFrame, list[int]]:
        """The k rows as ``vectors.top_k`` finds them, and the parts that were opened for it.

        The most promising parts that hold k rows come first; their k-th score decides which others can hold a better one.
        """
        q = np.asarray(query, np.float64)
        rows = self.rows.drop("_part")
        if k < 1 or not len(self.parts) or not q.any() or len(q) != self.pivots.shape[1]:
            return top_k(rows.limit(0), query, k, key, column), []
        angle = np.arccos(np.clip(self.pivots @ (q / np.sqrt(q @ q)), -1, 1))
        apart = np.maximum(0, np.maximum(self.low - angle, angle - self.high).max(1) - SLACK)
        best = np.maximum(0, np.cos(np.minimum(apart, np.pi)))
        order = np.lexsort((self.parts, -best))
        enough = int(np.searchsorted(np.cumsum(self.counts[order]), k)) + 1
        first = self.parts[order[:enough]].tolist()
        found = top_k(self.rows.where(F.col("_part").isin(first)).select(key, column), query, k, key, column).select("score").collect()
        least = found[-1].score if len(found) == k else 0.0
        opened = sorted({*first, *self.parts[best >= least - 1e-9].tolist()})
        return top_k(self.rows.where(F.col("_part").isin(opened)).drop("_part"), query, k, key, column), opened


def build(chunks: DataFrame, dim: int, key: str = "chunk_hash", column: str = "vector", pivots: int = PIVOTS, rings: int = RINGS) -> PivotIndex:
    """An index of the rows whose vector has ``dim`` values and a norm above 0. Pivots come from SAMPLE rows, by a hash of the key; every row is indexed."""
    ship(chunks.sparkSession)
    some = chunks.where(F.size(column) == dim).orderBy(F.xxhash64(key), key).select(column).limit(SAMPLE).toArrow().combine_chunks()
    unit = _matrix(some.to_batches()[0], column, dim)[0] if len(some) else np.zeros((0, dim))
    unit = unit[np.isfinite(unit).all(1)]
    chosen = spread(unit, pivots) if len(unit) else np.eye(1, dim)
    angles = pa.list_(pa.float64())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, at = _matrix(batch, column, dim)
            a = np.arccos(np.clip(np.nan_to_num(m) @ chosen.T, -1, 1))
            near = a.argmin(1) if len(a) else np.zeros(0, np.int64)
            ring = np.minimum((a[np.arange(len(a)), near] / (np.pi / 2) * rings).astype(np.int64), rings - 1)
            own = batch.take(pa.array(at))
            arrays = [*own.columns, pa.array(near * rings + ring, pa.int32()), pa.array(list(a), angles)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*own.schema.names, "_part", "_angles"])

    schema = T.StructType([*chunks.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_angles", T.ArrayType(T.DoubleType()))])
    rows = staged(chunks.mapInArrow(placed, schema), parts="_part")
    ends = [f(F.col("_angles")[j]).alias(f"{n}{j}") for n, f in (("low", F.min), ("high", F.max)) for j in range(len(chosen))]
    told = rows.groupBy("_part").agg(F.count("*").alias("n"), *ends).orderBy("_part").collect()  # pivots times rings rows at most
    of = lambda n: np.array([[r[f"{n}{j}"] for j in range(len(chosen))] for r in told], float).reshape(-1, len(chosen))
    return PivotIndex(rows.drop("_angles"), chosen, np.array([r["_part"] for r in told], np.int64), np.array([r.n for r in told], np.int64), of("low"), of("high"))
