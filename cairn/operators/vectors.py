"""Exact cosine search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import vector
from cairn.shared import staged
from cairn.shipping import ship


def with_norm(chunks: DataFrame, column: str = "vector") -> DataFrame:
    return chunks.withColumn("norm", vector.norm(F.col(column)))


def _matrix(batch: pa.RecordBatch, column: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows whose vector has ``dim`` values and a norm above 0, from the batch's flat buffer, and their places."""
    found = batch.column(batch.schema.get_field_index(column))
    sizes = found.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == dim)
    if not dim or not len(at):
        return np.zeros((0, dim)), at[:0]
    rows = found if len(at) == len(found) else found.take(pa.array(at))
    m = np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(at), dim)
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    live = ~(n <= 0)  # what is no number stays and scores 0
    return m[live] / n[live][:, None], at[live]


def _scores(m: np.ndarray) -> np.ndarray:
    return np.clip(np.nan_to_num(m, nan=0.0), 0.0, 1.0)


def top_k(chunks: DataFrame, query: list[float], k: int = 3, key: str = "chunk_hash", column: str = "vector") -> DataFrame:
    """The k rows nearest to ``query``: score descending, then ``key``.

    Rows of norm 0, and vectors of another length than the query's, are never
    returned; negative scores count as 0. A query of norm 0, or a k below 1, finds nothing. Scores come from one matrix product
    for each Arrow batch; a task keeps its k best rows, and Spark takes the k best of those.
    """
    q = np.asarray(query, np.float64)
    length = float(np.sqrt(q @ q))
    if k < 1 or not length:
        return chunks.withColumn("score", F.lit(0.0)).limit(0)
    unit = q / length

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, low = None, -1.0
        for batch in batches:
            m, at = _matrix(batch, column, len(q))
            s = _scores(m @ unit)
            near = np.flatnonzero(s >= low)
            if not len(near):
                continue
            if len(near) > k:  # ties of the last one stay, the key decides
                near = near[s[near] >= np.partition(s[near], len(near) - k)[len(near) - k]]
            some = pa.Table.from_batches([batch.take(pa.array(at[near]))]).append_column("_score", pa.array(s[near]))
            held = some if held is None else pa.concat_tables([held, some])
            held = held.take(pc.sort_indices(held, [("_score", "descending"), (key, "ascending")])[:k])
            if len(held) == k:
                low = held["_score"][k - 1].as_py()
        if held is not None:
            yield from held.combine_chunks().to_batches()

    ship(chunks.sparkSession)
    schema = T.StructType([*chunks.schema.fields, T.StructField("_score", T.DoubleType())])
    return chunks.mapInArrow(best, schema).orderBy(F.desc("_score"), key).limit(k).withColumnRenamed("_score", "score")


def checked(rows: DataFrame, dim: int, column: str = "vector") -> DataFrame:
    """``rows``, whose use fails if a vector has another length than ``dim``."""
    wrong = F.raise_error(F.format_string(f"a vector has %d values, not {dim}", F.size(column))).cast("array<float>")
    return rows.withColumn(column, F.when(F.size(column) == dim, F.col(column)).otherwise(wrong))


#: Queries that are compared in one pass over the rows: what a task holds of them, some tens of megabytes.
QUERY_BLOCK = 8_192
#: Scores that a task holds at once.
SCORES = 4_000_000


def top_k_each(chunks: DataFrame, queries: DataFrame, k: int = 3, key: str = "chunk_hash", column: str = "vector", query_key: str = "query_id") -> DataFrame:
    """``query_key``, ``key``, score and rank of the k nearest rows of each query.

    Queries are a stated set. QUERY_BLOCK of them at a time go to all tasks, which compare them with the rows
    where these lie and keep k of each query; only those keys and scores are
    shuffled, never a vector. Vectors of unlike length don't meet. Beyond one block, each block's result is written before the next.
    """
    spark = chunks.sparkSession
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    schema = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(key, chunks.schema[key].dataType), T.StructField("score", T.DoubleType())])
    rows, found = chunks.select(key, column), []
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    for b in range(blocks):
        some = queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b).select(query_key, column).toArrow()  # a block, some thousands of rows
        block = spark.sparkContext.broadcast(some)
        near = rows.mapInArrow(partial(_nearest, block, k, key, column, query_key), schema)
        near = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(k, 0))
        found.append(near if blocks == 1 else staged(near))
    ship(spark)
    return reduce(DataFrame.unionByName, found)


def _nearest(block, k: int, key: str, column: str, query_key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best rows of each query of ``block`` among a task's."""
    asked = block.value.combine_chunks()
    asked = asked.to_batches()[0] if len(asked) else None
    if asked is None or k < 1:
        return
    groups = []
    for dim in {d for d in pc.list_value_length(asked[column]).to_pylist() if d}:
        q, at = _matrix(asked, column, dim)
        if len(at):
            groups.append((dim, q, at, np.full(len(at), -1.0)))
    held = None
    step = max(1, SCORES // max([len(q) for _, q, _, _ in groups], default=1))
    for batch in (x.slice(i, step) for x in batches for i in range(0, x.num_rows, step)):
        for dim, q, of, low in groups:
            v, at = _matrix(batch, column, dim)
            if not len(at):
                continue
            s = _scores(q @ v.T)
            if len(at) > k:
                bar = np.maximum(low, np.partition(s, len(at) - k, axis=1)[:, len(at) - k])
            else:
                bar = low
            i, j = np.nonzero(s >= bar[:, None])
            some = pa.table({"q": pa.array(of[i]), "key": batch.column(batch.schema.get_field_index(key)).take(pa.array(at[j])), "score": pa.array(s[i, j])})
            held = some if held is None else pa.concat_tables([held, some])
            order = pc.sort_indices(held, [("q", "ascending"), ("score", "descending"), ("key", "ascending")])
            held = held.take(order).combine_chunks()
            group = held["q"].to_numpy()
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            held = held.take(pa.array(np.flatnonzero(place < k)))
            last = np.flatnonzero(place[place < k] == k - 1)  # queries that have k rows by now, and their worst
            full, worst = held["q"].to_numpy()[last], held["score"].to_numpy()[last]
            mine = np.isin(full, of)
            low[np.searchsorted(of, full[mine])] = worst[mine]
    if held is not None and len(held):
        ids = asked.column(asked.schema.get_field_index(query_key)).take(held["q"].combine_chunks())
        yield from pa.table({query_key: ids, key: held["key"], "score": held["score"]}).combine_chunks().to_batches()
