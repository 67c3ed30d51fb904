"""A trie of conversation prefixes, by prefix-doubling names.

Turns get dense numbers, equal ones the same. In each of log2(longest) rounds, a
block of 2k turns that begins at a multiple of 2k gets the number of its pair of
half-blocks. A prefix of d turns is put together from the blocks of d's binary
digits, longest first: in as many rounds again, the prefix that ends before d's
lowest digit and the block of that digit make a pair, and equal pairs one node.
Every round joins rows one to one, so neither a conversation of any length nor a
turn that all conversations share meets in one task; the names of equal pairs
come back by joins whose hot keys Spark can split.

Conversations are ordered by turn (null first), turns of one number by role, then
by the digest of role and text. A null role or text is empty. Rows without
conv_id belong to no conversation. Repeated rows are turns of their own.
No conversation gives no node. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import staged
from cairn.shared import discard
from cairn.shipping import ship

#: Ids that are joined into one row before they are hashed.
BLOCK = 1_024


def running(rows: DataFrame, group: str, order: list[str], value: str, name: str, keep: list[str], before_it: bool = False) -> DataFrame:
    """``keep`` columns of ``rows`` with ``name``: the sum of ``value`` over the rows of the ``group`` up to each (or before it), in ``order``; a written table.

    Rows are dealt into ranges of group and order, so a group of any size is shared among tasks;
    what a group has in the ranges before is added. Groups that lie in several
    ranges are twice as many as there are ranges at most, so their sums are broadcast.
    """
    dealt = staged(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range", group).agg(F.sum(value).alias("_sum"))
    split = sums.join(sums.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1").select(group), group, "left_semi")
    before = F.sum("_sum").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    split = staged(split.select("_range", group, F.coalesce(before, F.lit(0)).alias("_before")))
    within = F.sum(value).over(Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    led = dealt.withColumn("_within", within).join(F.broadcast(split), ["_range", group], "left")
    total = F.col("_within") + F.coalesce("_before", F.lit(0)) - (F.col(value) if before_it else F.lit(0))
    out = staged(led.select(*keep, total.alias(name)))
    discard(dealt, split)
    return out


def named(rows: DataFrame, by: list[str], name: str, first: int = 0) -> tuple[DataFrame, int]:
    """``rows`` with ``name`` in place of ``by``: whole numbers from ``first`` on without gaps, the same for equal ``by``; and the number after the last."""
    spark = rows.sparkSession
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    keys = staged(rows.select(*by).distinct().select(*by, F.spark_partition_id().alias("_task"), row.alias("_row")))
    offsets, at = [], first
    for r in keys.groupBy("_task").count().orderBy("_task").collect():  # a row for each task
        offsets.append((r[0], at))
        at += r[1]
    tasks = F.broadcast(spark.createDataFrame(offsets, "_task int, _first bigint"))
    numbers = keys.join(tasks, "_task").select(*by, (F.col("_first") + F.col("_row")).alias(name))
    out = staged(rows.join(numbers, by).drop(*by))
    discard(keys)
    return out, at


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0), digest of role and text, n_bytes of the text; a written table."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("_turn"), role.alias("_role"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.lit(1).alias("_one"))
    return running(rows, "conv_id", ["_turn", "_role", "digest"], "_one", "at", ["conv_id", "digest", "n_bytes"], before_it=True)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, turns as from ``ordered``), where conversation c is the first h turns of c - c % 5, then its own after its first h.

    h is crc32 of the decimal c, modulo 9, so eight turns at most are taken from another one.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    convs = turns.where("at = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("_of"), h.alias("_h"))
    heads = turns.where("at < 8").groupBy(F.col("conv_id").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("at", "digest", "n_bytes"))).alias("_head"))
    led = convs.join(heads, "_of", "left").select("conv_id", "_h", F.expr("slice(_head, 1, _h)").alias("_head"))
    led = staged(led.withColumn("_p", F.coalesce(F.size("_head"), F.lit(0))))
    taken = led.select("conv_id", F.inline("_head"))
    own = turns.where(F.col("at") >= h).join(led.select("conv_id", "_h", "_p"), "conv_id").select("conv_id", (F.col("at") - F.col("_h") + F.col("_p")).alias("at"), "digest", "n_bytes")
    return staged(led.select("conv_id")), staged(taken.unionByName(own), led)


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, node: the node of each prefix of each conversation, from the root (0) at depth 0. ``turns``: conv_id, at, digest."""
    longest, blocks = turns.agg(F.max("at") + 1).first()[0] or 0, []
    if longest:
        level, _ = named(turns.select("conv_id", "at", "digest"), ["digest"], "name")
        blocks.append(level)
        while 1 << len(blocks) <= longest:
            half = F.col("at") % 2
            pairs = level.groupBy("conv_id", F.expr("at div 2").alias("at")).agg(F.max(F.when(half == 0, F.col("name"))).alias("_left"), F.max(F.when(half == 1, F.col("name"))).alias("_right"))
            level, _ = named(pairs.where("_left is not null and _right is not null"), ["_left", "_right"], "name")
            blocks.append(level)
    found, free = staged(convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("node"))), 1
    parts = [found]
    for k in range(len(blocks) - 1, -1, -1):
        size = 1 << k
        # prefixes whose depth is a multiple of twice the size, and the block that follows each
        before = parts[0]
        for p in parts[1:]:
            before = before.unionByName(p)
        follows = blocks[k].where("at % 2 = 0").select("conv_id", (F.col("at") * size).alias("depth"), F.col("name").alias("_block"))
        pairs = before.join(follows, ["conv_id", "depth"]).select("conv_id", (F.col("depth") + size).alias("depth"), F.col("node").alias("_before"), "_block")
        made, free = named(pairs, ["_before", "_block"], "node", free)
        parts.append(made)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = staged(every.select("conv_id", "depth", "node"))
    discard(*parts, *blocks)
    return every


def trie(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, prefixes) over conversations ``convs`` (conv_id, distinct) and their ``turns`` (conv_id, at from 0 without gaps, digest, n_bytes).

    Nodes have node, conv_id (their smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves and saved_tokens: over the subtree, each node's
    (n_convs - 1) times the bytes of its last turn.
    """
    every = prefixes(convs, turns)
    nodes = every.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"))
    above = every.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    last = turns.select("conv_id", (F.col("at") + 1).alias("depth"), "n_bytes")
    nodes = staged(nodes.join(above, ["conv_id", "depth"], "left").join(last, ["conv_id", "depth"], "left").withColumn("_saved", (F.col("n_convs") - 1) * F.coalesce("n_bytes", F.lit(0))))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    led = staged(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # a leaf is the end of its smallest member, so that member's prefixes are what stands above it
    leaves = every.join(led.where("n_children = 0").select("conv_id"), "conv_id", "left_semi").groupBy("node").agg(F.count("*").alias("n_leaves"))
    # a conversation is the smallest member of its nodes from some depth on, which fewer and fewer others share: what it
    # saves below a depth counts for its own nodes, all that it saves counts for the nodes above them
    shared = led.where("n_convs > 1").select("node", "conv_id", (-F.col("depth")).alias("_up"), "_saved")
    tail = running(shared, "conv_id", ["_up"], "_saved", "_below", ["node"])
    least = led.groupBy("conv_id").agg(F.min("depth").alias("_from"), F.sum("_saved").alias("_all")).where("_all > 0")
    rest = every.join(least, "conv_id").where("depth < _from").groupBy("node").agg(F.sum("_all").alias("_others"))
    parents = led.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = led.join(parents, "parent", "left").join(leaves, "node", "left").join(rest, "node", "left").join(tail, "node", "left")
    saved = F.coalesce("_others", F.lit(0)) + F.coalesce("_below", F.lit(0))
    out = staged(out.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), saved.cast("bigint").alias("saved_tokens")), nodes, led, tail)
    return out, every


def id_digests(rows: DataFrame, group: str, ids: str) -> DataFrame:
    """``group`` and ``ids_sha256``, of its ``ids`` (bigint) in decimal, ascending, joined by commas.

    Ranges of ids are joined into rows of BLOCK ids first; then a task takes the few rows of a
    group one after the other, in order, and keeps no more than the state of the hash.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, i = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
            begins = [b for a, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(g)], strict=False) for b in range(a, e, BLOCK)]
            texts = [",".join(map(str, i[a:e].tolist())) for a, e in zip(begins, [*begins[1:], len(g)], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(g[begins], pa.int64()), pa.array(i[begins], pa.int64()), pa.array(texts, pa.string())], names=["g", "least", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[int, str]] = []
            for g, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if g != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = g, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in done], pa.int64()), pa.array([h for _, h in done], pa.string())], names=["g", "h"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["g", "h"])

    ship(rows.sparkSession)
    led = rows.select(F.col(group).alias("g"), F.col(ids).alias("i"))
    blocks = led.repartitionByRange("g", "i").sortWithinPartitions("g", "i").mapInArrow(join, "g bigint, least bigint, ids string")
    hashed = blocks.repartition("g").sortWithinPartitions("g", "least").mapInArrow(digest, "g bigint, h string")
    return hashed.select(F.col("g").alias(group), F.col("h").alias("ids_sha256"))


def digests(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations, with the digest of those that end at each."""
    turns = ordered(conversations)
    convs, made = rebuilt(turns)
    discard(turns)
    nodes, every = trie(convs, made)
    length = every.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    ends = id_digests(every.join(length, ["conv_id", "depth"]), "node", "conv_id")
    out = staged(nodes.join(ends, "node", "left").drop("node").withColumn("ends_sha256", F.coalesce("ids_sha256", F.sha2(F.lit(b""), 256))).drop("ids_sha256"), convs, made, nodes, every)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_CRC = """list_reduce(list_transform(string_split({0}::VARCHAR, ''), lambda c: unicode(c)::BIGINT), lambda s, b: list_reduce(range(8)::BIGINT[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(s, b)), 4294967295)"""

#: The rule in DuckDB SQL: lists of turns, all their prefixes, and joins of nodes with what begins with them.
SQL = """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS k, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(turn ORDER BY k) AS turns FROM t GROUP BY 1), h AS (SELECT *, xor(""" + _CRC.format("conv_id") + """, 4294967295) % 9 AS h FROM own),
c AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h], []), h.turns[h + 1:]) AS turns FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM c), q AS (SELECT conv_id, depth, turns[1:depth] AS path, len(turns) = depth AS ends FROM p),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS e, (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE strlen(path[depth].text) END AS w FROM q GROUP BY 1, 2),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1), m AS (SELECT n.*, coalesce(kids.n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path)),
up AS (SELECT path[1:unnest(range(0, depth + 1))] AS path, w, n_children = 0 AS leaf FROM m), s AS (SELECT path, count(*) FILTER (leaf) AS n_leaves, sum(w)::BIGINT AS saved_tokens FROM up GROUP BY 1)
SELECT m.conv_id, m.depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, sha256(m.e) AS ends_sha256
FROM m JOIN s ON s.path = m.path LEFT JOIN n a ON m.depth > 0 AND a.path = m.path[1:m.depth - 1]"""
