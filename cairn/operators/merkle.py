"""A tree of content hashes over file paths, its statistics, its upkeep, and differences.

Nodes are (path, parent, depth, type, hash, size); the root is the empty path. A
directory's hash is that of its children's hashes in path order. Of more than
FAN children, blocks of FAN neighbours are hashed first, then blocks of blocks,
so that a directory of any size is shared among tasks. ``tree`` writes its files
parted by a hash of their parent (``bucket``), and so does the engine's store:
the children of some directories are then read without the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators.order import running
from cairn.shared import staged

#: Children whose hashes are hashed at once.
FAN = 1_024
#: Parts of a tree that ``tree`` writes.
BUCKETS = 16
COLUMNS = ["path", "parent", "depth", "type", "hash", "size"]
NODE = "path string, parent string, depth int, type string, hash string, size bigint"


def bucket_of(parent: Column, buckets: int) -> Column:
    """The part that holds the children of ``parent``."""
    return F.pmod(F.xxhash64(parent), F.lit(buckets)).cast("int")


def leaves(files: DataFrame, *extra: str) -> DataFrame:
    """The nodes of ``files`` (path, hash, size), with ``extra`` columns of theirs."""
    return files.select("path", paths.dirname(F.col("path")).alias("parent"), F.size(F.split("path", "/")).alias("depth"), F.lit("file").alias("type"), "hash", F.col("size").cast("bigint").alias("size"), *extra)


def _digest(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    kids = F.array_sort(F.collect_list(F.struct(order, "hash")))
    return rows.groupBy(*by).agg(kids.alias("_kids")).select(*by, F.sha2(F.array_join(F.transform("_kids", lambda k: k.hash), "").cast("binary"), 256).alias("hash"))


def fold(children: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(parent, hash) of the directories that have ``children`` (parent, path, hash), a written frame, and what was written for it. One buffer holds FAN hashes at most."""
    large = children.groupBy("parent").agg(F.count("*").alias("_n")).where(F.col("_n") > FAN).select("parent")
    if large.isEmpty():
        return _digest(children, ["parent"], "path"), []
    out = _digest(children.join(large, "parent", "left_anti"), ["parent"], "path")
    rows = running(children.join(large, "parent", "left_semi").withColumn("_one", F.lit(1)), "parent", ["path"], "_one", "_at", ["parent", "hash"], before_it=True)
    written = []
    while True:
        blocks = staged(_digest(rows.withColumn("_block", F.expr(f"_at div {FAN}L")), ["parent", "_block"], "_at").withColumnRenamed("_block", "_at"), rows)
        written.append(blocks)
        more = blocks.where("_at > 0").select("parent").distinct()
        out = out.unionByName(blocks.join(more, "parent", "left_anti").select("parent", "hash"))
        if more.isEmpty():
            return out, written
        rows = staged(blocks.join(more, "parent", "left_semi"))


def _directories(folded: DataFrame, depth: int) -> DataFrame:
    return folded.select(
        F.col("parent").alias("path"), F.when(F.col("parent") != "", paths.dirname(F.col("parent"))).alias("parent"), F.lit(depth).alias("depth"),
        F.lit("directory").alias("type"), "hash", F.lit(None).cast("bigint").alias("size"),
    )


def _root(frame: DataFrame) -> DataFrame:
    """The root over no file, as a node."""
    return frame.sparkSession.range(1).select(F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit("directory").alias("type"), F.sha2(F.lit(b""), 256).alias("hash"), F.lit(None).cast("bigint").alias("size"))


def tree(files: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The nodes of files (path, hash, size) and of all directories above them, with ``bucket``.

    Levels fold from the deepest up, and each is written before the next reads
    it. The root stands even over no file. ``discard`` takes back all that was written.
    """
    marked = lambda d: d.withColumn("bucket", bucket_of(F.col("parent"), buckets))
    leaf = staged(marked(leaves(files)), parts="bucket")
    depth = leaf.agg(F.max("depth")).first()[0] or 0
    levels, below = [leaf], None
    for d in range(depth, 0, -1):
        here = leaf.where(F.col("depth") == d)
        here = here if below is None else here.unionByName(below)
        folded, used = fold(here)
        below = staged(marked(_directories(folded, d - 1)), *used)
        levels.append(below)
    if not depth:
        levels.append(staged(marked(_root(files))))
    out = reduce(DataFrame.unionByName, levels)
    out._cairn_parts = levels
    return out


def _under(nodes: DataFrame, dirs: DataFrame, depth: int, buckets: int | None) -> DataFrame:
    """The ``nodes`` at ``depth`` whose parent is in ``dirs`` (path); of ``buckets`` parts, only those that hold some are read."""
    level = nodes.where(F.col("depth") == depth)
    if buckets:
        asked = [r[0] for r in dirs.select(bucket_of(F.col("path"), buckets)).distinct().collect()]  # one for each part at most
        level = level.where(F.col("bucket").isin(asked))
    return level.select(COLUMNS).join(dirs.select(F.col("path").alias("parent")), "parent", "left_semi")


def update(nodes: DataFrame, now: DataFrame, changed: DataFrame, buckets: int | None = None) -> DataFrame:
    """The directories that are new, gone (hash is null) or hash otherwise once files at ``changed`` (path) have changed; a written frame of nodes.

    ``nodes`` are the directories as they were, ``now`` the file nodes as they are. Only
    directories with a changed child are folded again, from the deepest up, so work stops at one
    that hashes as before. ``buckets``: both frames are parted by that many, as ``tree`` does it.
    """
    at = staged(leaves(changed.select("path", F.lit("").alias("hash"), F.lit(0).alias("size"))).select("path", "parent", "depth"))
    deepest = at.agg(F.max("depth")).first()[0] or 0
    made: list[DataFrame] = []
    for d in range(deepest - 1, -1, -1):
        asked = at.where(F.col("depth") == d + 1).select(F.col("parent").alias("path"))
        asked = (asked.unionByName(made[-1].select(F.col("parent").alias("path"))) if made else asked).distinct()
        kids = _under(now, asked, d + 1, buckets).select("parent", "path", "hash")
        dirs = _under(nodes, asked, d + 1, buckets).select("parent", "path", "hash")
        if made:
            dirs = dirs.join(made[-1].select("path"), "path", "left_anti").unionByName(made[-1].where("hash is not null").select("parent", "path", "hash"))
        kids = staged(kids.unionByName(dirs))
        folded, used = fold(kids)
        found = _directories(asked.withColumnRenamed("path", "parent").join(folded, "parent", "left"), d)
        if not d:
            found = found.withColumn("hash", F.coalesce("hash", F.sha2(F.lit(b""), 256)))
            was = nodes.where("depth = 0").select("path", F.col("hash").alias("_was"))
        else:
            was = _under(nodes, asked.select(paths.dirname(F.col("path")).alias("path")).distinct(), d, buckets).select("path", F.col("hash").alias("_was"))
        made.append(staged(found.join(was, "path", "left").where("not (hash <=> _was)").select(COLUMNS), kids, *used))
    if not made:
        return staged(changed.sparkSession.createDataFrame([], NODE), at)
    return staged(reduce(DataFrame.unionByName, made), at, *made)


def to_json(nodes: DataFrame) -> DataFrame:
    """A line of JSON (``value``) for each node, to be written as text."""
    return nodes.select(F.to_json(F.struct("path", "parent", "depth", "type", "hash", "size")).alias("value"))


def from_json(lines: DataFrame) -> DataFrame:
    """The nodes that ``to_json`` wrote."""
    return lines.select(F.from_json("value", NODE).alias("n")).select("n.*")


def stats(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        F.count_if(F.col("type") == "file").alias("files"), F.count_if(F.col("type") == "directory").alias("dirs"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max(F.when(F.col("path") == "", F.col("hash"))).alias("root_hash"),
    )


def diff(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(path, type, hash) of files (path, hash) that were added, modified or deleted; sees every rename."""
    if old is None:
        return new.select("path", F.lit("added").alias("type"), "hash")
    a, b = old.select("path", F.col("hash").alias("was")), new.select("path", "hash")
    both = a.join(b, "path", "full_outer").where("not (was <=> hash)")
    return both.select("path", F.when(F.col("was").isNull(), "added").when(F.col("hash").isNull(), "deleted").otherwise("modified").alias("type"), "hash")


def diff_pruned(old: DataFrame | None, new: DataFrame, buckets: int | None = None) -> DataFrame:
    """As ``diff``, of two trees, but nothing below directories of equal hash is looked at.

    From the root down, the children of unequal directories are compared, level by
    level; those of directories that only one tree has are unequal too. ``buckets``: both
    trees are parted by that many, so that a level reads only the parts that hold such
    children. A directory's hash leaves out names, so a rename that keeps the order of its siblings is not seen.
    """
    if old is None:
        return diff(None, new.where("type = 'file'"))
    side = lambda t, d, c, asked: (t.where("depth = 0").select(COLUMNS) if asked is None else _under(t, asked, d, buckets)).select("path", F.col("type").alias(f"{c}_type"), F.col("hash").alias(f"{c}_hash"))
    asked, d, found = None, 0, []
    while True:
        both = side(old, d, "old", asked).join(side(new, d, "new", asked), "path", "full_outer")
        found.append(staged(both.where("not (old_hash <=> new_hash and old_type <=> new_type)")))
        asked, d = found[-1].where("old_type = 'directory' or new_type = 'directory'").select("path"), d + 1
        if asked.isEmpty():
            break
    unequal = reduce(DataFrame.unionByName, found).where("old_type = 'file' or new_type = 'file'")
    kind = F.when(F.coalesce(F.col("old_type"), F.lit("")) != "file", "added").when(F.coalesce(F.col("new_type"), F.lit("")) != "file", "deleted").otherwise("modified")
    out = unequal.select("path", kind.alias("type"), F.when(F.col("new_type") == "file", F.col("new_hash")).alias("hash"))
    out._cairn_parts = found
    return out


def change_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("type").agg(F.count("*").alias("n"))


def change_lines(changes: DataFrame, most: int = 10) -> list[str]:
    """A marker and the path of the first ``most`` changes in path order, and how many more there are."""
    marker = F.when(F.col("type") == "added", "A").when(F.col("type") == "deleted", "D").otherwise("M")
    lines = [r[0] for r in changes.orderBy("path").limit(most).select(F.concat_ws(" ", marker, "path")).collect()]
    more = changes.count() - most
    return [*lines, f"... {more} more"] if more > 0 else lines


def changed_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose signature (path, sig) is new, gone or different."""
    a, b = old.select("path", F.col("sig").alias("was")), new.select("path", "sig")
    return a.join(b, "path", "full_outer").where("not (was <=> sig)").select("path")
