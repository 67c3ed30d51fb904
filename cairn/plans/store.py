"""The index's tables: plain Parquet folders, parted by a hash of a key.

A change writes the parts that it touches anew, once, into a folder of its own,
and a small file names the folders that make up each table. Readers look at that file
once, so they see the tables as of one moment, and a change that fails half-way is
not seen at all. Folders that no table needs any more go at the change after
next, when readers of the moment before are done.

``postings`` tells in which parts of ``chunks`` a file's chunks lie, so that a
delete by file opens those alone.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import paths
from cairn.operators import merkle
from cairn.shared import discard, file_system, staged

CHUNKS = "chunk_hash string, file_path string, start_line int, end_line int, content string, language string, vector array<float>, norm double"
FILES = "path string, size bigint, mtime_ms bigint, hash string"
TREE = "path string, parent string, depth int, type string, hash string, size bigint"
CACHE = "model_id string, chunk_hash string, vector array<float>"
POSTINGS = "file_path string, chunk_bucket int"
SCHEMAS = {"chunks": CHUNKS, "files": FILES, "tree": TREE, "embed_cache": CACHE, "postings": POSTINGS}
KEYS = {"chunks": "chunk_hash", "files": "path", "tree": "path", "embed_cache": "chunk_hash", "postings": "file_path"}
#: Folders of one part of the cache, from which on they are put together.
MOST_PIECES = 8


def merged(existing: DataFrame, rows: DataFrame, key: str, gone: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """``existing`` without the rows whose ``by`` (or key) is in ``gone`` and those whose key ``rows`` have, and ``rows``."""
    if gone is not None:
        existing = existing.join(gone.select(by or key), by or key, "left_anti")
    return existing.join(rows.select(key), key, "left_anti").unionByName(rows)


class Store:
    """``buckets``: parts of a table; a few gigabytes each are a good size."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- the file that names folders -------------------------------------------

    def _state(self) -> dict:
        """``tables``: for each table and part, its folders; ``last``: the number of the newest; ``old``: folders that go at the next change."""
        files, where = file_system(self.spark, f"{self.root}/current.json")
        if not files.exists(where):
            return {"tables": {}, "last": 0, "old": []}
        stream = files.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, state: dict) -> None:
        files, new = file_system(self.spark, f"{self.root}/next.json")
        out = files.create(new, True)
        out.write(json.dumps(state).encode())
        out.close()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        # a plain rename doesn't replace on every file system, this one does
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        over = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(files.makeQualified(new), files.makeQualified(path(f"{self.root}/current.json")), over)

    def _written(self, folder: str) -> list[int]:
        files, where = file_system(self.spark, f"{self.root}/{folder}")
        return [int(s.getPath().getName().split("=")[1]) for s in files.listStatus(where) if s.getPath().getName().startswith("bucket=")]

    # --- reading -----------------------------------------------------------------

    def exists(self) -> bool:
        return "files" in self._state()["tables"]

    def bucketed(self, table: str, parts: list[int] | None = None, state: dict | None = None) -> DataFrame:
        """The table with its ``bucket``, or only ``parts`` of it: others are not even listed."""
        schema = f"{SCHEMAS[table]}, bucket int"
        of = (state or self._state())["tables"].get(table, {})
        names = [f"{self.root}/{f}/bucket={b}" for b, folders in of.items() if parts is None or int(b) in parts for f in folders]
        if not names:
            return self.spark.createDataFrame([], schema)
        # one reader for each folder, which knows its parts by their names
        out = None
        for folder in sorted({n.rsplit("/", 1)[0] for n in names}):
            some = self.spark.read.schema(schema).option("basePath", folder).parquet(*[n for n in names if n.rsplit("/", 1)[0] == folder])
            out = some if out is None else out.unionByName(some)
        return out

    def read(self, table: str) -> DataFrame:
        return self.bucketed(table).drop("bucket")

    def bucket(self, table: str) -> Column:
        """The part of a row: nodes of the tree lie with their siblings, other rows by their key."""
        by = {"files": paths.dirname(F.col("path")), "tree": F.col("parent")}.get(table, F.col(KEYS[table]))
        return merkle.bucket_of(by, self.buckets)

    def touched(self, table: str, rows: DataFrame) -> list[int]:
        """The parts that rows with these keys lie in, as many as there are at most."""
        return [r[0] for r in rows.select(self.bucket(table)).distinct().collect()]

    # --- writing -----------------------------------------------------------------

    def _write(self, state: dict, table: str, rows: DataFrame) -> tuple[str, list[int]]:
        state["last"] += 1
        folder = f"{table}/{state['last']}"
        columns = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        rows.select(*columns, self.bucket(table).alias("bucket")).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{folder}")
        return folder, self._written(folder)

    def change(self) -> Change:
        return Change(self)

    def append(self, table: str, rows: DataFrame) -> None:
        with self.change() as change:
            change.append(table, rows)

    def replace(self, table: str, rows: DataFrame) -> None:
        with self.change() as change:
            change.replace(table, rows)

    def merge(self, table: str, gone: DataFrame, rows: DataFrame) -> None:
        """Drop the keys in ``gone`` (a column, the key) and those of ``rows``, then add ``rows``."""
        with self.change() as change:
            change.merge(table, rows, gone)

    def wipe(self) -> None:
        files, where = file_system(self.spark, self.root)
        if files.exists(where):
            files.delete(where, True)


class Change:
    """Changes of some tables that readers see together, at the end of the ``with`` block, or not at all."""

    def __init__(self, store: Store):
        self.store = store

    def __enter__(self) -> Change:
        self.state = self.store._state()
        self.before = {f for of in self.state["tables"].values() for folders in of.values() for f in folders}
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is not None:
            return
        old, state = self.state["old"], self.state
        now = {f for of in state["tables"].values() for folders in of.values() for f in folders}
        state["old"] = sorted(self.before - now)
        self.store._put(state)
        for folder in old:
            files, where = file_system(self.store.spark, f"{self.store.root}/{folder}")
            files.delete(where, True)

    def bucketed(self, table: str, parts: list[int] | None = None) -> DataFrame:
        """The table as this change leaves it."""
        return self.store.bucketed(table, parts, self.state)

    def append(self, table: str, rows: DataFrame) -> None:
        """Rows beside those that there are; kept even if the rest of the change fails. Parts in many pieces are put together."""
        of = self.state["tables"].setdefault(table, {})
        folder, parts = self.store._write(self.state, table, rows)
        self.before.add(folder)  # seen from now on, so it goes in the same way
        for b in parts:
            of.setdefault(str(b), []).append(folder)
        kept = self.store._state()
        self.store._put({**kept, "last": self.state["last"], "tables": {**kept["tables"], table: of}})
        many = [int(b) for b, folders in of.items() if len(folders) >= MOST_PIECES]
        if many:
            self.rewrite(table, many)

    def _set(self, table: str, parts: list[int], rows: DataFrame) -> None:
        folder, written = self.store._write(self.state, table, rows)
        of = self.state["tables"].setdefault(table, {})
        for b in parts:
            of.pop(str(b), None)
        for b in written:
            of[str(b)] = [folder]

    def replace(self, table: str, rows: DataFrame) -> None:
        self._set(table, [int(b) for b in self.state["tables"].get(table, {})], rows)

    def rewrite(self, table: str, parts: list[int]) -> None:
        """``parts`` in one piece, a row for each key."""
        keys = [KEYS[table], *(["model_id"] if table == "embed_cache" else [])]
        self._set(table, parts, self.bucketed(table, parts).drop("bucket").dropDuplicates(keys))

    def merge(self, table: str, rows: DataFrame, gone: DataFrame | None = None, by: str | None = None, parts: list[int] | None = None) -> None:
        """Drop rows whose ``by`` (or else the key) is in ``gone``, and those whose key ``rows`` (a written frame) have, then add ``rows``.

        Only parts with such keys are read and written, each once. Where ``by`` isn't the key, ``parts`` tells those of ``gone``.
        """
        store, key = self.store, KEYS[table]
        touched = set(store.touched(table, rows))
        if gone is not None:
            touched |= set(store.touched(table, gone) if parts is None else parts)
        if touched:
            there = self.bucketed(table, sorted(touched)).drop("bucket")
            self._set(table, sorted(touched), merged(there, rows.select(there.columns), key, gone, by))

    def put_chunks(self, rows: DataFrame, gone: DataFrame) -> None:
        """Upsert ``rows`` (a written frame), after the chunks of the files in ``gone`` (file_path, a written frame) are deleted.

        The files' postings tell which parts hold their chunks. A posting may be of a chunk that
        another file has since taken over; the chunk's own file_path decides.
        """
        store = self.store
        where = store.bucketed("postings", store.touched("postings", gone)).join(gone, "file_path", "left_semi")
        parts = [r[0] for r in where.select("chunk_bucket").distinct().collect()]  # as many as there are at most
        self.merge("chunks", rows, gone, "file_path", parts)
        told = staged(rows.select("file_path", store.bucket("chunks").alias("chunk_bucket")).distinct())
        kept = store.bucketed("postings", store.touched("postings", told)).join(told.select("file_path").distinct(), "file_path", "left_semi").join(gone, "file_path", "left_anti")
        told = staged(told.unionByName(kept.drop("bucket")).distinct(), told)
        self.merge("postings", told, gone)
        discard(told)


def upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_hash") -> DataFrame:
    """``new`` rows, and the existing ones whose key isn't among them: what a store does with the parts that it touches."""
    return merged(existing, new, key)
