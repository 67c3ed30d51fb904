"""A data source for trees of files: ``spark.read.format("cairn_files")``.

Spark's own file readers leave out empty files and those whose name begins with
a dot or an underscore; this one leaves out only what the ignore rules and the
profile leave out. The driver lists names (some 200 bytes of memory a file), a
directory that is ignored is never entered, and tasks read contents. The tree must
be mounted at the same path on all nodes. Columns: path (relative), size, mtime_ms,
content (binary; null if it can't be read, or isn't asked for).

As a stream it offers a listing (content is null) whenever the tree's files, sizes or
times differ from the last one, after a pause in which changes that come close
together are gathered. Its offset is a number and a digest of the listing.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Iterator

from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.functions import ignore, paths
from cairn.shared import discard, staged

SCHEMA = "path string, size bigint, mtime_ms bigint, content binary"


class Part(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class Rules:
    """What a walk leaves out: segments that a poll never enters, ignored names and paths, and files of no profile."""

    def __init__(self, ignore_text: str, extensions: list[str], filenames: list[str]):
        names, globs = ignore.parse(ignore_text)
        self.exact, self.extensions, self.filenames = set(names), set(extensions), set(filenames)
        self.wild = [re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in g), re.S) for g in globs]

    def out(self, rel: str, name: str) -> bool:
        return name in ignore.SKIPPED or name in self.exact or rel in self.exact or any(w.fullmatch(name) or w.fullmatch(rel) for w in self.wild)

    def indexable(self, name: str) -> bool:
        low = name.lower()
        return not (self.extensions or self.filenames) or low.rsplit(".", 1)[-1] in self.extensions or low in self.filenames


def entries(root: str, base: str, rules: Rules) -> tuple[list[tuple[str, int, int]], list[str], list[tuple[str, int, int]]] | None:
    """Of one directory: its files (path, size, mtime in ms), its own directories, and linked ones (path, device, inode). None if it can't be read, or is gone."""
    files, dirs, links = [], [], []
    try:
        with os.scandir(os.path.join(root, base)) as found:
            listed = sorted(found, key=lambda e: e.name)
    except OSError:
        return None
    for e in listed:
        rel = f"{base}/{e.name}" if base else e.name
        if rules.out(rel, e.name):
            continue
        try:
            if e.is_dir():
                if e.is_symlink():
                    st = e.stat()
                    links.append((rel, st.st_dev, st.st_ino))
                else:
                    dirs.append(rel)
            elif e.is_file() and rules.indexable(e.name):
                st = e.stat()
                files.append((rel, st.st_size, int(st.st_mtime * 1000)))
        except OSError:  # a link to nothing, or a file that went meanwhile
            continue
    return files, dirs, links


def walk(root: str, ignore_text: str, extensions: list[str], filenames: list[str], skipped: list[str] | None = None) -> Iterator[tuple[str, int, int]]:
    """(relative path, size, mtime in ms) of regular files that pass. A directory is listed once, by its own path or else
    the least of the links to it. ``skipped`` gets the directories that can't be read."""
    rules, seen, todo = Rules(ignore_text, extensions, filenames), set(), [""]
    links: list[tuple[str, int, int]] = []
    while todo:
        base = todo.pop()
        try:
            st = os.stat(os.path.join(root, base))
        except OSError:
            st = None
        found = entries(root, base, rules) if st else None
        if found is None:
            if skipped is not None:
                skipped.append(base)
        elif (st.st_dev, st.st_ino) not in seen:
            seen.add((st.st_dev, st.st_ino))
            yield from found[0]
            todo += found[1]
            links += found[2]
        if not todo:
            links = sorted(x for x in links if x[1:] not in seen)
            todo, links = [links[0][0]] if links else [], links[1:]


def read_one(root: str, rel: str) -> bytes | None:
    try:
        with open(os.path.join(root, rel), "rb") as f:
            return f.read()
    except OSError:
        return None


class _Options:
    def __init__(self, options: dict):
        self.root = options["path"]
        self.ignore = options.get("ignore", "")
        self.extensions, self.filenames = (json.loads(options.get(k, "[]")) for k in ("extensions", "filenames"))
        self.parts = int(options.get("partitions", "32"))
        self.contents = options.get("contents", "true") == "true"
        self.pause = float(options.get("pause", "0.5"))

    def walk(self) -> list[tuple[str, int, int]]:
        return list(walk(self.root, self.ignore, self.extensions, self.filenames))


class _Reader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Part]:
        """Files dealt so that all parts hold about as many bytes."""
        files = sorted(self.options.walk(), key=lambda f: -f[1])
        n = max(1, min(self.options.parts, len(files)))
        return [Part(files[i::n]) for i in range(n)]

    def read(self, partition: Part) -> Iterator[tuple]:
        for rel, size, mtime in partition.files:
            yield rel, size, mtime, read_one(self.options.root, rel) if self.options.contents else None


class _Stream(DataSourceStreamReader):
    def __init__(self, options: _Options):
        self.options = options
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        return {"at": 0, "digest": ""}

    def digest(self) -> str:
        return hashlib.sha256("\n".join(sorted(f"{rel}\t{size}:{mtime}" for rel, size, mtime in self.options.walk())).encode("utf-8", "surrogateescape")).hexdigest()

    def latestOffset(self) -> dict:
        """The last offset as long as nothing changed. After a restart the first poll counts as a change; applying it again does nothing."""
        now = self.digest()
        if self.last is not None and now != self.last["digest"]:
            time.sleep(self.options.pause)
            now = self.digest()
        if self.last is None or now != self.last["digest"]:
            self.last = {"at": time.time_ns(), "digest": now}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Part]:
        files = sorted(self.options.walk())
        n = max(1, min(self.options.parts, len(files)))
        return [Part(files[i::n]) for i in range(n)] if start != end else [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        for rel, size, mtime in partition.files:
            yield rel, size, mtime, None

    def commit(self, end: dict) -> None:
        pass


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cairn_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Options(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Options(self.options))


def options(root: str, ignore_text: str = "", profiles: tuple[list[str], list[str]] | None = None, partitions: int = 32, contents: bool = True, pause: float = 0.5) -> dict[str, str]:
    extensions, filenames = profiles if profiles is not None else paths.resolve_profiles()
    return {
        "path": root, "ignore": ignore_text, "extensions": json.dumps(extensions), "filenames": json.dumps(filenames), "partitions": str(partitions), "contents": str(contents).lower(), "pause": str(pause),
    }


#: Directories that one task lists before it hands on those that it found, and tasks of a round.
TASK_DIRS, TASKS = 500, 256
_LISTED = "path string, kind string, size bigint, mtime_ms bigint, dev decimal(20,0), ino decimal(20,0)"


def listing(spark: SparkSession, root: str, ignore_text: str = "", profiles: tuple[list[str], list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, size, mtime_ms of the files, path of the directories that couldn't be read), as ``walk`` has them, but listed by tasks; written frames.

    Each round, tasks go down from the directories that they get and hand on what they have
    no room for, so neither names nor directories pass through the driver. When no
    directory is left, links to directories that were not listed by their own path are
    followed, the least path of each; devices and inodes already seen drop out by a join.
    """
    extensions, filenames = profiles if profiles is not None else paths.resolve_profiles()
    most = TASK_DIRS

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(ignore_text, extensions, filenames)
        for batch in batches:
            todo, rows, room = batch.column(0).to_pylist(), [], most
            while todo and room:
                base, room = todo.pop(), room - 1
                try:
                    st = os.stat(os.path.join(root, base))
                except OSError:
                    st = None
                found = entries(root, base, rules) if st else None
                if found is None:
                    rows.append((base, "unread", None, None, None, None))
                    continue
                rows.append((base, "listed", None, None, Decimal(st.st_dev), Decimal(st.st_ino)))
                rows += [(p, "file", n, t, None, None) for p, n, t in found[0]]
                rows += [(p, "link", None, None, Decimal(d), Decimal(i)) for p, d, i in found[2]]
                todo += found[1]
            rows += [(p, "todo", None, None, None, None) for p in todo]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    from cairn.shipping import ship

    ship(spark)
    schema = to_arrow_schema(T._parse_datatype_string(_LISTED))
    todo, rounds = spark.createDataFrame([("",)], "path string"), []
    while True:
        rounds.append(staged(todo.mapInArrow(down, _LISTED)))
        every = reduce(DataFrame.unionByName, rounds)
        waiting = rounds[-1].where("kind = 'todo'").select("path")
        if waiting.isEmpty():
            seen = every.where("kind = 'listed'").select("dev", "ino").distinct()
            waiting = every.where("kind = 'link'").join(seen, ["dev", "ino"], "left_anti").groupBy("dev", "ino").agg(F.min("path").alias("path")).select("path")
            tried = every.where("kind = 'unread'").select("path")
            waiting = waiting.join(tried, "path", "left_anti")
            if waiting.isEmpty():
                break
        todo = waiting.repartition(TASKS)
    found = staged(every.where("kind = 'file'").select("path", "size", "mtime_ms")), staged(every.where("kind = 'unread'").select("path").distinct())
    discard(*rounds)
    return found


def contents(root: str, listed: DataFrame) -> DataFrame:
    """``listed`` (path and any other columns) with the content of each file (null if it can't be read), read by the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("path")
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                found = pa.array([read_one(root, row.column(at)[0].as_py())], pa.binary())
                yield pa.RecordBatch.from_arrays([*row.columns, found], schema=row.schema.append(pa.field("content", pa.binary())))

    from cairn.shipping import ship

    ship(listed.sparkSession)
    return listed.mapInArrow(run, T.StructType([*listed.schema.fields, T.StructField("content", T.BinaryType())]))


def register(spark: SparkSession) -> None:
    from cairn.shipping import ship

    ship(spark)
    spark.dataSource.register(Files)
