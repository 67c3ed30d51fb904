"""The index of a tree of text files: build, refresh, search, status, watch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cairn.functions import ignore, paths, text
from cairn.operators import chunking, embedding, merkle, vectors
from cairn.plans.config import read_config
from cairn.plans.store import Change, Store, merged
from cairn.shared import discard, staged
from cairn.sources import files as source


class Engine:
    """``on_modify``: "replace" drops a modified file's old chunks, "keep" leaves those whose text is gone.

    ``ignore_text`` stands for the default rules; those of the tree's own file count besides.
    ``by_tasks`` lets tasks walk the tree, in rounds, where its names are too many for the driver.
    Profiles come from the tree's configuration, where it has one. ``progress`` is called
    with the name of a phase and its figures, as soon as they are known.
    """

    #: Chunks that are embedded and put into the cache at once: what a failed refresh loses.
    WAVE = 1_000_000

    def __init__(self, spark: SparkSession, root: str, store: str, embedder: embedding.Embedder | None = None, ignore_text: str = ignore.DEFAULT, include: list[str] | None = None, only: list[str] | None = None, on_modify: str = "replace", prune: bool = False, boundaries: chunking.Boundaries = chunking.boundaries, buckets: int = 16, by_tasks: bool = False, progress: Callable[[str, dict[str, int]], None] | None = None):
        if on_modify not in ("replace", "keep"):
            raise ValueError("on_modify is replace or keep")
        config = read_config(root)
        self.spark, self.root, self.store = spark, root, Store(spark, store, buckets)
        self.embedder = embedder or embedding.HashedWords()
        self.ignore_text = ignore.merged(ignore_text, ignore.read_rules(root))
        self.profiles = paths.resolve_profiles(config.get("fileProfiles"), config.get("defaultProfiles"), include=include, only=only)
        self.by_tasks = by_tasks
        self.on_modify, self.prune, self.boundaries, self.progress = on_modify, prune, boundaries, progress or (lambda phase, figures: None)
        source.register(spark)

    def listing(self) -> DataFrame:
        """path, size, mtime_ms of the files that the rules and the profile admit; nothing is read. With ``by_tasks``, tasks walk the tree."""
        if self.by_tasks:
            files, unread = source.listing(self.spark, self.root, self.ignore_text, self.profiles)
            discard(unread)
            return files
        return self.spark.read.format("cairn_files").options(**source.options(self.root, self.ignore_text, self.profiles, contents=False)).load().drop("content")

    def read(self, listed: DataFrame) -> DataFrame:
        """``listed`` (path, ...) with content and hash, read by the tasks; what can't be read as UTF-8 is left out."""
        raw = source.contents(self.root, listed).withColumn("content", F.col("content").cast("string"))
        return raw.where("content is not null and is_valid_utf8(content)").withColumn("hash", text.content_hash(F.col("content")))

    def scan(self) -> DataFrame:
        """path, size, mtime_ms, content, hash of all files."""
        return self.read(self.listing())

    def tree(self) -> DataFrame:
        return merkle.tree(self.scan().select("path", "hash", "size"), self.store.buckets).drop("bucket")

    def diff(self) -> DataFrame:
        """What changed since the index was last refreshed."""
        now, exists = self.scan().select("path", "hash", "size"), self.store.exists()
        if self.prune:
            return merkle.diff_pruned(self._committed() if exists else None, merkle.tree(now, self.store.buckets), self.store.buckets)
        return merkle.diff(self.store.read("files").select("path", "hash") if exists else None, now.select("path", "hash"))

    def _committed(self) -> DataFrame:
        """The stored tree: its directories, and the files."""
        return self.store.bucketed("tree").unionByName(merkle.leaves(self.store.bucketed("files"), "bucket"))

    def build(self) -> dict[str, int]:
        """From nothing: wipes the store first."""
        self.store.wipe()
        return self.refresh()

    def refresh(self, full: bool = True, listed: DataFrame | None = None) -> dict[str, int]:
        """Applies all changes, which readers see together at the end; one that fails can be run again.

        ``full`` reads and hashes every file, otherwise only those whose size or time changed.
        Contents are read again for files that did change, and for those alone.
        """
        known, exists = self.store.bucketed("files"), self.store.exists()
        n_listed, n_read = Observation(), Observation()
        found = self.listing() if listed is None else listed
        written = [found] if listed is None and self.by_tasks else []
        listed = staged(found.observe(n_listed, F.count(F.lit(1)).alias("n")), *written)
        was = known.select("path", F.struct("size", "mtime_ms").alias("was"))
        looked = listed if full else listed.join(was, "path", "left").where("not (was <=> struct(size, mtime_ms))").drop("was")
        hashed = staged(self.read(looked).select("path", "size", "mtime_ms", "hash").observe(n_read, F.count(F.lit(1)).alias("n")))
        self.progress("hash", {"listed": n_listed.get["n"], "read": n_read.get["n"]})
        # what the store says of all files that were looked at or are gone, beside what was found
        gone = known.join(listed, "path", "left_anti").select("path")
        old = known.join(gone.unionByName(looked.select("path")), "path", "left_semi").select("path", "bucket", F.struct("size", "mtime_ms", "hash").alias("old"))
        both = old.join(hashed.select("path", F.struct("size", "mtime_ms", "hash").alias("new")), "path", "full_outer")
        unlike = staged(both.where("not (old <=> new)"))
        found = unlike.select("path", F.col("old.hash").alias("was"), F.col("new.hash").alias("hash")).where("not (was <=> hash)")
        kind = F.when(F.col("was").isNull(), "added").when(F.col("hash").isNull(), "deleted").otherwise("modified")
        changes = found.select("path", kind.alias("type"), "hash")
        told = {"indexed_chunks": 0, "deleted_files": 0, "changed_files": 0, "failed_files": 0}
        nothing = unlike.isEmpty()
        if nothing and exists:
            discard(listed, hashed, unlike)
            return told
        files, removed = staged(unlike.where("new is not null").select("path", "new.*")), unlike.where("new is null").select("path")
        dirs = self._directories(known, files, removed, changes.select("path"), exists)
        wrote = [listed, hashed, unlike, files, dirs]
        if self.prune and exists:
            now = merkle.leaves(merged(known, files.withColumn("bucket", self.store.bucket("files")), "path", removed), "bucket").unionByName(self._updated(dirs))
            wrote.append(changes := merkle.diff_pruned(self._committed(), now, self.store.buckets))
        with self.store.change() as change:
            if not nothing:
                told = self.apply(changes, change)
            change.merge("files", files, removed)
            if exists:
                change.merge("tree", dirs.where("hash is not null"), dirs.where("hash is null"))
            else:
                change.replace("tree", dirs)
        discard(*wrote)
        return told

    def _directories(self, known: DataFrame, files: DataFrame, removed: DataFrame, changed: DataFrame, exists: bool) -> DataFrame:
        """The directories that change (hash is null: gone), or all of a first refresh; a written frame."""
        if not exists:
            nodes = merkle.tree(files, self.store.buckets)
            return staged(nodes.where("type = 'directory'").select(merkle.COLUMNS), nodes)
        now = merged(known, files.withColumn("bucket", self.store.bucket("files")), "path", removed)
        return merkle.update(self.store.bucketed("tree"), merkle.leaves(now, "bucket"), changed, self.store.buckets)

    def _updated(self, dirs: DataFrame) -> DataFrame:
        """The stored directories as they are after ``dirs``."""
        kept = self.store.bucketed("tree").join(dirs.select("path"), "path", "left_anti")
        return kept.unionByName(dirs.where("hash is not null").withColumn("bucket", self.store.bucket("tree")))

    def apply(self, changes: DataFrame, change: Change | None = None) -> dict[str, int]:
        """Deletes, chunks, embeds what the cache lacks, upserts, for ``changes`` (path, type, hash).

        A file that can't be read any more, or whose content is no longer the one in ``changes``, counts
        as failed and is left to the next refresh. Without ``change`` the chunks are seen at once.
        """
        if change is None:
            with self.store.change() as change:
                return self.apply(changes, change)
        n_fresh, n_made, n_missed = Observation(), Observation(), Observation()
        count = lambda o, d: d.observe(o, F.count(F.lit(1)).alias("n"))
        counts = {r.type: r.n for r in merkle.change_summary(changes).collect()}
        wanted = changes.where("type != 'deleted'").select("path", F.col("hash").alias("wanted"))
        fresh = count(n_fresh, self.read(wanted).where("hash = wanted").select(F.col("path").alias("file_path"), "content"))
        made = staged(count(n_made, chunking.chunk(fresh, self.boundaries)))
        unique = chunking.last_written(made)
        model, dim = self.embedder.model_id, self.embedder.dim
        parts = self.store.touched("embed_cache", made)
        misses = staged(count(n_missed, embedding.split_known(unique, self.store.bucketed("embed_cache", parts), model, dim)[1].select("chunk_hash", "content")))
        found, missed = n_made.get["n"], n_missed.get["n"]
        waves = -(-missed // self.WAVE)
        self.progress("chunk", {"chunks": found, "unknown": missed})
        for wave in range(waves):
            part = misses.where(F.pmod(F.xxhash64("chunk_hash"), F.lit(waves)) == wave)
            added = vectors.checked(embedding.embed(part, self.embedder), dim)
            change.append("embed_cache", added.select(F.lit(model).alias("model_id"), "chunk_hash", "vector"))
            self.progress("embed", {"wave": wave + 1, "waves": waves})
        vectors_of = embedding.known(unique, change.bucketed("embed_cache", parts), model, dim).where("vector is not null")
        rows = staged(vectors.with_norm(vectors_of))
        dropped = staged(changes.where("type = 'deleted'" if self.on_modify == "keep" else "type != 'added'").select(F.col("path").alias("file_path")))
        change.put_chunks(rows, dropped)
        changed = counts.get("added", 0) + counts.get("modified", 0)
        told = {"indexed_chunks": found, "deleted_files": counts.get("deleted", 0), "changed_files": changed, "failed_files": changed - n_fresh.get["n"]}
        discard(made, misses, rows, dropped)
        self.progress("store", told)
        return told

    def search(self, query: str, k: int = 3) -> DataFrame:
        """file_path, start_line, end_line, content, score, preview of the k best chunks."""
        if not isinstance(query, str) or not query.strip():
            raise ValueError("the query is empty")
        return self.search_vector(self.embedder.embed([query])[0].tolist(), k)

    def search_vector(self, vector: list[float], k: int = 3) -> DataFrame:
        if not isinstance(k, int) or k < 1:
            raise ValueError("k must be a whole number, at least 1")
        if len(vector) != self.embedder.dim:
            raise ValueError(f"the vector has {len(vector)} values, not {self.embedder.dim}")
        found = vectors.top_k(self.store.read("chunks"), vector, k)
        return found.select("file_path", "start_line", "end_line", "content", "score", text.preview(F.col("content"), F.col("start_line")).alias("preview"))

    def status(self) -> DataFrame:
        """files, dirs, bytes, root_hash of the stored tree."""
        return merkle.stats(self._committed())

    def watch(self, checkpoint: str, every: str = "2 seconds", once: bool = False, done: Callable[[dict[str, int]], None] | None = None):
        from cairn.streaming.watch import watch

        return watch(self, checkpoint, every, once, done)
