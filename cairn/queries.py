"""The engine's operators as queries over the test tables, and the same in DuckDB SQL.

``documents`` stands for a tree of text files (source/lang/doc_id.txt), and
``embeddings`` for chunks with vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import ignore, paths, text, vector
from cairn.operators import chunking, embedding, merkle, pivots, report, vectors
from cairn.plans.store import Store, upsert
from cairn.shared import file_system, shared_dir, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file_path, content."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("file_path"), F.coalesce("text", F.lit("")).alias("content"))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(F.col("file_path").alias("path"), text.content_hash(F.col("content")).alias("hash"), F.octet_length("content").alias("size"), "doc_id")


#: A second version of the tree: some documents changed, some gone, some renamed in place.
def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = leaves(spark, sf_dir)
    new = old.where("doc_id % 11 != 3").select(
        F.when(F.col("doc_id") % 13 == 5, F.concat("path", F.lit("x"))).otherwise(F.col("path")).alias("path"),
        F.when(F.col("doc_id") % 7 == 2, F.sha2(F.concat("hash", F.lit("!")).cast("binary"), 256)).otherwise(F.col("hash")).alias("hash"),
    )
    return old.select("path", "hash"), new


_CORPUS = "corpus AS (SELECT doc_id, concat_ws('/', source, lang, doc_id || '.txt') AS file_path, coalesce(text, '') AS content FROM documents)"
_LEAVES = _CORPUS + ", leaves AS (SELECT doc_id, file_path AS path, sha256(content) AS hash, strlen(content) AS size FROM corpus)"
_VERSIONS = _LEAVES + """, old AS (SELECT path, hash FROM leaves), new AS (
  SELECT CASE WHEN doc_id % 13 = 5 THEN path || 'x' ELSE path END AS path, CASE WHEN doc_id % 7 = 2 THEN sha256(hash || '!') ELSE hash END AS hash FROM leaves WHERE doc_id % 11 <> 3)"""
_CHUNKS = _CORPUS + r""", split AS (SELECT file_path, regexp_split_to_array(content, '\n') AS l0 FROM corpus),
ls AS (SELECT file_path, list_transform(range(1, len(l0) + 1), lambda i: l0[i] || CASE WHEN i < len(l0) THEN chr(10) ELSE '' END) AS a FROM split),
lines AS (SELECT file_path, CASE WHEN a[len(a)] = '' THEN a[1:len(a) - 1] ELSE a END AS l FROM ls),
win AS (SELECT file_path, l, unnest(range(0, len(l), 40)) AS s FROM lines),
chunks AS (SELECT file_path, array_to_string(l[s + 1:s + 48], '') AS content, sha256(array_to_string(l[s + 1:s + 48], '')) AS chunk_hash, s + 1 AS start_line, least(s + 48, len(l)) AS end_line FROM win)"""
_BEST = _CHUNKS + ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_hash ORDER BY file_path DESC, start_line DESC) AS r FROM chunks) WHERE r = 1)"
_Q0 = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_COSINE = "least(1.0, greatest(0.0, list_cosine_similarity(embedding::DOUBLE[], q)))"


def _store(spark: SparkSession) -> Store:
    """A store in the shared folder, which goes when the driver ends."""
    store = Store(spark, f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}")
    files, where = file_system(spark, store.root)
    files.deleteOnExit(where)
    return store


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_hash"), F.col("embedding").alias("vector"), "label")


def _first_vector(spark, sf_dir):
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding)


@query(f"WITH {_Q0} SELECT vec_id, round({_COSINE}, 6) AS score FROM embeddings, q ORDER BY {_COSINE} DESC, vec_id LIMIT 10")
def knn_topk(spark, sf_dir):
    found = vectors.top_k(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), 10)
    return found.select(F.col("chunk_hash").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_Q0} SELECT vec_id, round({_COSINE}, 6) AS score FROM embeddings, q ORDER BY {_COSINE} DESC, vec_id LIMIT 10")
def knn_pivots(spark, sf_dir):
    """The same through an index that leaves parts without a winner unread."""
    asked = _first_vector(spark, sf_dir)
    found, _ = pivots.build(_vectors(spark, sf_dir), len(asked)).search(asked, 10)
    return found.select(F.col("chunk_hash").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id, least(1.0, greatest(0.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS score FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def knn_multi_query(spark, sf_dir):
    """Every row whose id is divisible by 100 against all rows."""
    rows = _vectors(spark, sf_dir)
    asked = rows.where("chunk_hash % 100 = 0").select(F.col("chunk_hash").alias("query_id"), "vector")
    found = vectors.top_k_each(rows, asked, 5)
    return found.select("query_id", F.col("chunk_hash").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_Q0} SELECT vec_id, round({_COSINE}, 6) AS score FROM embeddings, q WHERE vec_id % 3 <> 1 ORDER BY {_COSINE} DESC, vec_id LIMIT 10")
def knn_zero_norm_filter(spark, sf_dir):
    """A third of the vectors are zero and never found."""
    zeroed = F.transform("vector", lambda x: F.when(F.col("chunk_hash") % 3 == 1, F.lit(0.0)).otherwise(x).cast("float"))
    found = vectors.top_k(_vectors(spark, sf_dir).withColumn("vector", zeroed), _first_vector(spark, sf_dir), 10)
    return found.select(F.col("chunk_hash").alias("vec_id"), F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"))


@query(f"WITH {_CHUNKS} SELECT file_path, start_line, end_line, length(content) AS n_chars FROM chunks")
def chunk_windows(spark, sf_dir):
    return chunking.windows(corpus(spark, sf_dir)).select("file_path", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), F.length("content").cast("bigint").alias("n_chars"))


@query(f"WITH {_CHUNKS} SELECT file_path, start_line, chunk_hash FROM chunks")
def chunk_hashes(spark, sf_dir):
    return chunking.windows(corpus(spark, sf_dir)).select("file_path", F.col("start_line").cast("bigint").alias("start_line"), "chunk_hash")


@query(f"""WITH {_BEST}, existing AS (SELECT chunk_hash, 'old/' || file_path AS file_path, start_line FROM best WHERE start_line % 2 = 1)
SELECT chunk_hash, file_path, start_line FROM best WHERE start_line < 41 UNION ALL SELECT chunk_hash, file_path, start_line FROM existing e WHERE chunk_hash NOT IN (SELECT chunk_hash FROM best WHERE start_line < 41)""")
def chunk_upsert_dedupe(spark, sf_dir):
    """The last writer of each hash, upserted into an older version of the table."""
    chunks = chunking.windows(corpus(spark, sf_dir)).select("chunk_hash", "file_path", F.col("start_line").cast("bigint").alias("start_line"))
    best = chunking.last_written(chunks)
    existing = best.where("start_line % 2 = 1").withColumn("file_path", F.concat(F.lit("old/"), "file_path"))
    return upsert(existing, best.where("start_line < 41"))


@query(f"WITH {_CHUNKS} SELECT file_path, start_line, chunk_hash FROM chunks WHERE file_path NOT IN (SELECT file_path FROM corpus WHERE doc_id % 5 = 0)")
def chunk_delete_by_file(spark, sf_dir):
    """The chunks of all documents are stored, then those of one file in five deleted, by their postings."""
    files, store = corpus(spark, sf_dir), _store(spark)
    chunks = chunking.windows(files).selectExpr("*", "cast(null as array<float>) as vector", "cast(null as double) as norm")
    none = files.select("file_path").limit(0)
    with store.change() as change:
        change.put_chunks(staged(chunks), none)
    with store.change() as change:
        change.put_chunks(chunks.limit(0), files.where("doc_id % 5 = 0").select("file_path"))
    return store.read("chunks").select("file_path", F.col("start_line").cast("bigint").alias("start_line"), "chunk_hash")


@query(f"""WITH {_CHUNKS}, h AS (SELECT DISTINCT chunk_hash FROM chunks), cache AS (SELECT chunk_hash FROM h WHERE chunk_hash < '8')
SELECT 'hit' AS kind, count(*) AS n FROM chunks WHERE chunk_hash IN (SELECT * FROM cache) UNION ALL SELECT 'miss', count(DISTINCT chunk_hash) FROM chunks WHERE chunk_hash NOT IN (SELECT * FROM cache)""")
def cache_split(spark, sf_dir):
    """A cache that knows about half of the hashes."""
    chunks = chunking.windows(corpus(spark, sf_dir)).select("chunk_hash")
    cache = chunks.where("chunk_hash < '8'").select(F.lit("m").alias("model_id"), "chunk_hash", F.array(F.lit(1.0)).alias("vector"))
    counts = embedding.known(chunks, cache, "m", 1).agg(F.count("vector").alias("hits"), F.count_distinct(F.when(F.col("vector").isNull(), F.col("chunk_hash"))).alias("misses"))
    return counts.select(F.inline(F.array(F.struct(F.lit("hit").alias("kind"), F.col("hits").alias("n")), F.struct(F.lit("miss").alias("kind"), F.col("misses").alias("n")))))


@query(f"WITH {_CHUNKS} SELECT count(*) AS indexed_chunks, count(DISTINCT chunk_hash) AS stored_chunks, count(DISTINCT file_path) AS files FROM chunks")
def apply_stats(spark, sf_dir):
    """Chunks count before equal ones collapse."""
    return chunking.windows(corpus(spark, sf_dir)).agg(F.count("*").alias("indexed_chunks"), F.count_distinct("chunk_hash").alias("stored_chunks"), F.count_distinct("file_path").alias("files"))


def _fold_sql(name: str, source: str) -> str:
    """A CTE of the directories (path, hash) above the nodes of ``source``: hashes of up to 1,024 children, and of such hashes where there are more."""
    up = r"regexp_extract(path, '^(.*)/[^/]*$', 1)"
    placed = f"SELECT {up} AS dir, path, hash, (row_number() OVER (PARTITION BY {up} ORDER BY path) - 1) // 1024 AS b FROM {source}"
    return (
        f"{name}_blocks AS (SELECT dir, b, sha256(string_agg(hash, '' ORDER BY path)) AS hash FROM ({placed}) GROUP BY 1, 2), "
        f"{name} AS (SELECT dir AS path, CASE WHEN count(*) = 1 THEN min(hash) ELSE sha256(string_agg(hash, '' ORDER BY b)) END AS hash FROM {name}_blocks GROUP BY 1)"
    )


_TREE = ", ".join([_LEAVES, _fold_sql("d2", "leaves"), _fold_sql("d1", "d2"), _fold_sql("d0", "d1")])


@query(f"WITH {_TREE} SELECT hash FROM d0")
def merkle_root(spark, sf_dir):
    return merkle.tree(leaves(spark, sf_dir)).where("path = ''").select("hash")


@query(f"WITH {_TREE} SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2")
def merkle_dirs(spark, sf_dir):
    return merkle.tree(leaves(spark, sf_dir)).where("type = 'directory'").select("path", "hash")


@query(f"WITH {_TREE} SELECT (SELECT count(*) FROM leaves) AS files, (SELECT count(*) FROM d1) + (SELECT count(*) FROM d2) + 1 AS dirs, (SELECT sum(size)::BIGINT FROM leaves) AS bytes, (SELECT hash FROM d0) AS root_hash")
def tree_stats(spark, sf_dir):
    return merkle.stats(merkle.tree(leaves(spark, sf_dir)))


_DIFF = _VERSIONS + """, diff AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS type, n.hash AS hash
FROM old o FULL OUTER JOIN new n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash)"""


@query(f"WITH {_DIFF} SELECT path, type, hash FROM diff")
def tree_diff(spark, sf_dir):
    return merkle.diff(*versions(spark, sf_dir))


@query(f"""WITH {_DIFF}, {_fold_sql("od2", "old")}, {_fold_sql("nd2", "new")}
SELECT path, type, hash FROM diff WHERE regexp_extract(path, '^(.*)/[^/]*$', 1) NOT IN (SELECT od2.path FROM od2 JOIN nd2 ON od2.path = nd2.path AND od2.hash = nd2.hash)""")
def tree_diff_pruned(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    sized = lambda d: d.withColumn("size", F.lit(0))
    return merkle.diff_pruned(merkle.tree(sized(old)), merkle.tree(sized(new)), merkle.BUCKETS)


@query(f"WITH {_DIFF} SELECT type, count(*) AS n FROM diff GROUP BY 1")
def change_summary(spark, sf_dir):
    return merkle.change_summary(merkle.diff(*versions(spark, sf_dir)))


IGNORE = "src1/\n*.tmp\nsrc2/de\n?rc3/fr/*9.txt\n# none\n!x\n"


@query(f"""WITH {_CORPUS} SELECT file_path FROM corpus WHERE NOT (split_part(file_path, '/', 1) = 'src1' OR file_path LIKE 'src2/de/%' OR regexp_matches(file_path, '^.rc3/fr/.*9\\.txt$'))""")
def ignore_filter(spark, sf_dir):
    return corpus(spark, sf_dir).where(~ignore.ignored(F.col("file_path"), IGNORE)).select("file_path")


_EXT = "CASE doc_id % 6 WHEN 0 THEN 'A.TS' WHEN 1 THEN 'Dockerfile' WHEN 2 THEN 'x.md' WHEN 3 THEN '.env' WHEN 4 THEN 'b.test.py' ELSE 'ts' END"


def _named(spark, sf_dir):
    return corpus(spark, sf_dir).select(F.expr(f"concat_ws('/', file_path, {_EXT})").alias("path"))


@query(f"WITH {_CORPUS} SELECT concat_ws('/', file_path, {_EXT}) AS path FROM corpus WHERE doc_id % 6 NOT IN (2, 3)")
def profile_filter(spark, sf_dir):
    return _named(spark, sf_dir).where(paths.indexable(F.col("path"), *paths.resolve_profiles()))


@query(f"WITH {_CORPUS} SELECT concat_ws('/', file_path, {_EXT}) AS path, CASE doc_id % 6 WHEN 0 THEN 'typescript' WHEN 4 THEN 'python' WHEN 5 THEN 'typescript' ELSE '' END AS language FROM corpus")
def language_detect(spark, sf_dir):
    return _named(spark, sf_dir).select("path", paths.language(F.col("path")).alias("language"))


@query(f"""WITH {_LEAVES} SELECT path FROM leaves WHERE doc_id % 9 = 4 UNION ALL SELECT path || '.new' FROM leaves WHERE doc_id % 10 = 1 UNION ALL SELECT path FROM leaves WHERE doc_id % 10 = 1 AND doc_id % 9 <> 4""")
def metadata_changes(spark, sf_dir):
    """Signatures of two scans: one in nine changed, one in ten renamed."""
    old = leaves(spark, sf_dir).select("path", "doc_id", paths.signature(F.col("size"), F.col("doc_id")).alias("sig"))
    name = F.when(F.col("doc_id") % 10 == 1, F.concat("path", F.lit(".new"))).otherwise(F.col("path"))
    new = old.select(name.alias("path"), F.when(F.col("doc_id") % 9 == 4, F.concat("sig", F.lit("0"))).otherwise(F.col("sig")).alias("sig"))
    return merkle.changed_metadata(old, new)


@query(r"""WITH d AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '\n+$', ''), chr(10)) AS l FROM documents), s AS (SELECT doc_id, l, l[1:8] AS h, length(least(len(l), 8)::VARCHAR)::INTEGER AS w FROM d)
SELECT doc_id, array_to_string(list_concat(list_transform(range(1, len(h) + 1), lambda i: lpad(i::VARCHAR, w, ' ') || ' │ ' || CASE WHEN length(h[i]) > 200 THEN h[i][1:199] || '…' ELSE h[i] END), CASE WHEN len(l) > 8 THEN [lpad('', w, ' ') || ' │ … ' || (len(l) - 8) || ' more'] ELSE [] END), chr(10)) AS preview FROM s""")
def preview_lines(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", text.preview(F.col("content"), F.lit(1)).alias("preview"))


@query("SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(b / 1024.0 * 10 + 0.5) / 10) WHEN b < 1073741824 THEN printf('%.1f MB', floor(b / 1048576.0 * 10 + 0.5) / 10) ELSE printf('%.1f GB', floor(b / 1073741824.0 * 10 + 0.5) / 10) END AS size FROM (SELECT doc_id, n_chars * (1 + doc_id % 7 * 700) AS b FROM documents)")
def format_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.format_bytes(F.expr("n_chars * (1 + doc_id % 7 * 700)")).alias("size"))


@query("WITH t AS (SELECT floor(value * 1000)::BIGINT AS ns FROM events WHERE value IS NOT NULL), s AS (SELECT list_sort(list(ns)) AS l FROM t) SELECT (SELECT (sum(ns) // count(*))::BIGINT FROM t) AS mean, l[least(len(l), floor(len(l) * 0.5)::BIGINT + 1)] AS p50, l[least(len(l), floor(len(l) * 0.9)::BIGINT + 1)] AS p90, l[len(l)] AS max FROM s")
def bench_percentiles(spark, sf_dir):
    return report.search_summary(table(spark, sf_dir, "events").where("value is not null").select(F.floor(F.col("value") * 1000).cast("bigint").alias("ns")))


@query("SELECT event_type AS name, (sum(floor(value * 1000)::BIGINT) // count(*))::BIGINT AS ns FROM events WHERE user_id % 4 > 0 GROUP BY 1")
def phase_rollup(spark, sf_dir):
    return report.phase_means(table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("run"), F.col("event_type").alias("name"), F.floor(F.col("value") * 1000).cast("bigint").alias("ns")))


@query(f"WITH {_CORPUS} SELECT bool_or(contains(lower(file_path), 'src7/fr')) AS found FROM corpus")
def verify_hits(spark, sf_dir):
    return report.hits_match(corpus(spark, sf_dir), "SRC7/fr")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS starts FROM events),
s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def idle_sessions(spark, sf_dir):
    return report.idle_periods(table(spark, sf_dir, "events")).select("user_id", F.unix_micros(F.col("started").cast("timestamp")).alias("started"), F.unix_micros(F.col("last").cast("timestamp")).alias("last"), "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def event_histogram(spark, sf_dir):
    return report.histogram(table(spark, sf_dir, "events"), "event_type")


@query(f"WITH {_CORPUS} SELECT concat_ws('/', file_path, {_EXT}) AS path, doc_id % 6 IN (0, 4, 5) AS grammar FROM corpus")
def grammar_available(spark, sf_dir):
    return _named(spark, sf_dir).select("path", paths.has_grammar(paths.language(F.col("path"))).alias("grammar"))


_DEEP = "CASE doc_id % 4 WHEN 0 THEN 'a/node_modules/' WHEN 1 THEN '.git/' WHEN 2 THEN 'src/' ELSE 'x.git/' END || file_path"


@query(f"WITH {_CORPUS} SELECT {_DEEP} AS path FROM corpus WHERE doc_id % 4 > 1")
def hard_skip_filter(spark, sf_dir):
    return corpus(spark, sf_dir).select(F.expr(_DEEP).alias("path")).where(~ignore.skipped(F.col("path")))


@query(f"WITH {_CORPUS} SELECT doc_id, file_path || '/x' AS path FROM corpus")
def path_normalize(spark, sf_dir):
    """Backslashes, doubled slashes, dots in front and a slash behind."""
    raw = F.concat(F.lit("././"), F.translate("file_path", "/", "\\"), F.lit("//x/"))
    return corpus(spark, sf_dir).select("doc_id", paths.normalized(raw).alias("path"))


@query(f"WITH {_CORPUS} SELECT doc_id, CASE WHEN doc_id % 3 <> 1 THEN file_path END AS path FROM corpus")
def path_relative(spark, sf_dir):
    """Below the root in another case, outside it, and relative already."""
    raw = F.concat(F.expr("CASE doc_id % 3 WHEN 0 THEN '/data/TREE/' WHEN 1 THEN '/other/' ELSE '' END"), "file_path")
    return corpus(spark, sf_dir).select("doc_id", paths.relative_to("/Data/Tree/", raw).alias("path"))


@query("""WITH d AS (SELECT doc_id, n_chars * (1 + doc_id % 7 * 40) AS ms, n_chars * (1 + doc_id % 5 * 300007) AS ns FROM documents)
SELECT doc_id, CASE WHEN ms < 1000 THEN ms || 'ms' ELSE printf('%d.%02ds', (ms + 5) // 1000, (ms + 5) // 10 % 100) END AS took,
CASE WHEN ns < 1000000 THEN ns || 'ns' WHEN ns < 1000000000 THEN ((ns + 500000) // 1000000) || 'ms' ELSE printf('%d.%02ds', (ns + 5000000) // 1000000000, (ns + 5000000) // 10000000 % 100) END AS took_ns FROM d""")
def format_durations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.format_duration(F.expr("n_chars * (1 + doc_id % 7 * 40)")).alias("took"), text.format_duration_ns(F.expr("n_chars * (1 + doc_id % 5 * 300007)")).alias("took_ns"))


@query("SELECT vec_id, printf('%d.%03d', vec_id % 1001 // 1000, vec_id % 1001 % 1000) AS shown FROM embeddings")
def format_scores(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", text.format_score(F.expr("vec_id % 1001 / 1000D")).alias("shown"))


@query("SELECT (user_id % 4)::BIGINT AS run, sum(floor(value * 1000)::BIGINT)::BIGINT AS ns FROM events WHERE user_id % 3 = 0 GROUP BY 1")
def phase_totals(spark, sf_dir):
    """Phases with a parent don't count again."""
    phases = table(spark, sf_dir, "events").selectExpr("user_id % 4 AS run", "if(user_id % 3 = 0, null, 'outer') AS parent", "cast(floor(value * 1000) AS bigint) AS ns")
    return report.total_time(phases).select(F.col("run").cast("bigint").alias("run"), "ns")


@query("SELECT doc_id, contains(lower(coalesce(text, '')), 'licensed') AND contains(lower(coalesce(text, '')), 'the') AS verified FROM documents")
def answers_verified(spark, sf_dir):
    """Which texts hold all terms, in any case."""
    return report.answer_has(table(spark, sf_dir, "documents"), ["LICENSED", "the"], "text").select("doc_id", "verified")


@query(f"WITH {_CHUNKS} SELECT DISTINCT chunk_hash FROM chunks WHERE chunk_hash >= '8'")
def cache_misses(spark, sf_dir):
    """What is to be embedded, each once; a cached vector of another size counts as none."""
    chunks = chunking.windows(corpus(spark, sf_dir)).select("chunk_hash")
    cache = chunks.select(F.lit("m").alias("model_id"), "chunk_hash", F.when(F.col("chunk_hash") < "8", F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))).alias("vector"))
    return embedding.split_known(chunks, cache, "m", 1)[1]


@query(f"WITH {_TREE} SELECT path, 0 AS depth, hash FROM d0 UNION ALL SELECT path, 1, hash FROM d1 UNION ALL SELECT path, 2, hash FROM d2 UNION ALL SELECT path, 3, hash FROM leaves")
def tree_as_json(spark, sf_dir):
    """The nodes, written as lines of JSON and read again."""
    lines = merkle.to_json(merkle.tree(leaves(spark, sf_dir)))
    return merkle.from_json(lines).select("path", "depth", "hash")


@query(f"""WITH {_VERSIONS}, {", ".join(_fold_sql(f"{v}{d}", f"{v}{d + 1}" if d < 2 else ("old", "new")[v == "n"]) for v in "on" for d in (2, 1, 0))},
o AS (SELECT * FROM o0 UNION ALL SELECT * FROM o1 UNION ALL SELECT * FROM o2), n AS (SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2)
SELECT coalesce(o.path, n.path) AS path, n.hash AS hash FROM o FULL OUTER JOIN n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash""")
def tree_update(spark, sf_dir):
    """The directories that another version of the files changes, folded from the changed paths up."""
    old, new = (v.withColumn("size", F.lit(0)) for v in versions(spark, sf_dir))
    nodes = merkle.tree(old)
    now = merkle.leaves(new).withColumn("bucket", merkle.bucket_of(F.col("parent"), merkle.BUCKETS))
    return merkle.update(nodes.where("type = 'directory'"), staged(now, parts="bucket"), merkle.diff(old, new), merkle.BUCKETS).select("path", "hash")


@query()
def chunk_postprocess(spark, sf_dir):
    """Every fifth line with an "and" begins a declaration; spans then merge and split."""

    def ranges(content: str, _: str):
        found = [i for i, r in enumerate(content.split("\n")) if " and " in r][::5]
        return [(i, i + 2) for i in found if i % 3 == 0]

    return chunking.by_declarations(corpus(spark, sf_dir), ranges).select("file_path", "start_line", "end_line", "chunk_hash")


@query()
def embed_documents(spark, sf_dir):
    """Each distinct chunk embedded once."""
    unique = chunking.last_written(chunking.windows(corpus(spark, sf_dir)))
    return embedding.embed(unique, embedding.HashedWords(64)).select("chunk_hash", "vector", "norm")
