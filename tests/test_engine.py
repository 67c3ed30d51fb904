"""The engine's operators against hand-derived cases, and every query against DuckDB."""

import hashlib
import json
import os
import signal
import time
import weakref
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn import queries
from cairn.functions import ignore, paths, text
from cairn.operators import chunking, embedding, merkle, pieces, pivots, report, vectors
from cairn.plans.config import read_config
from cairn.plans.engine import Engine
from cairn.plans.store import Store
from cairn.sources import files as source
from cairn.streaming import watch as watching

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(d):
    d = d[sorted(d.columns)].astype(object)
    return sorted(repr([x.tolist() if hasattr(x, "tolist") else x for x in r]) for r in d.values.tolist())


def brute_postprocess(docs):
    out = []
    for d in docs.itertuples():
        text_ = d.text or ""
        lines_ = text_.splitlines(True)
        marks = [i for i, r in enumerate(text_.split("\n")) if " and " in r][::5]
        spans, at = [], 0
        for i in marks:
            if i % 3 == 0:
                spans += [(at, i)] * (i > at) + [(i, min(i + 2, len(lines_)))]
                at = min(i + 2, len(lines_))
        spans += [(at, len(lines_))] * (at < len(lines_) and bool(spans))
        done = []
        while spans:
            a, b = spans.pop(0)
            if b - a < 4 and spans:
                done.append((a, spans.pop(0)[1]))
            else:
                done += [(s, min(s + 48, b)) for s in range(a, b, 40)] if b - a > 60 else [(a, b)]
        for a, b in done or [(s, min(s + 48, len(lines_))) for s in range(0, len(lines_), 40)]:
            body = "".join(lines_[a:b])
            if body:
                out.append((f"{d.source}/{d.lang}/{d.doc_id}.txt", a + 1, b, hashlib.sha256(body.encode()).hexdigest()))
    return pd.DataFrame(out, columns=["file_path", "start_line", "end_line", "chunk_hash"])


def brute_embed(docs):
    out = {}
    for d in docs.itertuples():
        lines_ = (d.text or "").splitlines(True)
        for s in range(0, len(lines_), 40):
            body = "".join(lines_[s : s + 48])
            v = [0.0] * 64
            for w in body.lower().split():
                for part, weight in [(w, 1.0)] + [(w[i : i + 3], 0.25) for i in range(len(w) - 2)]:
                    h = zlib.crc32(part.encode())
                    v[h % 64] += weight if h >> 31 else -weight
            out[hashlib.sha256(body.encode()).hexdigest()] = v
    return pd.DataFrame([(h, np.array(v, np.float32), float(np.sqrt(sum(x * x for x in v)))) for h, v in out.items()], columns=["chunk_hash", "vector", "norm"])


BRUTE = {"chunk_postprocess": brute_postprocess, "embed_documents": brute_embed}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.ORACLE_SQL:
        assert rows(got) == rows(BRUTE[name](spark.read.parquet(f"{SF}/documents.parquet").toPandas()))
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def column(spark, values, make):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(make(F.col("v"))).collect()]


def test_windows(spark):
    n = {0: [], 1: [(1, 1)], 40: [(1, 40)], 41: [(1, 41), (41, 41)], 48: [(1, 48), (41, 48)], 80: [(1, 48), (41, 80)], 81: [(1, 48), (41, 81), (81, 81)], 100: [(1, 48), (41, 88), (81, 100)]}
    files = spark.createDataFrame([(f"{k:03}.txt", "x\n" * k) for k in n], "file_path string, content string")
    got = {}
    for r in chunking.windows(files).orderBy("start_line").collect():
        got.setdefault(int(r.file_path[:3]), []).append((r.start_line, r.end_line))
    assert got == {k: v for k, v in n.items() if v}


def test_arrange():
    def sizes(*spans):
        at, out = 0, []
        for s in spans:
            out.append((at, at + s))
            at += s
        return [e - s for s, e in chunking.arrange(out)]

    assert sizes(2, 3, 10) == [5, 10] and sizes(1, 1, 1) == [2, 1] and sizes(3, 70) == [73] and sizes(70, 2) == [48, 30, 2] and sizes(2) == [2]


def test_lines(spark):
    values = ["", "a", "a\n", "a\n\n", "a\r\nb", "a b", "a\rb", "\x0bx\x1cy\x85z"]
    assert column(spark, values, text.lines) == [v.splitlines(True) for v in values]


def test_ignore(spark):
    def out(rules, *names):
        return column(spark, names, lambda c: ignore.ignored(c, rules))

    assert out("dist/", "dist/a.js", "x/dist/a.js", "dist", "distx") == [True, True, True, False]
    assert out("*.log", "logs/a.log", "a.logs") == [True, False]
    assert out("src/gen/", "src/gen/a.ts", "x/src/gen/a.ts") == [True, False]
    assert out("src/*.ts", "src/a/b.ts") == [True]
    assert out("**/*.fixture.ts", "a/x.fixture.ts", "x.fixture.ts") == [True, False]
    assert out("[ab].ts\n{a,b}.ts\n!keep.log\n/dist\n# c\n\n", "a.ts", "keep.log", "dist/a.js") == [False] * 3


def test_profiles_and_languages(spark):
    names = ["a/B.TS", "Dockerfile", "Dockerfile.dev", "ts", "README.md", ".env"]
    assert column(spark, names, lambda c: paths.indexable(c, *paths.resolve_profiles())) == [True, True, False, True, False, False]
    assert column(spark, [".env"], lambda c: paths.indexable(c, *paths.resolve_profiles(only=["data"]))) == [True]
    assert column(spark, ["a.mjs", "a.tsx", "a.h", "a.sql", "py"], paths.language) == ["javascript", "tsx", "c", "", "python"]
    with pytest.raises(ValueError):
        paths.resolve_profiles(only=["nope"])
    with pytest.raises(ValueError):
        paths.resolve_profiles(only=["code"], include=["docs"])


def test_paths(spark):
    assert column(spark, ["a\\b//c/", "./x"], paths.normalized) == ["a/b/c", "x"]
    assert column(spark, ["/R/a/b", "/other/a", "c/d"], lambda c: paths.relative_to("/r", c)) == ["a/b", None, "c/d"]


def diffs(spark, old, new):
    frame = lambda d: spark.createDataFrame([(p, h, 1) for p, h in d.items()], "path string, hash string, size int")
    show = lambda d: sorted((r.type, r.path) for r in d.collect())
    a, b = (None if old is None else frame(old)), frame(new)
    return show(merkle.diff_pruned(None if a is None else merkle.tree(a), merkle.tree(b))), show(merkle.diff(a, b))


def test_diff(spark):
    assert diffs(spark, None, {"a": "1", "b": "2"}) == ([("added", "a"), ("added", "b")],) * 2
    assert diffs(spark, {"a": "1"}, {"a": "1"}) == ([], [])
    assert diffs(spark, {"a": "1"}, {"a": "2"}) == ([("modified", "a")],) * 2
    assert diffs(spark, {"a": "1", "b": "2"}, {"a": "1"}) == ([("deleted", "b")],) * 2
    assert diffs(spark, {"d/a": "1"}, {"d/b": "1"}) == ([], [("added", "d/b"), ("deleted", "d/a")])
    assert diffs(spark, {"p": "1"}, {"p/x": "2"}) == ([("added", "p/x"), ("deleted", "p")],) * 2


def test_tree_as_json(spark):
    nodes = merkle.tree(spark.createDataFrame([("a/b", "h1", 3), ("c", "h2", 4)], "path string, hash string, size int"))
    lines = merkle.to_json(nodes)
    assert all(json.loads(r.value)["hash"] for r in lines.collect())
    assert sorted(merkle.from_json(lines).collect(), key=str) == sorted(nodes.drop("bucket").collect(), key=str)


def test_empty_tree(spark):
    row = merkle.stats(merkle.tree(spark.createDataFrame([], "path string, hash string, size int"))).first()
    assert (row.files, row.dirs, row.bytes, len(row.root_hash)) == (0, 1, 0, 64)


def test_top_k(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.0]), ("c", [0.0, 0.0]), ("d", [1.0, 1.0]), ("e", [2.0, 0.0])], "chunk_hash string, vector array<float>")
    keys = lambda q, k: [r.chunk_hash for r in vectors.top_k(rows, q, k).collect()]
    assert [r.chunk_hash for r in vectors.top_k(rows.union(spark.createDataFrame([("f", [1.0])], rows.schema)), [1.0, 0.0], 9).collect()] == ["a", "e", "d", "b"]
    with pytest.raises(Exception, match="a vector has 1 values, not 2"):
        vectors.checked(spark.createDataFrame([("f", [1.0])], rows.schema), 2).collect()
    assert keys([1.0, 0.0], 9) == ["a", "e", "d", "b"] and keys([1.0, 0.0], 1) == ["a"] and keys([1.0, 0.0], 0) == [] and keys([0.0, 0.0], 3) == []


@pytest.mark.parametrize("block", [8_192, 3])
def test_top_k_each(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    rng = np.random.default_rng(0)
    data = [(f"k{i:02}", [float(x) for x in np.round(rng.normal(size=3))]) for i in range(40)] + [("zero", [0.0] * 3), ("short", [1.0])]
    rows = spark.createDataFrame(data, "chunk_hash string, vector array<float>")
    asked = rows.limit(10).selectExpr("chunk_hash query_id", "vector")
    want = set()
    for q, v in [(r.query_id, np.array(r.vector)) for r in asked.collect() if any(r.vector)]:
        scores = sorted((-max(0.0, float(v @ np.array(w) / np.linalg.norm(v) / np.linalg.norm(w))), k) for k, w in data if len(w) == 3 and any(w))
        want |= {(q, k, i + 1) for i, (_, k) in enumerate(sorted((round(s, 9), k) for s, k in scores)[:5])}
    assert {(r.query_id, r.chunk_hash, r["rank"]) for r in vectors.top_k_each(rows.withColumn("norm", vectors.vector.norm(F.col("vector"))), asked, 5).select("query_id", "chunk_hash", "rank").collect()} == want
    assert vectors.top_k_each(rows.limit(0), asked, 5).count() == vectors.top_k_each(rows, asked.limit(0), 5).count() == 0


def test_percentiles(spark):
    some = lambda v: report.search_summary(spark.createDataFrame([(x,) for x in v], "ns bigint")).first()
    assert tuple(some([1, 2, 3, 4])) == (2, 3, 4, 4) and tuple(some([])) == (0, 0, 0, 0)
    values = [int(x) for x in np.random.default_rng(1).integers(-(10**15), 10**15, 501)] + [7] * 100
    place = sorted(values)
    assert tuple(some(values))[1:] == (place[300], place[540], place[-1])


def write(root, name, content):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_build_refresh_search(spark, tmp_path):
    root = tmp_path / "tree"
    for name in ("__init__.py", "_app.ts", ".dot.py", "_u/w.py", ".hid/z.py", "a/b/y.ts", "node_modules/x.js", "notes.md"):
        write(root, name, f"value_{abs(hash(name)) % 1000} = 1\n")
    write(root, "a/x.py", "import os\n\n# adds\ndef add(a, b):\n    return a + b\n\n\nclass Penguin:\n    swim = True\n    fly = False\n    cold = True\n")
    write(root, "empty.py", "")
    write(root, "a/bad.py", b"\xff\xfe\xff")
    engine = Engine(spark, str(root), f"file://{tmp_path}/store", buckets=4)
    told = engine.build()
    status = engine.status().first()
    assert status.files == 8 and told["changed_files"] == 8
    assert engine.search("class penguin swim fly", 1).first().file_path == "a/x.py"
    assert engine.refresh() == {"indexed_chunks": 0, "deleted_files": 0, "changed_files": 0, "failed_files": 0}
    before = engine.store.read("embed_cache").count()
    write(root, "a/x.py", "zebra = 'stripes'\n")
    os.remove(root / "_app.ts")
    told = engine.refresh()
    assert (told["deleted_files"], told["changed_files"]) == (1, 1)
    assert engine.store.read("chunks").where("content like '%Penguin%' or file_path = '_app.ts'").count() == 0
    assert engine.store.read("embed_cache").count() == before + 1
    with pytest.raises(ValueError):
        engine.search("x", 0)


def test_modified_files_can_keep_old_chunks(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, "f.txt", "X\n")
    engine = Engine(spark, str(root), f"file://{tmp_path}/store", buckets=4, only=["docs"], on_modify="keep")
    engine.build()
    write(root, "f.txt", "Z\n")
    engine.refresh()
    assert sorted(r.content for r in engine.store.read("chunks").collect()) == ["X\n", "Z\n"]


def test_watch(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, "a.py", "first = 1\n")
    write(root, "b.py", "second = 2\n")
    engine = Engine(spark, str(root), f"file://{tmp_path}/store", buckets=4)
    told = []
    engine.watch(f"file://{tmp_path}/cp", once=True, done=told.append).awaitTermination(120)
    assert engine.status().first().files == 2
    write(root, "a.py", "third = 33\n")
    os.remove(root / "b.py")
    engine.watch(f"file://{tmp_path}/cp", once=True, done=told.append).awaitTermination(120)
    assert [r.content for r in engine.store.read("chunks").collect()] == ["third = 33\n"] and len(told) == 2


def test_words_after_the_256th_count():
    from cairn.operators.embedding import HashedWords

    words = [f"w{i}" for i in range(300)]
    a, b = HashedWords(64).embed([" ".join(words), " ".join([*words[:299], "other"])])
    assert (a != b).any()


def test_formats(spark):
    n = spark.createDataFrame([(0,), (1536,), (5 * 1024**2,), (3 * 1024**3,)], "n bigint")
    assert [r[0] for r in n.select(text.format_bytes(F.col("n"))).collect()] == ["0 B", "1.5 KB", "5.0 MB", "3.0 GB"]
    assert [r[0] for r in n.select(text.format_bytes(F.col("n"), bench=True)).collect()] == ["0B", "1.5KB", "5.0MB", "3072.0MB"]
    d = spark.createDataFrame([(999,), (1_500,), (2_000_000,), (61_250_000_000,)], "n bigint")
    assert [r[0] for r in d.select(text.format_duration_ns(F.col("n"))).collect()] == ["999ns", "1500ns", "2ms", "61.25s"]
    assert [r[0] for r in d.select(text.format_duration(F.col("n"))).collect()][:2] == ["999ms", "1.50s"]
    assert spark.range(1).select(text.format_score(F.lit(0.12345))).first()[0] == "0.123"


def test_preview(spark):
    made = lambda s, start=1: spark.createDataFrame([(s,)], "s string").select(text.preview(F.col("s"), F.lit(start))).first()[0]
    assert made("a\n\nb\n\n", 9) == " 9 │ a\n10 │ \n11 │ b" and made("") == "1 │ "
    assert made("\n".join("abcdefghij")) == "\n".join(f"{i + 1} │ {c}" for i, c in enumerate("abcdefgh")) + "\n  │ … 2 more"
    assert made("x" * 201) == "1 │ " + "x" * 199 + "…" and made("x" * 200) == "1 │ " + "x" * 200


def test_grammars_and_skips(spark):
    assert column(spark, ["python", "", "cobol"], paths.has_grammar) == [True, False, False]
    assert column(spark, ["a/.git/x", ".cairn/y", "a/git/x"], ignore.skipped) == [True, True, False]
    assert ignore.merged("a\nb", "b\nc") == "a\nb\nc"
    assert column(spark, ["x/node_modules/y.js", "a.pyc", "src/a.py"], lambda c: ignore.ignored(c, ignore.DEFAULT)) == [True, True, False]


GO = """package x

// Adds.
// Twice.
func Add(a int) int {
\treturn a + 1 // }
}

var y = "{"

type T struct {
\tA int
}
"""
TS = "import x from 'y';\n\n/** Doc */\nexport function f() {\n  return `{`;\n}\n\nconst a = 1;\nclass B {\n  m() {}\n}\n"


def test_boundaries():
    assert chunking.boundaries(GO, "go") == [(2, 7), (10, 13)]
    assert chunking.boundaries(TS, "typescript") == [(2, 6), (7, 8), (8, 11)]
    assert chunking.boundaries("#!/bin/sh\n# does\nrun() {\n  echo \"}\"\n}\nrun\n", "bash") == [(0, 5)]
    assert chunking.boundaries("@dec\ndef f():\n    pass\n", "python") == [(0, 3)] and chunking.boundaries("def f(:", "python") is None and chunking.boundaries("x", "cobol") is None
    assert chunking.boundaries("pub fn a() {\n}\nimpl B {\n  fn c() {}\n}\n", "rust") == [(0, 2), (2, 5)] and chunking.boundaries("fn a() {", "rust") == [(0, 1)]
    assert chunking.spans_of(10, [(0, 8), (2, 4)]) == [(0, 8), (2, 4), (4, 10)]


def test_model_provider(spark):
    made = []

    def load():
        made.append(1)
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    provider = embedding.FromModel("lengths", 2, load)
    rows = spark.createDataFrame([("a", "xyz"), ("b", None)], "chunk_hash string, content string")
    got = {r.chunk_hash: (list(r.vector), round(r.norm, 3)) for r in embedding.embed(rows, provider).collect()}
    assert got == {"a": ([3.0, 1.0], 3.162), "b": ([0.0, 1.0], 1.0)} and not made
    with pytest.raises(ValueError):
        embedding.FromModel("wrong", 3, load).embed(["x"])


def test_changes_listed(spark):
    changes = spark.createDataFrame([(f"f{i:02}", t, "h") for i, t in enumerate(["added", "deleted", "modified"] * 4)], "path string, type string, hash string")
    assert merkle.change_lines(changes)[:3] == ["A f00", "D f01", "M f02"] and merkle.change_lines(changes)[-1] == "... 2 more" and len(merkle.change_lines(changes)) == 11
    assert merkle.change_lines(changes.limit(0)) == []


def test_scenarios_and_report(spark, tmp_path):
    one = {"name": "koa", "repo": "r", "query": "q", "expectations": {"pathSubstring": "LIB", "answerMustInclude": ["Dispatch", "next"]}}
    (tmp_path / "koa.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "zod.json").write_text(json.dumps({"name": "zod", "repo": "r", "query": "q"}))
    assert report.scenarios(spark, f"file://{tmp_path}").count() == 2 and report.scenarios(spark, f"file://{tmp_path}", "nope").count() == 0
    scenario = report.scenarios(spark, f"file://{tmp_path}", "koa.json")
    terms = scenario.first().expectations.answerMustInclude
    answers = spark.createDataFrame([("it calls dispatch and NEXT",), ("dispatch",), (None,)], "answer string")
    assert [(list(r.missing), r.verified) for r in report.answer_has(answers, terms).collect()] == [([], True), (["next"], False), (terms, False)]
    phases = spark.createDataFrame([("open", 2_000_000, None, 1), ("db", 500_000, "open", 1), ("index", 9_000_000, None, 1)], "name string, ns bigint, parent string, run int")
    assert [tuple(r) for r in report.total_time(phases).collect()] == [(1, 11_000_000)]
    tree = merkle.stats(merkle.tree(spark.createDataFrame([("a", "h", 5)], "path string, hash string, size int")))
    timings = report.search_summary(phases.select("ns"))
    row = json.loads(report.report(scenario, phases, tree, timings, 3).toJSON().first())
    assert row["totalMs"] == 11 and row["tree"] == {"files": 1, "bytes": 5} and row["search"]["topK"] == 3 and row["scenario"]["name"] == "koa" and len(row["phases"]) == 3


def test_config_and_own_rules(spark, tmp_path):
    root = tmp_path / "tree"
    assert read_config(str(root)) == {"mode": "local"}
    write(root, ".cairn/config.json", json.dumps({"defaultProfiles": ["mine"], "fileProfiles": {"mine": {"extensions": ["zig"]}}}))
    write(root, ".cairnignore", "gen/\n")
    for name in ("a.zig", "gen/b.zig", "c.py", "build/d.zig"):
        write(root, name, "x\n")
    for by_tasks in (False, True):
        engine = Engine(spark, str(root), f"file://{tmp_path}/store", by_tasks=by_tasks)
        assert [r.path for r in engine.listing().collect()] == ["a.zig"]


def test_tree_diff_and_status(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, "a/x.py", "x = 1\n")
    write(root, "b.py", "y = 1\n")
    for prune in (False, True):
        engine = Engine(spark, str(root), f"file://{tmp_path}/store{prune}", prune=prune, buckets=4)
        assert sorted((r.type, r.path) for r in engine.diff().collect()) == [("added", "a/x.py"), ("added", "b.py")]
        engine.build()
        assert engine.diff().count() == 0
        assert engine.status().first() == merkle.stats(engine.tree()).first()
        write(root, "a/x.py", f"x = '{prune}'\n")
        assert [(r.type, r.path) for r in engine.diff().collect()] == [("modified", "a/x.py")]
        assert engine.refresh()["changed_files"] == 1 and engine.diff().count() == 0
    with pytest.raises(ValueError):
        engine.search("  ")
    with pytest.raises(ValueError):
        engine.search_vector([1.0], 3)


def test_quick_refresh_reads_changed_files_only(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"
    for i in range(6):
        write(root, f"f{i}.py", f"v{i} = {i}\n")
    phases = []
    engine = Engine(spark, str(root), f"file://{tmp_path}/store", buckets=4, progress=lambda *x: phases.append(x))
    engine.WAVE = 4
    engine.build()
    assert phases == [("hash", {"listed": 6, "read": 6}), ("chunk", {"chunks": 6, "unknown": 6}), ("embed", {"wave": 1, "waves": 2}), ("embed", {"wave": 2, "waves": 2}), ("store", {"indexed_chunks": 6, "deleted_files": 0, "changed_files": 6, "failed_files": 0})]
    looked = []
    real = engine.read
    monkeypatch.setattr(engine, "read", lambda d: (looked.append(sorted(r.path for r in d.select("path").collect())), real(d))[1])
    write(root, "f3.py", "changed = 33\n")
    assert engine.refresh(full=False) == {"indexed_chunks": 1, "deleted_files": 0, "changed_files": 1, "failed_files": 0}
    assert looked == [["f3.py"], ["f3.py"]]
    os.utime(root / "f4.py", (1, 1))
    assert not any(engine.refresh(full=False).values()) and engine.store.read("files").where("path = 'f4.py'").first().mtime_ms == 1000
    os.remove(root / "f5.py")
    assert engine.refresh(full=False)["deleted_files"] == 1
    assert sorted(r.content for r in engine.store.read("chunks").collect()) == ["changed = 33\n", *[f"v{i} = {i}\n" for i in (0, 1, 2, 4)]]


def test_store_merges_touched_buckets(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=4)
    row = lambda p, h: (p, 1, 1, h)
    frame = lambda r: spark.createDataFrame(r, "path string, size bigint, mtime_ms bigint, hash string")
    store.replace("files", frame([row(f"p{i}", "a") for i in range(20)]))
    before = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "s/files").rglob("*.parquet"))}
    store.merge("files", frame([row("p1", "")]).select("path"), frame([row("p2", "b")]))
    got = {r.path: r.hash for r in store.read("files").collect()}
    assert got == {f"p{i}": "b" if i == 2 else "a" for i in range(20) if i != 1}
    after = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "s/files").rglob("*.parquet"))}
    assert set(before) & set(after)
    store.merge("files", store.read("files").select("path"), frame([]))
    assert store.read("files").count() == 0 and store.exists()


def test_stream_offsets(spark, tmp_path):
    write(tmp_path, "a.py", "x\n")
    reader = source._Stream(source._Options({**source.options(str(tmp_path), pause=0.01)}))
    first = reader.latestOffset()
    assert reader.latestOffset() == first and len(json.dumps(first)) < 200
    write(tmp_path, "b.py", "y\n")
    second = reader.latestOffset()
    assert second["at"] > first["at"] and sorted(f[0] for p in reader.partitions(first, second) for f in p.files) == ["a.py", "b.py"]


class Query:
    isActive = True

    def stop(self):
        self.isActive = False


def test_idle_and_signal_stop(monkeypatch):
    for given, want in {"": 15.0, "x": 15.0, "-1": 15.0, "0": 0.0, "2.5": 2.5, "nan": 15.0, "inf": 15.0}.items():
        assert watching.idle_minutes(given) == want
    idle, busy, never, told = Query(), Query(), Query(), Query()
    threads = [watching.stop_when_idle(idle, lambda: time.time() - 61, 1, 0.01), watching.stop_when_idle(busy, time.time, 1, 0.01), watching.stop_when_idle(never, lambda: 0, 0, 0.01)]
    threads[0].join(5), threads[2].join(5)
    assert (idle.isActive, busy.isActive, never.isActive) == (False, True, True)
    busy.stop()
    before = signal.getsignal(signal.SIGTERM)
    watching.stop_on_signal(told, (signal.SIGTERM,))
    os.kill(os.getpid(), signal.SIGTERM)
    time.sleep(0.05)
    assert not told.isActive and signal.getsignal(signal.SIGTERM) == before


def rows_read(spark):
    """Rows that finished stages have read from files, so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).inputRecords() for i in range(stages.size()))


def nodes_of(frame):
    return {r.path: (r.parent, r.depth, r.type, r.hash) for r in frame.collect()}


def tree_of(spark, files):
    return spark.createDataFrame([(p, h, 1) for p, h in files.items()], "path string, hash string, size int")


@pytest.mark.parametrize("fan", [1_024, 3])
def test_update_is_a_full_build(spark, monkeypatch, fan):
    """Fifty random edits in rounds, over directories of many blocks, with files that become directories and the other way round."""
    monkeypatch.setattr(merkle, "FAN", fan)
    rng = np.random.default_rng(fan)
    pick = lambda k: int(rng.integers(k))
    files = {f"d{pick(3)}/e{pick(3)}/f{pick(30)}": f"h{i}" for i in range(60)} | {f"g{i}": "x" for i in range(20)}
    for edits in (30, 15, 5):
        before = merkle.tree(tree_of(spark, files))
        new = dict(files)
        for i in range(edits):
            kind, path = pick(4), str(rng.choice(sorted(new)))
            if kind == 0:
                new.pop(path)
            elif kind == 1:
                new[path] = f"n{i}"
            elif kind == 2:
                new[f"d{pick(4)}/e{pick(4)}/n{pick(9)}/f{i}"] = f"n{i}"
            else:
                new.pop(path)
                new[f"{path}/under"] = f"n{i}"
        changed = [p for p in files.keys() | new.keys() if files.get(p) != new.get(p)]
        after = merkle.tree(tree_of(spark, new))
        dirs = lambda t: t.where("type = 'directory'")
        got = merkle.update(dirs(before), after.where("type = 'file'"), spark.createDataFrame([(p,) for p in changed], "path string"), merkle.BUCKETS).collect()
        was, want = nodes_of(dirs(before)), nodes_of(dirs(after))
        assert {r.path for r in got} == {p for p in was.keys() | want.keys() if was.get(p) != want.get(p)}
        assert all((want.get(r.path) or (0, 0, 0, None))[3] == r.hash for r in got)
        pruned = {(r.type, r.path, r.hash) for r in merkle.diff_pruned(before, after, merkle.BUCKETS).collect()}
        assert pruned == {(r.type, r.path, r.hash) for r in merkle.diff_pruned(before.drop("bucket"), after.drop("bucket")).collect()}
        kind = lambda p: "added" if p not in files else "deleted" if p not in new else "modified"
        assert pruned <= {(kind(p), p, new.get(p)) for p in changed} and len(pruned) >= len(changed) // 2
        files = new
    assert merkle.update(dirs(before), after.where("type = 'file'"), spark.createDataFrame([], "path string")).count() == 0


def test_one_flat_directory(spark):
    """Its children are hashed by blocks, in several tasks, in path order."""
    names = [f"f{i:05}" for i in range(5_000)]
    h = {n: hashlib.sha256(n.encode()).hexdigest() for n in names}
    level = [h[n] for n in sorted(names)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 1_024]).encode()).hexdigest() for i in range(0, len(level), 1_024)]
    root = merkle.tree(tree_of(spark, h).repartition(7)).where("path = ''").first()
    assert root.hash == level[0]


def test_diff_reads_what_changed(spark):
    files = {f"d{i:03}/f{j}": f"{i}-{j}" for i in range(400) for j in range(20)}
    old, new = (merkle.tree(tree_of(spark, f), 64) for f in (files, files | {"d007/f3": "new", "d009/g": "added"}))
    before = rows_read(spark)
    assert {(r.type, r.path) for r in merkle.diff_pruned(old, new, 64).collect()} == {("modified", "d007/f3"), ("added", "d009/g")}
    few = rows_read(spark) - before
    # both levels of 400 directories, and of the 16,000 files those of two parts of 64
    assert few < 6_000
    before = rows_read(spark)
    merkle.diff(old.where("type = 'file'"), new.where("type = 'file'")).collect()
    assert rows_read(spark) - before >= 16_000


def folders(path):
    return sum(1 for p in path.iterdir() if p.is_dir())


def test_refresh_leaves_nothing_behind(spark, tmp_path):
    from cairn.shared import shared_dir

    shared = type(tmp_path)(shared_dir(spark).removeprefix("file://"))
    root = tmp_path / "tree"
    for i in range(5):
        write(root, f"d{i}/f.py", f"v{i} = {i}\n")
    engine = Engine(spark, str(root), f"file://{tmp_path}/store", buckets=4)
    engine.build()
    seen = []
    for i in range(4):
        write(root, f"d{i}/f.py", f"changed{i} = {i}\n")
        assert engine.refresh(full=False)["changed_files"] == 1
        seen.append((folders(shared), sum(folders(tmp_path / "store" / t) for t in ("chunks", "files", "tree", "postings"))))
    assert len({a for a, _ in seen}) == 1 and seen[-1][1] <= 40
    assert nodes_of(engine._committed()) == nodes_of(engine.tree())


def test_readers_see_one_moment(spark, tmp_path):
    """A reader of the moment before goes on, and a change that fails isn't seen."""
    store = Store(spark, f"file://{tmp_path}/s", buckets=2)
    frame = lambda *r: spark.createDataFrame([(p, 1, 1, h) for p, h in r], "path string, size bigint, mtime_ms bigint, hash string")
    store.replace("files", frame(("a", "1"), ("b", "1")))
    before = store.read("files")
    store.merge("files", frame().select("path"), frame(("a", "2")))
    assert {r.hash for r in before.collect()} == {"1"} and {r.path: r.hash for r in store.read("files").collect()} == {"a": "2", "b": "1"}
    with pytest.raises(RuntimeError), store.change() as change:
        change.merge("files", frame(("b", "3")))
        raise RuntimeError
    assert {r.path: r.hash for r in store.read("files").collect()} == {"a": "2", "b": "1"}


def test_delete_opens_the_files_own_buckets(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=32)
    chunks = lambda *r: spark.createDataFrame([(h, f, 1, 2, "x", "", None, None) for f, h in r], "chunk_hash string, file_path string, start_line int, end_line int, content string, language string, vector array<float>, norm double")
    paths_ = lambda *p: spark.createDataFrame([(x,) for x in p], "file_path string")
    with store.change() as change:
        change.put_chunks(chunks(*[(f"f{i}", f"h{i}-{j}") for i in range(40) for j in range(3)]), paths_())
    before = store._state()["tables"]["chunks"]
    with store.change() as change:
        change.put_chunks(chunks(), paths_("f7"))
    after = store._state()["tables"]["chunks"]
    assert sum(before[b] != after.get(b) for b in before) <= 3 and store.read("chunks").count() == 117
    # h1-0 goes over to another file, whose delete takes it along; the posting of the file before does no harm
    for rows, gone in ((chunks(("z", "h1-0")), paths_()), (chunks(), paths_("f1"))):
        with store.change() as change:
            change.put_chunks(rows, gone)
    left = {(r.file_path, r.chunk_hash) for r in store.read("chunks").where("file_path in ('z', 'f1')").collect()}
    assert left == {("z", "h1-0")}
    with store.change() as change:
        change.put_chunks(chunks(), paths_("z", "z", "not there"))
    assert store.read("chunks").count() == 114


def test_cache_opens_asked_parts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=16)
    rows = lambda *h: spark.createDataFrame([("m", x, [1.0]) for x in h], "model_id string, chunk_hash string, vector array<float>")
    for i in range(9):
        store.append("embed_cache", rows(*[f"h{k}" for k in range(i, i + 30)]))
    of = store._state()["tables"]["embed_cache"]
    assert max(map(len, of.values())) < 8 and store.read("embed_cache").select("chunk_hash").distinct().count() == 38
    # folders that no part needs are gone but for those of the change before
    named = {f for folders in of.values() for f in folders} | set(store._state()["old"])
    assert {f"embed_cache/{p.name}" for p in (tmp_path / "s/embed_cache").iterdir()} == named
    asked = rows("h3", "h4")
    some = store.bucketed("embed_cache", store.touched("embed_cache", asked))
    assert some.select("bucket").distinct().count() <= 2 and some.join(asked, "chunk_hash", "left_semi").select("chunk_hash").distinct().count() == 2


def test_unreadable_and_changed_files_count_as_failed(spark, tmp_path):
    root = tmp_path / "tree"
    write(root, "a.py", "a = 1\n"), write(root, "b.py", "b = 1\n")
    engine = Engine(spark, str(root), f"file://{tmp_path}/store", buckets=4)
    engine.build()
    changes = spark.createDataFrame([("a.py", "modified", hashlib.sha256(b"other").hexdigest()), ("gone.py", "added", "x"), ("b.py", "modified", hashlib.sha256(b"b = 1\n").hexdigest())], "path string, type string, hash string")
    assert engine.apply(changes) == {"indexed_chunks": 1, "deleted_files": 0, "changed_files": 3, "failed_files": 2}


def test_walk_by_tasks(spark, tmp_path, monkeypatch):
    """As the walk on the driver: links to directories once, cycles, links to nothing, unreadable ones."""
    root = tmp_path / "tree"
    for name in ("a/x.py", "a/b/y.py", "a/b/c/z.py", ".hid/q.py", "node_modules/n.py", "m.md", "gen/g.py"):
        write(root, name, "x = 1\n")
    write(tmp_path, "outside/o.py", "x = 1\n")
    os.symlink(root / "a", root / "a/b/again"), os.symlink(tmp_path / "outside", root / "two"), os.symlink(tmp_path / "outside", root / "one"), os.symlink(root / "none", root / "dead")
    os.symlink(root / "a/x.py", root / "link.py")
    real = os.scandir
    (root / "shut").mkdir()
    (root / "shut" / "s.py").write_text("x")
    for most in (500, 1):
        monkeypatch.setattr(source, "TASK_DIRS", most)
        skipped = []
        want = sorted(source.walk(str(root), "gen/", ["py"], [], skipped))
        files, unread = source.listing(spark, str(root), "gen/", (["py"], []))
        assert sorted(map(tuple, files.collect())) == want and [p for p, _, _ in want] == [".hid/q.py", "a/b/c/z.py", "a/b/y.py", "a/x.py", "link.py", "one/o.py", "shut/s.py"]
        assert unread.count() == len(skipped) == 0
    # a directory that vanishes while the walk goes on is left out
    monkeypatch.setattr(os, "scandir", lambda p: (_ for _ in ()).throw(FileNotFoundError()) if str(p).endswith("shut") else real(p))
    skipped = []
    assert "shut/s.py" not in [p for p, _, _ in source.walk(str(root), "", ["py"], [], skipped)] and skipped == ["shut"]
    files, unread = source.listing(spark, str(tmp_path / "nowhere"))
    assert files.count() == 0 and [r.path for r in unread.collect()] == [""]


def test_pivots_leave_parts_unread(spark):
    """The rows are those of the full search; of clustered vectors, few parts are opened and few rows read."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    data = [(f"k{i:04}", [float(x) for x in centres[i % 12] + 0.05 * rng.normal(size=16)]) for i in range(1_200)] + [("zero", [0.0] * 16), ("short", [1.0]), ("null", None)]
    rows = spark.createDataFrame(data, "chunk_hash string, vector array<float>")
    index = pivots.build(rows, 16)
    assert index.counts.sum() == 1_200
    show = lambda d: [(r.chunk_hash, round(r.score, 9)) for r in d.collect()]
    for q in (data[5][1], [float(x) for x in -centres[3]], [1.0] * 16):
        found, opened = index.search(q, 7)
        assert show(found) == show(vectors.top_k(rows, q, 7)) and set(opened) <= set(index.parts.tolist())
    found, opened = index.search(data[5][1], 7)
    before = rows_read(spark)
    found.collect()
    assert len(opened) <= len(index.parts) // 2 and rows_read(spark) - before <= 700
    assert index.search([0.0] * 16)[0].count() == index.search([1.0])[0].count() == index.search([1.0] * 16, 0)[0].count() == pivots.build(rows.limit(0), 16).search([1.0] * 16)[0].count() == 0


def longest_match(known, word):
    """Every beginning of what is left is tried, longest first."""
    out, at = [], 0
    while at < len(word):
        mark = "##" if at else ""
        end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in known), None)
        if end is None:
            return [known["[UNK]"]]
        out.append(known[mark + word[at:end]])
        at = end
    return out


def test_pieces_are_the_longest_that_fit(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    words = sorted({w for t in texts for w in pieces._WORD.findall(t.lower())})
    rng = np.random.default_rng(2)
    some = {w[a:b] for w in words for a in rng.integers(0, len(w), 3) for b in rng.integers(a + 1, len(w) + 1, 2)}
    letters = {c for w in words for c in w} - {"q", "ß"}
    vocabulary = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *sorted(some | letters), *(f"##{p}" for p in sorted(some | letters)), "##"]
    made, known = pieces.Pieces(vocabulary), {p: i for i, p in enumerate(vocabulary)}
    for t in texts:
        whole = [i for w in pieces._WORD.findall(t.lower()) for i in (longest_match(known, w) if len(w) <= 100 else [1])]
        assert made.encode(t) == [2, *whole[:254], 3]
    assert made.encode("") == [2, 3] and made.word("x" * 101) == [1]


def test_batches_by_length(spark):
    vocabulary = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a"]
    seen = []

    def load():
        return lambda ids, real: (seen.append(real.sum(1)), np.stack([real.sum(1), ids.sum(1)], 1))[1]

    provider = pieces.FromPieces("stub", 2, lambda: vocabulary, load)
    texts = ["a " * int(n) for n in np.random.default_rng(3).integers(0, 400, 2_000)]
    got = provider.embed(texts)
    n = np.array([min(len(t) // 2, 254) for t in texts])
    assert (got[:, 0] == n + 2).all() and (got[:, 1] == 4 * n + 5).all()
    assert sum(map(len, seen)) == 2_000 and all(len(x) <= 256 and x.max() <= 1.25 * x.min() + 8 for x in seen)
    rows = spark.createDataFrame([("a", "a a"), ("b", None)], "chunk_hash string, content string")
    assert {r.chunk_hash: list(r.vector) for r in embedding.embed(rows, provider).collect()} == {"a": [4.0, 13.0], "b": [2.0, 5.0]}


def test_embedding_holds_one_piece_at_a_time(spark):
    class Watching:
        """Gives each text its length, and with it how many texts and bytes came along and how many of the arrays given before are still held."""

        model_id, dim = "watching", 4

        def __init__(self):
            self.given = []

        def embed(self, texts):
            held = sum(r() is not None for r in self.given)
            out = np.array([[len(t), len(texts), sum(map(len, texts)), held] for t in texts], np.float32)
            self.given.append(weakref.ref(out))
            return out

    def embedded(texts):
        made = spark.createDataFrame([(f"{i:05}", t) for i, t in enumerate(texts)], "chunk_hash string, content string").coalesce(1)
        found = [(r.vector, r.norm) for r in embedding.embed(made, Watching()).orderBy("chunk_hash").collect()]
        assert [v[0] for v, _ in found] == [len(t or "") for t in texts] and [n for _, n in found] == pytest.approx([np.linalg.norm(v) for v, _ in found], rel=1e-6)
        return np.array([v[1:] for v, _ in found]).max(0)

    n, _, held = embedded(["x" * (i % 50) if i % 7 else None for i in range(6_000)])
    assert n == embedding.BATCH and held <= 3
    _, size, _ = embedded(["x" * (1 << 20)] * 20 + ["", None, "x" * (9 << 20), "y"])
    assert size == 9 << 20  # the one longer text, alone
    assert list(embedding.spans(pa.array([], "string"), 3)) == [] and list(embedding.spans(pa.array(["aa", "aa", None, "aaaaa", "a"]), 3, 4)) == [(0, 3), (3, 4), (4, 5)]
