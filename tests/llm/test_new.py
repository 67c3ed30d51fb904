"""Periodic runs, the prefix trie and toxicity: against plain versions, on odd input, and on planted and held-out rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import prefixtrie, queries, runs, toxicity
from cairn.llm.common import crc_mod

SF = "/root/testdata/sf0.001"
CLASH = "runs collapsed start length period m w a p g score predicted offending depth node name at digest _left _range x`y a.b".split()


# --- periodic runs -----------------------------------------------------------


def brute_runs(w, least=24, times=3):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            m = j - i + q
            if j > i and m >= max(least, times * q) and not any(all(w[k] == w[k + r] for k in range(i, i + m - r)) for r in range(1, q)):
                out.append((i, m, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("dense", [1, runs.DENSE, 10**9])
def test_runs_are_those_of_brute_force(monkeypatch, dense):
    """However early the halves take over from whole sorts."""
    monkeypatch.setattr(runs, "DENSE", dense)
    rng = random.Random(dense)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(0, 4)):
            n, letters = rng.randint(0, 90), rng.randint(1, 4)
            w = [b"%d" % rng.randrange(letters) for _ in range(n)]
            if n > 5 and rng.random() < 0.7:
                a, p = rng.randrange(n), 1 + rng.randrange(n // 2)
                w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
                if rng.random() < 0.5:
                    w[rng.randrange(n)] = b"x"
            docs.append(w)
        least, times = rng.choice([(24, 3), (4, 3), (2, 2), (6, 4)])
        assert runs.runs(docs, least, times) == [brute_runs(w, least, times) for w in docs]


def test_long_repeats():
    assert runs.runs([[b"a"] * 50_000]) == [[(0, 50_000, 1)]]
    assert runs.runs([[b"%d" % (i % 3_000) for i in range(20_000)]]) == [[(0, 20_000, 3_000)]]
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    assert runs.runs([[c.encode() for c in b]], 12) == [brute_runs(b, 12)]


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query(spark):
    got = queries.op11_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000").collect()
    want = {r.doc_id: plain_row(r.doc_id, r.text) for r in docs}
    got = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(docs) > 150 and {k: got[k] for k in want} == want and sum(r[1] > 0 for r in want.values()) > 10


def odd_rows(spark, ids, texts):
    fields = "doc_id bigint, text string, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASH)
    return spark.createDataFrame([(i, t, *[f"{c}{k}" for c in CLASH]) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], fields)


def test_runs_of_odd_rows(spark):
    texts = [None, "", " \n", "é " * 30, "é " * 30, "a b\x1fc d " * 12, " ".join(f"w{i}" for i in range(60_000)), "x " * 60_000]
    d = odd_rows(spark, [1, 2, 3, 4, 4, 5, 6, None], texts)
    got = runs.find(d, ["doc_id", *CLASH]).collect()
    assert sorted((str(r.doc_id), [tuple(x) for x in r.runs], len(r.collapsed)) for r in got) == sorted([
        ("1", [], 0), ("2", [], 0), ("3", [], 0), ("4", [(0, 30, 1)], 1), ("4", [(0, 30, 1)], 1), ("5", [(0, 24, 2)], 7), ("6", [], len(texts[6])), ("None", [(0, 60_000, 1)], 1),
    ])
    assert all(r["a.b"][3:] == r["x`y"][3:] == r["period"][6:] for r in got)
    rows = {tuple(r) for r in runs.digests(runs.with_planted(d)).collect()}
    short = [(i, t) for i, t in zip([1, 2, 3, 4, 4, 5], texts, strict=False)]
    assert {r for r in rows if r[0] not in (6, None)} == {plain_row(i, t) for i, t in short}
    assert runs.digests(runs.with_planted(d.limit(0))).count() == 0


# --- prefix trie -------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for path in nodes:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(members) - 1) * len(path[-1][1].encode()) if path else 0
    ends = lambda path, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(path)).encode()).hexdigest()
    return sorted((min(m), len(p), -1 if not p else min(nodes[p[:-1]]), len(m), kids[p], leaves[p], saved[p], ends(p, m)) for p, m in list(nodes.items()))


def trie_rows(d):
    assert d.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in d.collect())


CONV = "conv_id bigint, turn bigint, role string, text string, node string, depth int, name string, `a.b` string"


def conversation_rows(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, "x", "y") for r in rows], CONV)


def test_trie_of_shared_and_odd_turns(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice("ab")) for c in range(40) for t in range(rng.randint(1, 4))]
    rows += [(50, None, None, None), (50, None, "", ""), (50, 1, "u", "é" * 9), (50, 1, "u", "é" * 9), (51, 1, None, ""), (52, 7, "u", None), (None, 1, "u", "lost")]
    rows += [(c, t, "user", f"turn {t // 3}") for c in (60, 61, 62, 65, 70) for t in range(100 + c)]
    assert trie_rows(prefixtrie.digests(conversation_rows(spark, rows))) == plain_trie(rows)


def test_trie_of_one_long_conversation(spark):
    """Half of all rows are one conversation; equal turns go round in it."""
    rows = [(5, t, "u", f"{t % 7}") for t in range(700)] + [(5 * k, t, "u", f"{t % 7}") for k in range(2, 40) for t in range(18)]
    assert trie_rows(prefixtrie.digests(conversation_rows(spark, rows))) == plain_trie(rows)


def test_trie_of_none(spark):
    assert prefixtrie.digests(conversation_rows(spark, [])).count() == 0


def test_conversation_without_turns(spark):
    """Its turns are all cut off and those it begins with are of a conversation that isn't there."""
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 9 == 8 and c % 5)
    rows = [(c, t, "u", "x") for t in range(3)]
    assert trie_rows(prefixtrie.digests(conversation_rows(spark, rows))) == plain_trie(rows) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_ids_are_hashed_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK", 3)
    got = prefixtrie.id_digests(spark.range(1_000).selectExpr("id % 7 div 5 as g", "id").repartition(5), "g", "id").collect()
    want = {g: hashlib.sha256(",".join(str(i) for i in range(1_000) if i % 7 // 5 == g).encode()).hexdigest() for g in (0, 1)}
    assert {r.g: r.ids_sha256 for r in got} == want


# --- toxicity ----------------------------------------------------------------

FAIR = "the house stood by a river and children came. they read books there! was it cold? nobody knew"
RUDE = "you are a wretched gnurf"


def invented(n=300):
    rng = random.Random(3)
    words = FAIR.replace(".", "").replace("!", "").replace("?", "").split()
    docs = []
    for i in range(n):
        lines = [" ".join(rng.choices(words, k=8)) for _ in range(rng.randint(3, 30))]
        bad = i % 5 == 0
        if bad:
            lines.insert(rng.randrange(len(lines)), f"{rng.choice(words)} {rng.choice(['gnurf', 'blorks'])} {rng.choice(words)}")
        docs.append((i, ". ".join(lines) + ".", int(bad)))
    return docs


def test_labels_of_documents_teach_sentences(spark):
    d = spark.createDataFrame(invented(), "doc_id bigint, text string, toxic int")
    model = toxicity.train(d, d, F.col("doc_id") < 200)
    got = toxicity.score(d, model, ["doc_id", "text", "toxic"]).where("doc_id >= 200").collect()
    assert all(r.predicted == r.toxic for r in got)
    for r in got:
        told = [r.text[o.start : o.end] for o in r.offending]
        assert bool(told) == bool(r.toxic) and all("gnurf" in s or "blorks" in s for s in told)
    # a text isn't toxic for its length
    long = spark.createDataFrame([(1, FAIR * 5_000), (2, FAIR * 5_000 + RUDE)], "doc_id bigint, text string")
    assert {r.doc_id: r.predicted for r in toxicity.score(long, model, ["doc_id"]).collect()} == {1: 0, 2: 1}


def test_noisy_or_by_hand(spark):
    model = toxicity.Model({toxicity.slots_of("gnurf")[0]: 7.0, toxicity.slots_of("blorks")[0]: 5.0}, 0.25)
    r = toxicity.score(spark.createDataFrame([("gnurf a. b. Blorks!",)], "text string"), model, ["text"]).first()
    none = 1 / (1 + np.exp(6.0))
    p = [(1 / (1 + np.exp(-1.0)) - none) / (1 - none), (1 / (1 + np.exp(1.0)) - none) / (1 - none)]
    assert r.score == pytest.approx(1 - 0.75 * (1 - p[0]) * (1 - p[1])) and [(o.start, o.end) for o in r.offending] == [(0, 7)]


def test_toxicity_of_odd_rows(spark):
    d = odd_rows(spark, [1, 2, 3, 4, 4, None], [None, "", "...!\n", RUDE, RUDE, "x " * 200_000])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (3, 1, None), (None, 1, 1), (1, 0, 0)], "doc_id bigint, quality int, toxic int")
    for table, all_zero in ((none, True), (labels, False)):
        got = toxicity.score(d, toxicity.train(d, table, F.lit(True)), ["doc_id", *CLASH]).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got) and (not all_zero or not any(r.score for r in got))
        assert all(r["a.b"][3:] == r["x`y"][3:] for r in got) and len({(r.score) for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(d.limit(0), toxicity.train(d.limit(0), none, F.lit(True)), ["doc_id"]).count() == 0


def test_held_out_toxicity(spark):
    """At sf0.01 all documents with one of the words that the table's toxic documents share."""
    sf = "/root/testdata/sf0.01"
    got = queries.op13_toxicity(spark, sf)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = got.join(labels, "doc_id").where(crc_mod(F.col("doc_id"), 5) == 0).collect()
    right = sum(r.predicted == r.toxic for r in known)
    assert right >= 0.9 * len(known)
    rude = docs.where("text rlike '(?i)\\\\b(idiot|moron|scum|trash)\\\\b'").select("doc_id")
    caught = got.join(rude, "doc_id").agg(F.avg("predicted"), F.count("*")).first()
    assert caught[0] >= 0.9 and caught[1] > 20
