"""The operators and the pipeline against plain versions, written here from their rules."""

import hashlib
import math
import random
import re
import struct
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import bpe, gbt, html, langid, ledger, linededup, mixing, quality, queries, syncmers, urls

SF = "/root/testdata/sf0.001"


def rows_of(d):
    """Whole numbers as such, also where nulls have made a column one of floats."""
    d = d[sorted(d.columns)].astype(object)
    return sorted(repr([int(x) if isinstance(x, float) and x.is_integer() else x for x in r]) for r in d.where(d.notna(), None).values.tolist())


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


# --- line dedup --------------------------------------------------------------


def brute_lines(texts):
    """(doc_id, text) pairs in order to what is left of each text."""
    told = []
    for i, text in texts:
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            t = line.split()
            if t:
                m = ["<*>" if re.search("[0-9@]", x) else x for x in t]
                t = t if m.count("<*>") > 0.25 * len(m) else m
                told.append((i, at, tuple(t)))
    counts = Counter()
    for t in {t for _, _, t in told}:
        for at, x in enumerate(t):
            counts[len(t), t[:2], at, x] += 1

    def template(t):
        lines = [counts[len(t), t[:2], at, x] if x != "<*>" else 0 for at, x in enumerate(t)]
        least = sorted(lines, reverse=True)[math.ceil(0.75 * len(t)) - 1]
        return (t[:2], tuple(x if 2 * c > least else None for x, c in zip(t, lines))) if len(t) > 2 and least > 1 else t

    docs = defaultdict(list)
    for i, _, t in told:
        docs[template(t)].append(i)
    gone = {(i, at) for i, at, t in told if i != docs[template(t)][0]}
    return {i: None if text is None else "\n".join(x for at, x in enumerate(text.split("\n")) if (i, at) not in gone) for i, text in texts}


def test_line_dedup_is_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == brute_lines(rows)


@pytest.mark.parametrize("lines, left", [
    (["posted by anna on the village board", "posted by boris on the village board", "posted by carol on the village board"], [True, False, False]),
    ([" ".join(f"h{'abcdefghijklmnopqrstuv'[i]}x" for i in range(22)) + " " + " ".join(f"{c}{'abcdefghijklmnopqr'[i]}y" for i in range(18)) for c in ("left", "right")], [True, True]),
    (["Home About Contact", "Home About Contact"], [True, False]),
    (["only here", "only there"], [True, True]),
    (["item 17 costs 3 euros", "item 18 costs 4 euros"], [True, True]),
    (["alpha beta gamma delta 17 items", "alpha beta gamma delta 99 items"], [True, False]),
    (["", "", "  "], [True, True, True]),
])
def test_line_dedup_cases(spark, lines, left):
    docs = spark.createDataFrame([(i, f"{x}\nown words {chr(97 + i) * 3}") for i, x in enumerate(lines)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in linededup.dedup(docs).collect()}
    assert [got[i].text.split("\n")[0] == x and got[i].n_dropped == 0 for i, x in enumerate(lines)] == left
    assert [got[i].n_lines for i in got] == [2] * len(lines)


def test_line_dedup_fields_at_any_size(spark):
    """Fields whose values come again, in leaves of eight and of 3,600 lines, and one value that most lines have."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ!?:;,.()"[:60]
    for names, boards in (("anna boris carol dora".split(), "village town".split()), ([f"name{c}" for c in letters], [f"board{c}" for c in letters])):
        lines = [f"posted by {n} on the {b} board today at noon" for n in names for b in boards]
        got = linededup.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string"))
        assert got.where("n_dropped = 1 and text = ''").count() == len(lines) - 1 and got.where("doc_id = 0 and n_dropped = 0").count() == 1
    lines = [f"posted by {'anna' if i % 3 else f'x{chr(97 + i)}'} on the {chr(97 + i)} board today at noon" for i in range(12)]
    got = {r.doc_id: r.n_dropped for r in linededup.dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).collect()}
    assert got == {i: int(i > 1) for i in range(12)}  # one line of anna's template and one of the others' stay
    own = [" ".join(f"{w}{chr(97 + i)}" if j > 3 else w for j, w in enumerate("the news of today says much that is new".split())) for i in range(9)]
    assert linededup.dedup(spark.createDataFrame(list(enumerate(own)), "doc_id bigint, text string")).where("n_dropped > 0").count() == 0


# --- language ----------------------------------------------------------------


def brute_vector(text):
    s = "".join(c if c.isalpha() else "\0" for c in text.lower())
    s = re.sub("\0+", "\0", f"\0{s}\0")
    v = np.zeros(langid.DIM)
    for a, b, c in zip(s, s[1:], s[2:]):
        of = lambda x: langid.letter_vector(0 if x == "\0" else ord(x))
        v += np.roll(of(a), 2) * np.roll(of(b), 1) * of(c)
    return v / max(np.linalg.norm(v), 1e-9)


def test_language_is_explicit_hypervectors(spark):
    texts = [(1, "the cat and the hat", "en"), (2, "le chat et la tête", "fr"), (3, "γάτα και σκύλος", "el"), (4, "кошка и собака", "ru"), (5, "猫和狗在家里", "zh"), (6, "the dog", None), (7, "12 !", "en"), (8, None, "en")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    learned = langid.train(docs, F.lit(True))
    assert sorted(learned) == ["el", "en", "fr", "ru", "zh"]
    for i, t, lang in texts[:5]:
        assert np.allclose(learned[lang] / np.linalg.norm(learned[lang]), brute_vector(t), atol=1e-4)
    got = {r.doc_id: r for r in langid.predict(docs, learned, ["doc_id"]).collect()}
    for i, t, _ in texts:
        v = brute_vector(t or "")
        scores = {k: float(v @ (p / np.linalg.norm(p))) for k, p in sorted(learned.items())}
        best = max(scores, key=scores.get)
        assert (got[i].lang_pred, round(got[i].score, 3)) == ((best, round(max(0.0, scores[best]), 3)) if any(c.isalpha() for c in t or "") else ("und", 0.0))
    assert [got[i].lang_pred for i in (3, 4, 5, 6)] == ["el", "ru", "zh", "en"]


# --- trees -------------------------------------------------------------------


def walked(trees, x):
    """Node by node."""
    total = trees.base
    for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
        total += leaf[node - len(feature)]
    return total


def test_trees_are_walked_right():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    trees = gbt.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=20)
    assert np.allclose(trees.raw(x), [walked(trees, r) for r in x]) and np.mean((trees.raw(x) > 0) == (x[:, 0] * x[:, 1] > 0)) > 0.9
    assert len(gbt.fit(x, np.ones(400)).feature) == 0 and len(gbt.fit(x[:0], np.zeros(0)).score(x[:0])) == 0


def test_quality_labels_null_double_and_hot(spark):
    docs = spark.createDataFrame([(i, f"{'good prose here' if i % 2 else 'bad!!! ###'} {i}") for i in range(40)] + [(100, "hot")] * 90, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (2, None), (None, 1)] + [(100, 1)] * 50, "doc_id bigint, quality int")
    trees = quality.train(docs, labels, F.lit(True))
    plain = quality.train(docs.distinct(), labels.distinct(), F.lit(True))
    assert np.array_equal(trees.leaf, plain.leaf)
    for r in quality.score(docs.distinct(), trees, ["doc_id", "text"]).collect():
        assert math.isclose(r.score, 1 / (1 + math.exp(-walked(trees, quality.statistics(r.text)))), rel_tol=1e-9)
        assert r.predicted == (r.score >= 0.3)


# --- fingerprints ------------------------------------------------------------


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute_anchors(text):
    b = text.encode()
    h = [signed(xxhash.xxh64_intdigest(b[i : i + syncmers.S], 42)) for i in range(len(b) - syncmers.S + 1)]
    found = []
    for i in range(len(b) - syncmers.K + 1):
        inner = h[i : i + syncmers.W]
        if min(inner) in (inner[0], inner[-1]):
            found.append(xxhash.xxh64_intdigest(b[i : i + syncmers.K], 42) & 0xFFFFFFFF)
    return found or [xxhash.xxh64_intdigest(b, 42) & 0xFFFFFFFF]


def likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("ranges", [500, 7])
def test_fingerprints_are_brute_force(spark, monkeypatch, ranges):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", ranges)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in syncmers.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        a, e, b = brute_anchors(t), brute_anchors(edited), brute_anchors(after)
        assert got[i].fingerprint == "".join(f"{x:08x}" for x in a) and got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].edited_fingerprint == "".join(f"{x:08x}" for x in e)
        assert math.isclose(got[i].near_edited, likeness(a, e)) and math.isclose(got[i].near_next, likeness(a, b))


def test_fingerprints_of_hot_and_null_ids(spark, monkeypatch):
    """Every document has one successor: near_next counts as that of a ring over all rows."""
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 5)
    rows = [(None, f"null id number {i} with some words") for i in range(40)] + [(7, f"hot id number {i} with some words") for i in range(40)] + [(-(2**63), "least"), (2**63 - 1, "greatest"), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    led = syncmers.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))).collect()
    assert Counter(r._text for r in led) == Counter(t or "" for _, t in rows)
    assert Counter(r._next._text for r in led) == Counter(t or "" for _, t in rows)
    after = {r._text: r._next._text for r in led if r._text}
    assert after["least"].startswith("hot") or after["least"] == "" and after["greatest"].startswith("null")


# --- mixing ------------------------------------------------------------------


def members(spark, p, t):
    return spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(t, p)], "_tokens bigint, _p array<double>")


@pytest.mark.parametrize("targets", [(0.6, 0.2, 0.2), (0.2, 0.7, 0.1), (0.97, 0.01, 0.02), (0.999, 0.0, 0.001), (0.0, 0.5, 0.5), (0.0, 1.0, 0.0)])
def test_mixing_is_nonnegative_least_squares(spark, targets):
    rng = np.random.default_rng(3)
    p = rng.dirichlet((0.3, 0.15, 0.2), 120)
    t = rng.integers(5, 200, 120)
    wanted = dict(zip(mixing.DOMAINS, targets))
    for hold in (False, True) if not targets[0] else (False,):  # nothing is held where nothing is asked of the first domain
        steps, scale, held, reached = mixing.fit(members(spark, p, t), wanted, hold)
        assert not held
    got = [r[0] for r in members(spark, p, t).select(mixing.rate_of(steps, scale)).collect()]
    assert min(got) >= 0
    # projected gradient on all rates, by hand and for long
    a, want = p.T * t, None
    base = 0 if targets[0] else int(np.argmax(a.sum(1) * (np.array(targets) > 0)))
    want = a[base].sum() / targets[base] * np.array(targets)
    r, size = np.ones(120), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(60_000):
        r = np.maximum(0, r - size * a.T @ (a @ r - want))
    best = a @ r
    mine = a @ np.array(got)
    mine = mine * want[base] / mine[base] if best[base] > 0.999 * want[base] else mine
    assert np.linalg.norm(mine - want) <= np.linalg.norm(best - want) + 0.003 * np.linalg.norm(want)
    assert np.allclose(reached, (a @ np.array(got)) / (a @ np.array(got)).sum(), atol=1e-6)


def test_mixing_meets_feasible_targets_and_holds_the_first_domain(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    wanted = {"clean": 0.6, "toxic": 0.2, "junk": 0.2}
    for hold in (False, True):
        got = mixing.rates(d, lab, ["doc_id"], wanted, hold).toPandas()
        sums = np.array([(got.rate * got.n_tokens * got[f"p_{k}"]).sum() for k in wanted])
        assert np.allclose(sums / sums.sum(), list(wanted.values()), rtol=0.01)
        if hold:
            assert (got.rate[(got.p_clean >= got.p_toxic) & (got.p_clean >= got.p_junk)] == 1).all()


def test_mixing_without_a_domain(spark):
    """After a filter no junk is left: the others' shares are met all the same, and clean texts stay once."""
    rows = [(i, f"good prose number {i} of the village") for i in range(300)] + [(i, f"you worthless idiot {i} of the village") for i in range(300, 330)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, 1, int(i >= 300)) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    got = mixing.rates(docs, lab, ["doc_id"], hold=True).toPandas()
    assert (got.rate[got.doc_id < 300] == 1).all() and (got.p_junk == 0).all()
    toxic, clean = ((got.rate * got.n_tokens * got[f"p_{k}"]).sum() for k in ("toxic", "clean"))
    assert np.isclose(toxic / clean, mixing.TARGETS["toxic"] / mixing.TARGETS["clean"], rtol=0.02)
    assert mixing.resample(docs, lab).where("doc_id < 300").count() == 300


# --- urls --------------------------------------------------------------------


def test_urls_are_naive_globs(spark):
    rng = random.Random(4)
    pool = ["ads.", "x", "casino", ".net", ".com", "é", "/", "/wp-login.php", "-bets.", "%63asino", ":80", "user@", "..", "/a/../", "?q", ".jpg", "#f", "example", "org/fr/", "EN", "."]
    made = [("http://" if rng.random() < 0.9 else "") + "".join(rng.choices(pool, k=rng.randint(0, 6))) for _ in range(3000)] + ["", "://", "http://" + "a" * 5000 + "/casino", None, None]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id bigint, url string")
    for r in urls.judge(pages).collect():
        host, path = urls.split_url(made[r.page_id])
        assert (r.host, r.path) == (host, path)
        fits = [(len(x), x, v) for v, x in urls.HOST_RULES if ("." + host).endswith("." + x.partition("/")[0]) and path.startswith("/" + x.partition("/")[2])]
        h, p = urls.canonical(host, path)
        hit = []
        for g in urls.BLOCK_GLOBS:
            on, slash, below = g.partition("/")
            rx = lambda s: "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in s)
            one = re.fullmatch(("" if on.startswith("*") else r"\.") + rx(on), "." + h, re.S) and (not slash or re.fullmatch(rx(slash + below), p, re.S))
            # a star may run from the host into the path
            both = re.fullmatch(("" if on.startswith("*") else r"\.") + rx(on) + "\1" + (rx(slash + below) if slash else ".*"), "." + h + "\1" + p, re.S)
            assert not one or both
            hit += [g] * bool(both and host)
        assert list(r.globs) == hit and r.rule == (max(fits)[1] if fits else None), made[r.page_id]
        assert r.verdict == (max(fits)[2] if fits else "block" if hit else "allow")


def test_canonical_urls_and_rule_tables(spark):
    assert urls.canonical("u:p@x.com.:8080", "/a/./b/../%41") == ("x.com", "/a/a") and urls.canonical("x", "") == ("x", "")
    table = spark.createDataFrame([("host", "allow", "a.org/x"), ("glob", "block", "?.org/*é?z")] * 2, "kind string, verdict string, rule string")
    hosts, globs = urls.rules_of(table)
    assert hosts == (("allow", "a.org/x"),) and globs == ("?.org/*é?z",)
    pages = spark.createDataFrame([(1, "http://b.org/1é漢z"), (2, "http://bb.org/1é漢z"), (3, "http://b.org/%C3%A9%E6%BC%A2Z"), (4, "http://a.org/xéaz")], "page_id bigint, url string")
    assert [r.verdict for r in urls.judge(pages, host_rules=hosts, globs=globs).orderBy("page_id").collect()] == ["block", "allow", "block", "allow"]
    assert urls.judge(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urls.rules_of(table.limit(1).withColumn("rule", F.repeat(F.lit("x"), urls.MOST_BITS)))


# --- rules -------------------------------------------------------------------


def test_ledger_is_brute_force(spark):
    rng = random.Random(5)
    pool = ["a", "B", "##", "|x", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "É", "ü", "ABC", "漢字", "<>", "\r\n", "ǅ"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(2000)] + ["word " * 60, "ÀB\x85CD EF\x1cgh", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in ledger.ledger(docs, ["doc_id"]).collect():
        text = texts[r.doc_id] or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in (i, i + 1, i + 2)}
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines), sum(x.isupper() for x in w))
        assert tuple(r[m] for m in ledger.MEASURES) == want
        bits = sum(b for name, b in ledger.BITS.items() if eval(ledger.RULES[name].replace("OR", "or"), {m: v for m, v in zip(ledger.MEASURES, want)}))
        assert r.fail_bits == bits


# --- html --------------------------------------------------------------------


@pytest.mark.parametrize("page, text", [
    ("plain text with no tags", "plain text with no tags"),
    ("<div><h1>T</h1><p>Text one two three.</p></div>", "T\n\nText one two three."),
    ("<body>direct text of this page, and more<p>and a para</p>", "direct text of this page, and more\n\nand a para"),
    ("<p class=x'>hello", "hello"),
    ("<script src=a.js />var a=1;</script><p>some words of text here.</p>", "some words of text here."),
    ("<p>a <math><mi>x</mi></math> b", "a x b"),
    ("<svg><p>words after an open drawing</p>", "words after an open drawing"),
    ("<svg><text>no</text></svg><p>words after a drawing</p>", "words after a drawing"),
    ("<p>a &lt;b&gt; &amp; c &copy; d\n\n e</p><!-- x --><p></p>", "a <b> & c © d e"),
    ("<!--><p>shown as the comment is empty</p>", "shown as the comment is empty"),
])
def test_html_cases(page, text):
    assert html.extract([page], html.trees()) == [text]


@pytest.mark.parametrize("page", ["<a" * 500_000, "<b></i>" * 140_000, '"' * 1_000_000, "<a b=\"'" * 140_000, "<svg>" * 200_000 + "</svg>", "<i><div>" + "<b></i>" * 140_000, "<td><p>" * 60_000, "<!--" * 250_000])
def test_html_is_linear(page):
    import time

    began = time.process_time()
    html.extract([page], html.trees())
    assert time.process_time() - began < 6


def test_html_model_is_what_training_gives():
    got, stored = html.learn(), html.trees()
    assert got.odds == stored.odds and np.array_equal(got.trees.feature, stored.trees.feature) and np.allclose(got.trees.leaf, stored.trees.leaf)


# --- the pipeline, stage by stage --------------------------------------------


def test_pipeline_is_brute_force(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def done(d, name):
        return spark.createDataFrame(stages[name](spark, d, SF).toPandas(), d.schema)

    trees = quality.train(docs, labels, F.lit(True))
    good = done(docs, "quality classifier")
    want = {r.doc_id: tuple(r) for r in docs.collect() if 1 / (1 + math.exp(-walked(trees, quality.statistics(r.text)))) >= 0.3}
    assert {r.doc_id: tuple(r) for r in good.collect()} == want and 0 < len(want) < docs.count()

    cut = done(good, "line dedup")
    left = brute_lines(sorted((i, r[1]) for i, r in want.items()))
    before = {i: r[1] for i, r in want.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in cut.collect()} == {i: (t, len(t)) for i, t in left.items() if t.split() or t == before[i]}

    one = done(cut, "n-gram Jaccard join")
    from test_llm import brute

    classes = {i: c for i, (_, c) in brute({r.doc_id: r.text for r in cut.collect()}).items()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(classes.values()))

    mixed = done(one, "mixing sources to target weights")
    told = mixing.rates(one, labels, ["doc_id"], hold=True).toPandas()
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({int(r.doc_id): int(r.copies) for r in told.itertuples() if r.copies})
    clean = told[(told.p_clean >= told.p_toxic) & (told.p_clean >= told.p_junk)]
    assert (clean.copies == 1).all() and len(clean) > 0.8 * len(told)

    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    t.no_truncation(), t.no_padding()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in stages["BPE encoding"](spark, mixed, SF).collect():
        assert list(r.ids) == t.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_encoded_ids_of_many_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "<|endoftext|> x")], "doc_id bigint, text string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs).collect()}
    assert got[2] == got[3] == [] and got[4][0] == 49407
    for r in bpe.digests(docs).collect():
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(got[r.doc_id])}I", *got[r.doc_id])).hexdigest()
    assert {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs)).collect()}[1] == "a</w> b</w>"
