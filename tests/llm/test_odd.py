"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import bpe, html, langid, ledger, linededup, mixing, nearjoin, quality, syncmers, urls

LONG = " ".join(f"w{i}" for i in range(20_000))
SAME = "the same line of eight words is here"
TEXTS = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (None, SAME), (5, f"{SAME}\nzwei"), (6, LONG), (7, LONG)]
#: Names of helper columns and of results, and ones that need quoting.
CLASH = "score predicted lang_pred n_lines n_dropped fail_bits n_tokens copies _k _key _row _doc _text _rep _gone _tokens _p _draw _rest _source a.b x`y h".split()
SF = "/root/testdata/sf0.001"


def odd(spark):
    fields = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASH)
    rows = [(i, t, "en" if k % 2 else None, None, None if t is None else len(t), *[f"{c}{k}" for c in CLASH]) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, fields)


def kept(spark, d, columns):
    """The clashing columns are as they were, row by row."""
    assert [c for c in d.columns if c in columns] == [c for c in odd(spark).columns if c in columns]
    got = [dict(zip(d.columns, r)) for r in d.collect()]
    for r in got:
        assert len({r[c][len(c) :] for c in columns}) == 1
    return got


CLEAN = [c for c in CLASH if c not in ("n_lines", "n_dropped")]


def test_line_dedup(spark):
    got = kept(spark, linededup.dedup(odd(spark)), CLEAN)
    texts = {int(r["h"][1:]): (r["text"], r["n_lines"], r["n_dropped"]) for r in got}
    assert texts == {0: (None, 0, 0), 1: ("", 1, 0), 2: ("  \n\t ", 2, 0), 3: ("one", 1, 0), 4: ("one", 1, 0), 5: (SAME, 1, 0), 6: ("zwei", 2, 1), 7: (LONG, 1, 0), 8: ("", 1, 1)}


def test_near_join(spark):
    got = {(r.doc_id, r.copy_id, r.class_id, r.n_copies, r.n_links) for r in nearjoin.near_join(odd(spark)).collect()}
    assert got == {(1, 1, 1, 2, 1), (2, 1, 1, 2, 1), (3, 3, 3, 1, 0), (4, 4, 4, 2, 1), (None, None, None, 1, 1), (5, 5, None, 1, 1), (6, 6, 6, 2, 1), (7, 6, 6, 2, 1)} or got == {
        (1, 1, 1, 2, 1), (2, 1, 1, 2, 1), (3, 3, 3, 1, 0), (4, 4, 4, 2, 1), (None, None, None, 1, 0), (5, 5, 5, 1, 0), (6, 6, 6, 2, 1), (7, 6, 6, 2, 1)
    }
    # 4 of the 5 five-grams of the longer text are those of the shorter one
    assert (5, 5, None, 1, 1) in got


def test_one_of_each(spark):
    got = kept(spark, nearjoin.one_of_each(odd(spark)), CLASH)
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "3", "4", "6", "None"]


def test_language(spark):
    d = odd(spark)
    got = kept(spark, langid.predict(d, langid.train(d, F.lit(True)), [*CLASH, "doc_id"]), [c for c in CLASH if c not in ("score", "lang_pred")])
    assert {r["h"]: r["lang_pred"] for r in got} == {f"h{k}": "en" if k > 2 else "und" for k in range(9)} and all(0 <= r["score"] <= 1 for r in got)


def test_quality(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = kept(spark, quality.score(odd(spark), quality.train(odd(spark), labels, F.lit(True)), CLASH), [c for c in CLASH if c not in ("score", "predicted")])
    assert [(r["score"], r["predicted"]) for r in got] == [(0.5, 1)] * 9


def test_fingerprints(spark):
    got = syncmers.fingerprints(odd(spark)).collect()
    assert sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t in TEXTS)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.n_chars), set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values()) and by[6, len(LONG)] == by[7, len(LONG)] and by[1, 0] == by[2, 0]
    assert {(r.doc_id, r.near_next) for r in got if r.doc_id in (1, 6)} == {(1, 1.0), (6, 1.0)}


def test_mixing(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = kept(spark, mixing.rates(odd(spark), none, CLASH), [c for c in CLASH if c not in ("n_tokens", "copies")])
    assert {(r["h"], r["n_tokens"], r["rate"], r["copies"]) for r in got} == {(f"h{k}", len((t or "").split()), 1.0, 1) for k, (_, t) in enumerate(TEXTS)}
    assert len(kept(spark, mixing.resample(odd(spark), none), CLASH)) == 9


def test_bpe(spark):
    got = kept(spark, bpe.encode(odd(spark), keep=["doc_id", *CLASH]), [c for c in CLASH if c != "n_tokens"])
    assert {r["h"]: r["n_tokens"] for r in got if r["h"] < "h3"} == {"h0": 0, "h1": 0, "h2": 0} and len({tuple(r["ids"]) for r in got if r["doc_id"] in (6, 7)}) == 1
    assert {(r.doc_id, r.n_tokens) for r in bpe.digests(odd(spark)).collect() if r.doc_id in (1, 2, 4)} == {(1, 0), (2, 0), (4, 1)}


def test_ledger(spark):
    got = kept(spark, ledger.ledger(odd(spark), CLASH), [c for c in CLASH if c not in ("n_lines", "fail_bits")])
    assert {r["h"]: r["n_words"] for r in got} == {f"h{k}": len((t or "").split()) for k, (_, t) in enumerate(TEXTS)}
    assert {r["h"]: r["fail_bits"] & 1 for r in got} == {f"h{k}": int(k < 7) for k in range(9)}


def pages(spark):
    rows = [(1, None, None, "a", "b", "c"), (2, "", "", "a", "b", "c"), (3, "x", "<p>x", "a", "b", "c"), (3, "x", "<p>x", "a", "b", "c"), (4, "http://x.net/" + "y" * 100_000, "<p>" + "a b " * 50_000, "a", "b", "c"), (None, "http://h.org/?q", "<b>t", "a", "b", "c")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, verdict string, `a.b` string")


def test_urls(spark):
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages(spark)).collect()}
    assert got == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "x.net", "/" + "y" * 100_000, "net/", "block"), (None, "h.org", "/", None, "allow")}


def test_html(spark):
    got = sorted((str(r.page_id), r.text, r["a.b"]) for r in html.main_text(pages(spark), ["page_id", "text", "verdict", "a.b"]).collect())
    assert got == [("1", "", "c"), ("2", "", "c"), ("3", "x", "c"), ("3", "x", "c"), ("4", " ".join(["a b"] * 50_000), "c"), ("None", "t", "c")]


@pytest.mark.parametrize("name, left", [("line dedup", 8), ("n-gram Jaccard join", 5), ("mixing sources to target weights", 9)])
def test_stages(spark, name, left):
    stage = dict(corpus_pipeline.STAGES)[name]
    # ids without a label, so that all are alike to what is learned from labels
    d = odd(spark).withColumn("doc_id", F.col("doc_id") + 10**9)
    got = kept(spark, stage(spark, d, SF), CLASH)
    assert len(got) == left and stage(spark, d, SF).columns == d.columns
    for r in got:
        k = int(r["h"][1:])
        assert r["text"] == ("zwei" if name == "line dedup" and k == 6 else TEXTS[k][1]) and r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_quality_stage(spark):
    got = kept(spark, corpus_pipeline.quality_stage(spark, odd(spark), SF), CLASH)
    assert all(r["text"] == TEXTS[int(r["h"][1:])][1] for r in got)


def test_encoding_stage(spark):
    got = corpus_pipeline.encoding_stage(spark, odd(spark), SF)
    assert got.columns == ["doc_id", "lang", "source", "ids", "n_tokens"] and got.count() == 9


def test_empty_tables(spark):
    none, labels = odd(spark).limit(0), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    made = [
        langid.predict(none, langid.train(none, F.lit(True)), ["doc_id"]), linededup.dedup(none), nearjoin.near_join(none), nearjoin.one_of_each(none), quality.score(none, quality.train(none, labels, F.lit(True)), ["doc_id"]),
        syncmers.fingerprints(none), mixing.rates(none, labels, ["doc_id"]), mixing.resample(none, labels), bpe.digests(none), bpe.encode(none), ledger.ledger(none, ["doc_id"]), urls.judge(pages(spark).limit(0)), html.main_text(pages(spark).limit(0), ["page_id"]),
        *[stage(spark, none, SF) for _, stage in corpus_pipeline.STAGES],
    ]
    assert [d.count() for d in made] == [0] * len(made)
