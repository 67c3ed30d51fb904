"""The operators of cairn.llm against brute force, libraries, held-out labels and odd tables."""

import hashlib
import struct
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from cairn.llm import bpe, html, ledger, mixing, nearjoin, queries, syncmers, urls

SF = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def test_language_held_out(spark):
    got = queries.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) and (got.lang == got.lang_pred).mean() > 0.95


def brute(texts):
    sets = {i: frozenset(tuple(w[j : j + min(5, len(w))]) for j in range(len(w) - min(5, len(w)) + 1)) if (w := (t or "").split()) else frozenset() for i, t in texts.items()}
    links, parent = Counter(), {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) if sets[a] and sets[b] else texts[a] == texts[b]:
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (links[i], root(i)) for i in ids}


def test_near_join_is_brute_force(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: (r.n_links, r.class_id) for r in nearjoin.near_join(docs).collect()} == brute(texts)


def test_near_join_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "BLOCK_TEXTS", 8)
    rng = np.random.default_rng(1)
    base = [f"t{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        w = list(base)
        w[rng.integers(120)] = f"x{i}"
        texts[i] = " ".join(w)
    got = nearjoin.near_join(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    assert {r.doc_id: (r.n_links, r.class_id) for r in got.collect()} == brute(texts)


def test_bands_reach_the_recall():
    bands, rows = nearjoin.plan_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= nearjoin.MOST_HASHES


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_quality_classifier(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9


def test_every_stretch_has_an_anchor(spark, docs):
    size = {r.doc_id: len((r.text or "").encode()) for r in docs.collect()}
    starts = {}
    for r in syncmers.anchor_positions(docs).collect():
        starts.setdefault(r.doc_id, []).append(r.start)
    for i, n in size.items():
        if n >= syncmers.K + syncmers.W - 1:
            at = [-1, *sorted(starts[i]), n - syncmers.K + 1]
            assert max(b - a for a, b in zip(at, at[1:])) <= syncmers.W
    text = "a line of forty characters, more or less"
    near = {r.doc_id: r.near_edited for r in syncmers.fingerprints(spark.createDataFrame([(1, text), (2, text[::-1])], "doc_id bigint, text string")).collect()}
    assert min(near.values()) > 0


def test_mixing_meets_targets(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = mixing.rates(d, lab, ["doc_id"]).toPandas()
    sums = [float((got.rate * got.n_tokens * got[f"p_{k}"]).sum()) for k in mixing.DOMAINS]
    want = np.array([mixing.TARGETS[k] for k in mixing.DOMAINS])
    assert (got.rate >= 0).all() and np.allclose(np.array(sums) / sums[0], want / want[0], rtol=0.02)


def test_mixing_counts_all_marks_and_tokens(spark):
    texts = ["", "   ", "a\tb", " a  b\n\nc\r\n", "WHOLLY LOUD", "<p> <b>", "x | y! $", "É 漢字 b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").selectExpr("i", f"{mixing.tokens_sql('t')} n", f"{mixing.marks_sql('t')} m")
    got = {r.i: r for r in rows.collect()}
    assert [got[i].n for i in range(len(texts))] == [len(t.split()) for t in texts]
    for i, t in enumerate(texts):
        per = lambda chars: min(4, int(4 * sum(c in chars for c in t) / max(1, len(t.split())) + 0.5))  # noqa: E731, B023
        assert got[i].m == [f"_symbols{per('#*$%&<>')}", f"_bars{per('|')}", f"_calls{per('!')}", f"_capitals{per('ABCDEFGHIJKLMNOPQRSTUVWXYZ')}"]


def test_copies_of_one_text_are_drawn_apart(spark, monkeypatch):
    monkeypatch.setattr(mixing, "fit", lambda members, targets, hold: ([], 0.5, [1.0, 0.0, 0.0]))
    rows = spark.createDataFrame([(i, "the same text") for i in range(400)], "doc_id bigint, text string")
    got = mixing.rates(rows, labels(spark), ["doc_id"]).toPandas()
    assert 140 < got.copies.sum() < 260 and (got.reached_toxic == 0).all() and (got.target_toxic == mixing.TARGETS["toxic"]).all()


def test_url_contract(spark):
    urls_ = ["https://a.b.Example.NET/en/x?q#f", "http://example.net/EN/", "http://x.net", "http://x.net/", "http://notnet/", "x.net/", None, "http://c.org/fr/1", "http://example.com/de/", "http://my-casino.com/", "http://o.org/a.net/"]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id bigint, url string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert [got[i].rule for i in range(11)] == ["example.net/en/", "net/", None, "net/", None, None, None, "org/fr/", "example.com/de/", None, None]
    assert [got[i].verdict for i in range(11)] == ["allow", "block", "allow", "block", "allow", "allow", "allow", "allow", "block", "block", "allow"]
    assert (got[0].host, got[0].path, got[5].host) == ("a.b.example.net", "/en/x", "")
    assert urls.judge(pages.limit(0)).count() == 0


def test_bpe_is_the_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    t.no_truncation(), t.no_padding()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    more = ["", " ", "Ünïcödé ÀÉ", "a" * 3000, "x<|endoftext|>y", "ﬁ①²", "漢字かな 👩‍👩‍👧", "it's don't WE'LL 12345", "İ ΑΣ ǅ"]
    texts |= {-1 - i: m for i, m in enumerate(more)}
    for r in bpe.digests(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), texts[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), texts[r.doc_id]


def test_ledger(spark):
    text = "a b c a b c\n\nx # y\nx # y\n"
    row = ledger.ledger(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string"), ["doc_id"]).orderBy("doc_id").collect()
    assert (row[0].n_words, row[0].word_chars, row[0].n_symbols, row[0].n_dup_lines, row[0].n_repeat_words) == (12, 12, 2, 1, 12)
    assert row[1].n_words == 0 and row[1].fail_bits & ledger.BITS["few_words"]


def test_ablations_agree_with_the_ledger(spark, docs):
    rows = ledger.ledger(docs, ["doc_id"])
    bits = [r.fail_bits for r in rows.collect()]
    mask = ledger.mask_of("v2")
    for r in ledger.ablations(rows, "v2").collect():
        b = ledger.BITS[r.rule]
        assert (r.failed, r.failed_alone) == (sum(x & b > 0 for x in bits), sum(x & mask == b for x in bits))


def test_html_of_the_pages(spark):
    import re
    from html import unescape

    for r in html.main_text(spark.read.parquet(f"{SF}/pages.parquet"), ["page_id", "html"]).collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_html_odd_and_held_out(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "<"), (4, "<div><p>a<p"), (5, "<script>x"), (6, "<b>" * 500)], "page_id bigint, html string")
    assert [r.text for r in html.main_text(odd, ["page_id"]).orderBy("page_id").collect()] == ["", "", "<", "a", "", ""]
    made, model = html.Invented(1234), html.trees()
    pages = [made.page() for _ in range(100)]
    right = 0
    for p, got in zip(pages, html.extract(pages, model), strict=True):
        page = html.parse(p)
        right += got == "\n\n".join(t for t in page.texts if "\x01" in t)
    assert right >= 85


def test_pipeline(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = [d.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns
        d = spark.createDataFrame(out.toPandas(), out.schema)
        sizes.append(d.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] >= sizes[4] > 0.6 * sizes[1]


def test_near_join_of_a_chain(spark, monkeypatch):
    """Texts that each share bands with the next only: their component is loose, so pairs are compared band by band."""
    monkeypatch.setattr(nearjoin, "BLOCK_TEXTS", 8)
    rng = np.random.default_rng(2)
    words = [f"c{i}" for i in range(900)]
    texts = {i: " ".join(words[8 * i : 8 * i + 100]) for i in range(90)}
    for i in range(90, 120):
        w = words[8 * (i - 90) : 8 * (i - 90) + 100]
        w[rng.integers(100)] = f"x{i}"
        texts[i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    bands, rows = nearjoin.plan_bands()
    reps = nearjoin.signatures(docs, bands, rows).selectExpr("_key", "_id _rep", "1L _size", "_grams", "_bands")
    assert nearjoin.candidates(reps).where("_at is not null").count() > 0
    assert {r.doc_id: (r.n_links, r.class_id) for r in nearjoin.near_join(docs).collect()} == brute(texts)
