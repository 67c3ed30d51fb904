"""Mixing to target weights by soft domain membership, in DataFrame and SQL functions alone.

A classifier learned from the labelled table gives every document a posterior
over domains: naive Bayes over the presence of words and of shape marks (how
many symbols, bars and capitals a text has). Then each document gets a rate, the
number of times it should occur, such that the expected domain token totals

    S_k = sum over documents of rate * tokens * posterior_k

match targets. Projected gradient descent solves this nonnegative least squares:
start at rate 1, step against the gradient, set negative rates to 0. In the
metric that weighs a rate by the document's tokens, the step of a document
depends on its posterior alone. The gradient is scaled by the inverse of the free
documents' Gram matrix, so these are Newton-like steps; where one would go too far,
halves of it, or the plain gradient, are taken. What a step needs from the corpus are K sums and a K x K matrix, which
Spark adds up; rates follow from the steps' K numbers, so nothing that grows with
the corpus reaches the driver, and no step lengthens the lineage.

Only the shares of the totals are given, so their scale is free: the first domain
keeps the expected tokens it had. A scarce domain gets rates above 1, without
limit: any shares are met that the posteriors can make up. ``hold`` keeps at
rate 1 the documents whose likeliest domain is the first, and fits the others.

Null texts count as empty: no token, the prior as posterior, rate as any other.
Without labels every document is of the first domain and has rate 1; a domain
that no labelled text has takes no part. Repeated rows count each. Texts of any
length are read whole. Columns of any name stay as they are; of those that
``rates`` keeps, one that has the name of a new one gives way to it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import let, packed, quoted, staged, unit, unpacked

#: The domains of the labelled table: name and condition; the first that holds counts.
DOMAINS = {"clean": "quality = 1 and toxic = 0", "toxic": "toxic = 1", "junk": "quality = 0"}
#: Share of the expected tokens that each domain should have.
TARGETS = {"clean": 0.97, "toxic": 0.01, "junk": 0.02}
#: Labelled documents that training reads, about: a bound on the sample, not on what is scored.
TRAIN_ROWS = 20_000
#: Words and marks that the classifier knows: the bound of what it broadcasts.
LEXICON = 256
STEPS, CLOSE = 25, 1e-3
#: Rows' worth of belief that a word is as common in a domain as anywhere.
PULL = 2.0
#: The score of a domain that no labelled text has: no word makes up for it, and its posterior is 0.
ABSENT = -1e6
#: Standard deviations from chance that a word must be to count.
ODD = 6.0


def _count(text: str, chars: str) -> str:
    """How often characters of the class occur: what is left when runs of all others go."""
    return f"octet_length(regexp_replace({text}, '[^{chars}]++', ''))"


def marks_sql(text: str) -> str:
    """array<string>: marks of the text's shape, each with a level from 0 to 4: symbols, bars, calls and capitals for each word."""
    n = f"greatest(1, {tokens_sql(text)})"
    counts = {"symbols": "#*$%&<>", "bars": "|", "calls": "!", "capitals": "A-Z"}
    return let("n", n, "array(" + ", ".join(f"concat('_{name}', cast(least(4, round(4.0D * {_count(text, chars)} / n)) as int))" for name, chars in counts.items()) + ")")


def tokens_sql(text: str) -> str:
    """A text's tokens, as whitespace of any kind and length parts them; none in an empty or blank text."""
    return rf"cast(size(array_remove(split({text}, '\\s+'), '')) as bigint)"


def words_sql(text: str) -> str:
    """array<string>: the words of a text, letters only, in lower case."""
    return rf"split(lower({text}), '[^\\p{{L}}]+')"


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], list[list[float]], list[float]]:
    """Lexicon, log-odds of each entry in each domain, and the score of a text with none of them.

    An id is in the sample once for each of its domains at most, so it is small
    enough to broadcast. If many documents have one id, they are thinned out to
    ``rows`` again. A row that falls in no domain, or has a null label, doesn't train.
    """
    domain = F.expr("case " + " ".join(f"when {c} then {i}" for i, c in enumerate(DOMAINS.values())) + " end")
    able = labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null").distinct()
    n = able.count()
    if n > rows:
        able = able.where(unit(F.col("doc_id"), 6) < rows / n)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")).join(F.broadcast(able), "doc_id")
    n = sample.count()
    if n > 2 * rows:
        sample = sample.where(unit(F.struct("doc_id", "_t"), 7) < rows / n)
    sample = sample.dropDuplicates(["domain", "_t"])
    sample = staged(sample.select("domain", F.expr(f"array_union({marks_sql('_t')}, {words_sql('_t')})").alias("f")))
    sizes = {r.domain: r.n for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    ks = range(len(DOMAINS))
    if not total:
        return [], [], [0.0] + [ABSENT] * (len(DOMAINS) - 1)
    have = [F.count_if(F.col("domain") == k).alias(f"n{k}") for k in ks]
    words = sample.select("domain", F.explode("f").alias("w")).where("w != ''").groupBy("w").agg(F.count("*").alias("n"), *have)
    # how many standard deviations the word's count in a domain is from what chance would give it
    share = {k: sizes.get(k, 0) / total for k in ks}
    odd = [F.abs(F.col(f"n{k}") - F.col("n") * share[k]) / F.sqrt(F.col("n") * (share[k] * (1 - share[k]) + 1e-9) * (1.0 + 1e-9 - F.col("n") / total) + 0.25) for k in ks]
    top = words.withColumn("odd", F.greatest(*odd)).where(F.col("odd") >= ODD).orderBy(F.desc("odd"), "w").limit(LEXICON).collect()
    # smoothed towards how often the word is anywhere, so that a domain of few rows says little
    q = [[min(1 - 1e-4, max(1e-6, (r[f"n{k}"] + PULL * r.n / total) / (sizes.get(k, 0) + PULL))) for k in ks] for r in top]
    prior = [math.log(sizes[k] / total) + sum(math.log(1 - x[k]) for x in q) if sizes.get(k) else ABSENT for k in ks]
    return [r.w for r in top], [[math.log(y / (1 - y)) for y in x] for x in q], prior


def with_posteriors(docs: DataFrame, model: tuple[list[str], list[list[float]], list[float]], keep: list[Column]) -> DataFrame:
    """``keep`` columns with ``_tokens``, ``_p`` (array<double>, in the order of DOMAINS) and ``_draw``, a number in [0, 1) of the row."""
    words, weights, priors = model
    start = f"array({', '.join(f'{p!r}D' for p in priors)})"
    base = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_t"), unit(F.struct("doc_id", "text"), 66).alias("_draw"))
    if words:
        lexicon = f"split('{' '.join(words)}', ' ')"
        table = f"array({', '.join('array(' + ', '.join(f'{round(x, 5)!r}D' for x in w) + ')' for w in weights)})"
        found = base.withColumn("_f", F.expr(f"concat(array_intersect({words_sql('_t')}, {lexicon}), array_intersect({marks_sql('_t')}, {lexicon}))"))
        scores = f"aggregate(_f, {start}, (s, w) -> zip_with(s, element_at({table}, cast(array_position({lexicon}, w) as int)), (a, b) -> a + b))"
    else:
        found, scores = base.withColumn("_f", F.lit(0)), start
    exp = let("s", scores, "transform(s, x -> exp(x - array_max(s)))")
    p = let("e", exp, "transform(e, x -> x / aggregate(e, 0D, (a, y) -> a + y))")
    return found.withColumn("_p", F.expr(p)).withColumn("_tokens", F.expr(tokens_sql("_t"))).drop("_t", "_f")


def rate_of(steps: list[list[float]], scale: float = 1.0, hold: bool = False) -> Column:
    """The rate after ``steps``, from the document's posterior."""
    rate = F.lit(scale)
    if steps:
        table = "array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in step) + ")" for step in steps) + ")"
        taken = " + ".join(f"_p[{k}] * s[{k}]" for k in range(len(DOMAINS)))
        rate = F.expr(f"aggregate({table}, 1D, (r, s) -> greatest(0D, r - ({taken})))") * F.lit(scale)
    return F.when(held(), F.lit(1.0)).otherwise(rate) if hold else rate


def held() -> Column:
    return F.expr("_p[0] >= array_max(_p)")


def fit(members: DataFrame, targets: dict[str, float] = TARGETS, hold: bool = False) -> tuple[list[list[float]], float, bool, list[float]]:
    """Steps, scale and ``hold`` for ``rate_of``, from the columns _tokens and _p, and the share of the tokens that each domain reaches.

    Totals are measured against the first domain, which keeps its tokens; if it has none or
    nothing is asked of it, against that of the asked ones which has the most, and nothing is held.

    What should vanish: without ``hold``, each domain's total less its target, at
    the first domain's tokens; with it, each further domain's total less what the
    first one's total asks of it.
    """
    names, ks = list(DOMAINS), range(len(DOMAINS))
    wanted = np.array([targets[n] for n in names]) / sum(targets.values())

    def measured(steps):
        weighed = members.select(F.col("_tokens").cast("double").alias("t"), "_p", rate_of(steps, hold=hold).alias("r"), (held() if hold else F.lit(False)).alias("held"))
        free = F.when((F.col("r") > 0) & ~F.col("held"), F.col("t")).otherwise(0.0)
        sums = [F.sum(F.col("r") * F.col("t") * F.col("_p")[k]).alias(f"s{k}") for k in ks]
        row = weighed.agg(*sums, *[F.sum(free * F.col("_p")[i] * F.col("_p")[j]).alias(f"g{i}{j}") for i in ks for j in ks]).first()
        return np.array([row[f"s{k}"] or 0.0 for k in ks]), np.array([[row[f"g{i}{j}"] or 0.0 for j in ks] for i in ks])

    def shares(s):
        return s / max(s.sum(), 1e-9)

    have, gram = measured([])
    live = [k for k in ks if have[k] > 0]
    asked = [k for k in live if wanted[k] > 0]
    if not asked or len(live) < 2:
        return [], 1.0, hold, shares(have).tolist()
    base = 0 if 0 in asked else max(asked, key=lambda k: have[k])
    if hold and base:
        hold = False
        have, gram = measured([])
    first, unmoved = float(have[base]), have
    wanted = np.where(np.isin(ks, live), wanted, 0.0)
    wanted /= wanted.sum()
    want = first / wanted[base] * wanted
    ways = np.eye(len(names))[live]
    if hold:
        ways = ways[[k for k, d in enumerate(live) if d]] - np.outer(wanted[[d for d in live if d]] / wanted[0], np.eye(len(names))[0])

    def left(s):
        return ways @ (s if hold else s - want)

    def apart(s):
        return float(np.max(np.abs(shares(s) - wanted)[live] / np.maximum(wanted[live], 1e-3)))

    steps: list[list[float]] = []
    for _ in range(STEPS):
        if apart(have) <= CLOSE:
            break
        inner = ways @ gram @ ways.T
        newton = np.linalg.solve(inner + 1e-6 * np.diag(np.maximum(inner.diagonal(), 1.0)), left(have))
        # the plain gradient, at the greatest step that surely leads down, where the scaled one goes too far
        plain = left(have) / max(np.linalg.eigvalsh(inner)[-1], 1e-9)
        for step in (*(newton / 2**j for j in range(7)), plain):
            tried = [*steps, [float(x) for x in ways.T @ step]]
            new, new_gram = measured(tried)
            if np.linalg.norm(left(new)) < np.linalg.norm(left(have)) * (1 - 1e-9):
                break
        else:
            break
        steps, have, gram = tried, new, new_gram
    if have[base] <= 1e-6 * first:
        return [], 1.0, hold, shares(unmoved).tolist()
    return steps, 1.0 if hold else first / float(have[base]), hold, shares(have).tolist()


def rates(docs: DataFrame, labels: DataFrame, keep: list[str], targets: dict[str, float] = TARGETS, hold: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, the posteriors, ``rate``, ``copies``, and each domain's target and reached share.

    ``copies`` is the rate rounded up or down by a hash of doc_id and text, so that
    its expectation is the rate and copies of a text are drawn apart. Texts are read once: what the fit reads is written besides.
    """
    new = {"n_tokens", "rate", "copies", *(f"{x}_{n}" for n in DOMAINS for x in ("p", "target", "reached"))}
    kept = [c for c in keep if c.lower() not in new]
    whole = staged(with_posteriors(docs, learn(docs, labels), [F.struct(*[quoted(c) for c in kept], F.lit(0).alias("_")).alias("_row")]))
    steps, scale, hold, reached = fit(whole, targets, hold)
    rate = rate_of(steps, scale, hold)
    named = [F.col("_p")[k].alias(f"p_{n}") for k, n in enumerate(DOMAINS)]
    ends = [F.lit(float(x)).alias(f"{what}_{n}") for k, n in enumerate(DOMAINS) for what, x in (("target", targets[n]), ("reached", reached[k]))]
    back = [F.col("_row").getField(c).alias(c) for c in kept]
    return whole.select(*back, F.col("_tokens").alias("n_tokens"), *named, rate.alias("rate"), copies(rate).alias("copies"), *ends)


def copies(rate: Column) -> Column:
    """A whole number of copies with the rate as its expectation."""
    return F.floor(rate + F.col("_draw")).cast("int")


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, hold: bool = True) -> DataFrame:
    """``docs`` with each row as often as its rate says; columns as they were."""
    whole = staged(with_posteriors(docs, learn(docs, labels), [packed(docs).alias("_row")]))
    steps, scale, hold, _ = fit(whole, targets, hold)
    drawn = whole.withColumn("_copies", copies(rate_of(steps, scale, hold)))
    return drawn.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*unpacked(docs))
