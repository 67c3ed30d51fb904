"""Toxicity by multiple-instance learning: document labels train a score of sentences.

A sentence's probability is the logistic function of the weights of its distinct
words and their beginnings, less what it would be without any (so that a sentence
that tells nothing adds nothing, and a long text isn't toxic for its length); a
document's is a leaky noisy-or of its sentences: 1 - (1 - leak) * product of (1 - p). Only documents have labels: those without toxicity say so of each of
their sentences, the others of at least one, and training finds which. The leak
takes what labels no sentence accounts for. Sentences of half a chance or more are told with their place.

Sentences end by . ! ? or a line feed. Whole texts are read, of any length. A null
or empty text has no sentence and scores the leak. Null labels don't train; a
document with both labels trains with both; without labels all score 0. Repeated
rows train once and each get a score. Kept columns named score, predicted or
offending give way to the new ones; other columns are neither read nor changed.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import staged, unit, with_columns
from cairn.shared import discard

#: Labelled rows, and bytes of their texts, that training reads, about: bounds on the sample, not on what is scored.
TRAIN_ROWS, TRAIN_BYTES = 10_000, 100_000_000
#: From this score on a document, or a sentence, counts as toxic.
THRESHOLD = 0.5
#: Words are hashed to so many slots. A slot gets a weight if documents of one label have it more often than chance
#: explains: by a likelihood ratio (G squared) of so much.
SLOTS, EVIDENCE = 1 << 20, 15.0
#: Lengths of the beginnings of words that have weights as well.
BEGINNINGS = (5, 6, 7, 8, 9)
#: Steps of training, their size, and the weight of squared weights.
STEPS, RATE, L2 = 150, 0.2, 0.02
#: The logit of a sentence without weights.
BIAS = -6.0
#: Words whose weight a worker remembers.
MEMORY = 200_000

_SENTENCE, _WORD = re.compile(r"[^.!?\n。！？]+"), re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    """``weights`` by slot, of those slots that have one."""

    weights: dict[int, float]
    leak: float


def chance(z: np.ndarray) -> np.ndarray:
    """The probability of sentences whose weights add up to ``z``."""
    none = 1 / (1 + np.exp(-BIAS))
    return np.maximum((1 / (1 + np.exp(-np.clip(z + BIAS, -30, 30))) - none) / (1 - none), 0.0)


def slots_of(word: str) -> list[int]:
    """The slots of a word: its own and those of its beginnings, which inflected and compound words share."""
    parts = [word, *[f"{word[:k]}*" for k in BEGINNINGS if k < len(word)]]
    return [zlib.crc32(p.encode("utf-8", "replace")) & (SLOTS - 1) for p in parts]


def instances(text: str | None) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-case words) of each sentence that has a word; places are code points, from 0."""
    found = []
    for m in _SENTENCE.finditer(text or ""):
        if words := set(_WORD.findall(m[0].lower())):
            found.append((m.start(), m.end(), words))
    return found


def fit(doc: np.ndarray, sizes: np.ndarray, slots: np.ndarray, y: np.ndarray) -> Model:
    """The model by gradient ascent on the log-likelihood (Adam).

    ``doc`` (a place in ``y``) and number of ``slots`` of each sentence that has some, one after the other; the others tell nothing.
    """
    n = len(y)
    if not y.any():
        return Model({}, 0.0)
    sentence = np.repeat(np.arange(len(doc)), sizes)
    common, words = np.unique(slots, return_inverse=True)
    x = np.zeros(len(common) + 1)  # weights, and the logit of the leak
    x[-1] = np.log(0.25 * y.mean() / (1 - 0.25 * y.mean()))
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        z = np.bincount(sentence, x[words], len(doc))
        leak = 1 / (1 + np.exp(-x[-1]))
        none = np.log1p(-leak) + np.bincount(doc, np.log1p(-np.minimum(chance(z), 1 - 1e-12)), n)  # log of the chance that nothing is toxic
        q = np.exp(none)
        pull = np.where(y, q / np.maximum(1 - q, 1e-9), -1.0)  # how the likelihood grows by the log of the chance against each cause
        dz = np.where(z >= 0, pull[doc] / (1 + np.exp(-np.clip(z + BIAS, -30, 30))), 0.0)
        g = np.concatenate((np.bincount(words, dz[sentence], len(common)) - L2 * x[:-1], [pull.sum() * leak]))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x += RATE * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    kept = np.flatnonzero(np.abs(x[:-1]) > 1e-3)
    return Model(dict(zip(common[kept].tolist(), x[kept].tolist(), strict=True)), float(1 / (1 + np.exp(-x[-1]))))


def telling(slots: DataFrame) -> DataFrame:
    """The slots of sentences (doc, bad, sentence, slot) whose share of toxic documents differs from that of all by EVIDENCE; SLOTS at most.

    A sentence counts in the first of the documents that have it, so that copies are no evidence.
    """
    own = slots.join(slots.groupBy("sentence").agg(F.min("doc").alias("doc")), ["sentence", "doc"]).select("doc", "bad", "slot").distinct()
    share = own.select("doc", "bad").distinct().agg((F.count_if("bad") + 0.5) / (F.count("*") + 1)).first()[0]
    part = lambda k, want: F.when(k > 0, k * F.log(k / want)).otherwise(0.0)
    c, b = F.col("n").cast("double"), F.col("n_bad").cast("double")
    counts = own.groupBy("slot").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"))
    return counts.where(2 * (part(b, c * share) + part(c - b, c * (1 - share))) >= EVIDENCE).select("slot")


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Model:
    """The model of about ``rows`` labelled documents that ``learn`` admits, whose texts have about ``size`` bytes.

    The sample is drawn by a hash of the id. An id has two rows of the sample at most, so it is
    small enough to broadcast; if many documents share an id, or texts are
    long, documents are thinned out by a hash of id and text. Tasks split texts, hash words and
    find the slots that tell something; the driver gets those alone.
    """
    able = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") > 0).alias("bad")).distinct()
    n = able.count()
    if n > rows:
        able = able.where(unit(F.col("doc_id"), 6) < rows / n)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(able), "doc_id")
    n, total = sample.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1.0, 2 * rows / max(1, n), size / max(1, total))
    if share < 1:
        sample = sample.where(unit(F.struct("doc_id", "text"), 7) < share)
    sample = sample.dropDuplicates(["doc_id", "bad", "text"]).withColumn("doc", F.xxhash64("doc_id", "bad", "text"))

    def make():
        return lambda texts: {"slots": [[sorted(i for w in words for i in slots_of(w)) for _, _, words in instances(t)] for t in texts]}

    split = staged(with_columns(sample, ["doc", "bad"], "text", make, "slots array<array<int>>"))
    each = split.select("doc", "bad", F.posexplode("slots").alias("at", "s")).select("doc", "bad", "at", F.xxhash64("s").alias("sentence"), F.explode("s").alias("slot"))
    found = each.join(F.broadcast(telling(each)), "slot").groupBy("doc", "bad", "at").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    got = found.orderBy("doc", "bad", "at").toArrow().combine_chunks()
    all_bad, all_fair = split.agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
    discard(split)
    # documents with a telling sentence come first, then the others
    names, doc = np.unique(got["doc"].to_numpy(), return_inverse=True)
    y = np.zeros(len(names), bool)
    y[doc] = got["bad"].to_numpy(zero_copy_only=False)
    y = np.concatenate((y, np.ones(all_bad - y.sum(), bool), np.zeros(all_fair - (~y).sum(), bool)))
    return fit(doc, pc.list_value_length(got["slots"]).to_numpy(), pc.list_flatten(got["slots"]).to_numpy(), y)


def score(docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns of ``docs`` with ``score``, ``predicted`` and ``offending``: start, end (code points) and score of sentences from ``threshold`` on."""
    weights, leak = model.weights, model.leak

    def make():
        known: dict[str, float] = {}

        def weight(word: str) -> float:
            if len(known) >= MEMORY:
                known.clear()
            known[word] = w = sum(weights.get(i, 0.0) for i in slots_of(word))
            return w

        def step(texts):
            scores, places = [], []
            for t in texts:
                found = instances(t)
                p = chance(np.array([sum([w if (w := known.get(x)) is not None else weight(x) for x in words]) for _, _, words in found], float))
                scores.append(float(1 - (1 - leak) * np.exp(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())))
                places.append([{"start": found[i][0], "end": found[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= threshold)])
            return {"score": scores, "predicted": [int(s >= threshold) for s in scores], "offending": places}

        return step

    return with_columns(docs, keep, "text", make, "score double, predicted int, offending array<struct<start: bigint, end: bigint, score: double>>")
