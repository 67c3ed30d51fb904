"""Language identification with hyperdimensional n-gram profiles.

Each letter (code point) has a random +1/-1 vector. An n-gram's vector binds its
letters' vectors, each permuted (rolled) by its place, by multiplication; a text
bundles the vectors of its n-grams by addition. A language's prototype bundles
the texts of that language at unit length, and a text gets the language whose
prototype has the greatest cosine to it.

Empty, null and letterless texts get ``und`` and score 0. Ties go to the first
language in alphabetical order. Rows without a language don't train; where none
trains, every text with a letter gets ``und`` too. Whole texts are read, of any
length. Repeated rows each get a row. Of the kept columns, one named lang_pred
or score gives way to the new one; other columns are neither read nor changed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import unit, with_columns

UND = "und"
DIM, SEED = 512, 11
#: Texts that are bundled by one matrix product.
BLOCK = 64
_EDGE, _FIRST = np.zeros(1, np.int64), np.ones(1, bool)
#: Labelled rows that training reads, about: a bound on the sample, not on what is predicted.
TRAIN_ROWS = 20_000


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(4096)
def letter_vector(code: int) -> np.ndarray:
    """The random vector of a code point, 0 (no letter, or the edge of the text) included: +1 or -1 by the bits of its hashes."""
    data = code.to_bytes(4, "little")
    bits = np.unpackbits(np.frombuffer(b"".join(xxhash.xxh64_digest(data, seed=SEED + k) for k in range(DIM // 64)), np.uint8))
    return bits.astype(np.float32) * 2 - 1


def gram_vectors(grams_: np.ndarray) -> np.ndarray:
    """The bound vector of each trigram: roll(a, 2) * roll(b, 1) * c."""
    out = np.ones((len(grams_), DIM), np.float32)
    for k in range(3):
        used, at = np.unique(grams_ >> 21 * (2 - k) & 0x1FFFFF, return_inverse=True)
        out *= np.array([np.roll(letter_vector(int(c)), 2 - k) for c in used])[at]
    return out


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The trigrams of a text (21 bits a letter, 0 for what is none) and their counts; None if it has no letter."""
    if not text:
        return None
    s = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.where(letters()[s], s, 0).astype(np.int64)
    if not s.any():
        return None
    s = np.concatenate((_EDGE, s, _EDGE))
    s = s[np.concatenate((_FIRST, (s[1:] | s[:-1]) != 0))]
    return np.unique(s[:-2] << 42 | s[1:-1] << 21 | s[2:], return_counts=True)


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the texts that have a letter, and which those are."""
    got = [(i, g) for i, t in enumerate(texts) if (g := grams(t)) is not None]
    out = np.zeros((len(got), DIM), np.float32)
    for at in range(0, len(got), BLOCK):
        block = got[at : at + BLOCK]
        used = np.unique(np.concatenate([g for _, (g, _) in block]))
        dense = np.zeros((len(block), len(used)), np.float32)
        for k, (_, (g, c)) in enumerate(block):
            dense[k, np.searchsorted(used, g)] = c
        out[at : at + BLOCK] = dense @ gram_vectors(used)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9), np.array([i for i, _ in got], np.int64)


def train(docs: DataFrame, learn: Column, rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Language prototypes from about ``rows`` of the rows that ``learn`` admits.

    The sample is drawn by a hash of the text, so copies enter or stay out
    together. Tasks bundle their own rows; what reaches the driver is one
    vector for each language of the sample.
    """
    able = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    n = able.count()
    if n > rows:
        able = able.where(unit(F.col("text"), SEED) < rows / n)

    def make():
        def step(texts):
            vectors, at = bundles(texts)
            made: list = [None] * len(texts)
            for i, v in zip(at, vectors, strict=True):
                made[i] = v.tolist()
            return {"v": made}

        return step

    vectors = with_columns(able, ["lang"], "text", make, "v array<float>").where("v is not null")
    sums = vectors.groupBy("lang").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(DIM)]).alias("v"))
    return {r.lang: np.array(r.v, np.float32) for r in sums.collect()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred`` and ``score``; reads no other column but ``text``."""
    names = sorted(prototypes)
    unitary = np.array([prototypes[k] / max(np.linalg.norm(prototypes[k]), 1e-9) for k in names]).reshape(-1, DIM)

    def make():
        def step(texts):
            langs, scores = [UND] * len(texts), [0.0] * len(texts)
            if names:
                vectors, at = bundles(texts)
                for i, c in zip(at, vectors @ unitary.T, strict=True):
                    langs[i], scores[i] = names[int(c.argmax())], float(min(1, max(0, c.max())))
            return {"lang_pred": langs, "score": scores}

        return step

    return with_columns(docs, keep, "text", make, "lang_pred string, score double")
