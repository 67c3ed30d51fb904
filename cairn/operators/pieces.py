"""Texts to pieces of a given vocabulary, for providers of embeddings that want token ids.

A vocabulary is a list of pieces, one a line of its file; a piece's place is its
id. Pieces that go on inside a word begin with ``##``. Text is lower-cased and parted into
words and single marks; of each word the longest piece that fits comes first, then the
longest that goes on, by a trie; a word that can't be made up so, or is very long, is one
unknown piece. What is over the limit is cut, and both end marks stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

from cairn.operators.embedding import BATCH

_WORD = re.compile(r"\w+|[^\w\s]")
#: Characters of a word beyond which it is unknown, and ids of a text with both end marks.
LONGEST_WORD, MOST = 100, 256


class Pieces:
    """``encode`` gives the ids of a text, the end marks included."""

    def __init__(self, vocabulary: list[str], most: int = MOST, begin: str = "[CLS]", end: str = "[SEP]", unknown: str = "[UNK]"):
        place = {p: i for i, p in enumerate(vocabulary)}
        self.begin, self.end, self.unknown, self.most = place[begin], place[end], place[unknown], most
        #: Two tries, of pieces that begin a word and of those that go on; a node maps characters to nodes, and None to an id.
        self.first, self.rest = {}, {}
        for piece, i in place.items():
            node = self.rest if piece.startswith("##") and len(piece) > 2 else self.first
            for c in piece[2:] if node is self.rest else piece:
                node = node.setdefault(c, {})
            node[None] = i

    def word(self, word: str) -> list[int]:
        found, at, trie = [], 0, self.first
        while at < len(word) and len(word) <= LONGEST_WORD:
            node, to, best = trie, at, None
            while to < len(word) and (node := node.get(word[to])) is not None:
                to += 1
                if None in node:
                    best = node[None], to
            if best is None:
                return [self.unknown]
            found.append(best[0])
            at, trie = best[1], self.rest
        return found or [self.unknown]

    def encode(self, text: str) -> list[int]:
        ids = [self.begin]
        for m in _WORD.finditer(text.lower()):
            if len(ids) >= self.most - 1:
                break
            ids += self.word(m[0])
        return [*ids[: self.most - 1], self.end]


class FromPieces:
    """A provider that a model over token ids backs: ``vocabulary()`` and ``load()`` run once in each worker, when the first text comes.

    ``load`` returns a function from a matrix of ids, filled up with 0, and one of which are real, to an array of
    shape (texts, dim). Texts go to it by length, BATCH at a time at most, so that little is filled up.
    """

    #: Texts that are put into batches together.
    texts = 16 * BATCH

    def __init__(self, model_id: str, dim: int, vocabulary: Callable[[], list[str]], load: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], most: int = MOST):
        self.model_id, self.dim, self.vocabulary, self.load, self.most = model_id, dim, vocabulary, load, most

    def embed(self, texts: list[str]) -> np.ndarray:
        if self.model_id not in _loaded:
            _loaded[self.model_id] = Pieces(self.vocabulary(), self.most), self.load()
        pieces, model = _loaded[self.model_id]
        ids = [pieces.encode(t) for t in texts]
        out = np.zeros((len(texts), self.dim), np.float32)
        order = sorted(range(len(ids)), key=lambda i: len(ids[i]))
        for at in batches([len(ids[i]) for i in order]):
            some = [order[i] for i in range(*at)]
            filled = np.zeros((len(some), len(ids[some[-1]])), np.int64)
            real = np.zeros(filled.shape, bool)
            for row, mark, i in zip(filled, real, some, strict=True):
                row[: len(ids[i])], mark[: len(ids[i])] = ids[i], True
            made = np.asarray(model(filled, real), np.float32)
            if made.shape != (len(some), self.dim):
                raise ValueError(f"{self.model_id} gave {made.shape}, not {(len(some), self.dim)}")
            out[some] = made
        return out


def batches(lengths: list[int]) -> list[tuple[int, int]]:
    """Spans of ascending ``lengths``: BATCH at most, the longest no more than a quarter and 8 over the shortest."""
    spans, start = [], 0
    for i, n in enumerate(lengths):
        if i - start == BATCH or n > 1.25 * lengths[start] + 8:
            spans.append((start, i))
            start = i
    return [*spans, (start, len(lengths))] if lengths else []


#: The vocabularies and models that this worker has loaded.
_loaded: dict[str, tuple[Pieces, Callable[[np.ndarray, np.ndarray], np.ndarray]]] = {}
