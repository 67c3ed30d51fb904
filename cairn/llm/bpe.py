"""Byte-pair encoding by a deterministic automaton compiled from the merges.

Every merge (a, b) is a gadget: it takes the arc b out of the state that a
leads to and adds an arc for ab. After all merges, a token sequence is the
encoding of a word exactly if each token has an arc to the next. ``joins``
answers which arcs the gadgets leave, going back through the merges instead of
storing every arc. ``Automaton`` determinises this over the word's bytes: a
state holds the tokens that may be growing and the token before each. States and
transitions are made when a word first needs them and kept in a table, so that
most words are read by look-ups alone. Decoding emits the arcs' labels.

Texts go through the steps that the tokenizer file names: added tokens are cut
out, then the normalizers (of which NFC, NFD, NFKC, NFKD, Lowercase and Replace
are known; any other is an error), the split pattern and the byte alphabet. Null
and empty texts have no token. Words of any length are read in time linear in
their length. Repeated rows each get a row. ``digests`` and ``decode`` read no other column;
of those that ``encode`` keeps, one named ids or n_tokens gives way to the new one.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import with_columns

#: Words in a generation of a worker's memory (it holds two: what the younger one lacks is looked for in the older), and the
#: states and arcs beyond which its automaton starts anew. What it keeps stays with the worker after its task.
MAX_WORDS, MAX_STATES, MAX_ARCS = 200_000, 150_000, 300_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: Without these, a text's normal form has nothing beyond U+024F, and a plain ``re`` can split it.
_BEYOND = re.compile("[^\x00-\u012f\u0132-\u017e]")


def latin(kind: str) -> str:
    """The characters below U+0250 of a Unicode category, for a character class of ``re``."""
    return "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)


def lowered(text: str) -> str:
    """Lower case, each character by itself: no final sigma."""
    return text.lower() if text.isascii() else text.replace("Σ", "σ").lower()


def normalizer(spec: dict | None) -> list[Callable[[str], str]]:
    """The steps of a tokenizer file's normalizer. Runs of white space that become a space change no word and are left out."""
    kind = (spec or {}).get("type")
    if kind is None:
        return []
    if kind == "Sequence":
        return [step for part in spec["normalizers"] for step in normalizer(part)]
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return [lambda t: t if t.isascii() else unicodedata.normalize(kind, t)]
    if kind == "Lowercase":
        return [lowered]
    if kind == "Replace":
        pattern, content = spec["pattern"], spec["content"]
        if pattern.get("Regex") == r"\s+" and content == " ":
            return []
        found = regex.compile(pattern["Regex"] if "Regex" in pattern else regex.escape(pattern["String"]))
        return [lambda t: found.sub(lambda _: content, t)]
    raise ValueError(f"no such normalizer: {kind}")


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.pair[x, y] = r
            self.rank.setdefault(made, r)
            self.parts.setdefault(made, (x, y))
        self.label = [""] * (max(vocab.values(), default=-1) + 1)
        self.lengths = [0] * len(self.label)
        # the vocabulary as a tree: children by byte, the token that a node is, and the token if the word ends there
        self.child: list[dict[int, int]] = [{}]
        self.whole, self.closed = [-1], [-1]
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        for t, i in vocab.items():
            self.label[i] = t
            ends = bool(word_end) and t.endswith(word_end) and t != word_end
            letters = t[: -len(word_end)] if ends else t
            self.lengths[i] = len(letters)
            if not all(c in byte_of for c in letters):
                continue  # no word has it
            at = 0
            for c in letters:
                at = self.child[at].setdefault(byte_of[c], len(self.child))
                if at == len(self.child):
                    self.child.append({})
                    self.whole.append(-1)
                    self.closed.append(-1)
            (self.closed if ends or not word_end else self.whole)[at] = i
            if not word_end:
                self.whole[at] = i
        self.arcs: dict[tuple[int, int], bool] = {}
        self.restart()

    def restart(self) -> None:
        self.arcs.clear()
        # a state: for each end of a token after which another may grow, the longest first, where that one stands
        # in the tree and the token before it (-1: the word begins)
        self.states: list[tuple[tuple[int, int], ...]] = [((0, -1),)]
        self.number = {self.states[0]: 0}
        #: The next state, and the last token of a word that ends, by state * 256 + byte.
        self.table: dict[int, int] = {}
        self.closing: dict[int, int] = {}
        self.last: list[int] = [-1]

    def joins(self, x: int, y: int) -> bool:
        """Is there an arc y out of the state that token x leads to?"""
        if (known := self.arcs.get((x, y))) is None:
            known, a, b, before = True, x, y, len(self.pair) + 1
            while True:
                if self.pair.get((a, b), before) < before:
                    known = False
                    break
                ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
                if ra < 0 and rb < 0:
                    break
                if ra > rb:  # a is the younger: at its merge its right part met b
                    a, before = self.parts[a][1], ra
                else:
                    b, before = self.parts[b][0], rb + 1
            self.arcs[x, y] = known
        return known

    def ending(self, state: int, byte: int, tokens: list[int]) -> int:
        """The last token after reading ``byte`` in ``state``; -1 if none fits."""
        for node, before in self.states[state]:
            to = self.child[node].get(byte)
            if to is not None and (token := tokens[to]) >= 0 and (before < 0 or self.joins(before, token)):
                return token
        return -1

    def step(self, state: int, byte: int) -> int:
        token = self.ending(state, byte, self.whole)
        live = tuple((to, before) for node, before in self.states[state] if (to := self.child[node].get(byte)) is not None)
        key = (*live, (0, token))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.last.append(token)
        self.table[state << 8 | byte] = to
        return to

    def encode(self, word: bytes) -> list[int]:
        """The tokens of a word."""
        if len(self.states) > MAX_STATES or len(self.arcs) > MAX_ARCS:
            self.restart()
        table, last, at, read = self.table, self.last, 0, []
        for byte in word[:-1]:
            at = table.get(at << 8 | byte) or self.step(at, byte)
            read.append(last[at])
        byte = word[-1]
        token = self.closing.get(at << 8 | byte)
        if token is None:
            token = self.closing[at << 8 | byte] = self.ending(at, byte, self.closed)
        lengths = self.lengths
        out, end = [token], len(word) - lengths[token]
        while end > 0:
            token = read[end - 1]
            out.append(token)
            end -= lengths[token]
        out.reverse()
        return out


class Tokenizer:
    """Texts to ids and back, by the parts of a tokenizer file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.automaton = Automaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.label = self.automaton.label
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label += [""] * (max(self.added.values(), default=-1) + 1 - len(self.label))
        for t, i in self.added.items():
            self.label[i] = t
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.steps = normalizer(spec.get("normalizer"))
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split_latin = re.compile(split.replace(r"\p{L}", latin("L")).replace(r"\p{N}", latin("N")).replace(r"\s", r"\t-\r \x85\xa0"))
        self.split = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        #: Two generations of words and their ids, as bytes: a word in use stays, a rare one goes after a while.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """The ids of a word as little-endian 32-bit numbers."""
        made = self.words.get(word)
        if made is None:
            made = self.older.get(word)
            if made is None:
                ids = self.automaton.encode(word.encode())
                made = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.words) >= MAX_WORDS:
                self.words, self.older = {}, self.words
            self.words[word] = made
        return made

    def read(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        out = []
        for piece in self.cut.split(text) if any(map(text.__contains__, self.added)) else (text,):
            if piece in self.added:
                out.append(struct.pack("<I", self.added[piece]))
                continue
            split = self.split if not piece.isascii() and _BEYOND.search(piece) else self.split_latin
            for step in self.steps:
                piece = step(piece)
            words = split.findall(piece)
            got = list(map(self.words.get, words))
            at = -1
            for _ in range(got.count(None)):
                at = got.index(None, at + 1)
                got[at] = self.word(words[at])
            out += got
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.read(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.label.__getitem__, ids))


@lru_cache(1)
def tokenizer_of(spec: str) -> Tokenizer:
    """One a worker process, so that its words and states serve all its tasks."""
    return Tokenizer(json.loads(spec))


def load(spark: SparkSession, path: str):
    """A tokenizer file, broadcast: its size is that of the vocabulary, whatever the data."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row."""
    spec = load(docs.sparkSession, path or default_path())

    def make():
        tokenizer = tokenizer_of(spec.value)

        def step(texts):
            ids = [tokenizer.read(t) if t else b"" for t in texts]
            decoded = [tokenizer.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            return {
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
            }

        return step

    return with_columns(docs, ["doc_id"], "text", make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id) with ``ids`` and ``n_tokens``."""
    spec = load(docs.sparkSession, path or default_path())

    def make():
        tokenizer = tokenizer_of(spec.value)

        def step(texts):
            ids = [tokenizer.read(t) if t else b"" for t in texts]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            kind = pa.list_(pa.field("element", pa.int32()))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values, type=kind)
            return {"ids": lists, "n_tokens": pa.array(sizes)}

        return step

    return with_columns(docs, keep or ["doc_id"], "text", make, "ids array<int>, n_tokens bigint")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with the text that the ids' labels make; null ids count as none."""
    spec = load(encoded.sparkSession, path or default_path())

    def make():
        tokenizer = tokenizer_of(spec.value)
        return lambda ids: {"decoded": [tokenizer.decode(x or []) for x in ids]}

    return with_columns(encoded, ["doc_id", "ids"], "ids", make, "decoded string")
