"""N-gram Jaccard self-join of documents by MinHash banding.

Documents whose sets of word 5-grams have a Jaccard index of 0.8 or more are
linked. ``plan_bands`` picks bands and rows for the wanted recall at that
threshold, candidates meet by a shuffle on band hashes, and every candidate pair
is verified on its full n-gram sets.

1. Equal texts form a copy class. Classes come from partial sums over a hash of
   the text, so a group of copies of any size is one class and one
   representative (the lowest doc_id) works for it.
2. Representatives that share a band hash are candidates. They are compared
   within their component of shared bands where that is tight, as among the
   versions of one text, and else band by band: whichever asks for fewer pairs.
   So a chain of boilerplate through the corpus costs its candidate pairs, never
   the square of its length. Bands of equal members count once, and a pair
   is compared in the first band that it shares.
3. Such a set is cut into blocks of bounded weight by a hash of its members, and
   each pair of blocks is one unit of work. A unit compares all its texts by
   products of n-gram incidence matrices and returns, for each text, how many
   documents it is linked to, and a spanning forest of the links: what it
   returns is as large as what it reads, never the pairs themselves. Units are
   dealt by range, so that those of one large set spread over tasks.
4. Near-duplicate classes are the components of those forests.

Words are split at white space, case counts. A text of one to four words has one
n-gram, all its words; a null text counts as empty; texts without a word are
copies of each other if they are equal, and have no other link. Rows of equal
doc_id and text count as copies of each other. Null doc_ids come first in order.
Texts of any length are read whole. ``near_join`` reads no column but doc_id and
text; ``one_of_each`` leaves columns of any name as they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.llm.common import packed, staged, unpacked, with_columns
from cairn.shipping import ship

NGRAM, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
#: A block of a candidate group: about so many texts, and n-grams, at most.
BLOCK_TEXTS, BLOCK_GRAMS = 256, 1_000_000
#: Columns of an incidence matrix that are made at once, and words that a worker remembers.
SLICE, MAX_WORDS = 16_384, 120_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest false candidates) whose bands reach ``recall`` with at most ``most`` hashes."""
    best = (1, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


_words: dict[str, int] = {}


def grams(text: str | None, n: int = NGRAM) -> np.ndarray:
    """The set of a text's word n-grams as sorted 64-bit hashes."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > MAX_WORDS:
        _words.clear()
    known = _words
    got = list(map(known.get, words))
    if None in got:
        for i, x in enumerate(got):
            if x is None:
                w = words[i]
                if (x := known.get(w)) is None:
                    x = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
                got[i] = x
    h = np.array(got, np.uint64)
    k = min(n, len(h))
    out = h[: len(h) - k + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out = (out ^ (out >> np.uint64(29))) * _MIX + h[i : len(h) - k + 1 + i]
        out = (out ^ (out >> np.uint64(32))) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def band_hashes(grams_: np.ndarray, bands: int, rows: int, factors: np.ndarray, shifts: np.ndarray) -> list[int]:
    """A hash of each band of the signature; none for an empty set."""
    if not len(grams_):
        return []
    low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    small = (grams_ >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(small), 2048):
        part = small[at : at + 2048]
        np.minimum(low, (part[None, :] * factors[:, None] + shifts[:, None]).min(1), out=low)
    data = low.reshape(bands, rows)
    return [xxhash.xxh64_intdigest(data[b].tobytes(), seed=b) - (1 << 63) for b in range(bands)]


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def signatures(docs: DataFrame, bands: int, rows: int, n: int = NGRAM) -> DataFrame:
    """_id, _key (a 128-bit hash of the text), _grams (their number) and _bands of each row."""
    kept = docs.select(_id_of().alias("_id"), F.coalesce("text", F.lit("")).alias("_text"))

    def make():
        factors, shifts = permutations(bands * rows)

        def step(texts):
            sets = [grams(t, n) for t in texts]
            return {
                "_key": [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts],
                "_grams": [len(g) for g in sets],
                "_bands": [band_hashes(g, bands, rows, factors, shifts) for g in sets],
            }

        return step

    return with_columns(kept, ["_id"], F.col("_text"), make, "_key binary, _grams bigint, _bands array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): label is the least node of the component.

    Each round gives every node the least label around it and then the label of
    that label, so paths shorten by more than half; sums are partial, so a node
    of any degree is no hot spot. Rounds are written to the shared folder.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        known = labels.select("node", "label")
        near = both.join(known.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        hooked = known.join(near, known.node == near.a).select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        up = known.select(F.col("node").alias("to"), F.col("label").alias("above"))
        labels = staged(hooked.join(up, "to").select("node", F.least("to", "above").alias("label"), "was"), labels)
        if labels.where("label != was").isEmpty():
            return labels.select("node", "label")


OUT = "_key binary, _links bigint, _peer binary"


def links_in(texts: list[str], keys: list[bytes], sizes: list[int], left: np.ndarray, same: bool, threshold: float, n: int, before: np.ndarray | None = None) -> Iterator[tuple[int, int, list[int]]]:
    """For each text: the place, the documents it is linked to, and the places it is joined to in a spanning forest.

    ``left``: which texts are of the first block; ``same``: both blocks are one;
    ``before``: the texts' hashes of earlier bands, where pairs that share one were compared.
    """
    sets = [grams(t, n) for t in texts]
    count = np.array([len(s) for s in sets], np.float64)
    rows = np.flatnonzero(left)
    cols = rows if same else np.flatnonzero(~left)
    common = np.zeros((len(rows), len(cols)), np.float32)
    if len(rows) and len(cols):
        if len(rows) * len(cols) <= 16:
            for i, r in enumerate(rows):
                for j, c in enumerate(cols):
                    if not same or i < j:
                        common[i, j] = len(np.intersect1d(sets[r], sets[c], assume_unique=True))
            if same:
                common = common + common.T
        else:
            # only n-grams that more than one text has can be common to two
            every, seen = np.unique(np.concatenate(sets), return_counts=True)
            every = every[seen > 1]
            place = [np.searchsorted(every, s[np.isin(s, every, assume_unique=True)]) for s in sets]
            for at in range(0, len(every), SLICE):
                width = min(SLICE, len(every) - at)
                dense = np.zeros((len(sets), width), np.float32)
                for i, p in enumerate(place):
                    lo, hi = np.searchsorted(p, (at, at + width))
                    dense[i, p[lo:hi] - at] = 1
                common += dense[rows] @ dense[cols].T
    alike = common >= threshold * (count[rows][:, None] + count[cols][None, :] - common) - 1e-6
    alike &= common > 0
    for band in range(0 if before is None else before.shape[1]):
        alike &= before[rows, band][:, None] != before[cols, band][None, :]
    if same:
        np.fill_diagonal(alike, False)
    weight = np.array(sizes, np.int64)
    links = np.zeros(len(texts), np.int64)
    links[rows] += alike @ weight[cols]
    if not same:
        links[cols] += alike.T @ weight[rows]
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    peers: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        for j in np.flatnonzero(alike[i]):
            a, b = root(int(r)), root(int(cols[j]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                peers.setdefault(int(r), []).append(int(cols[j]))
    for i in range(len(texts)):
        yield i, int(links[i]), peers.get(i, [])


def verified(units: DataFrame, threshold: float, n: int) -> DataFrame:
    """OUT rows for units of (_unit, _lo, _hi): links of each key, and forest edges (_peer) with no links."""
    ship(units.sparkSession)
    out = T.StructType.fromDDL(OUT)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(rows):
            keys, texts, sizes, left, bands = [], [], [], [], []
            for key, size, text, mine, at, hashes in rows:
                if not keys or keys[-1] != key:
                    keys.append(key), sizes.append(size), texts.append(text), left.append(mine)
                    if at is not None:
                        bands.append(hashes[:at])
            made: dict[str, list] = {"_key": [], "_links": [], "_peer": []}
            before = np.array(bands, np.int64).reshape(len(keys), -1) if bands else None
            for i, links, peers in links_in(texts, keys, sizes, np.array(left, bool), same, threshold, n, before):
                if links:
                    made["_key"].append(keys[i]), made["_links"].append(links), made["_peer"].append(None)
                for j in peers:
                    made["_key"].append(keys[i]), made["_links"].append(0), made["_peer"].append(keys[j])
            return made

        held: dict[str, list] = {"_key": [], "_links": [], "_peer": []}
        current, rows, same = None, [], False
        for batch in batches:
            for unit, lo, hi, block, key, size, text, at, hashes in zip(*[batch.column(i).to_pylist() for i in range(9)], strict=True):
                if (unit, lo, hi) != current:
                    if len(rows) > 1:
                        for k, v in finish(rows).items():
                            held[k] += v
                        if len(held["_key"]) > 4096:
                            yield pa.RecordBatch.from_pydict(held, schema=arrow)
                            held = {k: [] for k in held}
                    current, rows, same = (unit, lo, hi), [], lo == hi
                rows.append((key, size, text, block == lo, at, hashes))
        if len(rows) > 1:
            for k, v in finish(rows).items():
                held[k] += v
        yield pa.RecordBatch.from_pydict(held, schema=arrow)

    return units.select("_unit", "_lo", "_hi", "_block", "_key", "_size", "_text", "_at", "_hashes").mapInArrow(run, out)


def _id_of() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))


def _key_of() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _blocks(texts: str, grams_: str) -> Column:
    return F.expr(f"cast(greatest(1, ceil({texts} / {BLOCK_TEXTS}), ceil({grams_} / {BLOCK_GRAMS})) as int)").alias("_blocks")


def candidates(reps: DataFrame) -> DataFrame:
    """Sets to compare: _unit, _blocks, _at (the band, null for a component), and _key, _rep, _size and _hashes (all bands, with _at) of each member."""
    banded = reps.select("_key", "_grams", F.posexplode("_bands").alias("at", "band"))
    met = banded.groupBy("at", "band").agg(F.min("_key").alias("low"), F.max("_key").alias("high"), F.count("*").alias("n"), F.expr("bit_xor(xxhash64(_key))").alias("x"), F.sum("_grams").alias("g"))
    met = staged(met.where("low != high").drop("high"))
    edges = banded.join(met.select("at", "band", "low"), ["at", "band"]).where("_key != low").select(F.col("_key").alias("a"), F.col("low").alias("b"))
    groups = components(edges)
    members = staged(reps.join(groups, reps._key == groups.node).select("_key", "_rep", "_size", "_grams", "_bands", F.col("label").alias("_group")))
    buckets = met.join(groups.select(F.col("node").alias("low"), F.col("label").alias("_group")), "low")
    buckets = staged(buckets.groupBy("_group", "n", "x").agg(F.min(F.struct("at", "band", "g")).alias("first")).select("_group", "n", "first.*"), met)
    whole = members.groupBy("_group").agg(F.count("*").alias("m"), F.sum("_grams").alias("g"))
    parts = buckets.groupBy("_group").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    sized = staged(whole.join(parts, "_group").select("_group", _blocks("m", "g"), (F.col("pairs") < F.col("m") * F.col("m")).alias("loose")))
    tight = members.join(sized.where("not loose"), "_group").select(F.col("_group").alias("_unit"), "_blocks", F.lit(None).cast("int").alias("_at"), "_key", "_rep", "_size", F.lit(None).cast("array<bigint>").alias("_hashes"))
    bands = buckets.join(sized.where("loose").select("_group"), "_group").select(F.col("at").alias("_at"), "band", _blocks("n", "g"))
    within = members.select("_key", "_rep", "_size", F.col("_bands").alias("_hashes"), F.posexplode("_bands").alias("_at", "band"))
    loose = within.join(bands, ["_at", "band"]).select(F.unhex(F.lpad(F.hex("band"), 16, F.lit("0"))).alias("_unit"), "_blocks", "_at", "_key", "_rep", "_size", "_hashes")
    return staged(tight.unionByName(loose), members, buckets, sized)


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _key, ...) and copy classes (_key, _rep, _size, _links, _class: the lowest id of the near-duplicate class)."""
    bands, rows = plan_bands(threshold, recall)
    rows_of = staged(signatures(docs, bands, rows, n))
    reps = staged(rows_of.groupBy("_key").agg(F.min("_id").alias("_rep"), F.count("*").alias("_size"), F.first("_grams").alias("_grams"), F.first("_bands").alias("_bands")))
    dealt = candidates(reps).withColumn("_block", F.expr("cast(pmod(xxhash64(_key), _blocks) as int)"))
    texts = docs.select(_id_of().alias("_rep"), _key_of().alias("_key"), F.coalesce("text", F.lit("")).alias("_text"))
    units = texts.join(dealt, ["_key", "_rep"]).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    units = units.select("_unit", F.least("_block", "_other").alias("_lo"), F.greatest("_block", "_other").alias("_hi"), "_block", "_key", "_size", "_text", "_at", "_hashes")
    units = units.repartitionByRange("_unit", "_lo", "_hi").sortWithinPartitions("_unit", "_lo", "_hi", "_key")
    found = staged(verified(units, threshold, n))
    links = found.groupBy("_key").agg(F.sum("_links").alias("_links"))
    forest = components(found.where("_peer is not null").select(F.col("_key").alias("a"), F.col("_peer").alias("b")))
    labelled = forest.join(reps.select(F.col("_key").alias("node"), "_rep"), "node")
    lowest = labelled.groupBy("label").agg(F.min("_rep").alias("_class"))
    named = staged(labelled.join(lowest, "label").select(F.col("node").alias("_key"), "_class"))
    links = staged(links, found)
    told = reps.select("_key", "_rep", "_size").join(links, "_key", "left").join(named, "_key", "left")
    told = staged(told.select("_key", "_rep", "_size", F.coalesce("_links", F.lit(0)).alias("_links"), F.coalesce("_class", "_rep").alias("_class")), reps, links, named)
    return rows_of, told


def near_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, copy_id, class_id, n_copies, n_links.

    ``copy_id`` is the lowest doc_id of equal texts, ``class_id`` that of the
    near-duplicate class; ``n_links`` counts the other documents, copies too,
    whose Jaccard index with this one is at least ``threshold``.
    """
    rows_of, told = near_classes(docs, threshold, n, recall)
    whole = rows_of.select("_id", "_key").join(told, "_key")
    shown = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return whole.select(
        shown("_id").alias("doc_id"), shown("_rep").alias("copy_id"), shown("_class").alias("class_id"),
        F.col("_size").alias("n_copies"), (F.col("_links") + F.col("_size") - 1).alias("n_links"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the lowest doc_id's (of several such rows, that of the lowest hash of the text)."""
    classes = near_classes(docs, threshold, n)[1]
    kept = classes.groupBy("_class").agg(F.min(F.struct("_rep", "_key")).alias("_first")).select("_first._rep", "_first._key")
    held = docs.select(packed(docs).alias("_row"), _id_of().alias("_rep"), _key_of().alias("_key")).join(kept, ["_key", "_rep"], "left_semi")
    return held.dropDuplicates(["_key", "_rep"]).select(*unpacked(docs))
