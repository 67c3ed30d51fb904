"""Document fingerprints of closed syncmers, in SQL functions alone.

A closed syncmer is a window of K bytes of the UTF-8 text whose least inner
substring of S bytes (by 64-bit hash) is its first or its last. All of them are
the anchors, about one in 5 bytes, and every stretch of K + W - 1 bytes holds
one. Whether a window is an anchor depends on its own bytes only, so equal
passages have equal anchors wherever they stand, and the anchors of a spliced
text are those of its parts and of the few windows over the seam.

A fingerprint is the anchors' hashes (8 hex digits each) in text order. A text
without an anchor (as every text under K bytes) has one anchor of its whole
content, so that equal texts, empty ones too, have equal fingerprints. Likeness
is the Jaccard index of the sets of anchor hashes.

Documents are ordered by doc_id (null first), then by a hash of the text; the one
after the last is the first. Null texts count as empty. Repeated rows are
documents of their own, so a row's next document may be its copy. Texts of any
length are read whole. No column but doc_id and text is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import let

K, S = 16, 6
W = K - S + 1
#: Documents in a range, about, and the most ranges, as their bounds pass through the driver: beyond 10 million documents a
#: range holds more than RANGE_ROWS, and its sort spills.
RANGE_ROWS, MAX_RANGES = 500, 20_000


def anchors_sql(data: str) -> str:
    """array<bigint> of the anchors of the binary ``data`` in text order: start (from 0) * 2**32 + hash."""
    hashes = f"transform(sequence(1, octet_length(b) - {S - 1}), i -> xxhash64(substring(b, i, {S})))"
    # the first or the last is the least: each chain of comparisons ends at the first that fails
    first = " and ".join(f"h[i] <= h[i + {j}]" for j in range(1, W))
    last = " and ".join(f"h[i + {W - 1}] <= h[i + {j}]" for j in range(W - 1))
    starts = f"filter(sequence(0, size(h) - {W}), i -> ({first}) or ({last}))"
    packed = f"transform({starts}, i -> shiftleft(cast(i as bigint), 32) | (xxhash64(substring(b, i + 1, {K})) & 4294967295L))"
    return let("b", data, f"if(octet_length(b) < {K}, cast(array() as array<bigint>), {let('h', hashes, packed)})")


def within(anchors: str, size: str) -> str:
    """Those anchors that end by byte ``size``."""
    return f"filter({anchors}, a -> shiftright(a, 32) + {K} <= {size})"


def hashes_sql(anchors: str, text: str) -> str:
    """The hashes of the anchors, or one of the whole text."""
    return f"if(size({anchors}) > 0, transform({anchors}, a -> a & 4294967295L), array(xxhash64({text}) & 4294967295L))"


def hex_sql(hashes: str) -> str:
    return f"lower(array_join(transform({hashes}, a -> lpad(hex(a), 8, '0')), ''))"


def likeness_sql(a: str, b: str) -> str:
    """Jaccard index of two arrays without repeats."""
    return let("n", f"size(array_intersect({a}, {b}))", f"cast(n as double) / (size({a}) + size({b}) - n)")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id and _text of ``docs`` with ``_anchors``, and a struct ``_next`` of the _text and _anchors of the document after it.

    Rows are dealt into ranges that hold about RANGE_ROWS each, by doc_id and hash of the
    text together, so that an id of many documents is split as well. The first
    document of a range also goes, as a guest, to the range before it, and the
    very first to the last. So the text moves once and no task sees all.
    """
    low = docs.agg(F.min("doc_id")).first()[0] or 0
    # one number for the order: ids from the least on (0 for null) above 60 bits of a hash
    high = F.coalesce(F.col("doc_id").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)") + 1, F.lit(0)).cast("decimal(20,0)")
    placed = docs.withColumn("_k", (high * F.lit(2**60).cast("decimal(19,0)") + F.shiftrightunsigned(F.xxhash64("_text"), 4)).cast("decimal(38,0)"))
    n = docs.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    if ranges > 1:
        fractions = ", ".join(repr(i / ranges) for i in range(1, ranges))
        found = placed.agg(F.expr(f"percentile_approx(_k, array({fractions}), {20 * ranges})")).first()[0]
        # bounds that are documents: the first of each range
        near = placed.withColumn("_own", F.expr(_range_sql(sorted({0, *map(int, found)}))))
        cuts = sorted(int(r[0]) for r in near.groupBy("_own").agg(F.min("_k")).select("min(_k)").collect())
    else:
        cuts = [int(x) for x in placed.agg(F.min("_k")).first() if x is not None] or [0]
    placed = placed.withColumn("_own", F.expr(_range_sql(cuts))).withColumn("_first", F.expr(f"{_bounds(cuts)}[_own] = _k"))
    own = F.struct(F.col("_own").alias("range"), F.lit(0).alias("guest"))
    guest = F.struct(F.expr(f"if(_own = 0, {len(cuts) - 1}, _own - 1)").alias("range"), F.lit(1).alias("guest"))
    dealt = placed.select("doc_id", "_text", "_k", F.explode(F.when(F.col("_first"), F.array(own, guest)).otherwise(F.array(own))).alias("_at"))
    dealt = dealt.select("doc_id", "_text", "_k", F.col("_at.range").alias("_range"), F.col("_at.guest").alias("_guest")).repartition("_range")
    made = dealt.withColumn("_anchors", F.expr(anchors_sql("cast(_text as binary)")))
    w = Window.partitionBy("_range").orderBy("_guest", "_k", "_text")
    return made.withColumn("_next", F.lead(F.struct("_text", "_anchors")).over(w)).where("_guest = 0").select("doc_id", "_text", "_anchors", "_next")


def _bounds(cuts: list[int]) -> str:
    """One literal, once the optimizer has folded it."""
    return f"cast(split('{' '.join(map(str, cuts))}', ' ') as array<decimal(38,0)>)"


def _range_sql(cuts: list[int]) -> str:
    """The place of the last of ``cuts`` that is not above _k (0 if all are), by halving."""
    middle = "(s.lo + s.hi + 1) div 2"
    step = f"if(c[{middle}] <= _k, named_struct('lo', cast({middle} as int), 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast(greatest(s.lo, {middle} - 1) as int)))"
    return let("c", _bounds(cuts), f"aggregate(sequence(1, {max(1, len(cuts).bit_length())}), named_struct('lo', 0, 'hi', {len(cuts) - 1}), (s, i) -> {step}, s -> s.lo)")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, fingerprint, those of its edited text, and the likenesses."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    led = with_next(texts)
    n, m = F.length("_text"), F.floor(F.length("_text") / 4).cast("int")
    parts = led.select(
        "doc_id", F.col("_text"), n.alias("_n"), F.col("_anchors").alias("_own"), F.col("_next._text").alias("_after_text"), F.col("_next._anchors").alias("_after"),
        F.substring("_text", F.lit(1), n - m).alias("_head"), F.substring(F.col("_next._text"), F.lit(1), m).alias("_tail"),
    )
    seam_left, seam_right = f"least(octet_length(_head), {K - 1})", f"least(octet_length(_tail), {K - 1})"
    seam = f"concat(substring(cast(_head as binary), octet_length(_head) - {seam_left} + 1, {seam_left}), substring(cast(_tail as binary), 1, {seam_right}))"
    joined = parts.select(
        "*",
        F.concat("_head", "_tail").alias("_edited"),
        F.expr(f"concat({within('_own', 'octet_length(_head)')}, {anchors_sql(seam)}, {within('_after', 'octet_length(_tail)')})").alias("_edited_anchors"),
    )
    hashed = joined.select(
        "doc_id", F.col("_n").cast("bigint").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        F.expr(hashes_sql("_own", "_text")).alias("_a"), F.expr(hashes_sql("_edited_anchors", "_edited")).alias("_e"), F.expr(hashes_sql("_after", "_after_text")).alias("_b"),
    )
    sets = hashed.select("*", *[F.array_distinct(c).alias(f"{c}s") for c in ("_a", "_e", "_b")])
    return sets.select(
        "doc_id", "n_chars", "edited_sha256", F.expr(hex_sql("_a")).alias("fingerprint"), F.expr(hex_sql("_e")).alias("edited_fingerprint"),
        F.expr(likeness_sql("_as", "_es")).alias("near_edited"), F.expr(likeness_sql("_as", "_bs")).alias("near_next"),
    )


def anchor_positions(docs: DataFrame, text: str = "text") -> DataFrame:
    """For matching by position: doc_id, start (bytes, from 0) and hash of each anchor."""
    packed = docs.select("doc_id", F.explode(F.expr(anchors_sql(f"cast({text} as binary)"))).alias("a"))
    return packed.select("doc_id", F.expr("shiftright(a, 32)").alias("start"), F.expr("a & 4294967295L").alias("hash"))
