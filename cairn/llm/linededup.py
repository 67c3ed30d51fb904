"""Line dedup by a log-template tree, in DataFrame and SQL functions alone.

The tree has a fixed depth: a line goes down by its token count, then by its
first DEPTH tokens, to a leaf. Tokens are parted by white space. Variable fields
become ``<*>`` in two ways: first every token with a digit or an ``@``, then, in
the leaf, every token that few lines have at that place, as measured by the line's other
tokens. The measure is how many lines of the leaf (equal lines are one) have the
token there, ranked within the line: the count at the rank where CONSTANT of the line's
tokens are reached is what a constant part has, and a token with half of that or
less is a field. The counts grow with the corpus together, so a leaf of any size
gives the same fields. What is left is the line's template. At least CONSTANT of its
tokens must be constant; a line that the fields would leave with fewer stands
for itself and must be equal. Lines of every length go the same way.

A template recurs if two documents have it. Its first document (by doc_id, null
first, then a hash of the text) keeps the line and all others lose it, so
boilerplate and copied passages survive once. A line whose constant tokens stand
in no other document stays. What a field holds in the later documents goes with
their lines: at most a quarter of a line's tokens. A field's value that more than half of
its lines have makes a template of its own. A field among the first DEPTH tokens,
or a word put in or left out, leads to another leaf: such lines stay.

Rows of equal doc_id and text are one document and share its fate; lines that
repeat within one document stay there. Null texts have no line and stay null;
empty texts stay empty. Lines end at ``\\n``; what stays is joined by it again.
Columns of any name stay as they are, but n_lines and n_dropped, which are replaced.

Lines travel as 64-bit hashes with their place, tokens as 32-bit hashes and only
within leaves of unlike lines. Counts have partial sums; joins read written
tables, so that Spark broadcasts one that is small and splits the keys of one that is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import let, packed, staged, unpacked

DEPTH, CONSTANT = 2, 0.75
#: A bitmap of leaves, 16 MB at most, and its pieces of 4 KB.
BITS, PIECE = 1 << 27, 1 << 15
#: Possessive, and from the start of a token only: linear in the text.
_FIELD = r"(?<!\\S)[^\\s0-9@]*+[0-9@]\\S*+"


def line_sql(line: str) -> str:
    """struct<n, leaf, h, w>: the line's tokens, its leaf, itself, and the tokens' hashes where a leaf may hold unlike lines."""
    # A single blank needs no regular expression, which Spark would compile for each line.
    tokens = lambda x: let("y", x, r"array_remove(if(y rlike '[\\t\\x0B\\f\\r]', split(y, '\\s+'), split(y, ' ')), '')")
    masked = let("m", tokens(f"regexp_replace({line}, '{_FIELD}', '<*>')"), f"if(size(filter(m, x -> x = '<*>')) > {1 - CONSTANT} * size(m), {tokens(line)}, m)")
    made = (
        f"named_struct('n', size(t), 'leaf', xxhash64(size(t), slice(t, 1, {DEPTH})), 'h', xxhash64(t), "
        f"'w', if(size(t) > {DEPTH}, transform(t, x -> hash(x)), null))"
    )
    return let("t", f"if({line} rlike '[0-9@]', {masked}, {tokens(line)})", made)


def _keyed(docs: DataFrame) -> DataFrame:
    """_doc: the whole row; _k, _row: which document it is."""
    k = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    return docs.select(packed(docs).alias("_doc"), k.alias("_k"), F.xxhash64(k, F.col("text")).alias("_row"), F.col("text").alias("_text"))


def mixed_leaves(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves that hold unlike lines, and ``lines`` with ``maybe``: whether their leaf may be one.

    ``maybe`` comes from a bitmap over BITS values of the leaf's hash, in pieces of PIECE bits: its
    size is bounded, so it is broadcast, and only the lines that it lets through are shuffled
    with their tokens. Joins with the leaves themselves follow.
    """
    mixed = staged(lines.where(f"n > {DEPTH}").groupBy("leaf").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low != high").select("leaf"))
    at = f"pmod(leaf, {BITS}L)"
    bitmaps = mixed.groupBy(F.expr(f"{at} div {PIECE}").alias("piece")).agg(F.expr(f"bitmap_construct_agg({at} % {PIECE})").alias("bits"))
    found = lines.join(F.broadcast(staged(bitmaps)), F.expr(f"{at} div {PIECE} = piece"), "left")
    byte = f"cast(conv(hex(substring(bits, cast({at} % {PIECE} div 8 as int) + 1, 1)), 16, 10) as int)"
    return mixed, found.withColumn("maybe", F.expr(f"n > {DEPTH} and bits is not null and shiftright({byte}, cast({at} % 8 as int)) & 1 = 1")).drop("piece", "bits")


def generalized(lines: DataFrame, mixed: DataFrame) -> DataFrame:
    """leaf, h and template of the lines (n, leaf, h, w) whose leaf is a mixed one, as far as their constant part is large enough."""
    unlike = staged(lines.join(mixed, "leaf").dropDuplicates(["leaf", "h"]).select("leaf", "h", "n", "w"))
    places = unlike.select("leaf", "h", "n", F.posexplode("w").alias("at", "token")).where("token != hash('<*>')")
    # A token of one line can't be of the constant part, so those needn't be joined.
    shared = staged(places.groupBy("leaf", "at", "token").agg(F.count("*").alias("lines")).where("lines > 1"))
    ranked = F.expr("sort_array(collect_list(struct(lines, xxhash64(at, token) as x)), false)").alias("c")
    kept = places.join(shared, ["leaf", "at", "token"]).groupBy("leaf", "h").agg(ranked, F.max("n").alias("n")).where(f"size(c) >= {CONSTANT} * n")
    constant = kept.select("leaf", "h", F.expr(f"transform(filter(c, e -> e.lines * 2 > c[cast(ceil({CONSTANT} * n) as int) - 1].lines), e -> e.x)").alias("xs"))
    return staged(constant.select("leaf", "h", F.expr("xxhash64(leaf, aggregate(xs, 0L, (a, x) -> a ^ x), size(xs))").alias("template")), unlike, shared)


def dropped_lines(docs: DataFrame) -> DataFrame:
    """_k, _row and ``_gone``, the sorted places of the lines that go, for each document that loses some."""
    lines = _keyed(docs).select("_k", "_row", F.expr("posexplode(split(_text, '\\n', -1))").alias("i", "line"))
    # Asked of the line and not of its tokens: Spark would move the filter down and part the line into tokens twice.
    lines = staged(lines.where(r"line rlike '\\S'").select("_k", "_row", "i", F.expr(line_sql("line")).alias("s")).select("_k", "_row", "i", "s.*"))
    mixed, told = mixed_leaves(lines)
    general = generalized(told.where("maybe"), mixed)
    told = told.select("_k", "_row", "i", "leaf", "h", "maybe")
    exact = told.where("not maybe").select("_k", "_row", "i", F.col("h").alias("template"))
    fielded = told.where("maybe").join(general, ["leaf", "h"], "left").select("_k", "_row", "i", F.coalesce("template", "h").alias("template"))
    told = staged(exact.unionByName(fielded), lines, mixed, general)
    who = F.struct("_k", "_row")
    known = told.groupBy("template").agg(F.min(who).alias("first"), F.max(who).alias("last")).where("first != last")
    known = staged(known.select("template", F.col("first._k").alias("first_k"), F.col("first._row").alias("first_row")))
    gone = told.join(known, "template").where("_k > first_k or (_k = first_k and _row > first_row)")
    return gone.groupBy("_k", "_row").agg(F.array_sort(F.collect_set("i")).alias("_gone"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines gone from ``text``, and n_lines and n_dropped besides."""
    gone = dropped_lines(docs)
    joined = _keyed(docs.drop("n_lines", "n_dropped")).join(gone, ["_k", "_row"], "left")
    kept = let("ls", r"split(_text, '\n', -1)", "array_join(transform(array_except(sequence(0, size(ls) - 1), _gone), i -> ls[i]), '\n')")
    return joined.select(
        *unpacked(docs.drop("n_lines", "n_dropped"), "_doc", {"text": F.expr(f"if(_gone is null, _text, {kept})")}),
        F.expr("coalesce(length(_text) - length(replace(_text, '\n', '')) + 1, 0)").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


#: The same rule for DuckDB, as the query's digest columns. It needs unique doc_ids.
SQL = rf"""WITH docs AS (SELECT coalesce(doc_id, -9223372036854775808) AS k, doc_id, text FROM documents),
lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs),
raw AS (SELECT k, i, line, list_filter(regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda x: x <> '') AS t FROM lines),
masked AS (SELECT k, i, t, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9@]') THEN '<*>' ELSE x END) AS m FROM raw WHERE len(t) > 0),
chosen AS (SELECT k, i, CASE WHEN len(list_filter(m, lambda x: x = '<*>')) > {1 - CONSTANT} * len(m) THEN t ELSE m END AS t FROM masked),
leaved AS (SELECT k, i, t, len(t) AS n, t[1:{DEPTH}] AS lead FROM chosen),
unlike AS (SELECT DISTINCT n, lead, t FROM leaved),
places AS (SELECT n, lead, t, unnest(t) AS token, unnest(range(len(t))) AS place FROM unlike),
shared AS (SELECT n, lead, place, token, count(*) AS lines FROM places WHERE token <> '<*>' GROUP BY ALL HAVING count(*) > 1),
ranked AS (SELECT p.n, p.lead, p.t, list({{'place': p.place, 'token': p.token, 'lines': s.lines}} ORDER BY p.place) AS c, list(s.lines ORDER BY s.lines DESC) AS counts
FROM places p JOIN shared s USING (n, lead, place, token) GROUP BY p.n, p.lead, p.t HAVING count(*) >= {CONSTANT} * p.n),
general AS (SELECT n, lead, t, to_json(list_transform(list_filter(c, lambda e: e.lines * 2 > counts[ceil({CONSTANT} * n)::INT]), lambda e: {{'place': e.place, 'token': e.token}})) AS template FROM ranked),
told AS (SELECT k, i, to_json([n::JSON, coalesce(template, to_json(t))]) AS template FROM leaved LEFT JOIN general USING (n, lead, t)),
known AS (SELECT template, min(k) AS first FROM told GROUP BY 1 HAVING min(k) < max(k)),
gone AS (SELECT k, list(DISTINCT i) AS gone FROM told JOIN known USING (template) WHERE k > first GROUP BY 1),
cut AS (SELECT doc_id, text, gone, string_split(text, chr(10)) AS ls FROM docs LEFT JOIN gone USING (k)),
kept AS (SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS n_lines, coalesce(len(gone), 0) AS n_dropped,
CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda j: NOT list_contains(gone, j - 1)), lambda j: ls[j]), chr(10)) END AS text FROM cut)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, length(text)::BIGINT AS n_chars_kept, sha256(text) AS text_sha256 FROM kept"""
