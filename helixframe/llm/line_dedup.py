"""Line dedup: exact repeats, and repeats within one word by a deletion neighbourhood.

A document's lines end at line feeds; a line's words are runs of other characters than
ASCII white space. Lines are ordered by document id, then by place. A line is dropped
if an earlier line has the same words or, where both have ``min_words`` or more, is one
word edit (a word put in, taken out or replaced) away. What counts is that the earlier
line stands in the input, not whether it is kept itself. Lines without words stay.

Near repeats, among the distinct lines (one row each, with the place of its first):

1. Of two lines one edit apart, the beginning or the end is the same, up to the half.
   Both become hashed keys; only lines that share one go on (no pair is lost).
2. Each of these emits its deletion variants as hashed keys: the line without word j,
   for each j that its shared end leaves open, and the line itself. A key is the
   exclusive-or of a hash of every word and its place, so running values over the words
   give all variants of a line in time proportional to its length.
3. Equal keys join. Lines with equal variants at the same j differ by a replaced word:
   the earliest of such a group is the witness of the others, by an aggregation. A line
   that equals another's variant lacks a word of it. No pairs are made within groups.
4. The witness's words are compared with the line's: the edit distance is 1 if their
   common beginning and end cover all but one word of the longer.

Built-in functions only. Hot lines, keys, variants and witnesses are aggregated map-side,
and their few rows are broadcast to those that look them up.

Defined results: null text has no lines and stays null; repeated rows: the later of
two equal lines of the same place is not told from it, so rows that repeat a document
id share one place, and neither is a repeat of the other; empty tables give no rows;
very long lines are handled whole. Rows with a null id take no part and stay whole.
Only the named columns are read; clean_documents() keeps all columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .common import dropped, spread_join, stored, table

#: Fewest words of lines that are compared with others by edits; 2 or more.
MIN_WORDS = 5


def plain(line: Column) -> Column:
    """The words of a line in which spaces() has been at work, with one space between."""
    text = F.trim(line)
    return F.when(F.contains(text, F.lit("  ")), F.array_join(F.filter(F.split(text, " "), lambda w: w != ""), " ")).otherwise(text)


def spaces(text: Column) -> Column:
    """White space other than line feeds as spaces; plain replacements and a split at
    one character are several times faster than a pattern.
    """
    for c in "\t\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def lines_of(docs: DataFrame, id_col: str, text_col: str, folded: bool = False) -> DataFrame:
    """doc and lines (an array) of every document with an id and a text; with spaces()
    done where ``folded``. Rows are chosen by the bare columns: what a filter asks of a
    computed one is computed again.
    """
    some = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    return some.select("doc", F.split(spaces(F.col("text")) if folded else F.col("text"), "\n", -1).alias("lines"))


def worded_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, line and t (its words with one space between) of every line with words. An
    outer generator, as to a plain one Spark adds filters that split every text again.
    """
    each = lines_of(docs, id_col, text_col, folded=True).select("doc", F.posexplode_outer("lines").alias("line", "text"))
    return each.filter(F.trim("text") != "").select("doc", F.col("line").cast("long").alias("line"), plain(F.col("text")).alias("t"))


def end_words(n: Column) -> Column:
    """How many words at either end every key of a line of ``n`` words holds at least."""
    size = F.call_function("shiftleft", F.lit(1), F.length(F.bin(n.cast("long"))) - 2)
    return F.when(n == 2 * size, F.floor(size / 2)).otherwise(size).cast("int")


def end_keys(line: Column, n: Column, min_words: int) -> Column:
    """Keys of the beginning and the end of a line of ``n`` words. Lines of 2^b to
    2^(b+1) - 1 words are keyed by 2^(b-1) words at either end, a half to a quarter of
    them: one edit leaves one of the two as it is. A line of just 2^b words is also keyed
    as those below, as it may be one of them with a word more. Words are found by their
    spaces, without splitting the line.
    """
    b = F.length(F.bin(n.cast("long"))) - 1
    size = F.call_function("shiftleft", F.lit(1), b - 1)

    def of(bucket: Column, some: Column) -> list[Column]:
        cut = lambda count: F.call_function("substring_index", line, F.lit(" "), count)
        return [F.xxhash64(F.lit(0), bucket, cut(some)), F.xxhash64(F.lit(1), bucket, cut(-some))]

    below = (n == 2 * size) & (n > min_words)
    return F.when(below, F.array(*of(b, size), *of(b - 1, F.floor(size / 2).cast("int")))).otherwise(F.array(*of(b, size)))


def running_xor(values: Column, start: Column) -> Column:
    """``start`` and its exclusive-or with the first, the first two, ... and all values.
    Long arrays are taken by blocks, so that they are not copied for each value.
    """

    def run(some: Column, first: Column) -> Column:
        return F.aggregate(some, F.array(first), lambda acc, x: F.array_append(acc, F.element_at(acc, -1).bitwiseXOR(x)))

    zero = F.lit(0).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / 256).cast("int") - 1), lambda b: F.slice(values, b * 256 + 1, 256))
    starts = run(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a.bitwiseXOR(x))), start)
    each = F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda b, s: F.slice(run(b, s), 2, F.size(b))))
    return F.when(F.size(values) <= 256, run(values, start)).otherwise(F.concat(F.array(start), each))


def variants(lines: DataFrame) -> DataFrame:
    """r, at (from 0) and key of each line without word ``at``, for the places from lo
    to before hi. ``lines``: r, words, lo, hi. Nothing crosses the network for it.
    """
    n = F.size("words")
    here = F.transform("words", lambda w, i: F.xxhash64(i, w))
    moved = F.transform("words", lambda w, i: F.xxhash64(i - 1, w))
    all_moved = F.aggregate(moved, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))
    # Words before the place as they are, and words after it one place to the left.
    before, after = F.slice(running_xor(here, F.lit(0).cast("long")), 1, n), F.slice(running_xor(moved, all_moved), 2, n)
    keys = F.zip_with(before, after, lambda a, b: a.bitwiseXOR(b))
    return lines.select("r", "lo", "hi", F.posexplode(keys).alias("at", "key")).filter("at >= lo AND at < hi").select("r", "at", "key")


def whole_keys(lines: DataFrame) -> DataFrame:
    """r and key of each line as it is; equal to that of a variant with its words."""
    own = F.aggregate(F.transform("words", lambda w, i: F.xxhash64(i, w)), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))
    return lines.select("r", own.alias("key"))


def witnesses(lines: DataFrame) -> DataFrame:
    """r and w (less than r): for each line the least that replaces a word of it, that
    lacks one, and that has one more, as far as there are any.
    """
    emitted = stored(variants(lines), "line-variants")
    # Equal variants at the same place: all of such a group are one word apart, so its
    # least stands for it, combined before the shuffle.
    groups = emitted.groupBy("key", "at").agg(F.min("r").alias("w"), F.max("r").alias("most"), F.count("*").alias("n")).filter("w < most").select("key", "at", "w", "n")
    replaced = spread_join(emitted, groups, ["key", "at"], "n", emitted.count()).filter("r > w").select("r", "w")
    # A variant that is a line: at most one line has its words.
    longer = emitted.select("key", F.col("r").alias("more")).join(whole_keys(lines).withColumnRenamed("r", "less"), "key")
    lacks = longer.filter("less < more").select(F.col("more").alias("r"), F.col("less").alias("w"))
    has = longer.filter("more < less").groupBy(F.col("less").alias("r")).agg(F.min("more").alias("w"))
    found = stored(replaced.unionByName(lacks).unionByName(has).distinct(), "line-witnesses")
    dropped(lines.sparkSession, emitted)
    return found


def one_edit(a: Column, b: Column) -> Column:
    """Are two different word arrays one edit apart? ``a`` is not the shorter."""
    n, m = F.size(a), F.size(b)

    def common(place: Callable[[Column, Column], Column]) -> Column:
        # Place of the first difference: the words that are equal up to it.
        differ = F.filter(F.sequence(F.lit(0), m - 1), lambda i: ~F.get(a, place(n, i)).eqNullSafe(F.get(b, place(m, i))))
        return F.coalesce(F.array_min(differ), m)

    return (n - m <= 1) & (common(lambda _, i: i) + common(lambda size, i: size - 1 - i) >= n - 1)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each dropped line: doc, line, first_doc, first_line (the place of the
    earlier line, which has the same words or is an edit away) and edits (0 or 1).
    """
    place = F.struct("doc", "line")
    each = worded_lines(docs, id_col, text_col)
    each = each.withColumn("n", F.octet_length("t") - F.octet_length(F.replace("t", F.lit(" "), F.lit(""))) + 1)
    rows = each.select("doc", "line", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), F.when(F.col("n") >= min_words, end_keys(F.col("t"), F.col("n"), min_words)).alias("keys"))
    rows = stored(rows, "lines")
    exact = ["h1", "h2"]
    first = stored(rows.groupBy(*exact).agg(F.min(place).alias("first"), F.count("*").alias("copies"), F.first("keys").alias("keys")), "distinct-lines")
    keyed = first.filter("keys IS NOT NULL").select("h1", F.posexplode("keys").alias("side", "k"))
    shared = keyed.groupBy("k").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.count("*").alias("n")).filter("a != b").select("k", "n")
    copies, distinct = first.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    # Which of its ends a line shares: where it is only one, the edit is beyond it.
    some = spread_join(keyed, shared, ["k"], "n", distinct).groupBy("h1").agg(F.max(F.col("side") % 2 == 0).alias("head"), F.max(F.col("side") % 2 == 1).alias("tail"))
    wanted = first.join(some, "h1").select("first.doc", F.struct("first.line", *exact, "head", "tail").alias("c")).groupBy("doc").agg(F.collect_list("c").alias("wanted"))
    # Whole documents cross to their candidates, not single lines: fewer and larger rows.
    texts = lines_of(docs, id_col, text_col).join(wanted, "doc")
    texts = texts.select("doc", F.explode_outer(F.transform("wanted", lambda c: F.struct(c.alias("c"), F.get("lines", c["line"].cast("int")).alias("text")))).alias("x"))
    texts = texts.select("doc", "x.c.*", "x.text").withColumn("text", spaces(F.col("text"))).withColumn("t", plain(F.col("text"))).drop("text")
    # Rows that repeat a document id may share a place: the hashes tell their lines.
    same = (F.xxhash64("t") == F.col("h1")) & (F.xxhash64(F.lit(1), "t") == F.col("h2"))
    texts = texts.groupBy(*exact, "doc", "line", "head", "tail").agg(F.max(F.when(same, F.col("t"))).alias("t")).filter("t IS NOT NULL")
    texts = texts.withColumn("words", F.split("t", " ")).drop("t")
    n, kept = F.size("words"), end_words(F.size("words"))
    texts = texts.withColumn("lo", F.when(F.col("tail"), 0).otherwise(kept)).withColumn("hi", F.when(F.col("head"), n).otherwise(n - kept)).drop("head", "tail")
    lines = stored(numbered(texts, ["doc", "line", *exact], "r"), "line-texts")
    near = witnesses(lines.select("r", "words", "lo", "hi"))
    a, b = lines.select("r", *exact, place.alias("own"), "words"), lines.select(F.col("r").alias("w"), place.alias("earlier"), F.col("words").alias("witness"))
    b = b.join(near.groupBy("w").agg(F.count("*").alias("n")), "w")
    checked = spread_join(near, b, ["w"], "n", near.count()).join(a, "r").filter("earlier < own")
    longer = F.size("words") >= F.size("witness")
    right = F.when(longer, one_edit(F.col("words"), F.col("witness"))).otherwise(one_edit(F.col("witness"), F.col("words")))
    near = checked.filter(right).groupBy(*exact).agg(F.min("earlier").alias("w"))
    # Every copy of a line that has an earlier neighbour goes; else all but the first.
    known = first.select(*exact, "first", "copies").join(near, exact, "left").filter("copies > 1 OR w IS NOT NULL")
    gone = spread_join(rows.select("doc", "line", *exact), known.withColumn("size", F.col("copies")), exact, "size", copies).filter((place > F.col("first")) | F.col("w").isNotNull())
    origin = F.least("first", F.coalesce("w", "first"))
    return gone.select("doc", "line", origin["doc"].alias("first_doc"), origin["line"].alias("first_line"), (origin != F.col("first")).cast("int").alias("edits")).distinct()


def clean_documents(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines of ``gone`` (as repeats() gives them). Documents that
    lose all their lines with words go; others keep every column, with the text that
    is left. ``gone`` has a row for each line; its longest list is that of a document.
    """
    lists = gone.groupBy(F.col("doc").alias("_hf_doc")).agg(F.collect_set(F.col("line").cast("int")).alias("_hf_gone"))
    # Whole rows in one column: no name of a caller's column can clash.
    joined = docs.select(F.struct("*").alias("_hf_row")).join(lists, F.col("_hf_row")[id_col] == F.col("_hf_doc"), "left")
    old = F.col("_hf_row")[text_col]

    def rest(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_hf_gone")
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    # A function over an array of one binds the lines: a split in the innermost function
    # would be done for each line. An outer generator, as in worded_lines().
    text = F.when(F.col("_hf_gone").isNull(), old).otherwise(F.get(F.transform(F.array(F.split(old, "\n", -1)), rest), F.lit(0)))
    some = joined.select("_hf_row", "_hf_gone", F.explode_outer(F.array(text)).alias("_hf_text"))
    kept = some.filter(F.col("_hf_gone").isNull() | F.rlike("_hf_text", F.lit("[^ \\t\\n\\x0B\\f\\r]")))
    return kept.select(*[F.col("_hf_text").alias(text_col) if c == text_col else F.col("_hf_row")[c].alias(c) for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line, first_doc_id, first_line and edits of every dropped line."""
    gone = repeats(table(spark, sf_dir, "documents"))
    return gone.select(F.col("doc").alias("doc_id"), "line", F.col("first_doc").alias("first_doc_id"), "first_line", "edits")


OP10_SQL = r"""
WITH lines AS (
  SELECT d.doc_id AS doc, u.i - 1 AS line, list_filter(regexp_split_to_array(string_split(d.text, chr(10))[u.i], '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words
  FROM documents d, unnest(range(1, len(string_split(d.text, chr(10))) + 1)) AS u(i)
  WHERE d.doc_id IS NOT NULL
), worded AS (SELECT doc, line, words, {'doc': doc, 'line': line} AS place FROM lines WHERE len(words) > 0),
firsts AS (SELECT words, min(place) AS first, len(words) AS n FROM worded GROUP BY words),
roles AS (SELECT words, first, n, unnest([n, n - 1]) AS r FROM firsts WHERE n >= 5),
keys AS (
  SELECT words, first, r, 0 AS side, words[1:r // 2] AS part FROM roles
  UNION ALL
  SELECT words, first, r, 1, words[n - (r - r // 2) + 1:n] FROM roles
), pairs AS (
  SELECT DISTINCT a.words AS words, b.words AS other, a.first AS first, b.first AS w
  FROM keys a JOIN keys b USING (r, side, part)
  WHERE b.first < a.first AND abs(len(a.words) - len(b.words)) <= 1
), ordered AS (
  SELECT *, CASE WHEN len(words) >= len(other) THEN words ELSE other END AS x, CASE WHEN len(words) >= len(other) THEN other ELSE words END AS y FROM pairs
), near AS (
  SELECT words, min(w) AS w FROM (
    SELECT words, w, len(x) AS n, len(y) AS m,
           coalesce(list_min(list_filter(range(1, len(y) + 1), lambda i: x[i] <> y[i])) - 1, len(y)) AS head,
           coalesce(list_min(list_filter(range(1, len(y) + 1), lambda i: x[len(x) + 1 - i] <> y[len(y) + 1 - i])) - 1, len(y)) AS tail
    FROM ordered
  ) WHERE head + tail >= n - 1 GROUP BY words
)
SELECT l.doc AS doc_id, l.line, o.first.doc AS first_doc_id, o.first.line AS first_line, CAST(o.first <> o.own AS INTEGER) AS edits
FROM worded l JOIN (
  SELECT f.words, f.first AS own, least(f.first, coalesce(near.w, f.first)) AS first, near.w IS NOT NULL AS has FROM firsts f LEFT JOIN near USING (words)
) o USING (words)
WHERE l.place > o.own OR o.has
"""
