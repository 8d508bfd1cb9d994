"""Quality rules: repetition counts of a text, and lines that several documents of a host share. Columns only.

A line is normalised (no white space at its ends, lower case, each run of digits as one 0) and hashed. For every
host, here ``source``, the distinct documents that hold a line are counted. A line found in at least ``at_docs`` documents
is removed as boilerplate, however many documents the host has. A document that keeps less than ``min_left`` of the
characters of its lines is depleted: rejected. Copies are documents as well, so of ``at_docs`` copies in one host none stays;
near-duplicate operators decide which copy to keep, before this one.

No text is shuffled for the verdict: lines travel as hashes. They are brought to one row for each line of a distinct text
and written once, then counted (a text as often as it has copies), and the removed ones are joined back to these rows and
summed up by text.

Defined cases: null and empty texts have no word and fail the base rule; a null source is a host of its own; rows
that repeat in all of doc_id, source and text count once and each get the verdict, rows without an id are one document;
a line exactly at the limit goes; texts of any length are counted whole; an empty table gives no rows; hashes have
64 bits. Other columns stay in ``clean`` alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylode.llm import common

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
AT_DOCS = 5
MIN_LEFT = 0.3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(common.SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, common.SPACE + "+"))


def repeated_words(hashes: Column) -> Column:
    """How many words lie in a window of ``WINDOW`` words that the text holds twice or more."""
    size = F.size(hashes)
    at = lambda i, k: F.get(hashes, i + k)
    windows = F.when(size < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    )

    def starts(ordered: Column) -> Column:
        n = F.size(ordered)
        same = lambda x, k: F.coalesce((F.get(ordered, k)["h"] == x["h"]), F.lit(False))
        twice = F.filter(ordered, lambda x, k: ((k > 0) & same(x, k - 1)) | ((k < n - 1) & same(x, k + 1)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(begin: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")
        )
        return F.aggregate(begin, zero, step, lambda acc: acc["n"])

    def count(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(ordered, lambda o: covered(starts(o)))
        )

    return let(windows, count)


def base(docs: DataFrame) -> DataFrame:
    """doc_id, source, key, line_chars, the base counts and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = let(
        F.transform(words(text), lambda w: F.xxhash64(w)),
        lambda h: F.struct(F.size(h).alias("n_words"), repeated_words(h).alias("n_repeat_words")),
    )
    with_word = F.filter(F.split(text, "\n"), lambda line: line.rlike(common.WORD))
    dup_lines = let(with_word, lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))
    out = docs.select(
        "doc_id",
        "source",
        text_key(text).alias("key"),
        counted.alias("c"),
        (F.char_length(text) - F.regexp_count(text, F.lit(common.SPACE))).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        dup_lines.cast("bigint").alias("n_dup_lines"),
        line_chars(text).alias("line_chars"),
    )
    n, repeats = F.col("c.n_words").cast("bigint"), F.col("c.n_repeat_words").cast("bigint")
    return out.select(
        "doc_id", "source", "key", "line_chars", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        repeats.alias("n_repeat_words"), ((n < 10) | (100 * repeats > 20 * n)).alias("base_failed"),
    )


def line_chars(text: Column) -> Column:
    return (F.char_length(text) - F.regexp_count(text, F.lit("\n"))).cast("bigint")


def line_key(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def text_key(text: Column) -> Column:
    return F.xxhash64(text, F.char_length(text))


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(line, F.lit(common.SPACE_CHARS))), "[0-9]+", "0")


def boilerplate(docs: DataFrame, at_docs: int = AT_DOCS) -> DataFrame:
    """source, key, removed (hashes of the lines over a limit) and removed_chars of the texts that lose lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("source", text_key(text).alias("key"), F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(
        "source", "key", "pos", line_key(F.col("line")).alias("line"), F.char_length("line").alias("chars")
    )
    once = lines.groupBy("source", "key", "pos").agg(F.first("line").alias("line"), F.first("chars").alias("chars"))
    # One row for each line of a text, however many copies the text has and however often it repeats the line.
    texts = common.stored(once.groupBy("source", "key", "line").agg(F.sum("chars").alias("chars")), "text-lines")
    named = docs.select(F.col("source").alias("__s"), text_key(text).alias("__k"), "doc_id").distinct()
    copies = named.groupBy("__s", "__k").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    same_text = F.col("source").eqNullSafe(F.col("__s")) & (F.col("key") == F.col("__k"))
    held = (
        texts.where(F.col("line") != F.xxhash64(F.lit("")))
        .join(copies, same_text, "left")
        .groupBy("source", "line")
        .agg(F.sum(F.coalesce("copies", F.lit(1))).alias("n"))
    )
    over = held.where(F.col("n") >= at_docs).select(F.col("source").alias("__s"), F.col("line").alias("__l"))
    # Written first: a join of two plain exchanges can be split where very many texts hold one line.
    over = common.stored(over, "shared-lines")
    return (
        texts.join(over, F.col("source").eqNullSafe(F.col("__s")) & (F.col("line") == F.col("__l")))
        .groupBy("source", "key")
        .agg(F.collect_set("line").alias("removed"), F.sum("chars").alias("removed_chars"))
    )


def verdicts(docs: DataFrame, at_docs: int = AT_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """doc_id, the base counts, base_failed, removed_chars and kept, one row for each row of ``docs``."""
    lost = boilerplate(docs, at_docs).select(
        F.col("source").alias("__s"), F.col("key").alias("__k"), "removed_chars"
    )
    joined = base(docs).join(lost, F.col("source").eqNullSafe(F.col("__s")) & (F.col("key") == F.col("__k")), "left")
    removed = F.coalesce("removed_chars", F.lit(0)).cast("bigint")
    depleted = (removed > 0) & (F.col("line_chars") - removed < min_left * F.col("line_chars"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"), removed.alias("removed_chars"),
    )


def clean(docs: DataFrame, at_docs: int = AT_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that are not depleted, without their boilerplate lines; all columns stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lost = boilerplate(docs, at_docs).select(
        F.col("source").alias("__s"), F.col("key").alias("__k"), F.col("removed").alias("__removed"), F.col("removed_chars").alias("__chars")
    )
    joined = docs.join(lost, F.col("source").eqNullSafe(F.col("__s")) & (text_key(text) == F.col("__k")), "left")
    left = F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(F.col("__removed"), line_key(line)))
    all_chars = line_chars(text)
    kept = F.col("__removed").isNull() | (all_chars - F.col("__chars") >= min_left * all_chars)
    cleaned = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.where(kept).withColumn("text", cleaned).select(*docs.columns)
