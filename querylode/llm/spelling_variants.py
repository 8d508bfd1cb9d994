"""Groups spelling variants: words one edit apart, the far more frequent neighbour that each word is a form of, and its root.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. They are found by dynamic
programming over sorted word lists. For each word of a list the later ones are scanned in order; the banded rows of the
edit matrix (only three diagonals can hold a cost of one) stay for the prefix that a word shares with the one before it, so
only its further letters are computed. Where all of a row exceeds one edit, all words with that prefix are skipped, by
binary search for the prefix's end.

Lists: one edit leaves the first half of a word or its other half as it is. So words meet in lists by the smaller of two
neighbouring lengths and by a shared half; a list of shared ends is scanned reversed. Where more than ``CROWD`` words share a
half, the part that may still differ is halved again, as often as needed; where one letter is left, a list holds at most
as many words as there are pairs of letters. So no task meets a whole vocabulary, and no pair of words that differ in
both halves meets at all.

Defined cases: null, empty and letterless texts have no word; a text counts whole, whatever its length; rows that repeat
count again; of equally frequent neighbours the first in code-point order is taken; a null doc_id is the empty text in the
planted edits' key; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylode.llm import common

LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
# More than the pairs of two letters of which a run can consist: so halving always ends.
CROWD = 20_000
_LAST = "\U0010ffff"


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, drop_every: int | None = None) -> DataFrame:
    """word, n: runs of letters with A-Z lower-cased, of enough code points and occurrences.

    With ``drop_every``, spelling errors are planted first: of a run whose crc32 of ``<doc_id>:<run>`` it divides, one letter
    goes.
    """
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Shorter runs can't become long enough.
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lowered, F.lit(f"{LETTERS}{{{min_chars},}}"), F.lit(0))).alias("word"))
    if drop_every:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        runs = runs.withColumn("__h", h)
        at = F.pmod(F.col("__h"), F.char_length("word")).cast("int")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
        runs = runs.select(F.when(F.pmod(F.col("__h"), F.lit(drop_every)) == 0, cut).otherwise(F.col("word")).alias("word"))
    counted = runs.where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def next_row(row: tuple[int, int, int], depth: int, letter: str, word: str) -> tuple[int, int, int]:
    """Costs of a prefix of depth + 1 letters against the word's prefixes one shorter, as long, one longer; 2 is too many."""
    size = len(word)
    less, same, more = row
    a = min(less + (depth < 1 or depth > size or letter != word[depth - 1]), same + 1) if depth <= size else 2
    b = min(same + (letter != word[depth]), more + 1, a + 1) if depth < size else 2
    c = min(more + (letter != word[depth + 1]), b + 1) if depth + 1 < size else 2
    return min(a, 2), min(b, 2), min(c, 2)


def near_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """The places of all pairs that are exactly one edit apart in a sorted list of distinct words."""
    n = len(words)
    shared = [0] * n
    for i in range(1, n):
        x, y, k = words[i - 1], words[i], 0
        for p, q in zip(x, y, strict=False):
            if p != q:
                break
            k += 1
        shared[i] = k
    for i, word in enumerate(words):
        # Rows of the word's own prefixes; they hold as far as a later word shares them.
        rows = [(2 if d == 0 else 1, 0, 1 if d < len(word) else 2) for d in range(len(word) + 1)]
        j = i + 1
        while j < n:
            other = words[j]
            depth = shared[j]
            del rows[depth + 1 :]
            row = rows[depth]
            while depth < len(other) and min(row) < 2:
                row = next_row(row, depth, other[depth], word)
                rows.append(row)
                depth += 1
            if min(row) >= 2:
                j = bisect_left(words, other[:depth] + _LAST, j + 1)
                continue
            k = len(word) - len(other) + 1
            if 0 <= k <= 2 and row[k] == 1:
                yield i, j
            j += 1


def lists(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """list, flipped, size, word: the lists in which near words meet; ``size`` is the smaller length of its pairs."""
    length = F.char_length("word")
    sized = words.select("word", F.explode(F.array(length, length - 1)).alias("size"))
    # A list's words share their first ``head`` and last ``tail`` letters.
    whole = sized.select("word", "size", F.lit(0).alias("head"), F.lit(0).alias("tail")).where("size >= 1")
    done = None
    while True:
        open_ = F.col("size") - F.col("head") - F.col("tail")
        half = F.floor(open_ / 2).cast("int")
        halves = F.array(
            F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
            F.struct(F.col("head").alias("head"), (F.col("tail") + open_ - half).alias("tail")),
        )
        parts = whole.select("word", "size", F.explode(halves).alias("h")).select("word", "size", "h.head", "h.tail")
        keyed = common.stored(parts.withColumn("list", _list_key()), "word-lists")
        left = F.col("size") - F.col("head") - F.col("tail")
        counts = keyed.groupBy("list").agg(F.count(F.lit(1)).alias("many"), F.max(left).alias("left"))
        crowded = common.stored(counts.where((F.col("many") > crowd) & (F.col("left") > 1)).select("list"), "crowded-lists")
        few = keyed.join(crowded, "list", "left_anti")
        done = few if done is None else done.unionByName(few)
        if crowded.isEmpty():
            flipped = (F.col("tail") > F.col("head")).alias("flipped")
            return done.select("list", flipped, "size", "word")
        whole = keyed.join(crowded, "list", "left_semi").select("word", "size", "head", "tail")


def _list_key():
    """64 bits of what a list's words share; lists that fall together by chance are one longer list."""
    size = F.char_length("word")
    tail = F.substring(F.col("word"), size - F.col("tail") + 1, F.col("tail"))
    return F.xxhash64("size", "head", "tail", F.substring(F.col("word"), F.lit(1), F.col("head")), tail)


def near(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: all pairs of words exactly one edit apart, each once, a < b."""
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, members = None, []
        for batch in batches:
            out = []
            for key, flipped, size, word in zip(*[batch.column(c).to_pylist() for c in ("list", "flipped", "size", "word")], strict=True):
                if (key, flipped, size) != own:
                    out += pairs(own, members)
                    own, members = (key, flipped, size), []
                members.append(word)
            yield table(out)
        yield table(pairs(own, members))

    def pairs(own, members: list[str]) -> list[tuple[str, str]]:
        if len(members) < 2:
            return []
        words = sorted(w[::-1] for w in members) if own[1] else sorted(members)
        found = []
        for i, j in near_pairs(words):
            if min(len(words[i]), len(words[j])) == own[2]:  # two longer ones meet in a list of their size
                x, y = (words[i][::-1], words[j][::-1]) if own[1] else (words[i], words[j])
                found.append((min(x, y), max(x, y)))
        return found

    def table(out: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in (0, 1)], ["a", "b"])

    dealt = lists(words, crowd).repartition(n, "list").sortWithinPartitions("list", "flipped", "size")
    return dealt.mapInArrow(run, "a string, b string").distinct()


def variants(words: DataFrame, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n): its form is its most frequent near word, if
    that is at least ``ratio`` times as frequent; its root is where the forms of forms end."""
    words = common.stored(words.select("word", "n"), "vocabulary")
    pairs = common.stored(near(words.select("word"), crowd), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    most = F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form")))
    around = both.join(of, "b").groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), most.alias("most"))
    joined = words.join(around, "word", "left")
    is_form = -F.col("most.less") >= ratio * F.col("n")
    formed = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("most.form")).alias("form"), F.when(is_form, -F.col("most.less")).cast("bigint").alias("form_n"),
    )
    formed = common.stored(formed, "word-forms")
    # Each round doubles the way; counts grow along it, so it ends.
    ends = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = common.stored(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "word-roots")
        if ends.where("moved").isEmpty():
            break
        ends = ends.select("word", "root")
    out = formed.join(ends.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
