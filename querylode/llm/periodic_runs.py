"""Periodic runs of words: stretches that repeat a block at least four times, and texts with each run's later copies removed.

A run is a stretch of consecutive words with smallest period p (words p apart are equal) and at least ``EXPONENT`` * p and
``LEAST_WORDS`` words, which no neighbouring word extends. For each octave of periods, S <= p < 2S, a text is cut into
overlapping tiles. Boundaries stand 2S words apart, so every run of the octave has one at or between its first word and
its last place that equals the word p later; a tile holds neighbouring boundaries and 4S words of context at most. Tiles
are solved independently of each other: at each boundary a Z-function to the right and one to the left tell how far words
p apart are equal, for all p at once, and of the p's divisors, which leaves out periods that are not the smallest. What is
cut off at 2S words goes on in the neighbour's fragment. Fragments that touch in a tile become one there, then fragments
are shuffled by document and period and stitched to runs.

Only boundaries near words in a dense chain of repeats get a tile: in a run every four words (but the last ones) come
again within p words, whatever the text. That is found with one sort for all octaves, exactly. Where four words come again
at one distance below S, on 4S words on both sides, no run of the octave has its smallest period, and no tile is made.

Texts without a tile have no run and are answered where they are read. The others' tiles are dealt over all tasks, so one
long text is solved by many. A row stands for itself only by a 128-bit hash of its text, so rows that repeat are solved
once. Defined cases: null, empty and blank texts have no word and no run; no run crosses rows; runs with the same start
come by period; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querylode.llm import common

EXPONENT = 4
LEAST_WORDS = 6
# Words of one tile, apart from its context, where the octave allows.
TILE = 4_096
RUN = "struct<start: bigint, length: bigint, period: bigint>"
_TILES = "key binary, octave int, offset bigint, boundaries binary, words binary"


def z_function(s: list, stop: int) -> list[int]:
    """For each i in 1 to ``stop`` how many items from i on equal those from the beginning."""
    n = len(s)
    z = [0] * min(n, stop)
    left = right = 0
    for i in range(1, len(z)):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@lru_cache(maxsize=1 << 16)
def parts_of(p: int) -> list[int]:
    """p divided by each of its prime factors."""
    return [p // f for f in prime_factors(p)]


def prime_factors(p: int) -> list[int]:
    out, f = [], 2
    while f * f <= p:
        if p % f == 0:
            out.append(f)
            while p % f == 0:
                p //= f
        f += 1
    return [*out, p] if p > 1 else out


class Gaps:
    """Where every four words of several texts, laid end to end, come again in their text, and how far from there."""

    def __init__(self, words: list[list[bytes]]):
        number = {w: i for i, w in enumerate(set().union(*words))} if words else {}
        self.ids = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64)
        self.ends = np.cumsum([len(w) for w in words])
        self.starts = np.r_[0, self.ends[:-1]] if len(words) else self.ends
        n = len(self.ids)
        self.at = self.gap = np.zeros(0, np.int64)
        if n < LEAST_WORDS:
            return
        _, pairs = np.unique(self.ids[:-1] * max(1, len(number)) + self.ids[1:], return_inverse=True)
        fours = pairs[:-2].astype(np.int64) * (int(pairs.max()) + 1) + pairs[2:]
        owner = np.repeat(np.arange(len(words)), np.diff(np.r_[0, self.ends]))
        inside = np.flatnonzero(owner[:-3] == owner[3:])
        order = inside[np.argsort(fours[inside], kind="stable")]
        again = (fours[order[1:]] == fours[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        gap = np.zeros(n, np.int64)
        gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
        self.at = np.flatnonzero(gap)
        self.gap = gap[self.at]
        # Stretches of places with one gap.
        new = np.flatnonzero(np.r_[True, (np.diff(self.at) != 1) | (np.diff(self.gap) != 0)][: len(self.at)])
        sizes = np.diff(np.r_[new, len(self.at)])
        self.first = np.repeat(self.at[new], sizes)
        self.last = self.first + np.repeat(sizes, sizes) - 1

    def boundaries(self, octave: int) -> tuple[np.ndarray, np.ndarray]:
        """Texts and places in them of the boundaries of an octave's tiles, in order."""
        s, step = 1 << octave, 2 << octave
        none = np.zeros(0, np.int64)
        near = self.at[self.gap < step]
        if not len(near):
            return none, none
        cuts = np.flatnonzero(np.diff(near) != 1)
        first, last = near[np.r_[0, cuts + 1]], near[np.r_[cuts, len(near) - 1]]
        long = last - first + 1 >= max(LEAST_WORDS - EXPONENT, (EXPONENT - 1) * s - 3)
        first, last = first[long], last[long]
        if not len(first):
            return none, none
        text = np.searchsorted(self.ends, first, side="right")
        begin, size = self.starts[text], self.ends[text] - self.starts[text]
        low = -((begin - first) // step)  # the first boundary at or after the chain's first place
        high = np.minimum(last + 4 - begin, size) // step
        many = np.maximum(high - low + 1, 0)
        text = np.repeat(text, many)
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        place = (np.repeat(low, many) + within) * step
        # No smallest period of the octave can be where a smaller gap holds all around.
        there = place + self.starts[text]
        k = np.minimum(np.searchsorted(self.at, there), len(self.at) - 1)
        smaller = (self.at[k] == there) & (self.gap[k] < s)
        smaller &= (there - self.first[k] >= EXPONENT * s) & (self.last[k] - there >= EXPONENT * s)
        # Neighbouring chains may name a boundary twice.
        once = np.unique(np.stack([text[~smaller], place[~smaller]]), axis=1)
        return once[0], once[1]

    def tiles(self) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(text, octave, offset, boundaries, words) of every tile; boundaries count from the tile's first word."""
        octave = 0
        longest = int((self.ends - self.starts).max()) if len(self.ends) else 0
        while EXPONENT << octave <= longest and len(self.at):
            step = 2 << octave
            text, place = self.boundaries(octave)
            if len(text):
                tile = place // max(TILE, 2 * EXPONENT << octave)
                cuts = np.flatnonzero(np.r_[True, (np.diff(text) != 0) | (np.diff(tile) != 0)])
                for a, b in zip(cuts, np.r_[cuts[1:], len(text)], strict=True):
                    t, own = int(text[a]), place[a:b]
                    low = max(0, int(own[0]) - step)
                    begin, end = int(self.starts[t]), int(self.ends[t])
                    high = min(end - begin, int(own[-1]) + 2 * step)
                    yield t, octave, low, own - low, self.ids[begin + low : begin + high]
            octave += 1


def solve(words: list[int], boundaries: list[int], octave: int) -> list[tuple[int, int, int]]:
    """(period, low, high) of the octave's fragments in a tile: places that equal the word a period later."""
    s, step = 1 << octave, 2 << octave
    found: dict[int, list[list[int]]] = {}
    for c in boundaries:
        to_right = words[c : c + 2 * step]
        to_left = words[max(0, c - step) : c][::-1]
        reach = min(step - 1, len(to_right))  # the largest period that has a word to compare
        if reach < s:
            continue
        right = z_function(to_right, reach + 1)
        right += [0] * (reach + 1 - len(right))
        # Place c - 1 - i against c - 1 - i + p: the reversed left part against the reversed words up to c + reach.
        back = [*to_left, -1, *words[c : c + reach][::-1], *to_left]
        zl, base = z_function(back, len(to_left) + 1 + reach), len(to_left) + 1 + reach
        for p in range(s, reach + 1):
            r, l = right[p], zl[base - p]
            if r + l < max(LEAST_WORDS - p, (EXPONENT - 1) * p) and r < step and l < step:
                continue
            if any(zl[base - d] >= l and right[d] >= r + p - d for d in parts_of(p)):
                continue  # a divisor is a period as well
            r = min(r, step)
            if r + l == 0:
                continue
            parts = found.setdefault(p, [])
            if parts and parts[-1][1] >= c - l:
                parts[-1][1] = max(parts[-1][1], c + r)
            else:
                parts.append([c - l, c + r])
    return [(p, a, b) for p, parts in found.items() for a, b in parts]


def text_key(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _split(docs: DataFrame, id_type: str) -> tuple[DataFrame, DataFrame]:
    """The rows without a tile, answered; and the tiles, with the texts that they are of."""

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, many in read(batches):
            has = np.zeros(len(many), dtype=bool)
            for t, *_ in Gaps(many).tiles():
                has[t] = True
            text = pa.array([b" ".join(w).decode() for w, h in zip(many, has, strict=True) if not h], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(~has)), text], ["doc_id", "text"])

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, many in read(batches):
            rows, keys = [], {}
            for t, octave, low, bounds, words in Gaps(many).tiles():
                if t not in keys:
                    keys[t] = text_key(b" ".join(many[t]))
                rows.append((keys[t], octave, low, bounds.astype("<i4").tobytes(), words.astype("<i4").tobytes()))
            at = sorted(keys)
            columns = list(zip(*rows, strict=True)) or [()] * 5
            # Texts and tiles in one table: a text's row has no octave.
            none = [None] * len(at)
            types = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            own = [[keys[t] for t in at], none, none, none, none]
            arrays = [pa.array([*o, *c], kind) for o, c, kind in zip(own, columns, types, strict=True)]
            ids = batch.column("doc_id").take(pa.array(at + [None] * len(rows), pa.int64()))
            texts = pa.array([b" ".join(many[t]).decode() for t in at] + [None] * len(rows), pa.string())
            yield pa.RecordBatch.from_arrays([ids, texts, *arrays], ["doc_id", "text", "key", "octave", "offset", "boundaries", "words"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                yield batch, [t.split() for t in common.texts(batch.column("text"))]

    rows = docs.select("doc_id", "text")
    schema = f"doc_id {id_type}, text string"
    return rows.mapInArrow(answered, schema), rows.mapInArrow(tiled, f"{schema}, {_TILES}")


def fragments(tiles: DataFrame) -> DataFrame:
    """key, period, low, high: what each tile holds, solved wherever it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                words, bounds = (np.frombuffer(r[c], "<i4").tolist() for c in ("words", "boundaries"))
                out += [(r["key"], p, a + r["offset"], b + r["offset"]) for p, a, b in solve(words, bounds, r["octave"])]
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "period", "low", "high"])

    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.select(*[c.split(" ")[0] for c in _TILES.split(", ")]).repartition(n, "key", "octave", "offset")
    return dealt.mapInArrow(run, "key binary, period bigint, low bigint, high bigint")


def stitched(parts: DataFrame) -> DataFrame:
    """key, start, length, period of the runs that fragments make."""
    of = Window.partitionBy("key", "period").orderBy("low", "high")
    before = F.max("high").over(of.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("low") > before).cast("int"), F.lit(0))
    pieces = parts.withColumn("__new", new).withColumn("__piece", F.sum("__new").over(of))
    whole = pieces.groupBy("key", "period", "__piece").agg(F.min("low").alias("start"), F.max("high").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    runs = whole.select("key", "start", length.alias("length"), "period")
    return runs.where(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), EXPONENT * F.col("period")))


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, runs (by start, then period; words count from 0) and collapsed: the words, joined by one space, that no run
    holds after its first period. One row for each row of ``docs``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    clean, tiled = _split(docs, id_type)
    tiled = common.stored(tiled, "period-tiles")
    runs = stitched(fragments(tiled.where("octave IS NOT NULL")))
    # At most a quarter of a text's words start a run.
    lists = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("found"))
    held = tiled.where("octave IS NULL").select("doc_id", "text", "key").join(lists, "key", "left")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                kept = []
                for text, found in zip(common.texts(batch.column("text")), batch.column("found").to_pylist(), strict=True):
                    words = text.split(b" ") if text else []
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    for r in found or []:
                        gone[r["start"] + r["period"]] += 1
                        gone[r["start"] + r["length"]] -= 1
                    stays = (np.cumsum(gone)[:-1] == 0).tolist()
                    kept.append(b" ".join([w for w, s in zip(words, stays, strict=True) if s]).decode())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("found"), pa.array(kept, pa.string())], ["doc_id", "found", "collapsed"])

    found_type = lists.schema["found"].dataType.simpleString()
    solved = held.select("doc_id", "found", "text").mapInArrow(drop, f"doc_id {id_type}, found {found_type}, collapsed string")
    found = F.coalesce("found", F.array().cast(found_type))
    in_order = F.transform(found, lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    none = F.array().cast(f"array<{RUN}>").alias("runs")
    return clean.select("doc_id", none, F.col("text").alias("collapsed")).unionByName(solved.select("doc_id", in_order.alias("runs"), "collapsed"))
