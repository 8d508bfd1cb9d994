"""Removal of every byte that a repeated string of ``LENGTH`` bytes covers, by sparse suffix sorting.

Positions: any ``LENGTH`` bytes hold an anchor, the leftmost position whose ``SEED`` bytes have the smallest hash, so
equal strings have anchors at equal places. Prefix polynomial hashes give the hash of any substring in constant time.
What can be around an anchor in a repeated string is its context: up to LENGTH - SEED bytes before it and LENGTH from it on.

1. Anchors are counted by seed. A seed that occurs once repeats nothing. If all contexts of a seed are equal, they are
   repeated as a whole: no bytes need to meet. Contexts are equal if two unrelated hashes are: the polynomial one of the
   seed, and XXH3 of all their bytes, so texts made to have equal polynomial hashes are told apart.
2. Of seeds with different contexts, each distinct context is taken once, with its bytes. Contexts of a seed are sorted as
   suffixes from the anchor on: a bottom-up mergesort over all seeds of a batch, in which two suffixes are compared
   by the binary search of their common extension over prefix hashes. Suffixes that share t bytes are neighbours in
   that order; among them, equal hashes of the s = LENGTH - t bytes before the anchor are repeated strings. Since they all hold
   the anchor, the least and the largest such s give the covered bytes. Both are verified byte by byte; if that or
   the order fails, the seed is solved by plain comparison.
3. Seeds with more than ``CROWD`` different contexts (a passage that very many documents share) are not brought into one
   task: each of their strings becomes a 128-bit hash, and Spark counts these.

Covered spans go back to the documents of all equal contexts. Null texts are empty; texts shorter than LENGTH keep all;
rows that repeat are documents of their own, so all of a long text that occurs twice goes; a text of any length is
worked through in overlapping parts; hashes of seeds and of contexts have 64 bits each; an empty table gives no rows. Extra
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylode.llm import common

LENGTH = 200
SEED = 64
CROWD = 20_000
# Bytes of text that are hashed at once, and contexts that are sorted at once.
AT_ONCE = 1 << 20
CONTEXTS_AT_ONCE = 20_000
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as long as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 16)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up = np.cumprod(np.r_[_U(1), np.full(size, _U(_BASE))])
            self.down = np.cumprod(np.r_[_U(1), np.full(size, _U(inverse))])
        return self.up, self.down


class Hashes:
    """Prefix polynomial hashes of a byte array: ``of(i, j)`` is the hash of bytes i to j, wherever they stand."""

    def __init__(self, data: np.ndarray, powers: Powers):
        up, self.down = powers(len(data))
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[data] * up[: len(data)], out=self.prefix[1:])

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.prefix[j] - self.prefix[i]) * self.down[i]


def _least_places(order: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the smallest of order[i : i + width], the leftmost of equals."""
    n = len(order)
    bits = _U(max(1, (n - 1).bit_length()))
    packed = (order >> bits << bits) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[:n] = packed
    grid = padded.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: n - width + 1], before[width - 1 : n])
    return (least & ((_U(1) << bits) - _U(1))).astype(np.int64)


def anchors(text: np.ndarray, ends: np.ndarray, first: int, powers: Powers, length: int, seed: int, stop: int | None = None):
    """Places, seed hashes and context hashes of the anchors of texts that lie end to end; ``ends`` are their ends.

    ``first`` is the first start of a string, and starts are below ``stop``; a text's parts around them are only context.
    """
    width = length - seed + 1
    if len(text) < length:
        return (np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 2)
    h = Hashes(text, powers)
    at = np.arange(len(text) - seed + 1)
    seeds = _mix(h.of(at, at + seed))
    places = _least_places(seeds, width)  # by start of a string
    starts = np.r_[0, ends[:-1]]
    valid = np.zeros(len(text) + 1, dtype=np.int32)
    full = ends - starts >= length
    np.add.at(valid, np.maximum(starts[full], first), 1)
    past = ends[full] - length + 1
    np.add.at(valid, past if stop is None else np.minimum(past, stop), -1)
    chosen = np.zeros(len(text), dtype=bool)
    chosen[places[np.cumsum(valid)[: len(places)] > 0]] = True
    p = np.flatnonzero(chosen)
    of = np.searchsorted(ends, p, side="right")
    left = np.minimum(width - 1, p - starts[of])
    right = np.minimum(length, ends[of] - p)
    return p, seeds[p], context_hashes(text.tobytes(), p, left, right)


def context_hashes(text: bytes, p: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of each context's bytes and of where the anchor is in them, unrelated to the polynomial hashes."""
    spans = zip((p - left).tolist(), (p + right).tolist(), left.tolist(), strict=True)
    return np.fromiter((xxhash.xxh3_64_intdigest(text[a:b], seed=k) for a, b, k in spans), np.uint64, len(p))


def _parts(text: bytes, length: int, seed: int):
    """A long text as (offset, bytes, first start of a string) with all the context that anchors need."""
    margin = length - seed
    for c in range(0, max(1, len(text) - length + 1), AT_ONCE):
        low = max(0, c - margin)
        yield low, text[low : c + AT_ONCE + margin + length], c - low


def anchor_rows(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """doc_id, at (31 bits of the text's hash, then the place), seed and context, a row for each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for whole in batches:
            for batch in common.slices(whole, "text", AT_ONCE):
                many = common.texts(batch.column("text"))
                if len(many) == 1 and len(many[0]) > AT_ONCE:
                    found = []
                    for low, part, first in _parts(many[0], length, seed):
                        data = np.frombuffer(part, dtype=np.uint8)
                        # Later strings are the next part's: here their anchors' contexts may be cut off.
                        p, s, c = anchors(data, np.array([len(data)]), first, powers, length, seed, first + AT_ONCE)
                        found.append((p + low, s, c))
                    place, s, c = (np.concatenate(x) for x in zip(*found, strict=True))
                    place, once = np.unique(place, return_index=True)
                    own, s, c = np.zeros(len(place), np.int64), s[once], c[once]
                else:
                    data = np.frombuffer(b"".join(many), dtype=np.uint8)
                    ends = np.cumsum([len(t) for t in many])
                    p, s, c = anchors(data, ends, 0, powers, length, seed)
                    own = np.searchsorted(ends, p, side="right")
                    place = p - np.r_[0, ends][own]
                of_text = np.array([text_hash(t) for t in many], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(own)),
                        pa.array(of_text[own] << 32 | place),
                        pa.array(s.astype(np.int64)),
                        pa.array(c.astype(np.int64)),
                    ],
                    ["doc_id", "at", "seed", "context"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, at bigint, seed bigint, context bigint")


def text_hash(text: bytes) -> int:
    """31 bits that tell rows with the same doc_id apart."""
    return xxhash.xxh32_intdigest(text) & 0x7FFFFFFF


class Sorter:
    """Contexts of seeds, sorted by seed and by the bytes from the anchor on."""

    def __init__(self, contexts: list[bytes], lefts: np.ndarray, groups: np.ndarray, powers: Powers, length: int):
        self.length = length
        sizes = np.array([len(c) for c in contexts])
        self.data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
        self.hashes = Hashes(self.data, powers)
        self.begin = np.r_[0, np.cumsum(sizes)[:-1]]
        self.anchor = self.begin + lefts
        self.left, self.right = lefts, sizes - lefts
        self.groups = groups
        self.order, self.common = self._sort()

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The common extension of the suffixes of two contexts, by binary search over prefix hashes."""
        a, b = self.anchor[i], self.anchor[j]
        low, high = np.zeros(len(i), np.int64), np.minimum(self.right[i], self.right[j])
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) >> 1
            same = self.hashes.of(a, a + middle) == self.hashes.of(b, b + middle)
            low, high = np.where(same & open_, middle, low), np.where(same | ~open_, high, middle - 1)

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before suffix j; equal ones and beginnings of others come by their number."""
        e = self.extension(i, j)
        i_ends, j_ends = e == self.right[i], e == self.right[j]
        last = len(self.data) - 1
        x = self.data[np.minimum(self.anchor[i] + e, last)].astype(np.int64)
        y = self.data[np.minimum(self.anchor[j] + e, last)].astype(np.int64)
        x, y = np.where(i_ends, -1, x), np.where(j_ends, -1, y)
        return np.where(x == y, i < j, x < y)

    def _sort(self) -> tuple[np.ndarray, np.ndarray]:
        """Merge runs of 1, 2, 4, ... contexts within every group; each one finds its place in the other run."""
        n = len(self.groups)
        order = np.argsort(self.groups, kind="stable")
        g = self.groups[order]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        sizes = np.diff(np.r_[starts, n])
        start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        within = np.arange(n) - start
        run = 1
        while run < sizes.max(initial=0):
            own = within // run
            other = start + (own ^ 1) * run
            other_end = np.minimum(other + run, start + size)
            merging = np.flatnonzero(other < start + size)
            low, high = other[merging], other_end[merging]
            me = order[merging]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                less = self.before(order[middle], me[open_])
                low[open_] = np.where(less, middle + 1, low[open_])
                high[open_] = np.where(less, high[open_], middle)
            pair = start[merging] + (own[merging] >> 1) * 2 * run
            place = pair + (within[merging] - own[merging] * run) + (low - other[merging])
            new = order.copy()
            new[place] = me
            order = new
            run *= 2
        same = g[1:] == g[:-1]
        shared = np.zeros(n, np.int64)  # with the one before, in the order
        at = np.flatnonzero(same) + 1
        shared[at] = self.extension(order[at - 1], order[at])
        shared[np.flatnonzero(~same) + 1] = -1
        if n:
            shared[0] = -1
        return order, shared

    def covered(self) -> tuple[np.ndarray, np.ndarray]:
        """For each context how far repeated strings reach before the anchor and from it on; -1 where none."""
        n, length = len(self.groups), self.length
        order, far, near = self.order, np.full(len(self.groups), -1), np.full(len(self.groups), -1)
        far_with, near_with = far.copy(), near.copy()
        anchor, left, right = self.anchor[order], self.left[order], self.right[order]
        for s in range(int(left.max(initial=-1)) + 1):
            run = np.cumsum(self.common < length - s)
            at = np.flatnonzero((left >= s) & (right >= length - s))
            if len(at) < 2:
                continue
            key = _mix(self.hashes.of(anchor[at] - s, anchor[at])) + run[at].astype(np.uint64) * _U(_BASE)
            by = np.argsort(key, kind="stable")
            same = np.flatnonzero(key[by][1:] == key[by][:-1])
            for one, two in ((same, same + 1), (same + 1, same)):
                i, j = order[at[by[one]]], order[at[by[two]]]
                new = near[i] < 0
                near[i[new]], near_with[i[new]] = s, j[new]
                far[i], far_with[i] = s, j
        found = np.flatnonzero(far >= 0)
        wrong = self._differ(found, far_with[found], far[found]) | self._differ(found, near_with[found], near[found])
        bad = np.union1d(np.unique(self.groups[found[wrong]]), self._unsorted())
        for group in bad:
            self._plain(np.flatnonzero(self.groups == group), far, near)
        return far, np.where(near >= 0, length - near, -1)

    def _differ(self, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Whether the strings from s bytes before the anchors differ, byte by byte."""
        out = np.zeros(len(i), dtype=bool)
        for a in range(0, len(i), 10_000):
            part = slice(a, a + 10_000)
            reach = np.arange(self.length)
            x = self.data[(self.anchor[i[part]] - s[part])[:, None] + reach]
            y = self.data[(self.anchor[j[part]] - s[part])[:, None] + reach]
            out[part] = (x != y).any(axis=1)
        return out

    def _unsorted(self) -> np.ndarray:
        """Groups in which neighbours don't share what the hashes say."""
        at = np.flatnonzero(self.common > 0)
        bad = []
        for a in range(0, len(at), 10_000):
            part = at[a : a + 10_000]
            i, j, e = self.order[part - 1], self.order[part], self.common[part]
            reach = np.arange(int(e.max()))
            last = len(self.data) - 1
            x = self.data[np.minimum(self.anchor[i][:, None] + reach, last)]
            y = self.data[np.minimum(self.anchor[j][:, None] + reach, last)]
            bad.append(self.groups[j[((x != y) & (reach < e[:, None])).any(axis=1)]])
        return np.unique(np.concatenate(bad)) if bad else np.zeros(0, self.groups.dtype)

    def _plain(self, members: np.ndarray, far: np.ndarray, near: np.ndarray) -> None:
        far[members] = near[members] = -1
        seen: dict[tuple[int, bytes], list[int]] = {}
        for i in members.tolist():
            for s in range(max(0, self.length - int(self.right[i])), int(self.left[i]) + 1):
                a = int(self.anchor[i]) - s
                seen.setdefault((s, self.data[a : a + self.length].tobytes()), []).append(i)
        for (s, _), places in seen.items():
            if len(places) > 1:
                for i in places:
                    far[i] = max(far[i], s)
                    near[i] = s if near[i] < 0 else min(near[i], s)


def contexts(docs: DataFrame, wanted: DataFrame, length: int, seed: int) -> DataFrame:
    """seed, context, left and bytes of the anchors in ``wanted`` (doc_id, at, seed, context)."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("at", "seed", "context")).alias("__wanted"))
    joined = docs.select("doc_id", "text").join(lists.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", AT_ONCE):
                out = []
                for text, own in zip(common.texts(batch.column("text")), batch.column("__wanted").to_pylist(), strict=True):
                    mine = text_hash(text)
                    for w in own:
                        if w["at"] >> 32 == mine:
                            p = w["at"] & 0xFFFFFFFF
                            left = min(length - seed, p)
                            out.append((w["seed"], w["context"], left, text[p - left : p + length]))
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["seed", "context", "left", "bytes"]
                )

    return joined.select("text", "__wanted").mapInArrow(run, "seed bigint, context bigint, left int, bytes binary")


def sorted_cover(rows: DataFrame, length: int) -> DataFrame:
    """seed, context, before, after: what repeated strings cover around the anchor, of contexts grouped by seed."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held = Powers(), None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            seeds = held.column("seed").to_numpy()
            if len(seeds) < CONTEXTS_AT_ONCE:
                continue
            cut = int(np.searchsorted(seeds, seeds[-1]))  # the last seed may go on
            if cut:
                yield from solve(held.slice(0, cut), powers)
                held = held.slice(cut)
        if held is not None:
            yield from solve(held, powers)

    def solve(whole: pa.RecordBatch, powers: Powers) -> Iterator[pa.RecordBatch]:
        seeds = whole.column("seed").to_numpy()
        a = 0
        while a < len(seeds):
            b = min(a + CONTEXTS_AT_ONCE, len(seeds))
            b = int(np.searchsorted(seeds, seeds[b - 1], side="right"))
            part = whole.slice(a, b - a)
            sorter = Sorter(
                part.column("bytes").to_pylist(), part.column("left").to_numpy().astype(np.int64), seeds[a:b], powers, length
            )
            before, after = sorter.covered()
            yield pa.RecordBatch.from_arrays(
                [part.column("seed"), part.column("context"), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))],
                ["seed", "context", "before", "after"],
            )
            a = b

    dealt = rows.repartition(n, "seed").sortWithinPartitions("seed")
    return dealt.mapInArrow(run, "seed bigint, context bigint, before int, after int").where("before >= 0")


def counted_cover(rows: DataFrame, length: int) -> DataFrame:
    """The same for seeds with very many contexts: every string of a context is hashed, and Spark counts the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            values = [batch.column(c).to_pylist() for c in ("seed", "context", "left", "bytes")]
            for seed, context, left, data in zip(*values, strict=True):
                for start in range(len(data) - length + 1):
                    h = xxhash.xxh3_128_digest(data[start : start + length])
                    out.append((seed, context, left - start, h))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["seed", "context", "s", "string"]
            )

    strings = rows.mapInArrow(run, "seed bigint, context bigint, s int, string binary")
    # The same place before the anchor: one string may stand around two anchors and would meet itself.
    same = ["string", "seed", "s"]
    repeated = strings.groupBy(*same).agg(F.min("context").alias("x"), F.max("context").alias("y")).where("x <> y").select(*same)
    found = strings.join(repeated, same).groupBy("seed", "context").agg(F.max("s").alias("before"), F.min("s").alias("least"))
    return found.select("seed", "context", "before", (F.lit(length) - F.col("least")).cast("int").alias("after"))


def spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, crowd: int = CROWD) -> DataFrame:
    """doc_id, at, before, after: covered bytes around anchors."""
    rows = common.stored(anchor_rows(docs, length, seed), "anchors")
    by_seed = rows.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("x"), F.max("context").alias("y")).where("n > 1")
    # Written first: a join of two plain exchanges can be split where one seed has very many anchors.
    by_seed = common.stored(by_seed.select("seed", (F.col("x") != F.col("y")).alias("mixed")), "seeds")
    repeated = rows.join(by_seed, "seed")
    repeated = common.stored(repeated, "repeated")
    whole = repeated.where(~F.col("mixed")).select("doc_id", "at", F.lit(length).alias("before"), F.lit(length).alias("after"))
    mixed = repeated.where("mixed").drop("mixed")
    kinds = common.stored(
        mixed.groupBy("seed", "context").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "contexts"
    )
    crowded = kinds.groupBy("seed").agg(F.count(F.lit(1)).alias("kinds"))
    # One anchor of each kind: of the least document, its first.
    least = kinds.select("seed", "context", F.col("least").alias("__least"))
    chosen = (
        mixed.join(least, ["seed", "context"]).where(F.col("doc_id").eqNullSafe(F.col("__least")))
        .groupBy("seed", "context").agg(F.min_by("doc_id", "at").alias("doc_id"), F.min("at").alias("at"))
    )
    bytes_of = contexts(docs, chosen.select("doc_id", "at", "seed", "context"), length, seed).dropDuplicates(["seed", "context"])
    bytes_of = common.stored(bytes_of.join(crowded, "seed"), "context-bytes")
    few, many = bytes_of.where(F.col("kinds") <= crowd), bytes_of.where(F.col("kinds") > crowd)
    cover = sorted_cover(few, length).union(counted_cover(many, length))
    # A context that occurs twice is covered as a whole.
    twice = kinds.where("n > 1").select("seed", "context", F.lit(length).alias("before"), F.lit(length).alias("after"))
    cover = cover.union(twice).groupBy("seed", "context").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    cover = common.stored(cover, "cover")
    return whole.union(mixed.join(cover, ["seed", "context"]).select("doc_id", "at", "before", "after"))


def remove(docs: DataFrame, length: int = LENGTH, seed: int = SEED, crowd: int = CROWD, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes (with ``digest`` their SHA-256) of every row."""
    found = spans(docs, length, seed, crowd).groupBy(F.col("doc_id").alias("__id")).agg(
        F.collect_list(F.struct("at", "before", "after")).alias("__spans")
    )
    joined = docs.select("doc_id", "text").join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                n_bytes, n_removed, n_spans, kept = [], [], [], []
                lists = batch.column("__spans")
                for i, text in enumerate(common.texts(batch.column("text"))):
                    goes = np.zeros(len(text) + 1, dtype=np.int32)
                    if lists[i].is_valid and len(text) >= length:
                        own = lists[i].values
                        at = own.field("at").to_numpy()
                        mine = at >> 32 == text_hash(text)
                        place = (at & 0xFFFFFFFF)[mine]
                        before = np.minimum(own.field("before").to_numpy()[mine], length - seed)
                        np.add.at(goes, np.maximum(place - before, 0), 1)
                        np.add.at(goes, np.minimum(place + own.field("after").to_numpy()[mine], len(text)), -1)
                    gone = np.cumsum(goes)[:-1] > 0
                    n_bytes.append(len(text))
                    n_removed.append(int(gone.sum()))
                    n_spans.append(int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(gone) else 0)
                    rest = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                    kept.append(common.sha(rest) if digest else rest)
                counts = [pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *counts, pa.array(kept, pa.string() if digest else pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", last],
                )

    last = "kept_sha256" if digest else "kept"
    kind = "string" if digest else "binary"
    fields = f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, {last} {kind}"
    return joined.select("doc_id", "text", "__spans").mapInArrow(run, fields)
