"""Near-duplicate documents by a parity-sketch join of their sets of word 5-grams.

Two sets of sizes a and b with Jaccard similarity t differ in at most (1 - t) / (1 + t) * (a + b) elements. Every
element sets, by exclusive or, one bit of a sketch; so sketches of sets that differ in d elements differ in at most d
bits. Sizes fall into bands; for a band with up to s elements, the sketch is cut into P pieces of ``PIECE_BITS`` bits,
more than the D elements by which linked sets can differ, so at least P - D pieces of linked sets are equal. A set
leaves a key for each piece with a bit set, in its own band and, where a partner can be there, in the next. Keys that
meet give candidates, and candidates are verified on their exact sets.

Equal sets are one class from the start, and a task passes on the keys of a class once. Where up to ``SMALL`` classes
meet in a key, all pairs are candidates. Where more meet, each one with the least of them is. Candidates whose sizes or
whole sketches (first in ``SHORT_BITS`` bits, then in over four bits for each element) are too far apart are dropped: no
linked sets are. Candidates are compared in three rounds: each class with the earlier one that it shares most keys with;
then those candidates that the links found so far leave in different components. A class with few crowded keys shares a key
that isn't crowded with every partner; so the third round is for classes with many crowded keys that meet others of different components. Texts of
one template that aren't linked differ in shingles that nobody else has: so the shingles of these classes are ranked, the
rarest first, and pairs that share one of the first are candidates where up to ``GROUP`` classes do (``rare_shingles``).
Only classes with more partners than that are compared by sketches, in blocks of bounded size. What is near enough is
verified. No link that would join two components is lost.

Keys travel as packed arrays by hash range of the key, whose number grows with the shingles; texts of candidates travel to the class that they are compared
to, in chunks. Components are found by rounds of joins.

Defined cases: null and blank texts have an empty set and are linked to nothing; rows that repeat are copies; of rows
that share a doc_id each has its own set, and they are one node; shingles and classes are told apart by 64-bit hashes;
a null doc_id is linked to nothing and its component is null; a similarity of exactly the limit links; texts of any
length count whole; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylode.llm import common
from querylode.llm.components import components

WORDS = 5
# The similarity, as a fraction of whole numbers.
NUMERATOR, DENOMINATOR = 80, 100
PIECE_BITS = 16
SHORT_BITS = 512
SMALL_SETS = 64
# Classes of one block in the third round.
BLOCK = 2_048
SMALL = 8
# Classes that may meet pair by pair in a shingle, in the third round.
GROUP = 32
# Shingles whose keys share a hash range, on average.
RANGE = 4_000_000
CHUNK = 256
# Word hashes that a task remembers.
REMEMBERED = 300_000
_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """The sorted distinct shingle hashes of texts, within one task."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(h))
        n = len(h) - k + 1
        total = np.full(n, k, dtype=np.uint64)
        for i in range(k):
            total = mix(total * _ODD[i % 5] + h[i : i + n])
        return np.unique(total)


class Bands:
    """Bands of set sizes, and for each band the elements that linked sets may differ in and the pieces."""

    def __init__(self, numerator: int = NUMERATOR, denominator: int = DENOMINATOR):
        self.t, self.u = numerator, denominator

    def edges(self, largest: int) -> list[int]:
        edges = [1]
        while edges[-1] <= largest:
            # A partner of a set below one edge is below the next one.
            reach = -(-edges[-1] * self.u // self.t)
            edges.append(max(edges[-1] + 1, reach, edges[-1] * self.u * self.u // (self.t * self.t)))
        return [*edges, max(edges[-1] + 1, edges[-1] * self.u * self.u // (self.t * self.t))]

    def differ(self, edge: int) -> int:
        """The most elements that two linked sets below ``edge`` differ in."""
        return 2 * (edge - 1) * (self.u - self.t) // (self.u + self.t)

    def pieces(self, edge: int) -> int:
        d = self.differ(edge)
        # Small sets: about a piece for each element, so that a common passage takes few of them.
        return 8 * edge if edge <= SMALL_SETS else d + 1 + max(1, d // 4)

    def of(self, n: int, edges: list[int]) -> list[tuple[int, int]]:
        """(band, its upper edge) where a set of n elements leaves keys."""
        k = int(np.searchsorted(edges, n, side="right")) - 1
        own = [(k, edges[k + 1])]
        if self.u * n >= self.t * edges[k + 1]:
            own.append((k + 1, edges[k + 2]))
        return own


def sketch_keys(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """The keys of several sets, the set of each key and which of its bands it is of, and each set's slack by band.

    The slack is how many of its keys a set may do without: it and a linked set share more keys than that.
    """
    keys, owners, seconds, slack = [], [], [], [[0, 0] for _ in sets]
    edges = bands.edges(max((len(s) for s in sets), default=1))
    for second in (0, 1):
        chosen = []
        for i, s in enumerate(sets):
            own = bands.of(len(s), edges) if len(s) else []
            if len(own) > second:
                chosen.append((i, *own[second]))
        if not chosen:
            continue
        index = np.array([c[0] for c in chosen])
        sizes = np.array([len(sets[i]) for i in index])
        pieces = np.array([bands.pieces(c[2]) for c in chosen], dtype=np.uint64)
        band = np.array([c[1] for c in chosen], dtype=np.uint64)
        first = np.r_[0, np.cumsum(pieces.astype(np.int64))]
        own = np.repeat(np.arange(len(chosen)), sizes)
        h = mix(np.concatenate([sets[i] for i in index]) + (band * _ODD[1])[own])
        piece = ((h >> np.uint64(32)) * pieces[own]) >> np.uint64(32)
        bit = (piece << np.uint64(PIECE_BITS)) | (h & np.uint64((1 << PIECE_BITS) - 1))
        parity = np.zeros(first[-1], dtype=np.uint64)
        np.bitwise_xor.at(parity, first[own] + piece.astype(np.int64), mix(bit + np.uint64(1)))
        there = np.flatnonzero(parity)  # pieces with a bit set
        owner = np.repeat(np.arange(len(chosen)), pieces.astype(np.int64))[there]
        keys.append(mix(parity[there] + (band * _ODD[2])[owner] + (there - first[owner]).astype(np.uint64) * _ODD[3]))
        owners.append(index[owner])
        seconds.append(np.full(len(there), second))
        found = np.bincount(owner, minlength=len(chosen))
        for (i, _, edge), f in zip(chosen, found.tolist(), strict=True):
            # P - D pieces are equal, of which some may be empty.
            slack[i][second] = f - bands.differ(edge) - 1
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), slack
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(seconds), slack


def sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of ``bits`` bits for each set, as 64-bit numbers. A sketch of half the bits is one half xor the other."""
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate([*sets, np.zeros(0, np.uint64)])
    bit = (mix(h * _ODD[4] + _ODD[0]) % _U(bits)).astype(np.int64)
    parity = np.bincount(own * bits + bit, minlength=len(sets) * bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64).reshape(len(sets), bits // 64)


def long_sketch(s: np.ndarray) -> bytes:
    """A sketch of at least four bits for each element."""
    bits = SHORT_BITS
    while bits < 4 * len(s):
        bits *= 2
    return sketches([s], bits).tobytes()


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def class_of(shingles: np.ndarray) -> int:
    """A signed 64-bit number for a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes()))))


def classes(docs: DataFrame, bands: Bands) -> DataFrame:
    """doc_id, n, class, slack0, slack1, sketch of every row; class is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for whole in batches:
            for batch in common.slices(whole, "text"):
                sets = [shingles(t) for t in common.texts(batch.column("text"))]
                own = [class_of(s) if len(s) else None for s in sets]
                slack = sketch_keys(sets, bands)[3]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(own, pa.int64()),
                        *[pa.array([s[k] for s in slack], pa.int64()) for k in (0, 1)],
                        pa.array(list(sketches(sets, SHORT_BITS)), pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "class", "slack0", "slack1", "sketch"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {id_type}, n bigint, class bigint, slack0 bigint, slack1 bigint, sketch array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(run, fields)


def met(docs: DataFrame, bands: Bands, parts: int) -> DataFrame:
    """a, b, times, key, second: classes a <= b that meet in a key.

    Without ``key``: they meet so many times in keys that aren't crowded. With it: class ``b`` has a crowded key, in
    its first or second band, and ``a`` is the least class there.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, passed = Shingles(), set()
        for whole in batches:
            for batch in common.slices(whole, "text", 4 * common.SLICE_BYTES):
                sets, own = [], []
                for text in common.texts(batch.column("text")):
                    s = shingles(text)
                    c = class_of(s) if len(s) else None
                    if c is not None and c not in passed:
                        passed.add(c)
                        sets.append(s)
                        own.append(c)
                keys, owner, second, _ = sketch_keys(sets, bands)
                part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                order = np.argsort(part, kind="stable")
                keys, part = keys[order], part[order]
                owner, second = owner[order], second[order]
                classes = np.array(own, dtype=np.int64)
                cuts = np.r_[np.flatnonzero(np.diff(part, prepend=np.uint64(parts))), len(part)] if len(part) else [0]
                spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(part[a]) for a, _ in spans], pa.int32()),
                        pa.array([_packed(keys[a:b], second[a:b]) for a, b in spans], pa.binary()),
                        pa.array([_named(owner[a:b], classes) for a, b in spans], pa.binary()),
                    ],
                    ["part", "keys", "nodes"],
                )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, nodes = None, [], []
        for batch in batches:
            for p, k, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if p != part and keys:
                    yield from _meetings(keys, nodes, part)
                    keys, nodes = [], []
                part = p
                keys.append(k)
                nodes.append(v)
        if keys:
            yield from _meetings(keys, nodes, part)

    packed = docs.select("text").mapInArrow(pack, "part int, keys binary, nodes binary")
    dealt = packed.repartitionById(parts, F.col("part"))  # a task for each range
    return dealt.sortWithinPartitions("part").mapInArrow(unpack, "a bigint, b bigint, times bigint, key bigint, second int")


def _packed(keys: np.ndarray, second: np.ndarray) -> bytes:
    """31 bits of each key, besides those that its part tells, and one of its band. Keys that fall together by chance
    only give candidates more."""
    return (keys << _U(1) | second.astype(np.uint64)).astype("<u4").tobytes()


def _named(owner: np.ndarray, classes: np.ndarray) -> bytes:
    """The classes of keys as runs: how many, each one's class, each one's length. A class's keys come in at most two."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes = np.diff(np.r_[starts, len(owner)])
    return np.array([len(starts)], "<u4").tobytes() + classes[owner[starts]].tobytes() + sizes.astype("<u4").tobytes()


def _names(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    return np.repeat(np.frombuffer(data, np.int64, n, 4), np.frombuffer(data, "<u4", n, 4 + 8 * n))


def _meetings(keys: list[bytes], nodes: list[bytes], part: int) -> Iterator[pa.RecordBatch]:
    both = np.frombuffer(b"".join(keys), "<u4")
    key, second = (both >> np.uint32(1)).astype(np.int64), (both & np.uint32(1)).astype(np.int32)
    node = np.concatenate([_names(d) for d in nodes])
    order = np.argsort(key)
    # Only keys that more than one entry has.
    k = key[order]
    again = np.r_[False, k[1:] == k[:-1]]
    again[:-1] |= again[1:]
    order = order[again]
    order = order[np.lexsort((node[order], key[order]))]
    key, second, node = key[order], second[order], node[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])][: len(key)]
    key, second, node = key[new], second[new], node[new]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    sizes = np.diff(np.r_[starts, len(key)])
    a, b, at, which = [], [], [], []
    for gap in range(1, SMALL):  # all pairs of up to SMALL classes, by distance in their order
        small = np.repeat((sizes > gap) & (sizes <= SMALL), sizes)
        place = np.arange(len(key)) - np.repeat(starts, sizes)
        i = np.flatnonzero(small & (place >= gap))
        a.append(node[i - gap])
        b.append(node[i])
    pairs = np.stack([np.concatenate(a), np.concatenate(b)])
    pairs = pairs[:, np.lexsort(pairs)]
    fresh = np.flatnonzero(np.r_[True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)][: pairs.shape[1]])
    times = np.diff(np.r_[fresh, pairs.shape[1]])
    pairs = pairs[:, fresh]
    crowd = np.flatnonzero(np.repeat(sizes > SMALL, sizes))
    least = np.repeat(node[starts], sizes)[crowd] if len(starts) else node[:0]
    label = mix(key[crowd].astype(np.uint64) + np.full(len(crowd), part, np.uint64) * _ODD[4]).astype(np.int64)
    none = len(pairs[0])
    for low in range(0, none + len(crowd), 100_000):
        high = low + 100_000
        x, y = pairs[:, low:high], slice(max(low - none, 0), max(high - none, 0))
        n = x.shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[x[0], least[y]]),
                pa.array(np.r_[x[1], node[crowd[y]]]),
                pa.array(np.r_[times[low:high], np.ones(len(label[y]), np.int64)]),
                pa.array(np.r_[np.zeros(n, np.int64), label[y]], mask=np.arange(n + len(label[y])) < n),
                pa.array(np.r_[np.zeros(n, np.int32), second[crowd[y]]]),
            ],
            ["a", "b", "times", "key", "second"],
        )


def near_sketches(x: Column, y: Column, total: Column, numerator: int, denominator: int) -> Column:
    """Whether two short sketches can be of linked sets that have ``total`` elements together."""
    bits = F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    differ = F.aggregate(bits, F.lit(0), lambda so_far, b: so_far + b)
    return (denominator + numerator) * differ <= (denominator - numerator) * total


def possible(pairs: DataFrame, reps: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs whose sizes and short sketches a linked pair can have."""
    of = lambda x: reps.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b")
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    near = near_sketches(F.col("s_a"), F.col("s_b"), F.col("n_a") + F.col("n_b"), numerator, denominator)
    return joined.where((denominator * least >= numerator * most) & near).drop("n_a", "n_b", "s_a", "s_b")


def long_sketches(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """class, n, sketch of the classes whose documents are in ``texts``."""
    rows = texts.join(ids, "doc_id").select("text", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for whole in batches:
            for batch in common.slices(whole, "text"):
                sets = [shingles(t) for t in common.texts(batch.column("text"))]
                own = [(c, len(s), long_sketch(s)) for c, s in zip(batch.column("class").to_pylist(), sets, strict=True) if len(s) and class_of(s) == c]
                columns = list(zip(*own, strict=True)) or [(), (), ()]
                types = (pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["class", "n", "sketch"])

    return rows.mapInArrow(run, "class bigint, n bigint, sketch binary").dropDuplicates(["class"])


def close(pairs: DataFrame, long: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs whose long sketches a linked pair can have."""
    of = lambda x: long.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            differ = np.empty(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True)):
                x, y = (np.frombuffer(v, np.uint64)[None] for v in (x, y))
                words = min(x.shape[1], y.shape[1])
                differ[i] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()
            keep = (denominator + numerator) * differ <= (denominator - numerator) * n
            yield batch.select(["a", "b", "times"]).filter(pa.array(keep))

    return joined.select("a", "b", "times", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint, times bigint")


def rare_shingles(texts: DataFrame, classes_of: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """shingle, class, component: the shingles among which a class shares one with each class that it is linked to.

    ``classes_of``: doc_id, class, component, n of the classes to compare. In order of how many of them have a shingle, two
    linked classes share one among the first of each, as many as a linked set may lack and one more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for whole in batches:
            for batch in common.slices(whole, "text"):
                sets = [shingles(t) for t in common.texts(batch.column("text"))]
                same = [len(s) > 0 and class_of(s) == c for c, s in zip(batch.column("class").to_pylist(), sets, strict=True)]
                kept = batch.select(["class", "component", "n"]).filter(pa.array(same, pa.bool_()))
                lists = [s.view(np.int64) for s, good in zip(sets, same, strict=True) if good]
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lists, pa.list_(pa.int64()))], ["class", "component", "n", "shingles"])

    rows = texts.join(classes_of, "doc_id").select("text", "class", "component", "n")
    id_type = classes_of.schema["component"].dataType.simpleString()
    sets = rows.mapInArrow(run, f"class bigint, component {id_type}, n bigint, shingles array<bigint>")
    each = common.stored(sets.select("class", "component", "n", F.explode("shingles").alias("shingle")), "shingles")
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    # Shingles of one class come first and meet nobody: their number is enough.
    shared = each.join(often, "shingle")
    alone = shared.groupBy("class").agg(F.count_distinct("shingle").alias("shared"))
    first = F.col("n") - F.ceil(F.col("n") * numerator / denominator) + 1 - (F.col("n") - F.col("shared"))
    needed = each.select("class", "n").distinct().join(alone, "class").select("class", first.alias("needed")).where("needed > 0")
    order = Window.partitionBy("class").orderBy("often", "shingle")
    # Equal ranks: a class of several rows with one doc_id comes more than once.
    ranked = shared.join(needed, "class").withColumn("__n", F.dense_rank().over(order))
    return ranked.where("__n <= needed").select("shingle", "class", "component").distinct()


def apart_pairs(rare: DataFrame, reps: DataFrame, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame]:
    """(a, b: pairs in different components, whose sizes and short sketches a linked pair can have, that share a rare
    shingle of up to ``GROUP`` classes; class: those with a shingle of more)."""
    sizes = rare.groupBy("shingle").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("x"), F.max("component").alias("y"))
    met = rare.join(sizes.where("x <> y").select("shingle", "size"), "shingle")
    few = met.where(F.col("size") <= GROUP).join(reps.select("class", "n", "sketch"), "class")
    members = few.groupBy("shingle").agg(F.sort_array(F.collect_list(F.struct("class", "component", "n", "sketch"))).alias("m"))

    def can_link(x, y):
        least, most = F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"])
        apart = (x["component"] != y["component"]) & (denominator * least >= numerator * most)
        return apart & near_sketches(x["sketch"], y["sketch"], x["n"] + y["n"], numerator, denominator)

    after = lambda x, i: F.filter(F.slice("m", i + 2, GROUP), lambda y: can_link(x, y))
    pairs = F.transform("m", lambda x, i: F.transform(after(x, i), lambda y: F.struct(x["class"].alias("a"), y["class"].alias("b"))))
    return members.select(F.inline(F.flatten(pairs))).distinct(), met.where(F.col("size") > GROUP).select("class").distinct()


def still_apart(members: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """a, b: pairs of one pivot's members in different components whose sketches a linked pair can have.

    ``members``: pivot, class, component, n, sketch. They are cut into blocks of about ``BLOCK``; any two blocks meet.
    """
    spark = members.sparkSession
    many = members.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    own = members.join(many, "pivot").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    met = met.select("pivot", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "class", "component", "n", "sketch")
    dealt = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pivot", "low", "high")

    def pairs(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        low, high = group[0][0][1:]
        own, label, component, n = (np.array([g[1][k] for g in group]) for k in range(4))
        words = np.array([len(g[1][4]) // 8 for g in group])
        by_words = {int(w): np.stack([np.frombuffer(group[i][1][4], np.uint64) for i in np.flatnonzero(words == w)]) for w in np.unique(words)}
        places = {w: np.flatnonzero(words == w) for w in by_words}
        a, b = [], []
        for w, rows in by_words.items():
            # Linked sets have sketches of the same length, or of half of it.
            for v in (w, 2 * w):
                if v not in by_words:
                    continue
                others, there = folded(by_words[v], w), places[v]
                for i, row in zip(places[w].tolist(), rows, strict=True):
                    at = there[(component[there] != component[i]) & ((own[there] != own[i]) if low != high else (there > i) if v == w else True)]
                    at = at[np.minimum(n[at], n[i]) * denominator >= np.maximum(n[at], n[i]) * numerator]
                    if not len(at):
                        continue
                    differ = np.bitwise_count(others[np.searchsorted(there, at)] ^ row).sum(axis=1)
                    at = at[(denominator + numerator) * differ.astype(np.int64) <= (denominator - numerator) * (n[at] + n[i])]
                    a += np.minimum(label[at], label[i]).tolist()
                    b += np.maximum(label[at], label[i]).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("pivot", "low", "high", "own", "class", "component", "n", "sketch")], strict=True)
            for r in rows:
                if group and group[0][0] != r[:3]:
                    yield from pairs(group)
                    group = []
                group.append((r[:3], r[3:]))
        if group:
            yield from pairs(group)

    ordered = dealt.sortWithinPartitions("pivot", "low", "high")
    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """a, b, shared, size (of the union): the pairs of classes that are linked, by the doc_ids that represent them.

    ``reps`` has class and doc_id. Each pair takes the text of ``b`` to ``a``, of whose pairs ``CHUNK`` share a group.
    """
    spark = docs.sparkSession
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = pairs.join(many, "a").select("a", F.col("b").alias("class"), F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"))
    heads = dealt.select("a", F.col("a").alias("class"), "chunk").distinct()
    wanted = dealt.withColumn("head", F.lit(0)).union(heads.withColumn("head", F.lit(1))).join(reps, "class")
    rows = wanted.join(docs.select("doc_id", "text"), "doc_id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = rows.select("a", "chunk", "head", "class", "doc_id", "text").repartition(n, "a", "chunk")
    id_type = reps.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, group, head, head_id = Shingles(), None, None, None
        for batch in batches:
            out = []
            values = [batch.column(c).to_pylist() for c in ("a", "chunk", "head", "class", "doc_id")]
            for a, chunk, is_head, own, doc_id, text in zip(*values, common.texts(batch.column("text")), strict=True):
                if group != (a, chunk):
                    group, head = (a, chunk), None
                if is_head and head is not None:
                    continue
                s = shingles(text)
                if not len(s) or class_of(s) != own:  # another row with this doc_id
                    continue
                if is_head:
                    head, head_id = s, doc_id
                elif head is not None:
                    shared = len(np.intersect1d(head, s, assume_unique=True))
                    size = len(head) + len(s) - shared
                    if denominator * shared >= numerator * size:
                        out.append((head_id, doc_id, shared, size))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], batch.column("doc_id").type if k < 2 else pa.int64()) for k in range(4)], ["a", "b", "shared", "size"]
            )

    ordered = grouped.sortWithinPartitions("a", "chunk", F.col("head").desc())
    return ordered.mapInArrow(run, f"a {id_type}, b {id_type}, shared bigint, size bigint")


def near_duplicates(docs: DataFrame, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    bands = Bands(numerator, denominator)
    docs = docs.select("doc_id", "text")
    rows = common.stored(classes(docs, bands), "classes")
    reps = rows.where(F.col("class").isNotNull() & F.col("doc_id").isNotNull()).groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "slack0", "slack1", "sketch")]
    )
    reps = common.stored(reps, "class-documents")
    ids = reps.select("class", "doc_id")
    shingles = reps.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // RANGE))
    met_keys = common.stored(met(docs.where(F.col("doc_id").isNotNull()), bands, parts), "met")
    candidates = met_keys.where("a <> b").groupBy("a", "b").agg(F.sum("times").alias("times"))
    candidates = common.stored(possible(candidates, reps, numerator, denominator), "candidates")
    # Classes with more crowded keys than they can do without.
    crowded = met_keys.where(F.col("key").isNotNull()).select(F.col("a").alias("pivot"), F.col("b").alias("class"), "second")
    slack = reps.select("class", F.posexplode(F.array("slack0", "slack1")).alias("second", "slack"))
    dense = crowded.groupBy("class", "second").count().join(slack, ["class", "second"]).where(F.col("count") > F.col("slack"))
    dense = common.stored(crowded.join(dense.select("class", "second"), ["class", "second"]).select("pivot", "class").distinct(), "dense")
    # The texts of candidates, once.
    named = candidates.select(F.explode(F.array("a", "b")).alias("class")).union(dense.select("class")).distinct()
    texts = common.stored(docs.join(named.join(ids, "class").select("doc_id").distinct(), "doc_id", "left_semi"), "candidate-texts")
    long = common.stored(long_sketches(texts, ids), "sketches")
    candidates = common.stored(close(candidates, long, numerator, denominator), "close-candidates")

    def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        found = verified(pairs, texts, ids, numerator, denominator)
        return common.stored(found.select("a", "b"), "verified")

    def component_of(found: DataFrame) -> DataFrame:
        """class and component of every class in a link."""
        return ids.join(found.withColumnRenamed("node", "doc_id"), "doc_id").select("class", "component")

    best = Window.partitionBy("b").orderBy(F.col("times").desc(), "a")
    first = candidates.withColumn("__n", F.row_number().over(best)).where(F.col("__n") == 1).select("a", "b")
    links = linked(first, texts)
    found = components(links)
    own = component_of(found)
    second = (
        candidates.select("a", "b").join(first, ["a", "b"], "left_anti")
        .join(own.select(F.col("class").alias("a"), F.col("component").alias("x")), "a", "left")
        .join(own.select(F.col("class").alias("b"), F.col("component").alias("y")), "b", "left")
        .where(~F.coalesce(F.col("x") == F.col("y"), F.lit(False)))
    )
    second = common.stored(second.select("a", "b"), "second-round")
    if not second.isEmpty():
        links = links.union(linked(second, texts))
        found = components(links)
    held = dense.join(component_of(found), "class", "left").withColumn("component", F.coalesce("component", F.col("class")))
    apart = held.groupBy("pivot").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("pivot")
    members = common.stored(held.join(apart, "pivot"), "members")
    if not members.isEmpty():
        compared = members.select("class", "component").distinct().join(reps.select("class", "doc_id", "n"), "class")
        rare = common.stored(rare_shingles(texts, compared, numerator, denominator), "rare")
        pairs, crowds = apart_pairs(rare, reps, numerator, denominator)
        near = close(pairs.withColumn("times", F.lit(1).cast("bigint")), long, numerator, denominator).select("a", "b")
        blocks = still_apart(members.join(crowds, "class", "left_semi").join(long, "class"), numerator, denominator)
        rest = near.union(blocks).distinct().join(candidates, ["a", "b"], "left_anti")
        rest = common.stored(rest, "third-round")
        if not rest.isEmpty():
            found = components(links.union(linked(rest, texts)))
    of_class = reps.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        F.col("class").alias("__class"), F.coalesce("component", "doc_id").alias("component")
    )
    joined = rows.join(of_class, F.col("class") == F.col("__class"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
