"""Language-model scores of texts: a hidden Markov model over word classes, trained by Baum-Welch.

Tokens are the words of a text, A-Z lower-cased, and one end. The ``OWN`` most frequent words of the training texts
have classes of their own, all other words share ``SHARED`` classes by hash, and the end is a class. The hidden
Markov model gives the probability of the class sequence; within a shared class a word has its smoothed share of
the class's training count. So the probability is exact over words of any vocabulary, while what tasks need to know
is bounded: emissions of OWN + SHARED + 1 classes, and the counts of the ``LISTED`` most frequent words.

Training: words are counted in tasks and summed by word in one shuffle, for the whole training part. Baum-Welch
goes over the training texts in ``ROUNDS``: three disjoint parts, where counts of earlier parts weigh ``EARLIER`` a round,
and a last round over all texts, whose counts alone, each of weight 1, make the model. Each task sums expected counts over
its texts, and Spark sums the tasks' by class. For these counts alone texts are cut into stretches, which all start from
the distribution of text starts; the moves from one stretch to the next are not counted.

Scoring: the scaled forward recursion runs over the whole sequence of every text. Words beyond the listed ones leave
the task as (row, word, times), get their counts from the joined count table, and come back as sums for each row.

Defined cases: null and empty texts are one end; without training texts every probability of the base is 0.1 / 0.1;
rows that repeat are rows of their own; a null doc_id is hashed as the empty text; extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylode.llm import common

STATES = 8
OWN = 4_096
SHARED = 1_024
CLASSES = OWN + SHARED + 1
END = OWN + SHARED
# Words whose counts every task knows, and the longest of them in bytes: at most 13 MB.
LISTED = 200_000
LISTED_BYTES = 64
# The first model: passes of Baum-Welch over a few stretches of the texts with the smallest hashes of their ids.
SEED_TEXTS = 2_000
SEED_STRETCHES = 4
SEED_PASSES = 20
# Parts of the training texts, of PARTS, that each round of Baum-Welch goes over.
PARTS = 8
ROUNDS = ((0, 2), (2, 5), (5, 8), (0, PARTS))
# The weight of earlier rounds' counts in a round over a part of the texts.
EARLIER = 0.3
STRETCH = 128
STRETCHES_AT_ONCE = 2_048
# Words that a task counts before it passes them on.
COUNTED_AT_ONCE = 400_000
ADD = 0.1
# Tokens of the class distribution that every state's emissions get.
PRIOR = 100.0


@dataclass
class Vocabulary:
    """The listed words with their classes and counts, and of every class what it holds."""

    listed: dict[bytes, int]
    class_of: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    ends: int
    shared_tokens: np.ndarray
    shared_distinct: np.ndarray

    @property
    def shared_mass(self) -> np.ndarray:
        return self.shared_tokens + ADD * (self.shared_distinct + 1)

    def distribution(self) -> np.ndarray:
        """The smoothed probabilities of the classes."""
        own = np.zeros(OWN)
        mine = self.class_of < OWN
        own[self.class_of[mine]] = self.counts[mine]
        mass = np.r_[own + ADD, self.shared_mass, self.ends + ADD]
        return mass / mass.sum()


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(training: DataFrame) -> DataFrame:
    """word, c: the words of all training texts, counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counted):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())], ["word", "c"]
            )

        counted: Counter = Counter()
        for batch in batches:
            for text in common.texts(batch.column("text")):
                counted.update(tokens(text))
                if len(counted) > COUNTED_AT_ONCE:
                    yield rows(counted)
                    counted = Counter()
        yield rows(counted)

    partial = training.select("text").mapInArrow(run, "word binary, c bigint")
    return partial.groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """The bounded part of the counts; ``counts`` is stored."""
    # The most frequent words by steps of the logarithm of their counts, as many steps as stay below LISTED words.
    short = counts.where(F.length("word") <= LISTED_BYTES).withColumn("step", F.floor(32 * F.log2("c")).cast("int"))
    steps = sorted(short.groupBy("step").count().collect(), reverse=True)  # 32 for each doubling: at most 2,016
    sums = np.cumsum([r["count"] for r in steps])
    taken = [r["step"] for r, n in zip(steps, sums.tolist(), strict=True) if n <= LISTED]
    listed = short.where(F.col("step") >= min(taken, default=1 << 30)).select("word", "c").toArrow()
    words, c = listed["word"].to_pylist(), listed["c"].to_numpy().astype(np.float64)
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    words, c = [words[i] for i in order], c[order]
    own = F.broadcast(counts.sparkSession.createDataFrame(pa.table({"word": pa.array(words[:OWN], pa.binary())})))
    bucket = F.pmod(F.crc32("word"), F.lit(SHARED)).cast("int")
    shared = counts.join(own, "word", "left_anti").groupBy(bucket.alias("b")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    shared_tokens, shared_distinct = np.zeros(SHARED), np.zeros(SHARED)
    for r in shared.collect():  # at most SHARED rows
        shared_tokens[r["b"]], shared_distinct[r["b"]] = r["n"], r["v"]
    class_of = np.array([i if i < OWN else OWN + zlib.crc32(w) % SHARED for i, w in enumerate(words)], dtype=np.int64)
    own_words = min(len(words), OWN)
    return Vocabulary(
        {w: i for i, w in enumerate(words)},
        class_of,
        c,
        int(c[:own_words].sum() + shared_tokens.sum()) + ends,
        int(own_words + shared_distinct.sum()) + (ends > 0),
        ends,
        shared_tokens,
        shared_distinct,
    )


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states

    @staticmethod
    def first(distribution: np.ndarray, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        emit = distribution[:, None] * rng.uniform(0.2, 1.8, (len(distribution), STATES))
        move = rng.uniform(0.5, 1.5, (STATES, STATES)) + 9 * STATES * np.eye(STATES)
        return Model(np.full(STATES, 1 / STATES), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def of(start: np.ndarray, move: np.ndarray, emit: np.ndarray, distribution: np.ndarray) -> Model:
        """The maximum of expected counts, with small priors so that nothing is impossible."""
        emit = emit + PRIOR * distribution[:, None]
        move, start = move + 1, start + 1
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def forward(self, sequences: list[np.ndarray]) -> np.ndarray:
        """The natural logarithm of each class sequence's probability, by the scaled forward recursion."""
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        starts = np.r_[0, np.cumsum(lengths)[:-1]][order]
        flat, sizes = np.concatenate(sequences), lengths[order]
        active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        log_p = np.zeros(len(sequences))
        alpha = np.broadcast_to(self.start, (len(sequences), STATES))
        for t, m in enumerate(active.tolist()):
            alpha = alpha[:m] if t == 0 else alpha[:m] @ self.move
            alpha = alpha * self.emit[flat[starts[:m] + t]]
            scale = alpha.sum(axis=1)
            log_p[:m] += np.log(scale)
            alpha /= scale[:, None]
        out = np.empty(len(sequences))
        out[order] = log_p
        return out

    def expected(self, stretches: np.ndarray, begins: np.ndarray):
        """Expected counts (start, move, emit) of rows of classes; CLASSES fills the ends of short rows."""
        emit = np.concatenate([self.emit, np.ones((1, STATES))]).astype(np.float32)
        move, rows = self.move.astype(np.float32), len(stretches)
        columns = np.ascontiguousarray(stretches.T)
        e = emit[columns]
        alpha, scale = np.empty_like(e), np.empty((STRETCH, rows, 1), np.float32)
        for t in range(STRETCH):
            a = np.multiply(self.start.astype(np.float32) if t == 0 else alpha[t - 1] @ move, e[t], out=alpha[t])
            scale[t] = a.sum(axis=1, keepdims=True)
            a /= scale[t]
        moves, beta = np.zeros((STATES, STATES)), np.ones((rows, STATES), np.float32)
        real = columns < CLASSES
        for t in range(STRETCH - 1, -1, -1):
            ahead = e[t] * beta / scale[t]
            if t:
                weighted = ahead * real[t][:, None]
                moves += (alpha[t - 1].T @ weighted) * move
            alpha[t] *= beta  # now the probabilities of the states
            beta = ahead @ move.T
        slot = (columns[real][:, None] * STATES + np.arange(STATES)).ravel()
        emitted = np.bincount(slot, alpha[real].ravel(), CLASSES * STATES).reshape(CLASSES, STATES)
        return alpha[0][begins].sum(axis=0), moves, emitted


def class_sequence(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The classes of a text's tokens, and the listed word of each (-1 where it isn't listed; the end left out)."""
    get = vocabulary.listed.get
    at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    classes = np.empty(len(words) + 1, dtype=np.int64)
    classes[-1] = END
    if len(words):
        classes[:-1] = vocabulary.class_of[at] if len(vocabulary.class_of) else 0
        for i in np.flatnonzero(at < 0).tolist():
            classes[i] = OWN + zlib.crc32(words[i]) % SHARED
    return classes, at


def cut(classes: np.ndarray) -> np.ndarray:
    """Rows of STRETCH classes; CLASSES fills the last."""
    padded = np.full(-(-len(classes) // STRETCH) * STRETCH, CLASSES)
    padded[: len(classes)] = classes
    return padded.reshape(-1, STRETCH)


def seeded(training: DataFrame, words, distribution: np.ndarray) -> Model:
    """Where Baum-Welch starts: random states, parted on a bounded sample so that the rounds refine them."""
    ids = training.where(F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SEED_TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, begins = [], []
            for text in common.texts(batch.column("text")):
                own = cut(class_sequence(tokens(text), words.value)[0])
                for i in np.unique(np.linspace(0, len(own) - 1, SEED_STRETCHES).astype(int)).tolist():
                    rows.append(own[i].tolist())
                    begins.append(i == 0)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), pa.array(begins)], ["row", "begins"])

    sample = training.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # SEED_TEXTS numbers
    found = sample.mapInArrow(run, "row array<int>, begins boolean").toArrow()
    model = Model.first(distribution)
    if found.num_rows:
        rows = np.array(found["row"].to_pylist())
        begins = found["begins"].to_numpy()
        order = np.lexsort(rows.T[::-1])  # the same sums whatever the order of tasks
        for _ in range(SEED_PASSES):
            model = Model.of(*model.expected(rows[order], begins[order]), distribution)
    return model


def train(training: DataFrame, vocabulary: Vocabulary) -> Model:
    """Baum-Welch over disjoint parts of the training texts, then over all of them."""
    spark = training.sparkSession
    words = spark.sparkContext.broadcast(vocabulary)
    distribution = vocabulary.distribution()
    model = seeded(training, words, distribution)
    total = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))]
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(PARTS))
    values = [f"v{k}" for k in range(STATES)]
    for low, high in ROUNDS:

        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            vocabulary = words.value
            sums = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))]
            stretches, begins = [], []

            def add():
                found = model.expected(np.array(stretches), np.array(begins))
                for s, f in zip(sums, found, strict=True):
                    s += f
                stretches.clear()
                begins.clear()

            for batch in batches:
                for text in common.texts(batch.column("text")):
                    classes, _ = class_sequence(tokens(text), vocabulary)
                    own = cut(classes)
                    stretches.extend(own)
                    begins.extend([True] + [False] * (len(own) - 1))
                    if len(stretches) >= STRETCHES_AT_ONCE:
                        add()
            if stretches:
                add()
            table = np.concatenate([sums[2], sums[1], sums[0][None]])
            used = np.flatnonzero(table.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int64()), *[pa.array(table[used, k]) for k in range(STATES)]], ["i", *values]
            )

        own = training.where((part >= low) & (part < high)).select("text")
        rows = own.mapInArrow(run, "i bigint, " + ", ".join(f"{v} double" for v in values))
        summed = rows.groupBy("i").agg(*[F.sum(v).alias(v) for v in values]).toArrow()  # a row for each class and state
        table = np.zeros((CLASSES + STATES + 1, STATES))
        table[summed["i"].to_numpy()] = np.stack([summed[v].to_numpy() for v in values], axis=1)
        new = [table[-1], table[CLASSES:-1], table[:CLASSES]]
        earlier = EARLIER if high - low < PARTS else 0  # a round over all texts has the earlier ones' too
        total = [earlier * a + b for a, b in zip(total, new, strict=True)]
        model = Model.of(*total, distribution)
    return model


def score(docs: DataFrame, held_out: str = "held_out") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``docs`` has doc_id, text and the boolean column ``held_out``; the other rows are learned from.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.col(held_out).alias("held_out"))
    training = docs.where(~F.col("held_out"))
    counts = common.stored(word_counts(training), "word-counts")
    known = vocabulary(counts, training.count())
    model = train(training, known)
    shared = spark.sparkContext.broadcast((known, model))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    log_z = float(np.log10(known.tokens + ADD * (known.distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        log_c, log_mass = np.log10(known.counts + ADD), np.log10(known.shared_mass)
        for whole in batches:
            for batch in common.slices(whole, "text"):
                sequences, rare, rare_n, n_known, own_log, shared_log = [], [], [], [], [], []
                for text in common.texts(batch.column("text")):
                    words = tokens(text)
                    classes, at = class_sequence(words, known)
                    sequences.append(classes)
                    found = at[at >= 0]
                    inside = known.class_of[found] >= OWN if len(found) else found > 0
                    in_shared = classes[(classes >= OWN) & (classes < END)] - OWN
                    own_log.append(log_c[found[~inside]].sum() + np.log10(known.ends + ADD))
                    shared_log.append((log_c[found[inside]].sum(), log_mass[in_shared].sum()))
                    n_known.append(len(found) + (known.ends > 0))
                    own = Counter([words[i] for i in np.flatnonzero(at < 0).tolist()])
                    rare.append(list(own))
                    rare_n.append(list(own.values()))
                log_p = model.forward(sequences) / np.log(10)
                listed, mass = np.array(shared_log).T
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("held_out"),
                        pa.array([len(s) for s in sequences], pa.int64()),
                        pa.array(n_known, pa.int64()),
                        pa.array(np.array(own_log) + listed),
                        pa.array(log_p + listed - mass),
                        pa.array(rare, pa.list_(pa.binary())),
                        pa.array(rare_n, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "rare", "times"],
                )

    local = docs.mapInArrow(
        run,
        f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double, "
        "rare array<binary>, times array<bigint>",
    )
    # Written once, with row numbers that are then fixed.
    local = common.stored(local.withColumn("row", F.monotonically_increasing_id()), "local-scores")
    rare = local.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), "r.times")
    c = F.coalesce("c", F.lit(0))
    from_rare = (
        rare.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(c + F.lit(ADD))).alias("more_logs"),
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
        )
    )
    more = F.coalesce("more_logs", F.lit(0.0))
    return local.drop("rare", "times").join(from_rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(log_z)).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
