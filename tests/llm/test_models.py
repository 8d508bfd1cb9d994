"""Language identification, language-model scores, quality classifier."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from querylode.llm import common, hmm_scoring, language_id, quality_classifier
from querylode.llm import queries as q

SF = "/root/testdata/sf0.001"


def test_gradients_of_the_network():
    rng = np.random.default_rng(1)
    net = language_id.Network(["a", "b", "c"], states=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    data = rng.integers(97, 123, (5, language_id.WINDOW)).astype(np.uint8)
    data[2, 20:] = 0
    label = np.array([0, 1, 2, 0, 1])

    def loss():
        p = net.positions([net.states_of(data, d)[0] for d in (0, 1)])
        there = (data.T != 0).astype(float)
        return -(np.log(p[:, label, np.arange(5)]) * there).sum() / there.sum()

    grad = net.gradients(data, label)
    for name, at in (("o", (1, 4)), ("b", (2, 0)), ("u0", (1, 2)), ("u1", (7, 0)), ("u0", (8, 1)), ("x0", (4, int(data[0, 3]))), ("x1", (7, int(data[1, 9])))):
        kept = net.w[name][at]
        net.w[name][at] = kept + 1e-2
        up = loss()
        net.w[name][at] = kept - 1e-2
        down = loss()
        net.w[name][at] = kept
        assert grad[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-4)


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = q.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.9 * len(held)


def test_language_odd_rows(odd, none, monkeypatch):
    monkeypatch.setattr(language_id, "UPDATES", 5)
    net = language_id.train(odd, per_language=5, epochs=1)
    rows = language_id.identify(odd, net).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    for unknown in (1, 2, 3, -(1 << 63)):
        assert (by_id[unknown].lang_pred, by_id[unknown].score) == ("und", 0.0)
    assert by_id[4].lang_pred in net.languages
    assert language_id.train(none) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    assert language_id.identify(none, net).count() == 0


def tiny_model():
    rng = np.random.default_rng(4)
    emit = rng.uniform(0.1, 1, (hmm_scoring.CLASSES, hmm_scoring.STATES))
    move = rng.uniform(0.1, 1, (hmm_scoring.STATES, hmm_scoring.STATES))
    start = rng.uniform(0.1, 1, hmm_scoring.STATES)
    return hmm_scoring.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def test_forward_is_the_sum_over_all_paths():
    model = tiny_model()
    sequences = [np.array([5, 70, 5, 900]), np.array([1]), np.array([3, 3])]
    for s, got in zip(sequences, model.forward(sequences), strict=True):
        total = 0.0
        for path in itertools.product(range(hmm_scoring.STATES), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for a, b, c in zip(path[:-1], path[1:], s[1:], strict=True):
                p *= model.move[a, b] * model.emit[c, b]
            total += p
        assert got == pytest.approx(math.log(total), rel=1e-9)


def test_baum_welch_counts_and_progress():
    model, rng = tiny_model(), np.random.default_rng(6)
    classes = [rng.integers(0, 40, n) for n in (300, 128, 5)]
    rows = np.concatenate([hmm_scoring.cut(c) for c in classes])
    begins = np.array([True, False, False, True, True])
    start, move, emit = model.expected(rows, begins)
    assert emit.sum() == pytest.approx(433, rel=1e-4) and start.sum() == pytest.approx(3, rel=1e-4)
    assert move.sum() == pytest.approx(433 - 5, rel=1e-4)
    assert emit.sum(axis=1)[:40] == pytest.approx(np.bincount(np.concatenate(classes), minlength=40), rel=1e-3)
    likely, share = [], np.bincount(np.concatenate(classes), minlength=hmm_scoring.CLASSES) + 1e-6
    for _ in range(6):
        likely.append(model.forward([r[r < hmm_scoring.CLASSES] for r in rows]).sum())
        model = hmm_scoring.Model.of(*model.expected(rows, np.ones(5, bool)), 1e-9 * share / share.sum())
    assert likely[-1] > likely[1] > likely[0]


def test_last_round_counts_every_token_once(some, monkeypatch):
    sums, of = [], hmm_scoring.Model.of
    monkeypatch.setattr(hmm_scoring.Model, "of", staticmethod(lambda *a: sums.append(a[2].sum()) or of(*a)))
    monkeypatch.setattr(hmm_scoring, "SEED_PASSES", 3)
    known = hmm_scoring.vocabulary(hmm_scoring.word_counts(some), some.count())
    hmm_scoring.train(some, known)
    assert sums[-1] == pytest.approx(known.tokens, rel=1e-3)


def base_scores(rows):
    counts = Counter()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    for r in rows:
        if not r.held_out:
            counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    out = Counter()
    for r in rows:
        own = tokens(r.text)
        score = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        out[(r.doc_id, r.held_out, len(own), sum(counts[w] > 0 for w in own), n, round(score, 4))] += 1
    return out


def test_scores(spark, odd, none, monkeypatch):
    monkeypatch.setattr(hmm_scoring, "LISTED", 400)
    monkeypatch.setattr(hmm_scoring, "SEED_PASSES", 3)
    given = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", common.remainder("doc_id", 10) == 0)
    for docs in (given, odd.withColumn("held_out", F.coalesce(F.col("doc_id") == 8, F.lit(False)))):
        got = hmm_scoring.score(docs).collect()
        plain = base_scores(docs.select("doc_id", "text", "held_out").collect())
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == plain
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert hmm_scoring.score(none.withColumn("held_out", F.lit(False))).count() == 0
    untrained = hmm_scoring.score(odd.withColumn("held_out", F.lit(True))).collect()
    assert all(r.base_score == pytest.approx(0) and r.n_known == r.train_tokens == 0 for r in untrained)


def test_probabilities_sum_to_one():
    """All one-token texts, known words of a shared class and one unknown of each, and the empty text first."""
    vocabulary = hmm_scoring.Vocabulary({}, np.zeros(0, np.int64), np.zeros(0), 0, 0, 3, np.full(hmm_scoring.SHARED, 4.0), np.full(hmm_scoring.SHARED, 2.0))
    assert vocabulary.distribution().sum() == pytest.approx(1)
    inside = (np.array([3, 1, 0]) + hmm_scoring.ADD) / vocabulary.shared_mass[0]
    assert inside.sum() == pytest.approx(1)


def test_trees_learn_and_are_walked_right():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, quality_classifier.STATISTICS))
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] < -0.5)).astype(float)
    trees = quality_classifier.fit(x[:2000], y[:2000])
    scores = trees.scores(x)
    assert ((scores[2000:] > 0.5) == (y[2000:] > 0.5)).mean() > 0.95
    for i in range(20):
        total = trees.prior
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[i, feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-total)))


def test_quality_of_given_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = q.op6_quality_classifier(spark, SF)
    assert rows.count() == 200
    both = rows.join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in both) >= 0.9 * len(both)


def test_quality_odd_rows(spark, odd, none):
    labels = odd.select("doc_id", "label")
    model = quality_classifier.train(odd, labels)
    got = quality_classifier.score(odd, model)
    assert set(got.columns) == set(odd.columns) and got.count() == odd.count()
    assert all(0 <= r.score <= 1 for r in got.collect())
    nothing = quality_classifier.train(none, labels)
    assert quality_classifier.score(odd, nothing).select("score").distinct().count() == 1
    assert quality_classifier.score(none, nothing).count() == 0
