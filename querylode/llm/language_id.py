"""Language identification by a bidirectional gated recurrent network over bytes.

A text is lower-cased, encoded as UTF-8 and cut into windows of ``WINDOW`` bytes, so that a text of any length is a
batch of equal rows. In each window one network of gated units reads forwards and one backwards; both states at a
position give the probabilities of the languages there, and a document's are the mean over all of its positions.

The network is trained by backpropagation through time in numpy, on at most ``PER_LANGUAGE`` documents of each
language (the smallest hashes of their ids) with ``WINDOWS`` windows of each, read by Spark tasks; so the fit is
bounded and repeatable. Weights are a few kilobytes and travel with the tasks.

Defined cases: a null text and one without a letter are ``und`` with score 0; equal texts get equal answers; without
any labelled document every text is ``und``; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querylode.llm import common

# The bounds of the labelled sample.
PER_LANGUAGE = 1_000
WINDOWS = 4
WINDOW = 64
STATES = 8
EPOCHS = 4
# A small sample is gone over more often, up to so many updates.
UPDATES = 240
BATCH = 256
RATE = 0.01
UNKNOWN = "und"
# Windows that a task works through at once.
AT_ONCE = 8_192


def windows(many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW) bytes of all texts one after the other, 0 where a text has ended, and each one's text."""
    padded = b"".join([t + bytes(-len(t) % WINDOW) for t in many])
    owner = np.repeat(np.arange(len(many)), [-(-len(t) // WINDOW) for t in many])
    return np.frombuffer(padded, dtype=np.uint8).reshape(-1, WINDOW), owner


class Network:
    """Weights by name. Of each direction (0 forwards, 1 backwards), gates in the order update, reset, candidate:
    ``x`` (3 states x 256) from the byte, ``u`` (3 states x states) from the state; ``o`` (languages x 2 states), ``b``.
    """

    def __init__(self, languages: list[str], states: int = STATES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.states = languages, states
        self.w = {}
        for d in (0, 1):
            self.w[f"x{d}"] = rng.normal(0, 0.3, (3 * states, 256))
            self.w[f"u{d}"] = rng.normal(0, 0.3, (3 * states, states))
        self.w["o"] = rng.normal(0, 0.3, (len(languages), 2 * states))
        self.w["b"] = np.zeros((len(languages), 1))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def states_of(self, data: np.ndarray, d: int, keep: bool = False):
        """States (WINDOW x states x rows) of one direction, and what the backward pass needs if ``keep``."""
        x, u, n = self.w[f"x{d}"], self.w[f"u{d}"], self.states
        steps = range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1)
        # tanh alone gives all gates: sigmoid(v) = (1 + tanh(v / 2)) / 2.
        half = np.r_[np.full(2 * n, 0.5, np.float32), np.ones(n, np.float32)][:, None]
        x, u = x * half, u * half
        rows = data.shape[0]
        columns = np.ascontiguousarray(data.T)
        out = np.empty((WINDOW, n, rows), np.float32)
        h = np.zeros((n, rows), np.float32)
        kept = []
        for t in steps:
            inputs = np.take(x, columns[t], axis=1)
            from_state = u @ h
            gates = inputs[: 2 * n]
            gates += from_state[: 2 * n]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:n], gates[n:]
            candidate = inputs[2 * n :]
            candidate += r * from_state[2 * n :]
            np.tanh(candidate, out=candidate)
            if keep:
                kept.append((h, z, r, candidate, from_state[2 * n :]))
            new = out[t]
            np.subtract(h, candidate, out=new)
            new *= z
            new += candidate
            h = new
        return out, kept

    def positions(self, both: list[np.ndarray]) -> np.ndarray:
        """Probabilities (WINDOW x languages x rows) of every position."""
        o = self.w["o"]
        logits = o[:, : self.states] @ both[0]
        logits += o[:, self.states :] @ both[1]
        logits += self.w["b"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def documents(self, many: list[bytes]) -> np.ndarray:
        """The mean probabilities (texts x languages) over the positions of each text."""
        data, owner = windows(many)
        total = np.zeros((len(many), len(self.languages)))
        left = np.array([len(t) for t in many])[owner]
        starts = np.r_[0, np.cumsum([-(-len(t) // WINDOW) for t in many])][owner]
        lengths = np.minimum(left - (np.arange(len(owner)) - starts) * WINDOW, WINDOW)
        for a in range(0, len(data), AT_ONCE):
            part, size = data[a : a + AT_ONCE], lengths[a : a + AT_ONCE]
            p = self.positions([self.states_of(part, d)[0] for d in (0, 1)])
            p *= np.arange(WINDOW)[:, None, None] < size
            summed = p.sum(axis=0)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(owner[a : a + AT_ONCE], summed[k], len(many))
        return total / np.maximum([len(t) for t in many], 1)[:, None]

    def gradients(self, data: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Backpropagation through time of the mean cross entropy over all positions that hold a byte."""
        n, rows = self.states, len(data)
        (h0, kept0), (h1, kept1) = self.states_of(data, 0, True), self.states_of(data, 1, True)
        p = self.positions([h0, h1])
        p[:, label, np.arange(rows)] -= 1
        there = data.T[:, None, :] != 0
        p *= there / np.float32(max(there.sum(), 1))
        grad = {"o": np.concatenate([np.einsum("tlr,tnr->ln", p, h) for h in (h0, h1)], axis=1), "b": p.sum(axis=(0, 2))[:, None]}
        for d, kept in ((0, kept0), (1, kept1)):
            back = self.w["o"][:, d * n : (d + 1) * n].T @ p
            u, gx, gu = self.w[f"u{d}"], np.zeros_like(self.w[f"x{d}"]), np.zeros_like(self.w[f"u{d}"])
            carry = np.zeros((n, rows), np.float32)
            steps = list(range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1))
            for i in range(WINDOW - 1, -1, -1):
                h, z, r, c, uc = kept[i]
                dh = carry + back[steps[i]]
                dc = dh * (1 - z) * (1 - c * c)
                gates = np.concatenate([dh * (h - c) * z * (1 - z), dc * uc * r * (1 - r), dc])
                to_state = np.concatenate([gates[: 2 * n], dc * r])
                gu += to_state @ h.T
                byte = data[:, steps[i]]
                for k in range(3 * n):
                    gx[k] += np.bincount(byte, gates[k], 256)
                carry = dh * z + u.T @ to_state
            grad[f"x{d}"], grad[f"u{d}"] = gx, gu
        return grad


def fit(data: np.ndarray, label: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam over shuffled batches of windows; every language weighs the same."""
    net, rng = Network(languages, seed=seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    step, epochs = 0, max(epochs, -(-UPDATES // max(1, -(-len(data) // BATCH))))
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            step += 1
            rate = RATE * (1 if epoch < epochs * 0.6 else 0.3)
            for k, g in net.gradients(data[at], label[at]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                net.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def prepared(text: str | None) -> bytes:
    return (text or "").lower().encode()


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> Network | None:
    """Fit on rows of (doc_id, text, lang); null texts and labels are left out."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = rows.select("doc_id", "lang").withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language)
    sample = rows.select("doc_id", "text").join(F.broadcast(chosen.drop("n")), "doc_id")  # per_language rows each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                found, langs = [], []
                for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                    data, _ = windows([prepared(text)])
                    at = np.unique(np.linspace(0, len(data) - 1, WINDOWS).astype(int)) if len(data) else []
                    found += [data[i].tobytes() for i in at]
                    langs += [lang] * len(at)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(langs, pa.string())], ["data", "lang"])

    got = sample.mapInArrow(run, "data binary, lang string").toArrow().sort_by([("lang", "ascending"), ("data", "ascending")])
    if not got.num_rows:
        return None
    langs = got["lang"].to_pylist()
    languages = sorted(set(langs))
    label = np.searchsorted(languages, langs)
    data = np.frombuffer(b"".join(got["data"].to_pylist()), dtype=np.uint8).reshape(-1, WINDOW)
    # The same number of windows of each language, drawn again where there are fewer.
    rng, most = np.random.default_rng(3), np.bincount(label).max()
    at = np.concatenate([np.resize(rng.permutation(np.flatnonzero(label == k)), most) for k in range(len(languages))])
    return fit(data[at], label[at], languages, epochs)


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text"):
                many = batch.column("text").to_pylist()
                known = np.array([net is not None and has_letter(t) for t in many], dtype=bool)
                langs, scores = [UNKNOWN] * len(many), np.zeros(len(many))
                at = np.flatnonzero(known)
                if len(at):
                    p = net.documents([prepared(many[i]) for i in at])
                    scores[at] = np.clip(p.max(axis=1), 0, 1)
                    for i, k in zip(at.tolist(), p.argmax(axis=1).tolist(), strict=True):
                        langs[i] = net.languages[k]
                columns = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
