"""Scoring of Arrow batches of document vectors against one block of questions, inside Spark tasks.

Spark partitions the documents and does the final ranking; this helper only fills a (questions x documents) matrix for a
batch and keeps the best documents per question, so that pairs are never materialised as rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Cells of one score matrix, and of the vectors scored; larger batches are scored in slices.
MATRIX_CELLS = 1_000_000


class QuestionBlock:
    """The unit vectors of some questions (rows with ``qid`` and ``embedding``); NaN where there is none."""

    def __init__(self, rows):
        self.qids = [r["qid"] for r in rows]
        vectors = [r["embedding"] for r in rows]
        self.dim = next((len(v) for v in vectors if v is not None), 0)
        self.vectors = np.full((len(rows), self.dim), np.nan)
        for i, v in enumerate(vectors):
            if v is not None:
                self.vectors[i] = v
        if self.dim:
            self.vectors /= np.linalg.norm(self.vectors, axis=1, keepdims=True)

    def scores(self, lists) -> np.ndarray:
        """Cosine per question and document; NaN where a question has no vector."""
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        vectors = flat.reshape(len(lists), self.dim)
        with np.errstate(invalid="ignore", divide="ignore"):
            vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return self.vectors @ vectors.T


def best_documents(batches, block: QuestionBlock, k: int, schema: pa.Schema, repeated: bool = False) -> pa.RecordBatch:
    """The task's best ``k`` documents per question: highest rounded score, then smallest id.

    ``batches`` hold doc_id and embedding; with ``repeated`` a document may have several, of which the best counts. The result has the columns of ``schema``: qid, doc_id, vector_score.
    """
    n_q = len(block.qids)
    bar, kept = np.full(n_q, -np.inf), None
    for batch in batches:
        step = max(1, MATRIX_CELLS // max(1, n_q, block.dim))
        for at in range(0, batch.num_rows if block.dim else 0, step):
            part = batch.slice(at, step)
            ids = part.column(0)
            ids = ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.array(ids.to_pylist(), dtype=str)
            exact = block.scores(part.column(1))
            key = np.round(exact, 6)
            q, d = np.nonzero(~np.isnan(key) & (key >= bar[:, None]))
            new = [q, key[q, d], ids[d], exact[q, d]]
            if kept is not None:
                new = [np.concatenate(pair) for pair in zip(kept, new)]
            if repeated:
                order = np.lexsort((-new[3], new[2], new[0]))
                new = [a[order] for a in new]
                other = np.r_[True, (new[0][1:] != new[0][:-1]) | (new[2][1:] != new[2][:-1])][: len(order)]
                new = [a[other] for a in new]
            order = np.lexsort((new[2], -new[1], new[0]))
            new = [a[order] for a in new]
            q = new[0]
            start = np.r_[True, q[1:] != q[:-1]][: len(q)]
            place = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
            kept = [a[place < k] for a in new]
            full = place == k - 1
            bar[q[full]] = new[1][full]
    if kept is None:
        return pa.RecordBatch.from_pylist([], schema)
    q, _, ids, exact = kept
    columns = [pa.array([block.qids[i] for i in q], schema.field(0).type), pa.array(ids.tolist(), schema.field(1).type), pa.array(exact)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
