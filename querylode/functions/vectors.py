"""Built-in text embedding: a hashed bag of words as a unit vector."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .text import let, terms

# Rows whose counts are held at once.
VECTOR_ROWS = 256


def bucket(term: Column, dim: int = fv.EMBED_DIM) -> Column:
    """Slot of a word in the vector."""
    head = F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(dim)).cast("int")


def bucket_counts(text: Column, dim: int = fv.EMBED_DIM) -> Column:
    """Array of (bucket, tf) of a text, by bucket.

    Sorts the buckets of all words and reads off the run lengths, so the cost is that of one sort
    even for very long texts, and nothing leaves the row.
    """

    def runs(s):
        n = F.size(s)
        ends = F.filter(
            F.sequence(F.lit(1), n),
            lambda i: (i == n) | (F.get(s, i - 1) != F.get(s, i)),
        )
        return F.when(
            n > 0,
            let(
                ends,
                lambda e: F.transform(
                    e,
                    lambda end, i: F.struct(
                        F.get(s, end - 1).alias("bucket"),
                        (end - F.when(i > 0, F.get(e, i - 1)).otherwise(0)).alias("tf"),
                    ),
                ),
            ),
        ).otherwise(F.array().cast("array<struct<bucket:int,tf:int>>"))

    return let(F.sort_array(F.transform(terms(text), lambda t: bucket(t, dim))), runs)


def norm(counts: Column) -> Column:
    """Length of the vector of counts."""
    return F.sqrt(
        F.aggregate(counts, F.lit(0.0), lambda a, c: a + (c["tf"] * c["tf"]).cast("double"))
    )


def _hashed(rows: pa.Array, dim: int) -> pa.Array:
    """A unit vector for each row of words (as bytes); null for a row without any."""
    words, sizes = rows.flatten(), pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    coded = words.dictionary_encode()
    slots = np.array([int(md5(w).hexdigest()[:8], 16) % dim for w in coded.dictionary.to_pylist()], dtype=np.int64)
    slots = slots[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, dtype=np.int64)
    ends = np.cumsum(sizes)
    vectors = np.zeros((len(rows), dim), dtype=np.float32)
    for at in range(0, len(rows), VECTOR_ROWS):
        n = min(VECTOR_ROWS, len(rows) - at)
        first, last = ends[at] - sizes[at], ends[at + n - 1]
        place = np.repeat(np.arange(n), sizes[at : at + n]) * dim + slots[first:last]
        counts = np.bincount(place, minlength=n * dim).reshape(n, dim)
        length = np.sqrt((counts * counts).sum(axis=1).astype(np.float64))
        vectors[at : at + n] = counts / np.where(length > 0, length, 1)[:, None]
    full = vectors[sizes > 0].reshape(-1)
    offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, dim, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(full), mask=pa.array(sizes == 0))


def embed(text: Column, dim: int = fv.EMBED_DIM) -> Column:
    """Embedding of a text; null for one without words.

    Spark cuts the words; the slots of a batch's distinct words are hashed once and its vectors filled in Arrow batches.
    """

    def fill(words: pa.Array) -> pa.Array:
        return _hashed(words, dim)

    return F.arrow_udf(fill, "array<float>")(terms(text).cast("array<binary>"))
