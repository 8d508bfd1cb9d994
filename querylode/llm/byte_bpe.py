"""Byte-level BPE: words encoded by a priority queue of merge ranks over a doubly linked list, and decoded.

A text is cut at its special tokens, the rest into words by the vocabulary's pattern, and each word starts as the list
of its bytes' symbols. All pairs that merge wait in a heap by rank, then place. The least one is taken: if its symbols
are no longer those of that rank, the entry is stale and skipped; otherwise the right symbol is unlinked and the pairs
with the new symbol's neighbours join the heap. That is at most two entries a merge, so a word of n bytes takes n log n
steps, however long it is. Ids are decoded by joining the byte strings of the vocabulary.

Defined cases: null and empty texts have no id and decode to the empty text; a text is worked through whole, whatever
its length, and a task remembers the ids of at most ``REMEMBERED`` words; of equal ranks the leftmost pair merges first;
rows that repeat are encoded each; an empty table gives no rows; other columns are left out. A special token written in a
text is that token. The vocabulary file is read on the driver; tasks get its tables.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from querylode.llm import common

# How byte-level vocabularies of this kind cut a text into words (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 300_000
_BITS = 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary: printable Latin-1 itself, the others by turn from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    letters = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Symbols of bytes, ranks of symbol pairs, and the byte string of each id."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            content = json.load(f)
        model, before = content["model"], content["pre_tokenizer"]
        plain = not (content["normalizer"] or model["dropout"] or model["ignore_merges"] or before["add_prefix_space"])
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or not plain:
            raise ValueError("a byte-level BPE vocabulary without normaliser, dropout and prefix space is needed")
        ids, letters = model["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes = {i: bytes(byte_of[c] for c in token) for token, i in ids.items()}
        self.bytes |= {i: token.encode() for token, i in self.special.items()}
        self.symbol = [ids[c] for c in letters]
        self.ranks, self.formed = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[left] << _BITS | ids[right]] = rank
            self.formed.append(ids[left + right])

    def merged(self, word: bytes) -> list[int]:
        """The ids of a word."""
        ranks, formed = self.ranks, self.formed
        symbols = [self.symbol[b] for b in word]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(symbols[i] << _BITS | symbols[i + 1])
            if rank is not None:
                heap.append((rank, i))
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j == n or ranks.get(symbols[i] << _BITS | symbols[j]) != rank:
                continue  # stale: one of its symbols has been merged since
            symbols[i], symbols[j] = formed[rank], -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                rank = ranks.get(symbols[i] << _BITS | symbols[j])
                if rank is not None:
                    heapq.heappush(heap, (rank, i))
            j = before[i]
            if j >= 0:
                rank = ranks.get(symbols[j] << _BITS | symbols[i])
                if rank is not None:
                    heapq.heappush(heap, (rank, j))
        return [s for s in symbols if s >= 0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """Encodes texts and remembers words, within one task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, {}
        self.words = regex.compile(WORDS)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def __call__(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        parts = self.cut.split(text) if self.cut else [text]
        out = []
        for k, part in enumerate(parts):
            out += [np.uint32(self.vocabulary.special[part]).astype("<u4").tobytes()] if k % 2 else self._plain(part)
        return b"".join(out)

    def _plain(self, text: str) -> list[bytes]:
        words = self.words.findall(text)
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = np.array(self.vocabulary.merged(w.encode()), "<u4").tobytes()
        return [known[w] for w in words]


def encode(docs: DataFrame, vocabulary_file: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, and the ids and decoded text of each row (or, with ``digest``, their SHA-256)."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_file))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        encoder = Encoder(vocabulary)
        for whole in batches:
            for batch in common.slices(whole, "text"):
                ids, decoded = [], []
                for text in batch.column("text").to_pylist():
                    own = encoder(text or "")
                    ids.append(common.sha(own) if digest else np.frombuffer(own, "<u4").astype(np.int64))
                    back = vocabulary.decode(np.frombuffer(own, "<u4").tolist())
                    decoded.append((common.sha(back.encode()) if digest else back, len(own) // 4))
                counts = pa.array([n for _, n in decoded], pa.int64())
                kinds = (pa.string() if digest else pa.list_(pa.int64()), pa.string())
                rest = [pa.array(ids, kinds[0]), pa.array([d for d, _ in decoded], kinds[1])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), counts, *rest], ["doc_id", "n_tokens", *names])

    names = ["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
    fields = f"doc_id {id_type}, n_tokens bigint, {names[0]} {'string' if digest else 'array<bigint>'}, {names[1]} string"
    return docs.select("doc_id", "text").mapInArrow(run, fields)
