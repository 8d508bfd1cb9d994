"""SentencePiece BPE, encoded by vectorised merge rounds over flat symbol arrays, and decoded.

A text becomes segments: no piece holds a space mark after another character, so no merge crosses from one word to
the next space. Distinct segments of a slice of texts are laid end to end in one numpy array of symbols. A round
finds the smallest pair rank of each segment, merges its leftmost occurrences together, compacts the arrays, and
looks up the ranks of changed pairs only; segments without a pair leave. It equals merging one pair at a time: where
a merge forms a pair that would come before the other occurrences, that round merges the first occurrence alone.

Null and empty texts give only the begin and end ids; texts of any length are worked through whole; rows that repeat are
encoded each; an empty table gives no rows. Vocabulary: a BPE model file with byte fallback, identity
normalisation and a space mark before the text. The model file is read on the driver; tasks get its tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from querylode.llm import common

MARK = "▁"
CHARS = 0x110000
# Distinct segments whose ids a task remembers; beyond it the memory is emptied.
REMEMBERED = 300_000
NONE = np.int32(2**31 - 1)
_GENERAL = re.compile(r" +[^ ]+| +$")


class Pieces:
    """The tables of a model: symbols of characters, ranks of symbol pairs, bytes of pieces."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        is_byte = [model.is_byte(i) for i in range(size)]
        self.begin, self.end = model.bos_id(), model.eos_id()
        normal = {n: i for i, n in enumerate(names) if not special[i] and not is_byte[i]}
        inner = [n for n in normal if MARK in n[1:] and n.strip(MARK)]
        if inner or not all(is_byte[model.piece_to_id(f"<0x{b:02X}>")] for b in range(256)):
            raise ValueError("a BPE model with byte fallback and pieces within words is needed")
        # Runs of marks all have the lowest rank and are joined last, from the left.
        self.marks = {len(n): i for n, i in normal.items() if not n.strip(MARK)}
        self.mark = self.marks[1]
        # Symbols: a piece is its id; a character that is no piece is CHARACTER + its code point.
        self.character = size
        self.symbol = np.arange(CHARS, dtype=np.int32) + np.int32(size)
        for n, i in normal.items():
            if len(n) == 1:
                self.symbol[ord(n)] = i
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        self.bytes = [
            b"" if special[i] else bytes([int(n[3:5], 16)]) if is_byte[i] else n.replace(MARK, " ").encode()
            for i, n in enumerate(names)
        ]
        merged = [(n, i) for n, i in normal.items() if len(n) > 1 and n.strip(MARK)]
        order = sorted(merged, key=lambda x: (-model.get_score(x[1]), x[1]))
        self.piece_of_rank = np.array([i for _, i in order], dtype=np.int32)
        keys, ranks = [], []
        for rank, (n, _) in enumerate(order):
            for cut in range(1, len(n)):
                left, right = self._symbol(n[:cut], normal), self._symbol(n[cut:], normal)
                if left is not None and right is not None:
                    keys.append(left << 21 | right)
                    ranks.append(rank)
        self._hash(np.array(keys, dtype=np.int64), np.array(ranks, dtype=np.int32))

    def _symbol(self, name: str, normal: dict) -> int | None:
        return int(self.symbol[ord(name)]) if len(name) == 1 else normal.get(name)

    def _hash(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing; ``probes`` is the longest way to a key."""
        bits = 20
        while (1 << bits) < 4 * len(keys):
            bits += 1
        self.shift = np.uint64(64 - bits)
        self.table_key = np.full(1 << bits, -1, dtype=np.int64)
        self.table_rank = np.full(1 << bits, NONE, dtype=np.int32)
        place, left, self.probes = self._place(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            at = place[left]
            free = self.table_key[at] == -1
            self.table_key[at[free]] = keys[left[free]]  # of several for one place the last one stays
            won = self.table_key[at] == keys[left]
            self.table_rank[at[won]] = ranks[left[won]]
            left = left[~won]
            place[left] = (place[left] + 1) & (len(self.table_key) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that each pair forms; NONE where it forms none."""
        keys = left.astype(np.int64) << 21 | right
        at = self._place(keys)
        out = np.where(self.table_key[at] == keys, self.table_rank[at], NONE)
        open_ = np.flatnonzero((out == NONE) & (self.table_key[at] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.table_key) - 1)
            found = self.table_key[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.table_rank[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def encode(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment (a space mark, then the given characters) as little-endian 32-bit integers."""
        if not segments:
            return []
        text = " " + " ".join(segments) if all(" " not in s for s in segments) else "".join(" " + s for s in segments)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.int32)
        lengths = np.array([len(s) + 1 for s in segments], dtype=np.int64)
        symbols = self.symbol[np.where(points == 32, ord(MARK), points)]
        owner = np.repeat(np.arange(len(segments), dtype=np.int32), lengths)
        done_symbols, done_owner = [], []
        ranks = self._pair_ranks(symbols, owner)
        while True:
            # Segments without a pair leave.
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(ranks, starts) if len(starts) else ranks[:0]
            sizes = np.diff(np.r_[starts, len(owner)])
            stays = best != NONE
            if not stays.all():
                keep = np.repeat(stays, sizes)
                done_symbols.append(symbols[~keep])
                done_owner.append(owner[~keep])
                symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
                best, sizes = best[stays], sizes[stays]
            if not len(symbols):
                break
            symbols, owner, ranks = self._round(symbols, owner, ranks, np.repeat(best, sizes))
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return self._ids(symbols[order], owner[order], len(segments))

    def _pair_ranks(self, symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
        ranks = np.full(len(symbols), NONE, dtype=np.int32)
        if len(symbols) > 1:
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            ranks[inside] = self.rank(symbols[inside], symbols[inside + 1])
        return ranks

    def _round(self, symbols, owner, ranks, best):
        """Merge the leftmost occurrences of each segment's best pair, and compact."""
        hits = np.flatnonzero(ranks == best)
        # In a chain of overlapping occurrences every second one merges, from the left.
        first = np.r_[True, np.diff(hits) > 1]
        head = np.maximum.accumulate(np.where(first, np.arange(len(hits)), 0))
        hits = hits[(np.arange(len(hits)) - head) % 2 == 0]
        piece = self.piece_of_rank[best[hits]]
        new = symbols.copy()
        new[hits] = piece
        gone = np.zeros(len(symbols), dtype=bool)
        gone[hits + 1] = True
        # A new pair at or before the current rank would go first: such a segment merges its first occurrence alone.
        last = len(symbols) - 1
        before = hits - 1
        before = np.where((before >= 0) & gone[np.maximum(before, 0)], before - 1, before)
        has = (before >= 0) & (owner[np.maximum(before, 0)] == owner[hits])
        early = np.zeros(len(hits), dtype=bool)
        i = np.flatnonzero(has)
        early[i] = self.rank(new[before[i]], piece[i]) <= best[hits[i]]
        after = hits + 2
        i = np.flatnonzero((after <= last) & (owner[np.minimum(after, last)] == owner[hits]))
        early[i] |= self.rank(piece[i], symbols[after[i]]) <= best[hits[i]]
        if early.any():
            own = owner[hits]
            slow = np.isin(own, own[early])
            drop = slow & np.r_[False, own[1:] == own[:-1]]
            gone[hits[drop] + 1] = False
            new[hits[drop]] = symbols[hits[drop]]
            hits = hits[~drop]
        keep = ~gone
        place = np.cumsum(keep) - 1
        symbols, owner, ranks = new[keep], owner[keep], ranks[keep]
        at = place[hits]
        touched = np.zeros(len(symbols), dtype=bool)
        touched[at] = True
        touched[at[at > 0] - 1] = True
        changed = np.flatnonzero(touched)
        inside = changed[changed < len(symbols) - 1]
        inside = inside[owner[inside] == owner[inside + 1]]
        ranks[changed] = NONE
        ranks[inside] = self.rank(symbols[inside], symbols[inside + 1])
        return symbols, owner, ranks

    def _ids(self, symbols: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
        """Join runs of marks from the left, spell unknown characters in bytes, and cut by segment."""
        is_mark = symbols == self.mark
        if (is_mark[1:] & is_mark[:-1] & (owner[1:] == owner[:-1])).any():
            new_run = np.r_[True, ~(is_mark[1:] & is_mark[:-1] & (owner[1:] == owner[:-1]))]
            starts = np.flatnonzero(new_run)
            sizes = np.diff(np.r_[starts, len(symbols)])
            joined = [self._joined(n) if n > 1 else None for n in sizes.tolist()]
            repeats = np.array([1 if j is None else len(j) for j in joined], dtype=np.int64)
            out, own = np.repeat(symbols[starts], repeats), np.repeat(owner[starts], repeats)
            ends = np.cumsum(repeats).tolist()
            for j, end in zip(joined, ends, strict=True):
                if j is not None:
                    out[end - len(j) : end] = j
            symbols, owner = out, own
        unknown = symbols >= self.character
        if unknown.any():
            ids, owners = [], []
            at = np.flatnonzero(unknown)
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in (symbols[at] - self.character).tolist()]
            repeats = np.ones(len(symbols), dtype=np.int64)
            repeats[at] = [len(s) for s in spelled]
            ids = np.repeat(symbols, repeats)
            owners = np.repeat(owner, repeats)
            ids[np.repeat(unknown, repeats)] = self.byte_id[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
            symbols, owner = ids, owners
        data = symbols.astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(owner, minlength=n))
        cuts = [0, *ends.tolist()]
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _joined(self, n: int) -> list[int]:
        """The pieces of n marks: the leftmost pair that forms a piece joins first."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-1] + stack[-2] in self.marks:
                stack[-2:] = [stack[-1] + stack[-2]]
        return [self.marks[k] for k in stack]

    def segments(self, text: str) -> list[str]:
        """The segments of a text, each without its first space mark."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [s[1:] for s in _GENERAL.findall(" " + text)]

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids: pieces and bytes joined, without the space mark before the text."""
        pieces = self.bytes
        data = b"".join([pieces[i] for i in ids])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


class Encoder:
    """Encodes texts in slices and remembers segments, within one task."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, {}

    def __call__(self, many: list[str]) -> list[bytes]:
        cut = [self.pieces.segments(t) for t in many]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = list(set().union(*cut) - known.keys())
        known.update(zip(new, self.pieces.encode(new), strict=True))
        begin, end = (np.uint32(i).astype("<u4").tobytes() for i in (self.pieces.begin, self.pieces.end))
        return [b"".join([begin, *[known[s] for s in segments], end]) for segments in cut]


def encode(docs: DataFrame, model_file: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, and the ids and decoded text of each row (or, with ``digest``, their SHA-256).

    One output row per input row; null text counts as empty; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model_file))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        encoder = Encoder(pieces)
        for whole in batches:
            for batch in common.slices(whole, "text"):
                encoded = encoder([t or "" for t in batch.column("text").to_pylist()])
                decoded = [pieces.decode(np.frombuffer(e, dtype="<u4").tolist()) for e in encoded]
                counts = pa.array([len(e) // 4 for e in encoded], pa.int64())
                if digest:
                    rest = [
                        pa.array([common.sha(e) for e in encoded], pa.string()),
                        pa.array([common.sha(d.encode()) for d in decoded], pa.string()),
                    ]
                    names = ["ids_sha256", "decoded_sha256"]
                else:
                    rest = [
                        pa.array([np.frombuffer(e, dtype="<u4").tolist() for e in encoded], pa.list_(pa.int64())),
                        pa.array(decoded, pa.string()),
                    ]
                    names = ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), counts, *rest], ["doc_id", "n_tokens", *names]
                )

    more = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<bigint>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, {more}")
