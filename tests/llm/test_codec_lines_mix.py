"""SentencePiece, line dedup, mixing."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from querylode.llm import line_dedup, mixing, sentencepiece_codec

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_codec.Pieces(MODEL)


def random_texts(n, seed=5):
    rnd = random.Random(seed)
    letters = ["ab ▁", "aaab ", "the qu ick\n\t", "日本 語é😀a  ", "   a\n", "0123 .,-=", "".join(map(chr, range(32, 127)))]
    return ["".join(rnd.choice(a) for _ in range(rnd.randint(0, 60))) for a in rnd.choices(letters, k=n)]


def test_codec_equals_the_library(pieces):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["", " ", "a" * 999, " " * 70, " " * 70 + "a", "abcthedog" * 900, *random_texts(3000)]
    found = sentencepiece_codec.Encoder(pieces)(texts)
    for text, got in zip(texts, found, strict=True):
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(got, "<u4").tolist() == ids
        assert pieces.decode(ids) == library.decode(ids)


def test_codec_odd_rows(odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentencepiece_codec.encode(odd, MODEL, digest=True).collect())
    want = Counter()
    for r in odd.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        digests = (np.array(ids, "<u4").tobytes(), library.decode(ids).encode())
        want[(r.doc_id, len(ids), *(hashlib.sha256(d).hexdigest() for d in digests))] += 1
    assert got == want
    assert sentencepiece_codec.encode(none, MODEL).count() == 0


def kept_lines(rows, min_chars, min_docs):
    strip, low = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(low)
    rank = lambda i: -(1 << 64) if i is None else i
    holders = defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(rank(r.doc_id))
    out = Counter()
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < min_docs or rank(r.doc_id) == max(holders[key(x)])]
        out[(r.doc_id, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize("batches", [1, 4, 5])
def test_line_dedup_brute_force(odd, batches):
    got = line_dedup.dedup(odd, min_chars=20, min_docs=3, batches=batches)
    assert set(odd.columns) <= set(got.columns)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == kept_lines(odd.collect(), 20, 3)


def test_line_dedup_generated(spark):
    rnd = random.Random(3)
    pool = [f"line number {i} of the common pool" for i in range(12)]
    rows = [(i, "\n".join(rnd.choice([*pool, f"own {i} {k} with some more words"]) for k in range(rnd.randint(0, 9)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = line_dedup.dedup(docs)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == kept_lines(docs.collect(), 20, 3)


@pytest.mark.parametrize(("batches", "fanout", "min_docs"), [(1, 2, 2), (2, 2, 4), (3, 2, 5), (4, 3, 6), (5, 2, 4), (6, 3, 3), (6, 2, 5)])
def test_line_dedup_off_the_defaults(spark, batches, fanout, min_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = spark.catalog.listTables()
    got = line_dedup.dedup(docs, min_docs=min_docs, batches=batches, fanout=fanout)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == kept_lines(docs.collect(), 20, min_docs)
    assert spark.catalog.listTables() == before


def test_compaction_leaves_one_row_for_each_key(spark):
    rnd = random.Random(9)
    runs, want, holder = line_dedup.Runs(spark, 2), Counter(), {}
    for batch in range(7):
        keys = rnd.sample(range(3_000), 2_000)
        runs.add(spark.createDataFrame([(k, -k, 1 + k % 3, 100 - batch) for k in keys], "h1 bigint, h2 bigint, n bigint, last bigint"))
        for k in keys:
            want[k] += 1 + k % 3
            holder.setdefault(k, 100 - batch)
        for t in runs.tables():
            assert spark.table(t).count() == spark.table(t).select("h1", "h2").distinct().count()
        got = {r.h1: (r.n, r.last) for r in runs.rows(runs.tables()).collect()}
        assert got == {k: (n, holder[k]) for k, n in want.items()}
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    runs.close()


def test_batches_grow_with_the_square_root_of_the_input(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BATCH_BYTES", 100)
    for n, batches in ((0, 1), (1, 1), (10, 1), (40, 2), (250, 5)):
        assert line_dedup.batches_of(spark.createDataFrame([("x" * 10,)] * n, "text string")) == batches


def test_line_dedup_empty(none):
    assert line_dedup.dedup(none).count() == 0


def highest_quotients(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
def test_apportion_is_sainte_lague(spark, seats):
    rnd = random.Random(seats)
    votes = [rnd.choice([0, 1, 3, 3, 50, 1000, 4321]) for _ in range(40)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(votes)], "k int, v bigint")
    got = mixing.apportion(rows, [], "v", F.lit(seats), "k", "seats").orderBy("k").collect()
    assert [r.seats for r in got] == highest_quotients(votes, seats)


def plain_targets(sizes, weights, share, repeats):
    goal, full = share * sum(sizes), set()
    while True:
        rest = goal - sum(repeats * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        total = sum(weights[i] for i in open_)
        target = {i: repeats * sizes[i] if i in full else rest * weights[i] / total for i in range(len(sizes))}
        over = {i for i in open_ if target[i] > repeats * sizes[i]}
        if not over:
            return target
        full |= over


def test_targets(spark):
    sizes = [100, 3, 70, 0, 900, 20, 20, 5]
    names = ["a", "b", "c", "d", "e", "f", "g", None]
    weights = [5, 2, 1]
    got = mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size bigint"), weights, 1.5, 2)
    want = plain_targets(sizes, [weights[i % 3] for i in range(len(sizes))], 1.5, 2)
    for r in got.collect():
        assert r.target == pytest.approx(want[names.index(r.source)])


def test_mix(some, odd, none):
    for docs, tolerance in ((some, 0.15), (odd, None)):
        rows = mixing.mix(docs, [5, 2, 1], shard_docs=16).collect()
        assert len(rows) == docs.count()
        assert rows and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, [5, 2, 1], shard_docs=16).collect()))
        assert all(0 <= r.taken <= 2 * r.size for r in rows)
        if tolerance:
            source = {r.doc_id: r.source for r in docs.collect()}
            taken, target = Counter(), {}
            for r in rows:
                taken[source[r.doc_id]] += r.taken
                target[source[r.doc_id]] = r.target
            assert all(abs(taken[s] - t) <= tolerance * t for s, t in target.items())
    assert mixing.mix(none, [5, 2, 1]).count() == 0


def test_take_holds_what_the_mix_says(odd, some):
    for docs in (odd, some):
        texts = mixing.take(docs, [5, 2, 1])
        assert texts.columns == docs.columns
        by_doc = Counter()
        for r in texts.collect():
            by_doc[r.doc_id] += len((r.text or "").encode().split())
        want = Counter()
        for r in mixing.mix(docs, [5, 2, 1]).collect():
            want[r.doc_id] += r.taken
        assert +by_doc == +want


def test_take_deals_texts_once(some, capsys):
    """The window over equal rows and the join with the mix share one shuffle, null ids and all."""
    mixing.take(some.repartition(3), [5, 2, 1]).explain()
    plan = capsys.readouterr().out
    with_text = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "__k#" in line]
    assert len(with_text) == 1
