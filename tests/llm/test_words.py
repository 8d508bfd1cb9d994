"""Byte-level BPE, periodic runs, spelling variants."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from querylode.llm import byte_bpe, periodic_runs, spelling_variants
from querylode.llm import queries as q

FILE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.Vocabulary(FILE))


def test_byte_bpe_equals_the_library(encoder, library):
    rnd = random.Random(7)
    letters = ["ab ", "aaab ", "the qu ick\n\t", "日本 語é😀a  ", "   a\n", "0123 .,-='st", "".join(map(chr, range(128))), "é́‍١²Ⅷ\xa0 \x85 x"]
    texts = ["".join(rnd.choice(a) for _ in range(rnd.randint(0, 60))) for a in rnd.choices(letters, k=3000)]
    texts += ["", " ", "a" * 999, " " * 70, "abcthedog" * 900, "it's we'll I'M", "a<|endoftext|> b<|endoftext|>", "<|endoftext|>" * 3, " <|endoftext| >"]
    # Every character: alone, as part of words, of numbers, and of white space.
    for low in range(0, 0x20000, 64):
        chars = [chr(c) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000]
        texts += ["".join(f"a{c}b 1{c}2 .{c}, {c} \n{c}" for c in chars)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        got = np.frombuffer(encoder(text), "<u4").tolist()
        assert got == want.ids, text
        assert encoder.vocabulary.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_merges_of_a_very_long_word(encoder, library):
    rnd = random.Random(1)
    for text in ("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "=" * 100_000):
        assert np.frombuffer(encoder(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def plain_codes(library, rows):
    out = Counter()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        out[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(back))] += 1
    return out


def test_byte_bpe_rows(odd, none, library):
    got = byte_bpe.encode(odd, FILE, digest=True)
    assert Counter(map(tuple, got.collect())) == plain_codes(library, odd.collect())
    texts = Counter((r.doc_id, r.n_tokens, len(r.ids), r.decoded) for r in byte_bpe.encode(odd, FILE).collect())
    assert texts == Counter((r.doc_id, n := len(library.encode(r.text or "", add_special_tokens=False).ids), n, r.text or "") for r in odd.collect())
    assert byte_bpe.encode(none, FILE).count() == 0


def test_byte_bpe_query(spark, some, library):
    assert Counter(map(tuple, q.op12_byte_bpe(spark, SF).collect())) == plain_codes(library, some.collect())


def plain_runs(words, exponent=4, least=6):
    """Every run, found by comparing all words with those any period later."""
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids, n, out = np.array([names[w] for w in words], np.int64), len(words), []
    for p in range(1, n // exponent + 1):
        same = np.r_[False, ids[:-p] == ids[p:], False].astype(np.int8)
        begin, end = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for i, j in zip(begin.tolist(), end.tolist(), strict=True):
            block = words[i : i + p]
            if j + p - i >= max(least, exponent * p) and all(p % d or block != block[:d] * (p // d) for d in range(1, p)):
                out.append((i, j + p - i, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for start, length, p in runs for i in range(start + p, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repeating(rnd):
    """Words with runs of many periods, some within others, some next to each other, some one word short."""
    words = []
    for _ in range(rnd.randint(0, 5)):
        block = [rnd.choice("abc") for _ in range(rnd.choice([1, 1, 2, 3, 4, 5, 8, 13, 31, 64, 90]))]
        if rnd.random() < 0.3:
            block = block * rnd.randint(1, 5) + [rnd.choice("abcd")]
        length = max(1, round(len(block) * rnd.uniform(2, 7)) + rnd.choice([-1, 0, 0, 1]))
        words += [block[i % len(block)] for i in range(length)]
        words += [rnd.choice("abcdefghi") for _ in range(rnd.choice([0, 0, 1, 7, 50]))]
    return words


@pytest.mark.parametrize("tile", [4096, 8])
def test_periodic_runs(spark, tile, monkeypatch):
    monkeypatch.setattr(periodic_runs, "TILE", tile)
    rnd = random.Random(tile)
    texts = [repeating(rnd) for _ in range(120)] + [["a"] * n for n in (5, 6, 7, 40, 900)] + [list("ab") * 200, list("aab") * 100 + list("aba") * 90]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in periodic_runs.collapse(docs).collect()}
    assert len(got) == len(texts)
    for i, words in enumerate(texts):
        want = plain_runs(words)
        assert [(r.start, r.length, r.period) for r in got[i].runs] == want, words
        assert got[i].collapsed == plain_collapse(words, want)
    assert sum(len(r.runs) for r in got.values()) > 100


def test_a_long_text_is_many_tiles(spark):
    """One text of 200,000 words: its tiles are dealt over tasks, and runs of all lengths are whole."""
    rnd = random.Random(3)
    words = [str(rnd.random()) for _ in range(20_000)]
    text = ["x"] * 30_000 + words[:7_000] * 9 + words + (words[:3] + ["x"]) * 9_000 + words[:5] * 10_000
    docs = spark.createDataFrame([(1, " ".join(text))], "doc_id bigint, text string")
    tiles = periodic_runs._split(docs, "bigint")[1].where("octave IS NOT NULL")
    assert tiles.count() > 20 and tiles.selectExpr("max(length(words))").first()[0] <= 4 * 40 * 8_192
    got = periodic_runs.collapse(docs).collect()[0]
    # What follows a run extends it as far as it goes on with its period.
    want = [(0, 30_000, 1), (30_000, 70_000, 7_000), (113_000, 36_003, 4), (149_000, 50_000, 5)]
    assert [(r.start, r.length, r.period) for r in got.runs] == want
    assert got.collapsed == plain_collapse(text, want)


def test_periodic_runs_odd_rows(odd, none):
    rows = periodic_runs.collapse(odd).collect()
    want = Counter()
    for r in odd.collect():
        words = WORD.findall(r.text or "")
        runs = [] if len(words) > 50_000 else plain_runs(words)
        want[(r.doc_id, tuple(runs), plain_collapse(words, runs))] += 1
    long = max(rows, key=lambda r: len(r.collapsed))
    assert all(x.period == 977 for x in long.runs) and len(long.runs) == 1
    assert long.runs[0].length == 60_000
    got = Counter((r.doc_id, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in rows if r is not long)
    assert got == Counter({k: v for k, v in want.items() if k[0] != 4})
    assert periodic_runs.collapse(none).count() == 0


def with_repeats(doc_id, words):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_periodic_runs_query(spark, some, odd):
    want = Counter()
    for r in some.collect():
        words = with_repeats(r.doc_id, WORD.findall(r.text or ""))
        runs = plain_runs(words) if len(words) < 3_000 else None
        if runs is None:
            continue
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        milli = None if best is None else 1000 * best[1] // best[2]
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want[(r.doc_id, len(runs), *(best or (None,) * 3), milli, sha(listed), sha(plain_collapse(words, runs)))] += 1
    got = Counter(map(tuple, q.op13_periodic_runs(spark, SF).collect()))
    assert got.total() == some.count() and not want - got
    assert sum(k[1] for k in want) > 5
    changed = Counter((r.doc_id, tuple(WORD.findall(r.text or ""))) for r in q.with_repeats(odd).collect())
    assert changed == Counter((r.doc_id, tuple(with_repeats(r.doc_id, WORD.findall(r.text or "")))) for r in odd.collect())


def one_edit(word, letters):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            out |= {word[:i] + word[i + 1 :]} | {word[:i] + c + word[i + 1 :] for c in letters}
    return out - {word}


def plain_variants(counts, ratio=5):
    letters = sorted(set("".join(counts)))
    out = {}
    for w, n in counts.items():
        near = [x for x in one_edit(w, letters) if x in counts]
        best = min(near, key=lambda x: (-counts[x], x.encode()), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (form, n, len(near), counts.get(form))
    rows = set()
    for w, (form, n, many, form_n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, many, form_n))
    return rows


def test_near_pairs_of_a_sorted_list():
    rnd = random.Random(2)
    for _ in range(200):
        words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) for _ in range(60)})
        got = list(spelling_variants.near_pairs(words))
        want = {(i, j) for i, w in enumerate(words) for j, v in enumerate(words) if i < j and v in one_edit(w, "ab")}
        assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("crowd", [20_000, 12, 3])
def test_spelling_variants(spark, crowd):
    rnd = random.Random(crowd)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 11))): 5 * rnd.choice([1, 2, 9, 70, 400, 2_500]) for _ in range(700)}
    given = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.variants(given, crowd=crowd).collect()}
    assert got == plain_variants(words)


def plain_vocabulary(rows, drop_every, min_chars=6, min_count=5):
    counts = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{w}".encode())
            if drop_every and h % drop_every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def test_spelling_variants_query(spark, some):
    want = plain_variants(plain_vocabulary(some.collect(), 199))
    got = Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in q.op11_spelling_variants(spark, SF).collect())
    assert got == Counter(want) and any(r[1] for r in want)


def test_spelling_variants_odd_rows(odd, none):
    for every in (None, 2):
        words = spelling_variants.vocabulary(odd, min_count=1, drop_every=every)
        counts = plain_vocabulary(odd.collect(), every, min_count=1)
        assert {r.word: r.n for r in words.collect()} == counts
        got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.variants(words).collect()}
        assert got == plain_variants(counts)
    assert spelling_variants.variants(spelling_variants.vocabulary(none)).count() == 0
