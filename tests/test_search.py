import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from querylode.functions import vectors as vec
from querylode.operators import search, text_index

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
FIELDS = {"title": 2.0, "body": 1.0}


def corpus(spark, n=60, string_ids=False):
    rng = random.Random(5)
    docs, questions = [], []
    for i in range(n):
        title = " ".join(rng.choices(WORDS, k=rng.randint(0, 3)))
        body = " ".join(rng.choices(WORDS, k=rng.randint(1, 30)))
        v = None if i % 11 == 3 else [rng.gauss(0, 1) for _ in range(8)]
        docs.append((f"d{i:03d}" if string_ids else i, title, body, v, i % 4, [f"t{i % 3}"]))
    for q in range(7):
        questions.append((q, " ".join(rng.choices(WORDS + ["unseen"], k=3)), [rng.gauss(0, 1) for _ in range(8)]))
    kind = "string" if string_ids else "bigint"
    d = spark.createDataFrame(docs, f"doc_id {kind}, title string, body string, embedding array<float>, label int, tags array<string>")
    q = spark.createDataFrame(questions, "qid int, question string, embedding array<float>")
    return docs, questions, d.repartition(3), q


def brute_text(docs, questions):
    def tokens(s):
        return [t for t in re.split(r"[^a-z]+", s.lower()) if t]

    out = {}
    for f, (name, boost) in enumerate(FIELDS.items()):
        per = {d[0]: Counter(tokens(d[1 + f])) for d in docs}
        with_field = {i: c for i, c in per.items() if c}
        n, avg = len(with_field), sum(sum(c.values()) for c in with_field.values()) / len(with_field)
        for q in questions:
            for i, c in with_field.items():
                s = 0.0
                for t, qtf in Counter(tokens(q[1])).items():
                    df = sum(t in x for x in with_field.values())
                    if c[t]:
                        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                        s += qtf * idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg))
                out[q[0], i] = max(out.get((q[0], i), 0.0), boost * s)
    return {k: v for k, v in out.items() if v > 0}


def brute_vector(docs, questions):
    out = {}
    for q in questions:
        for d in docs:
            if d[3] is not None:
                a, b = np.float32(q[2]).astype(float), np.float32(d[3]).astype(float)
                out[q[0], d[0]] = float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    return out


def top(scores, k):
    best = {}
    for (q, d), s in scores.items():
        best.setdefault(q, []).append((-round(s, 6), d))
    return {(q, r + 1, d, -s) for q, rows in best.items() for r, (s, d) in enumerate(sorted(rows)[:k])}


def result(hits):
    return {(r["qid"], r["rank"], r["doc_id"], r["score"]) for r in hits.collect()}


@pytest.fixture(params=["few", "many"])
def path(request, monkeypatch):
    if request.param == "many":
        monkeypatch.setattr(search, "MAX_QUESTIONS", 2)
        monkeypatch.setattr(text_index, "SEEDS", 1)
    return request.param


@pytest.mark.parametrize("string_ids", [False, True])
def test_text_search_against_brute_force(spark, path, string_ids):
    docs, questions, d, q = corpus(spark, string_ids=string_ids)
    assert result(search.text_search(d, q, FIELDS, size=5)) == top(brute_text(docs, questions), 5)


def test_vector_search_against_brute_force(spark, path):
    docs, questions, d, q = corpus(spark)
    assert result(search.vector_search(d, q, size=5)) == top(brute_vector(docs, questions), 5)


def test_hybrid_search_against_brute_force(spark, path):
    docs, questions, d, q = corpus(spark)
    text, vector, k = brute_text(docs, questions), brute_vector(docs, questions), 4
    near = {(a, b) for a, _, b, _ in top(vector, k)}
    fused = {
        key: 0.3 * text.get(key, 0.0) + 0.7 * (vector[key] if key in near else 0.0)
        for key in set(text) | near
    }
    expected = top(fused, k)
    got = search.hybrid_search(d, q, fields=FIELDS, size=k)
    assert {(a, b, c, round(s, 5)) for a, b, c, s in result(got)} == {
        (a, b, c, round(s, 5)) for a, b, c, s in expected
    }


def test_small_batches_and_slices(spark, monkeypatch):
    from querylode.operators import block_scoring

    docs, questions, d, q = corpus(spark)
    monkeypatch.setattr(block_scoring, "MATRIX_CELLS", 20)
    block = block_scoring.QuestionBlock([{"qid": r["qid"], "embedding": list(r["embedding"])} for r in q.collect()])
    import pyarrow as pa

    given = [x for x in docs if x[3] is not None]
    table = pa.table({"doc_id": pa.array([x[0] for x in given]), "embedding": pa.array([x[3] for x in given], pa.list_(pa.float32()))})
    schema = pa.schema([("qid", pa.int32()), ("doc_id", pa.int64()), ("vector_score", pa.float64())])
    out = block_scoring.best_documents(table.to_batches(7), block, 3, schema)
    got = {(r["qid"], r["doc_id"]) for r in out.to_pylist()}
    assert got == {(a, c) for a, _, c, _ in top(brute_vector(docs, [(x[0], x[1], list(np.float32(x[2]))) for x in questions]), 3)}


def test_alpha_limits(spark):
    _, _, d, q = corpus(spark)
    by_vector = {r[:3] for r in result(search.vector_search(d, q, size=3))}
    assert {r[:3] for r in result(search.hybrid_search(d, q, fields=FIELDS, size=3, alpha=1.0)) if r[3] > 0} == {
        r[:3] for r in result(search.vector_search(d, q, size=3)) if r[3] > 0
    } and len(by_vector) == 21
    by_text = {r[:3] for r in result(search.text_search(d, q, FIELDS, size=3))}
    assert {r[:3] for r in result(search.hybrid_search(d, q, fields=FIELDS, size=3, alpha=0.0)) if r[3] > 0} == by_text


def test_filters_threshold_and_scale(spark):
    docs, questions, d, q = corpus(spark)
    vectors = brute_vector(docs, questions)
    label = {x[0]: x[4] for x in docs}
    allowed = {k: s for k, s in vectors.items() if label[k[1]] in (1, 2)}
    assert result(search.vector_search(d, q, size=5, filters={"label": [1, 2]})) == top(allowed, 5)
    post = {r for r in top(vectors, 5) if label[r[2]] in (1, 2)}
    assert result(search.vector_search(d, q, size=5, filters={"label": [1, 2]}, mode="post")) == post
    tagged = {k: s for k, s in vectors.items() if k[1] % 3 == 0}
    assert result(search.vector_search(d, q, size=5, filters={"tags": ["t0", "other"]})) == top(tagged, 5)
    hits = search.vector_search(d, q, size=5)
    assert {r for r in top(vectors, 5) if r[3] >= 0.3} == result(search.above_threshold(hits, 0.3))
    assert search.above_threshold(hits, None).count() == hits.count()
    half = result(search.vector_search(d, q, size=5, scale="half"))
    assert {r[:3] for r in half} == {r[:3] for r in top(vectors, 5)} and all(0 <= r[3] <= 1 for r in half)


def test_no_match(spark):
    _, _, d, _ = corpus(spark)
    q = spark.createDataFrame([(1, "nothing here")], "qid int, question string")
    assert search.text_search(d, q, FIELDS).count() == 0
    assert search.text_search(d.limit(0), q, FIELDS).count() == 0


def test_no_cross_join_in_the_plan(spark):
    _, _, d, q = corpus(spark)
    plan = search.hybrid_search(d, q, fields=FIELDS)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_embedding(spark):
    texts = ["the cat and the hat", "", "   ", "été 42", "!!!", "one " * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(vec.embed(F.col("t"), 16)).collect()]

    def expected(t):
        words = re.findall(r"\w+", t.lower())
        if not words:
            return None
        v = np.zeros(16)
        for w in words:
            v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16] += 1
        return v / np.linalg.norm(v)

    for g, t in zip(got, texts):
        e = expected(t)
        assert (g is None) == (e is None)
        if e is not None:
            assert np.allclose(g, e, atol=1e-6)


def test_citations(spark):
    df = spark.createDataFrame(
        [(1, 2, 0.5, "b", None, None, "x", ["t"], "SELECT"), (1, 1, 0.9, "a", "p", "c", None, None, None)],
        "qid int, rank bigint, score double, sql_query string, notebook_path string, context_before string, "
        "context_after string, tables_used array<string>, query_type string",
    )
    c = search.citations(df).first()["citations"]
    assert [x["sql_query"] for x in c] == ["a", "b"]
    assert c[0]["context_after"] == "" and c[0]["tables_used"] == [] and c[1]["notebook_path"] == ""


def test_minmax_fusion(spark, path):
    docs, questions, d, q = corpus(spark)
    k = 4
    lists = [top(brute_text(docs, questions), k), top(brute_vector(docs, questions), k)]
    units = []
    for found in lists:
        unit = {}
        for a in {r[0] for r in found}:
            own = {r[2]: r[3] for r in found if r[0] == a}
            low, high = min(own.values()), max(own.values())
            unit |= {(a, doc): 1.0 if high == low else (s - low) / (high - low) for doc, s in own.items()}
        units.append(unit)
    fused = {key: 0.3 * units[0].get(key, 0.0) + 0.7 * units[1].get(key, 0.0) for key in units[0] | units[1]}
    got = search.hybrid_search(d, q, fields=FIELDS, size=k, normalize="minmax")
    assert {(a, b, c, round(s, 5)) for a, b, c, s in result(got)} == {(a, b, c, round(s, 5)) for a, b, c, s in top(fused, k)}


def test_text_search_reads_no_text_and_few_postings(spark, tmp_path):
    """A word of every document, one of a third of them and rare ones: candidates come from the rare ones alone."""
    rows = [(i, "common " * (1 + i % 3) + ("often " if i % 3 == 0 else "") + (f"rare{i // 4} " if i < 400 else "")) for i in range(6_000)]
    index = text_index.write(spark.createDataFrame(rows, "doc_id bigint, text string"), ["text"], str(tmp_path))
    questions = spark.createDataFrame([(i, f"common often rare{i}") for i in range(100)], "qid int, question string")
    hits = search.text_search(spark.createDataFrame([], "doc_id bigint, text string"), questions, {"text": 1.0}, size=3, index=index)
    docs = [(i, t, "") for i, t in rows]
    df = Counter(w for _, t in rows for w in set(t.split()))
    total = sum(len(t.split()) for _, t in rows)
    expected = {}
    for a in range(100):
        for i, t in rows:
            words = Counter(t.split())
            if a * 4 <= i < a * 4 + 4:
                expected[a, i] = sum(
                    math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * words[w] * 2.2
                    / (words[w] + 1.2 * (0.25 + 0.75 * sum(words.values()) / (total / len(rows))))
                    for w in ("common", "often", f"rare{a}")
                    if words[w]
                )
    assert docs and result(hits) == top(expected, 3)
    found = text_index.best_by_text(index, questions, {"text": 1.0}, 3)
    assert found.count() == 400
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_bounds_stay_true_after_loads(spark, tmp_path):
    from querylode.operators.store import KnowledgeBase

    rng = random.Random(4)
    kb = KnowledgeBase(spark, str(tmp_path))
    kb.create()
    current = {}
    for load in range(3):
        fresh = {f"d{rng.randrange(60)}": " ".join(rng.choices(WORDS, k=rng.randint(1, 40))) for _ in range(30)}
        current |= fresh
        rows = [(k, v, "n") for k, v in fresh.items()]
        kb.index(_as_docs(spark.createDataFrame(rows, "doc_id string, sql_query string, notebook_path string")))
    q = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=3))) for i in range(5)], "qid int, question string")
    got = search.text_search(kb.documents(), q, {"sql_query": 1.0}, size=4, index=kb.text_index())
    plain = spark.createDataFrame(list(current.items()), "doc_id string, sql_query string")
    assert result(got) == result(search.text_search(plain, q, {"sql_query": 1.0}, size=4)) and got.count() == 20


def _as_docs(rows):
    from querylode import tables

    given = set(rows.columns)
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in tables.schema(tables.DOCS) if f.name not in given])
