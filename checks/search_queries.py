"""Registered queries over embeddings and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from querylode import fixed_values as fv
from querylode.functions import text as tx
from querylode.functions import vectors as vec
from querylode.operators import context, search, text_index, vector_index
from querylode.session import new_dir

from . import oracle_parts as o
from .fixture import cells, table
from .registry import register

L = "long"


@register(
    "kb_embed_text",
    f"WITH {o.CELLS}, {o.CONTEXT} SELECT extract_id, {o.embed_text()} AS embed_text FROM extracts",
)
def kb_embed_text(spark, sf_dir):
    text = tx.embedding_text(
        *[F.col(c) for c in ("sql_query", "context_before", "context_after", "notebook_path")]
    )
    return context.extracts(cells(spark, sf_dir)).select("extract_id", text.alias("embed_text"))


BUCKET = f"CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {fv.EMBED_DIM}"
HASHED = f"""words AS (SELECT doc_id, unnest({o.terms("text")}) AS w FROM documents),
tf AS (SELECT doc_id, {BUCKET} AS bucket, count(*) AS tf FROM words GROUP BY ALL)"""


@register("kb_hash_tf", f"WITH {HASHED} SELECT doc_id, bucket, tf FROM tf")
def kb_hash_tf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(vec.bucket_counts(F.col("text"))).alias("c")).select(
        "doc_id", F.col("c.bucket").cast(L).alias("bucket"), F.col("c.tf").cast(L).alias("tf")
    )


@register(
    "kb_embedding_norm",
    f"WITH {HASHED} SELECT doc_id, round(sqrt(sum(tf * tf)), 6) AS norm FROM tf GROUP BY doc_id",
)
def kb_embedding_norm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    norm = vec.norm(vec.bucket_counts(F.col("text")))
    return docs.select("doc_id", F.round(norm, 6).alias("norm"))


@register(
    "kb_embedding",
    f"""WITH cut AS (SELECT doc_id, text FROM documents
                     WHERE {o.strip("text")} <> ''),
words AS (SELECT doc_id, unnest({o.terms("text")}) AS w FROM cut),
tf AS (SELECT doc_id, {BUCKET} AS bucket, count(*) AS tf FROM words GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY doc_id)
SELECT doc_id, bucket, CAST(CAST(tf / norm AS FLOAT) AS DOUBLE) AS weight FROM tf JOIN n USING (doc_id)""",
)
def kb_embedding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    dense = docs.select("doc_id", F.posexplode(vec.embed(F.col("text"))).alias("bucket", "weight"))
    return dense.filter(F.col("weight") != 0).select(
        "doc_id", F.col("bucket").cast(L), F.col("weight").cast("double").alias("weight")
    )


@register(
    "q_search_text",
    "SELECT item_id AS qid, concat_ws(' | ', 'Question: ' || "
    + o.strip("text")
    + ", nullif('SQL concepts: ' || concat_ws(', ', "
    + ", ".join(f"CASE WHEN contains(lower(text), '{p}') THEN '{p}' END" for p in fv.SEARCH_PHRASES)
    + "), 'SQL concepts: ')) AS search_text FROM benchmark",
)
def q_search_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), tx.question_text(F.col("text")).alias("search_text")
    )


def vector_questions(spark, sf_dir):
    """Benchmark items with the vector of the same number."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    return b.join(e, "qid")


def vector_docs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast(L).alias("label")
    )


COS = """cos AS (
  SELECT b.item_id AS qid, d.vec_id AS doc_id, CAST(d.label AS BIGINT) AS label,
         list_cosine_similarity(CAST(d.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS raw
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings d)"""


def _knn(where="", extra=""):
    return f"""WITH {COS} SELECT qid, rank, doc_id, score{extra} FROM (
  SELECT qid, doc_id, label, round(raw, 6) AS score,
         row_number() OVER (PARTITION BY qid ORDER BY round(raw, 6) DESC, doc_id) AS rank
  FROM cos {where}) WHERE rank <= 10"""


@register("knn_top10", _knn())
def knn_top10(spark, sf_dir):
    return search.vector_search(vector_docs(spark, sf_dir), vector_questions(spark, sf_dir))


@register("knn_filtered_pre", _knn("WHERE label IN (1, 3)"))
def knn_filtered_pre(spark, sf_dir):
    return search.vector_search(
        vector_docs(spark, sf_dir), vector_questions(spark, sf_dir), filters={"label": [1, 3]}
    )


@register("knn_filtered_post", _knn() + " AND label IN (1, 3)")
def knn_filtered_post(spark, sf_dir):
    return search.vector_search(
        vector_docs(spark, sf_dir),
        vector_questions(spark, sf_dir),
        filters={"label": [1, 3]},
        mode="post",
    )


def text_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def text_questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("question")
    )


def bm25_sql(fields: dict, docs: str = "documents") -> str:
    """CTEs ending in ``txt``: qid, doc_id and the unrounded best boosted field score."""
    per_field = " UNION ALL ".join(
        f"SELECT doc_id, '{f}' AS field, {o.terms(f)} AS toks FROM {docs}" for f in fields
    )
    boosts = ", ".join(f"('{f}', {b})" for f, b in fields.items())
    k1, b = fv.BM25_K1, fv.BM25_B
    return f"""
fld AS ({per_field}),
dl AS (SELECT doc_id, field, len(toks) AS dl FROM fld WHERE len(toks) > 0),
st AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY field),
post AS (SELECT doc_id, field, term, count(*) AS tf
         FROM (SELECT doc_id, field, unnest(toks) AS term FROM fld) GROUP BY ALL),
dfs AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
qt AS (SELECT qid, term, count(*) AS qtf FROM (
         SELECT item_id AS qid, unnest({o.terms("text")}) AS term FROM benchmark) GROUP BY ALL),
fs AS (SELECT qt.qid, p.doc_id, p.field,
         sum(qt.qtf * ln(1 + (st.n - dfs.df + 0.5) / (dfs.df + 0.5)) * p.tf * ({k1} + 1)
             / (p.tf + {k1} * (1 - {b} + {b} * dl.dl / st.avgdl))) AS s
       FROM qt JOIN post p USING (term) JOIN dfs ON dfs.field = p.field AND dfs.term = p.term
       JOIN st ON st.field = p.field JOIN dl ON dl.doc_id = p.doc_id AND dl.field = p.field
       GROUP BY ALL),
txt AS (SELECT qid, doc_id, max(s * boost) AS text_raw
        FROM fs JOIN (VALUES {boosts}) AS bo(field, boost) USING (field) GROUP BY ALL)"""


def _top_text(fields):
    return f"""WITH {bm25_sql(fields)}
SELECT qid, rank, doc_id, score, score AS text_score FROM (
  SELECT qid, doc_id, round(text_raw, 6) AS score,
         row_number() OVER (PARTITION BY qid ORDER BY round(text_raw, 6) DESC, doc_id) AS rank FROM txt)
WHERE rank <= 10"""


ONE_FIELD = {"text": 1.0}
THREE_FIELDS = {"text": 2.0, "source": 1.5, "lang": 1.0}


@register("bm25_top10", _top_text(ONE_FIELD))
def bm25_top10(spark, sf_dir):
    return search.text_search(text_docs(spark, sf_dir), text_questions(spark, sf_dir), ONE_FIELD)


@register("bm25_multifield", _top_text(THREE_FIELDS))
def bm25_multifield(spark, sf_dir):
    return search.text_search(text_docs(spark, sf_dir), text_questions(spark, sf_dir), THREE_FIELDS)


@register(
    "kb_postings",
    f"""SELECT doc_id, 'text' AS field, term, count(*) AS tf
FROM (SELECT doc_id, unnest({o.terms("text")}) AS term FROM documents) GROUP BY ALL""",
)
def kb_postings(spark, sf_dir):
    return search.postings(text_docs(spark, sf_dir), ["text"])


@register(
    "kb_term_counts",
    f"""WITH t AS (SELECT doc_id, {o.terms("text")} AS toks FROM documents)
SELECT 'text' AS field, term, count(DISTINCT doc_id) AS df, NULL::BIGINT AS total
FROM (SELECT doc_id, unnest(toks) AS term FROM t) GROUP BY term
UNION ALL SELECT 'text', '', count(*), CAST(sum(len(toks)) AS BIGINT) FROM t WHERE len(toks) > 0""",
)
def kb_term_counts(spark, sf_dir):
    return search.term_counts(text_docs(spark, sf_dir), ["text"])


def hybrid_docs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return text_docs(spark, sf_dir).join(e, "doc_id", "left")


HYBRID = f"""{bm25_sql(ONE_FIELD, "documents")},
vecs AS (
  SELECT b.item_id AS qid, d.doc_id,
         list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS vec_raw
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, documents d JOIN embeddings e ON e.vec_id = d.doc_id),
vtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(vec_raw, 6) DESC, doc_id) AS vr FROM vecs)
         WHERE vr <= 10),
asked AS (SELECT b.item_id AS qid FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id),
fused AS (
  SELECT qid, doc_id, coalesce(t.text_raw, 0) AS text_raw, v.vec_raw,
         round({1 - fv.HYBRID_ALPHA} * coalesce(t.text_raw, 0) + {fv.HYBRID_ALPHA} * coalesce(v.vec_raw, 0), 6) AS score
  FROM (SELECT * FROM txt WHERE qid IN (SELECT qid FROM asked)) t FULL JOIN vtop v USING (qid, doc_id)),
hits AS (SELECT * FROM (
  SELECT qid, doc_id, score, round(text_raw, 6) AS text_score, round(vec_raw, 6) AS vector_score,
         row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM fused)
  WHERE rank <= 10)"""


def hybrid_hits(spark, sf_dir, attach=None, **options):
    """Texts are indexed and attached as they are read: only ids and vectors are joined."""
    texts = text_docs(spark, sf_dir)
    index = text_index.write(texts, list(ONE_FIELD))
    hits = search.hybrid_search(hybrid_docs(spark, sf_dir), vector_questions(spark, sf_dir), ONE_FIELD, index=index, **options)
    return texts.select("doc_id", *attach).join(hits, "doc_id") if attach else hits


@register(
    "hybrid_top10",
    f"WITH {HYBRID} SELECT qid, rank, doc_id, score, text_score, vector_score FROM hits",
)
def hybrid_top10(spark, sf_dir):
    return hybrid_hits(spark, sf_dir)


@register(
    "hybrid_minmax",
    f"""WITH {HYBRID.replace("hits AS", "plain_hits AS")},
ttop AS (SELECT * FROM (SELECT qid, doc_id, round(text_raw, 6) AS t, row_number() OVER (PARTITION BY qid ORDER BY round(text_raw, 6) DESC, doc_id) AS n
         FROM txt WHERE qid IN (SELECT qid FROM asked)) WHERE n <= 10),
tu AS (SELECT qid, doc_id, t, CASE WHEN max(t) OVER q = min(t) OVER q THEN 1 ELSE (t - min(t) OVER q) / (max(t) OVER q - min(t) OVER q) END AS tu
       FROM ttop WINDOW q AS (PARTITION BY qid)),
vu AS (SELECT qid, doc_id, v, CASE WHEN max(v) OVER q = min(v) OVER q THEN 1 ELSE (v - min(v) OVER q) / (max(v) OVER q - min(v) OVER q) END AS vu
       FROM (SELECT qid, doc_id, round(vec_raw, 6) AS v FROM vtop) WINDOW q AS (PARTITION BY qid)),
both_lists AS (SELECT qid, doc_id, coalesce(t, 0) AS text_score, v AS vector_score,
       round({1 - fv.HYBRID_ALPHA} * coalesce(tu, 0) + {fv.HYBRID_ALPHA} * coalesce(vu, 0), 6) AS score FROM tu FULL JOIN vu USING (qid, doc_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM both_lists) WHERE rank <= 10""",
)
def hybrid_minmax(spark, sf_dir):
    return hybrid_hits(spark, sf_dir, normalize="minmax")


@register(
    "threshold",
    f"WITH {HYBRID} SELECT qid, rank, doc_id, score, text_score, vector_score FROM hits WHERE score >= 5.0",
)
def threshold(spark, sf_dir):
    return search.above_threshold(hybrid_hits(spark, sf_dir), 5.0)


def cited_hits(spark, sf_dir):
    """Hybrid hits with documents in the role of past queries."""
    return hybrid_hits(spark, sf_dir, attach=["text", "lang", "source"]).select(
        "qid",
        "rank",
        "score",
        F.col("text").alias("sql_query"),
        F.col("source").alias("notebook_path"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("context_before"),
        F.lit(None).cast("string").alias("context_after"),
        F.array("lang").alias("tables_used"),
        F.col("source").alias("query_type"),
    )


@register(
    "citations",
    f"""WITH {HYBRID}
SELECT h.qid, h.rank, d.text AS sql_query, h.score AS similarity_score, d.source AS notebook_path,
       CASE WHEN d.lang <> 'en' THEN d.lang ELSE '' END AS context_before, '' AS context_after,
       d.lang AS tables_used, d.source AS query_type
FROM hits h JOIN documents d USING (doc_id)""",
)
def citations(spark, sf_dir):
    grouped = search.citations(cited_hits(spark, sf_dir))
    return (
        grouped.select("qid", F.explode("citations").alias("c"))
        .select("qid", "c.*")
        .withColumn("tables_used", F.array_join("tables_used", ","))
    )


def _indexed(spark, sf_dir):
    path = new_dir(spark, "vectors")
    vector_index.write(vector_docs(spark, sf_dir), path)
    return path


@register("knn_indexed", _knn())
def knn_indexed(spark, sf_dir):
    """The stored index with all buckets of a table probed: the exact result."""
    path = _indexed(spark, sf_dir)
    return vector_index.indexed_search(spark, path, vector_questions(spark, sf_dir), probes=None)


@register("knn_recall")
def knn_recall(spark, sf_dir):
    """Share of the exact best ten that the index finds."""
    questions = vector_questions(spark, sf_dir)
    near = vector_index.indexed_search(spark, _indexed(spark, sf_dir), questions)
    exact = search.vector_search(vector_docs(spark, sf_dir), questions)
    found = exact.join(near.select("qid", "doc_id", F.lit(1).alias("hit")), ["qid", "doc_id"], "left")
    return found.groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


@register("knn_lsh_recall")
def knn_lsh_recall(spark, sf_dir):
    """One row: mean recall of the index against the exact best ten, and the share of all pairs that were compared."""
    questions, docs = vector_questions(spark, sf_dir), vector_docs(spark, sf_dir)
    path = _indexed(spark, sf_dir)
    near = vector_index.indexed_search(spark, path, questions).select("qid", "doc_id", F.lit(1).alias("hit"))
    found = search.vector_search(docs, questions).join(near, ["qid", "doc_id"], "left")
    pairs = vector_index.candidates(spark, path, questions).agg(F.count("*").alias("compared")).scalar()
    n_docs, n_questions = docs.agg(F.count("*")).scalar(), questions.agg(F.count("*")).scalar()
    return found.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.max(pairs / (n_docs * n_questions)).alias("share"))


@register("knn_lsh_filtered")
def knn_lsh_filtered(spark, sf_dir):
    """Mean recall of the index under a filter, where every question gets all the hits that it asks for."""
    questions = vector_questions(spark, sf_dir)
    hits = vector_index.indexed_search(spark, _indexed(spark, sf_dir), questions, filters={"label": [1, 3]})
    exact = search.vector_search(vector_docs(spark, sf_dir), questions, filters={"label": [1, 3]})
    found = exact.join(hits.select("qid", "doc_id", F.lit(1).alias("hit")), ["qid", "doc_id"], "left")
    full = hits.groupBy("qid").count().filter(F.col("count") == 10).agg(F.count("*")).scalar()
    return found.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.countDistinct("qid").alias("questions"), F.max(full).alias("answered"))
