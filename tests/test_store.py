import json
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from querylode import fixed_values as fv
from querylode.operators import schema_match
from querylode.operators.search import term_counts
from querylode.operators.store import KnowledgeBase, latest
from querylode.plans import answer as ans
from querylode.plans.build import build, rebuild
from querylode.sources import catalog
from querylode.sources import notebooks as nb
from querylode.streaming import ingest

CATALOG_TABLES = [("sales", "orders_fact", "sales.orders_fact", "All orders"), ("crm", "users_dim", "crm.users_dim", None)]
CATALOG_COLUMNS = [
    ("sales.orders_fact", 0, "id", "bigint", "key", False),
    ("sales.orders_fact", 1, "amount", "double", None, False),
    ("sales.orders_fact", 2, "dt", "date", None, True),
    ("crm.users_dim", 0, "id", "bigint", None, False),
]


def described(spark):
    return (
        spark.createDataFrame(CATALOG_TABLES, "database string, name string, table_key string, description string"),
        spark.createDataFrame(CATALOG_COLUMNS, catalog.COLUMNS_SCHEMA),
    )


def notebook(*cells):
    return json.dumps({"cells": [{"cell_type": t, "source": s} for t, s in cells]})


A = notebook(("markdown", "order totals"), ("code", "SELECT SUM(amount) FROM orders_fact WHERE orders_fact.dt > 1"), ("code", "SELECT 2 FROM users_dim"))
A2 = notebook(("markdown", "order totals"), ("code", "SELECT COUNT(*) FROM orders_fact"))
B = notebook(("code", "SELECT u.id FROM users_dim u JOIN orders_fact o ON u.id = o.id"), ("markdown", "users with orders"))
NO_SQL = notebook(("code", "print(1)"))


def raw(spark, files):
    return spark.createDataFrame([(p, v, None) for p, v in files.items()], nb.RAW_SCHEMA)


def content(kb):
    skip = ("embedding", "updated_at", "version")
    rows = kb.documents().drop(*skip).collect()
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in rows)


def counts(kb):
    return sorted((r["field"], r["term"], r["df"], r["total"] or 0) for r in kb.counts().collect())


def test_latest_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "id string, v int, t string")
    assert {(r["id"], r["t"]) for r in latest(df, "id", "v").collect()} == {("a", "z"), ("b", "q")}
    plan = latest(df, "id", "v")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_build_and_rebuild(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    report = build(kb, raw(spark, {"d/a.ipynb": A, "d/b.ipynb": B, "d/c.ipynb": NO_SQL, "d/x.ipynb": "{"}), described(spark))
    assert (report.ok, report.notebooks, report.extracts, report.indexed, report.tables) == (True, 3, 3, 3, 2)
    stats = kb.stats().first()
    assert (stats["document_count"], stats["meta_count"], stats["status"]) == (3, 2, "healthy")
    assert stats["index_size"] > 0
    doc = kb.documents().filter(F.col("sql_query").contains("SUM")).first()
    assert doc["tables_used"] == ["orders_fact"] and doc["aggregations"] == ["SUM"]
    assert doc["context_before"] == "order totals" and len(doc["embedding"]) == fv.EMBED_DIM
    assert kb.get(doc["doc_id"]).first()["query_type"] == "SELECT"
    assert kb.get("nobody").count() == 0 and "embedding" not in kb.get("nobody").columns
    context = {r["schema_context"] for r in kb.schema_context().collect()}
    assert context == {
        "sales.orders_fact: 2 columns",
        "crm.users_dim: 1 columns",
        "sales.orders_fact: 2 columns; crm.users_dim: 1 columns",
    }
    lines = [r["line"] for r in kb.meta_lines("schema_metadata").orderBy("ord").collect()]
    assert lines == [
        "\n## Table: crm.users_dim", "Columns:", "  - id (bigint)",
        "\n## Table: sales.orders_fact", "Description: All orders", "Columns:", "  - id (bigint) - key",
        "  - amount (double)", "Partition Keys:", "  - dt (date)",
    ]
    assert rebuild(kb, raw(spark, {"d/b.ipynb": B}), described(spark)).ok
    assert kb.documents().count() == 1
    kb.drop()
    assert kb.documents().count() == 0
    kb.drop()


@pytest.mark.parametrize("files,message", [({}, "No notebooks found"), ({"a.ipynb": NO_SQL}, "No SQL extracts found")])
def test_build_stops_early(spark, tmp_path, files, message):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    report = build(kb, raw(spark, files))
    assert not report.ok and report.message == message and kb.documents().count() == 0


def test_no_embeddings(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    report = build(kb, raw(spark, {"a.ipynb": A}), embedder=lambda text: F.lit(None).cast("array<float>"))
    assert (report.ok, report.message, report.extracts) == (False, "No documents with embeddings", 2)


def test_incremental_equals_full(spark, tmp_path):
    step = KnowledgeBase(spark, str(tmp_path / "step"))
    ingest.apply_batch(step, raw(spark, {"d/a.ipynb": A, "d/c.ipynb": B}), "s:0", described(spark))
    ingest.apply_batch(step, raw(spark, {"d/a.ipynb": A2, "d/b.ipynb": B}), "s:1", described(spark))
    assert ingest.apply_batch(step, raw(spark, {"d/a.ipynb": A}), "s:1") is None
    ingest.apply_batch(step, raw(spark, {"d/c.ipynb": NO_SQL}), "s:2", described(spark))
    whole = KnowledgeBase(spark, str(tmp_path / "whole"))
    build(whole, raw(spark, {"d/a.ipynb": A2, "d/b.ipynb": B, "d/c.ipynb": NO_SQL}), described(spark), force=True)
    assert content(step) == content(whole) and len(content(step)) == 2
    assert counts(step) == counts(whole)
    direct = term_counts(whole.documents(), list(fv.FIELD_BOOSTS)).collect()
    assert counts(whole) == sorted((r["field"], r["term"], r["df"], r["total"] or 0) for r in direct)


def test_a_failed_load_stays_invisible(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    build(kb, raw(spark, {"d/a.ipynb": A}))
    before = content(kb)
    version = kb.next_version()
    kb.write_documents(kb.documents(), version)
    kb.mark_stale(version, kb.documents())
    assert content(kb) == before
    build(kb, raw(spark, {"d/b.ipynb": B}))
    assert len(content(kb)) == len(before) + 1


def test_index_replaces_by_id(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    build(kb, raw(spark, {"d/a.ipynb": A, "d/b.ipynb": B}))
    changed = kb.documents().filter(F.col("sql_query").contains("SUM")).withColumn("table_pattern", F.lit("new"))
    assert kb.index(changed) == 1
    assert kb.documents().count() == 3
    assert kb.documents().filter("table_pattern = 'new'").count() == 1


def test_stream_and_catch_up(spark, tmp_path):
    files, kb = tmp_path / "files", KnowledgeBase(spark, str(tmp_path / "kb"))
    files.mkdir()
    checkpoint = str(tmp_path / "checkpoint")
    (files / "a.ipynb").write_text(A)
    ingest.start(kb, str(files), checkpoint).awaitTermination()
    assert kb.documents().count() == 2
    (files / "b.ipynb").write_text(B)
    ingest.start(kb, str(files), checkpoint).awaitTermination()
    assert kb.documents().count() == 3
    (files / "a.ipynb").write_text(A2)
    later = time.time() + 5
    os.utime(files / "a.ipynb", (later, later))
    ingest.catch_up(kb, str(files))
    assert sorted(r["sql_query"] for r in kb.documents().collect()) == sorted(
        ["SELECT COUNT(*) FROM orders_fact", "SELECT u.id FROM users_dim u JOIN orders_fact o ON u.id = o.id"]
    )


def test_late_emptied_and_missing_files(spark, tmp_path):
    """Whatever time a file has, it is read once; patterns forget a notebook that lost its SQL."""
    kb, files = KnowledgeBase(spark, str(tmp_path / "kb")), tmp_path / "files"
    files.mkdir()
    (files / "b.ipynb").write_text(B)
    assert ingest.catch_up(kb, str(files)).indexed == 1
    (files / "late.ipynb").write_text(A)
    old = time.time() - 86_400
    os.utime(files / "late.ipynb", (old, old))
    assert ingest.catch_up(kb, str(files)).indexed == 2
    assert not ingest.catch_up(kb, str(files)).ok  # nothing new
    assert any("users_dim" in r["key"] for r in kb.usage().collect())
    for name in ("b.ipynb", "late.ipynb"):
        (files / name).write_text(NO_SQL)
        os.utime(files / name, (old + 60, old + 60))
    assert ingest.catch_up(kb, str(files)).message == "nothing to index"
    assert kb.documents().count() == kb.usage().count() == kb.meta_lines("business_patterns").count() == 0
    both = nb.read_files(spark, [str(files), str(tmp_path / "nowhere")])
    assert both.count() == 2 and nb.read_files(spark, [str(tmp_path / "nowhere")]).count() == 0


def test_usage_survives_other_loads(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    build(kb, raw(spark, {"d/a.ipynb": A, "d/b.ipynb": B}))
    before = sorted(map(tuple, kb.usage().collect()))
    kb.index(kb.documents().drop("version"))
    assert before and sorted(map(tuple, kb.usage().collect())) == before
    versions = {kb.next_version() for _ in range(20)}
    assert len(versions) == 20 and min(versions) > max(r["version"] for r in kb.commits())


def test_answers(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    build(kb, raw(spark, {"d/a.ipynb": A, "d/b.ipynb": B}), described(spark))
    asked = spark.createDataFrame(
        [(1, "order totals from orders_fact"), (2, "???"), (3, "users with orders"), (4, "users")], "qid int, question string"
    )
    seen = {}

    def reply(prompts):
        seen.update({r["qid"]: r["prompt"] for r in prompts.collect()})
        return spark.createDataFrame(
            [(1, "SQL Query: ```sql\nSELECT 1\n-- why\nFROM t;;\n```\nConfidence: 0.9\nExplanation: one\n\nx"),
             (3, "- SQL Query: DROP TABLE t\n- Confidence: 0.7.\n- Explanation: two"), (4, "no idea")],
            "qid int, reply string",
        )

    rows = {r["qid"]: r for r in ans.answer(kb, asked, reply, size=2).collect()}
    assert rows[1]["sql_query"] == "SELECT 1 FROM t;" and rows[1]["confidence"] == 0.9
    assert rows[1]["explanation"] == "one" and rows[1]["validation"]["is_valid"]
    assert len(rows[1]["citations"]) == 2 and "SUM" in rows[1]["citations"][0]["sql_query"]
    assert rows[3]["confidence"] == 0.7
    assert rows[3]["validation"]["message"] == fv.MSG_DANGEROUS + "DROP"
    assert (rows[4]["sql_query"], rows[4]["confidence"], rows[4]["explanation"]) == ("", 0.0, fv.MSG_NO_SQL)
    # "???" still has the word "question" of its search text, so it is embedded and finds documents.
    assert rows[2]["explanation"] == fv.MSG_NO_SQL
    assert set(seen) == {1, 2, 3, 4}
    p = seen[1]
    assert p.startswith("Context Information:\n## Available Tables and Schemas\n\n## Table: crm.users_dim\nColumns:")
    assert "\n\n## Common Business Patterns\n## Common Table Relationships\n- users_dim commonly joined with: orders_fact" in p
    assert "\n### Example 1 (similarity: " in p and "Context: order totals\nSQL: SELECT SUM" in p
    assert p.endswith("User Question: order totals from orders_fact\n\nPlease generate a SQL query to answer this question.")
    empty = KnowledgeBase(spark, str(tmp_path / "empty"))
    hits = ans.retrieve(empty, ans.embedded(asked))
    none = ans.results(ans.embedded(asked), hits, reply(asked.withColumn("prompt", F.lit(""))))
    assert {r["explanation"] for r in none.collect()} == {fv.MSG_NO_HITS}
    blank = ans.embedded(asked, embedder=lambda t: F.lit(None).cast("array<float>"))
    assert {r["explanation"] for r in ans.results(blank, hits, reply(asked.withColumn("prompt", F.lit("")))).collect()} == {fv.MSG_NO_EMBEDDING}


def test_name_match_is_contains(spark):
    keys = ["a.sales", "b.sales_fact", "zz.Users", "db.x", "db.orders_sales"]
    names = ["sales", "users", "X", "es_f", "missing", "b.s", "orders"]
    cat = spark.createDataFrame([(k, len(k)) for k in keys], "table_key string, n_columns int")
    df = spark.createDataFrame([(n,) for n in names], "table_name string")
    got = {r["wanted"]: r["table_key"] for r in schema_match.name_lookup(df, cat).collect()}
    expected = {}
    for n in names:
        found = sorted(k for k in keys if n.lower() in k.lower())
        if found:
            expected[n.lower()] = found[0]
    assert got == expected


def test_pieces_of_a_key_grow_with_its_length(spark):
    key = spark.createDataFrame([("warehouse_of_the_northern_region.daily_landings_by_harbour_and_boat",)], "k string")
    pieces = key.select(F.size(F.flatten(F.array(*[schema_match.grams(F.col("k"), F.lit(q)) for q in (1, 2, 3)])))).first()[0]
    assert pieces <= 3 * len(key.first()[0])


def test_metastore_catalog(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS meta LOCATION '{tmp_path}/meta.db'")
    spark.sql("CREATE TABLE meta.facts (id BIGINT COMMENT 'key', v STRING, dt DATE) USING parquet PARTITIONED BY (dt) COMMENT 'Facts'")
    try:
        assert "meta" in catalog.databases(spark) and catalog.tables_of(spark, "meta") == ["facts"]
        tables, columns = catalog.from_metastore(spark, [("meta", "facts"), ("meta", "nothing"), ("nowhere", "x")])
        row = tables.first()
        assert (tables.count(), row["table_key"], row["description"]) == (1, "meta.facts", "Facts")
        assert row["location"].endswith("meta.db/facts") and row["table_type"] == "MANAGED"
        got = [(c["name"], c["type"], c["comment"], c["is_partition"]) for c in columns.orderBy("pos").collect()]
        assert got == [("id", "bigint", "key", False), ("v", "string", None, False), ("dt", "date", None, True)]
    finally:
        spark.sql("DROP DATABASE meta CASCADE")


def test_targets(spark):
    specs = spark.createDataFrame([("a.x",), ("a.y.z",), ("bad",), ("a.x",)], "spec string")
    available = spark.createDataFrame([("a", "x"), ("b", "q"), ("c", "r")], "database string, name string")
    listed = spark.createDataFrame([("b",), ("b",)], "database string")
    got = sorted(tuple(r) for r in catalog.targets(specs, available, listed).collect())
    assert got == [("a", "x"), ("a", "y.z"), ("b", "q")]
    assert [r[0] for r in catalog.bad_specs(specs).collect()] == ["bad"]


def test_plans(spark, tmp_path):
    """Loading shuffles nothing; searching reads only the columns it needs and makes no pairs."""
    from querylode.plans.build import documents

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "Exchange" not in plan(documents(nb.extracts(nb.parse(raw(spark, {"d/a.ipynb": A})))))
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    build(kb, raw(spark, {"d/a.ipynb": A, "d/b.ipynb": B}), described(spark))
    asked = ans.embedded(spark.createDataFrame([(1, "order totals")], "qid int, question string"))
    shown = plan(ans.retrieve(kb, asked))
    assert "CartesianProduct" not in shown and "NestedLoop" not in shown
    scans = re.findall(r"ReadSchema: struct<([^\n]*)", shown)
    assert scans and all("cell_metadata" not in s and "subqueries" not in s for s in scans)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,x)]" in plan(kb.get("x"))


def test_date_filters_follow_loads(spark, tmp_path):
    """Date filters are kept per load: the description is that of a full build, and no older document is read for it."""
    dated = notebook(("code", "SELECT DATE_TRUNC('day', t.d) FROM t WHERE t.day > 1 AND x = 2 AND year = 3"))
    other = notebook(("code", "SELECT DATEADD(day, 1, d) FROM u WHERE u.day = 4"), ("code", "SELECT 1 FROM u WHERE u.day = 5"))
    step, whole = (KnowledgeBase(spark, str(tmp_path / n)) for n in ("step", "whole"))
    build(step, raw(spark, {"d/a.ipynb": dated, "d/b.ipynb": other}))
    build(step, raw(spark, {"d/a.ipynb": other}))
    build(step, raw(spark, {"d/b.ipynb": dated, "d/c.ipynb": A}))
    build(whole, raw(spark, {"d/a.ipynb": other, "d/b.ipynb": dated, "d/c.ipynb": A}))

    def shown(df):
        return sorted(map(tuple, df.select("notebook_path", "cell_index", "pos", "filter").collect()))

    assert shown(step.date_filters()) == shown(whole.date_filters()) == [
        ("d/a.ipynb", 0, 0, "u.day = 4"), ("d/b.ipynb", 0, 0, "t.day > 1"), ("d/b.ipynb", 0, 2, "year = 3"),
    ]
    lines = [sorted(map(tuple, kb.meta_lines("business_patterns").collect())) for kb in (step, whole)]
    assert lines[0] == lines[1] and any("u.day = 4" in line for _, line in lines[0])
    plan = step.date_filters(step.next_version())._jdf.queryExecution().executedPlan().toString()
    assert "date_filters" in plan and "business_context" not in plan and f"{tmp_path}/step/docs" not in plan


def test_pieces_filters_and_threshold(spark, tmp_path):
    long = notebook(("code", "SELECT a FROM harbours WHERE " + " AND ".join(f"k{i} = {i}" for i in range(200)) + " AND lighthouse = 1"))
    short = notebook(("code", "SELECT lighthouse, tide FROM coast"))
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    build(kb, raw(spark, {"d/a.ipynb": long, "d/b.ipynb": short, "d/c.ipynb": B}), chunk_size=40)
    pieces = {r["doc_id"]: r["n"] for r in kb.chunks().groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    texts = {r["doc_id"]: r for r in kb.documents().collect()}
    assert all(0 < n <= -(-len(texts[d]["business_context"]) // 40) for d, n in pieces.items()) and len(pieces) == 3
    asked = ans.embedded(spark.createDataFrame([(1, "harbours lighthouse"), (2, "coast tide")], "qid int, question string"))

    # Best piece of every document by brute force.
    questions = {r["qid"]: r["embedding"] for r in asked.collect()}
    best = {}
    for r in kb.chunks().collect():
        for q, v in questions.items():
            score = sum(x * y for x, y in zip(v, r["embedding"]))
            best[q, r["doc_id"]] = max(best.get((q, r["doc_id"]), -1), round(score, 6))
    got = ans.retrieve(kb, asked, size=2, hybrid=False, by_chunks=True).collect()
    for q in questions:
        order = sorted((-s, d) for (p, d), s in best.items() if p == q)[:2]
        mine = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["qid"] == q)
        assert [(d, s) for _, d, s in mine] == [(d, pytest.approx(-s, abs=2e-6)) for s, d in order]

    only = {"tables_used": ["coast", "nowhere"]}
    for options in ({}, {"hybrid": False}, {"by_chunks": True}, {"normalize": "minmax"}):
        hits = ans.retrieve(kb, asked, filters=only, **options).collect()
        assert {(r["qid"], r["notebook_path"]) for r in hits} == {(1, "d/b.ipynb"), (2, "d/b.ipynb")}, options
    hits = ans.retrieve(kb, asked).collect()
    bar = sorted(r["score"] for r in hits)[len(hits) // 2]
    above = ans.retrieve(kb, asked, threshold=bar).collect()
    assert {(r["qid"], r["doc_id"]) for r in above} == {(r["qid"], r["doc_id"]) for r in hits if r["score"] >= bar}
    assert ans.retrieve(kb, asked, filters={"tables_used": ["nowhere"]}).count() == 0
    with pytest.raises(ValueError):
        build(kb, raw(spark, {"d/a.ipynb": short}), chunk_size=0)

    # A replaced document takes its pieces along; one loaded without pieces has no vector by pieces.
    build(kb, raw(spark, {"d/a.ipynb": short}))
    assert kb.chunks().select("doc_id").distinct().count() == 2
    assert kb.documents().count() == 3 and ans.retrieve(kb, asked, hybrid=False, by_chunks=True).filter("qid = 1").count() == 2


def test_statistics(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "shelf"))
    assert tuple(kb.stats().drop("index_size").first()) == (0, 0, 0, 0, None, None, "shelf", "healthy")
    build(kb, raw(spark, {"d/a.ipynb": A, "d/b.ipynb": B}), described(spark), source="night run")
    build(kb, raw(spark, {"d/a.ipynb": A2}), model="mine")
    assert tuple(kb.stats().drop("index_size").first()) == (2, 2, 2, 2, "build", "mine", "shelf", "healthy")
    lost = kb.next_version()
    kb.commit(lost, "lost", 3)
    assert kb.stats().first()["status"] == "incomplete"


def test_results_have_schema_and_time(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    build(kb, raw(spark, {"d/a.ipynb": A}), described(spark))
    asked = spark.createDataFrame([(1, "order totals"), (2, "x")], "qid int, question string")
    replies = spark.createDataFrame([(1, "SQL Query: ```sql\nSELECT 1\n```")], "qid int, reply string")
    rows = {r["qid"]: r for r in ans.answer(kb, asked, lambda p: replies, filters={"tables_used": ["orders_fact"]}).collect()}
    assert rows[1]["schema_context"].startswith("\n## Table: sales.orders_fact\nDescription: All orders\nColumns:\n")
    assert rows[1]["execution_time"] == rows[2]["execution_time"] > 0
    assert ans.results(ans.embedded(asked), ans.retrieve(kb, ans.embedded(asked)), replies).first()["execution_time"] == 0


def test_unchanged_cells_stay(spark, tmp_path):
    """Cells that are as they were are neither embedded nor written; the base is that of a full build."""
    longer = notebook(("code", "SELECT 7 FROM users_dim"), ("code", "SELECT 8 FROM ports"), ("code", "SELECT 9 FROM ports"))
    edited = notebook(("code", "SELECT 7 FROM users_dim"), ("code", "SELECT 88 FROM ports"))
    step, whole = (KnowledgeBase(spark, str(tmp_path / n)) for n in ("step", "whole"))
    build(step, raw(spark, {"d/a.ipynb": A, "d/b.ipynb": longer}))
    first = step.commits()[-1]["version"]
    new = raw(spark, {"d/a.ipynb": A, "d/b.ipynb": edited, "d/c.ipynb": B})
    report = build(step, new, skip_unchanged=True)
    assert (report.ok, report.extracts, report.indexed, report.kept) == (True, 5, 2, 3)
    assert step.documents().filter(F.col("version") == first).count() == 3
    build(whole, new)
    lines = [sorted(map(tuple, kb.meta_lines("business_patterns").collect())) for kb in (step, whole)]
    assert content(step) == content(whole) and counts(step) == counts(whole) and lines[0] == lines[1]
    asked = ans.embedded(spark.createDataFrame([(1, "users ports orders")], "qid int, question string"))
    hits = [sorted((r["doc_id"], r["rank"], r["score"]) for r in ans.retrieve(kb, asked).collect()) for kb in (step, whole)]
    assert hits[0] == hits[1]
    again = build(step, new, skip_unchanged=True)
    assert (again.ok, again.indexed, again.kept) == (True, 0, 5) and content(step) == content(whole)
    other = build(step, new, skip_unchanged=True, model="another")
    assert (other.indexed, other.kept) == (5, 0) and content(step) == content(whole)
    docs = step.documents().drop("version")
    assert step.index(docs) == 5 and step.index(docs.withColumn("updated_at", F.current_timestamp()), skip_unchanged=True) == 0
    edit = docs.withColumn("query_type", F.when(F.col("notebook_path") == "d/c.ipynb", "X").otherwise(F.col("query_type")))
    assert step.index(edit, skip_unchanged=True) == 1 and step.documents().count() == 5


def test_compaction(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    build(kb, raw(spark, {"d/a.ipynb": A, "d/b.ipynb": B}), described(spark), source="one", chunk_size=50)
    build(kb, raw(spark, {"d/a.ipynb": A2}), source="two", chunk_size=50)
    asked = ans.embedded(spark.createDataFrame([(1, "order totals"), (2, "users")], "qid int, question string"))

    def seen():
        rows = lambda df: sorted(json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.collect())
        return (
            content(kb), counts(kb), rows(kb.usage()), rows(kb.files()), rows(kb.date_filters().drop("version")),
            rows(kb.chunks().drop("version")), rows(kb.digests().drop("version")), rows(kb.meta_lines("business_patterns")),
            rows(kb.meta_lines("schema_metadata")), rows(kb.schema_context().join(kb.documents(), ["doc_id", "version"]).select("doc_id", "schema_context")),
            rows(kb.text_index().postings), rows(ans.retrieve(kb, asked).select("qid", "doc_id", "rank", "score")),
            rows(kb.stats().drop("index_size")),
        )

    before = seen()
    kb.compact()
    assert len(kb.commits()) == 1 and seen() == before
    assert kb.is_committed("one") and kb.is_committed("two")
    kb.compact()
    assert len(kb.commits()) == 1
    build(kb, raw(spark, {"d/b.ipynb": A}))
    whole = KnowledgeBase(spark, str(tmp_path / "whole"))
    build(whole, raw(spark, {"d/a.ipynb": A2, "d/b.ipynb": A}))
    assert content(kb) == content(whole) and counts(kb) == counts(whole)
    kb.create(force=True)
    assert not kb.is_committed("one") and kb.documents().count() == 0


def test_catch_up_by_batches(spark, tmp_path):
    kb, files = KnowledgeBase(spark, str(tmp_path / "kb")), tmp_path / "files"
    files.mkdir()
    for i in range(5):
        (files / f"{i}.ipynb").write_text(A)
    report = ingest.catch_up(kb, str(files), files_per_batch=2)
    assert (report.ok, report.notebooks, report.indexed) == (True, 5, 10) and kb.documents().count() == 10
    (files / "3.ipynb").write_text(A.replace("SELECT 2", "SELECT 3"))
    later = time.time() + 5
    os.utime(files / "3.ipynb", (later, later))
    report = ingest.catch_up(kb, str(files), files_per_batch=2)
    assert (report.notebooks, report.indexed, report.kept) == (1, 1, 1) and kb.documents().count() == 10
    assert kb.documents().filter("sql_query LIKE 'SELECT 3%'").count() == 1


def test_patterns_of_the_tables_in_use(spark):
    lines = [(["1", ""], "H1"), (["1", "a"], "a with b"), (["1", "z"], "z with b"), (["2", ""], "H2"), (["2", "z"], "z: f"),
             (["3", ""], "H3"), (["3", "a"], "a: SUM"), (["4", ""], "H4"), (["4", "d > 1"], "- d > 1")]
    stored = spark.createDataFrame(lines, "ord array<string>, line string")
    hits = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (2, ["z"]), (3, []), (4, None), (5, [""])], "qid int, tables_used array<string>")
    from querylode.operators import render

    got = {r["qid"]: r["patterns_text"] for r in render.patterns_of(hits, stored).collect()}
    dates = "H4\n- d > 1"
    assert got == {1: f"H1\na with b\nH3\na: SUM\n{dates}", 2: f"H1\nz with b\nH2\nz: f\n{dates}", 3: dates, 4: dates, 5: dates}
    none = render.patterns_of(hits, stored.limit(0)).collect()
    assert {r["patterns_text"] for r in none} == {""}


def test_query_log(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    assert kb.query_log().count() == 0
    for i in (1, 2):
        kb.log(spark.createDataFrame([(f"q{i}", "SELECT 1", 0.5, "x")], "question string, sql_query string, confidence double, other string"))
    kb.create(force=True)
    assert [r["question"] for r in kb.query_log().orderBy("asked_at").collect()] == ["q1", "q2"]


def test_counts_come_from_postings(spark, tmp_path):
    """Rows that share an id are one document in both; replacing them leaves nothing of their words."""
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    build(kb, raw(spark, {"d/a.ipynb": A}))
    kept = {(r.field, r.term): (r.df, r.total) for r in kb.counts().collect()}
    doc = kb.documents().drop("version").limit(1)
    twice = doc.withColumn("doc_id", F.lit("same")).withColumn("sql_query", F.explode(F.array(F.lit("zig zag"), F.lit("zig zug"))))
    kb.index(twice)
    counts = {r.term: r.df for r in kb.counts().filter("field = 'sql_query'").collect()}
    postings = {r.term: r["count"] for r in kb.text_index().postings.filter("field = 'sql_query'").groupBy("term").count().collect()}
    assert counts == postings and counts["zig"] == counts["zag"] == 1
    kb.index(twice.withColumn("sql_query", F.lit("other")).limit(1))
    left = {r.term for r in kb.counts().collect()}
    assert "other" in left and not left & {"zig", "zag", "zug"}
    assert {k[1] for k in kept} <= left
