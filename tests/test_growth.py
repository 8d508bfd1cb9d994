"""What must not grow with the tables: words that are shuffled, texts that are joined, vectors that are made twice."""

import re

from pyspark.sql import functions as F

from checks import search_queries
from querylode import tables
from querylode.functions import sqlfeatures as sf
from querylode import session
from querylode.operators import render, schema_match, search, text_index
from querylode.operators.store import KnowledgeBase
from querylode.plans import build


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_counted_without_a_shuffle_of_words(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, "A"), (3, " "), (4, None)], "doc_id long, text string")
    found = text_index.postings(docs, ["text"])
    assert "hashpartitioning" not in re.sub("hashpartitioning\\(doc_id", "", _plan(found))
    rows = {tuple(r) for r in found.select("doc_id", "term", "tf", "dl").collect()}
    assert rows == {(1, "", 1, 3), (1, "a", 1, 3), (1, "b", 2, 3), (2, "", 1, 1), (2, "a", 1, 1)}


def test_postings_of_a_repeated_id_are_one_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "b"), (2, "a"), (None, "c"), (None, "c")], "doc_id long, text string")
    rows = text_index.postings(docs, ["text"]).filter("term <> ''").select("doc_id", "term", "tf").collect()
    assert {tuple(r) for r in rows} == {(1, "a", 1), (1, "b", 2), (2, "a", 1), (None, "c", 2)} and len(rows) == 4


def test_hybrid_queries_index_texts_as_they_are_read(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(text_index, "write", lambda docs, *_: seen.append(_plan(docs)) or 1 / 0)
    try:
        search_queries.hybrid_hits(spark, "/root/testdata/sf0.001")
    except ZeroDivisionError:
        pass
    assert len(seen) == 1 and "Join" not in seen[0]


def test_vectors_of_pieces_are_made_once(spark):
    docs = spark.createDataFrame([("d", "one two"), ("e", "!!")], "doc_id string, business_context string")
    made = build.chunk_vectors(docs, 4)
    assert len(re.findall("fill\\(", _plan(made))) == 1
    assert [(r[0], r[1], len(r[2])) for r in made.orderBy("chunk").collect()] == [("d", 0, 1024), ("d", 1, 1024)]


def test_texts_without_a_join_or_a_qualifier_are_not_walked(spark):
    docs = spark.createDataFrame([("SELECT a FROM t WHERE b = 1",)], "sql_query string")
    plan = _plan(sf.with_features(docs))
    assert len(re.findall(r"run\(CASE WHEN", plan)) >= 3
    row = sf.with_features(docs).first()
    assert (row["joins"], row["subqueries"], row["qualified_columns"], row["filters"]) == ([], [], [], ["b = 1"])


def test_postings_lie_as_their_documents_do(spark, tmp_path):
    """Nothing is sorted to write them, and a document's are in one place."""
    docs = spark.createDataFrame([(i, f"a b word{i}") for i in range(50)], "doc_id long, text string").coalesce(1)
    index = text_index.write(docs, ["text"], str(tmp_path))
    ids = [r["doc_id"] for r in index.postings.coalesce(1).collect()]
    assert len(ids) == 200 and sum(a != b for a, b in zip(ids, ids[1:])) == 49


def test_a_larger_input_means_more_tasks(spark, tmp_path):
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(k) for k in settings]
    spark.range(40_000, numPartitions=1).write.option("parquet.block.size", "20000").parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")

    def sizes(batches):
        for batch in batches:
            yield batch.slice(0, 0) if batch.num_rows <= 1_000 else batch

    with session.small_tasks(spark, 20_000):
        assert spark.read.parquet(f"{tmp_path}/t").rdd.getNumPartitions() > 4
        assert rows.mapInArrow(sizes, "id long").count() == 0
    assert [spark.conf.get(k) for k in settings] == before
    spark.conf.set(settings[0], "4k")
    try:
        with session.small_tasks(spark, 20_000):
            assert spark.conf.get(settings[0]) == "4096"
    finally:
        spark.conf.set(settings[0], before[0])


def _seen(monkeypatch, module):
    seen, stored = {}, session.stored

    def noted(df, name):
        conf = df.sparkSession.conf
        seen[name] = (_plan(df), conf.get("spark.sql.files.maxPartitionBytes"), conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return stored(df, name)

    monkeypatch.setattr(module, "stored", noted)
    return seen


def test_postings_are_not_shuffled_to_look_up_a_few_documents(spark, tmp_path, monkeypatch):
    rows = [(i, "common " * (1 + i % 3) + ("often " if i % 3 == 0 else "") + f"rare{i // 4}") for i in range(400)]
    index = text_index.write(spark.createDataFrame(rows, "doc_id long, text string"), ["text"], str(tmp_path))
    questions = spark.createDataFrame([(i, f"common often rare{i}") for i in range(20)], "qid int, question string")
    seen, before = _seen(monkeypatch, text_index), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(text_index, "LOOK_UP", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert text_index.best_by_text(index, questions, {"text": 1.0}, 3).select("qid").distinct().count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "wanted" in seen
    for name in ("promising", "hopeful", "text-hits"):
        assert "SortMergeJoin" not in seen[name][0] and "hashpartitioning(field" not in seen[name][0], name
    assert int(seen["hopeful"][1]) == text_index.SPLIT


def test_few_shuffle_partitions_mean_no_large_sums(spark, tmp_path, monkeypatch):
    """The sums of questions and documents are dealt by their number, whatever the session's partitions."""
    rows = [(i, "a b" + " c" * (i % 4)) for i in range(300)]
    questions = spark.createDataFrame([(i, "a b c") for i in range(10)], "qid int, question string")
    seen = {}
    for task_rows in (10_000_000, 100):
        monkeypatch.setattr(session, "TASK_ROWS", task_rows)
        noted, stored = {}, session.stored
        monkeypatch.setattr(text_index, "stored", lambda df, name: noted.setdefault(name, _partitions(df)) and stored(df, name))  # noqa: B023
        index = text_index.write(spark.createDataFrame(rows, "doc_id long, text string"), ["text"], str(tmp_path / str(task_rows)))
        hits = {tuple(r) for r in text_index.best_by_text(index, questions, {"text": 1.0}, 3).collect()}
        seen[task_rows] = noted["hopeful"], {(q, d, round(s, 9)) for q, d, s in hits}
    assert seen[100][0] == 30 and seen[10_000_000][0] == 4 == _partitions(None, spark)
    assert seen[100][1] == seen[10_000_000][1]


def _partitions(df, spark=None):
    return int((spark or df.sparkSession).conf.get("spark.sql.shuffle.partitions"))


def test_many_candidates_set_a_higher_bar(spark, tmp_path, monkeypatch):
    """The bar of the first few blocks lets nearly all documents through; of these only the best and their equals are ranked."""
    rows = [(i, "a " * (1 + i % 7) + "b " * (i % 5) + "x " * (i % 97)) for i in range(2_000)]
    index = text_index.write(spark.createDataFrame(rows, "doc_id long, text string"), ["text"], str(tmp_path))
    questions = spark.createDataFrame([(1, "a b"), (2, "b"), (3, "nothing")], "qid int, question string")
    monkeypatch.setattr(text_index, "SEEDS", 1)
    every = {tuple(r) for r in text_index.best_by_text(index, questions, {"text": 1.0}, 5).collect()}
    monkeypatch.setattr(text_index, "SHIPPED", 10)
    monkeypatch.setattr(text_index, "LOOK_UP", 0)
    few = {tuple(r) for r in text_index.best_by_text(index, questions, {"text": 1.0}, 5).collect()}
    best = lambda found: {(q, d, round(s, 9)) for q, d, s in found if sum(t > s + 1e-9 for p, _, t in found if p == q) < 5}
    assert best(few) == best(every) and {q for q, _, _ in few} == {1, 2}
    assert len(few) < len(every)


def test_words_of_many_documents_are_read_not_looked_up(spark, tmp_path, monkeypatch):
    words = [f"w{j}" for j in range(12)]
    rows = [(i, " ".join(w for j, w in enumerate(words) if i * (j + 3) % 7 < 4) + " x" * (i % 5)) for i in range(600)]
    index = text_index.write(spark.createDataFrame(rows, "doc_id long, text string"), ["text"], str(tmp_path))
    questions = spark.createDataFrame([(i, " ".join(words[i : i + 6]) + " x") for i in range(6)], "qid int, question string")
    seen = _seen(monkeypatch, text_index)
    read = {tuple(r) for r in text_index.best_by_text(index, questions, {"text": 1.0}, 2).collect()}
    assert "wanted" not in seen
    monkeypatch.setattr(text_index, "LOOK_UP", 0)
    looked_up = {tuple(r) for r in text_index.best_by_text(index, questions, {"text": 1.0}, 2).collect()}
    best = lambda found: {(q, d, round(s, 9)) for q, d, s in found if sum(t > s for p, _, t in found if p == q) < 2}
    assert best(read) == best(looked_up) and len(read) >= 12


def test_few_vectors_go_to_python_at_once(spark, monkeypatch):
    seen = _seen(monkeypatch, search)
    docs = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "doc_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "qid int, embedding array<float>")
    assert [r["doc_id"] for r in search.vector_search(docs, asked, size=2).orderBy("rank").collect()] == [8, 7]
    assert int(seen["nearest"][2]) <= session.ARROW_ROWS


def _shipped(df):
    """What a plan sends to all tasks, by way of the driver: the lines below each broadcast."""
    lines, found = _plan(df).splitlines(), []
    indent = lambda line: len(re.match(r"[\s:|]*", line.replace("+-", "  ")).group())
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for other in lines[i + 1 :]:
                if indent(other) <= indent(line):
                    break
                below.append(other)
            found.append("\n".join(below))
    return found


def test_a_catalog_of_lines_that_are_alike_is_not_sent_to_the_driver(spark, tmp_path):
    """Its file is small, its rows are many: the tables that hits use go to the lines, not the lines to the hits."""
    catalog = [([f"db.t{i}_fact", f"3-{j}"], f"  - c{j} (string)") for i in range(500) for j in range(4)]
    used = [(["2", f"t{i}_fact"], "- often") for i in range(500)]
    hits = spark.createDataFrame([(1, ["t7_fact"]), (2, ["T8_FACT", "none"]), (3, [])], "qid int, tables_used array<string>")
    texts = []
    for name, rows, of in (("catalog", catalog, render.schema_of), ("used", used, render.patterns_of)):
        spark.createDataFrame(rows, "ord array<string>, line string").write.parquet(f"{tmp_path}/{name}")
        found = of(hits, spark.read.parquet(f"{tmp_path}/{name}"))
        # What lines are headings, and how many date filters there are, is known beforehand.
        assert not [p for p in _shipped(found) if "line#" in p and not re.search(r"= \)|= 4\)", p)]
        texts.append({tuple(r) for r in found.collect()})
    columns = "\n".join(f"  - c{j} (string)" for j in range(4))
    assert texts[0] == {(1, columns), (2, columns)}
    assert texts[1] == {(1, "- often"), (2, ""), (3, "")}


def test_pieces_of_a_catalogs_names_are_not_sent_to_the_driver(spark, tmp_path):
    spark.range(2_000).selectExpr("concat('db.t', id, '_v') AS table_key", "0 AS n_columns").write.parquet(f"{tmp_path}/keys")
    names = spark.createDataFrame([("T12_V",), ("1999",), ("nowhere",), ("",)], "table_name string")
    found = schema_match.name_lookup(names, spark.read.parquet(f"{tmp_path}/keys"))
    assert not any("explode(flatten" in part for part in _shipped(found))
    assert {tuple(r)[:2] for r in found.collect()} == {("t12_v", "db.t12_v"), ("1999", "db.t1999_v")}


def test_too_many_rows_are_shuffled_whatever_their_files_take(spark, tmp_path):
    spark.range(50).write.parquet(f"{tmp_path}/few")
    few, many = spark.read.parquet(f"{tmp_path}/few"), spark.range(1_000)
    assert "BroadcastHashJoin" in _plan(many.join(session.shipped(few), "id"))
    assert "SortMergeJoin" in _plan(many.join(session.shipped(few, 10), "id"))


def _documents(rows, **columns):
    return rows.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in tables.schema(tables.DOCS).fields])


def test_documents_are_made_on_all_cores_however_few_bytes_they_come_from(spark, tmp_path):
    """Under a megabyte is shuffled, which Spark would give to one task."""
    text = F.concat(*[F.sha2(F.concat("id", F.lit(f"/{i}")), 256) for i in range(32)])
    rows = spark.range(400).groupBy((F.col("id") * 3).alias("id")).agg(F.max(text).alias("text"))
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    least = spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert kb.write_documents(_documents(rows, doc_id=F.col("id"), sql_query=F.col("text")), 1) == 400
    assert len(list((tmp_path / "kb/docs/version=1").glob("part-*.parquet"))) == 4
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionSize") == least


def test_a_load_reads_no_words_of_loads_that_it_replaces_nothing_of(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    kb.create()

    def index(ident, text):
        kb.index(_documents(spark.createDataFrame([(ident, text)], "id string, text string"), doc_id=F.col("id"), sql_query=F.col("text")))
        return max(r["version"] for r in kb.commits())

    index("one", "old words")
    other = index("two", "more words")
    (tmp_path / f"kb/postings/version={other}/part-unreadable.parquet").write_bytes(b"no Parquet file")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where many documents are replaced
    try:
        index("one", "new words")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    counts = {(r["field"], r["term"]): r["df"] for r in kb.counts().filter("term <> ''").collect()}
    assert counts == {("sql_query", "words"): 2, ("sql_query", "more"): 1, ("sql_query", "new"): 1}
