"""Hot keys: results stay whole when one key holds most rows."""

from pyspark.sql import functions as F

from querylode.operators import schema_match, store


def test_lookup_of_a_hot_name(spark):
    names = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id") % 7))
    features = spark.range(900).select(
        F.col("id").cast("string").alias("extract_id"), F.array(names).alias("tables")
    )
    catalog = spark.createDataFrame([("db.hot_1", 4), ("db.hot", 3), ("db.t3", 2)], "table_key string, n_columns int")
    rows = {r["extract_id"]: r["schema_context"] for r in schema_match.schema_context(features, catalog).collect()}
    expected = {}
    for i in range(900):
        if i % 3 > 0:
            expected[str(i)] = "db.hot: 3 columns"
        elif i % 7 == 3:
            expected[str(i)] = "db.t3: 2 columns"
    assert rows == expected


def test_replacing_a_hot_notebook(spark, tmp_path):
    kb = store.KnowledgeBase(spark, str(tmp_path / "kb"))
    kb.create()

    def docs(version, count):
        made = spark.range(count).select(
            F.concat_ws("/", F.lit(version), "id").alias("doc_id"),
            F.when(F.col("id") % 3 > 0, "hot.ipynb").otherwise("cold.ipynb").alias("notebook_path"),
        )
        missing = [f for f in store.tables.schema(store.tables.DOCS).fields if f.name not in made.columns]
        return made.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])

    first = kb.next_version()
    assert kb.write_documents(docs(first, 300), first) == 300
    kb.mark_none_stale(first)
    kb.commit(first, "a", 300)
    second = kb.next_version()
    kb.write_documents(docs(second, 10).filter("notebook_path = 'hot.ipynb'"), second)
    kb.mark_stale(second, spark.createDataFrame([("hot.ipynb",)], "notebook_path string"))
    assert kb.upcoming(second).count() == 106
    kb.commit(second, "b", 6)
    counts = dict(kb.documents().groupBy("notebook_path").count().collect())
    assert counts == {"cold.ipynb": 100, "hot.ipynb": 6}
