import re

import pytest
from pyspark.sql import functions as F

from querylode.functions import sqlfeatures as sf
from querylode.functions import text as tx
from querylode.operators import patterns, render
from querylode.plans.build import pattern_lines


def analyse(spark, *sqls):
    df = spark.createDataFrame(
        [("n", i, s) for i, s in enumerate(sqls)], "notebook_path string, cell_index int, sql_query string"
    )
    return sf.with_features(df)


def one(spark, sql):
    return analyse(spark, sql).first()


def test_simple_select(spark):
    r = one(spark, "SELECT ward, MAX(beds) AS largest FROM hospital_wing WHERE opened < DATE '1999-05-04' GROUP BY ward")
    assert r["query_type"] == "SELECT"
    assert r["tables"] == ["hospital_wing"]
    assert r["aggregations"] == ["MAX"]
    assert r["filters"] == ["opened < DATE '1999-05-04'"]
    assert {"beds", "largest", "opened", "ward"} <= set(r["columns"])


def test_joins(spark):
    r = one(spark, "SELECT c.name FROM customers c INNER JOIN sales s ON c.id = s.cid left outer join db.regions r ON r.x = s.x")
    assert r["tables"] == ["customers", "db.regions", "sales"]
    assert [tuple(j) for j in r["joins"]] == [("customers", "sales", "INNER"), ("sales", "db.regions", "LEFT")]


def test_join_after_a_nested_relation(spark):
    r = one(spark, "SELECT * FROM a JOIN b ON a.x = (SELECT max(y) FROM z) CROSS JOIN c WHERE a.x IN (SELECT q FROM d JOIN e ON 1 = 1)")
    assert [tuple(j) for j in r["joins"]] == [("a", "b", "INNER"), ("b", "c", "CROSS"), ("d", "e", "INNER")]
    r = one(spark, "SELECT * FROM (SELECT * FROM b) t JOIN c ON t.x = c.x")
    assert [tuple(j) for j in r["joins"]] == [("b", "c", "INNER")]


def test_ctes(spark):
    r = one(spark, """
        WITH catch_by_week AS (SELECT DATE_TRUNC('week', landed) AS w, SUM(kilos) AS t FROM fishing_trips GROUP BY 1),
        y (a, b) AS (SELECT 1, 2), z AS (WITH inner_one AS (SELECT 1) SELECT * FROM inner_one)
        SELECT w FROM catch_by_week JOIN z ON 1 = 1 WHERE t > 77""")
    assert r["query_type"] == "WITH"
    assert r["cte_names"] == ["catch_by_week", "inner_one", "y", "z"]
    assert r["tables"] == ["fishing_trips"]
    assert r["filters"] == ["t > 77"]
    assert "DATE_TRUNC" in r["date_functions"] and "DATE_TRUNC" in r["functions"]


def test_subqueries(spark):
    r = one(spark, "SELECT a FROM sales WHERE amount > ( SELECT AVG(amount) FROM sales WHERE d IN (SELECT max(d) FROM x) ) AND k = 1")
    assert r["subqueries"] == [
        "(SELECT max(d) FROM x)",
        "( SELECT AVG(amount) FROM sales WHERE d IN (SELECT max(d) FROM x) )",
    ]
    assert r["filters"] == ["amount > ( SELECT AVG(amount) FROM sales WHERE d IN (SELECT max(d) FROM x) )", "k = 1"]
    raw = analyse(spark, "SELECT (SELECT max(d) FROM x)").select(sf.subqueries_raw(F.col("clean_sql"))).first()[0]
    assert raw == ["(SELECT max(d)"]


def test_magic_comments_and_case(spark):
    r = one(spark, "  %sql\nselect hive FROM apiary\n   where queens = 2;")
    assert (r["query_type"], r["tables"], r["filters"]) == ("SELECT", ["apiary"], ["queens = 2"])
    r = one(spark, "-- all hives\nSELECT hive, /* grams */ honey FROM harvest /* one\n row a year */ WHERE season <> 'wet'")
    assert (r["query_type"], r["tables"], r["filters"]) == ("SELECT", ["harvest"], ["season <> 'wet'"])


@pytest.mark.parametrize("sql", ["", "   ", "walk the dog", None])
def test_no_sql(spark, sql):
    r = one(spark, sql)
    assert r["query_type"] == "UNKNOWN" and r["joins"] == [] and r["filters"] == []


def test_filters(spark):
    cases = {
        "SELECT 1 FROM t WHERE a BETWEEN 1 AND 2 AND b = 'x AND y' OR (c = 1 OR d = 2)":
            ["a BETWEEN 1 AND 2", "b = 'x AND y'", "(c = 1 OR d = 2)"],
        "SELECT 1 FROM t WHERE a = 1 UNION SELECT 2 FROM u WHERE b = 2 LIMIT 3": ["a = 1", "b = 2"],
        "SELECT 'WHERE' FROM t": [],
        "SELECT 1 FROM (SELECT 2 FROM t WHERE a = 1) x": [],
        "DELETE FROM t WHERE a IN (1, 2) RETURNING a": ["a IN (1, 2)"],
    }
    got = analyse(spark, *cases).orderBy("cell_index").collect()
    assert [r["filters"] for r in got] == list(cases.values())


def test_word_boundaries(spark):
    r = one(spark, "SELECT DISCOUNT(x), DENSE_RANK() OVER (w), count (y) FROM t")
    assert r["aggregations"] == ["COUNT", "DENSE_RANK"]
    assert r["functions"] == ["COUNT", "DENSE_RANK", "DISCOUNT", "OVER"]


def test_huge_in_list_is_cheap(spark):
    sql = "SELECT 1 FROM t WHERE a IN (" + ", ".join(map(str, range(60_000))) + ") AND b = 2"
    r = one(spark, sql)
    assert len(r["filters"]) == 2 and r["filters"][1] == "b = 2"


def test_business_patterns(spark):
    base = "FROM ferry_fact WHERE ferry_fact.date > '2019-08-08' GROUP BY 1"
    f = analyse(
        spark,
        f"SELECT harbour, SUM(revenue) {base}",
        f"SELECT captain, COUNT(*) {base}",
        f"SELECT DATE_TRUNC('year', date), SUM(revenue) {base}",
        "SELECT 1 FROM a JOIN b ON a.x = b.x",
    )
    counts = patterns.usage_counts(f)
    assert [tuple(r) for r in patterns.relationships(counts).collect()] == [("a", "b", 1)]
    assert [r["relationship"] for r in patterns.join_counts(counts).collect()] == ["a-b"]
    top = [tuple(r) for r in patterns.common_filters(counts).collect()]
    assert top == [("ferry_fact", "ferry_fact.date > '2019-08-08'", 3, 1)]
    aggs = patterns.common_aggregations(counts).orderBy("rk").collect()
    assert [(r["agg"], r["n"]) for r in aggs] == [("SUM", 2), ("COUNT", 1)]
    assert patterns.business_calculations(f).count() == 2
    assert [r["filter"] for r in patterns.date_filters(f).collect()] == ["ferry_fact.date > '2019-08-08'"]
    lines = pattern_lines(counts, patterns.date_filters(f))
    text = render.as_text(lines, ["section", "key"]).first()[0]
    assert text == (
        "## Common Table Relationships\n- a commonly joined with: b\n"
        "\n## Common Filters by Table\n- ferry_fact: ferry_fact.date > '2019-08-08'\n"
        "\n## Common Aggregations by Table\n- ferry_fact: SUM, COUNT\n"
        "\n## Common Date Filters\n- ferry_fact.date > '2019-08-08'"
    )


def test_date_patterns(spark):
    f = analyse(
        spark,
        "SELECT * FROM sales WHERE date >= DATE_SUB(CURRENT_DATE, INTERVAL 30 DAY)",
        "SELECT * FROM orders WHERE created_at >= '2023-01-01' AND created_at < '2024-01-01'",
    )
    assert [r["filter"] for r in patterns.date_filters(f).collect()] == [
        "date >= DATE_SUB(CURRENT_DATE, INTERVAL 30 DAY)"
    ]


def test_table_pattern(spark):
    f = analyse(spark, "SELECT SUM(x) FROM a JOIN b ON 1 = 1", "print")
    text = render.table_pattern(F.col("tables"), F.col("joins"), F.col("aggregations"))
    assert [r[0] for r in f.orderBy("cell_index").select(text).collect()] == [
        "Tables: a, b | Joins: a INNER JOIN b | Aggregations: SUM", ""
    ]


def test_embedding_texts(spark):
    long = "x" * 120
    df = spark.createDataFrame(
        [(f"%sql SELECT '{long}' -- c", " before ", "", "a/b/c.ipynb"), ("SELECT 1", "", "after", "c.ipynb")],
        "q string, b string, a string, p string",
    )
    got = [r[0] for r in df.select(tx.embedding_text(F.col("q"), F.col("b"), F.col("a"), F.col("p"))).collect()]
    assert got == [
        "Context: before | Query: SELECT '<LONG_STRING>' | Source: b/c.ipynb",
        "Query: SELECT 1 | Description: after",
    ]
    q = spark.createDataFrame([(" Group by region and join ",), ("Top users",)], "q string")
    assert [r[0] for r in q.select(tx.question_text(F.col("q"))).collect()] == [
        "Question: Group by region and join | SQL concepts: group by, join", "Question: Top users"
    ]
    e = spark.createDataFrame([("  ",), ("a" * 9000,)], "t string")
    assert [r[0] and len(r[0]) for r in e.select(tx.embeddable(F.col("t"))).collect()] == [None, 9000]
    c = spark.createDataFrame([("abcdefg",), ("",)], "t string").select(tx.chunks(F.col("t"), 3))
    assert [r[0] for r in c.collect()] == [["abc", "def", "g"], [""]]


def test_features_of_very_long_texts(spark):
    """20,000 conditions, joins and subqueries of one text in seconds; four times as many in at most about four times as long."""
    import time

    from pyspark.sql import functions as F

    from querylode.functions import sqlfeatures as sf

    def seconds(n):
        sql = "SELECT a FROM t" + "".join(f" JOIN u{i} ON x = {i}" for i in range(n)) + " WHERE "
        sql += " AND ".join(f"c{i} = (SELECT {i})" for i in range(n))
        df = spark.createDataFrame([(sql,)], "clean string")
        c = F.col("clean")
        start = time.time()
        row = df.select(F.size(sf.filters(c)).alias("f"), F.size(sf.joins(c)).alias("j"), F.size(sf.subqueries(c)).alias("s"), F.length(sf.outline(c))).first()
        assert row[:3] == (n, n, n)
        return time.time() - start

    seconds(10)
    short, long = seconds(5_000), seconds(20_000)
    assert long < 4 and long < 5 * max(short, 0.5)


@pytest.mark.parametrize(
    "sql,expected",
    [
        ("SELECT a.x FROM t a WHERE a.y IN (SELECT a.z FROM u a WHERE a.w = b.v)", {("t", "x"), ("t", "y"), ("u", "z"), ("u", "w"), (None, "v")}),
        ("SELECT p.x FROM (t p JOIN db.u q ON p.i = q.i), v WHERE v.k = u.k", {("t", "x"), ("t", "i"), ("db.u", "i"), ("v", "k"), (None, "k")}),
        ("SELECT db.u.k, u.m, f(u.n), u.g(1) FROM db.u", {("db.u", "k"), ("db.u", "m"), ("db.u", "n")}),
        ("SELECT e.c.d, o.p FROM t LATERAL VIEW explode(t.list) e AS c JOIN s o", {(None, "d"), ("t", "list"), ("s", "p")}),
        ("SELECT j.doc.field FROM t j", {("t", "doc")}),
        ("SELECT n.k FROM explode(x.y) n JOIN t USING (k) JOIN u r ON r.k = t.k", {(None, "k"), (None, "y"), ("u", "k"), ("t", "k")}),
        ("UPDATE t SET v = s.v FROM s WHERE t.i = s.i; SELECT t.a FROM z t", {("s", "v"), ("t", "i"), ("s", "i"), ("z", "a")}),
        ("MERGE INTO t g USING (SELECT h.i FROM h) s ON g.i = s.i", {("h", "i"), ("t", "i"), (None, "i")}),
        ('SELECT "A b".c FROM t AS "A b" WHERE x = \'q.r\' AND 1.5 > 2', {("t", "c")}),
        (")) SELECT a.x FROM t a ((", {("t", "x")}),
        ("SELECT 1", set()),
        ("", set()),
        (None, set()),
    ],
)
def test_aliases_belong_to_their_scope(spark, sql, expected):
    row = sf.with_features(spark.createDataFrame([(sql,)], "sql_query string")).first()
    assert {tuple(c) for c in row["qualified_columns"]} == expected


def test_aliases_of_very_deep_texts(spark):
    """5,000 scopes inside one another, all of which use an alias of the outermost."""
    n = 5_000
    sql = "SELECT o.x FROM t o WHERE " + "".join(f"EXISTS (SELECT o.c{i} FROM u{i} a{i} WHERE a{i}.k = 1 AND " for i in range(n)) + "o.z = 1" + ")" * n
    df = spark.createDataFrame([(sql,)], "clean string")
    row = df.select(sf.qualified_columns(F.col("clean"), F.array().cast("array<string>")).alias("c")).first()
    assert {tuple(c) for c in row["c"]} == {("t", "x"), ("t", "z")} | {("t", f"c{i}") for i in range(n)} | {(f"u{i}", "k") for i in range(n)}


def test_texts_of_one_shape_are_walked_once(monkeypatch):
    """Names, literals and blanks tell no shapes apart, but quoted names, keywords and equal names do."""
    import pyarrow as pa

    from querylode.functions import scopes

    walks = []
    walk = scopes._qualified
    monkeypatch.setattr(scopes, "_qualified", lambda tokens: walks.append(1) or walk(tokens))
    text = "SELECT {0}.x FROM {1} {2} WHERE {0}.y = 'l{1}'"
    cut = lambda *names: re.findall(r"'[^']*'|\"[^\"]*\"|\w+|\s+|.", text.format(*names))
    rows = [cut("t", "a", "T"), cut("u", "b", "U"), cut("t", "a", "s"), cut('"t"', "a", "T"), cut("x0aaaaaa", "x1aaaaaa", "X0AAAAAA"), None, []]
    got = [r and [(c["table_name"], c["column_name"]) for c in r] for r in scopes._distinct(pa.array(rows, pa.list_(pa.string()))).to_pylist()]
    assert got == [
        [("a", "x"), ("a", "y")], [("b", "x"), ("b", "y")], [(None, "x"), (None, "y")], [("a", "x"), ("a", "y")],
        [("x1aaaaaa", "x"), ("x1aaaaaa", "y")], None, [],
    ]
    assert len(walks) == 4  # one for three texts, one for each other shape, the empty one's too


def test_aliases_of_events_are_resolved_once(spark, capsys):
    """In as many tasks as a shuffle has, and not before it as well, to drop texts without any."""
    from checks.corpus_queries import sql_columns_scoped

    sql_columns_scoped(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Exchange RoundRobinPartitioning" in plan
    below = plan[plan.index("Exchange RoundRobinPartitioning"):]
    assert "EvalPython" in plan and "EvalPython" not in below
