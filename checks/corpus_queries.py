"""Registered queries over notebooks, cells and SQL features."""

from __future__ import annotations

from pyspark.sql import functions as F

from querylode import fixed_values as fv
from querylode.functions import sqlfeatures as sf
from querylode.functions import text as tx
from querylode.operators import context
from querylode.sources import notebooks as nb

from . import oracle_parts as o
from .fixture import cells
from .registry import register

# Cells per notebook file of the round trip; a longer conversation becomes several files.
FILE_CELLS = 256

L = "long"


def raw_files(spark, sf_dir, kind):
    """The fixture as notebook JSON, ``kind`` 'jupyter' or 'zeppelin'."""
    i, source, prose = F.col("cell_index"), F.col("source"), F.col("cell_type") == "markdown"
    if kind == "jupyter":
        as_text = F.to_json(F.struct("cell_type", "source", "execution_count"))
        lines = F.split(source, r"(?<=\n)").alias("source")
        as_lines = F.to_json(F.struct("cell_type", lines, "execution_count"))
        one, key, ending = F.when(i % 2 == 0, as_text).otherwise(as_lines), "cells", ".ipynb"
    else:
        text = F.when(prose, F.concat(F.lit("%md\n"), source)).otherwise(source).alias("text")
        one, key, ending = F.to_json(F.struct(text)), "paragraphs", ".json"
    part = F.floor(i / FILE_CELLS)
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct(i.alias("i"), one.alias("j")))), lambda c: c["j"]
    )
    name = F.regexp_replace("notebook_path", r"\.ipynb$", "")
    return (
        cells(spark, sf_dir)
        .groupBy(name.alias("name"), part.alias("part"))
        .agg(F.concat(F.lit(f'{{"{key}":['), F.array_join(ordered, ","), F.lit("]}")).alias("value"))
        .select(
            F.concat("name", F.lit("#"), F.col("part").cast("string"), F.lit(ending)).alias(
                "notebook_path"
            ),
            "value",
            F.lit(None).cast("timestamp").alias("modified"),
        )
    )


def whole_positions(df):
    """Path and cell number of the conversation, from those of the file."""
    part = F.regexp_extract("notebook_path", r"#(\d+)\.", 1).cast(L)
    return df.withColumns(
        {
            "cell_index": part * FILE_CELLS + F.col("cell_index"),
            "notebook_path": F.regexp_replace("notebook_path", r"#\d+\.\w+$", ".ipynb"),
        }
    )


@register(
    "nb_cells",
    f"WITH {o.CELLS} SELECT notebook_path, cell_index, cell_type, source, "
    "cell_index AS execution_count FROM cells",
)
def nb_cells(spark, sf_dir):
    parsed = nb.cells(nb.parse(raw_files(spark, sf_dir, "jupyter")))
    return whole_positions(parsed).select(
        "notebook_path", "cell_index", "cell_type", "source", F.col("execution_count").cast(L)
    )


@register(
    "nb_zeppelin_cells",
    f"WITH {o.CELLS} SELECT notebook_path, cell_index, cell_type, "
    f"CASE WHEN cell_type = 'markdown' THEN {o.strip('source')} ELSE source END AS source FROM cells",
)
def nb_zeppelin_cells(spark, sf_dir):
    parsed = nb.cells(nb.parse(raw_files(spark, sf_dir, "zeppelin")))
    return whole_positions(parsed).select("notebook_path", "cell_index", "cell_type", "source")


@register(
    "nb_file_extracts",
    f"""WITH {o.CELLS},
parts AS (SELECT *, cell_index // {FILE_CELLS} AS part FROM cells),
ctx AS (SELECT *,
  coalesce(array_to_string(list(source) FILTER (WHERE cell_type = 'markdown') OVER
    (PARTITION BY notebook_path, part ORDER BY cell_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' '), '') AS context_before,
  coalesce(array_to_string(list(source) FILTER (WHERE cell_type = 'markdown') OVER
    (PARTITION BY notebook_path, part ORDER BY cell_index ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), ' '), '') AS context_after
  FROM parts)
SELECT notebook_path, cell_index, source AS sql_query, context_before, context_after
FROM ctx WHERE cell_type = 'code' AND {o.is_sql("source")}""",
)
def nb_file_extracts(spark, sf_dir):
    found = nb.extracts(nb.parse(raw_files(spark, sf_dir, "jupyter")))
    return whole_positions(found).select(
        "notebook_path", "cell_index", "sql_query", "context_before", "context_after"
    )


@register(
    "nb_rejects",
    """SELECT 'page/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.ipynb' ELSE '.json' END AS notebook_path,
       'not JSON' AS reason FROM pages
UNION ALL SELECT 'event/' || event_id || '.json', 'no paragraphs' FROM events""",
)
def nb_rejects(spark, sf_dir):
    """Web pages are no JSON at all, event properties are JSON without paragraphs."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ending = F.when(F.col("page_id") % 2 == 0, ".ipynb").otherwise(".json")
    none = F.lit(None).cast("timestamp").alias("modified")
    raw = pages.select(
        F.concat(F.lit("page/"), F.col("page_id").cast("string"), ending).alias("notebook_path"),
        F.col("html").alias("value"),
        none,
    ).unionByName(
        events.select(
            F.concat(F.lit("event/"), F.col("event_id").cast("string"), F.lit(".json")).alias(
                "notebook_path"
            ),
            F.col("props").alias("value"),
            none,
        )
    )
    return nb.rejects(raw)


@register(
    "nb_is_sql",
    f"WITH {o.CELLS} SELECT notebook_path, cell_index, {o.is_sql('source')} AS is_sql, "
    f"CASE WHEN cell_type = 'markdown' THEN 'markdown' WHEN {o.is_sql('source')} THEN 'sql' END AS kind FROM cells",
)
def nb_is_sql(spark, sf_dir):
    return cells(spark, sf_dir).select(
        "notebook_path",
        F.col("cell_index").cast(L),
        tx.contains_sql(F.col("source")).alias("is_sql"),
        tx.cell_kind(F.col("cell_type"), F.col("source")).alias("kind"),
    )


@register(
    "nb_sql_notebooks",
    f"""WITH {o.CELLS} SELECT notebook_path, count(*) AS n_cells,
  count(*) FILTER (WHERE cell_type = 'code' AND {o.is_sql("source")}) AS n_sql,
  count(*) FILTER (WHERE cell_type = 'markdown') AS n_markdown
FROM cells GROUP BY 1 HAVING count(*) FILTER (WHERE cell_type = 'code' AND {o.is_sql("source")}) > 0""",
)
def nb_sql_notebooks(spark, sf_dir):
    return context.sql_notebooks(cells(spark, sf_dir))


@register(
    "nb_context",
    f"WITH {o.CELLS}, {o.CONTEXT} SELECT notebook_path, cell_index, context_before, context_after FROM ctx",
)
def nb_context(spark, sf_dir):
    return context.with_context(cells(spark, sf_dir)).select(
        "notebook_path", F.col("cell_index").cast(L), "context_before", "context_after"
    )


@register(
    "nb_extracts",
    f"WITH {o.CELLS}, {o.CONTEXT} SELECT extract_id, notebook_path, cell_index, sql_query, "
    "context_before, context_after FROM extracts",
)
def nb_extracts(spark, sf_dir):
    return context.extracts(cells(spark, sf_dir)).select(
        "extract_id",
        "notebook_path",
        F.col("cell_index").cast(L),
        "sql_query",
        "context_before",
        "context_after",
    )


def sql_cells(spark, sf_dir):
    """SQL cells of the fixture with their cleaned text."""
    return (
        cells(spark, sf_dir)
        .filter(tx.cell_kind(F.col("cell_type"), F.col("source")) == "sql")
        .select(
            "notebook_path",
            F.col("cell_index").cast(L).alias("cell_index"),
            F.col("source").alias("sql_query"),
            tx.clean_sql(F.col("source")).alias("clean_sql"),
        )
    )


def CLEAN():
    return F.col("clean_sql")


def exploded(df, items, name):
    return df.select("notebook_path", "cell_index", F.explode(items).alias(name))


@register("sql_clean", f"WITH {o.SQLCELLS} SELECT notebook_path, cell_index, clean AS clean_sql FROM sqlcells")
def sql_clean(spark, sf_dir):
    return sql_cells(spark, sf_dir).select("notebook_path", "cell_index", "clean_sql")


@register(
    "sql_query_type",
    rf"""WITH {o.SQLCELLS} SELECT notebook_path, cell_index, coalesce(nullif(upper(
      regexp_extract(clean, '(?i)^({"|".join(fv.STATEMENT_KEYWORDS)})\b', 1)), ''), 'UNKNOWN') AS query_type
    FROM sqlcells""",
)
def sql_query_type(spark, sf_dir):
    return sql_cells(spark, sf_dir).select(
        "notebook_path", "cell_index", sf.query_type(CLEAN()).alias("query_type")
    )


@register(
    "sql_tables",
    f"WITH {o.SQLCELLS} SELECT notebook_path, cell_index, unnest(tables) AS table_name FROM sqlcells",
)
def sql_tables(spark, sf_dir):
    df = sql_cells(spark, sf_dir).withColumn("cte_names", sf.cte_names(CLEAN()))
    return exploded(df, sf.tables(CLEAN(), F.col("cte_names")), "table_name")


@register(
    "sql_table_suffix",
    f"WITH {o.SQLCELLS} SELECT notebook_path, cell_index, "
    f"unnest(list_distinct(regexp_extract_all(clean, '{o.SUFFIX_RE}', 1))) AS table_name FROM sqlcells",
)
def sql_table_suffix(spark, sf_dir):
    return exploded(sql_cells(spark, sf_dir), sf.suffix_tables(CLEAN()), "table_name")


_WORDS = ", ".join(f"'{w}'" for w in fv.SQL_WORDS)


@register(
    "sql_columns",
    rf"""WITH {o.SQLCELLS},
bare AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(clean, '''[^'']*''', ' ', 'g'),
           '\b\w+\s*\(', '(', 'g'), '\b\w+\.', '', 'g') AS b FROM sqlcells),
names AS (SELECT DISTINCT notebook_path, cell_index, ctes, tables,
           unnest(regexp_extract_all(b, '\b([\pL_]\w*)\b', 1)) AS column_name FROM bare)
SELECT notebook_path, cell_index, column_name FROM names
WHERE upper(column_name) NOT IN ({_WORDS}) AND NOT list_contains(ctes, column_name)
  AND NOT list_contains(list_transform(tables, lambda t: split_part(t, '.', -1)), column_name)""",
)
def sql_columns(spark, sf_dir):
    df = (
        sql_cells(spark, sf_dir)
        .withColumn("cte_names", sf.cte_names(CLEAN()))
        .withColumn("tables", sf.tables(CLEAN(), F.col("cte_names")))
    )
    return exploded(df, sf.columns(CLEAN(), F.col("tables"), F.col("cte_names")), "column_name")


@register(
    "sql_columns_qualified",
    rf"""WITH {o.SQLCELLS},
plain AS (SELECT notebook_path, cell_index, ctes, regexp_replace(clean, '''[^'']*''', ' ', 'g') AS b FROM sqlcells),
said AS (SELECT notebook_path, cell_index, ctes,
   unnest(regexp_extract_all(b, '(?i)\b(?:FROM|JOIN)\s+(\w+)(?:\s+(\w+))?', 1)) AS table_name,
   unnest(regexp_extract_all(b, '(?i)\b(?:FROM|JOIN)\s+(\w+)(?:\s+(\w+))?', 2)) AS alias FROM plain),
names AS (SELECT notebook_path, cell_index, table_name, lower(alias) AS alias FROM said WHERE NOT list_contains(ctes, table_name)
   UNION SELECT notebook_path, cell_index, table_name, lower(table_name) FROM said WHERE NOT list_contains(ctes, table_name)),
used AS (SELECT DISTINCT notebook_path, cell_index, unnest(regexp_extract_all(b, '([A-Za-z_]\w*)\.([A-Za-z_]\w*)', 1)) AS q,
   unnest(regexp_extract_all(b, '([A-Za-z_]\w*)\.([A-Za-z_]\w*)', 2)) AS column_name FROM plain)
SELECT DISTINCT u.notebook_path, u.cell_index, n.table_name, u.column_name FROM used u
LEFT JOIN names n ON n.notebook_path = u.notebook_path AND n.cell_index = u.cell_index AND n.alias = lower(u.q)""",
)
def sql_columns_qualified(spark, sf_dir):
    df = sql_cells(spark, sf_dir).withColumn("cte_names", sf.cte_names(CLEAN()))
    return exploded(df, sf.qualified_columns(CLEAN(), F.col("cte_names")), "c").select(
        "notebook_path", "cell_index", "c.table_name", "c.column_name"
    )


@register(
    "sql_columns_scoped",
    """WITH expected AS (
  SELECT 0 AS odd, * FROM (VALUES ('sales_fact', 'a_'), ('shop.*_dim', 'b'), ('shop.*_dim', 'k'), ('orders_fact', 'k'),
    ('orders_fact', 'id'), ('sales_fact', 'id'), ('users_dim', 'k'), ('price_stage', 'q'), (NULL, 'q'), ('sales_fact', 'q')) AS a(t, c)
  UNION ALL SELECT 1, * FROM (VALUES ('raw.*', 'n_'), (NULL, 'n'), ('plan_tbl', 'm'), ('audit_table', 'm'), (NULL, 'z'),
    ('audit_table', 'd'), ('audit_table', 'e')) AS b(t, c))
SELECT event_id, replace(t, '*', event_type) AS table_name,
  c || CASE WHEN c IN ('a_', 'n_') THEN CAST(user_id AS VARCHAR) ELSE '' END AS column_name
FROM events JOIN expected ON odd = event_id % 2""",
)
def sql_columns_scoped(spark, sf_dir):
    """Every event as a query whose aliases are nested, shadowed, or declared again in the next part of a union."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    nested = F.concat(
        F.lit("SELECT t.a_"), user, F.lit(", (SELECT MAX(t.b) FROM shop."), kind,
        F.lit("_dim AS t WHERE t.k = o.k)\nFROM sales_fact t JOIN orders_fact o ON o.id = T.id, users_dim\n"
              "WHERE users_dim.k = 't.zzz' AND EXISTS (SELECT 1 FROM (SELECT x.q FROM price_stage x) d WHERE d.q = t.q)"),
    )
    union = F.concat(
        F.lit("WITH w AS (SELECT e.n_"), user, F.lit(" FROM `raw`.`"), kind,
        F.lit("` e) SELECT w.n, y.m FROM w LEFT JOIN plan_tbl y USING (n)\nUNION ALL SELECT y.m, lost.z FROM audit_table y "
              "WHERE EXTRACT(DAY FROM y.d) IS DISTINCT FROM y.e"),
    )
    sql = F.when(F.col("event_id") % 2 == 0, nested).otherwise(union)
    # Few bytes make much text: the events are dealt anew, else a file's few row groups are all the tasks there are.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type").repartition(tasks)
    found = sf.with_features(events.select("event_id", sql.alias("sql_query")))
    # The outer form keeps Spark from resolving the aliases twice, first to drop texts without any, before the shuffle.
    found = found.select("event_id", F.explode_outer("qualified_columns").alias("c")).filter(F.col("c").isNotNull())
    return found.select("event_id", "c.table_name", "c.column_name")


def _raw_join_sql(pattern):
    p = pattern.replace("(?U)", "")
    return (
        f"SELECT notebook_path, cell_index, unnest(regexp_extract_all(upper(clean), '{p}', 0)) AS m, "
        f"unnest(regexp_extract_all(upper(clean), '{p}', 1)) AS left_table, "
        f"unnest(regexp_extract_all(upper(clean), '{p}', 2)) AS right_table FROM sqlcells"
    )


@register(
    "sql_joins_raw",
    f"WITH {o.SQLCELLS}, raw AS ({' UNION ALL '.join(_raw_join_sql(p) for p in fv.JOIN_RAW)}) "
    "SELECT notebook_path, cell_index, left_table, right_table, CASE WHEN contains(m, 'LEFT') THEN 'LEFT' "
    "WHEN contains(m, 'RIGHT') THEN 'RIGHT' WHEN contains(m, 'FULL') THEN 'FULL' ELSE 'INNER' END AS join_type FROM raw",
)
def sql_joins_raw(spark, sf_dir):
    return exploded(sql_cells(spark, sf_dir), sf.joins_raw(CLEAN()), "j").select(
        "notebook_path", "cell_index", "j.*"
    )


@register(
    "sql_joins",
    f"WITH {o.SQLCELLS}, {o.JOINS} SELECT notebook_path, cell_index, left_table, right_table, join_type FROM joins",
)
def sql_joins(spark, sf_dir):
    return exploded(sql_cells(spark, sf_dir), sf.joins(CLEAN()), "j").select(
        "notebook_path", "cell_index", "j.*"
    )


@register(
    "sql_filters",
    f"WITH {o.SQLCELLS}, {o.FILTERS} SELECT notebook_path, cell_index, pos, filter FROM filters",
)
def sql_filters(spark, sf_dir):
    return sql_cells(spark, sf_dir).select(
        "notebook_path", "cell_index", F.posexplode(sf.filters(CLEAN())).alias("pos", "filter")
    ).withColumn("pos", F.col("pos").cast(L))


@register("sql_aggs", f"WITH {o.SQLCELLS}, {o.AGGS} SELECT * FROM aggs")
def sql_aggs(spark, sf_dir):
    return exploded(sql_cells(spark, sf_dir), sf.aggregations(CLEAN()), "agg")


@register("sql_date_funcs", f"WITH {o.SQLCELLS}, {o.DATEFNS} SELECT * FROM datefns")
def sql_date_funcs(spark, sf_dir):
    return exploded(sql_cells(spark, sf_dir), sf.date_functions(CLEAN()), "fn")


@register(
    "sql_funcs",
    rf"WITH {o.SQLCELLS}, {o.DATEFNS} SELECT notebook_path, cell_index, "
    r"unnest(regexp_extract_all(upper(clean), '(\w+)\s*\(', 1)) AS fn FROM sqlcells UNION SELECT * FROM datefns",
)
def sql_funcs(spark, sf_dir):
    return exploded(sql_cells(spark, sf_dir), sf.functions(CLEAN(), sf.date_functions(CLEAN())), "fn")


@register(
    "sql_subqueries_raw",
    rf"WITH {o.SQLCELLS} SELECT notebook_path, cell_index, "
    r"unnest(regexp_extract_all(clean, '(?is)\(\s*SELECT\s+.*?\)', 0)) AS subquery FROM sqlcells",
)
def sql_subqueries_raw(spark, sf_dir):
    return exploded(sql_cells(spark, sf_dir), sf.subqueries_raw(CLEAN()), "subquery")


@register(
    "sql_subqueries",
    rf"""WITH {o.SQLCELLS}, {o.TOKENS},
words AS (SELECT *, lead(upper(t)) OVER (PARTITION BY notebook_path, cell_index ORDER BY p) AS nxt
          FROM toks WHERE NOT regexp_matches(t, '^\s+$')),
opens AS (SELECT notebook_path, cell_index, p, depth FROM words WHERE t = '(' AND nxt = 'SELECT'),
spans AS (SELECT a.notebook_path, a.cell_index, a.p AS b, min(c.p) AS e
  FROM opens a JOIN toks c ON c.notebook_path = a.notebook_path AND c.cell_index = a.cell_index
   AND c.t = ')' AND c.depth = a.depth + 1 AND c.p > a.p GROUP BY ALL)
SELECT s.notebook_path, s.cell_index, string_agg(t.t, '' ORDER BY t.p) AS subquery
FROM spans s JOIN toks t ON t.notebook_path = s.notebook_path AND t.cell_index = s.cell_index
 AND t.p BETWEEN s.b AND s.e GROUP BY s.notebook_path, s.cell_index, s.b""",
)
def sql_subqueries(spark, sf_dir):
    return exploded(sql_cells(spark, sf_dir), sf.subqueries(CLEAN()), "subquery")


@register(
    "sql_ctes",
    f"WITH {o.SQLCELLS} SELECT notebook_path, cell_index, unnest(list_distinct(ctes)) AS cte FROM sqlcells",
)
def sql_ctes(spark, sf_dir):
    return exploded(sql_cells(spark, sf_dir), sf.cte_names(CLEAN()), "cte")


@register(
    "sql_ctes_first",
    rf"WITH {o.SQLCELLS} SELECT notebook_path, cell_index, unnest(list_distinct("
    r"regexp_extract_all(clean, '(?i)\bWITH\s+(?:RECURSIVE\s+)?(\w+)\s+AS\s*\(', 1))) AS cte FROM sqlcells",
)
def sql_ctes_first(spark, sf_dir):
    return exploded(sql_cells(spark, sf_dir), sf.cte_names_first(CLEAN()), "cte")
