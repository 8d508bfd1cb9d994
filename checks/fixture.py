"""The notebook corpus that the registered queries derive from the given tables.

One conversation is one notebook, one turn is one cell. Assistant turns are code cells whose source
is one of ten templates, chosen by the conversation and turn; other turns are markdown cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The ten code templates. {n} is a line end, {y} a year.
TEMPLATES = [
    "SELECT customer_id, SUM(amount) AS total{n}FROM sales_fact{n}WHERE sale_date >= '{y}-01-01' AND status = 'open'{n}GROUP BY customer_id",
    "SELECT c.name, COUNT(*) FROM customers c INNER JOIN sales_fact s ON c.id = s.customer_id LEFT JOIN region_dim r ON s.rid = r.rid WHERE s.sale_date BETWEEN '{y}-01-01' AND '{y}-12-31'",
    "WITH monthly_sales AS ({n}  SELECT DATE_TRUNC('month', d) AS m, SUM(revenue) AS rev FROM orders_fact GROUP BY 1{n}), x AS (SELECT 1){n}SELECT m, rev FROM monthly_sales WHERE rev > 10{y}",
    "SELECT id FROM sales_raw WHERE amount > ( SELECT AVG(amount) FROM sales_raw WHERE yr = {y} ) OR flag = 1 ORDER BY id LIMIT 5",
    "%sql SELECT * FROM users_dim WHERE users_dim.created_year = {y}",
    "%%sql{n}SELECT MIN(price), MAX(price) FROM price_stage FULL OUTER JOIN fx_dim ON a = b",
    "-- churn by plan{n}SELECT plan_tbl.plan, /* inline{n}note */ COUNT(DISTINCT u) FROM plan_tbl WHERE plan_tbl.yr = {y} -- tail",
    "INSERT INTO audit_table SELECT id, UPDATED_AT FROM events_raw WHERE y = {y}",
    "print('rows', {y})",
    "with open('f{y}.txt') as fh:{n}    pass",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source(role: Column, text: Column, conv_id: Column, turn: Column) -> Column:
    body = F.element_at(
        F.array(*[F.lit(t) for t in TEMPLATES]),
        (F.pmod(conv_id * 7 + turn, F.lit(len(TEMPLATES))) + 1).cast("int"),
    )
    year = (F.pmod(conv_id, F.lit(5)) + 2020).cast("string")
    filled = F.replace(F.replace(body, F.lit("{n}"), F.lit("\n")), F.lit("{y}"), year)
    return F.when(role == "assistant", filled).otherwise(text)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """notebook_path, notebook_type, cell_index, cell_type, source, execution_count."""
    c = table(spark, sf_dir, "conversations")
    role, text, conv, turn = (F.col(n) for n in ("role", "text", "conv_id", "turn"))
    return c.select(
        F.concat(F.lit("nb/"), conv.cast("string"), F.lit(".ipynb")).alias("notebook_path"),
        F.lit("jupyter").alias("notebook_type"),
        turn.cast("int").alias("cell_index"),
        F.when(role == "assistant", "code").otherwise("markdown").alias("cell_type"),
        _source(role, text, conv, turn).alias("source"),
        turn.cast("int").alias("execution_count"),
    )


def cells_sql() -> str:
    """The same rows in the oracle's SQL, as a CTE named ``cells``."""
    rows = ", ".join(
        "({}, '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(TEMPLATES)
    )
    return f"""
tpl AS (SELECT * FROM (VALUES {rows}) AS t(k, body)),
cells AS (
  SELECT concat('nb/', CAST(c.conv_id AS VARCHAR), '.ipynb') AS notebook_path,
         c.turn AS cell_index, c.conv_id,
         CASE WHEN c.role = 'assistant' THEN 'code' ELSE 'markdown' END AS cell_type,
         CASE WHEN c.role = 'assistant'
              THEN replace(replace(t.body, '{{n}}', chr(10)), '{{y}}', CAST(2020 + c.conv_id % 5 AS VARCHAR))
              ELSE c.text END AS source
  FROM conversations c JOIN tpl t ON t.k = (c.conv_id * 7 + c.turn) % 10)"""
