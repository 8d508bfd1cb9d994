"""Registered queries over corpus patterns, rendering and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from querylode import fixed_values as fv
from querylode.functions import sqlfeatures as sf
from querylode.operators import patterns, render, schema_match
from querylode.plans.build import pattern_lines
from querylode.session import checkpointed
from querylode.sources import catalog

from . import oracle_parts as o
from .corpus_queries import sql_cells
from .fixture import table
from .registry import register


def features(spark, sf_dir):
    return sf.with_features(sql_cells(spark, sf_dir)).withColumn(
        "extract_id", F.concat_ws("/", "notebook_path", F.col("cell_index").cast("string"))
    )


def usage(spark, sf_dir):
    return patterns.usage_counts(features(spark, sf_dir))


BASE = f"WITH {o.SQLCELLS}, {o.FILTERS}, {o.JOINS}, {o.AGGS}, {o.DATEFNS}"
USED = "used AS (SELECT notebook_path, cell_index, unnest(tables) AS table_name FROM sqlcells)"
BP_FILTERS = f"""bp_filters AS (
  SELECT * FROM (
    SELECT table_name, filter, n, row_number() OVER (PARTITION BY table_name ORDER BY n DESC, filter) AS rk
    FROM (SELECT u.table_name, f.filter, count(*) AS n FROM used u
          JOIN filters f USING (notebook_path, cell_index)
          WHERE contains(lower(f.filter), lower(u.table_name)) GROUP BY ALL))
  WHERE rk <= {fv.TOP_PATTERNS})"""
BP_AGGS = f"""bp_aggs AS (
  SELECT * FROM (
    SELECT table_name, agg, n, row_number() OVER (PARTITION BY table_name ORDER BY n DESC, agg) AS rk
    FROM (SELECT u.table_name, a.agg, count(*) AS n FROM used u
          JOIN aggs a USING (notebook_path, cell_index) GROUP BY ALL))
  WHERE rk <= {fv.TOP_PATTERNS})"""
DATE_WORDS = "|".join(fv.DATE_WORDS)
BP_DATES = f"""bp_dates AS (
  SELECT notebook_path, cell_index, pos, filter FROM filters
  WHERE (notebook_path, cell_index) IN (SELECT (notebook_path, cell_index) FROM datefns)
    AND regexp_matches(lower(filter), '{DATE_WORDS}'))"""


@register(
    "bp_relationships",
    f"{BASE} SELECT left_table, right_table, count(*) AS n FROM joins GROUP BY ALL",
)
def bp_relationships(spark, sf_dir):
    return patterns.relationships(usage(spark, sf_dir))


@register(
    "bp_join_counts",
    f"{BASE} SELECT left_table || '-' || right_table AS relationship, count(*) AS n FROM joins GROUP BY ALL",
)
def bp_join_counts(spark, sf_dir):
    return patterns.join_counts(usage(spark, sf_dir))


@register("bp_filters_top5", f"{BASE}, {USED}, {BP_FILTERS} SELECT * FROM bp_filters")
def bp_filters_top5(spark, sf_dir):
    return patterns.common_filters(usage(spark, sf_dir))


@register("bp_aggs_top5", f"{BASE}, {USED}, {BP_AGGS} SELECT * FROM bp_aggs")
def bp_aggs_top5(spark, sf_dir):
    return patterns.common_aggregations(usage(spark, sf_dir))


@register(
    "bp_calculations",
    f"{BASE} SELECT notebook_path, cell_index, source AS sql_query FROM sqlcells "
    f"WHERE regexp_matches(lower(source), '{'|'.join(fv.BUSINESS_KEYWORDS)}')",
)
def bp_calculations(spark, sf_dir):
    return patterns.business_calculations(features(spark, sf_dir))


@register("bp_date_filters", f"{BASE}, {BP_DATES} SELECT * FROM bp_dates")
def bp_date_filters(spark, sf_dir):
    dates = patterns.date_filters(features(spark, sf_dir))
    return dates.withColumn("pos", F.col("pos").cast("long"))


_EVENT_FILTERS = """dated AS (SELECT 'ev/' || event_id AS notebook_path, user_id, event_type FROM events WHERE event_id % 2 = 0),
found AS (
  SELECT notebook_path, 0::BIGINT AS pos, 'ts_time >= DATEADD(day, -' || (user_id % 30) || ', CURRENT_DATE)' AS filter FROM dated
  UNION ALL SELECT notebook_path, 1, 'kind = ' || chr(39) || event_type || chr(39) FROM dated
  UNION ALL SELECT notebook_path, 2, 'yearly = ' || user_id FROM dated)"""


def event_queries(spark, sf_dir):
    """event_id, user_id, sql_query: every event as a query; every other one uses date functions."""
    user = F.col("user_id")
    days = (user % 30).cast("string")
    dated = F.concat(
        F.lit("SELECT COUNT(*)\nFROM events_raw -- one event\nWHERE ts_time >= DATEADD(day, -"),
        days,
        F.lit(", CURRENT_DATE)\n  AND kind = '"),
        "event_type",
        F.lit("' OR yearly = "),
        user.cast("string"),
        F.lit(" GROUP BY 1"),
    )
    plain = F.concat(F.lit("SELECT COUNT(*) FROM events_raw WHERE ts_time >= "), days)
    sql = F.when(F.col("event_id") % 2 == 0, dated).otherwise(plain)
    return table(spark, sf_dir, "events").select("event_id", "user_id", sql.alias("sql_query"))


@register(
    "bp_event_date_filters",
    f"WITH {_EVENT_FILTERS} SELECT notebook_path, 0::BIGINT AS cell_index, pos, filter FROM found "
    f"WHERE regexp_matches(lower(filter), '{DATE_WORDS}')",
)
def bp_event_date_filters(spark, sf_dir):
    queries = event_queries(spark, sf_dir).select(
        F.concat(F.lit("ev/"), F.col("event_id").cast("string")).alias("notebook_path"),
        F.lit(0).cast("long").alias("cell_index"),
        "sql_query",
    )
    found = patterns.date_filters(sf.with_features(queries))
    return found.withColumn("pos", F.col("pos").cast("long"))


def bp_lines(spark, sf_dir):
    """The counts feed three sections, so they are computed once and read back."""
    return pattern_lines(checkpointed(usage(spark, sf_dir)), patterns.date_filters(features(spark, sf_dir)))


def _chr(text):
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


BP_LINES = f"""{BASE}, {USED}, {BP_FILTERS}, {BP_AGGS}, {BP_DATES},
body AS (
  SELECT 1 AS section, left_table AS key, '- ' || left_table || ' commonly joined with: '
         || string_agg(right_table, ', ' ORDER BY right_table) AS line
  FROM (SELECT DISTINCT left_table, right_table FROM joins) GROUP BY left_table
  UNION ALL SELECT 2, table_name, '- ' || table_name || ': ' || string_agg(filter, ', ' ORDER BY rk)
  FROM bp_filters WHERE rk <= 3 GROUP BY table_name
  UNION ALL SELECT 3, table_name, '- ' || table_name || ': ' || string_agg(agg, ', ' ORDER BY rk)
  FROM bp_aggs WHERE rk <= 3 GROUP BY table_name
  UNION ALL SELECT DISTINCT 4, filter, '- ' || filter
  FROM (SELECT * FROM bp_dates ORDER BY notebook_path, cell_index, pos LIMIT 5)),
lines AS (
  SELECT * FROM body UNION ALL
  SELECT section, '', CASE section WHEN 1 THEN {_chr(fv.HEAD_RELATIONSHIPS)} WHEN 2 THEN {_chr(fv.HEAD_FILTERS)}
    WHEN 3 THEN {_chr(fv.HEAD_AGGREGATIONS)} ELSE {_chr(fv.HEAD_DATE_FILTERS)} END
  FROM (SELECT DISTINCT section FROM body))"""


@register(
    "bp_render",
    f"{BP_LINES} SELECT CAST(section AS BIGINT) AS section, key, line FROM lines",
)
def bp_render(spark, sf_dir):
    return bp_lines(spark, sf_dir).withColumn("section", F.col("section").cast("long"))


@register(
    "bp_text",
    f"{BP_LINES} SELECT string_agg(line, chr(10) ORDER BY section, key, line) AS content FROM lines",
)
def bp_text(spark, sf_dir):
    return render.as_text(bp_lines(spark, sf_dir), ["section", "key"])


@register(
    "kb_table_pattern",
    f"""{BASE}, parts AS (SELECT notebook_path, cell_index, tables,
  (SELECT string_agg(left_table || ' ' || join_type || ' JOIN ' || right_table, '; ' ORDER BY p)
   FROM joins j WHERE j.notebook_path = s.notebook_path AND j.cell_index = s.cell_index) AS js,
  (SELECT string_agg(left_table || '-' || right_table, ';' ORDER BY p)
   FROM joins j WHERE j.notebook_path = s.notebook_path AND j.cell_index = s.cell_index) AS names,
  (SELECT string_agg(agg, ', ' ORDER BY agg)
   FROM aggs a WHERE a.notebook_path = s.notebook_path AND a.cell_index = s.cell_index) AS ags
  FROM sqlcells s)
SELECT notebook_path, cell_index, concat_ws(' | ',
    CASE WHEN len(tables) > 0 THEN 'Tables: ' || array_to_string(tables, ', ') END,
    'Joins: ' || js, 'Aggregations: ' || ags) AS table_pattern, coalesce(names, '') AS join_names
FROM parts""",
)
def kb_table_pattern(spark, sf_dir):
    return features(spark, sf_dir).select(
        "notebook_path",
        "cell_index",
        render.table_pattern(F.col("tables"), F.col("joins"), F.col("aggregations")).alias(
            "table_pattern"
        ),
        F.array_join(render.join_names(F.col("joins")), ";").alias("join_names"),
    )


# Base names of the described tables.
NAMES = [
    "sales_fact", "customers", "region_dim", "orders_fact", "sales_raw",
    "users_dim", "price_stage", "plan_tbl", "audit_table", "events_raw",
]
TYPES = ["string", "bigint", "double", "date"]


def export(spark, sf_dir):
    """(catalog_tables, catalog_columns): every conversation describes a table, every turn a column."""
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    base = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (conv % 10 + 1).cast("int"))
    keyed = c.select(
        "*",
        F.concat(F.lit("db"), (conv % 7).cast("string")).alias("database"),
        F.concat(base, F.lit("_v"), conv.cast("string")).alias("name"),
    ).withColumn("table_key", catalog.table_key(F.col("database"), F.col("name")))
    described = F.concat(F.lit("Table of conversation "), conv.cast("string"))
    tables = keyed.groupBy("database", "name", "table_key", "conv_id").agg(
        F.count_if(F.col("role") != "system").alias("n_columns")
    ).withColumn("description", F.when(conv % 3 > 0, described))
    columns = keyed.select(
        "table_key",
        turn.alias("pos"),
        F.concat("role", F.lit("_"), turn.cast("string")).alias("name"),
        F.element_at(F.array(*[F.lit(t) for t in TYPES]), (turn % 4 + 1).cast("int")).alias("type"),
        F.when(turn % 2 == 0, F.concat(F.lit("turn "), turn.cast("string"))).alias("comment"),
        (F.col("role") == "system").alias("is_partition"),
    )
    return tables, columns


_NAME_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
EXPORT = f"""keyed AS (
  SELECT *, 'db' || (conv_id % 7) AS database, {_NAME_LIST}[conv_id % 10 + 1] || '_v' || conv_id AS name
  FROM conversations),
cat_tables AS (
  SELECT database, name, database || '.' || name AS table_key, conv_id,
         count(*) FILTER (WHERE role <> 'system') AS n_columns,
         CASE WHEN conv_id % 3 > 0 THEN 'Table of conversation ' || conv_id END AS description
  FROM keyed GROUP BY ALL),
cat_columns AS (
  SELECT database || '.' || name AS table_key, turn AS pos, role || '_' || turn AS name,
         {_TYPE_LIST}[turn % 4 + 1] AS type, CASE WHEN turn % 2 = 0 THEN 'turn ' || turn END AS comment,
         role = 'system' AS is_partition
  FROM keyed)"""


SCHEMA_LINES = f"""schema_lines AS (
SELECT table_key, 0::BIGINT AS section, 0::BIGINT AS pos, chr(10) || '## Table: ' || table_key AS line FROM cat_tables
UNION ALL SELECT table_key, 1, 0, 'Description: ' || description FROM cat_tables WHERE description IS NOT NULL
UNION ALL SELECT table_key, 2, 0, 'Columns:' FROM cat_tables
UNION ALL SELECT DISTINCT table_key, 4, 0, 'Partition Keys:' FROM cat_columns WHERE is_partition
UNION ALL SELECT table_key, CASE WHEN is_partition THEN 5 ELSE 3 END, pos,
  '  - ' || name || ' (' || type || ')' || coalesce(' - ' || comment, '') FROM cat_columns)"""


@register("schema_render", f"WITH {EXPORT}, {SCHEMA_LINES} SELECT * FROM schema_lines")
def schema_render(spark, sf_dir):
    tables, columns = export(spark, sf_dir)
    return render.schema_lines(tables, columns).select(
        "table_key",
        F.col("ord.section").cast("long").alias("section"),
        F.col("ord.pos").alias("pos"),
        "line",
    )


@register(
    "cat_targets",
    f"""WITH {EXPORT},
specs AS (SELECT DISTINCT CASE WHEN role = 'user' THEN name ELSE database || '.' || name END AS spec FROM keyed)
SELECT split_part(spec, '.', 1) AS database, split_part(spec, '.', 2) AS name FROM specs WHERE contains(spec, '.')
UNION SELECT database, name FROM cat_tables
WHERE database IN (SELECT 'db' || (conv_id % 7) FROM conversations WHERE role = 'system')""",
)
def cat_targets(spark, sf_dir):
    tables, _ = export(spark, sf_dir)
    roles = table(spark, sf_dir, "conversations").select("conv_id", "role").join(tables, "conv_id")
    specs = roles.select(
        F.when(F.col("role") == "user", F.col("name")).otherwise(F.col("table_key")).alias("spec")
    ).distinct()
    listed = roles.filter(F.col("role") == "system").select("database")
    return catalog.targets(specs, tables, listed)


@register(
    "cat_metadata",
    f"""WITH {EXPORT}, wanted AS (SELECT DISTINCT database, name FROM keyed WHERE role = 'system')
SELECT t.database, t.name, t.table_key, t.description, t.n_columns FROM cat_tables t
JOIN wanted w USING (database, name)""",
)
def cat_metadata(spark, sf_dir):
    tables, _ = export(spark, sf_dir)
    systems = table(spark, sf_dir, "conversations").filter(F.col("role") == "system")
    wanted = tables.join(systems.select("conv_id").distinct(), "conv_id", "left_semi")
    return catalog.select_targets(tables, wanted).select(
        "database", "name", "table_key", "description", "n_columns"
    )


@register(
    "cat_schema_match",
    f"""{BASE}, {USED}, {EXPORT},
names AS (SELECT DISTINCT table_name FROM used),
matches AS (
  SELECT n.table_name, c.table_key, c.n_columns,
         row_number() OVER (PARTITION BY n.table_name ORDER BY c.table_key) AS r
  FROM names n JOIN cat_tables c ON contains(lower(c.table_key), lower(n.table_name)))
SELECT u.notebook_path || '/' || u.cell_index AS extract_id,
       string_agg(m.table_key || ': ' || m.n_columns || ' columns', '; ' ORDER BY u.table_name) AS schema_context
FROM used u JOIN matches m ON m.table_name = u.table_name AND m.r = 1 GROUP BY ALL""",
)
def cat_schema_match(spark, sf_dir):
    tables, _ = export(spark, sf_dir)
    return schema_match.schema_context(features(spark, sf_dir), tables)
