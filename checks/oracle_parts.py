"""Pieces of oracle SQL shared by several queries."""

from __future__ import annotations

from querylode import fixed_values as fv

from .fixture import cells_sql

CELLS = cells_sql()


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def no_comments(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '(?m)--.*$', '', 'g'), '(?s)/\*.*?\*/', '', 'g')"


def clean(x: str) -> str:
    return collapse(no_comments(rf"regexp_replace({x}, '(?im)^\s*%{{1,2}}sql\s*', '', 'g')"))


def is_sql(x: str) -> str:
    words = "|".join(fv.STATEMENT_KEYWORDS)
    return rf"regexp_matches({no_comments(x)}, '(?im)^\s*(?:{words})\s+|%sql\s+|%%sql')"


def values(items) -> str:
    return "(VALUES " + ", ".join(f"('{i}')" for i in items) + ")"


SUFFIX_RE = r"(?i)\b(\w+(?:" + "|".join(fv.TABLE_SUFFIXES) + r"))\b"

# sqlcells: every SQL cell with its cleaned text, CTE names and tables.
SQLCELLS = rf"""{CELLS},
sqlcells0 AS (
  SELECT *, {clean("source")} AS clean FROM cells
  WHERE cell_type = 'code' AND {is_sql("source")}),
sqlcells1 AS (
  SELECT *, list_concat(
      regexp_extract_all(clean, '(?i)\bWITH\s+(?:RECURSIVE\s+)?(\w+)\s+AS\s*\(', 1),
      regexp_extract_all(clean, '(?i)\),\s*(\w+)\s+AS\s*\(', 1)) AS ctes
  FROM sqlcells0),
sqlcells AS (
  SELECT *, list_sort(list_distinct(list_filter(list_concat(
      regexp_extract_all(clean, '(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+([\w.]+)', 1),
      regexp_extract_all(clean, '{SUFFIX_RE}', 1)), lambda x: NOT list_contains(ctes, x)))) AS tables
  FROM sqlcells1)"""

# toks: every token of every SQL cell with the nesting depth before it.
TOKENS = r"""
toks0 AS (
  SELECT notebook_path, cell_index,
         unnest(regexp_extract_all(clean, '(?s)''[^'']*''|"[^"]*"|\w+|\s+|.', 0)) AS t,
         generate_subscripts(regexp_extract_all(clean, '(?s)''[^'']*''|"[^"]*"|\w+|\s+|.', 0), 1) AS p
  FROM sqlcells),
toks AS (
  SELECT *, sum(CASE t WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)
              OVER (PARTITION BY notebook_path, cell_index ORDER BY p)
            - CASE t WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END AS depth
  FROM toks0)"""

_ENDS = ", ".join(f"'{w}'" for w in fv.WHERE_TERMINATORS)

# filters: the WHERE conditions of every SQL cell, from its token rows.
FILTERS = f"""{TOKENS},
kws AS (SELECT *, CASE WHEN depth = 0 THEN upper(t) END AS kw FROM toks),
acts AS (
  SELECT *,
    coalesce(last_value(CASE WHEN kw = 'WHERE' THEN 1 WHEN kw IN ({_ENDS}) THEN 0 END IGNORE NULLS) OVER w, 0) AS act,
    last_value(CASE WHEN kw IN ('BETWEEN', 'AND', 'OR', 'WHERE') THEN kw END IGNORE NULLS) OVER w AS prev
  FROM kws
  WINDOW w AS (PARTITION BY notebook_path, cell_index ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cuts AS (
  SELECT *, CASE WHEN kw = 'WHERE' AND act = 0 THEN 1
                 WHEN act = 1 AND (kw = 'OR' OR (kw = 'AND' AND prev IS DISTINCT FROM 'BETWEEN')) THEN 1
                 ELSE 0 END AS cut
  FROM acts),
grps AS (
  SELECT *, sum(cut) OVER (PARTITION BY notebook_path, cell_index ORDER BY p) AS grp FROM cuts),
filters0 AS (
  SELECT notebook_path, cell_index, grp, {strip("string_agg(t, '' ORDER BY p)")} AS filter
  FROM grps
  WHERE act = 1 AND cut = 0 AND coalesce(kw, '') NOT IN ({_ENDS})
  GROUP BY ALL),
filters AS (
  SELECT notebook_path, cell_index, filter,
         row_number() OVER (PARTITION BY notebook_path, cell_index ORDER BY grp) - 1 AS pos
  FROM filters0 WHERE filter <> '')"""

_JOIN_RE = r"(?i)\b(?:(FROM)|(?:(INNER|LEFT|RIGHT|FULL|CROSS)\s+)?(?:OUTER\s+)?JOIN)\s+([\w.]+)"

# joins: one row per JOIN of every SQL cell.
JOINS = rf"""
rels0 AS (
  SELECT notebook_path, cell_index,
         unnest(regexp_extract_all(clean, '{_JOIN_RE}', 1)) AS verb,
         unnest(regexp_extract_all(clean, '{_JOIN_RE}', 2)) AS kind,
         unnest(regexp_extract_all(clean, '{_JOIN_RE}', 3)) AS target,
         generate_subscripts(regexp_extract_all(clean, '{_JOIN_RE}', 3), 1) AS p
  FROM sqlcells),
rels AS (
  SELECT *, lag(target) OVER (PARTITION BY notebook_path, cell_index ORDER BY p) AS prev FROM rels0),
joins AS (
  SELECT notebook_path, cell_index, prev AS left_table, target AS right_table,
         coalesce(nullif(upper(kind), ''), 'INNER') AS join_type, p
  FROM rels WHERE coalesce(verb, '') = '' AND prev IS NOT NULL)"""

# aggs: aggregation names called in every SQL cell.
AGGS = rf"""
aggs AS (
  SELECT notebook_path, cell_index, n AS agg
  FROM sqlcells, {values(fv.AGGREGATIONS)} AS a(n)
  WHERE regexp_matches(upper(clean), '\b' || n || '\s*\('))"""

_BARE = ", ".join(f"'{n}'" for n in fv.BARE_DATE_FUNCTIONS)

# datefns: date functions used in every SQL cell.
DATEFNS = rf"""
datefns AS (
  SELECT notebook_path, cell_index, n AS fn
  FROM sqlcells, {values(fv.DATE_FUNCTIONS)} AS a(n)
  WHERE regexp_matches(upper(clean), '\b' || n || CASE WHEN n IN ({_BARE}) THEN '\b' ELSE '\s*\(' END))"""

# ctx: every cell with the markdown around it; extracts: the SQL cells of it.
CONTEXT = f"""
ctx AS (
  SELECT *,
    coalesce(array_to_string(list(source) FILTER (WHERE cell_type = 'markdown') OVER
      (PARTITION BY notebook_path ORDER BY cell_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' '), '') AS context_before,
    coalesce(array_to_string(list(source) FILTER (WHERE cell_type = 'markdown') OVER
      (PARTITION BY notebook_path ORDER BY cell_index ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), ' '), '') AS context_after
  FROM cells),
extracts AS (
  SELECT sha256(concat(notebook_path, chr(1), CAST(cell_index AS VARCHAR))) AS extract_id,
         notebook_path, cell_index, conv_id, source AS sql_query, context_before, context_after
  FROM ctx WHERE cell_type = 'code' AND {is_sql("source")})"""


def embed_text(prefix: str = "") -> str:
    p = prefix
    cl = clean(f"{p}sql_query")
    cl = rf"regexp_replace({cl}, '''[^'']{{{{{fv.LONG_LITERAL},}}}}''', '''{fv.LONG_LITERAL_MARK}''', 'g')".replace("{{", "{").replace("}}", "}")
    cl = rf"regexp_replace({cl}, '" + rf'"[^"]{{{fv.LONG_LITERAL},}}"' + rf"', '" + f'"{fv.LONG_LITERAL_MARK}"' + "', 'g')"
    b, a = strip(f"{p}context_before"), strip(f"{p}context_after")
    return (
        f"concat_ws(' | ', CASE WHEN {b} <> '' THEN 'Context: ' || {b} END, "
        f"'Query: ' || {cl}, "
        f"CASE WHEN {a} <> '' THEN 'Description: ' || {a} END, "
        f"'Source: ' || {p}notebook_path)"
    )


def terms(x: str) -> str:
    """Words of a text, as a list."""
    return (
        rf"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+'), "
        "lambda w: w <> '')"
    )
