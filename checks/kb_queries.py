"""Registered queries over the stored knowledge base, prompts, replies and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from querylode import fixed_values as fv
from querylode import tables
from querylode.functions import replies as rp
from querylode.functions import text as tx
from querylode.functions import vectors as vec
from querylode.operators import patterns, prompts, render
from querylode.operators.store import KnowledgeBase
from querylode.plans import answer as ans
from querylode.plans import build as bld
from querylode.session import new_dir
from querylode.streaming import ingest

from . import oracle_parts as o
from .corpus_queries import raw_files
from .fixture import cells, table
from .pattern_queries import _EVENT_FILTERS, BP_LINES, DATE_WORDS, EXPORT, SCHEMA_LINES, _chr, bp_lines, event_queries, export
from .registry import ORACLES, register
from .search_queries import HYBRID, bm25_sql, cited_hits

L = "long"

# Documents and their later edits, as one stream of versions.
VERSIONS = """versions AS (
  SELECT doc_id, 1::BIGINT AS version, lang AS source, n_chars FROM documents
  UNION ALL SELECT doc_id, 2, source || '/edited', n_chars + 1 FROM documents d
  WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT item_id, 3, 'benchmark', length(text) FROM benchmark)"""


@register(
    "kb_upsert",
    f"""WITH {VERSIONS} SELECT doc_id, version, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) AS rn FROM versions) WHERE rn = 1""",
)
def kb_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    first = docs.select("doc_id", F.lit(1).cast(L).alias("version"), F.col("lang").alias("source"), "n_chars")
    edits = docs.join(labels, "doc_id", "left_semi").select(
        "doc_id",
        F.lit(2).cast(L).alias("version"),
        F.concat("source", F.lit("/edited")).alias("source"),
        (F.col("n_chars") + 1).alias("n_chars"),
    )
    third = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("doc_id"),
        F.lit(3).cast(L).alias("version"),
        F.lit("benchmark").alias("source"),
        F.length("text").cast(L).alias("n_chars"),
    )
    kb = KnowledgeBase(spark, new_dir(spark, "kb"))
    kb.create()
    for load in (first, edits, third):
        kb.index(
            _as_documents(
                load,
                doc_id=F.col("doc_id").cast("string"),
                execution_count=F.col("version").cast("int"),
                notebook_path=F.col("source"),
                cell_index=F.col("n_chars").cast("int"),
            )
        )
    return kb.documents().select(
        F.col("doc_id").cast(L).alias("doc_id"),
        F.col("execution_count").cast(L).alias("version"),
        F.col("notebook_path").alias("source"),
        F.col("cell_index").cast(L).alias("n_chars"),
    )


@register(
    "kb_upsert_unchanged",
    """SELECT doc_id, CASE WHEN edited THEN 2 ELSE 1 END::BIGINT AS load,
  CASE WHEN edited THEN source || '/edited' ELSE source END AS source, n_chars
FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels) AS edited FROM documents)""",
)
def kb_upsert_unchanged(spark, sf_dir):
    """All documents come twice, some of them edited: the second load writes only these."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit("/edited").alias("edit")).distinct()
    again = docs.join(labels, "doc_id", "left").withColumn("source", F.concat("source", F.coalesce("edit", F.lit(""))))
    kb = KnowledgeBase(spark, new_dir(spark, "kb"))
    for load in (docs, again):
        kb.index(
            _as_documents(
                load,
                doc_id=F.col("doc_id").cast("string"),
                notebook_path=F.col("source"),
                cell_index=F.col("n_chars").cast("int"),
            ),
            skip_unchanged=True,
        )
    first = kb.commits()[0]["version"]
    return kb.documents().select(
        F.col("doc_id").cast(L).alias("doc_id"),
        F.when(F.col("version") == first, 1).otherwise(2).cast(L).alias("load"),
        F.col("notebook_path").alias("source"),
        F.col("cell_index").cast(L).alias("n_chars"),
    )


@register(
    "kb_compact",
    """SELECT d.doc_id, CASE WHEN b.doc_id IS NOT NULL THEN 'benchmark' WHEN l.doc_id IS NOT NULL THEN source || '/edited'
  ELSE source END AS source, (SELECT count(*) FROM benchmark) AS newest_load
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
LEFT JOIN (SELECT item_id AS doc_id FROM benchmark) b USING (doc_id)
UNION ALL SELECT item_id, 'benchmark', (SELECT count(*) FROM benchmark) FROM benchmark
WHERE item_id NOT IN (SELECT doc_id FROM documents)""",
)
def kb_compact(spark, sf_dir):
    """Two loads, a compaction, and a third load that replaces documents of the compacted base."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    edits = docs.join(labels, "doc_id", "left_semi").withColumn("source", F.concat("source", F.lit("/edited")))
    third = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("benchmark").alias("source"))
    kb = KnowledgeBase(spark, new_dir(spark, "kb"))

    def index(load):
        kb.index(_as_documents(load, doc_id=F.col("doc_id").cast("string"), notebook_path=F.col("source")))

    index(docs)
    index(edits)
    kb.compact()
    index(third)
    newest = kb.commits()[1]["documents"]
    return kb.documents().select(
        F.col("doc_id").cast(L).alias("doc_id"),
        F.col("notebook_path").alias("source"),
        F.lit(newest).cast(L).alias("newest_load"),
    )


def _as_documents(df, **columns):
    """Rows as documents of a knowledge base; other fields are null."""
    fields = tables.schema(tables.DOCS).fields
    return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


@register(
    "kb_embed_counts",
    rf"""SELECT source, count(*) AS n_documents,
  count(*) FILTER (WHERE regexp_matches(text, '[\p{{L}}\p{{N}}]')) AS n_embedded
FROM documents GROUP BY source""",
)
def kb_embed_counts(spark, sf_dir):
    embedding = vec.embed(F.col("text"))
    return (
        table(spark, sf_dir, "documents")
        .select("source", embedding.isNotNull().alias("ok"))
        .groupBy("source")
        .agg(F.count("*").alias("n_documents"), F.count_if("ok").alias("n_embedded"))
    )


def _indexed(spark, docs):
    kb = KnowledgeBase(spark, new_dir(spark, "kb"))
    kb.index(
        _as_documents(
            docs,
            doc_id=F.col("doc_id").cast("string"),
            notebook_path=F.col("source"),
            notebook_type=F.col("lang"),
            sql_query=F.col("text"),
        )
    )
    return kb


@register(
    "kb_get",
    "SELECT doc_id, lang, source, text FROM documents WHERE doc_id IN (SELECT max(doc_id) FROM documents)",
)
def kb_get(spark, sf_dir):
    """All documents are indexed; the one with the largest id is looked up."""
    docs = table(spark, sf_dir, "documents")
    kb = _indexed(spark, docs)
    wanted = str(docs.agg(F.max("doc_id")).first()[0])
    return kb.get(wanted).select(
        F.col("doc_id").cast(L).alias("doc_id"),
        F.col("notebook_type").alias("lang"),
        F.col("notebook_path").alias("source"),
        F.col("sql_query").alias("text"),
    )


@register(
    "kb_get_all",
    "SELECT d.doc_id, d.lang, d.source, CAST(l.quality AS BIGINT) AS quality FROM documents d JOIN labels l USING (doc_id)",
)
def kb_get_all(spark, sf_dir):
    """Lookup by id for a whole table of ids."""
    labels = table(spark, sf_dir, "labels")
    wanted = labels.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast(L).alias("quality"))
    return _indexed(spark, table(spark, sf_dir, "documents")).get_all(wanted).select(
        F.col("doc_id").cast(L).alias("doc_id"),
        F.col("notebook_type").alias("lang"),
        F.col("notebook_path").alias("source"),
        "quality",
    )


@register("kb_relationships", ORACLES["bp_relationships"])
def kb_relationships(spark, sf_dir):
    """Joins of tables as a knowledge base counts them after three loads, one of them replacing documents."""
    kb = KnowledgeBase(spark, new_dir(spark, "kb"))
    raw = raw_files(spark, sf_dir, "jupyter")
    half = F.pmod(F.xxhash64("notebook_path"), F.lit(2))
    bld.build(kb, raw.filter(half == 0))
    bld.build(kb, raw.filter(half == 1))
    bld.build(kb, raw.filter(half == 0))
    return patterns.relationships(kb.usage())


@register(
    "kb_chunks",
    """SELECT doc_id, i AS chunk, substr(text, i * 1000 + 1, 1000) AS piece
FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)))) AS i FROM documents)""",
)
def kb_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(tx.chunks(F.col("text"), 1000)).alias("chunk", "piece")).withColumn(
        "chunk", F.col("chunk").cast(L)
    )


def built(spark, sf_dir, chunk_size=None):
    """A knowledge base loaded from the fixture's notebooks."""
    kb = KnowledgeBase(spark, new_dir(spark, "kb") + "/notebooks")
    bld.build(kb, raw_files(spark, sf_dir, "jupyter"), export(spark, sf_dir), force=True, chunk_size=chunk_size)
    return kb


PARTS = f"""{o.SQLCELLS}, {o.FILTERS}, {o.JOINS}, {o.AGGS},
parts AS (SELECT *, cell_index // 256 AS part, cell_index % 256 AS pos,
   replace(notebook_path, '.ipynb', '') || '#' || (cell_index // 256) || '.ipynb' AS file FROM cells),
pctx AS (SELECT *,
  coalesce(array_to_string(list(source) FILTER (WHERE cell_type = 'markdown') OVER
    (PARTITION BY file ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' '), '') AS context_before,
  coalesce(array_to_string(list(source) FILTER (WHERE cell_type = 'markdown') OVER
    (PARTITION BY file ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), ' '), '') AS context_after
  FROM parts),
pdocs AS (SELECT sha256(concat(file, chr(1), CAST(pos AS VARCHAR))) AS doc_id, file AS notebook_path,
   p.pos AS cell_index, p.source AS sql_query, p.context_before, p.context_after, s.tables,
   p.notebook_path AS npath, p.cell_index AS ncell
  FROM pctx p JOIN sqlcells s ON s.notebook_path = p.notebook_path AND s.cell_index = p.cell_index)"""


@register(
    "kb_build",
    f"""WITH {PARTS}
SELECT doc_id, notebook_path, cell_index, sql_query, context_before, context_after,
  {o.embed_text()} AS business_context, array_to_string(tables, ',') AS tables_used,
  coalesce((SELECT string_agg(filter, ' & ' ORDER BY pos) FROM filters f
            WHERE f.notebook_path = d.npath AND f.cell_index = d.ncell), '') AS filters,
  coalesce((SELECT string_agg(agg, ',' ORDER BY agg) FROM aggs a
            WHERE a.notebook_path = d.npath AND a.cell_index = d.ncell), '') AS aggregations
FROM pdocs d""",
)
def kb_build(spark, sf_dir):
    return _documents(built(spark, sf_dir))


def _documents(kb):
    return kb.documents().select(
        "doc_id",
        "notebook_path",
        F.col("cell_index").cast(L).alias("cell_index"),
        "sql_query",
        "context_before",
        "context_after",
        "business_context",
        F.array_join("tables_used", ",").alias("tables_used"),
        F.array_join("filters", " & ").alias("filters"),
        F.array_join("aggregations", ",").alias("aggregations"),
    )


@register(
    "kb_stats",
    f"""WITH {PARTS}, {EXPORT}
SELECT count(*) AS document_count, 2::BIGINT AS meta_count, true AS has_bytes, 'healthy' AS status, 'build' AS source,
  '{fv.EMBED_MODEL}' AS model, 'notebooks' AS index_name,
  (SELECT count(DISTINCT database) FROM cat_tables) AS n_databases, (SELECT count(*) FROM cat_tables) AS n_tables FROM pdocs""",
)
def kb_stats(spark, sf_dir):
    return built(spark, sf_dir).stats().withColumn("has_bytes", F.col("index_size") > 0).drop("index_size")


_USER_NOTEBOOKS = f"""{_EVENT_FILTERS},
placed AS (SELECT 'ev/' || event_id AS event_path, 'users/' || user_id || '.ipynb' AS notebook_path,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS cell_index FROM events),
user_dates AS (SELECT p.notebook_path, p.cell_index, f.pos, f.filter FROM found f JOIN placed p ON p.event_path = f.notebook_path
  WHERE regexp_matches(lower(filter), '{DATE_WORDS}'))"""


def _after_three_loads(spark, sf_dir):
    """A notebook per user, whose cells are the user's events as queries. Half of the users are loaded with other queries
    at first, which a third load replaces."""
    queries = event_queries(spark, sf_dir).select("event_id", "user_id", "sql_query")
    kb = KnowledgeBase(spark, new_dir(spark, "kb"))
    older = queries.withColumn("sql_query", F.concat(F.lit("SELECT DATEADD(day, 1, d), MAX(x) FROM old_fact WHERE day = "), "user_id"))
    half = F.pmod(F.xxhash64("user_id"), F.lit(2))
    for part in (older.filter(half == 0), queries.filter(half == 1), queries.filter(half == 0)):
        cell = F.to_json(F.struct(F.lit("code").alias("cell_type"), F.col("sql_query").alias("source")))
        in_order = F.transform(F.sort_array(F.collect_list(F.struct("event_id", cell.alias("j")))), lambda c: c["j"])
        raw = part.groupBy("user_id").agg(F.concat(F.lit('{"cells":['), F.array_join(in_order, ","), F.lit("]}")).alias("value"))
        bld.build(kb, raw.select(
            F.concat(F.lit("users/"), F.col("user_id").cast("string"), F.lit(".ipynb")).alias("notebook_path"),
            "value", F.lit(None).cast("timestamp").alias("modified"),
        ))
    return kb


@register("kb_date_filters", f"WITH {_USER_NOTEBOOKS} SELECT notebook_path, cell_index, pos, filter FROM user_dates")
def kb_date_filters(spark, sf_dir):
    """The stored date filters after loads that replace others."""
    return _after_three_loads(spark, sf_dir).date_filters().select(
        "notebook_path", F.col("cell_index").cast(L).alias("cell_index"), F.col("pos").cast(L).alias("pos"), "filter"
    )


@register(
    "kb_patterns_after_loads",
    f"""WITH {_USER_NOTEBOOKS},
body AS (SELECT '3' AS section, 'events_raw' AS key, '- events_raw: COUNT' AS line
  UNION ALL SELECT DISTINCT '4', filter, '- ' || filter
  FROM (SELECT * FROM user_dates ORDER BY notebook_path, cell_index, pos LIMIT {fv.RENDERED_DATE_FILTERS}))
SELECT section, key, line FROM body UNION ALL SELECT DISTINCT section, '',
  CASE section WHEN '3' THEN {_chr(fv.HEAD_AGGREGATIONS)} ELSE {_chr(fv.HEAD_DATE_FILTERS)} END FROM body""",
)
def kb_patterns_after_loads(spark, sf_dir):
    """The stored pattern description after the same loads."""
    lines = _after_three_loads(spark, sf_dir).meta_lines(fv.PATTERNS_DOC[0])
    return lines.select(F.col("ord")[0].alias("section"), F.col("ord")[1].alias("key"), "line")


def _write_files(raw, path):
    """One notebook file per row, written by the tasks below a folder they all share."""

    def write(rows):
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
        for row in rows:
            name = f"{base}/{row['notebook_path'].replace('#', '-')}"
            target.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with target.open_output_stream(name) as out:
                out.write(row["value"].encode())

    raw.select("notebook_path", "value").foreachPartition(write)


@register(
    "stream_ingest",
    f"WITH {PARTS} SELECT npath AS notebook_path, ncell AS cell_index, sql_query, context_before, context_after FROM pdocs",
)
def stream_ingest(spark, sf_dir):
    """The fixture's notebooks arrive as files in three drops; the stream runs after each."""
    root = new_dir(spark, "drops")
    kb = KnowledgeBase(spark, f"{root}/kb")
    raw = raw_files(spark, sf_dir, "jupyter")
    for drop in range(3):
        arrived = raw.filter(F.pmod(F.xxhash64("notebook_path"), F.lit(3)) == drop)
        _write_files(arrived, f"{root}/files/drop{drop}")
        ingest.start(kb, f"{root}/files", f"{root}/checkpoint").awaitTermination()
    name, part = (F.regexp_extract("notebook_path", r"(nb/\d+)-(\d+)\.ipynb$", i) for i in (1, 2))
    return kb.documents().select(
        F.concat(name, F.lit(".ipynb")).alias("notebook_path"),
        (part.cast(L) * 256 + F.col("cell_index")).alias("cell_index"),
        "sql_query",
        "context_before",
        "context_after",
    )


RAG = f"""{HYBRID},
ex AS (SELECT h.qid, string_agg(
    concat_ws(chr(10), chr(10) || '### Example ' || h.rank || printf(' (similarity: %.3f)', h.score),
      CASE WHEN d.lang <> 'en' THEN 'Context: ' || d.lang END, 'SQL: ' || d.text), chr(10) ORDER BY h.rank) AS t
  FROM hits h JOIN documents d USING (doc_id) WHERE h.rank <= 3 GROUP BY h.qid),
rag AS (SELECT qid, {_chr(fv.HEAD_PATTERNS)} || chr(10)
    || (SELECT string_agg(line, chr(10) ORDER BY section, key, line) FROM lines)
    || chr(10) || {_chr(fv.HEAD_EXAMPLES)} || chr(10) || t AS rag_context FROM ex)"""


def _rag(spark, sf_dir):
    patterns_text = render.as_text(bp_lines(spark, sf_dir), ["section", "key"]).scalar()
    found = prompts.examples(cited_hits(spark, sf_dir))
    return prompts.rag_context(found, patterns_text=patterns_text)


@register("rag_context", f"{BP_LINES}, {RAG} SELECT qid, rag_context FROM rag")
def rag_context(spark, sf_dir):
    return _rag(spark, sf_dir)


@register(
    "prompt",
    f"""{BP_LINES}, {RAG} SELECT qid, {_chr(fv.PROMPT_CONTEXT)} || rag_context || {_chr(fv.PROMPT_QUESTION)}
  || b.text || {_chr(fv.PROMPT_REQUEST)} AS prompt FROM rag JOIN benchmark b ON b.item_id = qid""",
)
def prompt(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return _rag(spark, sf_dir).join(asked, "qid").select(
        "qid", prompts.user_prompt(F.col("rag_context"), F.col("text")).alias("prompt")
    )


def sample_replies(spark, sf_dir):
    """Every code cell in one of four reply shapes."""
    i, sql = F.col("cell_index"), F.col("source")
    one_line = F.regexp_replace(sql, r"\s+", " ")
    share = F.concat(F.lit("0."), (i % 9 + 1).cast("string"))
    shape = F.pmod(F.col("i"), F.lit(4))
    reply = (
        F.when(shape == 0, F.concat(F.lit("SQL Query: ```sql\n"), sql, F.lit("\n```\nConfidence: "), share, F.lit("\nExplanation: first line\nsecond line\n\nmore")))
        .when(shape == 1, F.concat(F.lit("Here it is\n```sql\n"), sql, F.lit("\n```\nconfidence: "), share))
        .when(shape == 2, F.concat(F.lit("```\nselect 1 from "), one_line, F.lit("\n```")))
        .otherwise(F.concat(F.lit("- SQL Query: "), one_line, F.lit("\n- Confidence: "), share, F.lit(".\n- Explanation: x")))
    )
    code = cells(spark, sf_dir).filter(F.col("cell_type") == "code")
    conv = F.regexp_extract("notebook_path", r"(\d+)", 1).cast(L)
    return code.withColumn("i", conv + i).select(
        "notebook_path", i.cast(L).alias("cell_index"), reply.alias("reply")
    )


REPLIES = r"""replies AS (
  SELECT notebook_path, cell_index, source, regexp_replace(source, '\s+', ' ', 'g') AS one_line,
         (conv_id + cell_index) % 4 AS shape, '0.' || (cell_index % 9 + 1) AS share
  FROM cells WHERE cell_type = 'code'),
full_replies AS (SELECT *, CASE shape
  WHEN 0 THEN 'SQL Query: ```sql' || chr(10) || source || chr(10) || '```' || chr(10) || 'Confidence: ' || share || chr(10) || 'Explanation: first line' || chr(10) || 'second line' || chr(10) || chr(10) || 'more'
  WHEN 1 THEN 'Here it is' || chr(10) || '```sql' || chr(10) || source || chr(10) || '```' || chr(10) || 'confidence: ' || share
  WHEN 2 THEN '```' || chr(10) || 'select 1 from ' || one_line || chr(10) || '```'
  ELSE '- SQL Query: ' || one_line || chr(10) || '- Confidence: ' || share || '.' || chr(10) || '- Explanation: x' END AS reply
  FROM replies)"""


def _tidy(x):
    return f"regexp_replace({o.collapse(o.no_comments(x))}, ';+$', '') || ';'"


PARSED = f"""parsed AS (SELECT notebook_path, cell_index, reply,
  CASE WHEN regexp_matches(reply, '(?is)SQL Query:\\s*```(?:sql)?\\s*(.*?)\\s*```')
         THEN regexp_extract(reply, '(?is)SQL Query:\\s*```(?:sql)?\\s*(.*?)\\s*```', 1)
       WHEN regexp_matches(reply, '(?is)```sql\\s*(.*?)\\s*```') THEN regexp_extract(reply, '(?is)```sql\\s*(.*?)\\s*```', 1)
       WHEN regexp_matches(reply, '(?is)```\\s*(SELECT.*?)\\s*```') THEN regexp_extract(reply, '(?is)```\\s*(SELECT.*?)\\s*```', 1)
       ELSE regexp_extract(reply, '(?im)^[-\\s]*SQL Query:[^\\S\\n]*([^\\s`].*)$', 1) END AS stated,
  rtrim(regexp_extract(reply, '(?i)Confidence:\\s*([0-9.]+)', 1), '.') AS number,
  CASE WHEN contains(reply, 'Explanation:') THEN {o.strip("split_part(split_part(reply, 'Explanation:', 2), chr(10) || chr(10), 1)")}
       ELSE reply END AS explanation
  FROM full_replies),
tidied AS (SELECT notebook_path, cell_index, CASE WHEN stated = '' THEN '' ELSE {_tidy("stated")} END AS sql_query,
  coalesce(TRY_CAST(number AS DOUBLE), 0.8) AS confidence, explanation FROM parsed)"""


@register("reply_parse", f"WITH {o.CELLS}, {REPLIES}, {PARSED} SELECT * FROM tidied")
def reply_parse(spark, sf_dir):
    return sample_replies(spark, sf_dir).select(
        "notebook_path", "cell_index", rp.parse_reply(F.col("reply")).alias("r")
    ).select("notebook_path", "cell_index", "r.*")


@register(
    "sql_tidy",
    f"WITH {o.CELLS} SELECT notebook_path, cell_index, {_tidy('source')} AS sql_query FROM cells WHERE cell_type = 'code'",
)
def sql_tidy(spark, sf_dir):
    code = cells(spark, sf_dir).filter(F.col("cell_type") == "code")
    return code.select(
        "notebook_path", F.col("cell_index").cast(L), rp.tidy_sql(F.col("source")).alias("sql_query")
    )


def _danger(mode, sql="source"):
    def occurs(n):
        return rf"regexp_matches(upper({sql}), '\b{n}\b')" if mode == "word" else f"contains(upper({sql}), '{n}')"

    whens = " ".join(
        f"WHEN {occurs(n)} THEN '{fv.MSG_DANGEROUS}{n}'" for n in fv.DANGEROUS_OPERATIONS
    )
    return f"CASE WHEN {sql} = '' THEN '{fv.MSG_INVALID}' {whens} ELSE '{fv.MSG_VALID}' END"


def _validated(spark, sf_dir, mode):
    code = cells(spark, sf_dir).filter(F.col("cell_type") == "code")
    return code.select(
        "notebook_path", F.col("cell_index").cast(L), rp.check_sql(F.col("source"), mode).alias("v")
    ).select("notebook_path", "cell_index", "v.*")


def _validate_sql(mode):
    return f"""WITH {o.CELLS}, v AS (SELECT notebook_path, cell_index, {_danger(mode)} AS message
  FROM cells WHERE cell_type = 'code') SELECT *, message = '{fv.MSG_VALID}' AS is_valid FROM v"""


@register("sql_validate", _validate_sql("word"))
def sql_validate(spark, sf_dir):
    return _validated(spark, sf_dir, "word")


@register("sql_validate_substring", _validate_sql("substring"))
def sql_validate_substring(spark, sf_dir):
    return _validated(spark, sf_dir, "substring")


@register(
    "history_last10",
    """SELECT conv_id * 100 + turn AS asked_at, text AS question FROM conversations WHERE role = 'user'
ORDER BY asked_at DESC, question LIMIT 10""",
)
def history_last10(spark, sf_dir):
    log = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return prompts.newest(
        log.select((F.col("conv_id") * 100 + F.col("turn")).alias("asked_at"), F.col("text").alias("question"))
    )


def _stored_reply(asked):
    """A reply that repeats the best example of the prompt."""
    best = F.regexp_extract("prompt", r"(?s)SQL: (.*?)\n(?:Description:|\n)", 1)
    return asked.select(
        "qid",
        F.concat(F.lit("SQL Query: ```sql\n"), best, F.lit("\n```\nConfidence: 0.9\nExplanation: best example")).alias("reply"),
    )


_FIELDS = list(fv.FIELD_BOOSTS)
_BUCKET = f"CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {fv.EMBED_DIM}"


def _vector_sql(name, source, ident, text):
    """CTEs ending in ``name``: ident, bucket, w of the hashed unit vectors, as stored floats."""
    return f"""
{name}_w AS (SELECT {ident}, unnest({o.terms(text)}) AS w FROM {source}),
{name}_tf AS (SELECT {ident}, {_BUCKET} AS bucket, count(*) AS tf FROM {name}_w GROUP BY ALL),
{name}_n AS (SELECT {ident}, sqrt(sum(tf * tf)) AS norm FROM {name}_tf GROUP BY ALL),
{name} AS (SELECT {ident}, bucket, CAST(CAST(tf / norm AS FLOAT) AS DOUBLE) AS w FROM {name}_tf JOIN {name}_n USING ({ident})),
{name}_len AS (SELECT {ident}, sqrt(sum(w * w)) AS len FROM {name} GROUP BY ALL)"""


QUESTION_TEXT = ORACLES["q_search_text"]


def _retrieved(among):
    """CTEs ending in ``hits``: hybrid search among the documents that meet a condition on doc_id."""
    return f"""{PARTS},
adocs AS (SELECT *, {o.embed_text()} AS business_context FROM pdocs),
{bm25_sql(fv.FIELD_BOOSTS, "adocs")},
qtext AS ({QUESTION_TEXT}),
{_vector_sql("dv", "adocs", "doc_id", "business_context")},
{_vector_sql("qv", "qtext", "qid", "search_text")},
vecs AS (SELECT qid, doc_id, sum(qv.w * dv.w) / any_value(ql.len) / any_value(dl2.len) AS vec_raw
  FROM qv JOIN dv USING (bucket) JOIN qv_len ql USING (qid) JOIN dv_len dl2 USING (doc_id) GROUP BY qid, doc_id),
allvecs AS (SELECT q.qid, d.doc_id, coalesce(v.vec_raw, 0) AS vec_raw
  FROM qv_len q CROSS JOIN dv_len d LEFT JOIN vecs v ON v.qid = q.qid AND v.doc_id = d.doc_id),
vtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(vec_raw, 6) DESC, doc_id) AS vr FROM allvecs WHERE {among})
         WHERE vr <= {fv.ANSWER_SIZE}),
fused AS (
  SELECT qid, doc_id,
         round({1 - fv.HYBRID_ALPHA} * coalesce(t.text_raw, 0) + {fv.HYBRID_ALPHA} * coalesce(v.vec_raw, 0), 6) AS score
  FROM (SELECT * FROM txt WHERE {among}) t FULL JOIN vtop v USING (qid, doc_id)),
hits AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM fused)
  WHERE rank <= {fv.ANSWER_SIZE})"""


RETRIEVED = _retrieved("true")


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("question")
    )


@register(
    "kb_retrieve",
    f"WITH {RETRIEVED} SELECT h.qid, h.rank, h.doc_id, h.score, d.sql_query FROM hits h JOIN adocs d USING (doc_id)",
)
def kb_retrieve(spark, sf_dir):
    kb = built(spark, sf_dir)
    hits = ans.retrieve(kb, ans.embedded(_asked(spark, sf_dir)))
    return hits.select("qid", "rank", "doc_id", "score", "sql_query")


# The tables that a filtered search asks for, the least score of its hits, and the length of pieces.
ASKED_TABLES = ["sales_fact", "plan_tbl"]
LEAST_SCORE = 0.1
PIECE = 80
_ALLOWED = f"doc_id IN (SELECT doc_id FROM adocs WHERE list_has_any(tables, {ASKED_TABLES}))"


@register(
    "kb_retrieve_filtered",
    f"WITH {_retrieved(_ALLOWED)} SELECT qid, rank, doc_id, score FROM hits WHERE score >= {LEAST_SCORE}",
)
def kb_retrieve_filtered(spark, sf_dir):
    """Hybrid search among the documents that use one of two tables, with a least score."""
    options = {"filters": {"tables_used": ASKED_TABLES}, "threshold": LEAST_SCORE}
    hits = ans.retrieve(built(spark, sf_dir), ans.embedded(_asked(spark, sf_dir)), **options)
    return hits.select("qid", "rank", "doc_id", "score")


@register(
    "kb_retrieve_chunks",
    f"""WITH {PARTS},
adocs AS (SELECT *, {o.embed_text()} AS business_context FROM pdocs),
pieces AS (SELECT doc_id || '/' || i AS piece_id, doc_id, substr(business_context, i * {PIECE} + 1, {PIECE}) AS piece
  FROM (SELECT *, unnest(range(0, CAST(ceil(length(business_context) / {PIECE}.0) AS BIGINT))) AS i FROM adocs)),
qtext AS ({QUESTION_TEXT}),
{_vector_sql("dv", "pieces", "piece_id", "piece")},
{_vector_sql("qv", "qtext", "qid", "search_text")},
near AS (SELECT qid, piece_id, sum(qv.w * dv.w) / any_value(ql.len) / any_value(pl.len) AS raw
  FROM qv JOIN dv USING (bucket) JOIN qv_len ql USING (qid) JOIN dv_len pl USING (piece_id) GROUP BY qid, piece_id),
best AS (SELECT q.qid, p.doc_id, round(max(coalesce(n.raw, 0)), 6) AS score
  FROM qv_len q CROSS JOIN pieces p JOIN dv_len USING (piece_id) LEFT JOIN near n ON n.qid = q.qid AND n.piece_id = p.piece_id
  GROUP BY q.qid, p.doc_id)
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM best)
WHERE rank <= {fv.ANSWER_SIZE}""",
)
def kb_retrieve_chunks(spark, sf_dir):
    """Vector search where the best piece of a document counts."""
    kb = built(spark, sf_dir, chunk_size=PIECE)
    hits = ans.retrieve(kb, ans.embedded(_asked(spark, sf_dir)), hybrid=False, by_chunks=True)
    return hits.select("qid", "rank", "doc_id", "score")


@register(
    "kb_answer",
    f"""WITH {RETRIEVED}, {EXPORT}, {SCHEMA_LINES},
hit_tables AS (SELECT DISTINCT h.qid, lower(unnest(d.tables)) AS wanted FROM hits h JOIN adocs d USING (doc_id)),
meant AS (SELECT wanted, min(table_key) AS table_key
  FROM (SELECT DISTINCT wanted FROM hit_tables) JOIN cat_tables ON contains(lower(table_key), wanted) GROUP BY wanted),
schemas AS (SELECT qid, string_agg(line, chr(10) ORDER BY table_key, section, pos, line) AS schema_context
  FROM (SELECT DISTINCT qid, table_key FROM hit_tables JOIN meant USING (wanted)) JOIN schema_lines USING (table_key) GROUP BY qid),
best AS (SELECT h.qid, {_tidy("d.sql_query")} AS sql_query FROM hits h JOIN adocs d USING (doc_id) WHERE h.rank = 1),
cited AS (SELECT qid, count(*) AS n_citations FROM hits GROUP BY qid),
answered AS (SELECT *, {_danger("word", "sql_query")} = '{fv.MSG_VALID}' AS is_valid FROM best JOIN cited USING (qid))
SELECT qid, sql_query, 0.9::DOUBLE AS confidence, 'best example' AS explanation, n_citations, is_valid,
  coalesce(schema_context, '') AS schema_context, true AS timed FROM answered LEFT JOIN schemas USING (qid)
UNION ALL SELECT item_id, '', 0.0, '{fv.MSG_NO_HITS}', 0, false, '', true FROM benchmark WHERE item_id NOT IN (SELECT qid FROM hits)""",
)
def kb_answer(spark, sf_dir):
    kb = built(spark, sf_dir)
    done = ans.answer(kb, _asked(spark, sf_dir), _stored_reply)
    return done.select(
        "qid",
        "sql_query",
        "confidence",
        "explanation",
        F.size("citations").cast(L).alias("n_citations"),
        "validation.is_valid",
        "schema_context",
        (F.col("execution_time") > 0).alias("timed"),
    )
