"""Word lists, patterns, formats and numbers that decide the results.

Everything here is data. The logic that uses it lives in ``functions`` and ``operators``.
"""

# Statement keywords that mark a cell as SQL and name its query type.
STATEMENT_KEYWORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "WITH"]

# Aggregation names looked for as calls.
AGGREGATIONS = [
    "COUNT", "SUM", "AVG", "MIN", "MAX", "MEDIAN", "STDDEV",
    "FIRST_VALUE", "LAST_VALUE", "ROW_NUMBER", "RANK", "DENSE_RANK",
]

# Date function names.
DATE_FUNCTIONS = [
    "DATE_TRUNC", "DATE_PART", "EXTRACT", "DATEADD", "DATEDIFF",
    "CURRENT_DATE", "CURRENT_TIMESTAMP", "NOW", "GETDATE",
]

# Date functions that SQL also allows without parentheses.
BARE_DATE_FUNCTIONS = ["CURRENT_DATE", "CURRENT_TIMESTAMP"]

# Words that make a filter a date filter.
DATE_WORDS = ["date", "time", "day", "month", "year"]

# Words that mark a query as a business calculation.
BUSINESS_KEYWORDS = [
    "revenue", "profit", "loss", "margin", "conversion", "retention",
    "churn", "ltv", "cac", "arpu", "mrr", "arr", "cohort",
]

# Name endings that mark an identifier as a table.
TABLE_SUFFIXES = ["_table", "_tbl", "_fact", "_dim", "_stage", "_raw"]

# Phrases appended to a question as "SQL concepts", in this order.
SEARCH_PHRASES = ["select", "from", "where", "group by", "order by", "join"]

# Operations that make generated SQL invalid, checked in this order.
DANGEROUS_OPERATIONS = ["DROP", "DELETE", "TRUNCATE", "ALTER", "INSERT", "UPDATE"]

# Messages of the SQL check.
MSG_VALID = "Valid SQL query"
MSG_INVALID = "Invalid SQL syntax"
MSG_DANGEROUS = "Query contains potentially dangerous operation: "

# Messages of failed answers.
MSG_NO_EMBEDDING = "Failed to generate query embedding"
MSG_NO_HITS = "No similar queries found"
MSG_NO_SQL = "Failed to generate SQL"

# SQL words that are never column names.
SQL_WORDS = [
    "ALL", "ALTER", "AND", "ANY", "AS", "ASC", "BETWEEN", "BY", "CASE", "CAST", "CREATE", "CROSS",
    "CURRENT_DATE", "CURRENT_TIMESTAMP", "DELETE", "DESC", "DISTINCT", "DROP", "ELSE", "END",
    "EXCEPT", "EXISTS", "FALSE", "FROM", "FULL", "GROUP", "HAVING", "ILIKE", "IN", "INNER",
    "INSERT", "INTERSECT", "INTERVAL", "INTO", "IS", "JOIN", "LEFT", "LIKE", "LIMIT", "NATURAL",
    "NOT", "NULL", "NULLS", "OFFSET", "ON", "OR", "ORDER", "OUTER", "OVER", "PARTITION",
    "RECURSIVE", "RIGHT", "ROWS", "SELECT", "SET", "TABLE", "THEN", "TRUE", "UNION", "UPDATE",
    "USING", "VALUES", "WHEN", "WHERE", "WINDOW", "WITH",
]

# Words that end a WHERE clause at its own nesting level.
WHERE_TERMINATORS = [
    "GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "EXCEPT", "INTERSECT", "RETURNING", "INTO", ";",
]

# Literals at least this long are replaced before embedding, and by what.
LONG_LITERAL = 100
LONG_LITERAL_MARK = "<LONG_STRING>"

# Fixed value: vector width.
EMBED_DIM = 1024
# What statistics call the built-in embedder.
EMBED_MODEL = f"hashed words, {EMBED_DIM}"

# Searched text fields with their boosts, BM25 and fusion constants.
FIELD_BOOSTS = {
    "sql_query": 2.0,
    "business_context": 1.5,
    "context_before": 1.0,
    "context_after": 1.0,
}
BM25_K1 = 1.2
BM25_B = 0.75
HYBRID_ALPHA = 0.7

# Result sizes.
SEARCH_SIZE = 10
ANSWER_SIZE = 5
PROMPT_EXAMPLES = 3
TOP_PATTERNS = 5
RENDERED_PATTERNS = 3
RENDERED_DATE_FILTERS = 5
HISTORY_SIZE = 10
CONTEXT_SPAN = 3

# Confidence of a reply that states none.
DEFAULT_CONFIDENCE = 0.8

# Ids and kinds of the two documents that describe the whole corpus.
SCHEMA_DOC = ("schema_metadata", "metadata")
PATTERNS_DOC = ("business_patterns", "patterns")

# Headings of the rendered texts.
HEAD_RELATIONSHIPS = "## Common Table Relationships"
HEAD_FILTERS = "\n## Common Filters by Table"
HEAD_AGGREGATIONS = "\n## Common Aggregations by Table"
HEAD_DATE_FILTERS = "\n## Common Date Filters"
HEAD_SCHEMAS = "## Available Tables and Schemas"
HEAD_PATTERNS = "\n## Common Business Patterns"
HEAD_EXAMPLES = "\n## Similar Queries from Past Analysis"

# The prompt texts.
SYSTEM_PROMPT = """You are an expert SQL developer with deep knowledge of data analytics and business intelligence. Your task is to convert natural language questions into accurate, efficient SQL queries.

Given the user's question and the provided context (table schemas, business patterns, and similar queries), generate a SQL query that answers the question.

Guidelines:
1. Use only tables and columns that exist in the provided schema
2. Follow the business patterns and common practices shown in similar queries
3. Write clean, readable SQL with proper formatting
4. Include appropriate JOINs, WHERE clauses, and aggregations
5. Consider performance implications
6. If the question is ambiguous, make reasonable assumptions based on the context

Response format:
- SQL Query: [Your SQL query]
- Confidence: [0.0-1.0 confidence score]
- Explanation: [Brief explanation of the query logic and any assumptions made]"""
PROMPT_CONTEXT = "Context Information:\n"
PROMPT_QUESTION = "\n\nUser Question: "
PROMPT_REQUEST = "\n\nPlease generate a SQL query to answer this question."

# Where a reply states its SQL, in order of preference, and its other parts.
REPLY_SQL_PATTERNS = [
    r"(?is)SQL Query:\s*```(?:sql)?\s*(.*?)\s*```",
    r"(?is)```sql\s*(.*?)\s*```",
    r"(?is)```\s*(SELECT.*?)\s*```",
    r"(?im)^[-\s]*SQL Query:[^\S\n]*([^\s`].*)$",
]
REPLY_CONFIDENCE_PATTERN = r"(?i)Confidence:\s*([0-9.]+)"
REPLY_EXPLANATION_PATTERN = r"(?is)Explanation:\s*(.*?)(?=\n\n|\z)"

# Patterns of the four plain join features, the first CTE, the plain subquery and a call.
JOIN_RAW = [
    r"(?U)(\w+)\s+(?:INNER\s+)?JOIN\s+(\w+)",
    r"(?U)(\w+)\s+LEFT\s+(?:OUTER\s+)?JOIN\s+(\w+)",
    r"(?U)(\w+)\s+RIGHT\s+(?:OUTER\s+)?JOIN\s+(\w+)",
    r"(?U)(\w+)\s+FULL\s+(?:OUTER\s+)?JOIN\s+(\w+)",
]
FIRST_CTE = r"(?iU)\bWITH\s+(?:RECURSIVE\s+)?(\w+)\s+AS\s*\("
SUBQUERY_RAW = r"(?isU)\(\s*SELECT\s+.*?\)"
CALL = r"(?U)(\w+)\s*\("

# Words around the relations of a statement, for the scopes of aliases.
SET_OPERATORS = ["UNION", "EXCEPT", "INTERSECT", "MINUS"]
RELATION_FOLLOWS = ["FROM", "JOIN", "INTO", "UPDATE"]
BEFORE_RELATION = ["LATERAL", "ONLY", "TABLE"]
LIST_ENDS = ["SELECT", "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "SET", "VALUES", "WINDOW", "QUALIFY"]
AFTER_RELATION = [
    "ON", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER", "NATURAL", "SEMI", "ANTI", "LATERAL", "TABLESAMPLE",
    "WHEN", "OFFSET", "FETCH", "FOR", "PIVOT", "UNPIVOT", "RETURNING",
]
