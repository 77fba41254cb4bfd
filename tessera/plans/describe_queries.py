"""Registered description queries (S10, S11, D2-D6, J2, J3, U3, A16), the documentation flow
into the audit log (K1) and configured measurement of the real tables (M11)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import checks as CK
from tessera.operators import describe as D
from tessera.operators.documentation import document_schema
from tessera.operators.metrics import measure_checks
from tessera.operators.catalog import columns_listing
from tessera.operators.history import description_change_rows
from tessera.plans.base import AS_OF, register
from tessera.plans.oracle_sql import checks_sql, comment_statement_sql
from tessera.sinks.tables import append_and_read
from tessera.plans.catalog_queries import COL_LISTING_SQL, OBJ_LISTING_SQL, listing
from tessera.plans.fixture_sql import with_ctes
from tessera.session import scratch_path, unique_name
from tessera.sinks.comments import apply_suggestions
from tessera.sources.catalog import schemas_columns, session_columns, session_objects
from tessera.sources.config import config_frame
from tessera.sources.fixtures import catalog_columns, contact_refs
from tessera.sources.tables import read_table, table_path

# tables described from their real schema and data: (sample key, columns in order)
SAMPLED = {
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    "nation": ("n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]),
    "region": ("r_regionkey", ["r_regionkey", "r_name"]),
    "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                              "o_orderdate", "o_orderpriority"]),
    "events": ("event_id", ["event_id", "ts", "user_id", "event_type", "value", "props"]),
    "lineitem": (("l_orderkey", "l_linenumber"), [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate"]),
    "documents": ("doc_id", ["doc_id", "text", "lang", "source", "n_chars"]),
    "labels": ("doc_id", ["doc_id", "quality", "toxic"]),
    "benchmark": ("item_id", ["item_id", "text"]),
    "pages": ("page_id", ["page_id", "url", "html"]),
    "conversations": (("conv_id", "turn"), ["conv_id", "turn", "role", "text"]),
}
DB, SCHEMA = "TESTDATA", "PUBLIC"


def _order(t: str) -> list[str]:
    key = SAMPLED[t][0]
    return [key] if isinstance(key, str) else list(key)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _nl(s: str) -> str:
    """A Python string with newlines as a DuckDB expression."""
    return " || chr(10) || ".join(_lit(p) for p in s.split("\n"))


# ---------------------------------------------------------------- samples

def _frames(spark, sf_dir):
    """The sampled tables: each is opened once for its schema and its samples."""
    return {t: read_table(spark, sf_dir, t) for t in SAMPLED}


def _table_samples(frames, **place):
    return reduce(lambda a, b: a.unionByName(b), [
        D.sample_rows(frames[t], t, key, **place) for t, (key, _) in SAMPLED.items()])


def _render_sql(t: str) -> str:
    cells = ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'NULL')" for c in SAMPLED[t][1])
    return f"concat_ws(' | ', {cells})"


def _ties(t: str) -> str:
    """Rows that tie come in the order of their columns."""
    return ", ".join(f"{c} NULLS FIRST" for c in SAMPLED[t][1])


def _row_sql(t: str) -> str:
    keys = ", ".join(_order(t))
    return (f"SELECT * FROM (SELECT '{t}' AS table_name, row_number() OVER (ORDER BY {keys}, {_render_sql(t)}) AS k, row_text "
            f"FROM (SELECT *, {_render_sql(t)} AS row_text FROM {t} ORDER BY {keys}, {_ties(t)} LIMIT 5))")


_ROWS_SQL = " UNION ALL ".join(_row_sql(t) for t in SAMPLED)


@register("sample_table_rows", f"""
SELECT table_name, row_number() OVER (PARTITION BY table_name ORDER BY k) AS rn, row_text
FROM ({_ROWS_SQL}) r""")
def sample_table_rows(spark, sf_dir):
    return _table_samples(_frames(spark, sf_dir))


def _column_samples(frames, **place):
    return reduce(lambda a, b: a.unionByName(b), [
        D.column_samples(frames[t], t, key, **place) for t, (key, _) in SAMPLED.items()])


def _val_sql() -> str:
    parts = []
    for t, (_, cols) in SAMPLED.items():
        for c in cols:
            parts.append(f"SELECT * FROM (SELECT '{t}' AS table_name, '{c}' AS column_name, "
                         f"md5(concat_ws(' ', {', '.join(f'CAST({k} AS VARCHAR)' for k in _order(t))})) AS h, "
                         f"{_render_sql(t)} AS whole, CAST({c} AS VARCHAR) AS value_text "
                         f"FROM {t} ORDER BY h, {_ties(t)} LIMIT 10)")
    return " UNION ALL ".join(parts)


_VALS_SQL = f"""
SELECT table_name, column_name, value_text,
  row_number() OVER (PARTITION BY table_name, column_name ORDER BY h, whole) AS sample_rank
FROM ({_val_sql()}) v"""


@register("sample_column_values", _VALS_SQL)
def sample_column_values(spark, sf_dir):
    return _column_samples(_frames(spark, sf_dir))


# ---------------------------------------------------------------- prompts over real tables

def _real_columns(frames):
    return columns_listing(schemas_columns(frames, DB, SCHEMA), sort=False)


def _real_objects(spark):
    return config_frame(spark, [(DB, SCHEMA, t, "TABLE") for t in SAMPLED],
                        "database_name string, schema_name string, table_name string, object_type string")


_TYPE_MAP = ("CASE WHEN data_type = 'VARCHAR' THEN 'STRING' WHEN data_type = 'INTEGER' THEN 'INT' "
             "WHEN data_type LIKE 'TIMESTAMP%' AND data_type NOT LIKE '%TIME ZONE%' THEN 'TIMESTAMP_NTZ' "
             "ELSE upper(data_type) END")
_IN_TABLES = ", ".join(f"'{t}'" for t in SAMPLED)
_REAL_COLS = f"""
SELECT table_name, ordinal_position, column_name, {_TYPE_MAP} AS data_type
FROM information_schema.columns WHERE table_name IN ({_IN_TABLES})"""


@register("table_prompts", f"""
SELECT '{DB}' AS database_name, '{SCHEMA}' AS schema_name, c.table_name, 'TABLE' AS object_type,
  c.n_columns, c.column_list,
  'table ' || c.table_name || ' in {DB}.{SCHEMA}' || chr(10) || 'fields:' || chr(10) || c.columns_text
  || chr(10) || 'example rows:' || chr(10) || coalesce(s.sample_data, '{D.NO_SAMPLE}')
  || chr(10) || {_nl(D.TABLE_ASK)} AS prompt
FROM (SELECT table_name, count(*) AS n_columns,
        string_agg('- ' || column_name || ' (' || data_type || ')', chr(10) ORDER BY ordinal_position)
          AS columns_text,
        string_agg(column_name, ', ' ORDER BY ordinal_position) AS column_list
      FROM ({_REAL_COLS}) rc GROUP BY table_name) c
LEFT JOIN (SELECT table_name, string_agg(row_text, chr(10) ORDER BY k) AS sample_data
           FROM ({_ROWS_SQL}) r GROUP BY table_name) s ON c.table_name = s.table_name""")
def table_prompts(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    samples = D.sample_text(_table_samples(frames, database=DB, schema=SCHEMA))
    return D.table_prompts(_real_objects(spark), _real_columns(frames), samples)


@register("column_prompts", f"""
SELECT '{DB}' AS database_name, '{SCHEMA}' AS schema_name, c.table_name, c.column_name, c.data_type,
  'field ' || c.column_name || chr(10) || 'of ' || c.table_name || chr(10) || 'in {DB}.{SCHEMA}'
  || chr(10) || 'type ' || c.data_type || chr(10) || 'example values:' || chr(10)
  || coalesce(s.sample_data, '{D.NO_SAMPLE}') || chr(10) || {_nl(D.COLUMN_ASK)} AS prompt
FROM ({_REAL_COLS}) c
LEFT JOIN (SELECT table_name, column_name,
             string_agg(coalesce(value_text, 'NULL'), chr(10) ORDER BY sample_rank) AS sample_data
           FROM ({_VALS_SQL}) v GROUP BY table_name, column_name) s
  ON c.table_name = s.table_name AND c.column_name = s.column_name""")
def column_prompts(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    return D.column_prompts(_real_columns(frames), _column_samples(frames, database=DB, schema=SCHEMA)).select(
        "database_name", "schema_name", "table_name", "column_name", "data_type", "prompt")


# ---------------------------------------------------------------- descriptions over the catalog

def _objects(spark, sf_dir):
    """Tables of the column catalog with their listed type and current description."""
    cols = catalog_columns(spark, sf_dir).select(
        F.col("table_catalog").alias("database_name"), F.col("table_schema").alias("schema_name"),
        "table_name").distinct()
    lst = listing(spark, sf_dir, sort=False).select("database_name", "schema_name",
                                        F.col("object_name").alias("table_name"),
                                        "object_type", "current_description")
    return (cols.join(lst, D.OBJ_KEYS, "left")
            .withColumn("object_type", F.coalesce("object_type", F.lit("BASE TABLE"))))


def _columns(spark, sf_dir):
    return columns_listing(catalog_columns(spark, sf_dir), sort=False)


_KIND_LABEL = "CASE WHEN {t} = 'VIEW' THEN 'View' ELSE 'Table' END"
_OBJ_SQL = f"""
SELECT c.database_name, c.schema_name, c.table_name, coalesce(l.object_type, 'BASE TABLE') AS object_type,
  l.current_description
FROM (SELECT DISTINCT table_catalog AS database_name, table_schema AS schema_name, table_name FROM cols) c
LEFT JOIN ({OBJ_LISTING_SQL}) l ON c.database_name = l.database_name AND c.schema_name = l.schema_name
  AND c.table_name = l.object_name"""
_TABLE_DESC_SQL = f"""
SELECT o.object_type AS kind, o.database_name, o.schema_name, o.table_name,
  CAST(NULL AS VARCHAR) AS column_name, o.current_description AS before_description,
  {_KIND_LABEL.format(t='o.object_type')} || ' ' || o.table_name || ' in ' || o.database_name || '.'
  || o.schema_name || ' with ' || CAST(coalesce(x.n, 0) AS VARCHAR) || ' columns: ' || coalesce(x.cl, '')
    AS description,
  CAST(NULL AS VARCHAR) AS error
FROM ({_OBJ_SQL}) o
LEFT JOIN (SELECT table_catalog, table_schema, table_name, count(*) AS n,
             string_agg(column_name, ', ' ORDER BY ordinal_position) AS cl
           FROM cols GROUP BY table_catalog, table_schema, table_name) x
  ON o.database_name = x.table_catalog AND o.schema_name = x.table_schema AND o.table_name = x.table_name"""
_COL_DESC_SQL = f"""
SELECT 'COLUMN' AS kind, database_name, schema_name, table_name, column_name,
  current_description AS before_description,
  'Column ' || column_name || ' of ' || table_name || ' (' || lower(data_type) || ')' AS description,
  CAST(NULL AS VARCHAR) AS error
FROM ({COL_LISTING_SQL}) c"""


def _template_tables(spark, sf_dir):
    return D.generate_descriptions(_objects(spark, sf_dir), _columns(spark, sf_dir), "TABLE")


@register("describe_tables", with_ctes(_TABLE_DESC_SQL, "objs", "cols"))
def describe_tables(spark, sf_dir):
    return _template_tables(spark, sf_dir)


@register("describe_columns", with_ctes(_COL_DESC_SQL, "cols"))
def describe_columns(spark, sf_dir):
    return D.generate_descriptions(_objects(spark, sf_dir), _columns(spark, sf_dir), "COLUMN")


def python_template(prompts: pd.Series) -> pd.Series:
    """The column template as a Python completer (exercises the Arrow/mapInPandas path)."""
    f = prompts.str.extract(r"\Afield (?P<c>[^\n]*)\nof (?P<t>[^\n]*)\nin [^\n]*\ntype (?P<d>[^\n]*)")
    return "Column " + f["c"] + " of " + f["t"] + " (" + f["d"].str.lower() + ")"


@register("describe_columns_pandas", with_ctes(_COL_DESC_SQL, "cols"))
def describe_columns_pandas(spark, sf_dir):
    return D.generate_descriptions(_objects(spark, sf_dir), _columns(spark, sf_dir), "COLUMN",
                                   completer=python_template)


_BOTH_SQL = f"{_TABLE_DESC_SQL} UNION ALL {_COL_DESC_SQL}"


def _both(spark, sf_dir):
    return D.generate_descriptions(_objects(spark, sf_dir), _columns(spark, sf_dir), "BOTH")


@register("generate_descriptions", with_ctes(_BOTH_SQL, "objs", "cols"))
def generate_descriptions(spark, sf_dir):
    return _both(spark, sf_dir)


@register("description_length_violations", with_ctes(f"""
SELECT *, length(description) AS length,
  CASE WHEN kind = 'COLUMN' THEN {D.COLUMN_LIMIT} ELSE {D.TABLE_LIMIT} END AS "limit"
FROM ({_BOTH_SQL}) s
WHERE length(description) > CASE WHEN kind = 'COLUMN' THEN {D.COLUMN_LIMIT} ELSE {D.TABLE_LIMIT} END""",
                                                      "objs", "cols"))
def description_length_violations(spark, sf_dir):
    return D.length_violations(_both(spark, sf_dir))


@register("run_summary", with_ctes(f"""
SELECT count(DISTINCT (database_name, schema_name, table_name)) AS tables_processed,
  count(*) FILTER (WHERE kind <> 'COLUMN' AND description IS NOT NULL AND description <> '') AS table_descriptions,
  count(*) FILTER (WHERE kind = 'COLUMN' AND description IS NOT NULL AND description <> '') AS column_descriptions,
  count(*) FILTER (WHERE NOT (description IS NOT NULL AND description <> '')) AS failed,
  printf('%d objects: %d table texts, %d column texts, %d failures',
    count(DISTINCT (database_name, schema_name, table_name)),
    count(*) FILTER (WHERE kind <> 'COLUMN' AND description IS NOT NULL AND description <> ''),
    count(*) FILTER (WHERE kind = 'COLUMN' AND description IS NOT NULL AND description <> ''),
    count(*) FILTER (WHERE NOT (description IS NOT NULL AND description <> ''))) AS message
FROM ({_BOTH_SQL}) s""", "objs", "cols"))
def run_summary(spark, sf_dir):
    return D.run_summary(_both(spark, sf_dir))


def _new_comments(spark, sf_dir):
    cols = _columns(spark, sf_dir)
    und = cols.filter(F.col("has_description") == "No")
    desc = F.concat(F.lit("Column "), F.col("column_name"), F.lit(" of "), F.col("table_name"),
                    F.lit(" ("), F.lower("data_type"), F.lit(")"))
    return und.select(*D.OBJ_KEYS, F.lower("column_name").alias("column_name"),
                      F.when(F.col("ordinal_position") % 11 == 0, F.lit("")).otherwise(desc)
                      .alias("description"))


@register("merge_column_comments", with_ctes(f"""
SELECT c.database_name, c.schema_name, c.table_name, c.column_name,
  CASE WHEN n.u IS NOT NULL THEN (CASE WHEN n.d <> '' THEN n.d END)
       WHEN c.current_description IS NOT NULL
        AND regexp_matches(c.current_description, '[^ \\t\\n\\x0B\\f\\r]') THEN c.current_description
  END AS comment
FROM ({COL_LISTING_SQL}) c
LEFT JOIN (SELECT database_name, schema_name, table_name, upper(lower(column_name)) AS u,
             CASE WHEN ordinal_position % 11 = 0 THEN ''
                  ELSE 'Column ' || column_name || ' of ' || table_name || ' (' || lower(data_type) || ')' END AS d
           FROM ({COL_LISTING_SQL}) x WHERE has_description = 'No') n
  ON c.database_name = n.database_name AND c.schema_name = n.schema_name AND c.table_name = n.table_name
 AND upper(c.column_name) = n.u""", "cols"))
def merge_column_comments(spark, sf_dir):
    return D.merge_column_comments(_columns(spark, sf_dir), _new_comments(spark, sf_dir))


def _selection(spark, sf_dir):
    return contact_refs(spark, sf_dir).select(
        F.col("object_database").alias("database_name"), F.col("object_schema").alias("schema_name"),
        F.lower("object_name").alias("object_name")).distinct()


_SEL = "(SELECT DISTINCT object_database AS database_name, object_schema AS schema_name, lower(object_name) AS object_name FROM refs)"


@register("resolve_selection", with_ctes(f"""
SELECT s.database_name, s.schema_name, l.object_name, l.object_type, l.current_description, l.has_description
FROM {_SEL} s JOIN ({OBJ_LISTING_SQL}) l ON s.database_name = l.database_name
  AND s.schema_name = l.schema_name AND upper(s.object_name) = upper(l.object_name)""", "objs", "refs"))
def resolve_selection(spark, sf_dir):
    return D.resolve_selection(listing(spark, sf_dir, sort=False), _selection(spark, sf_dir))


@register("unresolved_selection", with_ctes(f"""
SELECT * FROM {_SEL} s WHERE NOT EXISTS (SELECT 1 FROM ({OBJ_LISTING_SQL}) l
  WHERE s.database_name = l.database_name AND s.schema_name = l.schema_name
    AND upper(s.object_name) = upper(l.object_name))""", "objs", "refs"))
def unresolved_selection(spark, sf_dir):
    return D.unresolved_selection(listing(spark, sf_dir, sort=False), _selection(spark, sf_dir))


@register("describe_and_log", with_ctes(f"""
SELECT database_name, schema_name, object_type, table_name AS object_name, column_name,
  nullif(before_description, '') AS before_description, nullif(description, '') AS after_description,
  {comment_statement_sql('object_type', 'database_name', 'schema_name', 'table_name', 'column_name', 'description')}
    AS sql_executed,
  'tessera' AS updated_by, CAST(TIMESTAMP '{AS_OF}' AS TIMESTAMP) AS updated_at
FROM (SELECT *, CASE kind WHEN 'COLUMN' THEN 'COLUMN' WHEN 'VIEW' THEN 'VIEW' ELSE 'TABLE' END AS object_type
      FROM ({_BOTH_SQL}) s WHERE description IS NOT NULL AND description <> '') g""", "objs", "cols"))
def describe_and_log(spark, sf_dir):
    """The whole documentation flow as one job: suggestions for every table and column,
    cleaned, turned into change rows with the true BEFORE, appended to the audit log."""
    changes = D.suggestion_changes(_both(spark, sf_dir))
    rows = description_change_rows(changes, updated_by="tessera", updated_at=AS_OF)
    return append_and_read(rows, "description_history")


#: All given tables and their columns.
MEASURED = {t: cols for t, (_, cols) in SAMPLED.items()} | {"embeddings": ["vec_id", "embedding", "label"]}


def _configured_checks():
    """The checks the config expansion gives for the given tables (static schemas)."""
    from tessera.operators.metrics import Check
    plan = {}
    for t, cols in MEASURED.items():
        checks = [Check("ROW_COUNT")]
        fresh = {"orders": "o_orderdate", "events": "ts", "lineitem": "l_shipdate"}.get(t)     # their temporal columns
        if fresh:
            checks.append(Check("FRESHNESS", fresh))
        checks += [Check(m, c) for c in cols for m in ("NULL_COUNT", "DUPLICATE_COUNT", "UNIQUE_COUNT")]
        plan[t] = checks
    return plan


_CONFIGURED_SQL = "\nUNION ALL\n".join(
    checks_sql(t, f"{DB}.{SCHEMA}.{t}", chs) for t, chs in _configured_checks().items())


@register("measure_configured", _CONFIGURED_SQL)
def measure_configured(spark, sf_dir):
    """Catalog -> configuration -> measurement: the real tables' schemas are expanded into
    checks (ROW_COUNT, FRESHNESS on a temporal column, NULL / DUPLICATE /
    UNIQUE on every column), then the checks frame is measured table by table."""
    checks = CK.expand_checks(schemas_columns({t: read_table(spark, sf_dir, t) for t in MEASURED},
                                              DB, SCHEMA))
    return measure_checks(spark, checks, as_of=AS_OF,
                          resolver=lambda db, schema, table: read_table(spark, sf_dir, table))


# ---------------------------------------------------------------- comments in the session catalog

DOCUMENTED = ("customer", "nation", "orders")
REFUSED = "o_totalprice"      # the completer below fails on this column


def partly_failing(prompts: pd.Series) -> pd.Series:
    """A completer that knows fields and objects, and fails on one column and on views."""
    if prompts.str.contains(rf"\Afield {REFUSED}\n").any():
        raise ValueError("refused")
    field = prompts.str.extract(r"\Afield (?P<c>[^\n]*)\nof (?P<t>[^\n]*)\n")
    thing = prompts.str.extract(r"\Abase table (?P<t>\S+) in ")
    return ("Field " + field["c"] + " of " + field["t"]).where(field["c"].notna(), "Rows of " + thing["t"])


def documented(spark, sf_dir):
    """The given tables, a view with a column called Comment and a broken view in a schema
    of their own, documented and read back: (stored suggestions, catalog rows, report)."""
    db = unique_name("described")
    spark.sql(f"CREATE DATABASE {db} LOCATION '{scratch_path(spark, 'catalog', db)}'")
    try:
        for t in DOCUMENTED:
            spark.sql(f"CREATE TABLE {db}.{t} USING parquet LOCATION '{table_path(sf_dir, t)}'")
        spark.sql(f"ALTER TABLE {db}.orders ALTER COLUMN {REFUSED} COMMENT 'kept'")
        spark.sql(f"CREATE VIEW {db}.late_orders (o_orderkey, Comment) COMMENT 'the old view text' AS "
                  f"SELECT o_orderkey, o_orderpriority FROM {db}.orders")
        spark.sql(f"CREATE TABLE {db}.gone (x INT) USING parquet")
        spark.sql(f"CREATE VIEW {db}.broken AS SELECT x FROM {db}.gone")
        spark.sql(f"DROP TABLE {db}.gone")
        run = document_schema(spark, db, completer=partly_failing, updated_by="tessera", updated_at=AS_OF)
        rows = [(r["table_name"], None, r["comment"]) for r in session_objects(spark, db).collect()]
        for t in [r[0] for r in rows]:
            rows += [(t, r["column_name"], r["comment"]) for r in session_columns(spark, db, t).collect()]
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")
    back = config_frame(spark, rows, "table_name string, column_name string, comment string")
    return run, back


_DOCUMENTED_IN = ", ".join(f"'{t}'" for t in DOCUMENTED)


@register("comments_applied", f"""
SELECT DISTINCT table_name, CAST(NULL AS VARCHAR) AS column_name, 'Rows of ' || table_name AS comment
FROM information_schema.columns WHERE table_name IN ({_DOCUMENTED_IN})
UNION ALL SELECT table_name, column_name,
  CASE WHEN column_name = '{REFUSED}' THEN 'kept' ELSE 'Field ' || column_name || ' of ' || table_name END
FROM information_schema.columns WHERE table_name IN ({_DOCUMENTED_IN})
UNION ALL SELECT * FROM (VALUES ('late_orders', NULL, 'the old view text'),
  ('late_orders', 'o_orderkey', 'Field o_orderkey of late_orders'),
  ('late_orders', 'Comment', 'Field Comment of late_orders')) v""")
def comments_applied(spark, sf_dir):
    """Comments written to the session catalog and read back: failed completions (one column,
    the view's own text) keep the old comment, the broken view is left out."""
    return documented(spark, sf_dir)[1]


@register("documentation_summary", f"""
SELECT count(DISTINCT table_name) + 1 AS tables_processed, count(DISTINCT table_name) AS table_descriptions,
  count(*) + 1 AS column_descriptions, 2 AS failed,
  printf('%d objects: %d table texts, %d column texts, %d failures', count(DISTINCT table_name) + 1,
    count(DISTINCT table_name), count(*) + 1, 2) AS message
FROM information_schema.columns WHERE table_name IN ({_DOCUMENTED_IN})""")
def documentation_summary(spark, sf_dir):
    """Counts of the same run, two completions of which failed."""
    return D.run_summary(documented(spark, sf_dir)[0].suggestions)


def documented_selection(spark, sf_dir):
    """Two tables asked for in other cases, and a name that does not exist."""
    db = unique_name("selected")
    spark.sql(f"CREATE DATABASE {db} LOCATION '{scratch_path(spark, 'catalog', db)}'")
    try:
        for t in DOCUMENTED:
            spark.sql(f"CREATE TABLE {db}.{t} USING parquet LOCATION '{table_path(sf_dir, t)}'")
        return document_schema(spark, db, tables=["CUSTOMER", "Nation", "no_such_table"], updated_by="tessera", updated_at=AS_OF)
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")


@register("documentation_selection", """
SELECT count(DISTINCT table_name) AS tables_processed, count(DISTINCT table_name) AS table_descriptions,
  count(*) AS column_descriptions, 1 AS failed,
  printf('%d objects: %d table texts, %d column texts, %d failures', count(DISTINCT table_name), count(DISTINCT table_name),
    count(*), 1) AS message
FROM information_schema.columns WHERE table_name IN ('customer', 'nation')""")
def documentation_selection(spark, sf_dir):
    """A run over a selection, one name of which the schema lacks: it is counted as failed."""
    return D.run_summary(documented_selection(spark, sf_dir).suggestions)


# ---------------------------------------------------------------- views of another namespace (K6)

def commented_view(spark, sf_dir):
    """A view whose text names a table of its own schema, commented while another schema, with
    a table of that name, is the current one: rows of (what, value) about it afterwards."""
    mine, other = unique_name("views_of"), unique_name("views_by")
    current = spark.catalog.currentDatabase()
    for db in (mine, other):
        spark.sql(f"CREATE DATABASE {db} LOCATION '{scratch_path(spark, 'catalog', db)}'")
    try:
        spark.sql(f"CREATE TABLE {mine}.t USING parquet LOCATION '{table_path(sf_dir, 'customer')}'")
        spark.sql(f"CREATE TABLE {other}.t USING parquet LOCATION '{table_path(sf_dir, 'supplier')}'")
        spark.sql(f"USE {mine}")
        spark.sql("CREATE VIEW v (x, y) COMMENT 'kept' TBLPROPERTIES ('team' = \"the EU's\") AS "
                  "SELECT c_custkey, c_acctbal FROM t")
        spark.sql(f"USE {other}")
        report = apply_suggestions(spark, config_frame(
            spark, [(f"{mine}.v", "X", "the customer")], "table_ident string, column_name string, description string"))
        properties = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {mine}.v").collect()}
        comment = next(r["comment"] for r in session_objects(spark, mine).where("table_name = 'v'").collect())
        n, total = spark.table(f"{mine}.v").agg(F.count("x"), F.sum("x")).first()
        rows = [("rows", str(n)), ("sum", str(total)), ("property", properties.get("team")), ("comment", comment),
                ("failed", str(len(report.failed))), ("current", str(spark.catalog.currentDatabase() == other).lower())]
        rows += [(f"column {r['column_name']}", r["comment"]) for r in session_columns(spark, mine, "v").collect()]
    finally:
        spark.sql(f"USE `{current}`")
        for db in (mine, other):
            spark.sql(f"DROP DATABASE {db} CASCADE")
    return config_frame(spark, rows, "what string, value string")


@register("view_comments_other_namespace", """
SELECT 'rows' AS what, CAST(count(c_custkey) AS VARCHAR) AS value FROM customer
UNION ALL SELECT 'sum', CAST(sum(c_custkey) AS VARCHAR) FROM customer
UNION ALL SELECT * FROM (VALUES ('property', 'the EU''s'), ('comment', 'kept'), ('failed', '0'), ('current', 'true'),
  ('column x', 'the customer'), ('column y', NULL)) v""")
def view_comments_other_namespace(spark, sf_dir):
    """Comments on a view leave its rows, properties and text alone in any current schema."""
    return commented_view(spark, sf_dir)
