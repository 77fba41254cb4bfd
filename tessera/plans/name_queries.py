"""Registered scalar-function queries: identifiers, statements, cleaning, schedules
(X1-X5, X9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import names as N
from tessera.functions import text as X
from tessera.plans.base import register
from tessera.plans.fixture_sql import with_ctes
from tessera.plans.oracle_sql import comment_statement_sql, sql_fq, sql_quote
from tessera.sources.fixtures import audit_log, measurement_log
from tessera.sources.tables import read_table

# identifier candidates derived from every part row (spaces, '#', quotes, reserved
# words in mixed case, '-', '.', '')
_WORDS = ["table", "Column", "VIEW", "database", "schema", "select", "from", "where"]


def _identifiers(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    words = F.array(*[F.lit(w) for w in _WORDS])
    cands = [
        ("name", F.col("p_name")),
        ("brand", F.col("p_brand")),
        ("quoted", F.concat(F.lit('"'), F.col("p_type"), F.lit('"'))),
        ("reserved", F.element_at(words, (k % 8 + 1).cast("int"))),
        ("hyphen", F.concat(F.col("p_type"), F.lit("-"), F.col("p_size").cast("string"))),
        ("dotted", F.concat(F.col("p_brand"), F.lit("."), F.col("p_type"))),
        ("maybe_empty", F.when(k % 10 == 0, F.lit("")).otherwise(F.col("p_type"))),
    ]
    return p.select(k.alias("p_partkey"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("kind"), c.alias("ident")) for n, c in cands])))


_IDENT_SQL = """
SELECT p_partkey, kind, ident FROM (
  SELECT p_partkey, 'name' AS kind, p_name AS ident FROM part UNION ALL
  SELECT p_partkey, 'brand', p_brand FROM part UNION ALL
  SELECT p_partkey, 'quoted', '"' || p_type || '"' FROM part UNION ALL
  SELECT p_partkey, 'reserved',
    ['table', 'Column', 'VIEW', 'database', 'schema', 'select', 'from', 'where'][p_partkey % 8 + 1]
  FROM part UNION ALL
  SELECT p_partkey, 'hyphen', p_type || '-' || CAST(p_size AS VARCHAR) FROM part UNION ALL
  SELECT p_partkey, 'dotted', p_brand || '.' || p_type FROM part UNION ALL
  SELECT p_partkey, 'maybe_empty', CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_type END FROM part) s"""


@register("quote_identifiers", f"""
SELECT p_partkey, kind, ident, {sql_quote('ident')} AS quoted FROM ({_IDENT_SQL}) i""")
def quote_identifiers(spark, sf_dir):
    return _identifiers(spark, sf_dir).withColumn("quoted", N.quote_identifier("ident"))


@register("qualified_names", f"""
SELECT p_partkey, {sql_fq("'DB' || CAST(p_partkey % 3 AS VARCHAR)", 'p_type', 'p_name')}
  AS qualified_name FROM part""")
def qualified_names(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    db = F.concat(F.lit("DB"), (F.col("p_partkey") % 3).cast("string"))
    return p.select("p_partkey", N.qualified_name(db, F.col("p_type"), F.col("p_name"))
                    .alias("qualified_name"))


_DESC_TYPES = "('TABLE', 'VIEW', 'COLUMN')"


@register("render_comment_sql", with_ctes(f"""
SELECT history_id, {comment_statement_sql('object_type', 'database_name', 'schema_name', 'object_name',
                                 'column_name', 'txt')} AS sql_executed
FROM (SELECT *, CASE WHEN history_id % 4 = 0 THEN after_description || ' it''s ''quoted'''
                     ELSE after_description END AS txt
      FROM hist WHERE object_type IN {_DESC_TYPES}) h""", "hist"))
def render_comment_sql(spark, sf_dir):
    h = audit_log(spark, sf_dir).filter(F.col("object_type").isin("TABLE", "VIEW", "COLUMN"))
    txt = F.when(F.col("history_id") % 4 == 0,
                 F.concat(F.col("after_description"), F.lit(" it's 'quoted'"))
                 ).otherwise(F.col("after_description"))
    return h.select("history_id", N.comment_statement(
        "object_type", "database_name", "schema_name", "object_name", "column_name", txt
    ).alias("sql_executed"))


def _statements(spark, sf_dir):
    q = measurement_log(spark, sf_dir)
    rid = F.col("result_id")
    table = F.when(rid % 5 == 0, F.concat(F.lit('"'), F.col("table_name"), F.lit(' X"'))
                   ).otherwise(F.col("table_name"))
    arg = F.get(F.col("argument_names"), 0)
    col = (F.when(arg.isNull(), F.lit("")).when(rid % 3 == 0, F.concat(F.lit('"'), arg, F.lit('"')))
           .otherwise(arg))
    stmt = F.concat(F.lit("ALTER TABLE "), F.col("table_database"), F.lit("."), F.col("table_schema"),
                    F.lit("."), table, F.lit(f" ADD DATA METRIC FUNCTION {N.METRIC_NAMESPACE}."),
                    F.col("metric_name"), F.lit(" ON ("), col, F.lit(");"))
    return q.select("result_id", stmt.alias("statement"))


_STMT_SQL = f"""
SELECT result_id,
  'ALTER TABLE ' || table_database || '.' || table_schema || '.' ||
  CASE WHEN result_id % 5 = 0 THEN '"' || table_name || ' X"' ELSE table_name END ||
  ' ADD DATA METRIC FUNCTION {N.METRIC_NAMESPACE}.' || metric_name || ' ON (' ||
  CASE WHEN arg_name IS NULL THEN '' WHEN result_id % 3 = 0 THEN '"' || arg_name || '"'
       ELSE arg_name END || ');' AS statement
FROM qr"""

_TRIM = "regexp_replace(regexp_extract(statement, '{p}', 1), '^\\s+|\\s+$', '', 'g')".format(
    p=N.COLUMN_PATTERN)


@register("parse_metric_statements", with_ctes(f"""
SELECT result_id, statement,
  regexp_replace(coalesce(nullif(regexp_extract(upper(statement), '{N.TABLE_PATTERN}', 1), ''),
                          '{N.UNKNOWN_TABLE}'), '^"+|"+$', '', 'g') AS table_name,
  coalesce(nullif(regexp_extract(upper(statement), '{N.metric_pattern()}', 1), ''),
           '{N.UNKNOWN_METRIC}') AS metric_name,
  CASE WHEN {_TRIM} <> '' THEN
    regexp_replace(regexp_replace({_TRIM}, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') END
    AS column_name
FROM ({_STMT_SQL}) s""", "qr"))
def parse_metric_statements(spark, sf_dir):
    s = _statements(spark, sf_dir)
    return s.select("result_id", "statement", N.parse_metric_statement("statement").alias("p")) \
            .select("result_id", "statement", "p.table_name", "p.metric_name", "p.column_name")


_WS = "[ \\t\\n\\x0B\\f\\r]"


@register("clean_descriptions", f"""
SELECT doc_id, CASE WHEN length(t) >= 2 AND starts_with(t, '"') AND ends_with(t, '"')
                    THEN substr(t, 2, length(t) - 2) ELSE t END AS cleaned
FROM (SELECT doc_id, regexp_replace(raw, '^{_WS}+|{_WS}+$', '', 'g') AS t FROM (
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '"' || text || '"'
                                       WHEN 1 THEN '  ' || text || chr(10)
                                       WHEN 2 THEN '"' ELSE text END AS raw
        FROM documents) r) c""")
def clean_descriptions(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    raw = (F.when(k == 0, F.concat(F.lit('"'), F.col("text"), F.lit('"')))
           .when(k == 1, F.concat(F.lit("  "), F.col("text"), F.lit("\n")))
           .when(k == 2, F.lit('"')).otherwise(F.col("text")))
    return d.select("doc_id", X.clean_generated(raw).alias("cleaned"))


def _pick(values, idx):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values) + 1).cast("int"))


def _list(values):
    return "[" + ", ".join(str(v) for v in values) + "]"


@register("schedule_expressions", f"""
SELECT event_id,
  CASE kind WHEN 'minutes' THEN printf('%d MINUTE', n)
            WHEN 'hours' THEN printf('USING CRON 0 */%d * * * UTC', n)
            WHEN 'daily' THEN printf('USING CRON %d %d * * * UTC', mi, hr)
            ELSE '{X.ON_CHANGES_EXPRESSION}' END AS schedule_expression,
  CASE kind WHEN 'minutes' THEN printf('Every %d minutes', n)
            WHEN 'hours' THEN printf('Every %d hours', n)
            WHEN 'daily' THEN printf('Daily at %02d:%02d UTC', hr, mi)
            ELSE '{X.ON_CHANGES_LABEL}' END AS description
FROM (SELECT event_id,
        CASE event_id % 4 WHEN 0 THEN 'minutes' WHEN 1 THEN 'hours' WHEN 2 THEN 'daily'
             ELSE 'changes' END AS kind,
        CASE event_id % 4 WHEN 0 THEN {_list(X.PERIODIC_MINUTES)}[user_id % {len(X.PERIODIC_MINUTES)} + 1]
             ELSE {_list(X.PERIODIC_HOURS)}[user_id % {len(X.PERIODIC_HOURS)} + 1] END AS n,
        hour(ts) AS hr, {_list(X.DAILY_MINUTES)}[user_id % {len(X.DAILY_MINUTES)} + 1] AS mi
      FROM events) e""")
def schedule_expressions(spark, sf_dir):
    """Every event picks a schedule kind and its options from its own fields."""
    e = read_table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    kind = (F.when(k == 0, "minutes").when(k == 1, "hours").when(k == 2, "daily")
            .otherwise("changes"))
    n = F.when(k == 0, _pick(X.PERIODIC_MINUTES, F.col("user_id"))).otherwise(
        _pick(X.PERIODIC_HOURS, F.col("user_id")))
    s = X.schedule_expression(kind, n, F.hour("ts"), _pick(X.DAILY_MINUTES, F.col("user_id")))
    return e.select("event_id", s.alias("s")).select("event_id", "s.schedule_expression",
                                                     "s.description")


@register("schedule_parse", f"""
SELECT event_id, kind, every, hr AS hour, mi AS minute FROM (
  SELECT event_id,
    CASE event_id % 4 WHEN 0 THEN 'minutes' WHEN 1 THEN 'hours' WHEN 2 THEN 'daily' ELSE 'changes' END AS kind,
    CASE event_id % 4 WHEN 0 THEN {_list(X.PERIODIC_MINUTES)}[user_id % {len(X.PERIODIC_MINUTES)} + 1]
         WHEN 1 THEN {_list(X.PERIODIC_HOURS)}[user_id % {len(X.PERIODIC_HOURS)} + 1] END AS every,
    CASE WHEN event_id % 4 = 2 THEN CAST(hour(ts) AS INTEGER) END AS hr,
    CASE WHEN event_id % 4 = 2 THEN {_list(X.DAILY_MINUTES)}[user_id % {len(X.DAILY_MINUTES)} + 1] END AS mi
  FROM events) e""")
def schedule_parse(spark, sf_dir):
    """Rendered schedule expressions parsed back into their options (round trip)."""
    s = schedule_expressions(spark, sf_dir)
    return s.select("event_id", X.parse_schedule("schedule_expression").alias("p")).select(
        "event_id", "p.kind", "p.every", "p.hour", "p.minute")
