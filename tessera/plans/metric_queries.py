"""Registered metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.registry import sql_metric
from tessera.operators.metrics import Check, measure, measure_checks_to, measure_suite
from tessera.operators.observed import write_measured
from tessera.plans.base import AS_OF, ROUND_DIGITS, register
from tessera.plans.fixture_sql import with_ctes
from tessera.plans.oracle_sql import checks_sql
from tessera.session import scratch_path, unique_name
from tessera.sources.config import config_frame
from tessera.sources.fixtures import labeled_documents
from tessera.sources.tables import TABLES, read_table

LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"]
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"]
DOCS_L_COLS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
NUMERIC = {"lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax",
                        "l_linenumber"],
           "orders": ["o_totalprice"], "customer": ["c_acctbal"]}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return labeled_documents(spark, sf_dir) if name == "docs_l" else read_table(spark, sf_dir, name)


def run_plan(spark, sf_dir, plan: dict[str, list[Check]], rounded=False) -> DataFrame:
    suite = {t: (source(spark, sf_dir, t), checks) for t, checks in plan.items()}
    out = measure_suite(suite, as_of=AS_OF, one_read=("docs_l",))
    if rounded:
        out = out.withColumn("value", F.round("value", ROUND_DIGITS))
    return out


def plan_sql(plan: dict[str, list[Check]], rounded=False) -> str:
    rd = ROUND_DIGITS if rounded else None
    body = "\nUNION ALL\n".join(checks_sql(t, t, checks, rd) for t, checks in plan.items())
    return with_ctes(body, "docs_l") if "docs_l" in plan else body


def _each(metric: str, columns: dict[str, list[str]], **params) -> dict[str, list[Check]]:
    p = tuple(sorted((k, tuple(v) if isinstance(v, list) else v) for k, v in params.items()))
    return {t: [Check(metric, c, p) for c in cols] for t, cols in columns.items()}


def _merge(*plans: dict[str, list[Check]]) -> dict[str, list[Check]]:
    out: dict[str, list[Check]] = {}
    for p in plans:
        for t, checks in p.items():
            out.setdefault(t, []).extend(checks)
    return out


def _define(name: str, plan: dict[str, list[Check]], rounded=False):
    register(name, plan_sql(plan, rounded))(lambda spark, sf_dir: run_plan(spark, sf_dir, plan, rounded))


# M1 .. M10: one metric family each, over whole tables
_define("metric_row_count", {t: [Check("ROW_COUNT")] for t in TABLES})
_define("metric_freshness", {"lineitem": [Check("FRESHNESS", "l_shipdate")],
                             "orders": [Check("FRESHNESS", "o_orderdate")],
                             "events": [Check("FRESHNESS", "ts")]})
_define("metric_null_count", _merge(_each("NULL_COUNT", {"docs_l": DOCS_L_COLS}),
                                    _each("NULL_COUNT", {"embeddings": ["embedding"]})))
_DUP_COLS = {"documents": ["text"], "lineitem": ["l_orderkey", "l_partkey", "l_returnflag"],
             "orders": ["o_custkey"], "docs_l": ["quality"]}
_define("metric_duplicate_count", _each("DUPLICATE_COUNT", _DUP_COLS))
_define("metric_duplicate_values", _each("DUPLICATE_VALUES", _DUP_COLS))
_define("metric_unique_count", _each("UNIQUE_COUNT", {"lineitem": LINEITEM_COLS,
                                                      "docs_l": ["text", "quality"]}))
_define("metric_null_percent", _each("NULL_PERCENT", {"docs_l": ["quality", "toxic", "text"]}))
_define("metric_accepted_values", _merge(
    _each("ACCEPTED_VALUES", {"docs_l": ["lang"]}, values=["en", "fr", "de"]),
    _each("ACCEPTED_VALUES", {"lineitem": ["l_returnflag"]}, values=["R", "A"]),
    _each("ACCEPTED_VALUES", {"orders": ["o_orderstatus"]}, values=["O", "F"])))
_define("metric_avg", _each("AVG", NUMERIC), rounded=True)
_define("metric_min_max", _merge(_each("MIN", NUMERIC), _each("MAX", NUMERIC)))
_define("metric_stddev", _each("STDDEV", NUMERIC), rounded=True)

# The whole suite, several tables, one job -- the flagship query
CORE = ("NULL_COUNT", "UNIQUE_COUNT", "DUPLICATE_COUNT")
SUITE = _merge(
    {"lineitem": [Check("ROW_COUNT"), Check("FRESHNESS", "l_shipdate")]},
    *[_each(m, {"lineitem": LINEITEM_COLS}) for m in CORE],
    {"orders": [Check("ROW_COUNT"), Check("FRESHNESS", "o_orderdate")]},
    *[_each(m, {"orders": ORDERS_COLS}) for m in CORE],
    *[_each(m, {"orders": ["o_totalprice"]}) for m in ("AVG", "MIN", "MAX", "STDDEV")],
    {"docs_l": [Check("ROW_COUNT")]},
    _each("NULL_COUNT", {"docs_l": ["quality", "toxic"]}),
    _each("NULL_PERCENT", {"docs_l": ["quality", "toxic"]}),
    _each("UNIQUE_COUNT", {"docs_l": ["text"]}),
    _each("DUPLICATE_COUNT", {"docs_l": ["text"]}),
    _each("ACCEPTED_VALUES", {"docs_l": ["lang"]}, values=["en", "fr", "de"]),
)
_define("metric_suite", SUITE, rounded=True)


def metric_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_plan(spark, sf_dir, SUITE, rounded=True)


# M5 option: approximate distinct counts (HLL++, rsd 5%) -- no exact oracle
@register("metric_unique_count_approx")
def metric_unique_count_approx(spark, sf_dir):
    df = read_table(spark, sf_dir, "lineitem")
    return measure(df, [Check("UNIQUE_COUNT", c) for c in LINEITEM_COLS], "lineitem",
                   distinct="approx")


#: How far an estimate may lie from the exact count: three times HLL++'s 5 % deviation.
TOLERANCE = 0.15


@register("metric_unique_count_tolerance", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS DOUBLE) AS exact, true AS within FROM lineitem" for c in LINEITEM_COLS))
def metric_unique_count_tolerance(spark, sf_dir):
    """The estimate of every column held against the exact count of the same engine."""
    df = read_table(spark, sf_dir, "lineitem")
    checks = [Check("UNIQUE_COUNT", c) for c in LINEITEM_COLS]
    exact = measure(df, checks, "lineitem").select("column_name", F.col("value").alias("exact"))
    near = measure(df, checks, "lineitem", distinct="approx").select("column_name", F.col("value").alias("near"))
    return exact.join(near, "column_name").select(
        "column_name", "exact", (F.abs(F.col("near") - F.col("exact")) <= TOLERANCE * F.col("exact")).alias("within"))


# Custom metrics through the registry (SQL aggregate templates)
CUSTOM = {"NEGATIVE_COUNT": "count_if({col} < 0)", "ZERO_COUNT": "count_if({col} = 0)"}
for _name, _tmpl in CUSTOM.items():
    sql_metric(_name, _tmpl)
_CUSTOM_PLAN = {
    "customer": [Check("NEGATIVE_COUNT", "c_acctbal", (("sql", CUSTOM["NEGATIVE_COUNT"]),))],
    "supplier": [Check("NEGATIVE_COUNT", "s_acctbal", (("sql", CUSTOM["NEGATIVE_COUNT"]),))],
    "lineitem": [Check("ZERO_COUNT", c, (("sql", CUSTOM["ZERO_COUNT"]),))
                 for c in ("l_discount", "l_tax")],
}
_define("metric_custom_expr", _CUSTOM_PLAN)


@register("metric_accepted_values_domain", """
SELECT 'orders' AS table_name, 'o_orderpriority' AS column_name, 'ACCEPTED_VALUES' AS metric_name,
  CAST(count(*) AS DOUBLE) AS value
FROM orders WHERE o_orderpriority IS NOT NULL
  AND o_orderpriority NOT IN (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderkey % 7 = 0 AND o_orderstatus = 'F'
                              AND o_orderpriority < '3')""")
def metric_accepted_values_domain(spark, sf_dir):
    """Accepted values that come from a table, with a NULL among them."""
    orders = read_table(spark, sf_dir, "orders")
    domain = (orders.where("o_orderkey % 7 = 0 AND o_orderstatus = 'F' AND o_orderpriority < '3'")
              .select("o_orderpriority").unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS o_orderpriority")))
    check = Check("ACCEPTED_VALUES", "O_ORDERPRIORITY", (("domain", domain),))
    return measure(orders, [check], "orders")


# What fails fails alone
sql_metric("PER_IMPOSSIBLE", "count(*) / count_if({col} IS NULL AND {col} IS NOT NULL)")
_FAILING = [("orders", "ROW_COUNT", None, None), ("orders", "AVG", "o_orderstatus", None),
            ("orders", "PER_IMPOSSIBLE", "o_totalprice", None), ("orders", "NULL_COUNT", "O_CUSTKEY", None),
            ("orders", "UNIQUE_COUNT", "o_custkey", None), ("orders", "NEGATIVE_COUNT", "no_such_column", None),
            ("orders", "ACCEPTED_VALUES", "o_orderstatus", ["O", None, "F"]),
            ("events", "UNIQUE_COUNT", "user_id", None), ("events", "NO_SUCH_METRIC", "user_id", None),
            ("no_such_table", "ROW_COUNT", None, None)]


def failing_run(spark, sf_dir) -> DataFrame:
    checks = config_frame(spark, [("", "", *r) for r in _FAILING],
                          "table_catalog string, table_schema string, table_name string, metric_name string, "
                          "column_name string, accepted_values array<string>")
    return measure_checks_to(spark, checks, scratch_path(spark, "results", unique_name("isolated")), as_of=AS_OF,
                             resolver=lambda db, schema, table: read_table(spark, sf_dir, table))


@register("measure_with_failures", """
SELECT 'orders' AS table_name, CAST(NULL AS VARCHAR) AS column_name, 'ROW_COUNT' AS metric_name,
  CAST(count(*) AS DOUBLE) AS value, false AS failed FROM orders
UNION ALL SELECT 'orders', 'o_custkey', 'NULL_COUNT', CAST(count(*) - count(o_custkey) AS DOUBLE), false FROM orders
UNION ALL SELECT 'orders', 'o_custkey', 'UNIQUE_COUNT', CAST(count(DISTINCT o_custkey) AS DOUBLE), false FROM orders
UNION ALL SELECT 'orders', 'o_orderstatus', 'ACCEPTED_VALUES',
  CAST(count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS DOUBLE), false FROM orders
UNION ALL SELECT 'events', 'user_id', 'UNIQUE_COUNT', CAST(count(DISTINCT user_id) AS DOUBLE), false FROM events
UNION ALL SELECT * FROM (VALUES ('orders', 'o_orderstatus', 'AVG', CAST(NULL AS DOUBLE), true),
  ('orders', 'o_totalprice', 'PER_IMPOSSIBLE', NULL, true), ('orders', 'no_such_column', 'NEGATIVE_COUNT', NULL, true),
  ('events', 'user_id', 'NO_SUCH_METRIC', NULL, true), ('no_such_table', NULL, 'ROW_COUNT', NULL, true)) v""")
def measure_with_failures(spark, sf_dir):
    """A configuration with an unsuitable type, a missing column and table, an unknown metric
    and a division by zero: each of them fails alone."""
    return failing_run(spark, sf_dir).select("table_name", "column_name", "metric_name", "value",
                                              F.col("error").isNotNull().alias("failed"))


# M4/M5: nested values
def nested_orders(spark, sf_dir) -> DataFrame:
    """Orders with a struct, a map and an array of them, and null ones among each."""
    return read_table(spark, sf_dir, "orders").selectExpr(
        "CASE WHEN o_orderkey % 6 <> 0 THEN named_struct('s', o_orderstatus, 'p', o_orderpriority) END AS pair",
        "CASE WHEN o_orderkey % 4 <> 0 THEN map('status', o_orderstatus, 'priority', o_orderpriority) "
        "WHEN o_orderkey % 8 = 0 THEN map('priority', o_orderpriority, 'status', o_orderstatus) END AS tags",
        "array(o_custkey % 10, nullif(o_custkey % 3, 0)) AS codes")


_NESTED = ("UNIQUE_COUNT", "DUPLICATE_COUNT", "DUPLICATE_VALUES", "NULL_COUNT")


def _nested_sql(table: str, column: str, value: str, where: str, source: str) -> str:
    src = f"(SELECT CASE WHEN {where} THEN {value} END AS v FROM {source})"
    facts = {"UNIQUE_COUNT": f"count(DISTINCT v) FROM {src}", "DUPLICATE_COUNT": f"count(v) - count(DISTINCT v) FROM {src}",
             "DUPLICATE_VALUES": f"count(*) FROM (SELECT v FROM {src} WHERE v IS NOT NULL GROUP BY v HAVING count(*) > 1)",
             "NULL_COUNT": f"count(*) - count(v) FROM {src}"}
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{m}' AS metric_name, "
                              f"CAST(x AS DOUBLE) AS value FROM (SELECT {e.replace(' FROM', ' AS x FROM', 1)})"
                              for m, e in facts.items())


@register("metric_nested_values", " UNION ALL ".join([
    _nested_sql("orders", "pair", "coalesce(o_orderstatus, '~') || '|' || coalesce(o_orderpriority, '~')", "o_orderkey % 6 <> 0",
                "orders"),
    _nested_sql("orders", "tags", "coalesce(o_orderstatus, '~') || '|' || coalesce(o_orderpriority, '~')",
                "o_orderkey % 4 <> 0 OR o_orderkey % 8 = 0", "orders"),
    _nested_sql("orders", "codes", "(o_custkey % 10)::VARCHAR || '|' || coalesce(nullif(o_custkey % 3, 0)::VARCHAR, '~')", "true",
                "orders"),
    _nested_sql("embeddings", "embedding", "embedding", "true", "embeddings"),
    _nested_sql("events", "props", "props", "true", "events")]))
def metric_nested_values(spark, sf_dir):
    """Counts by value of structs, maps (in any key order), arrays, vectors and variants."""
    variants = read_table(spark, sf_dir, "events").selectExpr("parse_json(props) AS props")
    frames = {"orders": nested_orders(spark, sf_dir), "embeddings": read_table(spark, sf_dir, "embeddings"), "events": variants}
    columns = {"orders": ["pair", "tags", "codes"], "embeddings": ["embedding"], "events": ["props"]}
    return measure_suite({t: (frames[t], [Check(m, c) for c in cs for m in _NESTED]) for t, cs in columns.items()})


# M9: extremes beyond the integers of a double
_BIG = 9007199254740993


@register("metric_min_max_exact", f"""
WITH t AS (SELECT {_BIG} - o_orderkey AS near, o_orderkey::HUGEINT * {_BIG} AS far, o_custkey FROM orders)
SELECT 'orders' AS table_name, * FROM (
  SELECT 'near' AS column_name, 'MIN' AS metric_name, min(near)::VARCHAR AS value_text FROM t
  UNION ALL SELECT 'near', 'MAX', max(near)::VARCHAR FROM t
  UNION ALL SELECT 'near', 'UNIQUE_COUNT', count(DISTINCT near)::VARCHAR FROM t
  UNION ALL SELECT 'far', 'MIN', min(far)::VARCHAR FROM t
  UNION ALL SELECT 'far', 'MAX', max(far)::VARCHAR FROM t
  UNION ALL SELECT 'o_custkey', 'MAX', max(o_custkey)::VARCHAR FROM t
  UNION ALL SELECT NULL, 'ROW_COUNT', count(*)::VARCHAR FROM t) r""")
def metric_min_max_exact(spark, sf_dir):
    """Extremes of large integers and decimals as text, from value groups and from the scan."""
    orders = read_table(spark, sf_dir, "orders").selectExpr(
        f"{_BIG} - o_orderkey AS near", f"CAST(o_orderkey AS DECIMAL(18,0)) * {_BIG} AS far", "o_custkey")
    checks = [Check("ROW_COUNT"), Check("MIN", "near"), Check("MAX", "near"), Check("UNIQUE_COUNT", "near"), Check("MIN", "far"),
              Check("MAX", "far"), Check("MAX", "o_custkey")]
    return measure(orders, checks, "orders", texts=True).select("table_name", "column_name", "metric_name", "value_text")


# Metrics of a table while it is written
_WRITTEN = [Check("ROW_COUNT"), Check("FRESHNESS", "l_shipdate"), Check("NULL_COUNT", "l_partkey"), Check("AVG", "l_quantity"),
            Check("MIN", "l_extendedprice"), Check("MAX", "l_extendedprice"), Check("STDDEV", "l_quantity"),
            Check("ACCEPTED_VALUES", "l_returnflag", (("values", ("R", "A")),)), Check("UNIQUE_COUNT", "l_suppkey"),
            Check("DUPLICATE_COUNT", "l_suppkey")]


@register("metrics_while_writing", f"""
SELECT table_name, column_name, metric_name, round(value, {ROUND_DIGITS}) AS value
FROM ({checks_sql('lineitem', 'lineitem', _WRITTEN)}) r""")
def metrics_while_writing(spark, sf_dir):
    """Lineitem is written once, and its scan metrics come from that very job."""
    path = scratch_path(spark, "written", unique_name("lineitem"))
    out = write_measured(read_table(spark, sf_dir, "lineitem"), path, _WRITTEN, "lineitem", as_of=AS_OF)
    return out.withColumn("value", F.round("value", ROUND_DIGITS))
