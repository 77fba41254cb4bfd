"""Helpers that write the DuckDB oracle for metric checks (one SELECT per check).

Deliberately a different formulation from the Spark plan: ``count(DISTINCT c)``,
``count(*) - count(c)`` and a HAVING sub-query, instead of the union-of-group-bys.
"""

from __future__ import annotations

from tessera.plans.base import AS_OF


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _value_sql(table: str, metric: str, column: str | None, params: dict) -> tuple[str, str]:
    """Return (value expression, FROM clause)."""
    c = f'"{column}"' if column else None
    frm = f"FROM {table}"
    if metric == "ROW_COUNT":
        v = "count(*)"
    elif metric == "FRESHNESS":
        v = f"date_diff('second', max({c}), TIMESTAMP '{AS_OF}')"
    elif metric == "NULL_COUNT":
        v = f"count(*) - count({c})"
    elif metric == "NULL_PERCENT":
        v = f"CASE WHEN count(*) > 0 THEN 100.0::DOUBLE * (count(*) - count({c})) / count(*) END"
    elif metric == "ACCEPTED_VALUES":
        vals = ", ".join(_q(x) for x in params["values"])
        v = f"count(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN ({vals}))"
    elif metric == "AVG":
        v = f"avg({c})"
    elif metric == "MIN":
        v = f"min({c})"
    elif metric == "MAX":
        v = f"max({c})"
    elif metric == "STDDEV":
        v = f"stddev_samp({c})"
    elif metric == "UNIQUE_COUNT":
        v = f"count(DISTINCT {c})"
    elif metric == "DUPLICATE_COUNT":
        v = f"count({c}) - count(DISTINCT {c})"
    elif metric == "DUPLICATE_VALUES":
        v = "count(*)"
        frm = (f"FROM (SELECT {c} FROM {table} WHERE {c} IS NOT NULL "
               f"GROUP BY {c} HAVING count(*) > 1) s")
    elif "sql" in params:
        v = params["sql"].format(col=c)
    else:
        raise ValueError(metric)
    return v, frm


def checks_sql(table_view: str, table_name: str, checks, round_digits: int | None = None) -> str:
    """UNION ALL of one SELECT per check, long shape (table_name, column_name, metric_name, value)."""
    parts = []
    for ch in checks:
        metric, column = ch.metric.upper(), ch.column
        v, frm = _value_sql(table_view, metric, column, ch.param_dict())
        val = f"CAST({v} AS DOUBLE)"
        if round_digits is not None:
            val = f"round({val}, {round_digits})"
        colsql = _q(column) if column else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT {_q(table_name)} AS table_name, {colsql} AS column_name, "
                     f"{_q(metric)} AS metric_name, {val} AS value {frm}")
    return "\nUNION ALL\n".join(parts)


def sql_quote(e: str) -> str:
    """DuckDB CASE that quotes an identifier expression like ``quote_identifier``."""
    return (f"(CASE WHEN {e} IS NULL OR {e} = '' THEN {e} "
            f"WHEN starts_with({e}, '\"') AND ends_with({e}, '\"') THEN {e} "
            f"WHEN regexp_matches({e}, '[ .+/*()\\[\\]{{}}-]') OR upper({e}) IN "
            f"('TABLE', 'COLUMN', 'VIEW', 'DATABASE', 'SCHEMA', 'SELECT', 'FROM', 'WHERE') "
            f"THEN '\"' || {e} || '\"' ELSE {e} END)")


def sql_fq(db: str, schema: str, table: str) -> str:
    return f"({sql_quote(db)} || '.' || {sql_quote(schema)} || '.' || {sql_quote(table)})"


def comment_statement_sql(ot, db, sc, tb, col, text):
    """DuckDB CASE rendering the COMMENT statement recorded with a description change."""
    body = f"' IS ''' || coalesce(replace({text}, '''', ''''''), '') || ''';'"
    return (f"CASE WHEN {ot} = 'TABLE' THEN 'COMMENT ON TABLE ' || {sql_fq(db, sc, tb)} || {body} "
            f"WHEN {ot} = 'COLUMN' AND {col} IS NOT NULL AND {col} <> '' THEN 'COMMENT ON COLUMN ' || "
            f"{sql_fq(db, sc, tb)} || '.' || {sql_quote(col)} || {body} "
            f"ELSE '-- ' || {ot} || ' description update' END")
