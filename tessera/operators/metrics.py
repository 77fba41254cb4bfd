"""Data-quality metrics over user tables (the part of the engine that touches user data).

Plan shape, per table:

* all *scan* metrics of all columns -> ONE ``agg`` (partial aggregate on every map task,
  a single-row final aggregate): one pass over the columns they use;
* columns with *distinct* metrics, ``DISTINCT_BATCH`` at a time -> one scan that turns each
  row into one typed (column id, value) entry per column, ``groupBy(column id, value)``
  (map-side partial aggregation absorbs hot values: a value holding a third of the rows
  costs one row per map task), then one global aggregate with the per-column counts.
  Batches are unioned into the same job; Parquet pruning reads only a batch's columns.
  This avoids the Expand x (k+1) row multiplication Catalyst uses for k ``countDistinct``
  in one ``agg``, and keeps the number of scan tasks at (splits x batches), not
  (splits x columns). The same value groups give NULL_COUNT, NULL_PERCENT, ROW_COUNT,
  MIN, MAX, FRESHNESS and ACCEPTED_VALUES of texts; AVG, STDDEV and custom metrics of such a
  column share the table's one scan aggregate.

Results come back long: ``table_name, column_name, metric_name, value`` (value is double).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.canonical import canonical_text, is_nested
from tessera.functions.registry import get_metric

# unit recorded with each result (others: 'count')
METRIC_UNITS = {"ROW_COUNT": "rows", "FRESHNESS": "seconds", "NULL_PERCENT": "percent",
                "AVG": "value", "MIN": "value", "MAX": "value", "STDDEV": "value"}

RESULT_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("metric_name", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


@dataclass(frozen=True)
class Check:
    """One metric on one column (``column=None`` for table-level metrics)."""
    metric: str
    column: str | None = None
    params: tuple = field(default=())   # ((key, value), ...) e.g. (("values", ("a", "b")),)

    def param_dict(self) -> dict:
        return {k: v for k, v in self.params}


def col_ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _field_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def validate_checks(df: DataFrame, checks) -> tuple[list[Check], list[tuple[Check, str]]]:
    """Split checks into runnable ones and failures (unknown metric/column, wrong type).

    Failures are isolated per check: the rest of the suite still runs (the reference
    continues after a failed statement and counts successes and errors).
    """
    types = _field_types(df)
    spelled = {}
    for name in types:                # a column is found in any case, an exact match first
        spelled.setdefault(name.upper(), name)
    ok, failed, seen = [], [], set()
    for ch in checks:
        if ch.column is not None and ch.column not in types:
            ch = Check(ch.metric, spelled.get(ch.column.upper(), ch.column), ch.params)
        key = (ch.metric.upper(), ch.column, ch.params)
        if key in seen:               # e.g. FRESHNESS added at table and column level
            continue
        seen.add(key)
        try:
            m = get_metric(ch.metric)
        except KeyError as e:
            failed.append((ch, str(e)))
            continue
        if m.level == "table":
            ok.append(Check(m.name, None, ch.params))
            continue
        if ch.column is None:
            failed.append((ch, f"{m.name} needs a column"))
        elif ch.column not in types:
            failed.append((ch, f"no column {ch.column!r}"))
        elif not m.accepts(types[ch.column]):
            failed.append((ch, f"{m.name} does not accept {types[ch.column].simpleString()}"))
        else:
            ok.append(Check(m.name, ch.column, ch.params))
    return ok, failed


def sql_literal(s: str | None) -> str:
    """A Spark SQL string literal (NULL for None)."""
    if s is None:
        return "CAST(NULL AS STRING)"
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Metrics whose value is a whole number; MIN and MAX have the type of their column.
WHOLE = ("ROW_COUNT", "FRESHNESS", "NULL_COUNT", "UNIQUE_COUNT", "DUPLICATE_COUNT", "DUPLICATE_VALUES", "ACCEPTED_VALUES")


def _stack(table: str, items: list[tuple[str | None, str, str, str | None]]) -> str:
    """One SQL ``stack`` turning named aggregate columns into long rows: building the
    long shape as one expression string keeps driver work flat in the number of checks.
    ``items``: column, metric, value and, if there is one, the exact text (expressions)."""
    rows = ", ".join(f"{sql_literal(table)}, {sql_literal(col)}, {sql_literal(metric)}, "
                     f"CAST({val} AS DOUBLE), CAST({text or 'NULL'} AS STRING)" for col, metric, val, text in items)
    return f"stack({len(items)}, {rows}) AS (table_name, column_name, metric_name, value, value_text)"


# Columns whose distinct metrics share one scan. 1 = one scan + shuffle per column (least
# memory per task); larger batches divide the number of scan tasks by the batch size --
# splits are sized by file bytes, not by the pruned column, so per-column scans multiply
# the task count by the number of columns.
DISTINCT_BATCH = 4

_COUNT_STATS = {
    "UNIQUE_COUNT": "count(v)",
    "DUPLICATE_COUNT": "coalesce(sum(CASE WHEN v IS NOT NULL THEN n END) - count(v), 0)",
    "DUPLICATE_VALUES": "count_if(v IS NOT NULL AND n > 1)",
    # the value groups also carry the NULL group and the row total: NULL_COUNT,
    # NULL_PERCENT and ROW_COUNT come free with a column's distinct metrics
    "NULL_COUNT": "coalesce(sum(CASE WHEN v IS NULL THEN n END), 0)",
    "ROWS": "coalesce(sum(n), 0)",
}
# one stats row per column: the counts plus typed extremes (see _extremes)
_STATS_COLUMNS = [*_COUNT_STATS, "MIN_D", "MAX_D", "FRESH", "MIN_T", "MAX_T", "OUTSIDE"]
# metrics the group counts give exactly (same double operations as the scan builders)
_FROM_GROUPS = {
    "UNIQUE_COUNT": "CAST(UNIQUE_COUNT AS DOUBLE)",
    "DUPLICATE_COUNT": "CAST(DUPLICATE_COUNT AS DOUBLE)",
    "DUPLICATE_VALUES": "CAST(DUPLICATE_VALUES AS DOUBLE)",
    "NULL_COUNT": "CAST(NULL_COUNT AS DOUBLE)",
    "NULL_PERCENT": "CASE WHEN ROWS > 0 THEN CAST(100.0 AS DOUBLE) * NULL_COUNT / ROWS END",
    "ROW_COUNT": "CAST(ROWS AS DOUBLE)",
    "MIN": "MIN_D",
    "MAX": "MAX_D",
    "FRESHNESS": "FRESH",
    "ACCEPTED_VALUES": "CAST(OUTSIDE AS DOUBLE)",
}
# their exact texts; what is missing here has none beyond its double
_TEXT_FROM_GROUPS = {
    "UNIQUE_COUNT": "UNIQUE_COUNT", "DUPLICATE_COUNT": "DUPLICATE_COUNT", "DUPLICATE_VALUES": "DUPLICATE_VALUES",
    "NULL_COUNT": "NULL_COUNT", "ROW_COUNT": "ROWS", "MIN": "MIN_T", "MAX": "MAX_T",
    "FRESHNESS": "CAST(FRESH AS BIGINT)", "ACCEPTED_VALUES": "OUTSIDE",
}
DERIVED_FROM_GROUPS = ("NULL_COUNT", "NULL_PERCENT", "ROW_COUNT", "MIN", "MAX", "FRESHNESS", "ACCEPTED_VALUES")
_BUILT_IN = {name: get_metric(name) for name in DERIVED_FROM_GROUPS}


def _extremes(dtype: T.DataType, value: str, as_of) -> dict[str, str]:
    """SQL for MIN_D / MAX_D / FRESH and the texts MIN_T / MAX_T over ``value`` (the same
    results as the scan builders: extremes of the distinct values are the extremes of the
    rows)."""
    none = "CAST(NULL AS DOUBLE)"
    texts = {"MIN_T": "CAST(NULL AS STRING)", "MAX_T": "CAST(NULL AS STRING)"}
    if isinstance(dtype, T.NumericType):
        return {"MIN_D": f"CAST(min({value}) AS DOUBLE)", "MAX_D": f"CAST(max({value}) AS DOUBLE)",
                "FRESH": none, "MIN_T": f"CAST(min({value}) AS STRING)", "MAX_T": f"CAST(max({value}) AS STRING)"}
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        clock = "current_timestamp()" if as_of is None else f"to_timestamp({sql_literal(str(as_of))})"
        return {"MIN_D": none, "MAX_D": none,
                "FRESH": f"CAST(unix_timestamp({clock}) - unix_timestamp(max({value})) AS DOUBLE)", **texts}
    return {"MIN_D": none, "MAX_D": none, "FRESH": none, **texts}


def _group_type(dtype: T.DataType) -> str:
    """The type of :func:`_group_key`."""
    return "string" if is_nested(dtype) else dtype.simpleString()


def _group_key(dtype: T.DataType, column: str) -> str:
    """What a column is grouped by: the value, or the digest of a long string or binary or of
    any nested value, so that texts and vectors don't cross the network whole. Kept values
    are shorter than any digest, so the two never meet."""
    c = f"`{column.replace('`', '``')}`"
    if is_nested(dtype):
        return f"sha2({canonical_text(dtype, c)}, 256)"
    if isinstance(dtype, T.StringType):
        return f"CASE WHEN octet_length({c}) < 64 THEN {c} ELSE sha2({c}, 256) END"
    if isinstance(dtype, T.BinaryType):
        return f"CASE WHEN octet_length({c}) < 32 THEN {c} ELSE unhex(sha2({c}, 256)) END"
    return c


def _accepted_list(dtype: T.DataType, ch: Check) -> list[str] | None:
    """The accepted values of a text column as group keys; None when the groups can't tell."""
    values = ch.param_dict().get("values")
    if not isinstance(dtype, T.StringType) or values is None or set(ch.param_dict()) != {"values"}:
        return None
    texts = [v for v in values if v is not None]
    if not texts or not all(isinstance(v, str) for v in texts):
        return None
    return [v if len(v.encode()) < 64 else hashlib.sha256(v.encode()).hexdigest() for v in texts]


def _outside(value: str, n: str, accepted: list[str] | None) -> str:
    """SQL for the rows whose (grouped) value is not accepted."""
    if accepted is None:
        return "CAST(NULL AS BIGINT)"
    return f"coalesce(sum(CASE WHEN {value} NOT IN ({', '.join(map(sql_literal, accepted))}) THEN {n} END), 0)"


def _distinct_stats(df: DataFrame, cid: int, column: str, as_of=None, accepted=None) -> DataFrame:
    """One stats row (cid and ``_STATS_COLUMNS``) for one column."""
    exprs = {**_COUNT_STATS, **_extremes(_field_types(df)[column], "v", as_of),
             "OUTSIDE": _outside("v", "n", (accepted or {}).get(column))}
    key = F.expr(_group_key(_field_types(df)[column], column))
    groups = df.groupBy(key.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.expr(f"{cid} AS cid"), *[F.expr(f"{e} AS {m}") for m, e in exprs.items()])


def _distinct_stats_batch(df: DataFrame, batch: list[tuple[int, str]], as_of=None, accepted=None) -> DataFrame:
    """Stats rows for several columns from ONE scan: every row becomes one typed entry per
    column -- struct(cid, one field per distinct type, only the column's own field set) --
    so values keep their type (no string casts) and one group-by serves the batch."""
    own_type = _field_types(df)
    dtypes = {c: _group_type(t) for c, t in own_type.items()}
    slots: dict[str, int] = {}
    for _, c in batch:
        slots.setdefault(dtypes[c], len(slots))
    entries = []
    for cid, c in batch:
        own = slots[dtypes[c]]
        fields = [f"'cid', {cid}"] + [
            f"'f{j}', " + (_group_key(own_type[c], c) if j == own else f"CAST(NULL AS {t})")
            for t, j in slots.items()]
        entries.append(f"named_struct({', '.join(fields)})")
    fcols = [f"f{j}" for j in slots.values()]
    isnull = " AND ".join(f"{f} IS NULL" for f in fcols)
    groups = (df.selectExpr(f"inline(array({', '.join(entries)}))")
              .groupBy("cid", *fcols).agg(F.count(F.lit(1)).alias("n"))
              .selectExpr("cid", *fcols, f"NOT ({isnull}) AS present", "n"))
    # one global aggregate (always one row, also for an empty table), then one row per column
    aggs = []
    for cid, c in batch:
        on = f"cid = {cid} AND present"
        ext = _extremes(own_type[c], f"CASE WHEN cid = {cid} THEN f{slots[dtypes[c]]} END", as_of)
        aggs += [F.expr(f"count_if({on}) AS u{cid}"),
                 F.expr(f"coalesce(sum(CASE WHEN {on} THEN n END), 0) - count_if({on}) AS s{cid}"),
                 F.expr(f"count_if({on} AND n > 1) AS r{cid}"),
                 F.expr(f"coalesce(sum(CASE WHEN cid = {cid} AND NOT present THEN n END), 0) AS z{cid}"),
                 F.expr(f"coalesce(sum(CASE WHEN cid = {cid} THEN n END), 0) AS t{cid}"),
                 F.expr(f"{ext['MIN_D']} AS lo{cid}"), F.expr(f"{ext['MAX_D']} AS hi{cid}"),
                 F.expr(f"{ext['FRESH']} AS fr{cid}"),
                 F.expr(f"{ext['MIN_T']} AS lt{cid}"), F.expr(f"{ext['MAX_T']} AS ht{cid}"),
                 F.expr(_outside(f"CASE WHEN cid = {cid} THEN f{slots[dtypes[c]]} END", "n",
                                 (accepted or {}).get(c)) + f" AS ou{cid}")]
    rows = ", ".join(f"{cid}, u{cid}, s{cid}, r{cid}, z{cid}, t{cid}, lo{cid}, hi{cid}, fr{cid}, lt{cid}, ht{cid}, ou{cid}"
                     for cid, _ in batch)
    return groups.agg(*aggs).selectExpr(
        f"stack({len(batch)}, {rows}) AS (cid, {', '.join(_STATS_COLUMNS)})")


def _distinct_part(df: DataFrame, table: str, by_column: dict[str, list[str]],
                   batch: int = 1, as_of=None, accepted=None) -> DataFrame:
    """All group-count metrics of a table: stats rows per column (``batch`` columns per
    scan), unioned, then one long shaping step that keeps only the requested (column,
    metric) pairs. ROW_COUNT, when asked for, is taken from the first column's groups."""
    cols = list(by_column)
    if batch <= 1:
        frames = [_distinct_stats(df, i, c, as_of, accepted) for i, c in enumerate(cols)]
    else:
        ids = list(enumerate(cols))
        frames = [_distinct_stats_batch(df, ids[k:k + batch], as_of, accepted)
                  for k in range(0, len(ids), batch)]
    stats = reduce(lambda a, b: a.union(b), [f.select("cid", *_STATS_COLUMNS) for f in frames])
    names = "array(" + ", ".join(sql_literal(c) for c in cols) + ")"
    metrics = ", ".join(f"{sql_literal(m)}, {e}, CAST({_TEXT_FROM_GROUPS.get(m, 'NULL')} AS STRING)"
                        for m, e in _FROM_GROUPS.items())
    wanted = ", ".join(sql_literal(f"{i}:{m}") for i, c in enumerate(cols) for m in by_column[c])
    return (stats.selectExpr(f"{sql_literal(table)} AS table_name",
                             f"element_at({names}, cid + 1) AS column_name", "cid",
                             f"stack({len(_FROM_GROUPS)}, {metrics}) AS (metric_name, value, value_text)")
            .where(f"concat(cid, ':', metric_name) IN ({wanted})")
            .selectExpr("table_name",
                        "CASE WHEN metric_name = 'ROW_COUNT' THEN CAST(NULL AS STRING) "
                        "ELSE column_name END AS column_name", "metric_name", "value", "value_text"))


def _domain_branch(df: DataFrame, table: str, ch: Check) -> DataFrame:
    """ACCEPTED_VALUES against a domain table: values are grouped first, so a hot value is
    one row of the anti-join, and the group counts are summed."""
    dom = ch.param_dict()["domain"]
    dom = dom.select(F.col(dom.columns[0]).alias("_v"))
    groups = (df.select(col_ref(ch.column).alias("_v")).filter(F.col("_v").isNotNull())
              .groupBy("_v").agg(F.count(F.lit(1)).alias("_n")))
    outside = groups.join(dom.distinct(), "_v", "left_anti")
    return outside.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).selectExpr(
        _stack(table, [(ch.column, "ACCEPTED_VALUES", "n", "n")]))


def _needs_domain_join(ch: Check) -> bool:
    return ch.metric.upper() == "ACCEPTED_VALUES" and "domain" in ch.param_dict()


def measure(df: DataFrame, checks, table_name: str, *, as_of=None,
            distinct: str = "exact", materialize: bool = False,
            distinct_batch: int = DISTINCT_BATCH, one_read: bool = False,
            reasons: bool = False, texts: bool = False) -> DataFrame:
    """Evaluate ``checks`` on ``df``; one long row per check.

    ``texts=True`` adds ``value_text``, the exact value where the double may round it: MIN and
    MAX in the type of their column, whole numbers in full (null for the other metrics).
    Arrays, structs, maps and variants are counted by the digest of their canonical text.

    A check that cannot run (unknown metric or column, unsuitable type, an expression that
    does not resolve) gives a NULL; ``reasons=True`` adds its ``error`` text.

    ``as_of`` is the measurement clock for FRESHNESS (default: current timestamp).
    ``distinct="approx"`` computes UNIQUE_COUNT with HyperLogLog++ inside the scan
    aggregate instead of a group-by (duplicate counts stay exact).
    ``materialize=True`` cuts the lineage of an expensive derived source (a shuffle join,
    say) once -- a checkpoint of the needed columns in the shared checkpoint folder --
    so the per-column branches do not each recompute it. Plain scans need no such step:
    each branch reads only its own column.
    ``one_read=True`` suits a derived source without a written cut: every column whose
    metrics the value groups can give is grouped, and all of them share one batch, so the
    source runs once (once more if other metrics remain).
    """
    spark = df.sparkSession
    ok, failed = validate_checks(df, checks)
    types = _field_types(df)
    parts: list[DataFrame] = []

    scan, by_column, domain = [], {}, []
    for ch in ok:
        m = get_metric(ch.metric)
        if _needs_domain_join(ch):
            domain.append(ch)
        elif m.kind == "scan" or (distinct == "approx" and m.name == "UNIQUE_COUNT"):
            scan.append((ch, m))
        elif m.name in _FROM_GROUPS:
            by_column.setdefault(ch.column, []).append(m.name)
        else:
            raise ValueError(f"distinct metric {m.name} has no form over value groups; register it as a scan metric")
    accepted: dict[str, list[str]] = {}

    def from_groups(ch: Check, m) -> bool:
        """Whether the value groups of its column give this check (the built-in form only)."""
        if m is not _BUILT_IN.get(m.name) or m.level != "column":
            return False
        if m.name != "ACCEPTED_VALUES":
            return not ch.params
        return ch.column not in accepted and _accepted_list(types[ch.column], ch) is not None

    if one_read and by_column:
        by_name: dict[str, list] = {}
        for ch, m in scan:
            if ch.column:
                by_name.setdefault(ch.column, []).append((ch, m))
        for c, own in by_name.items():
            if c not in by_column and all(from_groups(ch, m) for ch, m in own) \
                    and sum(m.name == "ACCEPTED_VALUES" for _, m in own) < 2:
                by_column[c] = []
        distinct_batch = max(distinct_batch, len(by_column))
    if by_column:
        # NULL_COUNT / NULL_PERCENT of a column that is grouped anyway, and ROW_COUNT, come
        # from the group counts: no second read of those columns
        first = next(iter(by_column))
        rest = []
        for ch, m in scan:
            if ch.column in by_column and from_groups(ch, m):
                by_column[ch.column].append(m.name)
                if m.name == "ACCEPTED_VALUES":
                    accepted[ch.column] = _accepted_list(types[ch.column], ch)
            elif m is _BUILT_IN["ROW_COUNT"]:
                by_column[first].append("ROW_COUNT")
            else:
                rest.append((ch, m))
        scan = rest

    if materialize and (len(by_column) + len(domain) + (1 if scan else 0)) > 1:
        from tessera.session import checkpoint_root
        checkpoint_root(spark)
        needed = sorted({ch.column for ch in ok if ch.column})
        df = (df.select(*[col_ref(c) for c in needed]) if needed else df.select(F.lit(1).alias("_one")))
        df = df.checkpoint(eager=True)

    if scan:
        built = []
        for ch, m in scan:
            c = col_ref(ch.column) if ch.column else None
            params = {"as_of": as_of, **ch.param_dict()}
            if ch.column:
                params["column_sql"] = "`" + ch.column.replace("`", "``") + "`"
            try:
                built.append((ch, m, F.approx_count_distinct(c).cast("double") if m.name == "UNIQUE_COUNT"
                              else m.build(c, params)))
            except Exception as e:
                failed.append((ch, str(e)))

        def scanned(part) -> DataFrame:
            return df.agg(*_scan_aggregates(part)).selectExpr(_stack(table_name, _scan_items(part)))

        try:
            parts += [scanned(built)] if built else []
        except AnalysisException:       # some expression does not resolve: find out which
            sound = []
            for one in built:
                try:
                    scanned([one])
                    sound.append(one)
                except AnalysisException as e:
                    failed.append((one[0], str(e)))
            parts += [scanned(sound)] if sound else []

    def grouped(columns: dict) -> DataFrame:
        return _distinct_part(df, table_name, columns, distinct_batch, as_of, accepted)

    if by_column:
        try:
            parts.append(grouped(by_column))
        except AnalysisException:       # some column has no groups: find out which
            sound_columns = {}
            for c, names in by_column.items():
                try:
                    grouped({c: names})
                    sound_columns[c] = names
                except AnalysisException as e:
                    failed += [(Check(m, None if m == "ROW_COUNT" else c), str(e)) for m in names]
            parts += [grouped(sound_columns)] if sound_columns else []

    for ch in domain:
        try:
            parts.append(_domain_branch(df, table_name, ch))
        except AnalysisException as e:
            failed.append((ch, str(e)))

    parts = [x if texts else x.drop("value_text") for x in parts]
    if reasons:
        parts = [x.withColumn("error", F.lit(None).cast("string")) for x in parts]
    if failed or not parts:
        parts.append(_failed_rows(spark, [(table_name, ch, why) for ch, why in failed], reasons, texts))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _scan_aggregates(part) -> list[Column]:
    """The aggregates of scan metrics (check, metric, expression): ``_m0``, ``_m1``, ..., and
    ``_t0``, ... for extremes, whose text is that of the column's own type."""
    out = []
    for i, (ch, m, expr) in enumerate(part):
        out.append(expr.alias(f"_m{i}"))
        if m is _BUILT_IN.get(m.name) and m.name in ("MIN", "MAX"):
            extreme = F.min if m.name == "MIN" else F.max
            out.append(extreme(col_ref(ch.column)).cast("string").alias(f"_t{i}"))
    return out


def _scan_items(part) -> list[tuple]:
    return [(ch.column, m.name, f"_m{i}",
             f"_t{i}" if m is _BUILT_IN.get(m.name) and m.name in ("MIN", "MAX") else
             f"CAST(_m{i} AS BIGINT)" if m.name in WHOLE else None) for i, (ch, m, _) in enumerate(part)]


def _failed_rows(spark: SparkSession, failed, reasons: bool, texts: bool = False) -> DataFrame:
    """NULL results of checks that could not run: (table name, check, reason)."""
    extra = [T.StructField("value_text", T.StringType()), T.StructField("error", T.StringType())]
    schema = T.StructType([*RESULT_SCHEMA.fields, *extra])
    out = spark.createDataFrame([(t, ch.column, ch.metric.upper(), None, None, why) for t, ch, why in failed], schema)
    return out.drop(*(["error"] if not reasons else []), *(["value_text"] if not texts else []))


def measure_expand(df: DataFrame, checks, table_name: str, *, as_of=None) -> DataFrame:
    """Same results as :func:`measure` with every metric in ONE aggregate.

    Distinct metrics become ``count(DISTINCT c)`` which Catalyst plans as Expand x (k+1)
    plus two aggregates. Kept for sources that cannot be re-scanned cheaply (a
    micro-batch frame) and as the benchmark counterpart of the batched plan.
    """
    ok, failed = validate_checks(df, checks)
    aggs, items = [], []
    for i, ch in enumerate(ok):
        m = get_metric(ch.metric)
        c = col_ref(ch.column) if ch.column else None
        if m.name == "UNIQUE_COUNT":
            expr = F.count_distinct(c)
        elif m.name == "DUPLICATE_COUNT":
            expr = F.count(c) - F.count_distinct(c)
        elif m.name == "DUPLICATE_VALUES":
            raise ValueError("DUPLICATE_VALUES needs per-value counts; use measure()")
        else:
            params = {"as_of": as_of, **ch.param_dict()}
            if ch.column:
                params["column_sql"] = "`" + ch.column.replace("`", "``") + "`"
            expr = m.build(c, params)
        aggs.append(expr.alias(f"_m{i}"))
        items.append((ch.column, m.name, f"_m{i}", None))
    out = df.agg(*aggs).selectExpr(_stack(table_name, items)).drop("value_text")
    if failed:
        rows = [(table_name, ch.column, ch.metric.upper(), None) for ch, _ in failed]
        out = out.unionByName(df.sparkSession.createDataFrame(rows, RESULT_SCHEMA))
    return out


def measure_suite(suite: dict[str, tuple[DataFrame, list]], *, as_of=None,
                  distinct: str = "exact", materialize=(), one_read=()) -> DataFrame:
    """Measure several tables; one union of the per-table plans (one job when collected).
    ``materialize`` names the tables whose (derived) source is checkpointed once,
    ``one_read`` those whose columns share one batch."""
    parts = [measure(df, checks, name, as_of=as_of, distinct=distinct,
                     materialize=name in materialize, one_read=name in one_read)
             for name, (df, checks) in suite.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def column_checks(df: DataFrame, metrics, columns=None, **params) -> list[Check]:
    """Every compatible (column, metric) pair of ``df`` for the given metric names."""
    p = tuple(sorted(params.items()))
    out = []
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        for name in metrics:
            m = get_metric(name)
            if m.level == "column" and m.accepts(f.dataType):
                out.append(Check(m.name, f.name, p))
    return out


def empty_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RESULT_SCHEMA)


TABLE_KEYS = ("table_catalog", "table_schema", "table_name")


def _check_of(row) -> Check:
    values = row["accepted_values"] if "accepted_values" in row else None
    return Check(row["metric_name"], row["column_name"], () if values is None else (("values", tuple(values)),))


def _checks_by_table(checks: DataFrame) -> Iterator[tuple[tuple, list[Check]]]:
    """(table, its checks), table after table: the configuration streams through the driver
    in order and only one table's checks are held."""
    wanted = [*TABLE_KEYS, "metric_name", "column_name",
              *(["accepted_values"] if "accepted_values" in checks.columns else [])]
    table, own = None, []
    for r in checks.select(*wanted).orderBy(*TABLE_KEYS).toLocalIterator():
        if tuple(r[:3]) != table:
            if own:
                yield table, own
            table, own = tuple(r[:3]), []
        own.append(_check_of(r))
    if own:
        yield table, own


def _by_name(spark: SparkSession):
    def resolve(db, schema, table):
        return spark.table(".".join("`" + p.replace("`", "``") + "`" for p in (db, schema, table) if p))
    return resolve


def _measure_tables(spark: SparkSession, items, as_of, resolver, distinct, reasons=False) -> DataFrame:
    resolver = resolver or _by_name(spark)
    parts, unread = [], []
    for key, chs in items:
        name = ".".join(p for p in key if p)
        try:
            df = resolver(*key)
        except Exception as e:      # unreadable table: its checks become NULL results
            unread += [(name, c, str(e)) for c in chs]
            continue
        parts.append(measure(df, chs, name, as_of=as_of, distinct=distinct, reasons=reasons))
    if unread or not parts:
        parts.append(_failed_rows(spark, unread, reasons))
    return reduce(lambda a, b: a.unionByName(b), parts)


def measure_checks(spark: SparkSession, checks: DataFrame, *, as_of=None, resolver=None,
                   distinct: str = "exact") -> DataFrame:
    """Measure a checks configuration (rows: table_catalog, table_schema, table_name,
    metric_name, column_name -- the shape of ``checks.expand_checks`` -- and, if there,
    ``accepted_values``, an array of texts) as one union.

    The configuration is read on the driver (it is bounded by schemas, not data) to build
    one plan per table; tables are resolved with ``resolver(db, schema, table)`` (default:
    ``spark.table`` on the qualified name). ``table_name`` in the result is the qualified
    name. For account-wide configurations use :func:`measure_checks_in_jobs`."""
    return _measure_tables(spark, _checks_by_table(checks), as_of, resolver, distinct)


def _groups_of(items, n: int) -> Iterator[list]:
    group = []
    for item in items:
        group.append(item)
        if len(group) == n:
            yield group
            group = []
    if group:
        yield group


def measure_checks_in_jobs(spark: SparkSession, checks: DataFrame, tables_per_job: int = 200, *,
                           as_of=None, resolver=None, distinct: str = "exact"):
    """Like :func:`measure_checks`, but yields one result frame per group of tables, so a
    configuration over many thousands of tables never becomes one giant plan."""
    for group in _groups_of(_checks_by_table(checks), tables_per_job):
        yield _measure_tables(spark, group, as_of, resolver, distinct)


def measure_checks_to(spark: SparkSession, checks: DataFrame, path: str, tables_per_job: int = 50, *,
                      as_of=None, resolver=None, distinct: str = "exact") -> DataFrame:
    """Measure a configuration into a results table at ``path`` and read it back, with an
    ``error`` column. What fails while running fails alone: a job that fails is run again in
    two halves, of its tables, then of a table's checks, so that one bad check of n costs
    about 2 log2(n) further jobs and not n; a check that fails on its own becomes a NULL with
    the whole error text. Failed jobs leave no rows (file commit protocol); ``path`` should
    be new for each run.
    """
    def store(frame: DataFrame) -> None:
        frame.write.mode("append").parquet(path)

    def run(items) -> None:
        try:
            store(_measure_tables(spark, items, as_of, resolver, distinct, True))
            return
        except Exception as e:
            if len(items) == 1 and len(items[0][1]) == 1:
                (key, (ch,)), = items
                store(_failed_rows(spark, [(".".join(p for p in key if p), ch, str(e))], True))
                return
        if len(items) == 1:
            (key, chs), = items
            halves = [[(key, chs[:len(chs) // 2])], [(key, chs[len(chs) // 2:])]]
        else:
            halves = [items[:len(items) // 2], items[len(items) // 2:]]
        for half in halves:
            run(half)

    store(_failed_rows(spark, [], True))
    for group in _groups_of(_checks_by_table(checks), tables_per_job):
        run(group)
    return spark.read.parquet(path)


def outcome_counts(results: DataFrame) -> DataFrame:
    """One row: checks measured and checks failed (rows with an ``error``)."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("measured"),
                       F.count_if(F.col("error").isNotNull()).alias("failed"))
