"""Descriptions: samples, prompts, a pluggable completer, cleaning, merging and the
batch job (S10, S11, D2-D6, J2, J3, U3, A16, X5).

The reference makes one warehouse round trip per table and per column. Here every step
is one DataFrame over all objects: column lines and samples are aggregated per object
(bounded by a table's width or the sample size), prompts are one projection, and the
completer runs once per partition.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.canonical import canonical_text
from tessera.functions.text import clean_generated, is_blank
from tessera.operators.metrics import sql_literal

TABLE_SAMPLE_ROWS = 5
COLUMN_SAMPLE_VALUES = 10
TABLE_LIMIT = 150       # characters asked for in table prompts
COLUMN_LIMIT = 100      # characters asked for in column prompts
GENERATION_TYPES = ("TABLE", "COLUMN", "BOTH")
NO_COLUMNS = "(none listed)"
NO_SAMPLE = "(none at hand)"
OBJ_KEYS = ["database_name", "schema_name", "table_name"]

# what is asked for, after the facts
TABLE_ASK = (f"Tell someone new to this data, in one plain sentence of up to {TABLE_LIMIT} characters, "
             "what one row stands for and which question it answers.")
COLUMN_ASK = (f"Tell someone new to this data, in one plain phrase of up to {COLUMN_LIMIT} characters, "
              "what a value of this field says about its row.")


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _render(df: DataFrame) -> str:
    """SQL for a row as text, as one string (few calls to build it, however wide the table). A
    NULL cell keeps its place."""
    return "concat_ws(' | ', %s)" % ", ".join(f"coalesce(CAST({_ident(c)} AS STRING), 'NULL')" for c in df.columns)


# ---------------------------------------------------------------- samples

def _first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` (SQL; column ``_o``) and as text (``_t``): a bounded
    top-n of one pass, run with whatever uses it. Of rows that tie, the least by their
    columns come first."""
    ties = [canonical_text(f.dataType, _ident(f.name)) if _without_order(f.dataType) else _ident(f.name)
            for f in df.schema.fields]
    return df.selectExpr("*", f"{order} AS _o").orderBy("_o", *[F.expr(t) for t in ties]).limit(n).selectExpr(
        "*", f"{_render(df)} AS _t")


def _without_order(dtype: T.DataType) -> bool:
    """Whether values of the type have no order: maps and variants, and what holds them."""
    if isinstance(dtype, T.ArrayType):
        return _without_order(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_without_order(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.MapType, T.VariantType))


def _up_to_nth(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows whose ``key`` is among the first ``n`` (nulls first): the n-th is a subquery
    over that column alone, and its value reaches the scan as a filter, so row groups beyond
    it are not read."""
    k = F.col(_ident(key))
    nth = df.select(k.alias("k")).orderBy("k").limit(n).agg(F.max("k"))
    return df.where(k.isNull() | (k <= nth.scalar()))


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _names(table: str, database: str | None, schema: str | None) -> dict:
    """The object keys of a sample; database and schema only if given."""
    given = {"database_name": database, "schema_name": schema}
    return {k: v for k, v in given.items() if v is not None} | {"table_name": table}


def _placed(names: dict) -> list[str]:
    return [f"{sql_literal(v)} AS {k}" for k, v in names.items()]


def sample_rows(df: DataFrame, table: str, key, n: int = TABLE_SAMPLE_ROWS, database: str | None = None,
                schema: str | None = None) -> DataFrame:
    """First ``n`` rows by ``key`` (a column or several) rendered as text: object keys, rn,
    row_text."""
    keys = _keys(key)
    top = _first_rows(_up_to_nth(df, keys[0], n), "struct(%s)" % ", ".join(map(_ident, keys)), n)
    names = _placed(_names(table, database, schema))
    return top.selectExpr(*names, f"row_number() OVER (PARTITION BY {sql_literal(table)} ORDER BY _o, _t) AS rn", "_t AS row_text")


def sample_text(rows: DataFrame) -> DataFrame:
    """Sampled rows -> object keys and sample_data: rows joined by newlines (at most the
    sample size per table)."""
    keys = [k for k in OBJ_KEYS if k in rows.columns]
    return rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "row_text"))),
                                 lambda s: s["row_text"]), "\n").alias("sample_data"))


def column_samples(df: DataFrame, table: str, key, columns=None, n: int = COLUMN_SAMPLE_VALUES,
                   database: str | None = None, schema: str | None = None) -> DataFrame:
    """``n`` values per column, the same pseudo-random rows for every column: ordered by
    md5 of the key (a stable order any engine reproduces).
    Output: object keys, column_name, sample_rank, value_text."""
    cols, keys = columns or df.columns, _keys(key)
    sampled = df.select(*[_ident(c) for c in dict.fromkeys([*keys, *cols])])
    top = _first_rows(sampled, "md5(concat_ws(' ', %s))" % ", ".join(f"CAST({_ident(k)} AS STRING)" for k in keys), n)
    names = _names(table, database, schema)
    cells = ", ".join(f"named_struct('column_name', {sql_literal(c)}, 'value_text', CAST({_ident(c)} AS STRING))" for c in cols)
    # rank within the n sampled rows (the window only ever sees the top-n of one table)
    return top.selectExpr(
        *_placed(names), f"CAST(row_number() OVER (PARTITION BY {sql_literal(table)} ORDER BY _o, _t) AS BIGINT) AS sample_rank",
        f"array({cells}) AS cells").selectExpr(*names, "sample_rank", "inline(cells)").select(
        *names, "column_name", "sample_rank", "value_text")


# ---------------------------------------------------------------- prompts

def column_lines(columns: DataFrame) -> DataFrame:
    """Per table: ``- NAME (TYPE)[: comment]`` lines in ordinal order, and the count.

    ``columns``: database_name, schema_name, table_name, column_name, data_type,
    current_description, ordinal_position."""
    line = F.concat(F.lit("- "), F.col("column_name"), F.lit(" ("), F.col("data_type"), F.lit(")"),
                    F.when(~is_blank(F.col("current_description")),
                           F.concat(F.lit(": "), F.col("current_description"))).otherwise(F.lit("")))
    return columns.groupBy(*OBJ_KEYS).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal_position", line.alias("l")))),
                                 lambda s: s["l"]), "\n").alias("columns_text"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name"))),
                                 lambda s: s["column_name"]), ", ").alias("column_list"),
        F.count(F.lit(1)).alias("n_columns"))


def table_prompts(objects: DataFrame, columns: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One prompt per object. ``objects``: database_name, schema_name, table_name,
    object_type; ``samples``: table keys + sample_data (optional)."""
    lines = column_lines(columns)
    df = objects.join(lines, OBJ_KEYS, "left")
    if samples is not None:
        df = df.join(samples, OBJ_KEYS, "left")
    else:
        df = df.withColumn("sample_data", F.lit(None).cast("string"))
    kind = F.coalesce(F.col("object_type"), F.lit("TABLE"))
    prompt = F.concat(
        F.lower(kind), F.lit(" "), F.col("table_name"), F.lit(" in "), F.col("database_name"), F.lit("."),
        F.col("schema_name"), F.lit("\nfields:\n"), F.coalesce(F.col("columns_text"), F.lit(NO_COLUMNS)),
        F.lit("\nexample rows:\n"), F.coalesce(F.col("sample_data"), F.lit(NO_SAMPLE)), F.lit("\n" + TABLE_ASK))
    keep = ["current_description"] if "current_description" in objects.columns else []
    return df.select(*OBJ_KEYS, kind.alias("object_type"), F.coalesce("n_columns", F.lit(0)).alias("n_columns"),
                     F.coalesce("column_list", F.lit("")).alias("column_list"), prompt.alias("prompt"),
                     *keep)


def column_prompts(columns: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """One prompt per column; ``samples``: object keys, column_name, sample_rank, value_text.

    Samples of one database and schema may leave those two keys out."""
    df = columns
    if samples is not None:
        keys = [*(k for k in OBJ_KEYS if k in samples.columns), "column_name"]
        txt = samples.groupBy(*keys).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_rank", "value_text"))),
                                     lambda s: F.coalesce(s["value_text"], F.lit("NULL"))), "\n")
            .alias("sample_data"))
        df = df.join(txt, keys, "left")
    else:
        df = df.withColumn("sample_data", F.lit(None).cast("string"))
    prompt = F.concat(
        F.lit("field "), F.col("column_name"), F.lit("\nof "), F.col("table_name"), F.lit("\nin "),
        F.col("database_name"), F.lit("."), F.col("schema_name"), F.lit("\ntype "), F.col("data_type"),
        F.lit("\nexample values:\n"), F.coalesce(F.col("sample_data"), F.lit(NO_SAMPLE)), F.lit("\n" + COLUMN_ASK))
    keep = ["current_description"] if "current_description" in columns.columns else []
    return df.select(*OBJ_KEYS, "column_name", "data_type", prompt.alias("prompt"), *keep)


# ---------------------------------------------------------------- completion

def template_table_description(prompts: DataFrame) -> Column:
    """Deterministic stand-in for a language model, written with Column functions."""
    label = F.when(F.col("object_type") == "VIEW", F.lit("View")).otherwise(F.lit("Table"))
    return F.concat(label, F.lit(" "), F.col("table_name"),
                    F.lit(" in "), F.col("database_name"), F.lit("."), F.col("schema_name"),
                    F.lit(" with "), F.col("n_columns").cast("string"), F.lit(" columns: "),
                    F.col("column_list"))


def template_column_description() -> Column:
    return F.concat(F.lit("Column "), F.col("column_name"), F.lit(" of "), F.col("table_name"),
                    F.lit(" ("), F.lower(F.col("data_type")), F.lit(")"))


def complete_with(prompts: DataFrame, completer: Callable[[pd.Series], pd.Series],
                  prompt_col: str = "prompt", out_col: str = "description",
                  batch_size: int = 64) -> DataFrame:
    """Run a Python completer over the prompts: per partition, Arrow batches cut into
    chunks of ``batch_size`` prompts (one completer call each -- e.g. one model request).

    A chunk that raises is retried item by item; a failing item gets a NULL description
    and its error text (the job goes on, as the reference continues after a failed item)."""
    schema = T.StructType(prompts.schema.fields + [
        T.StructField(out_col, T.StringType()), T.StructField("error", T.StringType())])

    def complete_chunk(chunk: pd.Series) -> tuple[list, list]:
        try:
            out = list(pd.Series(completer(chunk)).astype(object))
            if len(out) != len(chunk):
                raise ValueError(f"completer returned {len(out)} texts for {len(chunk)} prompts")
            return out, [None] * len(chunk)
        except Exception:
            vals, errs = [], []
            for p in chunk:
                try:
                    vals.append(pd.Series(completer(pd.Series([p]))).iloc[0])
                    errs.append(None)
                except Exception as e:  # isolate the failing item
                    vals.append(None)
                    errs.append(str(e))
            return vals, errs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vals, errs = [], []
            for k in range(0, len(pdf), batch_size):
                v, e = complete_chunk(pdf[prompt_col].iloc[k:k + batch_size].reset_index(drop=True))
                vals += v
                errs += e
            yield pdf.assign(**{out_col: pd.Series(vals, index=pdf.index, dtype=object),
                                "error": pd.Series(errs, index=pdf.index, dtype=object)})

    return prompts.mapInPandas(run, schema)


def clean(df: DataFrame, col: str = "description") -> DataFrame:
    return df.withColumn(col, clean_generated(F.col(col)))


def length_violations(suggestions: DataFrame) -> DataFrame:
    """Suggestions longer than asked for (150 for tables/views, 100 for columns)."""
    limit = F.when(F.col("kind") == "COLUMN", F.lit(COLUMN_LIMIT)).otherwise(F.lit(TABLE_LIMIT))
    n = F.char_length("description")
    return (suggestions.filter(n > limit)
            .withColumn("length", n.cast("long")).withColumn("limit", limit))


# ---------------------------------------------------------------- merge, selection

def merge_column_comments(current: DataFrame, new: DataFrame) -> DataFrame:
    """Column comments for a rebuilt object: a new comment (matched case-insensitively)
    wins when non-empty; a column with a new but empty entry gets none; otherwise the old
    comment is kept when non-blank.

    ``current``: table keys, column_name, current_description; ``new``: table keys,
    column_name, description."""
    n = new.select(*OBJ_KEYS, F.upper("column_name").alias("_u"), F.col("description").alias("_new"),
                   F.lit(True).alias("_has_new"))
    c = current.withColumn("_u", F.upper("column_name"))
    j = c.join(n, OBJ_KEYS + ["_u"], "left")
    old = F.col("current_description")
    merged = (F.when(F.col("_has_new"), F.when(F.col("_new") != "", F.col("_new")))
              .when(~is_blank(old), old))
    return j.select(*OBJ_KEYS, "column_name", merged.alias("comment"))


def resolve_selection(listing: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected (database_name, schema_name, object_name) resolved against the listing, in
    any case; the listing's spelling comes back."""
    keys = ["database_name", "schema_name", "object_name"]
    upper = [f"_{k}" for k in keys]
    wanted = selection.select(*[F.upper(k).alias(u) for k, u in zip(keys, upper)]).distinct()
    return (listing.withColumns({u: F.upper(k) for k, u in zip(keys, upper)})
            .join(wanted, upper, "left_semi").drop(*upper))


def unresolved_selection(listing: DataFrame, selection: DataFrame) -> DataFrame:
    """The selected names that the listing does not have, in any case."""
    keys = ["database_name", "schema_name", "object_name"]
    upper = [f"_{k}" for k in keys]
    known = listing.select(*[F.upper(k).alias(u) for k, u in zip(keys, upper)]).distinct()
    return (selection.withColumns({u: F.upper(k) for k, u in zip(keys, upper)})
            .join(known, upper, "left_anti").drop(*upper))


# ---------------------------------------------------------------- batch job

def validate_request(database: str, schema: str, tables, generation_type: str) -> str | None:
    """The batch job's four input rules; returns the error text or None."""
    if not database:
        return "no database given"
    if not schema:
        return "no schema given"
    if tables is not None and len(tables) == 0:
        return "the list of tables has no entry"
    if (generation_type or "").upper() not in GENERATION_TYPES:
        return f"generation type is none of {', '.join(GENERATION_TYPES)}"
    return None


SUGGESTION_COLUMNS = ["kind", "database_name", "schema_name", "table_name", "column_name",
                      "before_description", "description", "error"]


def generate_descriptions(objects: DataFrame, columns: DataFrame, generation_type: str = "TABLE",
                          table_samples: DataFrame | None = None,
                          column_samples_df: DataFrame | None = None,
                          completer: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Suggestions for every object (TABLE), every column (COLUMN) or both.

    ``objects``: table keys, object_type, current_description; ``columns``: the column
    listing. With no ``completer`` the template (JVM-side) writes the text."""
    gt = generation_type.upper()
    if gt not in GENERATION_TYPES:
        raise ValueError(validate_request("x", "x", None, gt))
    parts = []
    # the current description rides along with each prompt (no join back to the listing)
    if gt in ("TABLE", "BOTH"):
        tp = table_prompts(objects.select(*OBJ_KEYS, "object_type", "current_description"),
                           columns, table_samples)
        tp = (complete_with(tp, completer) if completer else
              tp.withColumn("description", template_table_description(tp))
                .withColumn("error", F.lit(None).cast("string")))
        parts.append(clean(tp).select(
            F.col("object_type").alias("kind"), *OBJ_KEYS, F.lit(None).cast("string").alias("column_name"),
            F.col("current_description").alias("before_description"), "description", "error"))
    if gt in ("COLUMN", "BOTH"):
        cp = column_prompts(columns, column_samples_df)
        cp = (complete_with(cp, completer) if completer else
              cp.withColumn("description", template_column_description())
                .withColumn("error", F.lit(None).cast("string")))
        parts.append(clean(cp).select(
            F.lit("COLUMN").alias("kind"), *OBJ_KEYS, "column_name",
            F.col("current_description").alias("before_description"), "description", "error"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def run_summary(suggestions: DataFrame) -> DataFrame:
    """Objects processed, table/column descriptions generated, failures (selected names that
    do not exist are failures, and no objects), and a message."""
    ok = F.col("description").isNotNull() & (F.col("description") != "")
    is_col = F.col("kind") == "COLUMN"
    s = suggestions.agg(
        F.count_distinct(F.when(F.col("kind") != "MISSING", F.struct(*OBJ_KEYS))).alias("tables_processed"),
        F.count_if(~is_col & ok).alias("table_descriptions"),
        F.count_if(is_col & ok).alias("column_descriptions"),
        F.count_if(~ok).alias("failed"))
    return s.withColumn("message", F.format_string(
        "%d objects: %d table texts, %d column texts, %d failures",
        "tables_processed", "table_descriptions", "column_descriptions", "failed"))


def suggestion_changes(suggestions: DataFrame) -> DataFrame:
    """Successful suggestions -> description changes for the audit log: tables are logged
    as TABLE, views as VIEW, columns as COLUMN named ``table.column``; BEFORE is the
    description the object had."""
    kind = F.col("kind")
    otype = (F.when(kind == "COLUMN", F.lit("COLUMN")).when(kind == "VIEW", F.lit("VIEW"))
             .otherwise(F.lit("TABLE")))
    name = F.when(kind == "COLUMN", F.concat_ws(".", "table_name", "column_name")).otherwise(F.col("table_name"))
    ok = F.col("description").isNotNull() & (F.col("description") != "")
    return suggestions.filter(ok).select(
        "database_name", "schema_name", name.alias("object_name"), otype.alias("object_type"),
        "before_description", F.col("description").alias("after_description"))
