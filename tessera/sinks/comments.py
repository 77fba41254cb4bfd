"""Apply descriptions to the Spark catalog (K5, K6).

Catalog DDL is a driver-side metadata operation, one statement per object; the rows come
from an already-small suggestions frame and are streamed with ``toLocalIterator`` (no
full collect). Every statement is isolated: a failure is reported and the rest go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _table_ident(table) -> str:
    """A dotted name, or its parts (which may hold dots)."""
    return ".".join(_ident(p) for p in (table.split(".") if isinstance(table, str) else table))


def _literal(text: str | None) -> str:
    return "'" + (text or "").replace("\\", "\\\\").replace("'", "\\'") + "'"


def table_comment_sql(table: str, text: str | None) -> str:
    return f"COMMENT ON TABLE {_table_ident(table)} IS {_literal(text)}"


def column_comment_sql(table: str, column: str, text: str | None) -> str:
    return f"ALTER TABLE {_table_ident(table)} ALTER COLUMN {_ident(column)} COMMENT {_literal(text)}"


def view_comment_sql(view: str, text: str | None) -> str:
    return f"ALTER VIEW {_table_ident(view)} SET TBLPROPERTIES ('comment' = {_literal(text)})"


@dataclass
class ApplyReport:
    succeeded: int = 0
    failed: list[tuple[str, str]] = field(default_factory=list)


def _run(spark: SparkSession, sql: str, report: ApplyReport) -> None:
    try:
        spark.sql(sql)
        report.succeeded += 1
    except Exception as e:  # keep going; the report says what failed
        report.failed.append((sql, str(e)))


def is_view(spark: SparkSession, table: str) -> bool:
    return str(_details(spark, table).get("Type", "")).upper() == "VIEW"


def _details(spark: SparkSession, table: str) -> dict[str, str]:
    """The detail section of a table's description; the column rows before it are left out,
    so a column may be called like a detail."""
    rows = [(r[0], r[1]) for r in spark.sql(f"DESCRIBE TABLE EXTENDED {_table_ident(table)}").collect()]
    names = [k for k, _ in rows]
    at = max((i for i, k in enumerate(names) if k.startswith("# Detailed Table")), default=-1)
    return dict(reversed(rows[at + 1:]))


def view_text(spark: SparkSession, view: str) -> str:
    """The stored SELECT of a view, from the catalog (no DDL text parsing)."""
    text = _details(spark, view).get("View Text")
    if text is None:
        raise ValueError(f"{view} has no view text")
    return text


# The properties in which the catalog keeps what a view was created under.
NAMESPACE_PARTS, NAMESPACE_PART = "view.catalogAndNamespace.numParts", "view.catalogAndNamespace.part.%d"
SETTING, INTERNAL, SCHEMA_MODE = "view.sqlConfig.", "view.", "view.schemaMode"


def _properties(spark: SparkSession, view) -> dict[str, str]:
    """All properties of a view of the session catalog, the catalog's own among them (SQL
    does not list those)."""
    state = spark._jsparkSession.sessionState()
    found = state.catalog().getTableMetadata(state.sqlParser().parseTableIdentifier(_table_ident(view))).properties().iterator()
    out = {}
    while found.hasNext():
        pair = found.next()
        out[pair._1()] = pair._2()
    return out


@contextmanager
def created_under(spark: SparkSession, properties: dict[str, str]) -> Iterator[None]:
    """The session as it was when a view was created: its text means the same tables there.
    Catalog, namespace and settings are put back afterwards, whatever happens."""
    parts = [properties[NAMESPACE_PART % i] for i in range(int(properties.get(NAMESPACE_PARTS, 0)))]
    settings = {k.removeprefix(SETTING): v for k, v in properties.items() if k.startswith(SETTING)}
    settings = {k: v for k, v in settings.items() if spark.conf.isModifiable(k)}
    catalog, namespace = spark.catalog.currentCatalog(), spark.catalog.currentDatabase()
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        if parts:
            spark.sql("USE " + _table_ident(tuple(parts)))
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
        spark.catalog.setCurrentCatalog(catalog)
        spark.sql(f"USE {_table_ident(namespace)}")


def recreate_view(spark: SparkSession, view: str, column_comments: dict[str, str | None],
                  view_comment: str | None = None, report: ApplyReport | None = None) -> ApplyReport:
    """Views take comments by re-creation. New comments match case-insensitively and win
    when non-empty; other columns keep a non-blank old comment. The view is created again
    under the catalog, namespace and settings it was created under, so that names in its
    text stay those of the same tables; its own properties and schema mode stay."""
    report = report or ApplyReport()
    text, properties = view_text(spark, view), _properties(spark, view)
    cols = spark.table(_table_ident(view)).schema.fields
    new = {k.upper(): v for k, v in column_comments.items()}
    defs = []
    for f in cols:
        old = (f.metadata or {}).get("comment")
        if f.name.upper() in new:
            c = new[f.name.upper()] or None
        else:
            c = old if old and old.strip() else None
        defs.append(_ident(f.name) + (f" COMMENT {_literal(c)}" if c else ""))
    details = _details(spark, view)
    if view_comment is None:
        view_comment = details.get("Comment")
    vc = f" COMMENT {_literal(view_comment)}" if view_comment else ""
    own = {k: v for k, v in properties.items() if not k.startswith(INTERNAL) and k not in ("comment", "transient_lastDdlTime")}
    kept = f" TBLPROPERTIES ({', '.join(f'{_literal(k)} = {_literal(v)}' for k, v in sorted(own.items()))})" if own else ""
    mode = properties.get(SCHEMA_MODE, "").replace("_", " ")
    mode = f" WITH SCHEMA {mode}" if mode else ""
    # the full name means the same in any current namespace
    place = [details.get(k) for k in ("Catalog", "Database", "Table")]
    name = _table_ident(tuple(p for p in place if p) if place[2] else view)
    with created_under(spark, properties):
        _run(spark, f"CREATE OR REPLACE VIEW {name} ({', '.join(defs)}){vc}{kept}{mode} AS {text}", report)
    return report


def apply_suggestions(spark: SparkSession, suggestions: DataFrame, name_col: str = "table_ident") -> ApplyReport:
    """Apply (``table_ident`` -- a dotted name or an array of its parts --, ``column_name`` or
    NULL, ``description``) rows: tables get
    COMMENT / ALTER COLUMN statements; a view with column comments is re-created once with
    all of them, a view with only a new description gets a property update. A NULL
    description (a failed completion) is reported as failed and changes nothing; so is a
    blank one, except that an empty text clears the comment of a view's column."""
    report = ApplyReport()
    view_cols: dict[str, dict[str, str | None]] = {}
    view_desc: dict[str, str | None] = {}
    kinds: dict[str, bool] = {}
    for r in suggestions.select(name_col, "column_name", "description").toLocalIterator():
        t, col, text = r[0] if isinstance(r[0], str) else tuple(r[0]), r[1], r[2]
        label = t if isinstance(t, str) else ".".join(t)
        if t not in kinds:
            try:
                kinds[t] = is_view(spark, t)
            except Exception as e:
                report.failed.append((label, str(e)))
                kinds[t] = False
                continue
        # a failed completion must not erase a comment; an empty text clears a view's column
        if text is None or not text.strip() and not (kinds[t] and col):
            report.failed.append((f"{label}.{col}" if col else label, "no description"))
            continue
        if kinds[t]:
            if col:
                view_cols.setdefault(t, {})[col] = text
            else:
                view_desc[t] = text
                view_cols.setdefault(t, {})
        elif col:
            _run(spark, column_comment_sql(t, col, text), report)
        else:
            _run(spark, table_comment_sql(t, text), report)
    for v, cols in view_cols.items():
        try:
            if not cols:            # description only: a property change, no re-creation
                _run(spark, view_comment_sql(v, view_desc.get(v)), report)
            else:
                recreate_view(spark, v, cols, view_desc.get(v), report)
        except Exception as e:
            report.failed.append((v, str(e)))
    return report
