"""Text helpers as Column expressions: flags, cleaning, search, schedules, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# whitespace as Python's str.strip() sees it for ASCII text (space, \t \n \v \f \r)
WS_CLASS = r"[ \t\n\x0B\f\r]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(c) -> Column:
    return F.regexp_replace(_c(c), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def is_blank(c) -> Column:
    """NULL, '' or only whitespace."""
    c = _c(c)
    return c.isNull() | ~c.rlike(r"[^ \t\n\x0B\f\r]")


def object_description(c) -> Column:
    """Objects listing: '' -> NULL (blank text is kept as is)."""
    return F.nullif(_c(c), F.lit(""))


def column_description(c) -> Column:
    """Column listing: '', 'null', 'NULL' -> NULL."""
    c = _c(c)
    return F.when(c.isin("", "null", "NULL"), F.lit(None).cast("string")).otherwise(c)


def has_description(c) -> Column:
    """'Yes' when the text has a non-whitespace character, else 'No'."""
    return F.when(is_blank(c), F.lit("No")).otherwise(F.lit("Yes"))


def clean_generated(c) -> Column:
    """Trim, then drop one pair of surrounding double quotes (only when length >= 2)."""
    return _unquote(strip_ws(c))


def _unquote(t: Column) -> Column:
    n = F.char_length(t)
    return (F.when((n >= 2) & t.startswith('"') & t.endswith('"'), F.substring(t, F.lit(2), n - 2))
            .otherwise(t))


def search_match(c, pattern: str, literal: bool = False) -> Column:
    """Case-insensitive name search; a regex by default (NULL never matches)."""
    import re
    p = re.escape(pattern) if literal else pattern
    return F.coalesce(_c(c).rlike("(?i)" + p), F.lit(False))


# Schedule choices and the expression/label formats of each kind.
PERIODIC_MINUTES = (5, 15, 30, 60)
PERIODIC_HOURS = (1, 2, 4, 6, 8, 12, 24)
DAILY_MINUTES = (0, 15, 30, 45)
ON_CHANGES_EXPRESSION = "TRIGGER_ON_CHANGES"
ON_CHANGES_LABEL = "When data changes"


def schedule_expression(kind, n, hour=None, minute=None) -> Column:
    """struct(schedule_expression, description) for kind 'minutes'/'hours'/'daily'/'changes'."""
    kind, n = _c(kind), _c(n)
    hour = _c(hour) if hour is not None else F.lit(None)
    minute = _c(minute) if minute is not None else F.lit(None)
    expr = (F.when(kind == "minutes", F.format_string("%d MINUTE", n))
            .when(kind == "hours", F.format_string("USING CRON 0 */%d * * * UTC", n))
            .when(kind == "daily", F.format_string("USING CRON %d %d * * * UTC", minute, hour))
            .otherwise(F.lit(ON_CHANGES_EXPRESSION)))
    label = (F.when(kind == "minutes", F.format_string("Every %d minutes", n))
             .when(kind == "hours", F.format_string("Every %d hours", n))
             .when(kind == "daily", F.format_string("Daily at %02d:%02d UTC", hour, minute))
             .otherwise(F.lit(ON_CHANGES_LABEL)))
    return F.struct(expr.alias("schedule_expression"), label.alias("description"))


def parse_schedule(expr) -> Column:
    """Schedule expression -> struct(kind, every, hour, minute): the inverse of
    :func:`schedule_expression` ('minutes'/'hours' carry ``every``; 'daily' the time)."""
    e = _c(expr)
    mins = F.regexp_extract(e, r"^(\d+) MINUTE$", 1)
    hours = F.regexp_extract(e, r"^USING CRON 0 \*/(\d+) \* \* \* UTC$", 1)
    daily = r"^USING CRON (\d+) (\d+) \* \* \* UTC$"
    dm, dh = F.regexp_extract(e, daily, 1), F.regexp_extract(e, daily, 2)
    kind = (F.when(mins != "", "minutes").when(hours != "", "hours").when(dm != "", "daily")
            .when(e == ON_CHANGES_EXPRESSION, "changes"))
    every = F.when(mins != "", mins.cast("int")).when(hours != "", hours.cast("int"))
    return F.struct(kind.alias("kind"), every.alias("every"),
                    F.when(dh != "", dh.cast("int")).alias("hour"),
                    F.when(dm != "", dm.cast("int")).alias("minute"))


def metric_action_sentence(action, metric, column) -> Column:
    """'Added X data quality metric[ to column C]' / '<ACTION> X ...[ on column C]'."""
    action, metric, column = _c(action), _c(metric), _c(column)
    has_col = column.isNotNull() & (column != "")
    # fixed values: stored sentences must read alike to be matched and filtered
    added = F.concat(F.lit("Added "), metric, F.lit(" data quality metric"),
                     F.when(has_col, F.concat(F.lit(" to column "), column)).otherwise(F.lit("")))
    other = F.concat(action, F.lit(" "), metric, F.lit(" data quality metric"),
                     F.when(has_col, F.concat(F.lit(" on column "), column)).otherwise(F.lit("")))
    return F.when(action == "ADDED", added).otherwise(other)


def metric_object_type(metric, column) -> Column:
    """``DMF_<metric>`` plus ``_COLUMN`` for column-level changes."""
    column = _c(column)
    # fixed values: the prefix and suffix of stored object types
    return F.concat(F.lit("DMF_"), _c(metric),
                    F.when(column.isNotNull() & (column != ""), F.lit("_COLUMN")).otherwise(F.lit("")))


def thousands(c) -> Column:
    """1234567 -> '1,234,567'."""
    return F.format_number(_c(c).cast("double"), 0)


def percent_1(c) -> Column:
    """12.345 -> '12.3%'."""
    return F.format_string("%.1f%%", _c(c).cast("double"))
