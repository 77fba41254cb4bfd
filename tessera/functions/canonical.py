"""One text for every nested value: equal values have equal texts, different ones differ."""

from __future__ import annotations

from pyspark.sql import types as T

#: Microseconds stay, null fields too.
JSON_OPTIONS = ("map('ignoreNullFields', 'false', 'timestampFormat', 'yyyy-MM-dd HH:mm:ss.SSSSSSXXX', "
                "'timestampNTZFormat', 'yyyy-MM-dd HH:mm:ss.SSSSSS')")


def is_nested(dtype: T.DataType) -> bool:
    """Whether values of the type are no plain group keys, or wide ones."""
    return isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.VariantType))


def _needs_order(dtype: T.DataType) -> bool:
    """Whether some value of the type can be spelled in two ways: maps have no order, and 0.0
    equals -0.0."""
    if isinstance(dtype, T.ArrayType):
        return _needs_order(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_needs_order(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.MapType, T.FloatType, T.DoubleType))


def _ordered(dtype: T.DataType, value: str, depth: int = 0) -> str:
    """SQL for ``value`` with maps as entries in key order and -0.0 as 0.0, at any depth."""
    if not _needs_order(dtype):
        return value
    x = f"x{depth}"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return f"({value} + CAST(0 AS {dtype.simpleString()}))"
    if isinstance(dtype, T.ArrayType):
        return f"transform({value}, {x} -> {_ordered(dtype.elementType, x, depth + 1)})"
    if isinstance(dtype, T.StructType):
        fields = ", ".join("'f%d', %s" % (i, _ordered(f.dataType, "%s.`%s`" % (value, f.name.replace("`", "``")), depth))
                           for i, f in enumerate(dtype.fields))
        return f"CASE WHEN {value} IS NOT NULL THEN named_struct({fields}) END"
    key = _ordered(dtype.keyType, f"{x}.key", depth + 1)
    return (f"array_sort(transform(map_entries({value}), {x} -> named_struct('key', {key}, "
            f"'value', {canonical_text(dtype.valueType, f'{x}.value', depth + 1)})))")


def canonical_text(dtype: T.DataType, value: str, depth: int = 0) -> str:
    """SQL for the text of ``value`` (an expression): JSON in field order for nested types,
    the plain cast for others; null stays null."""
    if isinstance(dtype, T.VariantType):
        return f"to_json({value})"
    if not is_nested(dtype):
        return f"CAST({_ordered(dtype, value, depth)} AS STRING)"
    return f"to_json({_ordered(dtype, value, depth)}, {JSON_OPTIONS})"
