"""Values inside structs, arrays and maps of any depth: expressions made from the schema."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.functions.text import redact_line


def map_leaves(value: Column, kind: T.DataType, leaf: Callable[[Column, T.DataType], Column]) -> Column:
    """``value`` with each leaf (what is no struct, array or map) replaced by ``leaf(it, its type)``; keys of maps stay.

    Nulls of structs, arrays and maps stay null. The expression runs inside Spark, once for each value of an array.
    """
    if isinstance(kind, T.StructType):
        fields = [map_leaves(value.getField(f.name), f.dataType, leaf).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: map_leaves(x, kind.elementType, leaf))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: map_leaves(x, kind.valueType, leaf))
    return leaf(value, kind)


def map_texts(value: Column, kind: T.DataType, change: Callable[[Column], Column]) -> Column:
    """``value`` with each text inside it changed; other leaves stay."""
    return map_leaves(value, kind, lambda x, t: change(x) if isinstance(t, T.StringType) else x)


def redact_nested(rows: DataFrame, columns: Iterable[str], known: Column | None = None) -> DataFrame:
    """``rows`` with names and contacts redacted in every text inside the ``columns``; ``known`` is as of ``redact_names``."""
    wanted = set(columns)
    column = lambda name: rows["`" + name.replace("`", "``") + "`"]
    return rows.select(*[(map_texts(column(f.name), f.dataType, lambda x: redact_line(x, known)) if f.name in wanted else column(f.name)).alias(f.name) for f in rows.schema.fields])
