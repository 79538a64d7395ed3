"""Tables given in the expression, and results as expressions."""

from __future__ import annotations

import datetime
import decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..expr import Expr, Float32, Int8, Int32, Int64, Span, Symbol
from ..functions.scalars import date_value
from ..plans.relation import PlanError, Relation, named

NULL = Symbol("NULL")


def table_columns(x: Expr) -> list[tuple[str, list[Any], str]]:
    """(name, values, shape) of each column: S1 (c v …), S2 (c (List v …)), S3 (Column c (List v …))."""
    out = []
    for c in x.args:
        if not isinstance(c, Expr):
            raise PlanError(f"a table has columns, not {c!r}")
        args = list(c.args)
        if str(c.head) == "Column" and len(args) == 2 and isinstance(args[1], Expr) and str(args[1].head) == "List":
            out.append((str(args[0]), args[1].arguments(), "S3"))
        elif len(args) == 1 and isinstance(args[0], Expr) and str(args[0].head) == "List":
            out.append((str(c.head), args[0].arguments(), "S2"))
        else:
            out.append((str(c.head), c.arguments(), "S1"))
    return out


def interpolated(values: list[Any]) -> list[Any]:
    """(Interpolate x) cells become the mean of the nearest values on both sides; null where one is missing."""
    if not any(_is_gap(v) for v in values):
        return values
    known = [None if _is_gap(v) or _is_null(v) else v for v in values]
    out = list(values)
    for i, v in enumerate(values):
        if _is_gap(v):
            before = next((k for k in reversed(known[:i]) if k is not None), None)
            after = next((k for k in known[i + 1 :] if k is not None), None)
            if before is None or after is None:
                out[i] = NULL
            elif isinstance(before, int) and isinstance(after, int) and (before + after) % 2 == 0:
                out[i] = Int64((before + after) // 2)
            else:
                out[i] = (before + after) / 2
    return out


def _is_gap(v: Any) -> bool:
    return isinstance(v, Expr) and str(v.head) == "Interpolate"


def _is_null(v: Any) -> bool:
    return v is None or isinstance(v, Symbol)


def typed(name: str, values: list[Any]) -> tuple[T.DataType, list[Any], bool]:
    """(type, Python values, holds symbols). The first value that is no symbol decides; symbols are then nulls. NULL is null everywhere."""
    values = interpolated(values)
    cells = [d if (d := date_value(v)) is not None else v for v in values]
    first = next((v for v in cells if not _is_null(v)), None)
    if first is None:
        if any(isinstance(v, Symbol) and v != NULL for v in cells):
            return T.StringType(), [None if v is None or v == NULL else str(v) for v in cells], True
        return T.StringType(), [None] * len(cells), False
    for kinds, spark in (((bool,), T.BooleanType()), ((datetime.date,), T.DateType()), ((str,), T.StringType())):
        if isinstance(first, kinds):
            bad = next((v for v in cells if not _is_null(v) and not isinstance(v, kinds)), None)
            if bad is not None:
                raise PlanError(f"column {name} mixes {first!r} and {bad!r}")
            return spark, [None if _is_null(v) else str(v) if isinstance(v, str) else v for v in cells], False
    if isinstance(first, (int, float)):
        bad = next((v for v in cells if not _is_null(v) and (isinstance(v, bool) or not isinstance(v, (int, float)))), None)
        if bad is not None:
            raise PlanError(f"column {name} mixes {first!r} and {bad!r}")
        if any(isinstance(v, float) for v in cells if not _is_null(v)):
            return T.DoubleType(), [None if _is_null(v) else float(v) for v in cells], False
        return T.LongType(), [None if _is_null(v) else int(v) for v in cells], False
    raise PlanError(f"column {name} holds {first!r}")


def inline(spark: SparkSession, columns: list[tuple[str, list[Any]]]) -> Relation:
    """A driver-local table; integers are 64-bit, floats double."""
    lengths = {len(v) for _, v in columns}
    if len(lengths) > 1:
        raise PlanError(f"columns differ in length: {sorted(lengths)}")
    names = [n for n, _ in columns]
    if len(set(names)) != len(names):
        raise PlanError("a table names a column twice")
    kinds = [typed(n, v) for n, v in columns]
    schema = T.StructType([T.StructField(n, k) for n, (k, _, _) in zip(names, kinds)])
    rows = list(zip(*[v for _, v, _ in kinds])) if columns else []
    df = spark.createDataFrame(rows, schema)
    return Relation(df, natural=True, symbols=frozenset(n for n, (_, _, s) in zip(names, kinds) if s))


def collected(rel: Relation, cap: int) -> list[tuple]:
    """The rows in the table's order. More than `cap` are an error, never a part of them."""
    df = rel.df.orderBy(*rel.sort_columns()) if rel.order else rel.df
    rows = df.select(*map(named, rel.columns)).limit(cap + 1).collect() if rel.columns else []
    if len(rows) > cap:
        raise PlanError(f"the result has more than {cap} rows; use ToStatus, a Slice or a DataFrame")
    return [tuple(r) for r in rows]


def cell(value: Any, kind: T.DataType, symbol: bool) -> Any:
    if value is None:
        return NULL
    if isinstance(kind, T.BooleanType):
        return bool(value)
    if isinstance(kind, T.LongType):
        return Int64(value)
    if isinstance(kind, T.IntegerType):
        return Int32(value)
    if isinstance(kind, T.ByteType):
        return Int8(value)
    if isinstance(kind, T.FloatType):
        return Float32(value)
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.StringType):
        return Symbol(value) if symbol else str(value)
    if isinstance(kind, T.DateType):
        return Expr("DateObject", value.isoformat())
    if isinstance(value, decimal.Decimal):
        return Expr("ArrowType", kind.simpleString(), str(value))
    return Expr("ArrowType", kind.simpleString(), value.isoformat(sep=" ") if isinstance(value, datetime.datetime) else str(value))


def table(rel: Relation, cap: int, shape: str = "S1") -> Expr:
    """The relation as a Table expression of the shape."""
    kinds = {f.name: f.dataType for f in rel.df.schema}
    rows = collected(rel, cap)
    out = []
    for i, c in enumerate(rel.columns):
        values = [cell(r[i], kinds[c], c in rel.symbols) for r in rows]
        out.append(Expr(c, *values) if shape == "S1" else Expr(c, Expr("List", *values)) if shape == "S2" else Expr("Column", Symbol(c), Expr("List", *values)))
    return Expr("Table", *out)


def spans(df: DataFrame) -> Expr:
    """A DataFrame's columns as a Table of spans, for small results."""
    pdf = df.toArrow()
    return Expr("Table", *[Expr(n, Expr("List", Span(pdf.column(n)))) for n in pdf.column_names])
