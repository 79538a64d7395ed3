"""Scalar heads: as columns inside plans, and on literals on the driver."""

from __future__ import annotations

import datetime
import functools
import operator
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expr import Expr, Float32, Int8, Int32, Int64, Span, Symbol, atom
from ..plans.relation import PlanError, Relation, named

DATE = re.compile(r"\d{4}-\d{2}-\d{2}$")
COMPARISONS = frozenset(("Equal", "Equals", "NotEqual", "Less", "LessEqual", "Greater", "GreaterEqual", "Between"))


def _fold(f: Callable[[Any, Any], Any]) -> Callable[..., Any]:
    return lambda *xs: functools.reduce(f, xs)


#: head: (least, most arguments, columns to column)
SCALARS: dict[str, tuple[int, int | None, Callable[..., Column]]] = {
    "Plus": (1, None, _fold(operator.add)),
    "Times": (1, None, _fold(operator.mul)),
    "Minus": (2, 2, operator.sub),
    "-": (2, 2, operator.sub),
    "Add": (2, 2, operator.add),
    "Subtract": (2, 2, operator.sub),
    "Multiply": (2, None, _fold(operator.mul)),
    "Divide": (2, 2, operator.truediv),
    "Equal": (2, 2, operator.eq),
    "Equals": (2, 2, operator.eq),
    "NotEqual": (2, 2, operator.ne),
    "Less": (2, 2, operator.lt),
    "LessEqual": (2, 2, operator.le),
    "Greater": (2, 2, operator.gt),
    "GreaterEqual": (2, 2, operator.ge),
    "Between": (3, 3, lambda v, lo, hi: v.between(lo, hi)),
    "And": (1, None, _fold(operator.and_)),
    "Or": (1, None, _fold(operator.or_)),
    "Not": (1, 1, operator.invert),
    "Like": (2, 2, lambda c, p: F.like(c, p)),
    "StringContainsQ": (2, 2, lambda c, s: c.contains(s)),
    "StringContains": (2, 2, lambda c, s: c.contains(s)),
    "StringJoin": (1, None, lambda *xs: F.concat(*xs)),
    "IfElse": (3, 3, lambda c, a, b: F.when(c, a).otherwise(b)),
    "If": (3, 3, lambda c, a, b: F.when(c, a).otherwise(b)),
    "IsValid": (1, 1, lambda c: c.isNotNull()),
    "Int": (1, 1, lambda c: c.cast("bigint")),
    "Bool": (1, 1, lambda c: c.cast("boolean")),
    "Date": (1, 1, lambda c: c.cast("date")),
    "DateObject": (1, 1, lambda c: c.cast("date")),
    "Timestamp": (1, 1, lambda c: c.cast("timestamp")),
    "Year": (1, 1, lambda c: F.year(c).cast("bigint")),
    "Month": (1, 1, lambda c: F.month(c).cast("bigint")),
    "Day": (1, 1, lambda c: F.day(c).cast("bigint")),
    # further compute heads that a plan may use: an explicit list, as the open-ended one can't be checked
    "Abs": (1, 1, F.abs), "Negate": (1, 1, operator.neg), "Sqrt": (1, 1, F.sqrt), "Power": (2, 2, F.pow), "Exp": (1, 1, F.exp), "Ln": (1, 1, F.ln), "Log10": (1, 1, F.log10),
    "Floor": (1, 1, F.floor), "Ceil": (1, 1, F.ceil), "Round": (1, 2, lambda c, n=None: F.round(c) if n is None else F.round(c, n)), "Sign": (1, 1, F.signum),
    "Utf8Lower": (1, 1, F.lower), "Utf8Upper": (1, 1, F.upper), "Utf8Length": (1, 1, lambda c: F.length(c).cast("bigint")), "StartsWith": (2, 2, lambda c, s: c.startswith(s)), "EndsWith": (2, 2, lambda c, s: c.endswith(s)),
    "Coalesce": (1, None, lambda *xs: F.coalesce(*xs)), "IsNull": (1, 1, lambda c: c.isNull()), "Hour": (1, 1, lambda c: F.hour(c).cast("bigint")), "Minute": (1, 1, lambda c: F.minute(c).cast("bigint")), "Second": (1, 1, lambda c: F.second(c).cast("bigint")), "Quarter": (1, 1, lambda c: F.quarter(c).cast("bigint")),
    # text
    "Utf8Trim": (1, 1, F.trim), "Utf8Ltrim": (1, 1, F.ltrim), "Utf8Rtrim": (1, 1, F.rtrim), "Utf8Reverse": (1, 1, F.reverse), "Utf8Capitalize": (1, 1, F.initcap),
    "Replace": (3, 3, F.replace), "Substring": (3, 3, lambda c, start, n: F.substr(c, start + F.lit(1), n)), "FindSubstring": (2, 2, lambda c, s: (F.instr(c, s) - 1).cast("bigint")), "Repeat": (2, 2, lambda c, n: F.repeat(c, n.cast("int"))),
    "LPad": (3, 3, lambda c, n, p: F.call_function("lpad", c, n.cast("int"), p)), "RPad": (3, 3, lambda c, n, p: F.call_function("rpad", c, n.cast("int"), p)), "MatchRegex": (2, 2, F.regexp_like), "ReplaceRegex": (3, 3, F.regexp_replace),
    # numbers; the sign of a modulus is that of its first argument
    "Modulo": (2, 2, operator.mod), "IntegerDivide": (2, 2, lambda a, b: F.call_function("div", a, b)), "Trunc": (1, 1, lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))), "RoundHalfToEven": (1, 2, lambda c, n=None: F.bround(c)),
    "Log2": (1, 1, F.log2), "Log1p": (1, 1, F.log1p), "Sin": (1, 1, F.sin), "Cos": (1, 1, F.cos), "Tan": (1, 1, F.tan), "Asin": (1, 1, F.asin), "Acos": (1, 1, F.acos), "Atan": (1, 1, F.atan), "Atan2": (2, 2, F.atan2), "IsNan": (1, 1, F.isnan),
    "BitAnd": (2, 2, lambda a, b: a.bitwiseAND(b)), "BitOr": (2, 2, lambda a, b: a.bitwiseOR(b)), "BitXor": (2, 2, lambda a, b: a.bitwiseXOR(b)), "BitNot": (1, 1, F.bitwise_not),
    "MinElementWise": (2, None, F.least), "MaxElementWise": (2, None, F.greatest), "Xor": (2, 2, lambda a, b: a != b), "IsIn": (2, None, lambda c, *xs: c.isin(*xs)), "DayOfWeek": (1, 1, lambda c: F.weekday(c).cast("bigint")), "DayOfYear": (1, 1, lambda c: F.dayofyear(c).cast("bigint")),
    "DaysBetween": (2, 2, lambda a, b: F.date_diff(b, a).cast("bigint")), "AddDays": (2, 2, lambda d, n: F.date_add(d, n.cast("int"))),
}


def literal(value: Any) -> Column:
    kinds = {Int8: T.ByteType(), Int32: T.IntegerType(), Int64: T.LongType(), Float32: T.FloatType()}
    if type(value) in kinds:
        return F.lit(float(value) if isinstance(value, float) else int(value)).cast(kinds[type(value)])
    return F.lit(str(value) if isinstance(value, str) else value)


def column(x: Any, rel: Relation, scalars: dict[str, Callable[..., Column]] | None = None, resolve: Callable[[Symbol], Column | None] | None = None, foreign: Callable[[Expr], Column | None] | None = None) -> Column:
    """An expression over the relation's columns. A symbol that is no column, spelt exactly so, is a string.

    scalars: heads that a session has registered; resolve: another way to look symbols up; foreign: what to make of heads that aren't scalar.
    """
    sub = lambda y: column(y, rel, scalars, resolve, foreign)
    if isinstance(x, Symbol):
        if resolve is not None and (found := resolve(x)) is not None:
            return found
        return named(str(x)) if resolve is None and str(x) in rel.columns else F.lit(str(x))
    if isinstance(x, Span):
        raise PlanError("a span can't stand for one value")
    if not isinstance(x, Expr):
        return literal(x)
    head, args = str(x.head), x.arguments()
    if head == "Function" and len(args) == 1:
        return sub(args[0])
    if scalars and head in scalars:
        return scalars[head](*map(sub, args))
    if head not in SCALARS:
        if foreign is not None and (found := foreign(x)) is not None:
            return found
        raise PlanError(f"{head} is no function of values")
    least, most, make = SCALARS[head]
    if len(args) < least or (most is not None and len(args) > most):
        raise PlanError(f"{head} takes {least if least == most else f'{least} or more' if most is None else f'{least} to {most}'} arguments, not {len(args)}")
    cols = [sub(a) for a in args]
    if head in ("Round", "RoundHalfToEven") and len(args) == 2:
        return (F.round if head == "Round" else F.bround)(cols[0], int(args[1]))
    if head in COMPARISONS:
        # a bare YYYY-MM-DD on the right is a date where the left is one
        for i, a in enumerate(args[1:], 1):
            if isinstance(a, str) and not isinstance(a, Symbol) and DATE.match(a) and temporal(args[0], rel, cols[0]):
                cols[i] = F.lit(a).cast("date")
    return make(*cols)


def temporal(x: Any, rel: Relation, c: Column) -> bool:
    """Is the expression a date or a time? Decided by its type over the relation, so a string column is never cast."""
    if isinstance(x, Expr) and str(x.head) in ("Date", "DateObject", "Timestamp"):
        return True
    try:
        kind = rel.df.select(c.alias("x")).schema[0].dataType
    except Exception:  # noqa: BLE001 - a column of a relation that isn't joined yet
        return False
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


# -- on the driver ---------------------------------------------------------------------------------------------------
WIDTH = [bool, Int8, Int32, Int64, Float32, float]


def _typed(f: Callable[..., Any]) -> Callable[..., Any]:
    """Arithmetic that keeps the operands' type, the widest of them if they differ."""

    def run(*xs: Any) -> Any:
        if any(type(x) not in WIDTH[1:] for x in xs):
            return NotImplemented
        kind = max((type(x) for x in xs), key=WIDTH.index)
        return atom(functools.reduce(f, [int(x) if issubclass(kind, int) else float(x) for x in xs]), kind)

    return run


def _compared(f: Callable[[Any, Any], bool]) -> Callable[..., Any]:
    def run(*xs: Any) -> Any:
        if len(xs) != 2 or any(isinstance(x, (Expr, Symbol)) for x in xs) or isinstance(xs[0], str) != isinstance(xs[1], str):
            return NotImplemented
        return bool(f(*(str(x) if isinstance(x, str) else float(x) if isinstance(x, float) else int(x) for x in xs)))

    return run


def _logic(f: Callable[..., bool]) -> Callable[..., Any]:
    return lambda *xs: f(xs) if xs and all(isinstance(x, bool) for x in xs) else NotImplemented


def _divide(*xs: Any) -> Any:
    return float(xs[0]) / float(xs[1]) if len(xs) == 2 and all(type(x) in WIDTH[1:] for x in xs) else NotImplemented


#: Each gives NotImplemented where its arguments aren't plain values, and the expression then stays as it is.
DRIVER: dict[str, Callable[..., Any]] = {
    **dict.fromkeys(("Plus", "Add"), _typed(operator.add)), **dict.fromkeys(("Times", "Multiply"), _typed(operator.mul)), **dict.fromkeys(("Minus", "Subtract", "-"), _typed(operator.sub)), "Divide": _divide,
    **dict.fromkeys(("Equal", "Equals"), _compared(operator.eq)), "NotEqual": _compared(operator.ne), "Less": _compared(operator.lt), "LessEqual": _compared(operator.le), "Greater": _compared(operator.gt), "GreaterEqual": _compared(operator.ge),
    "And": _logic(all), "Or": _logic(any), "Not": lambda *xs: not xs[0] if len(xs) == 1 and isinstance(xs[0], bool) else NotImplemented,
    "StringJoin": lambda *xs: "".join(xs) if xs and all(isinstance(x, str) and not isinstance(x, Symbol) for x in xs) else NotImplemented,
    "StringContainsQ": lambda *xs: xs[1] in xs[0] if len(xs) == 2 and all(isinstance(x, str) and not isinstance(x, Symbol) for x in xs) else NotImplemented,
    "Symbol": lambda *xs: Symbol(xs[0]) if len(xs) == 1 and isinstance(xs[0], str) else NotImplemented,
}


def on_driver(head: str, args: list[Any]) -> Any:
    """The value of a scalar head on literals, or NotImplemented."""
    return DRIVER[head](*args) if head in DRIVER else NotImplemented


def date_value(x: Any) -> datetime.date | None:
    """The date that a literal such as (DateObject "1998-01-24") stands for."""
    if isinstance(x, Expr) and str(x.head) in ("DateObject", "Date") and len(x.args) == 1 and isinstance(x.args[0], str) and not isinstance(x.args[0], Symbol):
        return datetime.date.fromisoformat(x.args[0][:10])
    return None
