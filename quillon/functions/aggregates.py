"""Aggregate heads, and how their outputs are named."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..expr import Expr, Symbol
from ..plans.relation import PlanError, Relation, named

#: head: (function of a column, name in fn(col))
AGGREGATES: dict[str, tuple[Callable[[Column], Column], str]] = {
    "Sum": (F.sum, "sum"),
    "Mean": (F.avg, "mean"),
    "Avg": (F.avg, "mean"),
    "Min": (F.min, "min"),
    "Max": (F.max, "max"),
    "Count": (F.count, "count"),
}
ROWS = "count_all"


def is_aggregate(x: Any, extra: dict[str, Any] | None = None) -> bool:
    heads = AGGREGATES.keys() | (extra or {}).keys()
    return isinstance(x, Expr) and (str(x.head) in heads or str(x.head) == "CountAll") or isinstance(x, Symbol) and str(x) in ("Count", "CountAll")


def aggregate(x: Any, rel: Relation, value: Callable[[Any], Column], catalog_names: bool, extra: dict[str, Callable[[Column], Column]] | None = None) -> tuple[str, Column, str | None]:
    """(output name, column, input column or None). catalog_names: fn(col) rather than the input's own name."""
    args = x.arguments() if isinstance(x, Expr) else []
    head = str(x.head) if isinstance(x, Expr) else str(x)
    if head == "CountAll" or (head == "Count" and (not args or (isinstance(args[0], str) and str(args[0]) == "*"))):
        return (f"{ROWS}()" if head == "CountAll" or catalog_names else "Count"), F.count(F.lit(1)), None
    if len(args) != 1:
        raise PlanError(f"{head} takes one column")
    if extra and head in extra:
        make, short = extra[head], head.lower()
    else:
        make, short = AGGREGATES[head]
    if isinstance(args[0], Symbol):
        name = rel.resolve(args[0])
        return (f"{short}({name})" if catalog_names else name), make(named(name)), name
    return (f"{short}({args[0]!r})" if catalog_names else repr(args[0])), make(value(args[0])), None
