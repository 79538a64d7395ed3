"""Grouped and global aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.relation import PlanError, Relation, named
from .reshape import plain


def group(rel: Relation, keys: list[tuple[str, str]], aggregates: list[tuple[str, Column, str | None]]) -> Relation:
    """keys: (output name, column). Keys first, then aggregates; without keys one row; without aggregates the distinct keys. Null is a key like any other."""
    rel = plain(rel)
    names = [n for n, _ in keys] + [n for n, _, _ in aggregates]
    if len(set(names)) != len(names):
        raise PlanError(f"a column is named twice: {', '.join(sorted({n for n in names if names.count(n) > 1}))}")
    symbols = frozenset(n for n, c in keys if c in rel.symbols)
    by = [named(c).alias(n) for n, c in keys]
    if not aggregates:
        return Relation(rel.df.select(*by).distinct(), symbols=symbols)
    return Relation(rel.df.groupBy(*by).agg(*[c.alias(n) for n, c, _ in aggregates]), symbols=symbols)


def group_constant(rel: Relation, key: Column, name: str, aggregates: list[tuple[str, Column, str | None]]) -> Relation:
    """One group under a constant key; the aggregates come first, as that form has it. No rows give no group."""
    rel = plain(rel)
    counted = rel.df.agg(*[c.alias(n) for n, c, _ in aggregates], F.count(F.lit(1)).alias("__rows"))
    return Relation(counted.where("__rows > 0").select(*[named(n) for n, _, _ in aggregates], key.alias(name)))
