"""Projection, filters and row ranges."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.relation import HIDDEN, PlanError, Relation, named


def project(rel: Relation, items: list[tuple[str, Column, str | None]]) -> Relation:
    """Only the listed columns, all computed over the input's. The third part names a column that is kept, whose symbols stay symbols."""
    symbols = frozenset(n for n, _, src in items if src in rel.symbols)
    return rel.select([(n, c) for n, c, _ in items], symbols)


def project_all(rel: Relation, name: str) -> Relation:
    """All columns under an alias: c becomes name.c."""
    return rel.select([(f"{name}.{c}", named(c)) for c in rel.columns], frozenset(f"{name}.{c}" for c in rel.symbols))


def keep(rel: Relation, predicate: Column) -> Relation:
    """Rows for which the predicate is true; null drops."""
    return rel.with_rows(rel.df.filter(predicate))


def keep_constant(rel: Relation, value: bool) -> Relation:
    return rel if value else rel.with_rows(rel.df.filter(F.lit(False)))


def slice_rows(rel: Relation, offset: int, count: int) -> Relation:
    """Rows offset to offset + count - 1 in the table's order."""
    if offset < 0 or count < 0:
        raise PlanError("a slice starts at 0 or later and has no negative size")
    rel = rel.numbered()
    if not rel.order:
        raise PlanError("Slice needs an ordered table; sort it first")
    df = rel.df.orderBy(*rel.sort_columns())
    df = df.offset(offset).limit(count) if offset else df.limit(count)
    return replace(rel, df=df)


def renamed(rel: Relation, names: dict[str, str]) -> Relation:
    """Some columns under other names."""
    return rel.select([(names.get(c, c), named(c)) for c in rel.columns], frozenset(names.get(c, c) for c in rel.symbols))


def plain(rel: Relation) -> Relation:
    """Without order, for operators that lose it anyway: no hidden column goes into their shuffles."""
    return Relation(rel.df.drop(*[c for c in rel.df.columns if c.startswith(HIDDEN)]), symbols=rel.symbols) if rel.hidden else replace(rel, order=(), natural=False)
