"""Bag union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..plans.relation import HIDDEN, Relation, named


def union(inputs: list[Relation]) -> Relation:
    """All rows of all tables, in their order; columns by name, null where a table lacks one. A column is of symbols if it is in every table that has it."""
    columns = list(dict.fromkeys(c for r in inputs for c in r.columns))
    symbols = frozenset(c for c in columns if all(c in r.symbols for r in inputs if c in r.columns))
    if all(r.natural and not r.order for r in inputs):
        # partitions of a union stand in input order, so the natural order carries on
        return Relation(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r.df for r in inputs]), natural=True, symbols=symbols)
    if not all(r.has_order() for r in inputs):
        return Relation(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [r.visible() for r in inputs]), symbols=symbols)
    parts, order = [], [(f"{HIDDEN}input", False)]
    for i, r in enumerate(r.numbered() for r in inputs):
        names = {c: f"{HIDDEN}u{i}_{k}" for k, c in enumerate(r.hidden)}
        parts.append(r.df.select(*map(named, r.columns), F.lit(i).alias(f"{HIDDEN}input"), *[named(c).alias(n) for c, n in names.items()]))
        order += [(names[c], d) for c, d in r.order]
    return Relation(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), tuple(order), symbols=symbols)
