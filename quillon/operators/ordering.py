"""Sorting and top-k."""

from __future__ import annotations

from ..plans.relation import Relation
from .reshape import slice_rows


def order(rel: Relation, keys: list[tuple[str, bool]]) -> Relation:
    """Sorted by (column, descending), ties as they stood; nulls last either way. The sort runs where the order is used."""
    return rel.sorted_by([(rel.resolve(c), d) for c, d in keys])


def top(rel: Relation, keys: list[tuple[str, bool]], n: int) -> Relation:
    """The first n rows of the sorted table: a bounded heap per task, then one of those."""
    return slice_rows(order(rel, keys), 0, n)
