"""Which vocabulary a plan is written in.

The relational one (Select, Where, Group, By, …) writes (As name expr name expr …) and names an aggregate after its
column; the catalogue's (Filter, GroupBy, OrderBy, …) writes (As expr name) and names it fn(col). Both have Project and
Join, so the whole plan decides: a head that only one of them has settles it, lesser signs break ties, and heads of
both are an error unless the session says which is meant.
"""

from __future__ import annotations

from typing import Any

from ..expr import Expr, Symbol
from .relation import PlanError

RELATIONAL, CATALOGUE = "relational", "catalogue"
ONLY = {
    RELATIONAL: frozenset(("Select", "Where", "By", "Group", "Order", "Sort", "Top", "Function", "ProjectAll")),
    CATALOGUE: frozenset(("Filter", "GroupBy", "OrderBy", "keys", "Desc", "Slice", "Cumulate", "Pairwise", "LeftJoin", "AntiJoin")),
}
HINTS = {RELATIONAL: frozenset(("Plus", "Minus", "Times", "StringContainsQ", "StringContains", "DateObject", "Equals", "If", "-")), CATALOGUE: frozenset(("Add", "Between", "Like", "IfElse", "IsValid", "Int", "Bool", "Timestamp", "NotEqual"))}


def evidence(x: Any) -> tuple[dict[str, set[str]], dict[str, int]]:
    """The heads that settle it, by vocabulary, and the number of lesser signs."""
    strong: dict[str, set[str]] = {RELATIONAL: set(), CATALOGUE: set()}
    weak = {RELATIONAL: 0, CATALOGUE: 0}
    todo = [x]
    while todo:
        e = todo.pop()
        if not isinstance(e, Expr):
            continue
        head = str(e.head)
        for d in strong:
            if head in ONLY[d]:
                strong[d].add(head)
            weak[d] += head in HINTS[d]
        if head == "Project":
            for a in e.args[1:]:
                if isinstance(a, Symbol):
                    strong[CATALOGUE].add("a bare column in Project")
                elif isinstance(a, Expr) and str(a.head) == "As":
                    if len(a.args) > 2:
                        strong[RELATIONAL].add("As with several pairs")
                    elif len(a.args) == 2 and not isinstance(a.args[0], Symbol):
                        strong[CATALOGUE].add("As with the name last")
                    elif len(a.args) == 2 and not isinstance(a.args[1], Symbol):
                        strong[RELATIONAL].add("As with the name first")
        if head == "Table":
            # a table's columns are data, not operators
            for c in e.args:
                if isinstance(c, Expr):
                    wrapped = any(isinstance(v, Expr) and str(v.head) == "List" for v in c.args)
                    weak[RELATIONAL if wrapped else CATALOGUE] += 1
            continue
        todo.extend(e.args)
    return strong, weak


def infer(x: Any, given: str | None = None) -> str:
    """The plan's vocabulary; `given` decides where its own signs conflict or are none."""
    strong, weak = evidence(x)
    both = [d for d in strong if strong[d]]
    if len(both) == 2:
        if given:
            return given
        raise PlanError(f"the plan mixes vocabularies: {', '.join(sorted(strong[RELATIONAL]))} and {', '.join(sorted(strong[CATALOGUE]))}; set the session's dialect")
    if both:
        return both[0]
    if weak[RELATIONAL] != weak[CATALOGUE] and not given:
        return RELATIONAL if weak[RELATIONAL] > weak[CATALOGUE] else CATALOGUE
    return given or CATALOGUE
