"""Expressions to relations: one small function per operator, found by head."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Expr, Span, Symbol, to_text
from .functions.aggregates import AGGREGATES, aggregate, is_aggregate
from .functions.scalars import column
from .operators import grouping, joins, ordering, reshape, sets, sliding
from .plans.dialect import CATALOGUE, RELATIONAL
from .plans.relation import PlanError, Relation, named
from .sources import load as loading
from .sources import tables


class Unevaluated(Exception):
    """No operator has this head; the expression stays as it is."""

    def __init__(self, expr: Any):
        super().__init__(to_text(expr))
        self.expr = expr


@dataclass(frozen=True)
class Operator:
    """lower: (context, arguments) to a Relation, an atom or an Expr."""

    signature: str
    about: str
    lower: Callable[[Context, list[Any]], Any]


@dataclass
class Context:
    """What lowering needs: the session, and the vocabulary of the plan at hand."""

    session: Any
    dialect: str

    def relation(self, x: Any) -> Relation:
        """A table: an operator's result, or a name that the session knows."""
        if isinstance(x, Relation):
            return x
        if isinstance(x, str) and not isinstance(x, Expr):
            found = self.session.lookup(str(x))
            if found is None:
                raise PlanError(f"no table {x}")
            return found
        if not isinstance(x, Expr):
            raise PlanError(f"a table is needed, not {x!r}")
        out = self.lower(x)
        if isinstance(out, Relation):
            return out
        raise Unevaluated(out) if isinstance(out, Expr) else PlanError(f"a table is needed, not {out!r}")

    def lower(self, x: Expr) -> Any:
        op = self.session.operators.get(str(x.head))
        if op is None:
            raise Unevaluated(x)
        return op.lower(self, list(x.args))

    def value(self, x: Any, rel: Relation, attach: list[Relation] | None = None) -> Column:
        """A scalar expression over a table. A binding used as a value becomes a column that `attach` brings in."""

        def foreign(e: Expr) -> Column | None:
            if attach is None or str(e.head) not in ("ByName", "GroupBy", "Group"):
                return None
            one = self.relation(e)
            if len(one.columns) != 1:
                raise PlanError(f"{to_text(e)} is used as a value and has {len(one.columns)} columns")
            attach.append(one)
            return named(f"__scalar_{len(attach)}")

        return column(x, rel, self.session.scalars, None, foreign)

    def with_scalars(self, rel: Relation, make: Callable[[list[Relation]], list[Column]]) -> tuple[Relation, list[Column]]:
        """Columns that may use one-row tables as values, and the relation joined with those. Each is checked to be one row and broadcast."""
        attach: list[Relation] = []
        columns = make(attach)
        df = rel.df
        for i, one in enumerate(attach, 1):
            # max and the check make it one row whatever the plan; an empty table counts as null
            n = F.count(F.lit(1))
            x = F.first(named(one.columns[0]))
            single = one.df.agg(F.when(n <= 1, x).otherwise(F.raise_error(F.lit("a table used as a value has more than one row")).cast(one.df.schema[one.columns[0]].dataType)).alias(f"__scalar_{i}"))
            df = df.crossJoin(F.broadcast(single))
        return (Relation(df, rel.order, rel.natural, rel.symbols) if attach else rel), columns

    def catalogue(self) -> bool:
        return self.dialect == CATALOGUE


# -- reading arguments -----------------------------------------------------------------------------------------------
def where(x: Any) -> Any:
    return x.args[0] if isinstance(x, Expr) and str(x.head) == "Where" and len(x.args) == 1 else x


def whole(x: Any, what: str) -> int:
    if isinstance(x, bool) or not isinstance(x, int):
        raise PlanError(f"{what} is a whole number, not {x!r}")
    return int(x)


def by_keys(x: Any) -> list[tuple[str, bool]]:
    """(By c desc d): desc belongs to the column before it. A column named desc can't be a key this way."""
    if not isinstance(x, Expr) or str(x.head) != "By":
        raise PlanError(f"By is needed, not {x!r}")
    out: list[tuple[str, bool]] = []
    for a in x.args:
        if isinstance(a, Expr) and str(a.head) == "Desc":
            out.append((str(a.args[0]), True))
        elif isinstance(a, Symbol) and str(a) == "desc" and out and not out[-1][1]:
            out[-1] = (out[-1][0], True)
        elif isinstance(a, Symbol) and str(a) == "asc" and out:
            continue
        else:
            out.append((_name(a), False))
    return out


def order_keys(x: Any) -> list[tuple[str, bool]]:
    if not isinstance(x, Expr) or str(x.head).lower() not in ("keys", "list"):
        raise PlanError(f"(keys …) is needed, not {x!r}")
    return [(_name(a.args[0]), True) if isinstance(a, Expr) and str(a.head) == "Desc" else (_name(a.args[0]), False) if isinstance(a, Expr) and str(a.head) == "Asc" else (_name(a), False) for a in x.args]


def _name(x: Any) -> str:
    if not isinstance(x, str):
        raise PlanError(f"a column is needed, not {x!r}")
    return str(x)


def pairs(x: Expr, dialect: str) -> list[tuple[str, Any]]:
    """(name, expression) of an As, by the plan's vocabulary."""
    args = x.arguments()
    if dialect == RELATIONAL:
        if len(args) % 2 or not args:
            raise PlanError(f"As takes pairs of name and expression: {to_text(x)}")
        return [(_name(n), e) for n, e in zip(args[::2], args[1::2])]
    if len(args) != 2:
        raise PlanError(f"As takes an expression and a name: {to_text(x)}")
    return [(_name(args[1]), args[0])]


# -- operators -------------------------------------------------------------------------------------------------------
def _project(c: Context, args: list[Any]) -> Relation:
    rel = c.relation(args[0])
    wanted: list[tuple[str, Any]] = []
    for a in args[1:]:
        if isinstance(a, Expr) and str(a.head) == "As":
            wanted += pairs(a, c.dialect)
        elif isinstance(a, Symbol):
            wanted.append((rel.resolve(a), a))
        else:
            wanted.append((to_text(a), a))

    def source(e: Any) -> str | None:
        """The column that a plain symbol means: here it can be nothing else."""
        return rel.resolve(e) if isinstance(e, Symbol) else None

    joined, columns = c.with_scalars(rel, lambda attach: [named(source(e)) if isinstance(e, Symbol) else c.value(e, rel, attach) for _, e in wanted])
    return reshape.project(joined, [(n, col, source(e)) for (n, e), col in zip(wanted, columns)])


def _filter(c: Context, args: list[Any]) -> Relation:
    rel, p = c.relation(args[0]), where(args[1])
    if len(args) != 2:
        raise PlanError("a filter takes a table and one predicate")
    if isinstance(p, Expr) and str(p.head) == "Function" and len(p.args) == 1 and isinstance(p.args[0], bool):
        return reshape.keep_constant(rel, p.args[0])
    joined, (predicate,) = c.with_scalars(rel, lambda attach: [c.value(p, rel, attach)])
    out = reshape.keep(joined, predicate)
    return out if joined is rel else out.with_rows(out.df.drop(*[x for x in out.df.columns if x.startswith("__scalar_")]))


def _project_all(c: Context, args: list[Any]) -> Relation:
    return reshape.project_all(c.relation(args[0]), _name(args[1]))


def _slice(c: Context, args: list[Any]) -> Relation:
    return reshape.slice_rows(c.relation(args[0]), whole(args[1], "the offset"), whole(args[2], "the count"))


def _join(kind: str) -> Callable[[Context, list[Any]], Relation]:
    def run(c: Context, args: list[Any]) -> Relation:
        left, right = c.relation(args[0]), c.relation(args[1])
        preds: list[Expr] = []
        for p in map(where, args[2:]):
            # (And p q) at the top is p and q
            preds += list(p.args) if isinstance(p, Expr) and str(p.head) == "And" else [p]
        return joins.join(kind, left, right, preds, lambda p, resolve, rel: column(p, rel, c.session.scalars, resolve), c.session.range_width)

    return run


def _group_by(c: Context, args: list[Any]) -> Relation:
    rel = c.relation(args[0])
    aggs = [a for a in args[1:] if is_aggregate(a, c.session.aggregates) and not (isinstance(a, Symbol) and str(a) in rel.columns)]
    keys = [a for a in args[1:] if not any(a is x for x in aggs)]
    named_keys = [rel.resolve(_name(k)) for k in keys]
    return grouping.group(rel, [(k, k) for k in named_keys], [aggregate(a, rel, lambda e: c.value(e, rel), True, c.session.aggregates) for a in aggs])


def _group(c: Context, args: list[Any]) -> Relation:
    rel = c.relation(args[0])
    keys: list[tuple[str, str]] = []
    constant: list[Any] = []
    aggs: list[tuple[str, Column, str | None]] = []
    catalogue = False
    for a in args[1:]:
        if isinstance(a, Expr) and str(a.head) == "By":
            keys += [(k, k) for k in (rel.resolve(_name(x)) for x in a.arguments())]
        elif isinstance(a, Expr) and str(a.head) == "Function":
            constant.append(a.args[0])
        elif isinstance(a, Expr) and str(a.head) == "As":
            for n, e in pairs(a, RELATIONAL):
                if not is_aggregate(e, c.session.aggregates):
                    raise PlanError(f"{to_text(e)} is no aggregate")
                aggs.append((n, aggregate(e, rel, lambda e: c.value(e, rel), catalogue, c.session.aggregates)[1], None))
        elif is_aggregate(a, c.session.aggregates):
            aggs.append(aggregate(a, rel, lambda e: c.value(e, rel), catalogue, c.session.aggregates))
        else:
            raise PlanError(f"Group takes By, Function and aggregates, not {to_text(a)}")
    if constant:
        return grouping.group_constant(rel, c.value(constant[0], rel), "Function", aggs)
    return grouping.group(rel, keys, aggs)


def _order_by(c: Context, args: list[Any]) -> Relation:
    return ordering.order(c.relation(args[0]), order_keys(args[1]))


def _sort(c: Context, args: list[Any]) -> Relation:
    return ordering.order(c.relation(args[0]), by_keys(args[1]))


def _top(c: Context, args: list[Any]) -> Relation:
    return ordering.top(c.relation(args[0]), by_keys(args[1]), whole(args[2], "the number of rows"))


def _cumulate(c: Context, args: list[Any]) -> Relation:
    rel, agg = c.relation(args[0]), args[1]
    if not isinstance(agg, Expr) or str(agg.head) not in AGGREGATES or len(agg.args) != 1:
        raise PlanError("Cumulate takes one aggregate of a column")
    source = rel.resolve(_name(agg.args[0]))
    return sliding.cumulate(rel, f"{AGGREGATES[str(agg.head)][1]}({source})", str(agg.head), source, c.session.window_ranges)


def _pairwise(c: Context, args: list[Any]) -> Relation:
    rel = c.relation(args[0])
    return sliding.pairwise(rel, _name(args[1]), rel.resolve(_name(args[2])), whole(args[3], "the lag"), c.session.window_ranges)


def _union(c: Context, args: list[Any]) -> Relation:
    if not args:
        raise PlanError("Union takes tables")
    return sets.union([c.relation(a) for a in args])


def _load(c: Context, args: list[Any]) -> Any:
    if len(args) == 2 and isinstance(args[0], Symbol) and isinstance(args[1], str) and not isinstance(args[1], Symbol):
        # (Load relation "file"): read and bind
        rel = loading.load(c.session.spark, str(args[1]), [])
        c.session.bind(str(args[0]), rel)
        return rel
    if not args or not isinstance(args[0], str) or isinstance(args[0], Symbol):
        raise PlanError("Load takes a path")
    path = str(args[0])
    for loader in reversed(c.session.loaders):
        found = loader(c.session, path, args[1:])
        if isinstance(found, Expr):
            if str(found.head) == "Load":
                raise Unevaluated(found)
            return c.relation(found)
        if found is not None:
            return found
    return loading.load(c.session.spark, path, args[1:])


def _table(c: Context, args: list[Any]) -> Relation:
    columns = tables.table_columns(Expr("Table", *args))
    return tables.inline(c.session.spark, [(n, [c.session.cell(v) for v in vs]) for n, vs, _ in columns])


def _create_table(c: Context, args: list[Any]) -> Any:
    c.session.declare(_name(args[0]), [_name(a) for a in args[1:]])
    return Symbol(_name(args[0]))


def _insert_into(c: Context, args: list[Any]) -> Any:
    c.session.insert(_name(args[0]), [v for a in args[1:] for v in (a if isinstance(a, Span) else [a])])
    return Symbol(_name(args[0]))


def _bind(c: Context, args: list[Any]) -> Relation:
    rel = c.relation(args[0])
    c.session.bind(_name(args[1]), rel)
    return rel


def _by_name(c: Context, args: list[Any]) -> Relation:
    found = c.session.bindings.get(_name(args[0]))
    if found is None:
        raise PlanError(f"no table is bound to {args[0]}")
    return found


def _materialize(c: Context, args: list[Any]) -> Relation:
    return c.session.materialize(c.relation(args[0]))


def _to_status(c: Context, args: list[Any]) -> str:
    c.relation(args[0]).visible().write.format("noop").mode("overwrite").save()
    return "OK"


def _schema(c: Context, args: list[Any]) -> Relation:
    return tables.inline(c.session.spark, [("Columns", [Symbol(n) for n in c.relation(args[0]).columns])])


def _description(c: Context, args: list[Any]) -> str:
    return c.session.description()


OPERATORS: dict[str, Operator] = {
    "Load": Operator("Load(path [col …] [(flag v) …])", "a CSV, .tbl, Parquet, ORC or JSON file, or the .csv and .tbl files of a directory by column name, tagged with their \"file name\"; with a name first, binds it", _load),
    "Table": Operator("Table((col v …) …)", "inline columns, also as (col (List v …)) and (Column col (List v …)); integers are 64-bit, symbols in typed columns null", _table),
    "CreateTable": Operator("CreateTable(name attr …)", "declare an empty table; an attribute may be name:TYPE:n", _create_table),
    "InsertInto": Operator("InsertInto(name v …)", "append a row; (Interpolate c) is filled from its neighbours when the table is read", _insert_into),
    "Project": Operator("Project(table col … (As …))", "only the listed columns, all computed over the input", _project),
    "ProjectAll": Operator("ProjectAll(table name)", "every column as name.col", _project_all),
    "Filter": Operator("Filter(table predicate)", "rows where it is true; And and Or are three-valued as in SQL, null drops", _filter),
    "Select": Operator("Select(table (Where p)) or (Function bool)", "as Filter", _filter),
    "Slice": Operator("Slice(table offset count)", "a range of rows in the table's order", _slice),
    "OrderBy": Operator("OrderBy(table (keys col (Desc col) …))", "sort; nulls last either way, ties as they stood", _order_by),
    "Sort": Operator("Sort(table (By col [desc] …))", "as OrderBy", _sort),
    "Order": Operator("Order(table (By col [desc] …))", "as OrderBy; desc belongs to the column before it", _sort),
    "Top": Operator("Top(table (By col [desc] …) n)", "the first n of the sorted rows", _top),
    "GroupBy": Operator("GroupBy(table (agg col) … key …)", "keys first, then fn(col); CountAll gives count_all(); no key gives one row, no aggregate the distinct keys", _group_by),
    "Group": Operator("Group(table (By key …) (As name (Agg col) …))", "keys first; an unnamed aggregate has its column's name; (Function k) is one constant key, after the aggregates", _group),
    "Cumulate": Operator("Cumulate(table (agg col))", "append the running aggregate fn(col), row by row", _cumulate),
    "Pairwise": Operator("Pairwise(table out in lag)", "append in[i] - in[i - lag]", _pairwise),
    "Join": Operator("Join(left right pred …)", "inner; equalities between the sides are keys, the rest a residual condition; names of both sides get _l and _r", _join("inner")),
    "LeftJoin": Operator("LeftJoin(left right pred …)", "left outer; residual conditions belong to the match", _join("left")),
    "AntiJoin": Operator("AntiJoin(left right pred …)", "left rows without a match", _join("left_anti")),
    "Union": Operator("Union(table table …)", "all rows in input order, columns by name, null where missing", _union),
    "Name": Operator("Name(table sym)", "bind a table to a name", _bind),
    "ByName": Operator("ByName(sym)", "the table bound to it; inside a predicate or projection the value of its one row and column", _by_name),
    "Materialize": Operator("Materialize(table)", "run the plan once and keep the result", _materialize),
    "ToStatus": Operator("ToStatus(table)", "run the plan, give \"OK\"", _to_status),
    "Schema": Operator("Schema(table)", "the column names as symbols in a column Columns", _schema),
    "GetEngineDescription": Operator("GetEngineDescription()", "this text", _description),
}
