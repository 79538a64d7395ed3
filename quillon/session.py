"""A session: named tables, the stages of evaluation, and the boundary between plans and results."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from .expr import Expr, Span, Symbol, to_text
from .functions.aggregates import AGGREGATES
from .functions.scalars import SCALARS, date_value, on_driver
from .lower import OPERATORS, Context, Operator, Unevaluated
from .plans import dialect as dialects
from .plans.relation import PlanError, Relation, named
from .reader import read
from .sources import tables
from .sources.load import Loader, LoadError

#: Rows that a result may bring to the driver; more are an error.
CAP = 1_000_000
DDL = {"INTEGER": T.LongType(), "BIGINT": T.LongType(), "INT": T.LongType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "DECIMAL": T.DecimalType(15, 2), "DATE": T.DateType(), "BOOLEAN": T.BooleanType()}

Stage = Callable[[Any], Any]
KERNEL = frozenset(("EvaluateInEngines", "SetDefaultEnginePipeline", "ResetEngines"))


class Session:
    """dialect: the vocabulary where a plan's own signs don't tell, or None to let them; shape: how results print tables, by default as the plan's vocabulary does.

    range_width: bucket width of joins on a range alone, else measured; window_ranges: the number of ranges that
    running aggregates are cut into, else chosen by the table's size.
    """

    def __init__(self, spark: SparkSession | None = None, dialect: str | None = None, cap: int = CAP, shape: str | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.dialect, self.cap, self.shape = dialect, cap, shape
        self.range_width: float | None = None
        self.window_ranges: int | None = None
        self.operators: dict[str, Operator] = dict(OPERATORS)
        self.scalars: dict[str, Callable[..., Column]] = {}
        self.aggregates: dict[str, Callable[[Column], Column]] = {}
        self.loaders: list[Loader] = []
        self.bindings: dict[str, Relation] = {}
        self.relations: dict[str, Relation] = {}
        self.declared: dict[str, tuple[list[tuple[str, T.DataType | None]], list[list[Any]]]] = {}
        self.stages: dict[str, Stage] = {"spark": self.compute}
        self.pipeline: list[str] = []
        self._kept: list[DataFrame] = []
        self._depth = 0

    # -- tables --------------------------------------------------------------------------------------------------
    def register_table(self, name: str, df: DataFrame) -> Session:
        """Make a DataFrame known under a name."""
        self.relations[name] = Relation(df, natural=True)
        return self

    def lookup(self, name: str) -> Relation | None:
        """A declared, bound or registered table, exactly by name, else by the only one that differs in case."""
        for found in (self.declared, self.bindings, self.relations):
            if name in found:
                return self._declared(name) if found is self.declared else found[name]
        names = [n for n in {*self.bindings, *self.declared, *self.relations} if n.lower() == name.lower()]
        return self.lookup(names[0]) if len(names) == 1 else None

    def bind(self, name: str, rel: Relation) -> None:
        self.declared.pop(name, None)
        self.bindings[name] = rel

    def declare(self, name: str, attributes: list[str]) -> None:
        columns = []
        for a in attributes:
            n, _, kind = a.partition(":")
            columns.append((n, DDL.get(kind.split(":")[0].split("(")[0].upper(), T.StringType()) if kind else None))
        self.declared[name] = (columns, [])

    def insert(self, name: str, values: list[Any]) -> None:
        if name not in self.declared:
            found = self.lookup(name)
            if found is None:
                raise PlanError(f"no table {name}")
            # rows are gathered and joined to the table when it is read, so its plan doesn't grow by the row
            self.declared[name] = ([(c, None) for c in found.columns], [])
            self.relations[f"{name} "] = found
        columns, rows = self.declared[name]
        if len(values) != len(columns):
            raise PlanError(f"{name} has {len(columns)} columns, not {len(values)}")
        rows.append([self.cell(v) for v in values])

    def _declared(self, name: str) -> Relation:
        columns, rows = self.declared[name]
        rel = tables.inline(self.spark, [(n, [r[i] for r in rows]) for i, (n, _) in enumerate(columns)])
        kinds = {n: k for n, k in columns if k is not None}
        if kinds:
            rel = Relation(rel.df.select(*[named(c).cast(kinds[c]).alias(c) if c in kinds else named(c) for c in rel.columns]), natural=True, symbols=rel.symbols - kinds.keys())
        base = self.relations.get(f"{name} ")
        if base is None:
            return rel
        if not rows:
            return base
        kinds = {f.name: f.dataType for f in base.df.schema}
        rel = Relation(rel.df.select(*[named(c).cast(kinds[c]).alias(c) for c in base.columns]), natural=True)
        return Relation(base.df.unionByName(rel.df), natural=True, symbols=base.symbols)

    def cell(self, v: Any) -> Any:
        """A table's cell: literal expressions are evaluated, dates and gaps stay for the table to read."""
        if isinstance(v, Expr) and str(v.head) != "Interpolate" and date_value(v) is None:
            return self._literal(v)
        return v

    # -- extension -----------------------------------------------------------------------------------------------
    def register_operator(self, head: str, lower: Callable[[Context, list[Any]], Any], signature: str = "", about: str = "") -> None:
        """A new table operator: lower(context, arguments) to a Relation, an atom or an expression."""
        self.operators[head] = Operator(signature or f"{head}(…)", about, lower)

    def register_scalar(self, head: str, make: Callable[..., Column]) -> None:
        """A new function of columns, such as a built-in or a pandas UDF."""
        self.scalars[head] = make

    def register_aggregate(self, head: str, make: Callable[[Column], Column]) -> None:
        self.aggregates[head] = make

    def register_loader(self, loader: Loader) -> None:
        """A loader that is asked about each path before the built-in formats; it may own it, leave it, or own part of it."""
        self.loaders.append(loader)

    def register_stage(self, name: str, stage: Stage) -> None:
        """A stage of evaluation, from expression to expression."""
        self.stages[name] = stage

    # -- evaluation ----------------------------------------------------------------------------------------------
    def relation(self, x: Any) -> Relation:
        """The plan of a table expression; nothing runs."""
        x = read(x) if isinstance(x, str) and not isinstance(x, Symbol) else x
        return Context(self, dialects.infer(x, self.dialect)).relation(x)

    def dataframe(self, x: Any) -> DataFrame:
        """The DataFrame of a table expression, in no promised order."""
        return self.relation(x).visible()

    def ordered(self, x: Any) -> DataFrame:
        """The same, sorted as the table is."""
        rel = self.relation(x)
        return rel.with_rows(rel.df.orderBy(*rel.sort_columns())).visible() if rel.order else rel.visible()

    def evaluate(self, x: Any) -> Any:
        """The value of an expression, or of its text: an atom, a Table, or what is left of it where no operator applies.

        Results that Materialize kept are let go when the outermost call returns, unless a table was named since.
        """
        kept, names = len(self._kept), dict(self.bindings)
        self._depth += 1
        try:
            return self._evaluate(x)
        finally:
            self._depth -= 1
            if not self._depth and all(names.get(n) is r for n, r in self.bindings.items()):
                for df in self._kept[kept:]:
                    df.unpersist()
                del self._kept[kept:]

    def _evaluate(self, x: Any) -> Any:
        x = read(x) if isinstance(x, str) and not isinstance(x, Symbol) else x
        if isinstance(x, Expr):
            head = str(x.head)
            if head == "EvaluateInEngines":
                return self._in_stages(x)
            if head == "SetDefaultEnginePipeline":
                self.pipeline += [_path(a) for a in x.arguments()]
                return "okay"
            if head == "ResetEngines":
                self.reset()
                return "okay"
        for stage in self.pipeline or ["spark"]:
            x = self._stage(stage)(x)
        return x

    def call(self, x: Any) -> Any:
        """As evaluate(), with any error as an expression: (ErrorWhenEvaluatingExpression expr message)."""
        try:
            return self.evaluate(x)
        except Exception as e:  # noqa: BLE001 - the boundary turns every error into data
            return Expr("ErrorWhenEvaluatingExpression", x if isinstance(x, (Expr, Symbol)) else str(x), str(e).split("\n\nJVM stacktrace")[0])

    def _in_stages(self, x: Expr) -> Any:
        if not x.args or not isinstance(x.args[0], Expr) or str(x.args[0].head) != "List":
            raise PlanError("EvaluateInEngines takes a list of stages first")
        stages = [self._stage(_path(a)) for a in x.args[0].arguments()]
        out: Any = None
        for e in x.args[1:]:
            # the kernel's own operators are evaluated before the stages see what they give
            out = self.evaluate(e) if isinstance(e, Expr) and str(e.head) in KERNEL else e
            for stage in stages:
                out = stage(out)
        return out

    def _stage(self, name: str) -> Stage:
        if name not in self.stages:
            raise PlanError(f"no stage {name}")
        return self.stages[name]

    def reset(self) -> None:
        """Drop names and kept results; the pipeline stays."""
        for df in self._kept:
            df.unpersist()
        self._kept.clear()
        self.bindings.clear()
        self.declared.clear()

    def materialize(self, rel: Relation) -> Relation:
        """The result is kept on the executors' memory and disk; a lost executor's part is computed again."""
        df = rel.df.persist()
        df.count()
        self._kept.append(df)
        return rel.with_rows(df)

    def compute(self, x: Any) -> Any:
        """The stage that lowers to Spark."""
        if not isinstance(x, Expr):
            if isinstance(x, Symbol) and (rel := self.lookup(str(x))) is not None:
                return tables.table(rel, self.cap, self.shape or "S1")
            return x
        try:
            c = Context(self, dialects.infer(x, self.dialect))
            shape = self.shape or ("S2" if c.dialect == dialects.RELATIONAL else "S1")
            if str(x.head) not in self.operators:
                return self._literal(x)
            out = c.lower(x)
            return tables.table(out, self.cap, shape) if isinstance(out, Relation) else out
        except Unevaluated as e:
            return x if e.expr is None else self._rest(x)
        except LoadError as e:
            return str(e)

    def _rest(self, x: Expr) -> Expr:
        """An expression that some head stops: it stays, with what can be computed inside it computed."""
        return Expr(x.head, *[self._literal(a) if isinstance(a, Expr) and str(a.head) not in self.operators else a for a in x.args])

    def _literal(self, x: Any) -> Any:
        """Scalar heads on literals, operators nested in unknown heads; the rest stays."""
        if not isinstance(x, Expr):
            return x
        args: list[Any] = []
        for a in x.args:
            if isinstance(a, Span):
                args += list(a)
            elif isinstance(a, Expr):
                args.append(self.compute(a) if str(a.head) in self.operators else self._literal(a))
            else:
                args.append(a)
        out = on_driver(str(x.head), args)
        return Expr(x.head, *args) if out is NotImplemented else out

    def description(self) -> str:
        """Every operator and function with its signature and what was chosen where a choice was open."""
        lines = ["Operators:", *[f"  {o.signature}: {o.about}" for _, o in sorted(self.operators.items())]]
        lines += ["Aggregates: " + ", ".join(sorted({*AGGREGATES, "CountAll", *self.aggregates}))]
        lines += ["Functions: " + ", ".join(sorted({*SCALARS, *self.scalars, "Symbol"}))]
        lines += [
            "Choices: Divide gives a double; And, Or and Not are three-valued; overflow and failed casts are errors; a YYYY-MM-DD string right of a comparison with a date is a date;",
            "  a symbol that is no column is a string; columns asked for as columns are also found in other case; null is a group key; Assuming and other unknown heads stay unevaluated.",
        ]
        return "\n".join(lines)


def _path(a: Any) -> str:
    if isinstance(a, str) and not isinstance(a, Symbol):
        return str(a)
    raise TypeError(f'expected and actual type mismatch in expression "{to_text(a)}", expected string')


