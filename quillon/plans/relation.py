"""A table as the operators pass it on: a DataFrame with what relational algebra on ordered tables needs beside it."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that carry the order; no operator shows them.
HIDDEN = "__order_"


class PlanError(ValueError):
    """The expression can't be lowered to a plan."""


def named(name: str) -> Column:
    """The column of exactly this name; names may hold blanks, dots and parentheses."""
    return F.col("`" + name.replace("`", "``") + "`")


def short(path: Column, files: list[str]) -> Column:
    """The part of a file's path that tells it from the others and sorts like it: each row bears it through the sorts.

    Only what follows the folder of all is used, as a scheme may be written in two ways; files at different depths keep
    their whole paths."""
    parts = [f.split("/") for f in files]
    if len({len(p) for p in parts}) > 1:
        return path
    same = next((i for i, xs in enumerate(zip(*parts)) if len(set(xs)) > 1), 0)
    tails = sorted({"/".join(p[same:]) for p in parts})
    # sorted neighbours share the most
    shared = [len(os.path.commonprefix(pair)) for pair in zip(tails, tails[1:])]
    start = len(os.path.commonprefix(tails))
    return F.substring(F.substring_index(path, "/", same - len(parts[0])), start + 1, max(shared, default=0) + 1 - start)


@dataclass(frozen=True)
class Relation:
    """df with its hidden columns. order: (hidden column, descending) in precedence. natural: rows stand in the order of
    the scan, which only narrow operators keep; a row number for it is made where an operator needs one, so that scans
    stay open to pushdown. symbols: string columns whose values are symbols."""

    df: DataFrame
    order: tuple[tuple[str, bool], ...] = ()
    natural: bool = False
    symbols: frozenset[str] = frozenset()

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(HIDDEN)]

    def visible(self) -> DataFrame:
        return self.df.select(*map(named, self.columns)) if self.hidden else self.df

    def has_order(self) -> bool:
        return bool(self.order) or self.natural

    def sort_columns(self) -> list[Column]:
        return [named(c).desc_nulls_last() if d else named(c).asc_nulls_last() for c, d in self.order]

    def select(self, items: list[tuple[str, Column]], symbols: frozenset[str] = frozenset()) -> Relation:
        """New visible columns over the same rows."""
        names = [n for n, _ in items]
        if len(set(names)) != len(names):
            raise PlanError(f"a column is named twice: {', '.join(sorted({n for n in names if names.count(n) > 1}))}")
        df = self.df.select(*[c.alias(n) for n, c in items], *map(named, self.hidden))
        return replace(self, df=df, symbols=symbols)

    def with_rows(self, df: DataFrame) -> Relation:
        """The same columns over some of the rows."""
        return replace(self, df=df)

    def unordered(self, df: DataFrame, symbols: frozenset[str] = frozenset()) -> Relation:
        return Relation(df, symbols=symbols)

    def numbered(self) -> Relation:
        """With the scan's order as hidden columns: of several files by file name, place in the file and row, as Spark
        packs pieces of files into tasks by size; else the row alone. The numbers are no row counts."""
        if self.order or not self.natural:
            return self
        names = [f"{HIDDEN}file", f"{HIDDEN}block", f"{HIDDEN}scan"]
        row = F.monotonically_increasing_id().alias(names[2])
        files = self.df.inputFiles()
        if len(files) > 1:
            try:
                df = self.df.select("*", short(F.col("_metadata.file_path"), files).alias(names[0]), F.col("_metadata.file_block_start").alias(names[1]), row)
                return replace(self, df=df, order=tuple((n, False) for n in names), natural=False)
            except AnalysisException:  # no plain scan of files, such as a union of them, whose parts stand in order
                pass
        return replace(self, df=self.df.select("*", row), order=((names[2], False),), natural=False)

    def sorted_by(self, keys: list[tuple[str, bool]]) -> Relation:
        """Ordered by visible columns, then as before."""
        base = self.numbered()
        depth = len(base.order)
        names = [f"{HIDDEN}{depth}_{i}_{len(base.hidden)}" for i in range(len(keys))]
        df = base.df.withColumns({n: named(c) for n, (c, _) in zip(names, keys)})
        return replace(base, df=df, order=(*[(n, d) for n, (_, d) in zip(names, keys)], *base.order))

    def resolve(self, name: str) -> str:
        """The column that a slot for columns means: exactly, else the only one that differs in case."""
        name = str(name)
        if name in self.columns:
            return name
        close = [c for c in self.columns if c.lower() == name.lower()]
        if len(close) == 1:
            return close[0]
        raise PlanError(f"no column {name} in ({', '.join(self.columns)})" if not close else f"column {name} is ambiguous: {', '.join(close)}")
