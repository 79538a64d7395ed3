"""Inner, left and anti joins with residual predicates, and joins over ranges alone."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expr import Expr, Symbol
from ..plans.relation import PlanError, Relation, named
from .reshape import plain

#: A side of at most this many bytes, by the optimizer's statistics, is broadcast where a join has no equality.
SMALL = 32 << 20


def sides(left: Relation, right: Relation) -> tuple[dict[str, str], dict[str, str]]:
    """The output name of each side's columns: those that both have get _l and _r."""
    both = set(left.columns) & set(right.columns)
    a = {c: f"{c}_l" if c in both else c for c in left.columns}
    b = {c: f"{c}_r" if c in both else c for c in right.columns}
    names = [*a.values(), *b.values()]
    if len(set(names)) != len(names):
        raise PlanError(f"joined columns clash: {', '.join(sorted({n for n in names if names.count(n) > 1}))}")
    return a, b


def equalities(pred: Expr, left: Relation, right: Relation) -> list[tuple[str, str]] | None:
    """(left column, right column) of an equality between the sides, whichever way it is written; None if it is no such."""
    if str(pred.head) not in ("Equal", "Equals") or len(pred.args) != 2:
        return None
    a, b = pred.args
    if isinstance(a, Expr) and isinstance(b, Expr) and str(a.head) == str(b.head) == "List":
        if len(a.args) != len(b.args):
            raise PlanError("key lists differ in length")
        found = [equalities(Expr("Equal", x, y), left, right) for x, y in zip(a.args, b.args)]
        if any(f is None for f in found):
            raise PlanError(f"no keys of both sides in {pred!r}")
        return [p for f in found if f for p in f]
    if not (isinstance(a, Symbol) and isinstance(b, Symbol)):
        return None
    a, b = str(a), str(b)
    if a in left.columns and b in right.columns:
        return [(a, b)]
    if b in left.columns and a in right.columns:
        return [(b, a)]
    return None


def span_of(pred: Expr, left: Relation, right: Relation) -> tuple[str, str, str, bool] | None:
    """(value, low, high, value on the left) of a Between with the value on one side and both bounds on the other."""
    if str(pred.head) != "Between" or len(pred.args) != 3 or not all(isinstance(x, Symbol) for x in pred.args):
        return None
    v, lo, hi = map(str, pred.args)
    if v in left.columns and lo in right.columns and hi in right.columns:
        return v, lo, hi, True
    if v in right.columns and lo in left.columns and hi in left.columns:
        return v, lo, hi, False
    return None


def size_of(rel: Relation) -> int:
    """The optimizer's estimate in bytes."""
    return int(str(rel.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def number(rel: Relation, name: str, as_name: str) -> Column | None:
    """A column as a double that rises with it: numbers, dates as days, times as seconds; None for other types."""
    kind, c = rel.df.schema[name].dataType, named(as_name)
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp").cast("double")
    return None


def join(kind: str, left: Relation, right: Relation, preds: list[Expr], column: Callable[[Expr, Callable[[Symbol], Column | None], Relation], Column], width: float | None = None) -> Relation:
    """kind: inner, left or left_anti. Equalities are keys, all else a residual condition of the match itself, so a left join keeps rows that only fail it.

    Columns are renamed before joining, so self-joins and clashing names are never ambiguous; predicates use the input
    names, the left side's where both have one. Without an equality a small side is broadcast; two large sides joined
    by a range of numbers, dates or times meet in buckets of `width`, or of a quarter of the ranges' mean length, less for
    few ranges; anything else is a product of pairs, which no side is broadcast for.
    """
    left, right = plain(left), plain(right)
    a, b = sides(left, right)
    clash = set(left.columns) & set(right.columns)
    # the join's own names differ on both sides in any case
    l = left.df.toDF(*[f"l.{c}" for c in left.columns])  # noqa: E741
    r = right.df.toDF(*[f"r.{c}" for c in right.columns])

    def resolve(s: Symbol) -> Column | None:
        name = str(s)
        if name in left.columns:
            return named(f"l.{name}")
        if name in right.columns:
            return named(f"r.{name}")
        for c in clash:  # the output's names work too
            if name == f"{c}_l":
                return named(f"l.{c}")
            if name == f"{c}_r":
                return named(f"r.{c}")
        return None

    joined = Relation(l.join(r, F.lit(False), "cross"))  # for types only, never run
    keys: list[tuple[str, str]] = []
    rest: list[Column] = []
    spans = []
    for p in preds:
        found = equalities(p, left, right)
        if found is not None:
            keys += found
            continue
        span = span_of(p, left, right)
        spans += [span] if span else []
        rest.append(column(p, resolve, joined))
    conditions = [named(f"l.{x}") == named(f"r.{y}") for x, y in keys] + rest
    how = {"inner": "inner", "left": "left", "left_anti": "left_anti"}[kind]
    on = reduce(lambda x, y: x & y, conditions, F.lit(True))
    if keys:
        return output(l.join(r, on, how), left, right, a, b, kind)
    if size_of(right) <= SMALL:
        return output(l.join(F.broadcast(r), on, how), left, right, a, b, kind)
    if kind == "inner" and size_of(left) <= SMALL:
        return output(F.broadcast(l).join(r, on, how), left, right, a, b, kind)
    for v, lo, hi, on_left in spans:
        value, ranges, p, q = (left, right, "l.", "r.") if on_left else (right, left, "r.", "l.")
        numbers = number(value, v, p + v), number(ranges, lo, q + lo), number(ranges, hi, q + hi)
        kinds = {isinstance(rel.df.schema[c].dataType, T.DateType) for rel, c in ((value, v), (ranges, lo), (ranges, hi))}
        if all(n is not None for n in numbers) and len(kinds) == 1:
            return output(range_join(l, r, numbers, on_left, on, how, width), left, right, a, b, kind)
    if kind == "left_anti" and not rest:
        return output(l.join(F.broadcast(r.limit(1)), F.lit(True), how), left, right, a, b, kind)
    if kind != "inner":
        return output(product(l, r, on, how), left, right, a, b, kind)
    return output(l.join(r, on, how), left, right, a, b, kind)


#: Each level's buckets are so many times as wide as those of the level before.
WIDER = 16
#: How many buckets a range may touch before it goes to wider ones; if the width is given, WIDER is the bound.
TOUCHED = 1024


def scale(count: int, mean: float, longest: float, far: float, width: float | None = None) -> tuple[float, list[float]]:
    """The width of the narrowest buckets, and the longest range of each level but the last.

    A quarter of the mean has ranges copied five times on average, whatever their lengths; few ranges may be copied more
    often, to deal values to more tasks. Ranges of a wider level touch TOUCHED / WIDER of its buckets at least. Numbers of
    buckets up to `far`, the bound furthest from zero, stay within a double's digits.
    """
    most = TOUCHED if width is None else WIDER
    width = width if width is not None else max(float(mean or 1.0) / max(4, TOUCHED / 2 / max(count, 1)), 1e-9, (far or 0.0) * 2.0**-53)
    ends: list[float] = []
    while width * most * WIDER ** len(ends) < (longest or 0.0) and len(ends) < 63:
        ends.append(width * most * WIDER ** len(ends))
    return width, ends


def range_join(l, r, numbers: tuple[Column, Column, Column], on_left: bool, on: Column, how: str, width: float | None):  # noqa: E741
    """value between low and high, by buckets: a range goes to each bucket that it touches, a value to its own.

    Longer ranges lie in levels of wider buckets, each WIDER times the one before, so a range of any length touches
    TOUCHED + 1 at most, and a value goes to as many buckets as there are levels with ranges: a value and a range meet
    once. Ranges that hold nothing count for neither width nor levels. Left values without a match are those left by an
    anti join at each level; left ranges, those none of whose copies meets. A left join of more than one copy reads its
    sides for the pairs and again for the rows without a match.
    """
    value, low, high = numbers
    ranges = r if on_left else l
    length = high - low
    real = ranges.where(low <= high)
    width, ends = scale(*real.agg(F.count("*"), F.avg(length), F.max(length), F.max(F.greatest(F.abs(low), F.abs(high)))).first(), width)
    level = sum((F.when(length > F.lit(end), 1).otherwise(0) for end in ends), F.lit(0))
    used = sorted(x[0] for x in real.select(level.alias("n")).distinct().collect()) if ends else [0]
    bucket = lambda c, n: F.floor(c / (F.lit(width) * F.pow(F.lit(float(WIDER)), n)))
    touched = F.transform(F.sequence(bucket(low, level), bucket(high, level)), lambda x: F.struct(level.alias("level"), x.alias("at")))
    ranges_of = lambda df: df.where(low <= high).withColumn("bucket.r", F.explode(touched))
    values_of = lambda df, at: df.withColumn("bucket.v", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), bucket(value, F.lit(i)).alias("at")) for i in at])))
    on = (named("bucket.v") == named("bucket.r")) & on
    if how == "inner" or (on_left and how == "left" and len(used) == 1):
        return values_of(l, used).join(ranges_of(r), on, how) if on_left else ranges_of(l).join(values_of(r, used), on, how)
    if on_left:
        lone = reduce(lambda df, i: values_of(df, [i]).join(ranges_of(r), on, "left_anti").select(*map(named, l.columns)), used, l)
        met = (values_of(l, used), ranges_of(r))
    else:
        nowhere = F.array(F.lit(None).cast("struct<level:int,at:bigint>"))
        copies = l.withColumn("row.l", F.monotonically_increasing_id()).withColumn("all.l", F.when(low <= high, touched).otherwise(nowhere))
        copies = copies.select("*", F.size("`all.l`").alias("copies.l"), F.explode("`all.l`").alias("bucket.r"))
        lone = unmet(copies, values_of(r, used), on, l.columns)
        met = (ranges_of(l), values_of(r, used))
    return lone if how == "left_anti" else met[0].join(met[1], on, "inner").unionByName(lone, allowMissingColumns=True)


def unmet(copies, r, on: Column, columns: list[str]):
    """The rows, by their number "row.l", none of whose "copies.l" copies has a match. Only copies without one are
    gathered by row, so a row of many matches is no one task's load."""
    left = copies.join(r, on, "left_anti").groupBy(named("row.l"), named("copies.l"))
    rows = left.agg(F.count("*").alias("n"), F.first(F.struct(*map(named, columns))).alias("row")).where(F.col("n") == named("copies.l"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def product(l, r, on: Column, how: str):  # noqa: E741
    """A left or anti join on any condition between two large sides. Spark would broadcast the right one whatever its
    size; here an inner product forms the pairs piece by piece. Rows that are equal match alike, so those without a
    match are the rows whose values are in no pair."""
    met = l.join(r.hint("shuffle_replicate_nl"), on, "inner")
    seen = met.select(*[named(c).alias(f"seen.{c}") for c in l.columns]).distinct()
    lone = l.join(seen, reduce(lambda x, y: x & y, [named(c).eqNullSafe(named(f"seen.{c}")) for c in l.columns], F.lit(True)), "left_anti")
    return lone if how == "left_anti" else met.unionByName(lone, allowMissingColumns=True)


def output(df, left: Relation, right: Relation, a: dict[str, str], b: dict[str, str], kind: str) -> Relation:
    if kind == "left_anti":
        return Relation(df.select(*[named(f"l.{c}").alias(c) for c in left.columns]), symbols=left.symbols)
    columns = [named(f"l.{c}").alias(n) for c, n in a.items()] + [named(f"r.{c}").alias(n) for c, n in b.items()]
    return Relation(df.select(*columns), symbols=frozenset([a[c] for c in left.symbols] + [b[c] for c in right.symbols]))
