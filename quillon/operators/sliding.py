"""Running aggregates and lagged differences over ordered tables.

A window over the whole table walks its rows in one task. Small tables do that; larger ones are cut into ranges of the
order, each range runs alone and takes on what the ranges before it add up to, which is one row a range.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.relation import HIDDEN, PlanError, Relation, named
from .joins import size_of

#: Tables under this many bytes, by the optimizer's statistics, walk in one task.
ALONE = 8 << 20
RANGES = 512
#: Rows at the edges of ranges that are broadcast, at most.
EDGES = 1 << 16


def ordered(rel: Relation, what: str) -> Relation:
    rel = rel.numbered()
    if not rel.order:
        raise PlanError(f"{what} needs an ordered table; sort it first")
    return rel


def ranged(rel: Relation, ranges: int = RANGES) -> Column | None:
    """The range of each row: that of the scan's partition, or by quantiles of the first key. None where the key has no quantiles.

    Rows of equal first key share a range, so order inside and between ranges is the table's.
    """
    name, descending = rel.order[0]
    if name == f"{HIDDEN}scan":
        return F.shiftright(named(name), 33)
    if name == f"{HIDDEN}file":
        return F.struct(named(name), named(f"{HIDDEN}block"))
    kind = rel.df.schema[name].dataType
    if isinstance(kind, T.DateType):
        value = F.unix_date(named(name)).cast("double")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = named(name).cast("timestamp").cast("double")
    elif isinstance(kind, T.NumericType):
        value = named(name).cast("double")
    else:
        return None
    cuts = rel.df.select(value.alias("x")).agg(F.percentile_approx("x", [i / ranges for i in range(1, ranges)], 10000)).first()[0]
    cuts = sorted(set(cuts or []))
    if not cuts:
        return None
    at = below(value, cuts)
    at = F.when(value.isNull(), F.lit(len(cuts) + 1)).otherwise(at)
    return F.when(value.isNull(), at).otherwise(-at) if descending else at


def below(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts lie below the value, in two steps of about the root of their number each; null for null."""
    step = math.isqrt(len(cuts) - 1) + 1
    count = lambda xs: F.size(F.filter(xs, lambda c: c < value)).cast("long")
    coarse = count(F.array(*[F.lit(c) for c in cuts[step - 1 :: step]])) if cuts[step - 1 :: step] else F.lit(0).cast("long")
    fine = F.array(*[F.array(*[F.lit(c) for c in cuts[i : i + step]]) for i in range(0, len(cuts), step)])
    return F.when(value.isNotNull(), coarse * step + F.coalesce(count(F.get(fine, coarse.cast("int"))), F.lit(0)).cast("long"))


def cumulate(rel: Relation, name: str, head: str, source: str, ranges: int | None = None) -> Relation:
    """Append the running aggregate of a column, each row with all before it and itself; ties in the order count row by row."""
    rel = ordered(rel, "Cumulate")
    if name in rel.columns:
        raise PlanError(f"a column {name} is there already")
    x = named(source)
    part = ranged(rel, ranges or RANGES) if ranges or size_of(rel) > ALONE else None
    if part is None:
        run = Window.orderBy(*rel.sort_columns()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return placed(rel, name, {"Sum": F.sum, "Mean": F.avg, "Avg": F.avg, "Min": F.min, "Max": F.max, "Count": F.count}[head](x).over(run))
    df = rel.df.withColumn("__range", part)
    inner = Window.partitionBy("__range").orderBy(*rel.sort_columns()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(F.col("__range").alias("range")).agg(F.sum(x).alias("s"), F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    # one row a range
    totals = totals.select("range", F.sum("s").over(before).alias("__s"), F.sum("n").over(before).alias("__n"), F.min("lo").over(before).alias("__lo"), F.max("hi").over(before).alias("__hi"))
    df = df.join(F.broadcast(totals), F.col("__range") == F.col("range"))
    total = lambda own, past: F.when(own.isNull() & past.isNull(), F.lit(None)).otherwise(F.coalesce(own, F.lit(0)) + F.coalesce(past, F.lit(0)))
    s, n = total(F.sum(x).over(inner), F.col("__s")), F.count(x).over(inner) + F.coalesce("__n", F.lit(0))
    value = {"Sum": s, "Count": n, "Mean": F.when(n > 0, s / n), "Avg": F.when(n > 0, s / n), "Min": F.least(F.min(x).over(inner), F.col("__lo")), "Max": F.greatest(F.max(x).over(inner), F.col("__hi"))}[head]
    return placed(replace(rel, df=df), name, value, rel)


def pairwise(rel: Relation, name: str, source: str, lag: int, ranges: int | None = None) -> Relation:
    """Append the difference to the value `lag` rows before; null where there is none."""
    rel = ordered(rel, "Pairwise")
    if lag < 1:
        raise PlanError("the lag is 1 or more")
    if name in rel.columns and name != source:
        raise PlanError(f"a column {name} is there already")
    part = ranged(rel, ranges or RANGES) if ranges or size_of(rel) > ALONE else None
    if part is None:
        return placed(rel, name, named(source) - F.lag(named(source), lag).over(Window.orderBy(*rel.sort_columns())))
    df = rel.df.withColumn("__range", part)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(F.col("__range").alias("range")).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inner = Window.partitionBy("__range").orderBy(*rel.sort_columns())
    df = df.withColumn("__rank", F.row_number().over(inner)).withColumn("__own", F.lag(named(source), lag).over(inner))
    df = df.join(F.broadcast(totals), F.col("__range") == F.col("range")).withColumn("__row", F.col("__before") + F.col("__rank"))
    # within a range the value is at hand; the first rows of one ask for the last rows of those before it
    past = df.where(F.col("__rank") > F.col("__n") - lag).select((F.col("__row") + lag).alias("__at"), named(source).alias("__past"))
    past = F.broadcast(past) if lag * ((ranges or RANGES) + 2) <= EDGES and named_ranges(rel) else past
    df = df.join(past, (F.col("__row") == F.col("__at")) & (F.col("__rank") <= lag), "left")
    return placed(replace(rel, df=df), name, named(source) - F.when(F.col("__rank") > lag, F.col("__own")).otherwise(F.col("__past")), rel)


def named_ranges(rel: Relation) -> bool:
    """Whether the ranges are quantiles, of which there is a bounded number, and no pieces of a scan."""
    return rel.order[0][0] not in (f"{HIDDEN}scan", f"{HIDDEN}file")


def placed(rel: Relation, name: str, value: Column, shape: Relation | None = None) -> Relation:
    """The relation's columns with the value under its name, last unless the name is there."""
    shape = shape or rel
    names = shape.columns if name in shape.columns else [*shape.columns, name]
    df = rel.df.select(*[(value if c == name else named(c)).alias(c) for c in names], *map(named, shape.hidden))
    return replace(shape, df=df)
