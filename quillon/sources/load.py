"""Load: files and directories, by a registry of formats and of loaders that may own a path."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expr import Expr
from ..plans.relation import PlanError, Relation, named

FILE = "file name"

#: The tables of TPC-H by file stem, for .tbl files without a header.
TPCH: dict[str, str] = {
    "region": "r_regionkey bigint, r_name string, r_comment string",
    "nation": "n_nationkey bigint, n_name string, n_regionkey bigint, n_comment string",
    "supplier": "s_suppkey bigint, s_name string, s_address string, s_nationkey bigint, s_phone string, s_acctbal double, s_comment string",
    "customer": "c_custkey bigint, c_name string, c_address string, c_nationkey bigint, c_phone string, c_acctbal double, c_mktsegment string, c_comment string",
    "part": "p_partkey bigint, p_name string, p_mfgr string, p_brand string, p_type string, p_size bigint, p_container string, p_retailprice double, p_comment string",
    "partsupp": "ps_partkey bigint, ps_suppkey bigint, ps_availqty bigint, ps_supplycost double, ps_comment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority bigint, o_comment string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string",
}


class LoadError(PlanError):
    """What went wrong with a path; the query's result is its text."""

    def __init__(self, message: str):
        super().__init__(f"Load::error: {message}")


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def _first_line(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path).limit(1).collect()
    return rows[0][0] if rows else ""


def read_csv(spark: SparkSession, path: str, columns: list[str], flags: dict[str, Any]) -> DataFrame:
    """A header line, types from the data, ragged rows padded with null. Types come from all rows; (sample share) reads
    that share of them instead, and (schema text) none."""
    reader = spark.read.options(header=bool(flags.get("header", True)), mode="PERMISSIVE", sep=str(flags.get("separator", ",")))
    if "schema" in flags:
        return reader.schema(str(flags["schema"])).csv(path)
    return reader.options(inferSchema=bool(flags.get("infer", True)), samplingRatio=float(flags.get("sample", 1.0))).csv(path)


def read_tbl(spark: SparkSession, path: str, columns: list[str], flags: dict[str, Any]) -> DataFrame:
    """Bars between fields and one after the last. The first line is a header if it has all requested names, or else no number at all; without one the columns are TPC-H's by file stem."""
    line = _first_line(spark, path)
    fields = line.rstrip().removesuffix("|").split("|")
    header = all(c in fields for c in columns) if columns else not any(_number(f) for f in fields)
    header = bool(flags["header"]) if "header" in flags else header
    if header:
        df = spark.read.csv(path, header=True, inferSchema=True, sep="|", mode="PERMISSIVE")
        return df.select(*[named(c) for c in df.columns[: len(fields)]])
    stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
    if stem in TPCH and len(T.StructType.fromDDL(TPCH[stem])) == len(fields):
        schema = T.StructType.fromDDL(TPCH[stem]).add("_rest", T.StringType())
        return spark.read.csv(path, schema=schema, sep="|", mode="PERMISSIVE").drop("_rest")
    df = spark.read.csv(path, header=False, inferSchema=True, sep="|", mode="PERMISSIVE")
    return df.select(*[named(c) for c in df.columns[: len(fields)]])


def read_jdbc(spark: SparkSession, url: str, columns: list[str], flags: dict[str, Any]) -> DataFrame:
    """A table or query of a database by its JDBC URL: (Load url (table name) column …). The other flags are options of
    Spark's source, such as user, driver, partitionColumn with lowerBound, upperBound and numPartitions. Filters and
    columns reach the database; a table has no order."""
    options = {("dbtable" if k == "table" else k): str(v) for k, v in flags.items()}
    if not {"dbtable", "query"} & options.keys():
        raise LoadError(f"{url} needs (table name) or (query text)")
    df = spark.read.format("jdbc").options(url=url, **options).load()
    known = {c.lower(): c for c in df.columns}
    return df.select(*[named(known.get(c.lower(), c)).alias(c) for c in columns]) if columns else df


def _number(s: str) -> bool:
    try:
        float(s)
    except ValueError:
        return False
    return True


def _plain(kind: str) -> Callable[[SparkSession, str, list[str], dict[str, Any]], DataFrame]:
    return lambda spark, path, columns, flags: getattr(spark.read, kind)(path)


#: By extension: (spark, path, columns, flags) to a DataFrame.
FORMATS: dict[str, Callable[[SparkSession, str, list[str], dict[str, Any]], DataFrame]] = {"csv": read_csv, "tbl": read_tbl, "parquet": _plain("parquet"), "orc": _plain("orc"), "json": _plain("json")}

#: Loaders that are asked before the formats, the latest first: (session, path, arguments) to a Relation, to an Expr (the
#: path is left to others, in whole or in part), or None (not mine).
Loader = Callable[[Any, str, list[Any]], Any]


def arguments(args: list[Any]) -> tuple[list[str], dict[str, Any]]:
    """Column names, and flags given as (name value); a whole number given to a flag that wants a truth value counts as one."""
    columns, flags = [], {}
    for a in args:
        if isinstance(a, Expr) and len(a.args) == 1:
            flags[str(a.head)] = a.args[0]
        elif isinstance(a, str):
            columns.append(str(a))
        elif isinstance(a, Expr) and str(a.head) == "List":
            columns += [str(x) for x in a.args]
        else:
            raise PlanError(f"Load takes column names and flags, not {a!r}")
    return columns, flags


def pick(df: DataFrame, columns: list[str], path: str) -> DataFrame:
    if not columns:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise LoadError(f"{path} has no column {', '.join(missing)}")
    return df.select(*map(named, columns))


def load(spark: SparkSession, path: str, args: list[Any]) -> Relation:
    """One file, or all .csv and .tbl files at a directory's top, each tagged with its name. A Parquet or ORC directory is one table."""
    columns, flags = arguments(args)
    try:
        if path.startswith("jdbc:"):
            return Relation(read_jdbc(spark, path, columns, flags))
        fs, p = _fs(spark, path)
        if not fs.exists(p):
            raise LoadError(f"{path} does not exist")
        extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
        if fs.getFileStatus(p).isDirectory() and extension not in FORMATS:
            return load_directory(spark, fs, p, path, columns, flags)
        if extension not in FORMATS:
            raise LoadError(f"{path} has no known format")
        return Relation(pick(FORMATS[extension](spark, path, columns, flags), columns, path), natural=True)
    except LoadError:
        raise
    except Exception as e:
        raise LoadError(f"{path}: {str(e).splitlines()[0][:200]}") from e


def load_directory(spark: SparkSession, fs, p, path: str, columns: list[str], flags: dict[str, Any]) -> Relation:
    found = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().lower().endswith((".csv", ".tbl")))
    if not found:
        return Relation(spark.createDataFrame([], T.StructType([T.StructField(FILE, T.StringType())])), natural=True, symbols=frozenset((FILE,)))
    parts = []
    for name in found:
        full = f"{path.rstrip('/')}/{name}"
        df = FORMATS[name.rsplit(".", 1)[-1].lower()](spark, full, columns, flags)
        # columns that a file lacks are null, also where they are asked for
        df = df.select(*[named(c) if c in df.columns else F.lit(None).alias(c) for c in columns]) if columns else df
        parts.append(df)
    names = list(dict.fromkeys(c for df in parts for c in df.columns))
    kinds = {n: common_type([df.schema[n].dataType for df in parts if n in df.columns]) for n in names}
    parts = [df.select(*[(named(n).cast(kinds[n]) if n in df.columns else F.lit(None).cast(kinds[n])).alias(n) for n in names], F.lit(f).alias(FILE)) for df, f in zip(parts, found)]
    return Relation(reduce(DataFrame.unionByName, parts), natural=True, symbols=frozenset((FILE,)))


def common_type(kinds: list[T.DataType]) -> T.DataType:
    known = [k for k in kinds if not isinstance(k, T.NullType)]
    if not known:
        return T.StringType()
    if all(k == known[0] for k in known):
        return known[0]
    if all(isinstance(k, T.NumericType) for k in known):
        return T.LongType() if all(isinstance(k, T.IntegralType) for k in known) else T.DoubleType()
    return T.StringType()


def leaves_alone(*extensions: str) -> Loader:
    """A loader stage that defers: paths of these kinds stay (Load …) for a later stage."""
    return lambda session, path, args: Expr("Load", path, *args) if path.lower().endswith(extensions) else None
