"""What the operators share: table access, shared storage, batch sizes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows in one Arrow batch. Texts may be long, so batches stay far under Spark's 10,000 rows.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20

#: This package's root, made importable on the executors.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the session's Arrow batches by rows and bytes, and let Python workers import this package.

    Spark reads both bounds when a plan runs, after the operator has returned, so they stay set; smaller ones of the
    caller's are left as they are.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None) or ""
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names, so that other columns can't clash; null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that the cluster shares (spark.checkpoint.dir). Only in local mode may that be unset; then it is a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all its executors share")
        base = getattr(spark.sparkContext, "_quillon_dir", None)
        if base is None:
            base = spark.sparkContext._quillon_dir = tempfile.mkdtemp(prefix="quillon-")
    path = f"{base.rstrip('/')}/quillon-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write to shared storage and read again: lineage ends, nothing is computed twice, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(df: DataFrame) -> None:
    """Remove what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_quillon_path", None)
    if path:
        remove(df.sparkSession, path.rsplit("/", 1)[0])


def per_text(df: DataFrame, fn: Callable[[list[str]], Sequence], schema: str) -> DataFrame:
    """(doc_id, text) to one row per input row: the id as it is, then the columns that fn gives for a batch of texts."""
    kind = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = fn(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(kind)[1:]))], schema=kind)

    return df.mapInArrow(run, schema)


#: What str.split() takes for blanks beyond the six of the contracts.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str) -> list[str]:
    """Runs of anything but the six ASCII blanks. str.split() is faster and the same where no other blank occurs."""
    return NOT_SPACE.findall(text) if ODD_SPACE.search(text) else text.split()
