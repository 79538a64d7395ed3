"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept, and all but the last return the columns of `documents`:

1. quality: documents that the rules or the isolation forest reject go.
2. near_duplicates: of each group of SimHash neighbours the document of the smallest id stays.
3. decontamination: documents that hold a benchmark window go.
4. secrets: found secrets are replaced by a mark of their kind, and n_chars follows the text.
5. packing: what is left is laid along the Hilbert curve and cut into sequences.

An empty table passes through all stages; what each does with nulls, ties and repeated rows is in its operator's module.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import materialize, table
from quillon.llm.decontam import clean_rows
from quillon.llm.packing import pack
from quillon.llm.quality import quality_rules
from quillon.llm.secrets import redact_secrets
from quillon.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs, table(spark, sf_dir, "labels"), keep_columns=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_rows(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: The forest, the tokenizer and the curve are beyond SQL; tests/llm/test_pipeline.py holds the stages against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
