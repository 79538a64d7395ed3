"""The difference-cover algorithm for operator 6 in full, as a second method of remove_substrings().

Positions of a document whose distance to its start is 1 or 2 modulo 3 are sampled. Triples of symbols at sampled
positions are sorted and named in that order; the names are the symbols of the next round, whose triples reach three
times as far, until names stand for REACH = 198 bytes. A step of any multiple of 3 keeps a position sampled, so the
names that a triple joins are always there. The remaining suffixes, and all others, are merged through the cover: of
two suffixes one shift of 0, 1 or 2 bytes takes both to sampled positions, so each suffix enters once for each of its
two shifts, as the bytes before the sampled position, its name and the bytes after it, 200 bytes together. Sorted
neighbours of the same entry are equal prefixes.

Names are given by sorting distinct triples over ranges: the sort's row ids rise with the triples, so no rank needs
one task. It is exact, without hashes; but each of the five rounds sorts and joins two rows for every three bytes, so
it isn't the default: see the README for figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_text, materialize, prepare
from .substrings import SCHEMA, SIZE, kept_bytes

STEPS = (3, 9, 27, 81)
REACH = 198


def sampled(rows: DataFrame) -> DataFrame:
    """(row, at, b0, b1, b2) of the sampled positions of texts that have room for a whole prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                x = np.frombuffer(text, np.uint8).astype(np.int64)
                if len(x) < SIZE:
                    continue
                at = np.nonzero(np.arange(len(x) - 2) % 3 != 0)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row)), pa.array(at), *(pa.array(x[at + i]) for i in range(3))], ["row", "at", "b0", "b1", "b2"])

    return rows.select("row", "text").mapInArrow(run, "row long, at long, b0 long, b1 long, b2 long")


def named_triples(triples: DataFrame) -> DataFrame:
    """(row, at, b0, b1, b2) to (row, at, name): equal names for equal triples, in their order."""
    order = triples.select("b0", "b1", "b2").distinct().orderBy("b0", "b1", "b2")
    names = materialize(order.withColumn("name", F.monotonically_increasing_id()))
    return materialize(triples.join(names, ["b0", "b1", "b2"]).select("row", "at", "name"))


def reach_further(names: DataFrame, one: int, two: int) -> DataFrame:
    """The triples of the names at a position and one and two units of bytes further; positions without them drop out."""
    later = lambda d, c: names.select("row", (F.col("at") - d).alias("at"), F.col("name").alias(c))
    return names.withColumnRenamed("name", "b0").join(later(one, "b1"), ["row", "at"]).join(later(two, "b2"), ["row", "at"])


def repeated_positions(rows: DataFrame) -> DataFrame:
    """(row, text) to (row, start) of every SIZE-byte string that starts elsewhere too."""
    names = named_triples(sampled(rows))
    for step in STEPS[:-1]:
        old, names = names, named_triples(reach_further(names, step, 2 * step))
        discard(old)
    # three names of 81 bytes cover REACH, the last overlapping the one before
    old, names = names, named_triples(reach_further(names, STEPS[-1], REACH - STEPS[-1]))
    discard(old)

    def rims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                x = np.frombuffer(text, np.uint8).astype(np.int64)
                for shift in (0, 1, 2):
                    start = np.arange(max(0, len(x) - SIZE + 1))
                    start = start[(start + shift) % 3 != 0]
                    rim = np.full(len(start), shift)
                    for k in (*range(shift), *range(shift + REACH, SIZE)):
                        rim = rim * 256 + x[start + k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), row)), pa.array(start + shift), pa.array(rim), pa.array(start)], ["row", "at", "rim", "start"])

    entries = rows.select("row", "text").mapInArrow(rims, "row long, at long, rim long, start long").join(names, ["row", "at"])
    entries = materialize(entries.select("row", "start", "rim", "name"))
    again = entries.groupBy("rim", "name").agg(F.count("*").alias("n")).where("n > 1").select("rim", "name")
    return entries.join(again, ["rim", "name"], "left_semi").select("row", "start").distinct()


def remove_by_difference_cover(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The result of substrings.remove_substrings(), with the same defined cases."""
    prepare(docs.sparkSession)
    rows = materialize(id_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    starts = repeated_positions(rows).groupBy("row").agg(F.collect_list("start").alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                edge = np.zeros(len(text) + 1, np.int64)
                if found:
                    np.add.at(edge, np.array(found), 1)
                    np.add.at(edge, np.array(found) + SIZE, -1)
                out.append(kept_bytes(text, np.cumsum(edge)[: len(text)] > 0))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], [f.split()[0] for f in SCHEMA.split(", ")])

    return rows.join(starts, "row", "left").select("doc_id", "text", "starts").mapInArrow(run, SCHEMA)
