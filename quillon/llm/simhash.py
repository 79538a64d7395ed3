"""Near-duplicates by SimHash, linked by meet-in-the-middle ball hashing (operator 4).

Fingerprints that differ in at most RADIUS = 3 bits are linked. Every fingerprint emits all variants within half the
radius: one side of a pair moves one bit and the other two, so each emits its ball of radius 1 (65 variants) and, since
two of any three bits lie in one half of the word, those two-bit variants whose bits share a half (992). Pairs meet on
a common variant. Fingerprints within one bit of a variant are within two of each other, and one within two bits is
within three of those, so each meeting links its members to its smallest one-bit member: every link is right by
construction, and no pairs within a group are formed. A variant can only have as many members as its ball has points,
so no variant is a hot key. Two joins have keys that may be hot: the block keys of the filter, which distinct
fingerprints share where texts are alike, and the fingerprints when they are joined back to rows, which all copies of a
text share. Both join many narrow rows to one row a key, and adaptive execution splits the many.

Exact copies share a fingerprint and are collapsed before anything else. Ahead of the balls an exact filter leaves out
fingerprints that can have no partner: of BLOCKS = 6 blocks, three bits can touch three, so partners agree on three
blocks at least, and a fingerprint that shares no such triple with another has none.

Defined cases: null or empty text has fingerprint zero and is linked like any other; texts of fewer than three words
have their whole sequence for a shingle; repeated rows each get their row; a null id gets a row, and takes no part in
the smallest id; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import id_text, materialize, per_text, prepare
from .graph import connected_components

WORDS = 3
SEED = 42
RADIUS = 3
BLOCKS = 6
#: Shingles of a text that are hashed and counted at a time.
SLICE = 1 << 15
HALVES = (range(32), range(32, 64))


def fingerprints(texts: list[str], words: int = WORDS) -> np.ndarray:
    """The SimHash of each text, as unsigned 64-bit numbers. bytes.lower() and bytes.split() touch ASCII letters and the six ASCII blanks only."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), dtype=np.uint64)
    for d, text in enumerate(texts):
        parts = text.encode("utf-8", "surrogatepass").lower().split()
        if not parts:
            continue
        norm = b" ".join(parts)
        if len(parts) >= words:
            ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
            starts, stops = [0, *ends[:-words].tolist()], (ends[words - 1 :] - 1).tolist()
        else:
            starts, stops = [0], [len(norm)]
        votes = np.zeros(64, dtype=np.int64)
        for i in range(0, len(starts), SLICE):
            h = np.array([digest(norm[a:b], SEED) for a, b in zip(starts[i : i + SLICE], stops[i : i + SLICE])], dtype=np.uint64)
            votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[d] = np.packbits(2 * votes > len(starts), bitorder="little").view(np.uint64)[0]
    return out


def masks() -> list[int]:
    """The emitted variants' differences, as signed 64-bit numbers; the first 65 have one bit at most."""
    bits = [[], *([i] for i in range(64)), *(list(p) for half in HALVES for p in combinations(half, 2))]
    return [int(np.array(sum(1 << i for i in b), dtype=np.uint64).view(np.int64)) for b in bits]


def block_keys(fp: Column) -> Column:
    """For each triple of blocks a hash of their bits and of which they are."""
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    mask = [int(np.array(sum(1 << b for b in range(lo, hi)), dtype=np.uint64).view(np.int64)) for lo, hi in zip(edges, edges[1:])]
    whole = [sum(mask[i] & 0xFFFFFFFFFFFFFFFF for i in c) for c in combinations(range(BLOCKS), BLOCKS - RADIUS)]
    signed = [int(np.array(m, dtype=np.uint64).view(np.int64)) for m in whole]
    return F.array(*[F.xxhash64(fp.bitwiseAND(F.lit(m)), F.lit(i)) for i, m in enumerate(signed)])


def links(points: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to edges (a, b) whose components are those of all pairs within RADIUS."""
    keyed = points.select("fp", F.explode(block_keys(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    able = materialize(keyed.join(shared, "key", "left_semi").select("fp").distinct())
    # each fingerprint becomes about a thousand rows, so few bytes of them are work for many tasks
    able = able.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    ms = masks()
    near = F.transform(F.array(*[F.lit(m) for m in ms[:65]]), lambda m: m.bitwiseXOR(F.col("fp")))
    ball = F.transform(F.array(*[F.lit(m) for m in ms]), lambda m: m.bitwiseXOR(F.col("fp")))
    centre = able.select("fp", F.explode(near).alias("v")).groupBy("v").agg(F.min("fp").alias("centre"))
    met = able.select("fp", F.explode(ball).alias("v")).join(centre.hint("shuffle_hash"), "v").where("fp <> centre")
    out = materialize(met.select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct())
    return out


def rooted(rows: DataFrame, least: Column) -> DataFrame:
    """(fp, least, root): each distinct fingerprint of the rows, what least says of its rows, and its component."""
    points = materialize(rows.groupBy("fp").agg(least.alias("least")))
    roots = connected_components(links(points.select("fp")))
    return materialize(points.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id."""
    prepare(docs.sparkSession)
    rows = materialize(per_text(id_text(docs, id_col, text_col), lambda texts: [fingerprints(texts).view(np.int64)], "doc_id long, fp long"))
    linked = rooted(rows, F.min("doc_id"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows without near-duplicates: of each group exactly one row stays.

    It is that of the smallest id, null ids last; of rows of that id the one whose text has the smallest SHA-256, null
    first; of those the one of the smallest hash of all columns that aren't maps. Null and empty texts form one group;
    rows of null ids are told apart by their text, so they meet under no single key; the names of helper columns are
    made so that no column of the input has them; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    number, digest = F.col(id_col).cast("long"), F.coalesce(F.sha2(text_col, 256), F.lit(""))
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array(fingerprints(batch.column(3).to_pylist()).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], fp], ["doc_id", "digest", "tie", "fp"])

    texts = docs.select(number.alias("doc_id"), digest.alias("digest"), tie.alias("tie"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialize(texts.mapInArrow(run, "doc_id long, digest string, tie long, fp long"))
    # a row is known by its id, whether that is null, its text's digest and the hash of all, so one shuffle serves the join and the removal of repeated rows
    names = [f"quillon_{uuid.uuid4().hex}" for _ in range(4)]
    key = lambda i, d, t: [c.alias(n) for c, n in zip((F.coalesce(i, F.lit(0)), i.isNull(), d, t), names)]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "tie"))
    stay = rooted(rows, least).groupBy("root").agg(F.min("least").alias("least")).select(*key(*(F.col(f"least.{c}") for c in ("doc_id", "digest", "tie"))))
    return docs.select("*", *key(number, digest, tie)).join(stay, names, "left_semi").dropDuplicates(names).select(*[f"`{c}`" for c in docs.columns])
