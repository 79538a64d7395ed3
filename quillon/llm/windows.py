"""Which windows of a given length occur twice or more in a corpus: what operators 6 and 9 share.

A document is a sequence of units (bytes or words), a window `size` consecutive units. Positions are sampled so that
equal windows are sampled at equal places: of the size - gram + 1 grams inside a window the one of the least hash, the
leftmost of equals. Runs of windows with the same sampled gram form a piece. Names are given by sorting:

1. the sampled grams and, over them, the pieces: their hashes are dealt by hash to buckets and sorted there, and
   adjacent ones compared. A gram that occurs once rules out all windows around it. A whole piece that occurs twice
   settles all its windows at once; one of its copies still goes on, for the others to be compared with.
2. the windows left, at the edges of repeated passages, are dealt by their own hash, sorted and compared.

3. what recurs is then known by window. Operator 6 removes what those windows cover; operator 9 makes phrases of them
   and leaves the rest to automata (phrases.py).

Every chunk of documents sends each distinct value once, so a value that fills the corpus costs one entry a chunk, and
gets its answer back in the order it asked in: positions are never shuffled. A bucket hears FAN chunks at most: where
there are more, parts of the chunks condense what they ask to distinct values, and hand the answers on. Text is written once, as compressed
chunks bucketed by chunk, so joining the answers moves only the answers.

Windows are told apart by 96 bits: a 64-bit hash of theirs and 32 bits of their gram's.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize, prepare, remove, shared_dir

CHUNK_BYTES = 2 << 20
#: What a row counts for besides its text, so that rows without text fill chunks too.
ROW_BYTES = 64
TASK_BYTES = 32 << 20
WIDE = 16 << 30
BLOCK_UNITS = 1 << 19
SEGMENT = 1 << 22
INDEX_BITS = 24
BUCKET_BYTES = 16 << 20
FAN = 1 << 16
NONE, ALONE, FIRST, AGAIN = 0, 1, 2, 3

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        m = max(n, BLOCK_UNITS + 4096)
        for i, b in enumerate((BASE, BASE_INVERSE)):
            x = np.full(m, b, U)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by running minima inside blocks of w."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(U).max, U)]) if pad else x
    y = y.reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


@dataclass
class Pieces:
    """The pieces of a block: place of the gram, first and last window, hashes of gram and piece; prefix sums for window hashes."""

    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    gram: np.ndarray
    piece: np.ndarray
    prefix: np.ndarray
    size: int

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of the given pieces, and the piece of each."""
        n = self.hi[which] - self.lo[which] + 1
        of = np.repeat(which, n)
        return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.lo[which], n), of

    def hashes(self, starts: np.ndarray) -> np.ndarray:
        inverse = powers(len(self.prefix))[1]
        return mix((self.prefix[starts + self.size] - self.prefix[starts]) * inverse[starts])


def pieces(values: np.ndarray, sizes: list[int], size: int, gram: int) -> Pieces:
    """values: 64-bit values of the units of several segments, one after another; windows never cross segments."""
    n = len(values)
    empty = np.zeros(0, np.int64)
    if n < size:
        return Pieces(empty, empty, empty, empty.astype(U), empty.astype(U), np.zeros(1, U), size)
    power, inverse = powers(n + 1)
    prefix = np.zeros(n + 1, U)
    np.cumsum(values * power[:n], out=prefix[1:])
    h = mix((prefix[gram:] - prefix[:-gram]) * inverse[: n - gram + 1])
    low = U((1 << INDEX_BITS) - 1)
    packed = (h & ~low) | np.arange(len(h), dtype=U)
    least = (sliding_min(packed, size - gram + 1) & low).astype(np.int64)
    ok = np.zeros(n - size + 1, dtype=bool)
    at = 0
    for s in sizes:
        if s >= size:
            ok[at : at + s - size + 1] = True
        at += s
    v = np.nonzero(ok)[0]
    if not len(v):
        return Pieces(empty, empty, empty, empty.astype(U), empty.astype(U), prefix, size)
    m = least[v]
    cut = np.nonzero((m[1:] != m[:-1]) | (v[1:] != v[:-1] + 1))[0]
    first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(v) - 1]])
    lo, hi, where = v[first], v[last], m[first]
    form = mix(((where - lo).astype(U) << U(32)) | (hi - lo).astype(U))
    whole = mix((prefix[hi + size] - prefix[lo]) * inverse[lo] ^ form)
    # the sampled hashes are small ones, so they are mixed again to fill all buckets alike
    return Pieces(where, lo, hi, mix(h[where] + BASE), whole, prefix, size)


@dataclass(frozen=True)
class Scheme:
    """units: the values of a text's units; size and gram in units."""

    units: Callable[[bytes], np.ndarray]
    size: int
    gram: int


def blocks(texts: list[bytes], scheme: Scheme) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray]]:
    """Runs of segments (document, first unit, units) with their values. A segment has SEGMENT window starts at most and overlaps the next by size - 1 units."""
    held: list[tuple[int, int, int]] = []
    values: list[np.ndarray] = []
    total = 0
    for d, text in enumerate(texts):
        x = scheme.units(text)
        for s in range(0, max(1, len(x) - scheme.size + 1), SEGMENT):
            part = x[s : s + SEGMENT + scheme.size - 1]
            if total and total + len(part) > BLOCK_UNITS:
                yield held, np.concatenate(values)
                held, values, total = [], [], 0
            held.append((d, s, len(part)))
            values.append(part)
            total += len(part)
    if held:
        yield held, np.concatenate(values)


def distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of keys, the first being the major: places of the distinct ones in order, the distinct one of each row, and which occur again."""
    n = len(keys[0])
    order = np.lexsort(keys[::-1])
    new = np.ones(n, dtype=bool)
    if n > 1:
        new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    of = np.empty(n, np.int32)
    of[order] = np.cumsum(new) - 1
    starts = np.nonzero(new)[0]
    return order[starts], of, np.diff(np.append(starts, n)) > 1


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with h, so that values sorted by h are sorted by bucket."""
    return ((h >> U(32)) * U(buckets)) >> U(32)


def dealt(chunk: int, bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """Rows (bucket, chunk, packed columns) of values that are sorted by bucket."""
    if not len(bucket):
        return
    cuts = np.nonzero(bucket[1:] != bucket[:-1])[0] + 1
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
        yield int(bucket[s]), chunk, b"".join(c[s:e].tobytes() for c in columns)


def gathered(blobs: list[bytes], kinds: list[np.dtype]) -> list[np.ndarray]:
    width = sum(k.itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for b in blobs:
        n, at = len(b) // width, 0
        for i, k in enumerate(kinds):
            out[i].append(np.frombuffer(b, k, n, at))
            at += n * k.itemsize
    return [np.concatenate(x) for x in out]


FLAG, WORD64 = np.dtype(np.uint8), np.dtype(U)
PIECE, SPOT = [WORD64, WORD64, FLAG], [WORD64, np.dtype(np.uint32), FLAG]


def held_by(group: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each value asked for the first and the last chunk that has it, as far as the rows know: a chunk itself, or what parts of the chunks noted."""
    low, high = [], []
    for chunk, blob, noted in zip(group.chunk, group["values"], group.holders):
        n = len(blob) // width
        x = np.frombuffer(noted, np.int64).reshape(2, n) if noted is not None else np.full((2, n), chunk, np.int64)
        low.append(x[0])
        high.append(x[1])
    return np.concatenate(low), np.concatenate(high)


def extremes(group: pd.DataFrame, width: int, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n distinct values the first and last chunk."""
    low, high = held_by(group, width)
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
    np.minimum.at(first, of, low)
    np.maximum.at(last, of, high)
    return first, last


def answer_pieces(group: pd.DataFrame, tell: bool) -> pd.DataFrame:
    """All grams and pieces of a bucket: by sorting, what each chunk's ones are. Chunks are taken in order, so the first copy is the same in every attempt."""
    group = group.sort_values("chunk")
    gram, piece, flags = gathered(group["values"].tolist(), PIECE)
    first, of, more = distinct(gram, piece)
    more |= np.bincount(of, flags & 1, len(first)) > 0
    _, g, gs = distinct(gram[first])
    often = np.bincount(of, flags > 1, len(first)) > 0
    repeated = (gs | (np.bincount(g, more | often, len(gs)) > 0))[g]
    code = np.where(repeated, np.where(more, AGAIN, ALONE), NONE).astype(np.uint8)[of]
    lead = first[more & repeated]
    code[lead] = FIRST
    return replies(group, code, 17, [x[of] for x in extremes(group, 17, of, len(first))] if tell else None)


def answer_windows(group: pd.DataFrame, tell: bool) -> pd.DataFrame:
    """All open windows of a bucket: which occur twice."""
    group = group.sort_values("chunk")
    value, gram, again = gathered(group["values"].tolist(), SPOT)
    _, of, more = distinct(value, gram)
    more |= np.bincount(of, again, len(more)) > 0
    return replies(group, more[of].astype(np.uint8), 13, [x[of] for x in extremes(group, 13, of, len(more))] if tell else None)


def replies(group: pd.DataFrame, code: np.ndarray, width: int, holders: list[np.ndarray] | None) -> pd.DataFrame:
    """The codes of each row's values and, where wanted, their first and last chunk, of values that occur once 0."""
    ends = np.cumsum([len(b) // width for b in group["values"]]).tolist()
    cuts = list(zip([0, *ends], ends))
    noted: list[bytes | None] = [None] * len(cuts)
    if holders is not None:
        low, high = (np.where(code != NONE, x, 0) for x in holders)
        noted = [zstandard.compress(low[s:e].tobytes() + high[s:e].tobytes(), 1) for s, e in cuts]
    return pd.DataFrame({"chunk": group.chunk, "bucket": group.bucket, "codes": [zstandard.compress(code[s:e].tobytes(), 1) for s, e in cuts], "holders": noted})


def settled(asked: DataFrame, answer: Callable[[pd.DataFrame, bool], pd.DataFrame], kinds: list[np.dtype], chunks: int, tell: bool) -> DataFrame:
    """The answers to all chunks. kinds: of the two columns that tell values apart, and of the flags; tell: also which chunks have a value."""
    if chunks <= FAN:
        return asked.groupBy("home", "bucket").applyInPandas(lambda group: answer(group, tell), ANSWER)
    parts = -(-chunks // FAN)
    width = sum(k.itemsize for k in kinds)
    asked = materialize(asked.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts))))

    def condense(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        a, b, flags = gathered(group["values"].tolist(), kinds)
        first, of, more = distinct(a, b)
        again, often = more | (np.bincount(of, flags & 1, len(first)) > 0), np.bincount(of, flags > 1, len(first)) > 0
        columns = a[first], b[first], again.astype(np.uint8) + 2 * often.astype(np.uint8)
        noted = b"".join(x.tobytes() for x in extremes(group, width, of, len(first)))
        return pd.DataFrame({"bucket": group.bucket[:1], "chunk": group.part[:1], "values": [b"".join(c.tobytes() for c in columns)], "holders": [noted], "home": group.home[:1]})

    def spread(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        a, b, _ = gathered(group["values"].tolist(), kinds)
        first, of, _ = distinct(a, b)
        mine = np.frombuffer(zstandard.decompress(answers.codes.iloc[0]), np.uint8)
        code = np.where(mine == FIRST, AGAIN, mine).astype(np.uint8)[of]
        code[first[mine == FIRST]] = FIRST
        noted = np.frombuffer(zstandard.decompress(answers.holders.iloc[0]), np.int64).reshape(2, -1)[:, of] if tell else None
        return replies(group, code, width, noted)

    condensed = settled(asked.groupBy("bucket", "part").applyInPandas(condense, ASKED), answer, kinds, parts, tell)
    condensed = condensed.withColumnRenamed("chunk", "part")
    return asked.groupBy("bucket", "part").cogroup(condensed.groupBy("bucket", "part")).applyInPandas(spread, ANSWER)


def told(answers: list | None) -> np.ndarray:
    """The codes of a chunk, in the order of its values."""
    parts = sorted((a["bucket"], a["codes"]) for a in answers or ())
    return np.frombuffer(b"".join(zstandard.decompress(c) for _, c in parts), np.uint8)


def elsewhere(answers: list | None, chunk: int) -> np.ndarray:
    """In the same order a chunk that has the value, another one than this if there is such."""
    parts = sorted((a["bucket"], a["holders"]) for a in answers or ())
    both = [np.frombuffer(zstandard.decompress(h), np.int64).reshape(2, -1) for _, h in parts]
    low, high = np.concatenate(both, axis=1) if both else np.zeros((2, 0), np.int64)
    return np.where(low != chunk, low, high)


ASKED = "bucket long, chunk long, values binary, holders binary, home long"
ANSWER = "chunk long, bucket long, codes binary, holders binary"


def tasks(size: int, least: int) -> int:
    """Tasks for so many bytes of text: TASK_BYTES each, and more beyond WIDE bytes, by the root of how much, so that their number stays in hand."""
    return max(least, math.ceil(size / (TASK_BYTES * max(1.0, math.sqrt(size / WIDE)))))


def spark_hash(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """What Spark's hash() gives for longs, by which bucketed tables and shuffles deal rows."""
    x = x.astype(np.int64)
    rotate = lambda v, n: (v << np.uint32(n)) | (v >> np.uint32(32 - n))
    h = np.full(len(x), seed, np.uint32)
    for half in (x & 0xFFFFFFFF, x >> 32 & 0xFFFFFFFF):
        k = rotate(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = rotate(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).astype(np.int32)


def numbers(task: int, parts: int) -> Iterator[tuple[int, int]]:
    """Chunk numbers of a task with their buckets, for ever. A task fills few buckets, of which tasks in a row begin evenly apart; send(True) moves on to the next one."""
    at, bucket = task << 33, int(task * 0.6180339887498949 % 1 * parts)
    while True:
        ahead = np.arange(at, at + 4 * parts + 64)
        for hit in ahead[spark_hash(ahead) % parts == bucket].tolist():
            at = hit + 1
            if (yield hit, bucket):
                bucket = (bucket + 1) % parts
                break
        else:
            at = int(ahead[-1]) + 1


def homes(parts: int) -> np.ndarray:
    """For each of so many tasks a number that Spark's hash deals to it."""
    at, out = 0, np.full(parts, -1, np.int64)
    while (out < 0).any():
        ahead = np.arange(at, at + 4 * parts + 64)
        out[(spark_hash(ahead) % parts)[::-1]] = ahead[::-1]
        at += len(ahead)
    return out


class Corpus:
    """The documents as compressed chunks in shared storage, bucketed by chunk. close() takes the table out of the catalog and its files away."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        spark = prepare(docs.sparkSession)
        rows = id_text(docs, id_col, text_col)
        whole = rows.agg(F.sum(F.octet_length("text").cast("long") + ROW_BYTES).alias("size")).first()
        self.tasks = parts = tasks(whole["size"] or 0, spark.sparkContext.defaultParallelism)
        self.size, self.homes = whole["size"] or 0, homes(parts)

        def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids: list = []
            texts: list[bytes] = []
            held = filled = 0
            numbered = numbers(TaskContext.get().partitionId(), parts)
            chunk = next(numbered)[0]

            def out() -> pa.RecordBatch:
                raw = zstandard.compress(b"".join(texts), 3)
                return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([raw], pa.binary()), pa.array([chunk], pa.int64())], ["ids", "lengths", "raw", "chunk"])

            for batch in batches:
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                    ids.append(i)
                    texts.append(t)
                    held += len(t) + ROW_BYTES
                    if held >= CHUNK_BYTES:
                        yield out()
                        filled += held
                        chunk = numbered.send(filled >= TASK_BYTES // 2)[0]
                        filled %= TASK_BYTES // 2
                        ids, texts, held = [], [], 0
            if ids:
                yield out()

        chunks = rows.mapInArrow(bundle, "ids array<long>, lengths array<long>, raw binary, chunk long")
        self.name = f"quillon_{uuid.uuid4().hex}"
        self.path = shared_dir(spark)
        chunks.write.option("path", f"{self.path}/t").option("compression", "none").bucketBy(parts, "chunk").saveAsTable(self.name)
        self.table = spark.table(self.name)
        self.chunks = self.table.count()

    def close(self) -> None:
        spark = self.table.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(spark, self.path)

    def ask(self, rows: DataFrame, fn: Callable, extra: list[str]) -> DataFrame:
        """Run fn(chunk, texts, *extra) over the chunks; it yields rows (bucket, chunk, values), which are dealt by bucket, in turn to all tasks."""
        home, parts = self.homes, self.tasks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    got = list(fn(batch.column("chunk")[i].as_py(), unpack(batch, i), *(batch.column(c)[i].as_py() for c in extra)))
                    b, c, v = zip(*got) if got else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(v, pa.binary()), pa.nulls(len(b), pa.binary()), pa.array(home[np.array(b, np.int64) % parts], pa.int64())], ["bucket", "chunk", "values", "holders", "home"])

        return rows.select("chunk", "lengths", "raw", *extra).mapInArrow(run, ASKED).repartition(self.tasks, "home")

    def collect(self, answers: DataFrame, name: str) -> DataFrame:
        """One row a chunk: as many answers as it asked buckets, so no more than its values. Dealt as the chunks are, so they meet without moving text."""
        return answers.repartition(self.tasks, "chunk").groupBy("chunk").agg(F.collect_list(F.struct(*(c for c in answers.columns if c != "chunk"))).alias(name))

    def noted(self, collected: DataFrame) -> DataFrame:
        """Answers in shared storage. They are far smaller than the texts, so few tasks write them."""
        return materialize(collected.coalesce(max(1, self.tasks // 4)))

    def with_answers(self, rows: DataFrame, collected: DataFrame) -> DataFrame:
        return rows.join(collected.repartition(self.tasks, "chunk").hint("merge"), "chunk", "left")


def unpack(batch: pa.RecordBatch, i: int) -> list[bytes]:
    raw = zstandard.decompress(batch.column("raw")[i].as_py())
    ends = np.cumsum(batch.column("lengths")[i].as_py(), dtype=np.int64).tolist()
    return [raw[s:e] for s, e in zip([0, *ends], ends)]


class Chunk:
    """One chunk's pieces, in the same order in every pass."""

    def __init__(self, texts: list[bytes], scheme: Scheme):
        self.scheme, self.segments, self.parts = scheme, [], []
        for held, values in blocks(texts, scheme):
            self.segments.append(held)
            self.parts.append(pieces(values, [n for _, _, n in held], scheme.size, scheme.gram))
        none = np.zeros(0, U)
        self.gram = np.concatenate([p.gram for p in self.parts] or [none])
        self.piece = np.concatenate([p.piece for p in self.parts] or [none])
        self.first, self.of, self.again = distinct(self.gram, self.piece)

    def questions(self, buckets: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The order of the questions, their buckets, and (gram, piece, flags) of each.

        Distinct pieces come first. A gram that the chunk has once meets its like in the gram's bucket, at most once a
        chunk. One that it has more often is known to be repeated, and its pieces are dealt by themselves, so a gram
        with contexts without end fills no bucket; a further entry tells the gram's bucket that it is repeated. A
        piece that comes both ways is compared window by window.
        """
        gram, piece = self.gram[self.first], self.piece[self.first]
        places, g, more = distinct(gram)
        many = more | (np.bincount(g, self.again, len(more)) > 0)
        often = many[g]
        marks = gram[places[many]]
        bucket = bucket_of(np.concatenate([np.where(often, piece, gram), marks]), buckets)
        gram, piece = np.concatenate([gram, marks]), np.concatenate([piece, np.zeros(len(marks), U)])
        flags = np.concatenate([self.again + 2 * often.astype(np.uint8), np.full(len(marks), 2)]).astype(np.uint8)
        order = np.lexsort((piece, gram, bucket))
        return order, bucket[order], [gram[order], piece[order], flags[order]]

    def by_block(self, told: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
        """What is told in the order of the questions, by block for its pieces."""
        mine = np.zeros(len(order), told.dtype)
        if len(mine):
            mine[order] = told
        flat = mine[self.of] if len(self.of) else mine[:0]
        cuts = np.cumsum([len(p.gram) for p in self.parts])[:-1]
        return np.split(flat, cuts) if self.parts else []

    def codes(self, answers: list | None, buckets: int) -> list[np.ndarray]:
        """By block the codes of its pieces."""
        return self.by_block(told(answers), self.questions(buckets)[0])

    def open_windows(self, codes: list[np.ndarray]):
        """Starts, blocks and pieces of the windows to compare, their hashes and those of their grams, and distinct() of both."""
        starts, where, owner, gram, value = [], [], [], [], []
        for b, (p, c) in enumerate(zip(self.parts, codes)):
            s, of = p.windows(np.nonzero((c == ALONE) | (c == FIRST))[0])
            starts.append(s.astype(np.int32))
            where.append(np.full(len(s), b, np.int32))
            owner.append(of.astype(np.int32))
            gram.append((p.gram[of] >> U(32)).astype(np.uint32))
            value.append(p.hashes(s))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        gram, value = cat(gram, np.uint32), cat(value, U)
        return cat(starts, np.int32), cat(where, np.int32), cat(owner, np.int32), value, gram, distinct(value, gram)

    def recurring(self, answers: list | None, wide_answers: list | None, buckets: int, chunk: int | None = None) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """By block, at which units a window starts that occurs twice or more in the corpus; given the chunk's number also a chunk that has it, another one if there is such."""
        codes = self.codes(answers, buckets)
        starts, where, _, _, _, (_, of, _) = self.open_windows(codes)
        bits = told(wide_answers)
        hit = bits[of] == 1 if len(of) else np.zeros(0, dtype=bool)
        if chunk is not None:
            piece_at, window_at = self.by_block(elsewhere(answers, chunk), self.questions(buckets)[0]), elsewhere(wide_answers, chunk)
        out = []
        for b, (held, p, code) in enumerate(zip(self.segments, self.parts, codes)):
            on = np.zeros(sum(n for *_, n in held), dtype=bool)
            at, of_piece = p.windows(np.nonzero(code >= FIRST)[0])
            on[at] = True
            mine = hit & (where == b)
            on[starts[mine]] = True
            other = None
            if chunk is not None:
                other = np.zeros(len(on), np.int64)
                other[at] = piece_at[b][of_piece]
                other[starts[mine]] = window_at[of[mine]]
            out.append((on, other))
        return out


def asked(corpus: Corpus, scheme: Scheme, tell: bool = False) -> tuple[DataFrame, int]:
    """The chunks, each with what the corpus answers on its pieces and its open windows, and how many buckets of pieces there are; tell: also which chunks have a value."""
    # 17 bytes for about two pieces in each (size - gram + 2) units; 13 for each window at most
    many = max(1, -(-corpus.size * 34 // ((scheme.size - scheme.gram + 2) * BUCKET_BYTES)))
    wide = max(1, -(-corpus.size * 13 // (4 * BUCKET_BYTES)))

    def ask_pieces(chunk: int, texts: list[bytes]):
        c = Chunk(texts, scheme)
        _, bucket, columns = c.questions(many)
        yield from dealt(chunk, bucket, columns)

    def ask_windows(chunk: int, texts: list[bytes], answers):
        c = Chunk(texts, scheme)
        *_, value, gram, (first, _, again) = c.open_windows(c.codes(answers, many))
        yield from dealt(chunk, bucket_of(value[first], wide), [value[first], gram[first], again.astype(np.uint8)])

    first = settled(corpus.ask(corpus.table, ask_pieces, []), answer_pieces, PIECE, corpus.chunks, tell)
    first = corpus.noted(corpus.collect(first, "pieces"))
    rows = corpus.with_answers(corpus.table, first)
    second = settled(corpus.ask(rows, ask_windows, ["pieces"]), answer_windows, SPOT, corpus.chunks, tell)
    second = corpus.noted(corpus.collect(second, "windows"))
    return corpus.with_answers(rows, second), many


def repeated_units(docs: DataFrame, scheme: Scheme, finish: Callable[[bytes, np.ndarray], tuple], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, then finish(text, mask of units that repeated windows cover)."""
    corpus = Corpus(docs, id_col, text_col)
    rows, many = asked(corpus, scheme)
    names = [f.split()[0] for f in schema.split(", ")]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts = unpack(batch, i)
                c = Chunk(texts, scheme)
                masks: dict[int, np.ndarray] = {}
                for held, (begin, _) in zip(c.segments, c.recurring(batch.column("pieces")[i].as_py(), batch.column("windows")[i].as_py(), many)):
                    total = np.concatenate([np.zeros(scheme.size, np.int64), np.cumsum(begin)])
                    on, at = total[scheme.size :] > total[: -scheme.size], 0
                    for d, s, n in held:
                        if d in masks:  # a further segment of a long document
                            old = masks[d]
                            grown = np.zeros(s + n, dtype=bool)
                            grown[: len(old)] = old
                            grown[s:] |= on[at : at + n]
                            masks[d] = grown
                        else:
                            masks[d] = on[at : at + n]
                        at += n
                got = [finish(t, masks[d]) for d, t in enumerate(texts)]
                columns = list(zip(*got)) if got else [[]] * (len(names) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("ids")[i].as_py(), pa.int64()), *map(pa.array, columns)], names)

    # the result is small, so it is written and the chunks go at once
    out = materialize(rows.select("ids", "lengths", "raw", "pieces", "windows").mapInArrow(close, schema))
    corpus.close()
    return out
