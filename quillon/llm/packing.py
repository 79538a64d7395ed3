"""Packing in space-filling-curve order (operator 5).

A document's tokens are hashed into BUCKETS counts; the damped, normalised vector is projected to DIMS dimensions and
its cell on the Hilbert curve is the sort key. Documents are range-sorted by key, laid end to end along the curve and
cut into sequences of LENGTH tokens, so neighbours in a sequence are neighbours in content, and only the last sequence
is short. Positions come from the totals of the ranges, one number each, and running sums inside a range.

Tokens are written once to shared storage as 16-bit numbers; ordering touches only row, key and length.

Tokenizing goes blank by blank: this vocabulary drops white space, splits at it and normalises without crossing it, so
a text's ids are those of its blank-separated parts, which are kept in a bounded memory.

Defined cases: null text is empty, and an empty text is the end id alone; equal keys are ordered by doc_id, then by
row; repeated rows are packed each; a null id is packed like any other; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, materialize, prepare, words_of

LENGTH = 4096
END = 2
TOKENIZER = "word_bpe_49k.json"
BUCKETS = 256
DIMS = 3
BITS = 10
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Letters, then ASCII marks that start no contraction: the two are always split.
TAIL = re.compile(r"([^\W\d_]+)([.,!?#$%&*|;:]+)")
_LOADED: dict[str, Vocabulary] = {}


def byte_alphabet() -> list[str]:
    """The characters that byte-level vocabularies write bytes with."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


class Vocabulary:
    """A tokenizer with a memory of about PARTS parts and WORDS words at most; ids are kept as little-endian 16-bit numbers.

    A part that is a word with or without marks after it is the word's ids and the marks'. A word, normalised as the
    tokenizer does, goes straight to its merges; any other part takes the tokenizer's whole way.
    """

    PARTS = 500_000
    WORDS = 150_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(True) > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.known = Memory()
        self.known.learn = self.learn
        self.words: dict[str, bytes] = {}
        self.alphabet = byte_alphabet()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        if path not in _LOADED:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def word(self, w: str) -> bytes | None:
        """The ids of a word in lower case; None where it isn't letters in normal form."""
        ids = self.words.get(w)
        if ids is None:
            if w.isascii():
                spelled = w
            elif w.isalpha() and unicodedata.is_normalized("NFC", w):
                spelled = "".join(map(self.alphabet.__getitem__, w.encode()))
            else:
                return None
            ids = self.words[w] = b"".join([t.id.to_bytes(2, "little") for t in self.tokenizer.model.tokenize(spelled)])
        return ids

    def whole(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def learn(self, part: str) -> bytes:
        head, tail = part, ""
        if not part.isalpha():
            m = TAIL.fullmatch(part)
            if m is None or not m[1].isalpha():
                return self.whole(part)
            head, tail = m.groups()
        # lower() is by character but for one letter, and so is the tokenizer's
        if not head.isascii() and ("\u03a3" in head or not unicodedata.is_normalized("NFC", head)):
            return self.whole(part)
        ids = self.word(head.lower())
        if ids is None:
            return self.whole(part)
        if tail:
            marks = self.words.get(tail)
            if marks is None:
                marks = self.words[tail] = self.whole(tail)
            return ids + marks
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as bytes."""
        for memory, most in ((self.known, self.PARTS), (self.words, self.WORDS)):
            if len(memory) > most:
                memory.clear()
        end = np.array([END], dtype="<u2").tobytes()
        get = self.known.__getitem__
        return [b"".join([*map(get, words_of(t)), end]) for t in texts]


class Memory(dict):
    """Parts and their ids; one that is missing is learnt."""

    __slots__ = ("learn",)

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = self.learn(part)
        return ids


def projection(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(BUCKETS, DIMS))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions along the Hilbert curve of points given by rows of coordinates below 2**bits (Skilling's transform)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


#: The bucket of every 16-bit id.
HASHED = (np.arange(1 << 16, dtype=np.int64) * 0x9E3779B1 >> 7) % BUCKETS


def curve_keys(ids: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """The sort keys of a batch of documents."""
    n = len(ids)
    if not n:
        return np.zeros(0, dtype=np.int64)
    flat = np.concatenate(ids)
    of = np.repeat(np.arange(n), [len(i) for i in ids])
    counts = np.bincount(of * BUCKETS + HASHED[flat], minlength=n * BUCKETS).reshape(n, BUCKETS)
    vector = np.log1p(counts)
    vector /= np.linalg.norm(vector, axis=1, keepdims=True)  # the end id makes it positive
    at = (vector @ matrix + 3) / 6 * (1 << BITS)
    return hilbert(np.clip(at, 0, (1 << BITS) - 1).astype(np.int64))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = prepare(docs.sparkSession)
    matrix = projection()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(tokenizer)
        for batch in batches:
            raw = vocabulary.encode(batch.column(1).to_pylist())
            ids = [np.frombuffer(r, dtype="<u2") for r in raw]
            sizes = pa.array([len(i) for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curve_keys(ids, matrix)), sizes, pa.array(raw, pa.binary())], ["doc_id", "key", "n", "ids"])

    coded = id_text(docs, id_col, text_col).mapInArrow(encode, "doc_id long, key long, n long, ids binary")
    rows = materialize(coded.withColumn("row", F.monotonically_increasing_id()))
    # (row, key, n) along the curve; the range that a row falls in is written with it, so that it can't change any more
    order = rows.select("row", "key", "doc_id", "n").repartitionByRange("key", "doc_id", "row").withColumn("part", F.spark_partition_id())
    order = materialize(order)
    totals = sorted((r.part, r.total) for r in order.groupBy("part").agg(F.sum("n").alias("total")).collect())  # one a range
    base, at = [], 0
    for part, total in totals:
        base.append((part, at))
        at += total
    inner = F.sum("n").over(Window.partitionBy("part").orderBy("key", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    bases = F.broadcast(spark.createDataFrame(base, "part int, base long"))
    placed = order.withColumn("inner", inner).join(bases, "part").select("row", (F.col("base") + F.col("inner")).alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for d, raw, g in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), batch.column("at").to_pylist()):
                wide = np.frombuffer(raw, dtype="<u2").astype("<u4")
                s, n = 0, len(wide)
                while s < n:
                    seq, off = divmod(g + s, length)
                    k = min(n - s, length - off)
                    out.append((d, s, k, zlib.crc32(wide[s : s + k].tobytes()), n, seq, off))
                    s += k
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in SCHEMA.split(", ")])

    return rows.select("row", "doc_id", "ids").join(placed, "row").select("doc_id", "ids", "at").mapInArrow(cut, SCHEMA)
