"""Removal of word passages that occur twice, by repeated-phrase automata (operator 9).

1. Recurring passages. Which windows of SIZE words recur is suggested by sorted hashes over all documents (windows.py).
   Of those in a document some that cover the same words become its phrases.
2. The phrases of all documents are brought together and each distinct one is kept once, as text. It goes to the chunks
   of documents that chose it and to one more that is said to have it.
3. Automata. Each chunk compiles the phrases it is sent with pyahocorasick and streams all its documents through the
   automata, word by word. The words that go are those that matches cover.
4. All places where an automaton found a phrase are counted over the corpus. A phrase that was found in one place only
   doesn't recur, whatever the hashes said: the chunks that hold such a one are streamed again without it. So what
   recurs, and where, is decided by comparing words; hashes only suggest.

The automata are sharded as the documents are, since shards of phrases that each read all documents would cost time in
the square of the corpus. An automaton has NODES nodes at most; a chunk of more phrases streams through several.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .windows import Chunk, Corpus, Scheme, asked, unpack

SIZE = 35
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
PHRASE = "key binary, chunk long, text binary"
#: Nodes of one automaton, about.
NODES = 2_000_000
#: By chunk: its documents' results side by side, and the phrases found with the number of their places.
FOUND = "chunk long, ids array<long>, n_words array<long>, n_removed array<long>, kept array<string>, keys array<binary>, places array<long>"


def word_values(text: bytes) -> np.ndarray:
    """bytes.split() splits at the six ASCII blanks only."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def cover(starts: list[int], hashes: list[int], size: int) -> list[int]:
    """Of windows that start there, in order, places of some that cover the same words.

    Each time the one of the least hash goes on among those that begin in the last half before a gap would open, so
    that documents which share a passage soon choose the same windows of it, wherever they came in.
    """
    out = [0] if starts else []
    while out[-1:] and out[-1] + 1 < len(starts):
        at = starts[out[-1]]
        last = bisect_right(starts, at + size) - 1
        if last == out[-1]:
            out.append(last + 1)  # a new passage
            continue
        first = bisect_left(starts, at + (size + 1) // 2, out[-1] + 1)
        out.append(min(range(first, last + 1), key=hashes.__getitem__) if first <= last else last)
    return out


def recurring_phrases(texts: list[bytes], chunk: Chunk, recurring: list[tuple[np.ndarray, np.ndarray]]) -> dict[bytes, tuple[bytes, int]]:
    """The chunk's phrases by their key, each with a chunk that has it as well."""
    size = chunk.scheme.size
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for held, pieces, (begin, other) in zip(chunk.segments, chunk.parts, recurring):
        at = 0
        for d, s, n in held:
            here = np.nonzero(begin[at : at + n])[0] + at
            if len(here):
                found.setdefault(d, []).append((here - at + s, pieces.hashes(here), other[here]))
            at += n
    out: dict[bytes, tuple[bytes, int]] = {}
    for d, parts in found.items():
        starts, hashes, others = (np.concatenate(x).tolist() for x in zip(*parts))
        words = texts[d].split()
        for i in cover(starts, hashes, size):
            phrase = b" ".join(words[starts[i] : starts[i] + size])
            out[xxhash.xxh3_128_digest(phrase)] = phrase, others[i]
    return out


class Automaton:
    """Phrases as sequences of word numbers; words that no phrase has are 0."""

    def __init__(self, phrases: list[bytes], size: int):
        self.size = size
        self.number: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, text in enumerate(phrases):
            self.machine.add_word(tuple(self.number.setdefault(w, len(self.number) + 1) for w in text.split()), i)
        self.machine.make_automaton()

    def stream(self, words: list[bytes], gone: np.ndarray) -> list[int]:
        """Mark the words that matches cover; of each match the phrase."""
        found: list[int] = []
        if len(words) >= self.size:
            number = self.number.get
            for end, i in self.machine.iter(tuple([number(w, 0) for w in words])):
                found.append(i)
                gone[end - self.size + 1 : end + 1] = True
        return found


def search(texts: list[list[bytes]], phrases: list[bytes], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """By text which words go, and by phrase how many places it has. So many phrases make one automaton that its memory is bounded."""
    gone = [np.zeros(len(words), dtype=bool) for words in texts]
    places = np.zeros(len(phrases), np.int64)
    step = max(1, NODES // size)
    for at in range(0, len(phrases), step):
        automaton = Automaton(phrases[at : at + step], size)
        for words, mask in zip(texts, gone):
            found = automaton.stream(words, mask)
            if found:
                np.add.at(places, np.array(found) + at, 1)
    return gone, places


def kept_words(words: list[bytes], gone: np.ndarray) -> tuple[int, int, str]:
    n = int(gone.sum())
    if n:
        words = [w for w, g in zip(words, gone.tolist()) if not g]
    return len(gone), n, hashlib.sha256(b" ".join(words)).hexdigest()


def streamed(chunks: DataFrame, size: int) -> DataFrame:
    """(chunk, ids, lengths, raw, phrases) to what the chunk's automaton finds and leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                wanted = batch.column("phrases")[i].as_py() or []
                texts = [t.split() for t in unpack(batch, i)]
                gone, places = search(texts, [p["text"] for p in wanted], size)
                got = list(map(kept_words, texts, gone))
                row = {
                    "chunk": batch.column("chunk")[i].as_py(), "ids": batch.column("ids")[i].as_py(),
                    "n_words": [g[0] for g in got], "n_removed": [g[1] for g in got], "kept": [g[2] for g in got],
                    "keys": [p["key"] for p in wanted], "places": places.tolist(),
                }
                yield pa.RecordBatch.from_pylist([row], FOUND_ARROW)

    return chunks.select("chunk", "ids", "lengths", "raw", "phrases").mapInArrow(run, FOUND)


FOUND_ARROW = pa.schema([
    ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("n_removed", pa.list_(pa.int64())),
    ("kept", pa.list_(pa.string())), ("keys", pa.list_(pa.binary())), ("places", pa.list_(pa.int64())),
])


def remove_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per document: its words, those covered by a window of `size` words that starts elsewhere too, the hash of the rest.

    Null or empty text and texts of fewer words than `size` lose nothing; repeated rows count as other places, so both
    lose all; windows never cross documents; a null id gets its row; an empty table gives none; extra columns are
    ignored.
    """
    corpus = Corpus(docs, id_col, text_col)
    scheme = Scheme(word_values, size, max(1, size // 2))
    rows, many = asked(corpus, scheme, tell=True)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts, chunk = unpack(batch, i), batch.column("chunk")[i].as_py()
                c = Chunk(texts, scheme)
                got = recurring_phrases(texts, c, c.recurring(batch.column("pieces")[i].as_py(), batch.column("windows")[i].as_py(), many, chunk))
                for_others = [(k, other) for k, (_, other) in got.items() if other != chunk]
                keys = [*got, *(k for k, _ in for_others)]
                chunks = [chunk] * len(got) + [o for _, o in for_others]
                phrases = [t for t, _ in got.values()] + [None] * len(for_others)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(chunks, pa.int64()), pa.array(phrases, pa.binary())], ["key", "chunk", "text"])

    wanted = materialize(rows.select("chunk", "lengths", "raw", "pieces", "windows").mapInArrow(gather, PHRASE))
    pairs = wanted.select("key", "chunk").distinct()
    # a phrase is wanted once a chunk at most; one that all chunks want is a skewed key of the join, which adaptive execution splits
    distinct = wanted.groupBy("key").agg(F.first("text", ignorenulls=True).alias("text"))
    phrases = corpus.collect(pairs.join(distinct, "key"), "phrases")
    chunks = corpus.with_answers(corpus.table, phrases)
    found = materialize(streamed(chunks, size))
    # a phrase with one place was no phrase
    counted = found.select(F.explode(F.arrays_zip("keys", "places")).alias("f")).groupBy("f.keys").agg(F.sum("f.places").alias("places"))
    single = counted.where("places < 2").select(F.col("keys").alias("key"))
    results = found
    if not single.isEmpty():
        single = materialize(single)
        again = materialize(pairs.join(single, "key", "left_semi").select("chunk").distinct())
        phrases = corpus.collect(pairs.join(again, "chunk", "left_semi").join(single, "key", "left_anti").join(distinct, "key"), "phrases")
        chunks = corpus.with_answers(corpus.table.join(again.repartition(corpus.tasks, "chunk"), "chunk", "left_semi"), phrases)
        results = found.join(again, "chunk", "left_anti").union(materialize(streamed(chunks, size)))
    corpus.close()
    discard(wanted)
    row = F.explode(F.arrays_zip("ids", "n_words", "n_removed", "kept")).alias("r")
    return results.select(row).select(F.col("r.ids").alias("doc_id"), "r.n_words", "r.n_removed", F.col("r.kept").alias("kept_sha256"))
