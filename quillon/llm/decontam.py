"""Benchmark decontamination by a prefix-filtered set join (operator 7).

Every window of WINDOW consecutive item words is a record to be found whole, in order, in a document. The words are
ordered by rarity, counted over all documents and items. To contain a window a document must hold its rarest word, so
that single-word prefix is what is joined: a document word that is no window's rarest word costs one dictionary
lookup. A candidate then passes the length bound (the document has as many words as the window), the positional bound
(the window fits around the word's place) and exact verification word by word.

The items go to the executors in blocks of at most BLOCK windows, a bounded broadcast; a benchmark of any size takes
more blocks, each over all documents, and the hits of the blocks are merged per document. The driver holds one block at
a time: what a block found is written before the next one is read, and its broadcast is let go.

Defined cases: null has no words, in documents and items; an item without words matches nothing, one of fewer words
than WINDOW is one window; a repeated item_id is one item with the windows of all its rows; the windows of an item of
null id hit words like any other, and only the id is left out of n_items and items_sha256;
repeated documents get a row each; an empty benchmark leaves every document clean; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, materialize, per_text, prepare

WINDOW = 10
BLOCK = 200_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

#: ASCII letters to lower case, other ASCII outside 0-9 to a blank; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

Window = tuple[bytes, ...]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows(item: list[bytes], window: int) -> list[Window]:
    return [tuple(item[i : i + window]) for i in range(max(1, len(item) - window + 1))] if item else []


class Index:
    """Windows by their rarest word: its place in the window, the window, and the items that have it."""

    def __init__(self, of: dict[Window, list[str]], rarity: dict[bytes, int]):
        self.by_word: dict[bytes, dict[int, dict[Window, list[str]]]] = {}
        for w, items in of.items():
            at = min(range(len(w)), key=lambda i: (rarity.get(w[i], 0), w[i], i))
            self.by_word.setdefault(w[at], {}).setdefault((at << 16) | len(w), {})[w] = items

    def find(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint word ranges covered by occurrences, and the items that occur."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        get, n = self.by_word.get, len(doc)
        for p, word in enumerate(doc):
            places = get(word)
            if places is None:
                continue
            for code, known in places.items():
                start, end = p - (code >> 16), p - (code >> 16) + (code & 0xFFFF)
                if start >= 0 and end <= n and (hit := known.get(tuple(doc[start:end]))) is not None:
                    ranges.append((start, end))
                    items.update(hit)
        return merge(ranges), items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def rarities(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each item word occurs over all documents; partial sums leave each task, one row a word at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(filter(vocabulary.__contains__, words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return {bytes(r.word): r.n for r in docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def blocks(benchmark: DataFrame, window: int, size: int) -> Iterator[dict[Window, list[str]]]:
    """The items' windows in bounded blocks; the items stream to the driver partition by partition, one at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text")).dropna(subset=["text"])
    now: dict[Window, list[str]] = {}
    for r in rows.toLocalIterator():
        for w in windows(words(r.text), window):
            now.setdefault(w, []).extend([] if r.item_id is None else [r.item_id])
            if len(now) >= size:
                yield now
                now = {}
    if now:
        yield now


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = prepare(docs.sparkSession)
    texts = id_text(docs, id_col, text_col)
    of = blocks(benchmark, window, block)
    first, second = next(of, None), next(of, None)
    if second is not None:
        return in_blocks(texts, chain((first, second), of))
    index = broadcast(spark, texts, first or {})

    def run(batch: list[str]) -> list[list]:
        columns: list[list] = [[] for _ in range(5)]
        for text in batch:
            doc = words(text)
            ranges, items = index.value.find(doc)
            row = (len(doc), sum(e - s for s, e in ranges), len(items), digest(items), bool(ranges))
            for c, v in zip(columns, row):
                c.append(v)
        return columns

    return per_text(texts, run, SCHEMA)


def broadcast(spark: SparkSession, texts: DataFrame, of: dict[Window, list[str]]) -> Broadcast:
    return spark.sparkContext.broadcast(Index(of, rarities(texts, {x for w in of for x in w}) if of else {}))


def in_blocks(texts: DataFrame, found: Iterable[dict[Window, list[str]]]) -> DataFrame:
    """The same over several blocks: one pass each for the hits, which are few, then one that adds them up by row."""
    rows = materialize(texts.withColumn("row", F.monotonically_increasing_id()))
    hits = None
    for of in found:
        index = broadcast(texts.sparkSession, texts, of)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [index.value.find(words(t)) for t in batch.column("text").to_pylist()]
                keep = [i for i, (ranges, _) in enumerate(got) if ranges]
                flat = [[x for r in got[i][0] for x in r] for i in keep]
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(keep, pa.int64())), pa.array(flat, pa.list_(pa.int64())), pa.array([sorted(got[i][1]) for i in keep], pa.list_(pa.string()))], ["row", "ranges", "items"])

        one = materialize(rows.select("row", "text").mapInArrow(run, "row long, ranges array<long>, items array<string>"))
        index.destroy()
        hits = one if hits is None else hits.union(one)
    sizes = rows.select("doc_id", "row", "text").mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array([len(words(t)) for t in b.column("text").to_pylist()], pa.int64())], ["doc_id", "row", "n_words"]) for b in batches),
        "doc_id long, row long, n_words long",
    )
    # as many rows of a document as there are blocks
    merged = hits.groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit, count, code = [], [], []
            for flat, items in zip(b.column("ranges").to_pylist(), b.column("items").to_pylist()):
                pairs = merge(list(zip((flat or [])[::2], (flat or [])[1::2])))
                hit.append(sum(e - s for s, e in pairs))
                count.append(len(items or []))
                code.append(digest(set(items or [])))
            n = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), n, pa.array(count, pa.int64()), pa.array(code), pa.array([h > 0 for h in hit])], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return sizes.join(merged, "row", "left").select("doc_id", "n_words", "ranges", "items").mapInArrow(total, SCHEMA)


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The input rows, all columns, without those that hold a benchmark window.

    A null or empty text holds none and stays; rows of null and repeated ids are judged each by their text; an item of
    null id counts; an empty benchmark keeps all rows; no helper column is added, so no name can clash.
    """
    spark = prepare(docs.sparkSession)
    out = docs
    of = blocks(benchmark, window, block)
    now = next(of, None)
    while now is not None:
        index = broadcast(spark, docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), now)

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.value.find(words(t))[0] for t in batch.column(text_col).to_pylist()], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
        now = next(of, None)
        if now is not None:
            out = materialize(out)
            index.destroy()
    return out
