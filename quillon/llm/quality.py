"""Quality rules with an isolation forest over the rule statistics (operator 8).

Each document gets counts by fixed rules. A forest of random splits is grown on the statistics of labelled good
documents, and a document's verdict is its mean path length against a threshold calibrated on labelled rows: the
cut that separates good from bad rows best while it keeps at least KEEP of the good ones.

The classifier is fitted on at most FIT_ROWS labelled rows, those of the smallest hash of doc_id, so their choice
doesn't depend on file order. Everything else covers all rows.

Defined cases: null or empty text has no words, all counts are 0 and base_failed is true; a labelled row without
text, or a label of null, isn't used; repeated rows are judged each; with no usable labels of either class `kept` is
the base verdict; with good labels only, the cut is the KEEP quantile. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, per_text, prepare, words_of

FIT_ROWS = 6000
TREES = 128
SUBSAMPLE = 256
KEEP = 0.99
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, anomaly double"
SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The five counts of the contract, and the numbers that the forest sees."""
    words = words_of(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        first: dict[tuple, int] = {}
        covered = bytearray(n)
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                covered[j : j + 3] = b"\1\1\1"
                covered[i : i + 3] = b"\1\1\1"
        repeat = sum(covered)
    one = max(n, 1)
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    ends = sum(1 for w in words if w[-1] in "!|")
    counts = [n, chars, symbols, dup, repeat]
    return counts, [symbols / max(chars, 1), dup / max(lines, 1), repeat / one, upper / one, ends / one, chars / one / 20]


def base_failed(counts: list[int]) -> bool:
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def expected_path(n: float) -> float:
    """The mean depth of an unsuccessful search in a random tree over n points."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Isolation trees as flat arrays: feature (-1 in a leaf), cut, children, and the path length that a leaf adds."""

    def __init__(self, points: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(points))
        self.depth = int(np.ceil(np.log2(max(self.size, 2)))) + 4
        self.trees = [self._grow(points[rng.permutation(len(points))[: self.size]], rng) for _ in range(trees)]

    def _grow(self, points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, depth: int) -> int:
            k = len(nodes)
            nodes.append([-1, 0.0, k, k, depth + expected_path(len(rows))])
            if depth < self.depth and len(rows) > 1:
                # any feature may be drawn, one without spread too: then the node only isolates what differs from the value all its points share
                f = int(rng.integers(points.shape[1]))
                low, high = rows[:, f].min(), rows[:, f].max()
                cut = rng.uniform(low, high) if high > low else low
                left = rows[:, f] < cut
                a, b = grow(rows[left], depth + 1), grow(rows[~left], depth + 1)
                nodes[k] = [f, cut, a, b, depth, low, high]
            return k

        grow(points, 0)
        pad = np.array([x if len(x) == 7 else [*x, -np.inf, np.inf] for x in nodes], dtype=float)
        return pad[:, 0].astype(int), pad[:, 1], pad[:, 2].astype(int), pad[:, 3].astype(int), pad[:, 4], pad[:, 5], pad[:, 6]

    def paths(self, points: np.ndarray) -> np.ndarray:
        """The mean path length of each point; short is odd. A point outside the range of a node ends there, as a split between it and the node's points isolates it."""
        total, row = np.zeros(len(points)), np.arange(len(points))
        for f, cut, a, b, length, low, high in self.trees:
            at, out = np.zeros(len(points), dtype=int), np.zeros(len(points), dtype=bool)
            for _ in range(self.depth + 1):
                x = points[row, np.maximum(f[at], 0)]
                out |= (f[at] >= 0) & ((x < low[at]) | (x > high[at]))
                at = np.where(out, at, np.where(x < cut[at], a[at], b[at]))
            total += length[at]
        return total / len(self.trees)

    def score(self, points: np.ndarray) -> np.ndarray:
        """Between 0 and 1; high is odd."""
        return 2 ** (-self.paths(points) / max(expected_path(self.size), 1e-9)) if len(points) else np.zeros(0)


def threshold(scores: np.ndarray, good: np.ndarray, keep: float = KEEP) -> float:
    """The score over which a row is rejected: it keeps `keep` of the good rows at least, then separates best."""
    least = float(np.quantile(scores[good], keep))
    if good.all():
        return least
    cuts = np.unique(scores[scores >= least])
    cuts = np.append(cuts[:: max(1, len(cuts) // 2000)], least)
    gain = [(scores[good] <= c).mean() + (scores[~good] > c).mean() for c in cuts]
    best = float(cuts[int(np.argmax(gain))])
    above = scores[scores > best]
    return best if not len(above) else (best + float(above.min())) / 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> tuple[Forest, float] | None:
    """The forest and its threshold from a bounded number of labelled rows; None without good ones."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = id_text(docs, id_col, text_col).join(F.broadcast(rows), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [statistics(t) for t in batch.column("text").to_pylist()]
            failed, points = pa.array([base_failed(c) for c, _ in got], pa.bool_()), pa.array([f for _, f in got], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), failed, points], ["doc_id", "quality", "failed", "x"])

    # fit_rows rows of six numbers; of repeated documents the least in these counts
    sample = texts.mapInArrow(measure, "doc_id long, quality int, failed boolean, x array<double>")
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("quality", "failed", "x")).alias("s")).select("doc_id", "s.*").toPandas().sort_values("doc_id")
    sample = sample[~sample.failed]
    good = (sample.quality == 1).to_numpy()
    if not good.any():
        return None
    x = np.array(sample.x.tolist(), dtype=float)
    forest = Forest(x[good])
    return forest, threshold(forest.score(x), good)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """One row per document with its counts and the verdict; with keep_columns instead the kept input rows, unchanged."""
    prepare(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col)

    def judge(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        got = [statistics(t) for t in texts]
        counts = np.array([c for c, _ in got], dtype=np.int64).reshape(-1, 5)
        failed = np.array([base_failed(c) for c, _ in got], dtype=bool)
        odd = np.zeros(len(texts))
        kept = ~failed
        if model is not None:
            odd = model[0].score(np.array([f for _, f in got], dtype=float).reshape(-1, 6))
            kept = kept & (odd <= model[1])
        return counts, failed, kept, odd

    def run(texts: list[str]) -> list:
        counts, failed, kept, odd = judge(texts)
        return [*counts.T, failed, kept, odd]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(["" if t is None else t for t in batch.column(text_col).to_pylist()])[2]))

    if keep_columns:
        return docs.mapInArrow(keep, docs.schema)
    return per_text(id_text(docs, id_col, text_col), run, SCHEMA)
