"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (operator 10).

The ring has CELLS cells. A row lies in the cell of its key's hash; each shard owns REPLICAS points, and a cell
belongs to the shard of the next point clockwise. The loads are bounded at their least, so the law is `rows`:
with N rows and k shards, shard i holds N // k rows, and the first N % k shards one more. A shard takes rows of its
own cells first, clockwise; what is left over walks on clockwise to the next shards that have room.

Only the row counts of the cells, CELLS numbers whatever the input, reach the driver. The placement they give is a
table of at most CELLS + points pieces (cell, ranks from..to, shard, first slot), broadcast because its size is
bounded by constants. A row's rank in its cell is counted level by level: by the content of the row (PARTS parts), by
the task that wrote it, then by order. So no task ranks a whole cell, whether one id holds a third of all rows with
different texts or with the same one; which rows overflow depends on content, and on the task only among rows alike.

Defined cases: null text has size 8 and the CRC of no bytes; rows of a null id are keyed by size and CRC of their text;
rows that are equal in all columns are kept and get slots of their own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CELLS = 1 << 16
REPLICAS = 128
PARTS = 1 << 12
PIECES = "cell int, lo long, hi long, shard int, first long"


def ring(shards: int, cells: int = CELLS, replicas: int = REPLICAS) -> np.ndarray:
    """The shard that owns each cell: that of the next virtual node clockwise."""
    points = sorted((xxhash.xxh64_intdigest(f"{s}:{v}", seed=7) % cells, s) for s in range(shards) for v in range(replicas))
    at, who = np.array([p for p, _ in points]), np.array([s for _, s in points])
    return who[np.searchsorted(at, np.arange(cells)) % len(at)]


def place(counts: np.ndarray, owner: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (cell, lo, hi, shard, first slot): ranks lo..hi-1 of the cell go to the shard from that slot on."""
    total = int(counts.sum())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, pieces, left = [0] * shards, [], []

    def admit(cell: int, lo: int, hi: int, s: int) -> int:
        n = min(hi - lo, room[s] - filled[s])
        if n > 0:
            pieces.append((cell, lo, lo + n, s, filled[s]))
            filled[s] += n
        return lo + n

    for cell in np.nonzero(counts)[0].tolist():
        hi = int(counts[cell])
        lo = admit(cell, 0, hi, int(owner[cell]))
        if lo < hi:
            left.append((cell, lo, hi))
    # The overflow walks clockwise: what waits longest enters first wherever a shard has room. Runs of one owner count as one stop.
    stops = [int(owner[0])] + [int(owner[i]) for i in range(1, len(owner)) if owner[i] != owner[i - 1]]
    starts = [0] + [i for i in range(1, len(owner)) if owner[i] != owner[i - 1]]
    waiting: list[tuple[int, int, int]] = []
    by_stop: dict[int, list] = {}
    for x in left:
        by_stop.setdefault(int(np.searchsorted(starts, x[0], side="right")) - 1, []).append(x)
    for lap in range(3):
        for i, s in enumerate(stops):
            if waiting and filled[s] < room[s]:
                rest = []
                for cell, lo, hi in waiting:
                    lo = admit(cell, lo, hi, s)
                    if lo < hi:
                        rest.append((cell, lo, hi))
                waiting = rest
            if lap == 0:
                waiting.extend(by_stop.get(i, ()))
        if not waiting:
            break
    return pieces


def shard_rows(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    # rows without an id are keyed by their text, so that many of them don't share a cell
    none = F.col("doc_id").isNull()
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), none, F.when(none, F.col("text_crc32")), F.when(none, F.col("size"))))
    # the texts are read once: what is counted and then placed is a few numbers a row
    part = F.pmod(F.xxhash64("h", "size", "text_crc32"), F.lit(PARTS)).cast("int")
    rows = materialize(rows.select("*", F.pmod("h", F.lit(CELLS)).cast("int").alias("cell"), part.alias("part"), F.spark_partition_id().alias("task")))
    counts = np.zeros(CELLS, dtype=np.int64)
    for cell, n in rows.groupBy("cell").count().collect():  # CELLS rows at most
        counts[cell] = n
    pieces = spark.createDataFrame(place(counts, ring(shards), shards), PIECES)
    # rows before those of the same part, and among those before the ones of the same task
    fine = rows.groupBy("cell", "part", "task").agg(F.count("*").alias("n"))
    coarse = fine.groupBy("cell", "part").agg(F.sum("n").alias("n"))
    sum_before = lambda keys, by: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.select("cell", "part", sum_before(["cell"], "part").alias("above"))
    fine = fine.withColumn("before", sum_before(["cell", "part"], "task")).join(coarse, ["cell", "part"]).select("cell", "part", "task", (F.col("above") + F.col("before")).alias("before"))
    own = F.row_number().over(Window.partitionBy("cell", "part", "task").orderBy("h", "doc_id", "size", "text_crc32"))
    ranked = rows.withColumn("own", own).join(fine, ["cell", "part", "task"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    at = F.broadcast(pieces.withColumnRenamed("cell", "of"))
    out = ranked.join(at, (F.col("cell") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("first") + F.col("rank") - F.col("lo")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
