"""Operators against brute force over a large table, in many partitions and buckets: python tests/llm/large.py SF_DIR [4 5 6 7 9 10]"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import xxhash

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from quillon.llm import queries, windows  # noqa: E402

BLANKS = re.compile(rb"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def covered(units: list[np.ndarray], width: int) -> list[np.ndarray]:
    """For each text a mask of the units that a window which starts elsewhere too covers, by sorted hashes of all windows."""
    base = 0x5851F42D4C957F2D
    n = max(map(len, units)) + 1
    power, inverse = (np.full(n, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    power[0] = inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    hashes = []
    for v in units:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * power[: len(v)])])
        h = (total[width:] - total[:-width]) * inverse[: max(0, len(v) - width + 1)] if len(v) >= width else np.zeros(0, np.uint64)
        hashes.append(h ^ (h >> np.uint64(29)))
    order = np.sort(np.concatenate(hashes))
    again = np.unique(order[1:][order[1:] == order[:-1]])
    out = []
    for v, h in zip(units, hashes):
        edge = np.zeros(len(v) + 1, np.int64)
        place = np.minimum(np.searchsorted(again, h), len(again) - 1)
        at = np.nonzero(again[place] == h)[0] if len(again) else place
        np.add.at(edge, at, 1)
        np.add.at(edge, at + width, -1)
        out.append(np.cumsum(edge)[: len(v)] > 0)
    return out


def check_4(rows, docs, sf_dir):
    """Pairs by four blocks of 16 bits, one of which three differing bits leave alike, and union-find."""
    bits = np.array([int(x, 16) for x in rows.fingerprint], dtype=np.uint64)
    points, of = np.unique(bits, return_inverse=True)
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in range(4):
        key = (points >> np.uint64(16 * b)) & np.uint64(0xFFFF)
        order = np.argsort(key, kind="stable")
        for group in np.split(order, np.nonzero(np.diff(key[order]))[0] + 1):
            for s in range(0, len(group), 500):
                near = np.bitwise_count(points[group[s : s + 500], None] ^ points[group][None, :]) <= 3
                for i, j in zip(*np.nonzero(near)):
                    x, y = find(group[s + i]), find(group[j])
                    parent[max(x, y)] = min(x, y)
    least: dict[int, int] = {}
    roots = [find(i) for i in of]
    for d, r in zip(rows.doc_id, roots):
        least[r] = min(least.get(r, d), d)
    return sum(least[r] != c for r, c in zip(roots, rows.component_id))


def check_5(rows, docs, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list)
    for r in rows.sort_values(["doc_id", "start"]).itertuples():
        own[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    bad, ids = 0, list(docs)
    for s in range(0, len(ids), 4000):
        for d, e in zip(ids[s : s + 4000], tokenizer.encode_batch([docs[i].decode() for i in ids[s : s + 4000]], add_special_tokens=False)):
            x, at, good = np.array([*e.ids, 2], dtype="<u4"), 0, True
            for start, n, crc, total in own[d]:
                good &= start == at and total == len(x) and zlib.crc32(x[start : start + n].tobytes()) == crc
                at += n
            bad += not (good and at == len(x))
    rows = rows.sort_values(["sequence_id", "offset"])
    begin = (rows.sequence_id * 4096 + rows.offset).to_numpy()
    return bad + int(begin[0] != 0) + int((begin[1:] != begin[:-1] + rows.length.to_numpy()[:-1]).sum()) + int((rows.offset + rows.length > 4096).sum())


def check_6(rows, docs, sf_dir):
    values = np.random.default_rng(99).integers(0, 1 << 64, 256, dtype=np.uint64)
    got, bad = rows.set_index("doc_id").to_dict("index"), 0
    for (d, t), m in zip(docs.items(), covered([values[np.frombuffer(t, np.uint8)] for t in docs.values()], 200)):
        want = len(t), int(m.sum()), int((m[1:] & ~m[:-1]).sum() + m[:1].sum()), sha(np.frombuffer(t, np.uint8)[~m].tobytes())
        bad += want != tuple(got[d][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256"))
    return bad


def check_7(rows, docs, sf_dir):
    items, sizes = defaultdict(set), set()
    for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist():
        w = FOLDED.findall((r["text"] or "").translate(LOWER))
        for i in range(max(1, len(w) - 9) if w else 0):
            items[" ".join(w[i : i + 10])].add(str(r["item_id"]))
            sizes.add(min(10, len(w)))
    got, bad = rows.set_index("doc_id").to_dict("index"), 0
    for d, t in docs.items():
        w, found = FOLDED.findall(t.decode().translate(LOWER)), set()
        hit = bytearray(len(w))
        for n in sizes:
            for i in range(len(w) - n + 1):
                if known := items.get(" ".join(w[i : i + n])):
                    hit[i : i + n] = b"\1" * n
                    found |= known
        want = len(w), sum(hit), len(found), sha(",".join(sorted(found)).encode()), any(hit)
        bad += want != tuple(got[d][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    return bad


def check_9(rows, docs, sf_dir):
    words = [BLANKS.findall(t) for t in docs.values()]
    masks = covered([np.array([xxhash.xxh3_64_intdigest(x) for x in w], dtype=np.uint64) for w in words], 35)
    got, bad = rows.set_index("doc_id").to_dict("index"), 0
    for d, w, m in zip(docs, words, masks):
        want = len(w), int(m.sum()), sha(b" ".join(x for x, g in zip(w, m) if not g))
        bad += want != tuple(got[d][c] for c in ("n_words", "n_removed", "kept_sha256"))
    return bad


def check_10(rows, docs, sf_dir):
    per = rows.groupby("shard").slot.agg(["count", "max", "nunique"])
    bad = int(per["count"].max() - per["count"].min() > 1) + int((per["count"] != per["nunique"]).sum()) + int((per["max"] + 1 != per["count"]).sum())
    return bad + sum((n, crc) != (len(docs[d]) + 8, zlib.crc32(docs[d])) for d, n, crc in zip(rows.doc_id, rows["size"], rows.text_crc32))


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.files.maxPartitionBytes": "8m", "spark.sql.autoBroadcastJoinThreshold": "256k", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.driver.maxResultSize": "3g", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    spark = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    windows.BUCKET_BYTES = 4 << 20
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    for name, query in queries.QUERIES.items():
        n = name[2:].split("_")[0]
        if f"check_{n}" in globals() and (not wanted or n in wanted):
            began = time.time()
            rows = query(spark, sf_dir).toPandas()
            took = time.time() - began
            bad = globals()[f"check_{n}"](rows, docs, sf_dir) + int(sorted(set(rows.doc_id)) != sorted(docs))
            print(f"{name}: {len(rows)} rows in {took:.0f} s, wrong: {bad}", flush=True)
