import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from quillon.llm import graph, simhash


def fp_brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    texts = ["", " ", "a", "A b", "One two three", "one TWO\tthree four\xa0five É é", "x " * 700, "a b c a b c a b c", "\x1fq w\x0be"]
    assert simhash.fingerprints(texts).tolist() == [fp_brute(t) for t in texts]


def test_links_against_all_pairs(spark):
    """Planted distances 0 to 5 in every spread over the word, chains, and a dense cluster."""
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(40)]
    for f in fps[:40]:
        g = f
        for _ in range(3):
            for b in r.sample(range(64), r.randint(1, 5)):
                g ^= 1 << b
            fps.append(g)
    fps += [fps[0] ^ (1 << a) ^ (1 << b) for a in range(0, 64, 9) for b in range(0, 64, 7)] + [0, 7, 1 << 63, (1 << 64) - 1]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    got = {np.int64(r.node).view(np.uint64).item(): r.root for r in graph.connected_components(simhash.links(df)).collect()}
    want, sets = components(fps), defaultdict(set)
    for f, c in zip(fps, want):
        sets[c].add(f)
    mine = defaultdict(set)
    for f in fps:
        mine[got.get(f, ("own", f))].add(f)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    n = 300
    chain = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(200)] + [(5, 5), (2, 1)]
    rows = graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert len(rows) == len({r.node for r in rows}) and all(r.root == (0 if r.node <= n else 1000) for r in rows)
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    fps = [fp_brute(texts[i]) for i in ids]
    want = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, components(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()} == want


def test_edges_and_keeping_one(spark, docs):
    rows = simhash.simhash_groups(docs).collect()
    assert len(rows) == docs.count()
    assert {(r.fingerprint, r.component_id) for r in rows if r.doc_id in (2, 3, 4)} == {("0" * 16, 2)}
    assert simhash.simhash_groups(docs.limit(0)).collect() == []
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 5]


def test_one_row_of_each_group_whatever_the_ids(spark):
    texts = [" ".join(f"{w}{i}" for i in range(400)) for w in ("alpha", "beta", "gamma", "delta", "omega")]
    a, b, c, d, e = texts
    rows = [(None, a), (None, a + " x"), (None, b), (1, b + " x"), (7, c), (7, d), (3, d + " x"), (7, e), (7, e + " x"), (7, e), (8, e + " y")]
    kept = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    fps = [fp_brute(t) for _, t in rows]
    groups = components(fps)
    assert len(set(groups)) == 5 and len(kept) == 5
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest())
    want = [min((r for r, g in zip(rows, groups) if g == k), key=order) for k in set(groups)]
    assert sorted(kept, key=order) == sorted(want, key=order)


def test_columns_of_any_name_and_many_null_ids(spark):
    """Helper names can't clash; null ids meet under no single key; rows that differ in other columns alone leave the same one each time."""
    long = " ".join(f"word{i}" for i in range(300))
    rows = [(1, long, "a", 1), (None, long, "b", 2), (None, long + " x", "c", 3), (5, long, "d", 4), (5, long + " y", "e", 5), (5, long + " y", "f", 6)]
    names = "doc_id long, text string, _id string, `a.b` int"
    kept = simhash.keep_one(spark.createDataFrame(rows, names))
    assert kept.columns == ["doc_id", "text", "_id", "a.b"] and [tuple(r) for r in kept.collect()] == [rows[0]]
    for fp in ("fp", "tie", "digest", "root", "node", "least"):
        assert simhash.keep_one(spark.createDataFrame(rows, f"doc_id long, text string, {fp} string, none int")).count() == 1
    same = [simhash.keep_one(spark.createDataFrame(rows[4:], names).repartition(n)).collect() for n in (1, 2)]
    assert same[0] == same[1] and len(same[0]) == 1
    many = spark.range(3000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat_ws(' ', transform(sequence(1, 60), x -> sha2(concat(id % 500, '-', x), 256))) AS text").repartition(16)
    assert simhash.keep_one(many).count() == 500
