import hashlib
import random
import re

import pytest

from quillon.llm import decontam


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size=10):
    out = []
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).update([] if i is None else [str(i)])
    lengths = {len(w) for w in wins}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= x
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(spark, docs, items, **kw):
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    return sorted((tuple(r) for r in decontam.contamination(d, b, **kw).collect()), key=repr)


def case(seed):
    r = random.Random(seed)
    vocab = ["a", "B", "c3", "é", "É", "the", "x-y", "q.", "\x00z", "ß", "K", "日本"]
    say = lambda n: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(str(i), say(r.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(8)] + [("2", say(12)), ("9", None), (None, say(14)), (None, None)]
    docs = [(i, say(r.randint(0, 40)) + (r.choice(items)[1] or "") + say(r.randint(0, 9))) for i in range(40)] + [(40, None), (41, ""), (None, "a a"), (1, say(5))]
    return docs, items


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    docs, items = case(seed)
    assert got(spark, docs, items) == brute(docs, items)


def test_many_blocks_give_the_same(spark):
    docs, items = case(2)
    assert got(spark, docs, items, block=7) == brute(docs, items)
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    kept = sorted(((r.doc_id, r.text) for r in decontam.clean_rows(df, b, block=7).collect()), key=repr)
    assert kept == sorted((d for d in docs if not brute([d], items)[0][-1]), key=repr) and len(kept) < len(docs)


def test_items_of_null_id_count(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, f"so {item} it is"), (2, "clean words only"), (3, None)]
    empty = hashlib.sha256(b"").hexdigest()
    assert got(spark, docs, [(None, item)]) == [(1, 14, 11, 0, empty, True), (2, 3, 0, 0, empty, False), (3, 0, 0, 0, empty, False)]
    assert got(spark, docs, [(None, item), ("7", item)])[0][2:4] == (11, 1)
    assert got(spark, docs, []) == brute(docs, [])


def test_table(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted((tuple(r) for r in decontam.contamination(docs, items).collect()), key=repr) == want
    assert decontam.clean_rows(docs, items).count() == sum(not r[-1] for r in want) < len(want)


def test_empty(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and not r.contaminated for r in decontam.contamination(docs, none).collect())
    assert decontam.contamination(docs.limit(0), none).collect() == []
    kept = decontam.clean_rows(docs, none)
    assert kept.columns == docs.columns and kept.count() == docs.count()
