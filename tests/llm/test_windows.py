import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import phrases, substrings, windows


def gone(seqs, size):
    many = Counter(tuple(s[i : i + size]) for s in seqs for i in range(len(s) - size + 1))
    out = []
    for s in seqs:
        m = [False] * len(s)
        for i in range(len(s) - size + 1):
            if many[tuple(s[i : i + size])] > 1:
                m[i : i + size] = [True] * size
        out.append(m)
    return out


def brute_bytes(docs, size=200):
    seqs = [(t or "").encode() for _, t in docs]
    out = []
    for (d, _), s, m in zip(docs, seqs, gone(seqs, size)):
        spans = sum(a and not b for a, b in zip(m, [False, *m]))
        out.append((d, len(s), sum(m), spans, hashlib.sha256(bytes(c for c, g in zip(s, m) if not g)).hexdigest()))
    return sorted(out, key=repr)


def brute_words(docs, size=35):
    seqs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    return sorted(((d, len(s), sum(m), hashlib.sha256(" ".join(w for w, g in zip(s, m) if not g).encode()).hexdigest()) for (d, _), s, m in zip(docs, seqs, gone(seqs, size))), key=repr)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def planted(seed, unit):
    """Random texts with shared passages of every length around the window, nested, adjacent and repeated inside one text."""
    r = random.Random(seed)
    say = lambda n: unit(r, n)
    passages = [say(n) for n in (10, 17, 34, 35, 36, 50, 90, 199, 200, 201, 260, 400)]
    docs = []
    for i in range(60):
        parts = [say(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 3)
            parts += [p[a:] if r.random() < 0.4 else p, say(r.randint(0, 60))]
        docs.append((i, "".join(parts)))
    return [*docs, (60, docs[0][1]), (60, docs[0][1]), (61, None), (62, ""), (None, "x" * 1000), (63, docs[3][1] * 2)]


def letters(r, n):
    return "".join(r.choice("abcdé ") for _ in range(n))


def words(r, n):
    return "".join(r.choice(["a", "B", "cc", "é", "d\xa0e"]) + r.choice([" ", "\n", "  "]) for _ in range(n))


@pytest.mark.parametrize("seed", [0, 1])
def test_bytes_against_brute_force(spark, seed):
    docs = planted(seed, letters)
    assert got(substrings.remove_substrings(frame(spark, docs))) == brute_bytes(docs)


@pytest.mark.parametrize("seed", [4])
def test_parts_of_the_chunks_against_brute_force(spark, seed, monkeypatch):
    """Small chunks and many buckets, each of which hears three chunks at most, so that answers pass through several levels."""
    monkeypatch.setattr(windows, "FAN", 3)
    monkeypatch.setattr(windows, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(windows, "BUCKET_BYTES", 2500)
    docs = planted(seed, letters)
    assert got(substrings.remove_substrings(frame(spark, docs))) == brute_bytes(docs)
    docs = planted(seed, words)
    assert got(phrases.remove_phrases(frame(spark, docs))) == brute_words(docs)


@pytest.mark.parametrize("seed", [2, 3])
def test_words_against_brute_force(spark, seed):
    docs = planted(seed, words)
    assert got(phrases.remove_phrases(frame(spark, docs))) == brute_words(docs)


def test_automata_decide(spark, monkeypatch):
    """Phrases that were suggested wrongly change nothing, as automata find them in one place only; without matches nothing goes."""
    docs = planted(5, words)
    want = brute_words(docs)
    real, size = phrases.recurring_phrases, phrases.SIZE

    def suggest_all(texts, chunk, recurring):
        out = real(texts, chunk, recurring)
        for t in texts:
            w = t.split()
            for i in range(len(w) - size + 1):
                p = b" ".join(w[i : i + size])
                out.setdefault(hashlib.md5(p).digest(), (p, -1))
        return out

    monkeypatch.setattr(phrases, "recurring_phrases", suggest_all)
    assert got(phrases.remove_phrases(frame(spark, docs))) == want
    monkeypatch.setattr(phrases, "recurring_phrases", real)
    monkeypatch.setattr(phrases, "search", lambda texts, wanted, size: ([np.zeros(len(t), dtype=bool) for t in texts], np.zeros(len(wanted), np.int64)))
    assert {r[2] for r in got(phrases.remove_phrases(frame(spark, docs)))} == {0} != {r[2] for r in want}


def test_small_automata_give_the_same(monkeypatch):
    r = random.Random(3)
    texts = [words(r, 300).encode().split() for _ in range(4)]
    wanted = sorted({b" ".join(t[i : i + 5]) for t in texts for i in range(0, 290, 3)})
    whole = phrases.search(texts, wanted, 5)
    monkeypatch.setattr(phrases, "NODES", 50)
    parts = phrases.search(texts, wanted, 5)
    assert (whole[1] == parts[1]).all() and all((a == b).all() for a, b in zip(whole[0], parts[0]))
    assert whole[1].tolist() == [sum(b" ".join(t[i : i + 5]) == p for t in texts for i in range(len(t) - 4)) for p in wanted]


def test_rows_without_text_fill_chunks(spark, monkeypatch):
    """Many null and empty texts in one partition make many chunks, and the table of chunks leaves the catalog."""
    monkeypatch.setattr(windows, "ROW_BYTES", 1 << 16)
    docs = spark.createDataFrame([(i, None if i % 2 else "") for i in range(200)], "doc_id long, text string").coalesce(1)
    corpus = windows.Corpus(docs, "doc_id", "text")
    assert corpus.chunks == 7 and corpus.table.selectExpr("explode(ids)").count() == 200
    corpus.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quillon_")]
    for df in (substrings.remove_substrings(docs), phrases.remove_phrases(docs)):
        assert df.count() == 200 and df.where("n_removed > 0").isEmpty()


def test_chunk_numbers_and_tasks(spark):
    from pyspark.sql import functions as F

    got = [windows.numbers(3, 11)]
    seen = [next(got[0])] + [got[0].send(i % 5 == 0) for i in range(60)]
    assert len({c for c, _ in seen}) == len(seen)
    df = spark.createDataFrame([(c, b) for c, b in seen], "c long, b int")
    assert df.where(F.pmod(F.hash("c"), F.lit(11)) != F.col("b")).isEmpty()
    assert windows.tasks(0, 4) == 4 and windows.tasks(1 << 30, 4) == 32 and windows.tasks(100 << 40, 4) < 100_000


def test_low_entropy_and_small_windows(spark):
    r = random.Random(9)
    docs = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(50)]
    for size in (1, 2, 7, 12):
        assert got(substrings.remove_substrings(frame(spark, docs), size=size)) == brute_bytes(docs, size)
    docs = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(50)]
    for size in (1, 2, 9):
        assert got(phrases.remove_phrases(frame(spark, docs), size=size)) == brute_words(docs, size)


def test_long_texts_in_segments_and_chunks(spark, monkeypatch):
    """Small limits, in this process: the same masks from many segments and blocks as from one."""
    r = random.Random(4)
    text = letters(r, 3000)
    texts = [(text[:1700] + letters(r, 300) + text[500:1500]).encode(), text.encode(), b"", b"q" * 700]
    scheme = windows.Scheme(substrings.byte_values, 200, 100)

    def starts():
        out = Counter()
        for held, values in windows.blocks(texts, scheme):
            p = windows.pieces(values, [n for _, _, n in held], 200, 100)
            at = 0
            for d, s, n in held:
                for w in p.windows(np.arange(len(p.at)))[0].tolist():
                    if at <= w < at + n:
                        out[d, s + w - at] += 1
                at += n
        return out

    whole = starts()
    assert set(whole.values()) == {1} and len(whole) == sum(max(0, len(t) - 199) for t in texts)
    monkeypatch.setattr(windows, "SEGMENT", 333)
    monkeypatch.setattr(windows, "BLOCK_UNITS", 1000)
    assert starts() == whole


def test_table_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(substrings.remove_substrings(docs)) == brute_bytes([(r.doc_id, r.text) for r in docs.collect()])


def test_table_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(phrases.remove_phrases(docs)) == brute_words([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark, docs):
    for df in (substrings.remove_substrings(docs), phrases.remove_phrases(docs)):
        rows = df.collect()
        assert len(rows) == docs.count()
        assert all(r.n_removed == r[1] > 0 for r in rows if r.doc_id == 5)
        assert all(r.n_removed == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert substrings.remove_substrings(docs.limit(0)).collect() == [] == phrases.remove_phrases(docs.limit(0)).collect()


def test_difference_cover_gives_the_same(spark):
    from quillon.llm import suffixes

    docs = planted(7, letters)[:25] + planted(7, letters)[-6:]
    assert got(suffixes.remove_by_difference_cover(frame(spark, docs))) == brute_bytes(docs)
    assert suffixes.remove_by_difference_cover(frame(spark, docs).limit(0)).collect() == []
