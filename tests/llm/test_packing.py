import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def test_parts_give_the_ids_of_the_whole_text(spark, tokenizer):
    r = random.Random(4)
    bits = ["the", "Don't", "we'll!", "ΣΑΣ", "é", "é", " ́x", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|startoftext|>x", "\n", "\t", "  ", "123", "a,###", "日本語", "İ", "word.", "x_y", "ab|", "가", "'s", "ǅ!", "​", "ÉCOLE", "écoleÅ", "ΑΣ,", "ſtraße", "ﬁn!", "ÄÖÜ###", "İstanbul", "Ǆ", "ª", "ᾼ"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    texts += [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text, got in zip(texts, packing.Vocabulary(packing.TOKENIZER).encode(texts)):
        assert np.frombuffer(got, "<u2").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END], text


def test_hilbert_is_a_walk_over_all_cells():
    bits = 3
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = packing.hilbert(grid, bits)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check(rows, ids, length):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[d]) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[d][p.start : p.start + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[d])
    total = 0
    for s in sorted(by_seq):
        at = 0
        for p in sorted(by_seq[s], key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        total += at
        assert at == length or s == max(by_seq)
    assert sorted(by_seq) == list(range(len(by_seq))) and total == sum(map(len, ids.values()))


def test_round_trip(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2] for r in docs.collect()}
    check(packing.pack(docs).collect(), ids, 4096)
    check(packing.pack(docs, length=100).collect(), ids, 100)


def test_neighbours_share_content(spark):
    """Copies of two kinds of text lie in two runs, not mixed."""
    rows = [(i, ("alpha beta gamma delta " if i % 2 else "one two three four five ") * 5) for i in range(40)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), length=64).collect()
    order = [r.doc_id % 2 for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert sum(a != b for a, b in zip(order, order[1:])) == 1


def test_edges(spark, docs):
    rows = packing.pack(docs).collect()
    assert sum(r.start == 0 for r in rows) == docs.count()
    assert [(r.length, r.doc_tokens) for r in rows if r.doc_id == 2] == [(1, 1)]
    assert packing.pack(docs.limit(0)).collect() == []
