import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import packing, quality, secrets
from test_decontam import brute as contaminated
from test_packing import check
from test_simhash import components, fp_brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))

    def good(text):
        counts, x = quality.statistics(text)
        import numpy as np

        return not quality.base_failed(counts) and (model is None or model[0].score(np.array([x]))[0] <= model[1])

    want = {d: t for d, t in rows.items() if good(t)}
    for (name, stage), nxt in zip(corpus_pipeline.STAGES[:4], ("quality", "near_duplicates", "decontamination", "secrets")):
        assert name == nxt
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        if name == "near_duplicates":
            ids = sorted(want)
            group = components([fp_brute(want[i]) for i in ids])
            want = {ids[c]: want[ids[c]] for c in set(group)}
        elif name == "decontamination":
            bad = {r[0] for r in contaminated(list(want.items()), items) if r[-1]}
            assert bad
            want = {d: t for d, t in want.items() if d not in bad}
        elif name == "secrets":
            want = {d: secrets.redact(t) for d, t in want.items()}
            assert all("token =" not in t for t in want.values())
        assert {r.doc_id: r.text for r in docs.collect()} == want
    assert len(want) > 0.4 * len(rows)
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    check(corpus_pipeline.run(spark, SF).collect(), {d: [*t.encode(x, add_special_tokens=False).ids, 2] for d, x in want.items()}, 4096)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_nulls_ties_and_repeated_rows(spark):
    """Nulls in any column, an empty and a very long text, repeated rows: every stage runs, and good rows stay once."""
    kept = corpus_pipeline.quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).where("n_chars between 800 and 3000")
    good = [d.text for d in kept.orderBy("doc_id").collect() if "token" not in d.text][::7]
    rows = [(1, good[0], "en", None, 3), (1, good[0], "en", None, 3), (2, good[1], None, "s", None), (None, good[2], "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (None, None, None, None, None), (5, "\n".join(good) * 30, "en", "s", 9), (6, good[3] + ' token = "a1b2c3d4e5f60718"', "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    kept = sorted(docs.collect(), key=lambda d: (d.doc_id is None, d.doc_id))
    assert [d.doc_id for d in kept][:2] == [1, 2] and kept[-1].doc_id is None and 6 in {d.doc_id for d in kept}
    assert "a1b2c3d4" not in "".join(d.text for d in kept)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert sum(p.start == 0 for p in packed) == len(kept)
