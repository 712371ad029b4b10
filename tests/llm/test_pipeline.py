"""The stages over odd rows: nulls, empties, repeats, long texts, columns with working names."""

import hashlib

import corpus_pipeline
from gridloom.llm import bpe, pii
from gridloom.plans.scratch import materialise
from pyspark.sql import functions as F

NAMES = ["_loose", "_base", "_spans", "_f", "_q", "_k", "_th", "_key", "_bpe", "_own", "_id", "th", "node", "key"]


def test_stages_keep_columns_and_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    own = spark.read.parquet(sf + "/documents.parquet")
    long = "a sentence with a mail address jo@example.com and more words in it. " * 3000
    odd = [(None, None), (None, None), (None, "Null id with its own words and nothing else to say here today."), (900001, ""), (900002, long), (900002, long), (900003, "same id"), (900003, "another text under one id")]
    rows = spark.createDataFrame(odd, "doc_id long, text string")
    docs = own.unionByName(rows, allowMissingColumns=True).withColumn("n_chars", F.length("text").cast(own.schema["n_chars"].dataType))
    docs = docs.withColumns({n: F.lit(n) for n in NAMES})
    before = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = materialise(stage(spark, docs, sf), f"test-{name}")
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        kept = got.collect()
        assert kept and all(r[n] == n for r in kept for n in NAMES)
        if name != "pii":
            assert {(r.doc_id, r.text) for r in kept} <= before
            before = {(r.doc_id, r.text) for r in kept}
        else:
            assert len(kept) == docs.count() and all(r.n_chars is None or r.n_chars == len(r.text) for r in kept)
            assert not any("jo@example.com" in (r.text or "") for r in kept)
        if name == "simhash":
            assert len(kept) == len({r.text for r in kept if r.text})  + any(not r.text for r in kept)
        docs = got
    codec, last = bpe.Codec(bpe.vocabulary_path()), docs.select("doc_id", "text").collect()
    want = sorted(str((r.doc_id, *codec.digest(codec.encode(r.text)))) for r in last)
    assert sorted(str(tuple(r)) for r in corpus_pipeline.encoded(spark, docs, sf).collect()) == want
    assert hashlib.sha256(b"").hexdigest() == codec.digest([])[1]
    empty = own.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
    assert pii.redact(empty).columns == empty.columns
