from gridloom.llm import sampling


def test_sample_is_bounded_and_takes_only_chosen_ids(spark):
    rows = [(7, f"copy {k}", "x") for k in range(40)] + [(k, f"text {k}", "y") for k in range(100, 160)] + [(None, "no id", "z"), (200, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    labels = spark.createDataFrame([(7, 1), *((k, k % 2) for k in range(100, 160)), (101, 0), (200, 1), (None, 1)], "doc_id long, toxic int")
    ids = sampling.labelled(docs, labels, "toxic", "doc_id", 5, 0)
    assert 101 not in {r.id for r in ids.collect()}, "contradicting labels"
    for n in (5, 1000):
        got = sampling.with_texts(docs, ids, "doc_id", "text", n, 3).collect()
        count = {y: sum(r.y == y for r in got) for y in (0, 1)}
        assert count == {y: min(n, ids.where(f"y = {y}").count()) for y in (0, 1)}
        assert all(r.text == f"text {r.id}" for r in got if 100 <= r.id < 160)
    assert sampling.with_texts(docs.limit(0), ids.limit(0), "doc_id", "text", 5, 3).count() == 0
