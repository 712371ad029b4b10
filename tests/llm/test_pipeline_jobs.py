"""The driver's memory follows the jobs and plans of a stage, so their number is bounded."""

import random

import corpus_pipeline
from gridloom.operators.graph import connected_components
from gridloom.plans.scratch import materialise


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_stages_run_few_jobs(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good, n = jobs(spark, "quality", lambda: materialise(corpus_pipeline.good_quality(spark, docs, sf), "few-quality"))
    assert 0 < good.count() <= docs.count()
    one, m = jobs(spark, "simhash", lambda: materialise(corpus_pipeline.one_of_each(spark, good, sf), "few-simhash"))
    assert 0 < one.count() < good.count()
    assert m <= 120


def test_what_rounds_leave_is_solved_by_one_task(spark):
    rnd = random.Random(4)
    parts = [list(range(k * 1000, k * 1000 + size)) for k, size in enumerate((2, 5, 40, 120))]
    edges = [(9999, 9999)]
    for nodes in parts:
        rnd.shuffle(nodes)
        edges += list(zip(nodes, nodes[1:]))
    rnd.shuffle(edges)
    df = spark.createDataFrame(edges, "src long, dst long")
    want = sorted([(n, min(p)) for p in parts for n in p] + [(9999, 9999)])
    counts = []
    for small in (0, 60, 10_000):
        got, n = jobs(spark, f"components-{small}", lambda: connected_components(df, small).collect())  # noqa: B023
        assert sorted((r.node, r.component) for r in got) == want
        counts.append(n)
    assert counts[0] > counts[1] > counts[2]
