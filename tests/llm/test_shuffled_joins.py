"""Tables that an explode has lengthened are shuffled: Spark sizes them as before it and would send them through the driver."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import jaccard, neighbours, simhash
from gridloom.plans.scratch import materialise


def broadcast_joins(df):
    """The lines of the plan that ran, for joins by broadcast."""
    run = df._jdf.queryExecution()
    run.executedPlan().executeCollectPublic()
    return [line for line in run.executedPlan().toString().split("\n== Initial Plan")[0].split("\n") if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]


def test_cells_and_hubs_are_not_broadcast(spark):
    rnd = random.Random(6)
    base = rnd.getrandbits(63)
    fps = {base} | {base ^ 1 << rnd.randrange(63) ^ 1 << rnd.randrange(63) for _ in range(300)} | {rnd.getrandbits(63) for _ in range(300)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long").coalesce(1)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/few-fingerprints"
    df.write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    assert broadcast_joins(simhash._hub_links(df)) == []
    for dense in (64, 10_000):  # with dense cells and without
        links = simhash.link_fingerprints(df, dense=dense)
        assert links.where(F.col("src") == F.col("dst")).isEmpty() and not links.isEmpty()
        assert [j for j in broadcast_joins(links) if "half" in j] == []


def broadcast_plans(df):
    """The plans under the broadcasts that ran."""
    run = df._jdf.queryExecution()
    run.executedPlan().executeCollectPublic()
    lines, found = run.executedPlan().toString().split("\n== Initial Plan")[0].split("\n"), []
    depth = lambda line: len(re.match(r"[\s:+|-]*", line).group())
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            under = itertools.takewhile(lambda x: depth(x) > depth(line), lines[i + 1 :])  # noqa: B023
            found.append("\n".join(under))
    return found


def cells_and_visits(spark, n=400):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rnd.standard_normal((n, 6)))]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    one = neighbours.entries(df, 3)
    hashes = neighbours.Hashes(6, 1.0)
    index = materialise(neighbours._index(one, hashes), "few-cells")
    queries = materialise(one.limit(8).select("key", "vec"), "few-queries")
    return index, neighbours._visits(queries, hashes, 40)


def test_visits_are_not_broadcast(spark, monkeypatch):
    index, visits = cells_and_visits(spark)
    found = []
    for few in (neighbours.BROADCAST_CELLS, 0):
        monkeypatch.setattr(neighbours, "BROADCAST_CELLS", few)
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", 4)
        best = neighbours._best(index, visits, 3)
        sent = broadcast_plans(best)
        assert all("InPandas" not in x for x in sent) and bool(sent) == bool(few)
        # Blocks of one cell are dealt over the tasks, however the cells were joined.
        plan = best._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(table#\w+, place#\w+, block#\w+, qblock#\w+", plan)
        found.append(sorted(map(tuple, best.collect())))
    assert found[0] == found[1] and found[0]


def test_sample_is_drawn_from_few_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 300)
    df = spark.range(6_000).select(F.array(F.rand(3), F.rand(4)).alias("vec")).repartition(8)
    df = materialise(df, "many-vectors")
    plain = [r.vec for r in df.orderBy(F.xxhash64("vec")).limit(300).collect()]
    low = neighbours._least(df, df.count())
    assert [r.vec for r in low.collect()] == plain
    plan = low._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Filter" in plan
    sent = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda x: sent.append(x) or collect(x))
    assert neighbours._scale(df)[0] == 2 and len(sent) == 1
    assert neighbours._scale(df.limit(1)) == (2, 1.0) and neighbours._scale(df.limit(0)) == (0, 1.0)


def test_bands_and_lists_are_not_broadcast(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts = [rnd.choices(words, k=60) for _ in range(6)]
    texts += [[rnd.choice(words) if rnd.random() < 0.01 else w for w in t] for t in texts for _ in range(8)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    nodes = jaccard._nodes(docs, "doc_id", "text")
    assert [j for j in broadcast_joins(jaccard.grid_pairs(nodes.select("node", "fp"))) if re.search(r"\[(src|dst|half)#", j)] == []
    known = materialise(nodes.select("node", F.explode("bands").alias("key")).withColumn("cls", F.col("node")), "few-bands")
    pairs = jaccard._hub_pairs(known, F.xxhash64("node"))
    assert not pairs.isEmpty() and broadcast_joins(pairs) == []
    assert broadcast_joins(jaccard._mixed(known)) == []
    sets = jaccard._sets(known.select("node").distinct(), nodes, docs, "doc_id", "text")
    met = jaccard._prefix_meetings(materialise(jaccard._mixed(known), "few-mixed"), sets)
    assert not met.isEmpty() and broadcast_joins(met) == []
