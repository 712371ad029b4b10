import hashlib
import math

import numpy as np

from gridloom.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * float(np.float32(e))) for e in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(e is not None and math.isfinite(e) for e in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(x) for _, x in start]
    d = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda: [min(range(len(c)), key=lambda j: (d(x, c[j]), j)) for _, x in kept]
    for _ in range(rounds):
        own = nearest()
        for j in range(len(c)):
            mine = [x for (_, x), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    own = nearest()
    dist = [d(x, c[o]) for (_, x), o in zip(kept, own)]
    sums = [sum(q for q, o in zip(dist, own) if o == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, o, q, sums[o], sum(dist), sha[o]) for (i, _), o, q in zip(kept, own, dist)), key=str)


def run(spark, rows, schema=SCHEMA):
    return sorted((tuple(r) for r in clusters.cluster(spark.createDataFrame(rows, schema)).collect()), key=str)


def test_rows_odd_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(e) for e in rng.normal(0, 0.2, 64)], 0) for i in range(300)]
    rows += [(i + 300, [0.5 * (j == i % 5) for j in range(64)], 1) for i in range(100)]  # many equal vectors, equal distances
    rows += [rows[5]] * 3 + [(5, [0.0] * 64, 0)] + [(None, [0.25] * 64, 0)]
    rows += [(900, None, 0), (901, [0.1] * 63, 0), (902, [0.1] * 65, 0), (903, [None, *[0.1] * 63], 0), (904, [float("nan"), *[0.1] * 63], 0), (905, [float("-inf"), *[0.1] * 63], 0), (906, [], 0)]
    assert run(spark, rows) == brute(rows)


def test_few_none_and_huge(spark):
    rows = [(i, [i / 8.0] * 64, 0) for i in range(5)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == run(spark, [(1, None, 0)]) == []
    far = clusters.cluster(spark.createDataFrame([(1, [1e30] * 64, 0), (2, [-1e30] * 64, 0), (3, [0.0] * 64, 0)], SCHEMA)).collect()
    assert {r.distance for r in far} == {0} and len({r.cluster for r in far}) == 3
    named = spark.createDataFrame([(1, [0.5] * 64, 2, 3)], "vec_id int, embedding array<double>, cluster int, x int")
    assert [(r.vec_id, r.cluster, r.distance) for r in clusters.cluster(named).collect()] == [(1, 0, 0)]


def test_bounds_skip_and_never_miss(spark):
    rng = np.random.default_rng(11)
    middle = rng.integers(-400, 400, (12, 64))
    x = np.concatenate([m + rng.integers(-20, 20, (40, 64)) for m in middle]).astype(np.int64)
    # Centroids that go back and forth: the total displacement is short though the single moves are long.
    history, dist = middle[None].astype(np.int64), clusters.squared(x, middle)
    own, when, skipped = dist.argmin(axis=1), np.zeros(dist.shape, np.int64), 0
    for step in (60, -60, 5, 0, 200):
        history = np.concatenate([history, (history[0] + (step if step != -60 else 1))[None]])
        own, measured = clusters.reassign(x, own, dist, when, history)
        assert (own == clusters.squared(x, history[-1]).argmin(axis=1)).all()
        skipped += (measured == 0).sum()
        assert measured.max() <= 12
    assert skipped > len(x)
    assert (clusters.moves(history)[:, -1] == 0).all()
    big = np.array([[2**27] * 64, [-(2**27)] * 64], dtype=np.int64)
    assert clusters.squared(big, big)[0, 1] == 64 * (2**28) ** 2


def test_state_measures_less_than_all(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(e) for e in rng.normal(i % 4, 0.05, 64)], 0) for i in range(400)]
    vectors = clusters.integer_vectors(spark.createDataFrame(rows, SCHEMA))
    state, history = clusters.kmeans(vectors, 8, 3)
    assert history.shape == (4, 8, 64)
    assert state.agg({"measured": "avg"}).first()[0] < 8
