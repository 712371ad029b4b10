import math

import numpy as np

from gridloom.operators import wavelet2d


def grid_of(spark, a):
    return spark.createDataFrame([(r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], "row int, col int, v double")


def test_ridge_of_a_step(spark):
    a = np.zeros((40, 40))
    a[:, 20:] = 7.0  # a step to the east between columns 19 and 20
    found = wavelet2d.maxima(wavelet2d.transform(grid_of(spark, a), 40, 40, [1.0, 2.0, 4.0], buffer=20), 0.5)
    rows = found.where("row BETWEEN 8 AND 31 AND col BETWEEN 10 AND 30").collect()
    assert {(r.scale_no, r.row) for r in rows} == {(k, y) for k in range(3) for y in range(8, 32)} and all(r.col in (19, 20) for r in rows)
    assert all(abs(r.direction - math.pi / 2) < 0.05 for r in rows)  # the ridge runs north to south
    chains = wavelet2d.chains(found).where("start_row BETWEEN 8 AND 31 AND start_col IN (19, 20)").collect()
    assert {(r.start_row, r.scale_no) for r in chains} == {(y, k) for y in range(8, 32) for k in range(3)}
    assert wavelet2d.transform(grid_of(spark, np.ones((8, 8))), 8, 8).count() == 0


def test_chains_against_a_plain_search(spark):
    rng = np.random.default_rng(6)
    scales = {0: 1.0, 1: 1.5, 3: 3.0}
    rows = [(k, s, int(r), int(c), float(rng.random()), float(rng.choice([0.1, 0.4, 3.3, -6.1]))) for k, s in scales.items() for r, c in {tuple(x) for x in rng.integers(0, 25, (60, 2)).tolist()}]
    df = spark.createDataFrame(rows, "scale_no int, scale double, row int, col int, modulus double, direction double")
    got = {}
    for r in wavelet2d.chains(df).collect():
        got.setdefault((r.start_row, r.start_col), []).append((r.scale_no, r.row, r.col, r.modulus))
    want = {}
    for _, _, r0, c0, m0, d0 in (x for x in rows if x[0] == 0):
        r, c, d, chain, before = r0, c0, d0, [(0, r0, c0, m0)], 1.0
        for k in (1, 3):
            turn = lambda e: abs((e - d + math.pi) % (2 * math.pi) - math.pi)  # noqa: E731, B023
            near = [(math.hypot(x[2] - r, x[3] - c), x[2], x[3], x[5], x[4]) for x in rows if x[0] == k and turn(x[5]) < math.pi / 4]
            near = [x for x in near if x[0] < 2.0 * scales[k] / before]
            if near:
                _, r, c, d, m = min(near)
                chain.append((k, r, c, m))
            before = scales[k]
        if len(chain) > 1:
            want[r0, c0] = chain
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 10
    assert wavelet2d.chains(df.limit(0)).count() == 0
