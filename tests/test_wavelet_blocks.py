import math

import numpy as np
import pytest

from gridloom.operators import wavelet


def line(spark, values, k=1):
    return [(k, i, None if v is None else float(v)) for i, v in enumerate(values)]


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_blocks_change_nothing(spark, block):
    rng = np.random.default_rng(2)
    lines = {1: rng.normal(size=150).cumsum(), 2: np.sin(np.arange(61) / 5), 3: np.ones(20), 4: [1.0], 5: [0.0, 3.0]}
    df = spark.createDataFrame([r for k, v in lines.items() for r in line(spark, v, k)], "line_id long, pos int, v double")
    got = {}
    for r in wavelet.transform(df, 4, block=block).collect():
        got.setdefault((r.line_id, r.scale_no), {})[r.pos] = (r.scale, r.w)
    assert {k for k, _ in got} == {1, 2, 5}
    for (k, s), at in got.items():
        v = np.asarray(lines[k])
        x = (v - v.min()) / (v.max() - v.min())
        a = 10 ** (s * math.log10(max(len(v) / 4, 1)) / 3)
        kernel = wavelet._kernel(a)
        want = np.convolve(x, kernel)[len(kernel) // 2 :][: len(x)]
        assert sorted(at) == list(range(len(v))) and np.allclose([at[i][1] for i in range(len(v))], want, atol=1e-12)
        assert all(math.isclose(sc, a) for sc, _ in at.values())


def test_long_kernels_by_transform():
    rng = np.random.default_rng(3)
    x, kernel = rng.normal(size=9000), wavelet._kernel(300.0)
    direct = np.convolve(x, kernel)
    assert len(x) * len(kernel) > wavelet._DIRECT and np.allclose(wavelet._response(x, kernel), direct, atol=1e-9)


@pytest.mark.parametrize("block", [5, 1 << 16])
def test_peaks_over_blocks(spark, block):
    rng = np.random.default_rng(7)
    v = rng.integers(0, 12, 300).astype(float)
    places = np.sort(rng.choice(900, 300, replace=False))
    df = spark.createDataFrame([(1, int(p), float(x)) for p, x in zip(places, v)] + [(2, 4, 1.0)], "line_id long, pos int, value double")
    up = [k for k in range(300) if (k == 0 or v[k] > v[k - 1]) and (k == 299 or v[k] > v[k + 1]) and v[k] > 0.3 * v.max()]
    for distance in (1, 4, 40):
        kept = []
        for k in sorted(up, key=lambda k: (-v[k], -places[k])):
            if all(abs(places[k] - q) >= distance for q in kept):
                kept.append(int(places[k]))
        got = wavelet.peaks(df, ["line_id"], "value", 0.3, distance, block).collect()
        assert sorted(r.pos for r in got if r.line_id == 1) == sorted(kept)
        assert [(r.pos, r.value) for r in got if r.line_id == 2] == [(4, 1.0)]


def test_chains_against_a_plain_search(spark):
    rng = np.random.default_rng(9)
    rows = [(1, s, 2.0**s, int(p), float(p)) for s in (0, 1, 2, 4) for p in np.sort(rng.choice(200, 30 - 6 * s, replace=False))]
    rows += [(2, 1, 2.0, 5, 1.0), (2, 2, 4.0, 5, 1.0), (3, 0, 1.0, 9, 1.0)]
    got = {}
    for r in wavelet.chains(spark.createDataFrame(rows, "line_id long, scale_no int, scale double, pos int, value double")).collect():
        got.setdefault((r.line_id, r.chain), []).append((r.scale, r.pos))
    levels = {s: [p for k, n, _, p, _ in rows if k == 1 and n == s] for s in (0, 1, 2, 4)}
    want = []
    for p in levels[0]:
        chain, before = [(1.0, p)], 0
        for s in (1, 2, 4):
            near = min(levels[s], key=lambda q: (abs(q - chain[-1][1]), q))
            if abs(near - chain[-1][1]) < 2.0 * 2.0 ** (s - before):
                chain.append((2.0**s, near))
            before = s
        if len(chain) > 1:
            want.append(chain)
    assert [sorted(got[k]) for k in sorted(got)] == want


def _by_group(df):
    return "FlatMapGroups" in df._jdf.queryExecution().analyzed().toString()


def test_many_short_lines_share_batches(spark):
    df = spark.createDataFrame([r for k in range(5) for r in line(spark, [0, 3, 1, 4], k)], "line_id long, pos int, v double")
    assert not _by_group(wavelet.transform(df, 3)) and wavelet.transform(df, 3).count() == 5 * 3 * 4
    apart = wavelet.peaks(df.withColumnRenamed("v", "value"), ["line_id"], "value", 0.0, 3)
    assert not _by_group(apart) and sorted((r.line_id, r.pos) for r in apart.collect()) == [(k, 3) for k in range(5)]
    levels = [(k, s, 2.0**s, p, 1.0) for k in range(5) for s in (0, 1) for p in (3, 8)]
    followed = wavelet.chains(spark.createDataFrame(levels, "line_id long, scale_no int, scale double, pos int, value double"))
    assert not _by_group(followed) and followed.count() == 5 * 2 * 2
