import math

import duckdb
import numpy as np
import pytest

from gridloom.functions import scalar
from gridloom.operators import focal, graph, lines, spectral, stats
from gridloom.plans import catalog

SF = "/root/testdata/sf0.001"


def grid_of(spark, a):
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "row int, col int, v double")


def array_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r["v"] is None else r["v"]
    return out


@pytest.fixture(scope="module")
def sample():
    rnd = np.random.default_rng(4)
    a = rnd.normal(size=(12, 15)).cumsum(axis=1) + np.arange(12)[:, None]
    a[3:5, 6:9] = np.nan
    return a


@pytest.mark.parametrize("name", ["focal_mean_3x3", "ss_kurtosis", "relief_grass", "nn_fill", "analytic_signal", "normalise_grids", "line_regularise", "decimal_year"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rel = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in rel.description]
    want = sorted((tuple(x[names.index(c)] for c in cols) for x in rel.fetchall()), key=str)
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == want


def test_mean_of_constant_and_fill(spark):
    a = np.full((6, 7), 3.0)
    a[2, 3] = np.nan
    assert np.allclose(array_of(focal.mean_filter(grid_of(spark, a), 3, 6, 7), a.shape), 3.0)


def test_nearest_fill_against_all_pairs(spark, sample):
    got = array_of(focal.fill_nearest(grid_of(spark, sample), *sample.shape), sample.shape)
    ok = np.argwhere(~np.isnan(sample))
    for r, c in np.argwhere(np.isnan(sample)):
        best = min(((r - y) ** 2 + (c - x) ** 2, y, x) for y, x in ok)
        assert got[r, c] == sample[best[1], best[2]]
    empty = np.full((3, 3), np.nan)
    assert np.isnan(array_of(focal.fill_nearest(grid_of(spark, empty), 3, 3), (3, 3))).all()


def test_upward_continuation_against_numpy_with_padding(spark, sample):
    a = np.where(np.isnan(sample), np.nanmean(sample), sample)
    s = spectral.Spectrum(grid_of(spark, a), *a.shape, buffer=3)
    got = array_of(s.apply(spectral.upward(1.5)), a.shape)
    m = np.median(a)
    (mr, mc), (lr, lc) = s.m, (s.pads[0][0], s.pads[1][0])
    p = np.pad(a - m, ((lr, mr - a.shape[0] - lr), (lc, mc - a.shape[1] - lc)), mode="linear_ramp", end_values=0)

    def tukey(n, al=0.5):
        x = np.linspace(0, 1, n)
        return np.where(x < al / 2, 0.5 * (1 + np.cos(2 * np.pi / al * (x - al / 2))), np.where(x >= 1 - al / 2, 0.5 * (1 + np.cos(2 * np.pi / al * (x - 1 + al / 2))), 1))

    p = p * tukey(mr)[:, None] * tukey(mc)
    ky, kx = -2 * np.pi * np.fft.fftfreq(mr), 2 * np.pi * np.fft.fftfreq(mc)
    want = np.fft.ifft2(np.fft.fft2(p) * np.exp(-np.hypot(ky[:, None], kx) * 1.5)).real[lr : lr + a.shape[0], lc : lc + a.shape[1]] + m
    assert np.allclose(got, want, atol=1e-9)


def test_quadric_is_removed_exactly(spark):
    r, c = np.mgrid[:9, :11]
    a = 0.5 * c * c - 0.2 * r * r + 0.1 * r * c + 3.0 * c - r + 7
    assert np.abs(array_of(stats.detrend_quadric(grid_of(spark, a), 9, 11), a.shape)).max() < 1e-8


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == 100
    assert graph.connected_components(e.limit(0)).count() == 0


def test_pca_ratios(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(200, 3)) @ rnd.normal(size=(3, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double")
    scores, ratio, _ = stats.principal_components(df, ["a", "b", "c"])
    z = (x - x.mean(0)) / x.std(0)
    want = np.sort(np.linalg.eigvalsh(np.corrcoef(z.T)))[::-1]
    assert np.allclose(ratio, want / want.sum()) and scores.count() == 200


def test_regularise_ends(spark):
    pts = spark.createDataFrame([(1, i, float(i * i), 0.0, float(i)) for i in range(5)], "line_id int, seq int, x double, y double, v double")
    got = sorted(lines.regularise(pts, 4.0).collect(), key=lambda r: r.k)
    assert [round(r.d, 9) for r in got] == [0, 4, 8, 12, 16] and got[0].v == 0 and got[-1].v == 4 and math.isclose(got[1].v, 2.0)


def test_bad_arguments():
    with pytest.raises(ValueError):
        spectral.reduction_to_pole(0, 0)
    with pytest.raises(ValueError):
        spectral.band_pass(4, 16, 1, 1)
    with pytest.raises(ValueError):
        scalar.threshold(None, "between?")
