import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import quantiles, spectral


def grid_of(spark, a):
    rows = [(r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "row int, col int, v double")


def padded(a):
    """Cell by cell: mirrored edges under half a sine, corners carried on, the far columns one place nearer."""
    nr, nc = a.shape
    size = 1 << (max(nr, nc) - 1).bit_length()
    r, c = (size - nr) // 2, (size - nc) // 2
    w = lambda k, n: (1 + math.sin(k * math.pi / n - math.pi / 2)) / 2
    g = np.zeros((size, size))
    g[r : r + nr, c : c + nc] = a
    for k in range(r):
        g[k, c : c + nc] = g[2 * r - 1 - k, c : c + nc] * w(k, r)
    for k, line in enumerate([g[size - 2 * r + k, c : c + nc].copy() for k in range(r)]):
        g[size - 1 - k, c : c + nc] = line * w(k, r)
    for k in range(c):
        g[r : r + nr, k] = g[r : r + nr, 2 * c - 1 - k] * w(k, c)
    for k, line in enumerate([g[r : r + nr, size - 2 * c + k].copy() for k in range(c)]):
        g[r : r + nr, size - 2 - k] = line * w(k, c)
    for cols in (slice(0, c), slice(c + nc - 1, size)):
        for k in range(r):
            g[k, cols] = g[r, cols] * w(k, r)
        last = g[size - r - 1, cols].copy()
        for k in range(r):
            g[size - 2 - k, cols] = last * w(k, r)
    return g


@pytest.mark.parametrize("shape", [(48, 48), (13, 20), (20, 13), (5, 30), (30, 5), (16, 16), (15, 16), (2, 9), (17, 31)])
def test_mirror_padding(shape):
    a = np.random.default_rng(1).normal(size=shape)
    p = spectral.MirrorPadding(*shape)
    parts = np.stack([p.along(row) for row in a])
    assert np.allclose(p.down(parts), padded(a))


def brute(a, inc, dec):
    """All passes over whole arrays; angles in degrees as arrays, row 0 in the north."""
    a, inc, dec = (np.flipud(x) for x in (a, np.radians(inc), np.radians(dec)))
    nr, nc = a.shape
    size = 1 << (max(nr, nc) - 1).bit_length()
    r, c = (size - nr) // 2, (size - nc) // 2
    i0, d0 = inc[nr // 2, nc // 2], dec[nr // 2, nc // 2]
    k = np.arange(size)
    wave = np.where(k < size // 2, k + 1, k - size) * 2 * np.pi / (size - 1)

    def pole(g, i, d):
        u, v = wave[:, None], wave[None, :]
        t, f = u * u + v * v, math.cos(d) * math.cos(i) * u + math.sin(d) * math.cos(i) * v
        top = math.sin(i) ** 2 * t - f * f
        under = top**2 + 4 * math.sin(i) ** 2 * f * f * t
        return np.fft.ifft2(np.fft.fft2(padded(g)) * (t * top - 2j * math.sin(i) * f * t**1.5) / under).real[r : r + nr, c : c + nc]

    holes = np.isnan(a)
    whole = np.where(holes, np.nanmean(a), a)
    near = whole.copy()
    for y, x in np.argwhere(holes):
        near[y, x] = min(((y - p) ** 2 + (x - q) ** 2, p, q, a[p, q]) for p, q in np.argwhere(~holes))[3]
    base = pole(near, i0, d0)
    out = base.copy()
    for off, di, dd in ((inc - i0, 0.01, 0.0), (dec - d0, 0.0, 0.01)):
        g = whole
        for n, w in enumerate((1.0, 0.5, 0.1666666), 1):
            g = (pole(g, i0 + di, d0 + dd) - pole(g, i0, d0)) / 0.01
            out += w * g * off**n
    out[holes] = base[holes] = np.nan
    return np.flipud(out), np.flipud(base)


def as_array(df, shape, c):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", c).collect():
        out[r.row, r.col] = np.nan if r[c] is None else r[c]
    return out


def test_variable_reduction_equals_whole_arrays(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(100, 20, (13, 20)).cumsum(axis=1)
    a[4, 5] = a[0, 0] = a[12, 19] = a[7, 8] = np.nan
    y, x = np.mgrid[0:13, 0:20]
    inc, dec = -60 + 0.4 * y - 0.2 * x, 5 + 0.3 * x + 0.1 * y
    found = spectral.variable_reduction_to_pole(grid_of(spark, a), 13, 20, F.lit(-60.0) + 0.4 * F.col("row") - 0.2 * F.col("col"), F.lit(5.0) + 0.3 * F.col("col") + 0.1 * F.col("row")).cache()
    want, base = brute(a, inc, dec)
    assert np.allclose(as_array(found, a.shape, "v"), want, equal_nan=True, rtol=1e-7, atol=1e-6)
    assert np.allclose(as_array(found, a.shape, "base"), base, equal_nan=True, rtol=1e-9, atol=1e-7)


def test_constant_angles_and_corners(spark):
    a = np.random.default_rng(5).normal(size=(8, 9))
    found = spectral.variable_reduction_to_pole(grid_of(spark, a), 8, 9, F.lit(-65.0), F.lit(3.0))
    assert found.where("abs(v - base) > 1e-9").count() == 0
    cells = grid_of(spark, a).withColumn("angle", spectral.corner_angles(8, 9, (1.0, 2.0, 3.0, 4.0), 7.0)).cache()
    at = as_array(cells, (8, 9), "angle")
    assert np.allclose([at[0, 0], at[0, 8], at[7, 0], at[7, 8]], [1, 2, 3, 4])
    middle = grid_of(spark, np.zeros((9, 9))).withColumn("angle", spectral.corner_angles(9, 9, (1.0, 2.0, 3.0, 4.0), 7.0))
    assert math.isclose(middle.where("row = 4 AND col = 4").first().angle, 7.0)
    with pytest.raises(ValueError):
        spectral.variable_reduction_to_pole(grid_of(spark, a), 8, 9, F.lit(None), F.lit(3.0))
    with pytest.raises(ValueError):
        spectral.corner_angles(1, 9, (1.0, 2.0, 3.0, 4.0))


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "one", "infinite"])
def test_quantiles_against_sorting(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "BUCKETS", 16)
    monkeypatch.setattr(quantiles, "FEW", 5)
    rng = random.Random(kind)
    make = {
        "normal": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.choice([1, 1, 1, 2, 50])), "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 308),
        "one": lambda: 4.5, "infinite": lambda: rng.choice([math.inf, -math.inf, 1.0, rng.random()]),
    }[kind]
    values = [make() for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in [*values, None, math.nan]], "x double")
    ordered = sorted(values)
    ranks = [0, 1, 17, 199, 200, 398, 399, 400, -1]
    assert quantiles.order_statistics(df, "x", ranks) == {r: ordered[r] for r in ranks[:-2]}
    if kind not in ("infinite", "wide"):
        assert np.allclose(quantiles.quantiles(df, "x", [0.0, 0.1, 0.5, 0.99, 1.0]), np.quantile(values, [0.0, 0.1, 0.5, 0.99, 1.0]))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (math.nan,)], "x double")
    assert quantiles.quantiles(df, "x", [0.5]) == [None]
    assert quantiles.order_statistics(df, "x", [0]) == {}
