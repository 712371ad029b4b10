"""Operators that SQL cannot express, against brute force, known fields or exact round trips."""

import math

import numpy as np
import pytest

from gridloom.functions import scalar
from gridloom.operators import field, outlines, spectral, stats, streamlines, surfaces, wavelet, worms
from gridloom.sources import raster, tables
from pyspark.sql import functions as F


def grid_of(spark, a):
    return spark.createDataFrame([(r, c, None if np.isnan(x) else float(x)) for r, line in enumerate(a) for c, x in enumerate(line)], "row int, col int, v double")


def array_of(df, shape, v="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[v] is None else r[v]
    return out


def test_gradient_of_a_spike(spark):
    a = np.zeros((16, 8))
    a[7, 3] = 1
    g = worms.wrapped_gradient(grid_of(spark, a), "v", "gx", "gy")
    gx, gy = array_of(g, a.shape, "gx"), array_of(g, a.shape, "gy")
    want = np.zeros_like(a)
    want[7, 2], want[7, 4] = 1, -1
    assert np.array_equal(gx, want)
    want = np.zeros_like(a)
    want[6, 3], want[8, 3] = 1, -1
    assert np.array_equal(gy, want)


def test_continued_spike_keeps_its_sum(spark):
    a = np.zeros((30, 20))
    a[14, 9] = 1
    s = spectral.Spectrum(grid_of(spark, a), 30, 20, pads=((0, 0), (0, 0)), window="none", level="none", fill="level")
    sums = s.filtered({f"h{h}": spectral.upward(h) for h in (20, 10, 5, 1)}).agg(*[F.sum(f"h{h}") for h in (20, 10, 5, 1)]).first()
    assert np.allclose(list(sums), 1)


def walk(points, eps):
    """Greedy walk by comparing all points at every step."""
    left, order = list(range(1, len(points))), [0]
    while left:
        d = lambda k: math.dist(points[k], points[order[-1]])
        nearest = sorted(range(len(points)), key=lambda k: (d(k), k))[:10]
        step = [k for k in nearest if k in left and d(k) <= eps]
        nxt = step[0] if step else min(left, key=lambda k: (min(math.dist(points[k], points[o]) for o in order), k))
        left.remove(nxt)
        order.append(nxt)
    return order


def test_polylines_against_a_plain_walk(spark):
    rnd = np.random.default_rng(4)
    xy = np.cumsum(rnd.normal(size=(60, 2)), axis=0)
    df = spark.createDataFrame([(5.0, i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(0.5, 900, 0.0, 0.0), (0.5, 901, 0.1, 0.0), (7.0, 902, 0.0, 0.0)], "z double, id long, x double, y double")
    eps = 1.5
    groups = {}
    for r in worms.clusters(df, eps).collect():
        groups.setdefault(r.cluster, []).append(r.id)
    want = set()
    for ids in groups.values():
        pts = [tuple(xy[i]) for i in sorted(ids)]
        order, part = walk(pts, eps), []
        for a, b in zip([None, *order], order):
            if a is not None and math.dist(pts[a], pts[b]) > eps:
                want |= {tuple(part)} if len(part) > 1 else set()
                part = []
            part.append(pts[b])
        want |= {tuple(part)} if len(part) > 1 else set()
    got = {}
    for r in worms.polylines(df, eps).collect():
        assert r.z == 5.0
        got.setdefault((r.cluster, r.line), {})[r.seq] = (r.x, r.y)
    assert {tuple(v[k] for k in sorted(v)) for v in got.values()} == want
    assert worms.polylines(df.limit(0), eps).count() == 0


def test_components_of_mixed_sources(spark):
    rnd = np.random.default_rng(2)
    s = np.stack([rnd.uniform(-1, 1, 3000), rnd.laplace(size=3000)], axis=1)
    x = s @ np.array([[1.0, 0.6], [0.4, 1.0]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, p double, q double")
    scores, weights = stats.independent_components(df, ["p", "q"])
    got = np.array([(r.ic1, r.ic2) for r in scores.orderBy("id").collect()])
    c = np.abs(np.corrcoef(got.T, s.T)[:2, 2:])
    assert sorted(c.max(axis=1) > 0.98) == [True, True] and c.argmax(axis=1).tolist() in ([0, 1], [1, 0])
    assert all(max(w, key=abs) > 0 for w in weights)


def trace(m, o, r, c, way, least, tol, step, most):
    at, before, length = [float(r), float(c)], o[r, c], 0.0
    nr, nc = m.shape
    for _ in range(most):
        y, x = at
        if not (0 <= y < nr and 0 <= x < nc):
            break
        i, j = min(max(int(y), 0), nr - 2), min(max(int(x), 0), nc - 2)
        u, v = min(max(y - i, 0), 1), min(max(x - j, 0), 1)
        w = [((i, j), (1 - u) * (1 - v)), ((i, j + 1), (1 - u) * v), ((i + 1, j), u * (1 - v)), ((i + 1, j + 1), u * v)]
        if sum(m[p] * q for p, q in w) < least:
            break
        t = [(2 * math.radians(o[p]), q) for p, q in w]
        theta = math.degrees(math.atan2(sum(math.sin(a) * q for a, q in t), sum(math.cos(a) * q for a, q in t))) / 2 % 180
        d = abs(theta - before) % 180
        if min(d, 180 - d) > tol:
            break
        at = [y - way * math.sin(math.radians(theta)) * step, x + way * math.cos(math.radians(theta)) * step]
        length += step
        before = theta
    return length


@pytest.mark.parametrize("tile", [5, 256])
def test_streamlines_cell_by_cell(spark, tile):
    r, c = np.mgrid[:14, :17]
    m, o = 0.5 + 0.4 * np.sin(r / 3) * np.cos(c / 4), (r * 9 + c * 5) % 180 * 1.0
    m[3, 4] = np.nan
    df = spark.createDataFrame([(int(i), int(j), None if np.isnan(m[i, j]) else float(m[i, j]), float(o[i, j])) for i in range(14) for j in range(17)], "row int, col int, magnitude double, orientation double")
    got = array_of(streamlines.streamline_length(df, 14, 17, most=12, tile=tile), m.shape)
    clean = np.where(np.isnan(m), 0, m)
    want = np.full(m.shape, np.nan)
    for i in range(14):
        for j in range(17):
            if m[i, j] >= 0.3:
                want[i, j] = sum(trace(clean, o, i, j, w, 0.3, 22.5, 0.5, 12) for w in (1, -1))
    assert np.allclose(got, want, equal_nan=True)


def test_spline_comes_near_smooth_points(spark):
    rnd = np.random.default_rng(6)
    p = rnd.uniform(0, 20, (600, 2))
    z = np.sin(p[:, 0] / 5) + p[:, 1] / 10
    df = spark.createDataFrame([(float(x), float(y), float(h)) for (x, y), h in zip(p, z)], "x double, y double, z double")
    got = array_of(surfaces.b_spline(df, 20, 20, 5), (20, 20))
    r, c = np.mgrid[:20, :20] + 0.5
    want = np.sin(c / 5) + r / 10
    assert np.abs(got - want)[2:-2, 2:-2].mean() < 0.05
    coarse = array_of(surfaces.b_spline(df, 20, 20, 1), (20, 20))
    assert np.abs(got - want).mean() < np.abs(coarse - want).mean()


def test_rings_with_holes_and_touching_corners(spark):
    a = np.full((7, 8), np.nan)
    a[1:6, 1:6] = 1
    a[2:5, 2:5] = np.nan
    a[3, 3] = 1  # an island in the hole
    a[0, 6] = a[6, 6] = 1  # touch the block's corners
    got = sorted((r.area, r.holes) for r in outlines.polygons(grid_of(spark, a)).collect())
    assert got == [(1.0, 0), (1.0, 0), (1.0, 0), (16.0, 1)]
    ids = [r.id for r in outlines.polygons(grid_of(spark, a)).orderBy("id").collect()]
    assert ids == [1, 2, 3, 4]
    assert outlines.polygons(grid_of(spark, a * np.nan)).count() == 0


def test_field_of_a_dipole_and_its_poles(spark):
    co = spark.createDataFrame([(1, 0, 2000.0, -30000.0), (1, 1, 2000.0, 0.0), (1, -1, 2000.0, 0.0)], "n int, m int, year double, coef double")
    p = spark.createDataFrame([(0.0, 10.0, 0.0), (90.0, 0.0, 0.0), (-45.0, 200.0, 0.0), (95.0, 0.0, 0.0), (None, 1.0, 0.0)], "lat double, lon double, alt double")
    r = {x.lat: x for x in field.main_field(p, co, 2000.0, geodetic=False).collect()}
    assert abs(r[0.0].intensity - 30000) < 1e-6 and abs(r[0.0].inc) < 1e-9 and abs(r[90.0].inc - 90) < 1e-6 and abs(r[90.0].intensity - 60000) < 1e-6
    assert abs(r[-45.0].inc + math.degrees(math.atan(2))) < 1e-6 and r[95.0].inc is None and r[None].inc is None


def test_peaks_apart_and_chains(spark):
    v = [0.0, 5, 1, 4, 4.5, 1, 7, 6.9, 7, 0, 3]
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "line_id long, pos int, value double")
    at = lambda d: sorted(r.pos for r in wavelet.peaks(df, ["line_id"], "value", 0.0, d).collect())
    assert at(1) == [1, 4, 6, 8, 10] and at(3) == [1, 5 - 1, 8] and at(50) == [8]
    mx = spark.createDataFrame([(1, 0, 1.0, 5, 1.0), (1, 0, 1.0, 20, 1.0), (1, 1, 2.0, 8, 2.0), (1, 2, 4.0, 9, 3.0), (1, 2, 4.0, 23, 3.0)], "line_id long, scale_no int, scale double, pos int, value double")
    got = sorted((r.chain, r.scale_no, r.pos) for r in wavelet.chains(mx).collect())
    assert got == [(0, 0, 5), (0, 1, 8), (0, 2, 9), (1, 0, 20), (1, 2, 23)]


def test_tiff_bytes(tmp_path):
    rnd = np.random.default_rng(1)
    a = rnd.normal(size=(2, 300, 170)).astype("f4")
    a[0, 3, 4] = np.nan
    for how in ({}, {"deflate": True, "nodata": -9999.0}):
        raw = raster.encode(a, (10.0, 2.0, 0.0, 50.0, 0.0, -2.0), 4326, tags={"k": "v"}, names=["p", "q"], **how)
        b, about = raster.decode(raw)
        assert np.array_equal(a, b.astype("f4"), equal_nan=True) and about["transform"] == (10.0, 2.0, 0.0, 50.0, 0.0, -2.0)
        assert about["epsg"] == 4326 and about["tags"] == {"k": "v"} and about["names"] == {1: "p", 2: "q"}
    turned = raster.decode(raster.encode(a[0], (1.0, 2.0, 0.5, 3.0, 0.25, 4.0)))[1]["transform"]
    assert turned == (1.0, 2.0, 0.5, 3.0, 0.25, 4.0)
    with pytest.raises(ValueError):
        raster.decode(b"XX**")
    assert raster.suffixed("a/b.c/grid.ers", "_RTP") == "a/b.c/grid_RTP.tif" and raster.suffixed("grid", "_X") == "grid_X.tif"


def test_names_colours_and_definitions(spark, tmp_path):
    assert tables.short_names(["a_very_long_name", "a_very_long_other", "A_VERY_LON", "b"]) == ["a_very_lon", "a_very_lo1", "A_VERY_LO2", "b"]
    assert surfaces.parse_colours("red, blue", 3) == [(0, 0, 255), (127, 0, 127), (255, 0, 0)]
    assert surfaces.parse_colours("(0,0,0),(1,1,1)", 2) == [(255, 255, 255), (0, 0, 0)]
    with pytest.raises(ValueError):
        surfaces.parse_colours("1,2", 2)
    _, epsg = tables.definitions("DEFN 1 ST=RECD,RT=; X: F8.2: NAME=GDA94 / MGA zone 51")
    assert epsg == 28351
    (tmp_path / "p.txt").write_text("id  LAT   Lon\n1 -30.5 118\n2 bad 119\n\n3 -31 120\n")
    got = [tuple(r) for r in tables.points(spark, str(tmp_path / "p.txt")).orderBy("id").collect()]
    assert got == [(118.0, -30.5, 1.0), (120.0, -31.0, 3.0)]


def test_close_and_odd(spark):
    inf, nan = math.inf, math.nan
    rows = [(1.0, 1.0 + 1e-9, True), (inf, inf, True), (inf, -inf, False), (nan, nan, False), (1.0, 2.0, False), (None, 1.0, False), (inf, 1.0, False)]
    df = spark.createDataFrame(rows, "a double, b double, want boolean")
    assert df.where(scalar.close(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    n = spark.createDataFrame([(-3.0,), (1.0,), (2.0,), (4.2,)], "n double").select(scalar.odd(F.col("n"))).collect()
    assert [r[0] for r in n] == [1, 1, 3, 5]
