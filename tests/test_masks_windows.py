import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import focal, masks, spectral, stats
from gridloom.sources import tables


def grid_of(spark, a):
    return spark.createDataFrame([(r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], "row int, col int, v double")


def array_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.row, r.col] = np.nan if r.v is None else r.v
    return out


def test_masks_keep_the_middle_and_refuse_nonsense(spark):
    ones = grid_of(spark, np.ones((21, 15)))
    for how in ({}, {"shape": "circle", "size": 12, "edge": 4}, {"window": "cosine"}, {"edge": 0}, {"window": lambda x: x}):
        w = array_of(masks.masked(ones, masks.mask(21, 15, **how)), (21, 15))
        assert w[10, 7] == 1 and w.min() >= 0 and w.max() <= 1 + 1e-12 and np.allclose(w, w[::-1, ::-1])
    assert array_of(masks.masked(ones, masks.mask(21, 15, shape="circle", size=12, edge=4)), (21, 15))[10, 0] == 0
    for how in ({"shape": "star"}, {"window": "none of these"}):
        with pytest.raises(ValueError):
            masks.mask(5, 5, **how)


def test_embedding_and_shifts_come_back(spark):
    a = np.random.default_rng(1).normal(size=(7, 10))
    big = masks.embedded(grid_of(spark, a), 7, 10, 12, 15, 2)
    top, left = 2, 2
    want = np.zeros((12, 15))
    want[top - 2 : top + 9, left - 2 : left + 12] = np.pad(a - a.mean(), 2, mode="edge")
    assert np.allclose(array_of(big, (12, 15)), want)
    assert np.allclose(array_of(masks.cut_out(big, 7, 10, 12, 15), (7, 10)), a - a.mean())
    there = masks.shifted(big, 12, 15)
    assert np.allclose(array_of(there, (12, 15)), np.fft.fftshift(want)) and np.allclose(array_of(masks.shifted(there, 12, 15, back=True), (12, 15)), want)
    for bad in ((6, 15, 0), (12, 15, 3)):
        with pytest.raises(ValueError):
            masks.embedded(big, 7, 10, *bad)


def test_windows_and_statistics_given_as_functions(spark):
    a = np.random.default_rng(2).normal(size=(12, 9))
    own = spectral.Spectrum(grid_of(spark, a), 12, 9, window=np.blackman, level="none").apply(lambda kx, ky, k: np.ones_like(k))
    assert np.allclose(array_of(own, a.shape), a * np.outer(np.blackman(12), np.blackman(9)))
    named = array_of(focal.windowed_stat(grid_of(spark, a), "mean", 3, 12, 9), a.shape)
    given = array_of(focal.windowed_stat(grid_of(spark, a), lambda v: F.sum(v) / F.count(v), 3, 12, 9), a.shape)
    assert np.allclose(named, given)


def test_components_that_cannot_settle_say_so(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(rng.normal(size=(60, 2)).tolist(), "a double, b double")
    with pytest.warns(UserWarning, match="did not settle"):
        stats.independent_components(df, ["a", "b"], rounds=1, tolerance=0.0, starts=2)


def test_older_definitions_and_rows(spark, tmp_path):
    text = "DEFN 1 ST=RECD,RT=DATA;RT:A4;X:F8.1\nDEFN 2 ST=RECD,RT=DATA;X:F8.1\nDEFN 3 ST=RECD,RT=DATA;N:I4;END\nWGS84"
    fields, epsg, typed = tables.legacy_definitions(text, "GDA94 / MGA zone 55 (south)")
    assert ([f["name"] for f in fields], [f["kind"] for f in fields], epsg, typed) == (["RT", "X", "N"], ["string", "double", "int"], 28355, True)
    assert tables.legacy_definitions(text)[1] == 4326 and tables.legacy_definitions("GDA94 zone 12")[1] is None
    (tmp_path / "d.dat").write_text("DATA a 1.5 7\nDATA b 2\n  c  bad 8.5 9\n\nd 1\nDATAe 3 4 5\n")
    rows = {tuple(r) for r in tables.legacy_data(spark, fields, str(tmp_path / "d.dat"), True).collect()}
    assert rows == {("a", 1.5, 7), ("c", None, None), ("e", 3.0, 4)}
    plain = {tuple(r) for r in tables.legacy_data(spark, fields, str(tmp_path / "d.dat"), False).collect()}
    assert plain == {("a", 1.5, 7), ("b", 2.0, None), ("c", None, None), ("e", 3.0, 4)}
