import duckdb
import numpy as np
import pytest

from gridloom.operators import surfaces, terrain
from gridloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["agc", "slope_curvature", "dtm_class", "idw_grid", "rgb_to_scalar", "boundary_edges", "point_trend"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({catalog.ORACLES[name]})")
    assert sorted(d[0] for d in want.description) == cols
    rows = lambda rs: sorted((tuple(r) for r in rs), key=repr)
    have, want = rows(got.select(*cols).collect()), rows(want.fetchall())
    assert len(have) == len(want) > 0
    for a, b in zip(have, want):
        assert a == pytest.approx(b, abs=2e-5, nan_ok=True)


def test_long_cliff_and_flat_ground(spark):
    rows = [(r, c, 0.0 if c < 10 else 50.0) for r in range(20) for c in range(20)]
    got = {(r["row"], r["col"]): r["v"] for r in terrain.classify(spark.createDataFrame(rows, "row int, col int, v double"), 20, 20).collect()}
    assert len(got) == 400 and all(got[r, c] == 2 for r in range(4, 16) for c in (9, 10)) and got[10, 2] == 0


def test_trend_of_second_degree_is_exact_and_nulls_stay_out(spark):
    rnd = np.random.default_rng(1)
    xy = rnd.uniform(0, 9, (60, 2))
    rows = [(float(x), float(y), float(3 + x - 2 * y + x * y + 0.5 * y * y)) for x, y in xy] + [(1.0, 1.0, None)]
    out, terms = surfaces.point_trend(spark.createDataFrame(rows, "x double, y double, z double"), 2)
    assert len(terms) == 6 and max(abs(r["residual"]) for r in out.where("z IS NOT NULL").collect()) < 1e-8
    assert out.where("z IS NULL AND trend IS NOT NULL AND residual IS NULL").count() == 1
    none, terms = surfaces.point_trend(spark.createDataFrame([], "x double, y double, z double"), 2)
    assert none.count() == 0 and terms == []


def test_points_on_a_centre_and_out_of_reach(spark):
    pts = spark.createDataFrame([(0.5, 0.5, 4.0), (1.5, 0.5, 8.0), (99.0, 99.0, 1.0), (None, 1.0, 2.0)], "x double, y double, z double")
    got = {(r["row"], r["col"]): (r["v"], r["n"]) for r in surfaces.inverse_distance(pts, 3, 3, 1.0).collect()}
    assert got == {(0, 0): (4.0, 2), (0, 1): (8.0, 2), (1, 0): (4.0, 1), (1, 1): (8.0, 1), (0, 2): (8.0, 1)}


def test_white_black_and_incomplete_pixels_are_nodata(spark):
    px = spark.createDataFrame([(0, 0, 255, 255, 255), (0, 1, 0, 0, 0), (0, 2, None, 1, 1), (0, 3, 250, 3, 0)], "row int, col int, r int, g int, b int")
    got = {r["col"]: r["v"] for r in surfaces.colour_to_scalar(px, [(0, 0, 255), (255, 0, 0)]).collect()}
    assert got == {0: None, 1: None, 2: None, 3: 1.0}
