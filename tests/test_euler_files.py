import struct
import zlib

import duckdb
import numpy as np
import pytest

from gridloom.operators import crossings, euler
from gridloom.plans import catalog
from gridloom.sources import files


def test_euler_finds_a_point_source(spark):
    n, (x0, y0, z0), si = 12, (5.3, 6.1, 3.0), 2.0
    y, x = np.indices((n, n)).astype(float)
    r2 = (x - x0) ** 2 + (y - y0) ** 2 + z0**2
    v = r2 ** (-si / 2)
    slope = -si * r2 ** (-si / 2 - 1)
    rows = [(int(j), int(i), float(v[j, i]) + 4.0, float(slope[j, i] * (i - x0)), float(slope[j, i] * (j - y0)), float(slope[j, i] * -z0)) for j in range(n) for i in range(n)]
    f = spark.createDataFrame(rows, "row int, col int, v double, dx double, dy double, dz double")
    got = euler.deconvolve(f, [1.0, si], 5, n, n)
    at = got.where(f"si = {si}").toPandas()
    assert len(at) == (n - 4) ** 2
    assert np.allclose(at[["x", "y", "z", "base"]], [x0, y0, z0, 4.0], atol=1e-5)
    kept = euler.keep_most_varied(got, 0.1).toPandas()
    assert kept.groupby("si").size().tolist() == [6, 6]
    want = at.sort_values(["stdz", "row", "col"], ascending=[False, True, True]).head(6)
    assert set(map(tuple, kept[kept.si == si][["row", "col"]].values)) == set(map(tuple, want[["row", "col"]].values))
    holed = f.where("NOT (row = 0 AND col = 0)")
    assert euler.deconvolve(holed, [si], 5, n, n).count() == (n - 4) ** 2 - 1
    flat = f.selectExpr("row", "col", "v", "0.0 AS dx", "0.0 AS dy", "0.0 AS dz")
    assert euler.deconvolve(flat, [si], 5, n, n).count() == 0


@pytest.mark.parametrize("name", ["zero_crossings", "threshold_between", "sample_points"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    cols = sorted(got.columns)
    want = con.sql(catalog.ORACLES[name]).df()[cols].sort_values(cols).reset_index(drop=True)
    have = got.toPandas()[cols].sort_values(cols).reset_index(drop=True)
    assert len(want) == len(have) > 0
    for c in cols:
        assert np.allclose(want[c].astype(float), have[c].astype(float), equal_nan=True), c


def test_blank_refuses_other_conditions(spark):
    with pytest.raises(ValueError):
        crossings.blank(spark.range(1), "near", 1.0, 2.0)


def test_text_readers(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("9 9 9\nLINE:10\n1 2 3.5 4\r\n  2   3 4.5 5\nbad 1 2\n7\nTIE:20\n5 6 7 8\n")
    rows = files.xyz(spark, str(tmp_path / "a.xyz")).orderBy("seq").collect()
    assert [(r.line_id, r.x, r.y, list(r.data)) for r in rows] == [(10, 1, 2, [3.5, 4]), (10, 2, 3, [4.5, 5]), (20, 5, 6, [7, 8])]
    assert files.xyz(spark, str(tmp_path / "a.xyz"), ties=False).count() == 2
    (tmp_path / "c.shc").write_text("# note\n 1 1 2 2 1 1900.0 1905.0\n 1900.0 1905.0\n 1 0 -3.0 -2.5\n 1 1 7 8\n")
    got = {(r.n, r.m, r.year): r.coef for r in files.coefficients(spark, str(tmp_path / "c.shc")).collect()}
    assert got == {(1, 0, 1900.0): -3.0, (1, 0, 1905.0): -2.5, (1, 1, 1900.0): 7.0, (1, 1, 1905.0): 8.0}
    (tmp_path / "m.mag").write_text("# model\n333\n0 3 2 1\n-60 5 50000\n100 200 0\n130 240 0\n10 100\n\n1 2 3\n4 5 NaN\n")
    cells = {(r.row, r.col): (r.x, r.y, r.v) for r in files.modelled_grid(spark, str(tmp_path / "m.mag")).collect()}
    assert cells[0, 0] == (105, 230, 1) and cells[1, 1] == (115, 210, 5) and cells[1, 2][2] is None and len(cells) == 6


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("order", [1, -1])
def test_grd(spark, tmp_path, packed, order):
    a = np.arange(6, dtype="<f4").reshape(2, 3)
    a[1, 2] = -1e32
    body = a.tobytes()
    head = struct.pack("<5i7d", 4 + 1024 * packed, 2, 3, 2, order, 10.0, 20.0, 1000.0, 2000.0, 0.0, 5.0, 2.0).ljust(512, b"\0")
    if packed:
        blocks = [zlib.compress(body[:12]), zlib.compress(body[12:])]
        at = 512 + 16 + 2 * 12
        table = struct.pack("<4i", 0, 0, 2, 1) + struct.pack("<2q", at, at + 16 + len(blocks[0])) + struct.pack("<2i", *(16 + len(b) for b in blocks))
        body = table + b"".join(b"\0" * 16 + b for b in blocks)
    (tmp_path / "g.grd").write_bytes(head + body)
    got = {(r.row, r.col): r for r in files.grd(spark, str(tmp_path / "g.grd")).collect()}
    assert len(got) == 6
    one = got[0, 2] if order == 1 else got[2, 0]
    assert one.v == 6.0 and (one.x, one.y) == ((1020.0, 2000.0) if order == 1 else (1000.0, 2020.0))
    assert (got[1, 2] if order == 1 else got[2, 1]).v is None


def test_xyz_over_splits(spark, tmp_path):
    text, want, line, seq = "", [], None, 0
    for k in range(400):
        if k % 90 == 20:
            line = k if k % 180 == 20 else -1
            text, seq = text + ("LINE:%d\r\n" % k if line > 0 else "TIE:%d\n" % k), seq + 1
        text += f"{k}  {k + 0.5} {k * 2}" + ("\n", "\r\n", "\r")[k % 3]
        if line and line > 0:
            want.append((line, seq, float(k), k + 0.5, [2.0 * k]))
        seq += 1
    (tmp_path / "long.xyz").write_bytes(text.encode())
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {c: spark.conf.get(c) for c in keys}
    try:
        for c, v in zip(keys, ("300", "1")):
            spark.conf.set(c, v)
        p, splits = files._splits(spark, str(tmp_path / "long.xyz"))
        assert splits.count() > 10
        got = files.xyz(spark, str(tmp_path / "long.xyz"), ties=False).orderBy("seq").collect()
        assert [(r.line_id, r.seq, r.x, r.y, r.data) for r in got] == want
        lines = files._lines(spark, str(tmp_path / "long.xyz")).orderBy("at").collect()
        assert [r.at for r in lines] == list(range(seq)) and lines[0].line == "0 0.5 0"
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
