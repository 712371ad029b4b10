import math
import struct
import zlib

import numpy as np
import pytest

from gridloom.sources import blocks, files, raster


def cells_of(spark, a):
    rows = [(b + 1, r, c, None if np.isnan(a[b, r, c]) else float(a[b, r, c])) for b in range(a.shape[0]) for r in range(a.shape[1]) for c in range(a.shape[2])]
    return spark.createDataFrame(rows, "band int, row int, col int, v double")


def array_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.band - 1, r.row, r.col] = np.nan if r.v is None else r.v
    return out


@pytest.mark.parametrize("how", [{}, {"deflate": True, "nodata": -9999.0}, {"small": 0}, {"small": 0, "deflate": True}])
def test_written_by_tasks_as_in_memory(spark, tmp_path, monkeypatch, how):
    monkeypatch.setattr(raster, "strip_rows", lambda ncols: 4)
    a = np.random.default_rng(1).normal(size=(2, 11, 9)).astype("f4").astype(float)
    a[0, 3, 4] = a[1, 10, 8] = np.nan
    about = {"transform": (10.0, 2.0, 0.0, 50.0, 0.0, -2.0), "epsg": 4326, "tags": {"k<": 'v & "w"'}, "names": ["p", "q>"]}
    path = str(tmp_path / "out" / "g.tif")
    raster.write(cells_of(spark, a), path, 11, 9, 2, **about, **how)
    raw = (tmp_path / "out" / "g.tif").read_bytes()
    assert raw == raster.encode(a, **about, **how) and struct.unpack_from("<H", raw, 2)[0] == (43 if "small" in how else 42)
    back, found = raster.decode(raw)
    assert np.array_equal(back, a, equal_nan=True) and (found["epsg"], found["tags"], found["names"]) == (4326, about["tags"], {1: "p", 2: "q>"})
    assert np.array_equal(array_of(raster.read(spark, path), a.shape), a, equal_nan=True)
    table = raster.block_table(spark, path)
    assert table.count() == 6 and raster.read(spark, path, rows=(4, 6), bands=[2]).count() == 18
    d = raster.describe(spark, path).first()
    assert (d.bands, d.nrows, d.ncols, d.epsg, d.names) == (2, 11, 9, 4326, {1: "p", 2: "q>"})


def test_missing_cells_and_turned_rows(spark, tmp_path):
    path = str(tmp_path / "g.tif")
    raster.write(cells_of(spark, np.full((1, 1, 1), 5.0)), path, 3, 2, flip=True, transform=(0.0, 1.0, 0.0, 0.0, 0.0, 2.0))
    a, _ = raster.decode((tmp_path / "g.tif").read_bytes())
    assert a[0, 2, 0] == 5 and np.isnan(a).sum() == 5
    north = {(r.row, r.col): (r.y, r.v) for r in raster.read(spark, path).collect()}  # stored from the south up
    assert north[0, 0] == (5.0, 5.0) and {(r.row) for r in raster.read(spark, path, rows=(0, 1)).collect()} == {0}


def test_tiles_with_predictor_and_pixels_together(spark, tmp_path):
    a = np.random.default_rng(2).integers(0, 60_000, (2, 20, 37)).astype("<u2")
    tiles = []
    for r in range(0, 20, 16):
        for c in range(0, 37, 16):
            t = np.zeros((16, 16, 2), "<u2")
            part = a[:, r : r + 16, c : c + 16].transpose(1, 2, 0)
            t[: part.shape[0], : part.shape[1]] = part
            tiles.append(zlib.compress(np.diff(t, axis=1, prepend=np.zeros((16, 1, 2), "<u2")).astype("<u2").tobytes()))
    fields = {raster.WIDTH: [37], raster.HEIGHT: [20], raster.BITS: [16, 16], raster.COMPRESSION: [8], raster.SAMPLES: [2], raster.PLANAR: [1], raster.PREDICTOR: [2], raster.TILE_WIDTH: [16], raster.TILE_HEIGHT: [16], raster.SAMPLE_FORMAT: [1, 1], raster.TILE_OFFSETS: [], raster.TILE_BYTES: list(map(len, tiles))}
    at = 8 + 2 + 12 * len(fields) + 4
    start = at + 4 * 2 * len(tiles)
    fields[raster.TILE_OFFSETS] = [start + sum(map(len, tiles[:k])) for k in range(len(tiles))]
    head, tail = b"II" + struct.pack("<HIH", 42, 8, len(fields)), b""
    for tag, v in sorted(fields.items()):
        wide = len(v) * 4 > 4 and len(v) > 2
        body = struct.pack(f"<{len(v)}{'I' if wide else 'H'}", *v)
        head += struct.pack("<HHI", tag, 4 if wide else 3, len(v)) + (struct.pack("<I", at + len(tail)) if wide else body.ljust(4, b"\0"))
        tail += body if wide else b""
    (tmp_path / "t.tif").write_bytes(head + bytes(4) + tail + b"".join(tiles))
    assert np.array_equal(array_of(raster.read(spark, str(tmp_path / "t.tif")), a.shape), a)
    assert np.array_equal(raster.decode((tmp_path / "t.tif").read_bytes())[0], a)


def test_mosaic_reads_what_it_needs(spark, tmp_path):
    for k, (x, y) in enumerate(((0.0, 4.0), (3.0, 4.0), (0.0, 8.0))):
        a = np.full((1, 4, 4), float(k + 1))
        a[0, 0, 0] = np.nan
        # The last one is stored from the south up: its rows begin at y = 4.
        how = (x, 1.0, 0.0, y, 0.0, -1.0) if k < 2 else (x, 1.0, 0.0, 4.0, 0.0, 1.0)
        (tmp_path / f"{k}.tif").write_bytes(raster.encode(a, how))
    table = raster.block_table(spark, str(tmp_path / "*.tif"))
    v = {(r.row, r.col): (r.x, r.y, r.v) for r in raster.mosaic(table).collect()}
    assert len(v) == 44 and v[4, 3] == (3.5, 3.5, 1.0) and v[5, 3] == (3.5, 2.5, 2.0) and v[0, 0] == (0.5, 7.5, 3.0) and v[3, 0][2] is None and v[4, 0][2] is None
    some = {(r.row, r.col, r.v) for r in raster.mosaic(table, (5.2, 0.0, 9.0, 1.9)).collect()}
    assert some == {(r, c, 2.0) for r in (6, 7) for c in (5, 6)}
    with pytest.raises(ValueError):
        raster.mosaic(table.limit(0))
    (tmp_path / "2.tif").write_bytes(raster.encode(np.ones((1, 2, 2)), (0.0, 2.0, 0.0, 8.0, 0.0, -2.0)))
    with pytest.raises(ValueError):
        raster.mosaic(raster.block_table(spark, str(tmp_path / "*.tif")))


@pytest.mark.parametrize("order", [1, -1])
def test_rotated_grd_becomes_a_tiff(spark, tmp_path, order):
    a = np.arange(12, dtype="<f8").reshape(3, 4)
    a[1, 1] = -1e32
    head = struct.pack("<5i7d", 8, 2, 4, 3, order, 10.0, 20.0, 1000.0, 2000.0, 30.0, 0.0, 1.0).ljust(512, b"\0")
    (tmp_path / "g.grd").write_bytes(head + a.tobytes())
    want = {(round(r.x, 6), round(r.y, 6)): r.v for r in files.grd(spark, str(tmp_path / "g.grd")).collect()}
    files.grd_to_tiff(spark, str(tmp_path / "g.grd"), str(tmp_path / "g.tif"), 32750)
    got = {(round(r.x, 6), round(r.y, 6)): r.v for r in raster.read(spark, str(tmp_path / "g.tif")).collect()}
    assert got == want and len(got) == 12 and None in got.values()
    (tmp_path / "h.grd").write_bytes(head.replace(struct.pack("<d", 30.0), struct.pack("<d", 31.0)) + a.tobytes())
    with pytest.raises(ValueError):
        files.grd_to_tiff(spark, str(tmp_path / "*.grd"), str(tmp_path / "h.tif"))


def test_plain_grd_in_several_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_PLAIN_BYTES", 40)
    a = np.arange(35, dtype="<i4").reshape(7, 5)
    raw = struct.pack("<5i7d", 4, 1, 5, 7, 1, 1.0, 1.0, 0.0, 0.0, 0.0, 100.0, 2.0).ljust(512, b"\0") + a.tobytes()
    _, cut = files._grd_blocks(lambda at, n: raw[at : at + n])
    assert [c[:2] for c in cut] == [(0, 2), (2, 2), (4, 2), (6, 1)]
    (tmp_path / "p.grd").write_bytes(raw)
    assert {(r.row, r.col): r.v for r in files.grd(spark, str(tmp_path / "p.grd")).collect()} == {(r, c): a[r, c] / 2 + 100 for r in range(7) for c in range(5)}


def test_places_of_paths():
    assert blocks.local("file:///a/b%20c.tif") == "/a/b c.tif" and blocks.local("/a/b") == "/a/b" and blocks.local("hdfs://x/a") is None
    assert math.isclose(raster.strip_rows(1 << 20), 1)
