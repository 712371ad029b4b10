"""TIFF grids in and out, and the affine placement that goes with them.

A file is read and written strip by strip or tile by tile, by as many tasks as it has megabytes.
Only what such grids use is covered: strips or tiles, uncompressed or deflated, one sample format for all bands, GeoTIFF
placement by scale and tie point or by matrix, the text tags for nodata and metadata.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate
from xml.sax.saxutils import escape, quoteattr, unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.sources import blocks

# TIFF tags and field types used here.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINTS, MATRIX, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34264, 34735, 42112, 42113
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_FORMATS = {1: "u", 2: "i", 3: "f"}
#: Code of the projected system in the geographic key directory.
_EPSG_KEYS = (3072, 2048)


def _fields(read: Callable[[int, int], bytes]) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of the first directory, of plain or big TIFF, from ranges of the file."""
    start = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    magic = struct.unpack_from(order + "H", start, 2)[0]
    big = magic == 43
    if magic not in (42, 43):
        raise ValueError(f"unknown TIFF version {magic}")
    at = struct.unpack_from(order + ("Q" if big else "I"), start, 8 if big else 4)[0]
    wide, size, room = 8 if big else 2, 20 if big else 12, 8 if big else 4
    count = struct.unpack(order + ("Q" if big else "H"), read(at, wide))[0]
    table, out = read(at + wide, count * size), {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + ("HHQ" if big else "HHI"), table, k * size)
        if kind not in _TYPES:
            continue
        width, inner = struct.calcsize("=" + _TYPES[kind]) * n, table[k * size + size - room : (k + 1) * size]
        body = read(struct.unpack(order + ("Q" if big else "I"), inner)[0], width) if width > room else inner[:width]
        out[tag] = struct.unpack(f"{order}{n}{_TYPES[kind]}", body)
    return order, out


def _text(value: tuple | None) -> str:
    return value[0].decode("utf-8", "replace").rstrip("\0 ") if value else ""


def _about(tag: dict[int, tuple]) -> dict:
    """``transform``, ``epsg``, ``tags`` and ``names`` of a file's tags."""
    if MATRIX in tag:
        m = tag[MATRIX]
        transform = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif PIXEL_SCALE in tag and TIE_POINTS in tag:
        (sx, sy, _), (i, j, _, x, y, _) = tag[PIXEL_SCALE], tag[TIE_POINTS][:6]
        transform = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    else:
        transform = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    keys = tag.get(GEO_KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    found = [(unescape(k), a, unescape(v)) for k, a, v in re.findall(r'<Item name="([^"]+)"([^>]*)>([^<]*)</Item>', _text(tag.get(METADATA)))]
    names = {int(s.group(1)) + 1: v for k, a, v in found if k == "DESCRIPTION" and (s := re.search(r'sample="(\d+)"', a))}
    return {"transform": transform, "epsg": next((codes[k] for k in _EPSG_KEYS if k in codes), None), "tags": {k: v for k, a, v in found if "sample=" not in a}, "names": names}


def _layout(order: str, tag: dict[int, tuple]) -> dict:
    """What all blocks of a file share."""
    packed = tag.get(COMPRESSION, (1,))[0]
    if packed not in (1, 8, 32946):
        raise ValueError(f"compression {packed} is not covered")
    width, height, tiled = tag[WIDTH][0], tag[HEIGHT][0], TILE_OFFSETS in tag
    tw, th = (tag[TILE_WIDTH][0], tag[TILE_HEIGHT][0]) if tiled else (width, min(height, tag.get(ROWS_PER_STRIP, (height,))[0]))
    bands, nodata = tag.get(SAMPLES, (1,))[0], _text(tag.get(NODATA))
    kind = order + _FORMATS[tag.get(SAMPLE_FORMAT, (1,))[0]] + str(tag[BITS][0] // 8)
    dummy = None if not nodata or nodata.lower() == "nan" else float(np.float32(nodata)) if kind[1:] == "f4" else float(nodata)
    planar = tag.get(PLANAR, (1,))[0] == 2
    return {"height": height, "width": width, "bands": bands, "tw": tw, "th": th, "tiled": tiled, "planar": planar, "depth": 1 if planar else bands, "packed": packed != 1, "kind": kind, "predictor": tag.get(PREDICTOR, (1,))[0], "dummy": dummy}


def _places(lay: dict, tag: dict[int, tuple]) -> Iterator[tuple[int, int, int, int, int]]:
    """(first band from 0, first row, first column, offset, size) of each block."""
    starts, sizes = (tag[TILE_OFFSETS], tag[TILE_BYTES]) if lay["tiled"] else (tag[STRIP_OFFSETS], tag[STRIP_BYTES])
    across, down = -(-lay["width"] // lay["tw"]), -(-lay["height"] // lay["th"])
    for k, (at, n) in enumerate(zip(starts, sizes)):
        yield k // (across * down), k // across % down * lay["th"], k % across * lay["tw"], at, n


def _piece(raw: bytes, lay: dict, row: int, col: int) -> np.ndarray:
    """``(bands of the block, rows, columns)`` as doubles with NaN for no data."""
    rows = lay["th"] if lay["tiled"] else min(lay["th"], lay["height"] - row)
    kind = np.dtype(lay["kind"])
    piece = np.frombuffer(zlib.decompress(raw) if lay["packed"] else raw, kind, rows * lay["tw"] * lay["depth"]).reshape(rows, lay["tw"], lay["depth"])
    if lay["predictor"] == 2:
        piece = np.cumsum(piece, axis=1, dtype=kind)
    piece = piece[: lay["height"] - row, : lay["width"] - col].transpose(2, 0, 1).astype(float)
    if lay["dummy"] is not None:
        piece[piece == lay["dummy"]] = np.nan
    return piece


def decode(raw: bytes) -> tuple[np.ndarray, dict]:
    """``(bands, rows, columns)`` as doubles with NaN for no data, and ``transform``, ``epsg``, ``tags``, of a file held in memory."""
    order, tag = _fields(lambda at, n: raw[at : at + n])
    lay = _layout(order, tag)
    out = np.empty((lay["bands"], lay["height"], lay["width"]))
    for plane, r, c, at, n in _places(lay, tag):
        piece = _piece(raw[at : at + n], lay, r, c)
        out[plane : plane + len(piece), r : r + piece.shape[1], c : c + piece.shape[2]] = piece
    return out, _about(tag)


#: Files of at most this many bytes keep 32-bit offsets.
SMALL_FILE = (1 << 32) - (1 << 20)


def strip_rows(ncols: int) -> int:
    """Rows of a strip of about 64 kB."""
    return max(1, 65536 // max(1, ncols * 4))


def header(shape: tuple[int, int, int], lengths: list[int], transform: tuple[float, ...], epsg: int | None = None, nodata: float | None = None, tags: dict | None = None, names: list[str] | None = None, deflate: bool = False, per: int | None = None, small: int = SMALL_FILE) -> tuple[bytes, int]:
    """Head of a float32 file of ``(bands, rows, columns)`` whose strips of those lengths follow it, and its length; the big form if they need it."""
    depth, height, width = shape
    per = min(height, per or strip_rows(width))
    items = "".join(f"<Item name={quoteattr(str(k))}>{escape(str(v))}</Item>" for k, v in (tags or {}).items())
    items += "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{escape(str(v))}</Item>' for k, v in enumerate(names or []))
    big = sum(lengths) + 16 * len(lengths) + len(items) > small
    word, code = ("Q", 16) if big else ("I", 4)
    x0, dx, rx, y0, cy, dy = map(float, transform)
    fields: dict[int, tuple[int, list]] = {
        WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [32] * depth), COMPRESSION: (3, [8 if deflate else 1]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [depth]),
        ROWS_PER_STRIP: (4, [per]), STRIP_BYTES: (code, lengths), PLANAR: (3, [2]), SAMPLE_FORMAT: (3, [3] * depth),
        MATRIX: (12, [dx, rx, 0.0, x0, cy, dy, 0.0, y0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]), NODATA: (2, [("nan" if nodata is None else repr(float(nodata))).encode() + b"\0"]),
    }
    if not rx and not cy and dy < 0:
        del fields[MATRIX]
        fields |= {PIXEL_SCALE: (12, [dx, -dy, 0.0]), TIE_POINTS: (12, [0.0, 0.0, 0.0, x0, y0, 0.0])}
    if epsg is not None:
        geographic = 4000 <= epsg < 5000
        fields[GEO_KEYS] = (3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg])
    if items:
        fields[METADATA] = (2, [f"<GDALMetadata>{items}</GDALMetadata>".encode() + b"\0"])
    fields[STRIP_OFFSETS] = (code, [0] * len(lengths))
    room, entry, before = (8, 20, 16) if big else (4, 12, 8)
    body = lambda kind, v: v[0] if kind == 2 else struct.pack(f"<{len(v)}{_TYPES[kind]}", *v)
    table = before + (8 if big else 2)
    at = table + entry * len(fields) + room
    first = at + sum(-(-n // 8) * 8 for n in (len(body(*f)) for f in fields.values()) if n > room)
    fields[STRIP_OFFSETS] = (code, [first + n for n in accumulate(lengths[:-1], initial=0)] if lengths else [])
    head = b"II" + (struct.pack("<HHHQQ", 43, 8, 0, 16, len(fields)) if big else struct.pack("<HIH", 42, 8, len(fields)))
    tail = b""
    for tag, (kind, v) in sorted(fields.items()):
        value = body(kind, v)
        head += struct.pack("<HH" + word, tag, kind, len(v[0]) if kind == 2 else len(v))
        if len(value) > room:
            head += struct.pack("<" + word, at + len(tail))
            tail += value.ljust(-(-len(value) // 8) * 8, b"\0")
        else:
            head += value.ljust(room, b"\0")
    return head + bytes(room) + tail, first


def _strip(a: np.ndarray, nodata: float | None, deflate: bool) -> bytes:
    a = np.asarray(a, dtype="<f4")
    raw = (a if nodata is None else np.where(np.isnan(a), np.float32(nodata), a)).astype("<f4").tobytes()
    return zlib.compress(raw) if deflate else raw


def encode(bands: np.ndarray, transform: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0), epsg: int | None = None, nodata: float | None = None, tags: dict | None = None, names: list[str] | None = None, deflate: bool = False, small: int = SMALL_FILE) -> bytes:
    """A float32 TIFF file of ``(bands, rows, columns)`` in memory; NaN is written as ``nodata`` if that is given."""
    a = np.asarray(bands)
    a = a[None] if a.ndim == 2 else a
    per = strip_rows(a.shape[2])
    strips = [_strip(band[r : r + per], nodata, deflate) for band in a for r in range(0, a.shape[1], per)]
    return header(a.shape, list(map(len, strips)), transform, epsg, nodata, tags, names, deflate, small=small)[0] + b"".join(strips)


_BLOCK = "file string, transform array<double>, lay string, band int, depth int, row int, rows int, col int, cols int, at long, size long"


def block_table(spark: SparkSession, path: str) -> DataFrame:
    """``(file, transform, lay, band, depth, row, rows, col, cols, at, size)``: where in which file each strip or tile lies.

    A block holds ``depth`` bands from ``band`` (from 1) on, and rows and columns from ``row`` and ``col``
    on as the file has them.  Only the heads of the files are read; choosing among the blocks chooses
    what ``cells`` reads.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file in b["file"]:
                with blocks.opened(file) as f:
                    order, tag = _fields(blocks.ranged(f))
                lay, transform = _layout(order, tag), list(_about(tag)["transform"])
                text = json.dumps(lay)
                rows = [(file, transform, text, plane + 1, lay["depth"], r, min(lay["th"], lay["height"] - r), c, min(lay["tw"], lay["width"] - c), at, n) for plane, r, c, at, n in _places(lay, tag)]
                for k in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[k : k + 10_000], columns=[c.split()[0] for c in _BLOCK.split(", ")])

    return blocks.listed(spark, path).mapInPandas(run, _BLOCK)


def cells(table: DataFrame, turn: bool = True) -> DataFrame:
    """``(file, band, row, col, x, y, v)`` of the blocks in ``table``, read by tasks of a few MB each, whatever file they are of.

    Grids stored from the south up are turned, so that row 0 is the north, unless ``turn`` is off.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, group in b.sort_values(["file", "at"]).groupby("file", sort=False):
                with blocks.opened(file) as f:
                    read, lay = blocks.ranged(f), json.loads(group["lay"].iloc[0])
                    x0, dx, rx, y0, cy, dy = group["transform"].iloc[0]
                    south_up = turn and dy > 0 and (x0, dx, rx, y0, cy, dy) != (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
                    for x in group.itertuples():
                        piece = _piece(read(x.at, x.size), lay, x.row, x.col)
                        row, col = (i.ravel() for i in np.indices(piece.shape[1:]))
                        row, col = row + x.row, col + x.col
                        east, north = x0 + (col + 0.5) * dx + (row + 0.5) * rx, y0 + (col + 0.5) * cy + (row + 0.5) * dy
                        if south_up:
                            row = lay["height"] - 1 - row
                        for k, plane in enumerate(piece):
                            yield pd.DataFrame({"file": file, "band": np.int32(x.band + k), "row": row.astype(np.int32), "col": col.astype(np.int32), "x": east, "y": north, "v": plane.ravel()})

    found = blocks.dealt(table).mapInPandas(run, "file string, band int, row int, col int, x double, y double, v double")
    return found.withColumn("v", F.nanvl("v", F.lit(None).cast("double")))


def read(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, bands: list[int] | None = None) -> DataFrame:
    """``(file, band, row, col, x, y, v)`` of TIFF grids; a grid stored from the south up is turned so that row 0 is the north.

    ``x`` and ``y`` are cell centres; bands count from 1.  ``rows`` (from the first to before the last)
    and ``bands`` are chosen among the blocks, before any other is read.
    """
    table = block_table(spark, path)
    if rows is not None:
        height = F.get_json_object("lay", "$.height").cast("int")
        south_up = (F.col("transform")[5] > 0) & (F.col("transform") != F.array(*map(F.lit, (0.0, 1.0, 0.0, 0.0, 0.0, 1.0))))
        top = F.when(south_up, height - F.col("row") - F.col("rows")).otherwise(F.col("row"))
        table = table.where((top < rows[1]) & (top + F.col("rows") > rows[0]))
    if bands is not None:
        table = table.where(F.exists(F.array(*map(F.lit, bands)), lambda b: (b >= F.col("band")) & (b < F.col("band") + F.col("depth"))))
    found = cells(table)
    found = found if rows is None else found.where(F.col("row").between(rows[0], rows[1] - 1))
    return found if bands is None else found.where(F.col("band").isin(bands))


def mosaic(table: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``(band, row, col, x, y, v)`` of one grid over the blocks of several files with cells of one size, without rotation.

    Row 0 and column 0 are the north-west corner of all files.  Where files overlap, the valid value of
    the last one by name counts.  ``box`` (west, south, east, north) keeps the cells whose centres it
    holds, and only blocks that reach into it are read.
    """
    t = F.col("transform")
    sizes = table.agg(F.collect_set(F.struct(t[1].alias("dx"), F.abs(t[5]).alias("dy"), t[2].alias("rx"), t[4].alias("cy"))).alias("s")).first()
    if not sizes.s:
        raise ValueError("no blocks to put together")
    if len(sizes.s) > 1 or sizes.s[0].rx or sizes.s[0].cy:
        raise ValueError("the files differ in the size of their cells, or are rotated")
    dx, dy = sizes.s[0].dx, sizes.s[0].dy
    height = F.get_json_object("lay", "$.height").cast("int")
    corner = table.agg(F.min(t[0]).alias("west"), F.max(F.greatest(t[3], t[3] + t[5] * height)).alias("north")).first()
    if box is not None:
        west, south, east, north = box
        x, y = t[0] + F.col("col") * dx, t[3] + F.col("row") * t[5]
        x1, y1 = x + F.col("cols") * dx, y + F.col("rows") * t[5]
        table = table.where((x <= east) & (x1 >= west) & (F.least(y, y1) <= north) & (F.greatest(y, y1) >= south))
    found = cells(table, turn=False)
    if box is not None:
        found = found.where(F.col("x").between(west, east) & F.col("y").between(south, north))
    at = found.select("file", "band", F.floor((corner.north - F.col("y")) / dy).cast("int").alias("row"), F.floor((F.col("x") - corner.west) / dx).cast("int").alias("col"), "v")
    best = at.groupBy("band", "row", "col").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("file"))).alias("v"))
    return best.select("band", "row", "col", (F.lit(corner.west) + (F.col("col") + 0.5) * dx).alias("x"), (F.lit(corner.north) - (F.col("row") + 0.5) * dy).alias("y"), "v")


def describe(spark: SparkSession, path: str) -> DataFrame:
    """``(file, bands, nrows, ncols, transform, epsg, tags, names)``, sorted by file; ``transform`` is ``x0, dx, row-x, y0, col-y, dy``.

    Only heads are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file in b["file"]:
                with blocks.opened(file) as f:
                    order, tag = _fields(blocks.ranged(f))
                lay, about = _layout(order, tag), _about(tag)
                out.append((file, lay["bands"], lay["height"], lay["width"], list(about["transform"]), about["epsg"], about["tags"], about["names"]))
            yield pd.DataFrame(out, columns=["file", "bands", "nrows", "ncols", "transform", "epsg", "tags", "names"])

    return blocks.listed(spark, path).mapInPandas(run, "file string, bands int, nrows int, ncols int, transform array<double>, epsg int, tags map<string,string>, names map<int,string>").orderBy("file")


def magnetic_parameters(described: DataFrame) -> DataFrame:
    """``(file, inclination, declination, intensity)`` from the tags; all NULL unless all three are numbers."""
    value = lambda k: F.col("tags")[k].try_cast("double")
    names = ("inclination", "declination", "intensity")
    whole = value(names[0]).isNotNull() & value(names[1]).isNotNull() & value(names[2]).isNotNull()
    return described.select("file", *[F.when(whole, value(n)).alias(n) for n in names])


def bands_wide(cells: DataFrame, bands: list[int]) -> DataFrame:
    """``(file, row, col, b1, b2, ..)`` of the listed bands."""
    return cells.groupBy("file", "row", "col").pivot("band", bands).agg(F.first("v")).select("file", "row", "col", *[F.col(str(b)).alias(f"b{b}") for b in bands])


def suffixed(name: str, suffix: str, extension: str = ".tif") -> str:
    """``name`` with ``suffix`` before its extension, which becomes ``extension``."""
    return re.sub(r"(\.[^./\\]*)?$", lambda _: suffix + extension, name, count=1)


def write(cells: DataFrame, path: str, nrows: int, ncols: int, bands: int = 1, transform: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0), epsg: int | None = None, nodata: float | None = None, tags: dict | None = None, names: list[str] | None = None, flip: bool = False, deflate: bool = False, small: int = SMALL_FILE) -> None:
    """Write ``cells(band, row, col, v)``, bands from 1, as one TIFF; missing cells are no data.

    ``flip`` turns a grid whose row 0 is the south.  Strips are made by many tasks, which put them in
    their places of the file; a task holds a strip of about 64 kB, and no cell passes the driver.
    """
    per = strip_rows(ncols)
    down = -(-nrows // per)
    row = nrows - 1 - F.col("row") if flip else F.col("row")
    placed = cells.select(F.col("band").cast("int").alias("band"), row.cast("long").alias("row"), "col", F.col("v").cast("double").alias("v"))
    placed = placed.select(((F.col("band") - 1) * down + F.floor(F.col("row") / per)).alias("k"), (F.col("row") % per).alias("row"), "col", "v")
    # Strips without any cell are made as well.
    every = cells.sparkSession.range(bands * down).select(F.col("id").alias("k"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("double").alias("v"))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a = np.full((min(per, nrows - key[0] % down * per), ncols), np.nan)
        group = group[group["row"].notna()]
        a[group["row"].astype(np.int64), group["col"].astype(np.int64)] = group["v"].astype(float)
        return pd.DataFrame({"k": [key[0]], "body": [_strip(a, nodata, deflate)]})

    strips = placed.unionByName(every).groupBy("k").applyInPandas(run, "k long, body binary")
    blocks.write_pieces(strips, path, lambda lengths: header((bands, nrows, ncols), lengths, transform, epsg, nodata, tags, names, deflate, per, small), bands * down)


def boxed_transform(nrows: int, ncols: int, north: float, south: float, west: float, east: float) -> tuple[float, ...]:
    """Affine transform of a north-up grid that fills a box."""
    return west, (east - west) / ncols, 0.0, north, 0.0, (south - north) / nrows
