"""Spectral filters on ``(row, col, v)`` grids.

The transform runs in two passes of one-dimensional FFTs.  Rows become arrays, are padded,
tapered and transformed, and leave as blocks of a few columns; a block then holds all rows of
its columns, is transformed downwards, multiplied by every response and transformed back, so
that the spectrum is never exchanged cell by cell; a last pass takes the rows back.  A task
holds a row or ``BLOCK_CELLS`` cells of a block, whatever the size of the grid.

A response is a function of ``kx``, ``ky`` and ``k`` (radians per unit, numpy arrays of one
block) that returns a real or complex factor.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.operators.focal import fill_nearest
from gridloom.operators.quantiles import quantiles
from gridloom.plans.scratch import checkpointed

Response = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Cells of the padded grid that one task holds while it transforms columns.
BLOCK_CELLS = 1 << 21


def smooth_size(n: int, pad: int) -> int:
    """Smallest size of at least ``n + 2 * pad`` whose only prime factors are 2, 3 and 5."""
    size = n + 2 * pad
    while True:
        rest = size
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return size
        size += 1


def smooth_pads(n: int, pad: int) -> tuple[int, int]:
    """Cells before and after ``n`` cells that make up the smooth size."""
    more = smooth_size(n, pad) - n
    return more // 2, more - more // 2


def tukey(n: int, alpha: float = 0.5) -> np.ndarray:
    """Taper over the share ``alpha`` of ``n`` places; none at 0, a Hann window from 1 on."""
    if alpha <= 0:
        return np.ones(n)
    if alpha >= 1:
        return np.hanning(n)
    x = np.linspace(0, 1, n)
    low, high = x < alpha / 2, x >= 1 - alpha / 2
    w = np.ones(n)
    w[low] = 0.5 + 0.5 * np.cos(2 * math.pi * (x[low] / alpha - 0.5))
    w[high] = 0.5 + 0.5 * np.cos(2 * math.pi * ((x[high] - 1) / alpha + 0.5))
    return w


_WINDOWS = {"tukey": tukey, "hann": np.hanning, "none": np.ones}
_EDGES = {
    "ramp": lambda before, after: (np.arange(before) / max(before, 1), np.arange(after - 1, -1, -1) / max(after, 1)),
    "edge": lambda before, after: (np.ones(before), np.ones(after)),
    "zero": lambda before, after: (np.zeros(before), np.zeros(after)),
}


class Padding:
    """How a line of ``n`` values becomes one of the padded length: multiples of its edges, then a taper.

    ``window`` is a name or a function from a length to that many weights.
    """

    def __init__(self, pads: tuple[tuple[int, int], tuple[int, int]], edge: str, window: str | Callable[[int], np.ndarray]):
        self.pads, self.edge, self.window = pads, edge, window

    def _extended(self, a: np.ndarray, pads: tuple[int, int]) -> np.ndarray:
        before, after = _EDGES[self.edge](*pads)
        shape = (-1, *[1] * (a.ndim - 1))
        out = np.concatenate([before.reshape(shape) * a[:1], a, after.reshape(shape) * a[-1:]])
        taper = self.window if callable(self.window) else _WINDOWS[self.window]
        return out * taper(len(out)).reshape(shape)

    def along(self, v: np.ndarray) -> np.ndarray:
        """``[part, place]``: a row in parts that add up to its padded form, each padded downwards in its own way."""
        return self._extended(v, self.pads[1])[None]

    def down(self, parts: np.ndarray) -> np.ndarray:
        """Sum of the parts ``[row, part, column]`` of all rows, padded downwards."""
        return self._extended(parts[:, 0], self.pads[0])


class MirrorPadding(Padding):
    """Square of the next power of two, edges mirrored under half a sine wave that falls to 0 at the border.

    Beyond the corners the first and last row are carried on under the same weights.  At the far
    end, columns are mirrored one place nearer than rows are, so that the last column and the rows
    beyond it are weighed too; an odd gap leaves one line of zeros behind the last value.
    """

    def __init__(self, nrows: int, ncols: int):
        size = 1 << (max(nrows, ncols) - 1).bit_length()
        first = [(size - n) // 2 for n in (nrows, ncols)]
        super().__init__(tuple((f, size - n - f) for f, n in zip(first, (nrows, ncols))), "mirror", "none")
        self.body = (first[1], first[1] + ncols - 1)  # columns that mirror their rows
        self.across = self._mirrored(ncols, size, first[1], 2)
        self.rows = self._mirrored(nrows, size, first[0], 1), self._carried(nrows, size, first[0])

    @staticmethod
    def _lines(n: int, size: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        source, weight = np.full(size, -1), np.zeros(size)
        source[first : first + n], weight[first : first + n] = np.arange(n), 1.0
        return source, weight, 0.5 * (1 + np.sin(np.arange(first) * math.pi / max(first, 1) - math.pi / 2))

    @classmethod
    def _mirrored(cls, n: int, size: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        source, weight, w = cls._lines(n, size, first)
        k = np.arange(first)
        for to, of in ((k, 2 * first - 1 - k), (size - last - k, size - 2 * first + k)):
            source[to], weight[to] = source[of], weight[of] * w
        return source, weight

    @classmethod
    def _carried(cls, n: int, size: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        source, weight, w = cls._lines(n, size, first)
        k = np.arange(first)
        for to, of in ((k, first), (size - 2 - k, size - first - 1)):
            source[to], weight[to] = source[of], weight[of] * w
        return source, weight

    def along(self, v: np.ndarray) -> np.ndarray:
        source, weight = self.across
        line = v[source] * weight  # a source of -1 has no weight
        body = np.zeros((2, len(line)))
        inner = slice(*self.body)
        body[0, inner], body[1] = line[inner], line
        body[1, inner] = 0
        return body

    def down(self, parts: np.ndarray) -> np.ndarray:
        return sum(parts[source, k] * weight[:, None] for k, (source, weight) in enumerate(self.rows))


def plain_waves(m: int, spacing: float) -> np.ndarray:
    return 2 * math.pi * np.fft.fftfreq(m, spacing)


def whole_waves(m: int, spacing: float) -> np.ndarray:
    """Numbers counted from 1 instead of 0 on both sides, in steps of a whole turn over ``m - 1`` places."""
    k = np.arange(m)
    return np.where(k < m // 2, k + 1, k - m) * 2 * math.pi / (m - 1)


class Spectrum:
    """Forward transform of one grid, and what is needed to come back.

    ``level`` (median, mean or none) is taken off first; NULL cells take their nearest value, or
    the level if ``fill`` is ``level``.  ``pads`` are ``((top, bottom), (left, right))``.  Nothing
    runs before a result is asked for.
    """

    def __init__(
        self, grid: DataFrame, nrows: int, ncols: int, dx: float = 1.0, dy: float = 1.0, buffer: int = 0, pads: tuple | None = None,
        edge: str = "ramp", window: str | Callable[[int], np.ndarray] = "tukey", level: str = "median", fill: str = "nearest", padding: Padding | None = None, waves: Callable[[int, float], np.ndarray] = plain_waves,
    ):
        self._given, self.n, self.spacing = grid, (nrows, ncols), (dy, dx)
        self.padding = padding or Padding(pads or (smooth_pads(nrows, buffer), smooth_pads(ncols, buffer)), edge, window)
        self.pads, self.waves = self.padding.pads, waves
        self.m = tuple(n + sum(p) for n, p in zip(self.n, self.pads))
        self.level, self.fill = level, fill
        lanes = grid.sparkSession.sparkContext.defaultParallelism * 2
        self.width = max(1, min(BLOCK_CELLS // self.m[0], -(-self.m[1] // lanes)))

    @cached_property
    def grid(self) -> DataFrame:
        return checkpointed(self._given.select("row", "col", F.col("v").cast("double")))

    @cached_property
    def median(self) -> float:
        """The level taken off."""
        if self.level == "none":
            return 0.0
        of = self.grid.agg(F.avg("v")).first()[0] if self.level == "mean" else quantiles(self.grid, "v", [0.5])[0]
        return float(of or 0.0)

    @cached_property
    def filled(self) -> DataFrame:
        n = self.grid.agg(F.count("v")).first()[0] if self.fill == "nearest" else 0
        whole = self.grid if n in (0, self.n[0] * self.n[1]) else fill_nearest(self.grid, *self.n)
        return whole.select("row", "col", (F.coalesce("v", F.lit(self.median)) - self.median).alias("v"))

    def _rows(self) -> DataFrame:
        """``(block, row, z)``: each row's transform, cut into blocks of columns."""
        width, padding = self.width, self.padding

        def run(batches):
            for b in batches:
                out = []
                for row, v in zip(b["row"], b["v"]):
                    z = np.fft.fft(padding.along(np.asarray(v, float)))
                    out += [(k // width, row, z[:, k : k + width].tobytes()) for k in range(0, z.shape[1], width)]
                yield pd.DataFrame(out, columns=["block", "row", "z"])

        lines = self.filled.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("z"))
        return lines.select("row", F.col("z.v").alias("v")).mapInPandas(run, "block int, row int, z binary")

    def columns(self, work: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
        """Rows of ``work(block, spectrum of the block's columns, kx, ky, k)`` for every block."""
        (mr, mc), (dy, dx), width, padding, waves = self.m, self.spacing, self.width, self.padding, self.waves
        turned = -1 if waves is plain_waves else 1

        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            kx = waves(mc, dx)[key[0] * width : (key[0] + 1) * width][None, :]
            a = np.stack([np.frombuffer(z, complex).reshape(-1, kx.shape[1]) for z in group.sort_values("row")["z"]])
            spectrum = np.fft.fft(padding.down(a), axis=0)
            ky = turned * waves(mr, dy)[:, None]
            return work(key[0], spectrum, *np.broadcast_arrays(kx, ky, np.sqrt(kx * kx + ky * ky)))

        return self._rows().groupBy("block").applyInPandas(run, schema)

    def filtered(self, responses: dict[str, Response], crop: bool = True, restore: bool = True) -> DataFrame:
        """``(row, col, <one column per response>)`` without the level; NULL where the grid is, if ``restore``.

        Without ``crop`` the padded grid is returned, its first cell at ``(-top, -left)``.
        """
        (top, _), (left, _) = self.pads
        nr, nc = self.n if crop else self.m
        first, at = (top if crop else 0), (0 if crop else -top)
        names = list(responses)

        def down(block: int, spectrum: np.ndarray, kx: np.ndarray, ky: np.ndarray, k: np.ndarray) -> pd.DataFrame:
            out = {"row": np.arange(nr) + at, "block": block}
            for name, response in responses.items():
                a = np.fft.ifft(spectrum * response(kx, ky, k), axis=0)[first : first + nr]
                out[name] = [line.tobytes() for line in np.ascontiguousarray(a)]
            return pd.DataFrame(out)

        def back(key: tuple, group: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("block")
            out = {"row": key[0], "col": np.arange(nc) + (0 if crop else -left)}
            holes = own["col"][own["v"].isna()].to_numpy() if restore else np.array([], int)
            for name in names:
                z = np.fft.ifft(np.concatenate([np.frombuffer(x, complex) for x in group[name]])).real
                out[name] = z[left : left + nc].copy() if crop else z
                out[name][holes] = np.nan
            return pd.DataFrame(out)

        parts = self.columns(down, "row int, block int, " + ", ".join(f"{n} binary" for n in names))
        own = self.grid if restore else self.grid.limit(0)
        both = parts.groupBy("row").cogroup(own.groupBy("row"))
        found = both.applyInPandas(lambda key, a, b: back(key, a, b), "row int, col int, " + ", ".join(f"{n} double" for n in names))
        return found.select("row", "col", *[F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in names])

    def apply(self, response: Response, keep_level: bool = True) -> DataFrame:
        return self.filtered({"v": response}).withColumn("v", F.col("v") + (self.median if keep_level else 0.0))

    def several(self, responses: dict[str, Response]) -> DataFrame:
        """One column for each response, from one pass."""
        return self.filtered(responses)


def upward(h: float) -> Response:
    return lambda kx, ky, k: np.exp(-k * h)


def downward(h: float) -> Response:
    return lambda kx, ky, k: np.exp(k * h)


def vertical_integration(least: float = 1e-4, most: float | None = None) -> Response:
    return lambda kx, ky, k: 1.0 / np.clip(k, least, most)


def derivative(axis: str, order: float = 1.0) -> Response:
    """``(i kx)^p``, ``(i ky)^p`` or ``k^p``; the order need not be whole."""
    if axis == "z":
        return lambda kx, ky, k: k**order
    return lambda kx, ky, k: (1j * (kx if axis == "x" else ky)) ** order


def _edges(cutoff: float, width: float) -> tuple[float, float]:
    """Wavenumbers at which the taper around a cut-off wavelength begins and ends."""
    narrow = cutoff - width / 2
    return 2 * math.pi / (cutoff + width / 2), 2 * math.pi / narrow if narrow > 0 else 3 * math.pi / cutoff


def _rise(k: np.ndarray, a: float, b: float) -> np.ndarray:
    """0 up to ``a``, 1 from ``b`` on, half a cosine between."""
    return 0.5 - 0.5 * np.cos(math.pi * np.clip((k - a) / (b - a), 0.0, 1.0))


def low_pass(cutoff: float, width: float | None = None) -> Response:
    if not width or width <= 0:
        return lambda kx, ky, k: k <= 2 * math.pi / cutoff
    a, b = _edges(cutoff, width)
    return lambda kx, ky, k: 1 - _rise(k, a, b)


def high_pass(cutoff: float, width: float | None = None) -> Response:
    width = 0.2 * cutoff if width is None else width
    if width <= 0:
        return lambda kx, ky, k: k >= 2 * math.pi / cutoff
    a, b = _edges(cutoff, width)
    return lambda kx, ky, k: _rise(k, a, b)


def band_pass(long_wavelength: float, short_wavelength: float, long_width: float | None = None, short_width: float | None = None) -> Response:
    """Pass wavelengths between the two; where the tapers overlap the one at the short end wins.

    A taper is a fifth of the *other* cut-off unless given; cut-offs within a thousandth of their
    taper are moved up by a thousandth.
    """
    if long_wavelength < short_wavelength:
        raise ValueError("long_wavelength must not be shorter than short_wavelength")
    long_width = 0.2 * short_wavelength if long_width is None else long_width
    short_width = 0.2 * long_wavelength if short_width is None else short_width

    def clear(cutoff: float, width: float) -> float:
        cutoff += 1e-3 if cutoff - width < 1e-3 else 0.0
        cutoff += 1e-3 if abs(cutoff + width) < 1e-3 else 0.0
        return cutoff or 1e-3

    h0, h1 = _edges(clear(long_wavelength, long_width), long_width)
    l0, l1 = _edges(clear(short_wavelength, short_width), short_width)

    def response(kx: np.ndarray, ky: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = np.where((k >= h1) & (k <= l0), 1.0, 0.0)
        out = np.where((k >= h0) & (k < h1), _rise(k, h0, h1) if h1 > h0 else 0.0, out)
        return np.where((k > l0) & (k <= l1), 1 - _rise(k, l0, l1) if l1 > l0 else 0.0, out)

    return response


def sharp_band(long_wavelength: float, short_wavelength: float) -> Response:
    return lambda kx, ky, k: (k >= 2 * math.pi / long_wavelength) & (k <= 2 * math.pi / short_wavelength)


def butterworth(long_wavelength: float, short_wavelength: float, order: int = 4) -> Response:
    kh, kl = 2 * math.pi / long_wavelength, 2 * math.pi / short_wavelength

    def response(kx: np.ndarray, ky: np.ndarray, k: np.ndarray) -> np.ndarray:
        k = np.maximum(k, 1e-10)
        return 1.0 / (1.0 + (kh / k) ** (2 * order)) / (1.0 + (k / kl) ** (2 * order))

    return response


def directional_cosine(azimuth: float, degree: float) -> Response:
    return lambda kx, ky, k: np.abs(np.cos(np.arctan2(ky, kx) - math.radians(azimuth))) ** degree


def directional_butterworth(long_wavelength: float, short_wavelength: float, azimuth: float, width: float = 20.0, order: int = 4) -> Response:
    """Band times a squared cosine around one direction; one half-plane only, so the real part has half amplitude."""
    band, w = butterworth(long_wavelength, short_wavelength, order), math.radians(width)

    def response(kx: np.ndarray, ky: np.ndarray, k: np.ndarray) -> np.ndarray:
        off = np.angle(np.exp(1j * (np.arctan2(ky, kx) - math.radians(azimuth))))
        return band(kx, ky, k) * np.where(np.abs(off) <= w, np.cos(math.pi * off / (2 * w)) ** 2, 0.0)

    return response


def _field_direction(kx: np.ndarray, ky: np.ndarray, k: np.ndarray, inclination: float, declination: float) -> np.ndarray:
    i, d = math.radians(-inclination), math.radians(declination)
    return -math.sin(i) * k + 1j * math.cos(i) * (math.sin(d) * kx + math.cos(d) * ky)


def reduction_to_pole(inclination: float, declination: float) -> Response:
    """k squared over the product of the field's and the magnetisation's direction terms, which are equal here; 0 at k = 0."""
    if inclination == 0:
        raise ValueError("reduction to the pole is undefined at inclination 0")

    def response(kx: np.ndarray, ky: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = (kx * kx + ky * ky) / _field_direction(kx, ky, k + 1e-10, inclination, declination) ** 2
        return np.where(np.abs(out) > 1e6, 0.0, out)

    return response


def reduction_to_equator(inclination: float, declination: float) -> Response:
    i, d = math.radians(inclination), math.radians(declination)

    def response(kx: np.ndarray, ky: np.ndarray, k: np.ndarray) -> np.ndarray:
        c = np.cos(d - np.arctan2(kx, ky))
        flat = (math.cos(i) * c) ** 2
        return -((math.sin(i) - 1j * math.cos(i) * c) ** 2) * c * c / (math.sin(i) ** 2 * (1 + flat) + flat + 1e-10)

    return response


def corner_angles(nrows: int, ncols: int, corners: tuple[float, float, float, float], centre: float | None = None) -> Column:
    """An angle over ``(row, col)``, row 0 in the north: bilinear between its values in the north-west, north-east, south-west and south-east corner.

    A value at the centre is met by a bump that leaves the corners alone.
    """
    if nrows < 2 or ncols < 2:
        raise ValueError("corners need two rows and two columns")
    x, y = F.col("col") / F.lit(ncols - 1.0), 1 - F.col("row") / F.lit(nrows - 1.0)
    nw, ne, sw, se = map(float, corners)
    flat = (nw * (1 - x) + ne * x) * y + (sw * (1 - x) + se * x) * (1 - y)
    return flat if centre is None else flat + (centre - (nw + ne + sw + se) / 4) * 16 * x * (1 - x) * y * (1 - y)


def whole_wave_pole(inclination: float, declination: float) -> Response:
    """Reduction to the pole (radians) for waves counted from 1, real and imaginary part over a common denominator; 0 where that is 0."""
    along = math.cos(declination) * math.cos(inclination), math.sin(declination) * math.cos(inclination)
    down = math.sin(inclination)

    def response(kx: np.ndarray, ky: np.ndarray, k: np.ndarray) -> np.ndarray:
        t, flat = kx * kx + ky * ky, along[0] * ky + along[1] * kx
        top = down * down * t - flat * flat
        under = top * top + 4 * down * down * flat * flat * t
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(under == 0, 0, (t * top - 2j * down * flat * t**1.5) / under)

    return response


#: Step of the angle differences in radians, and what the first three of them are multiplied with.
ANGLE_STEP, TAYLOR = 0.01, (1.0, 0.5, 0.1666666)


def variable_reduction_to_pole(grid: DataFrame, nrows: int, ncols: int, inclination: Column, declination: Column) -> DataFrame:
    """``(row, col, v, base, inclination, declination)``: reduction to the pole under angles that vary over the grid.

    The angles are degrees, given as columns over the columns of ``grid`` (``corner_angles``, or
    columns of the table); row 0 is the north.  ``base`` is the reduction under the angles at the
    centre.  For either angle three passes take the difference of two reductions an ``ANGLE_STEP``
    apart, each of the result before, and a Taylor sum of the cell's own difference from the centre
    corrects the base.  Holes take their nearest value for the base and the mean for the
    differences, and are NULL in the end.
    """
    own = grid.select((nrows - 1 - F.col("row")).alias("row"), "col", F.col("v").cast("double").alias("v"), inclination.cast("double").alias("inclination"), declination.cast("double").alias("declination"))
    own = checkpointed(own)
    centre = own.where((F.col("row") == nrows // 2) & (F.col("col") == ncols // 2)).first()
    if centre is None or centre.inclination is None or centre.declination is None:
        raise ValueError("no angles at the centre of the grid")
    inc, dec = math.radians(centre.inclination), math.radians(centre.declination)
    pole = whole_wave_pole(inc, dec)
    steps = {"inc": whole_wave_pole(inc + ANGLE_STEP, dec), "dec": whole_wave_pole(inc, dec + ANGLE_STEP)}
    change = lambda moved: lambda kx, ky, k: (moved(kx, ky, k) - pole(kx, ky, k)) / ANGLE_STEP
    rates = {name: change(moved) for name, moved in steps.items()}
    spectrum = lambda cells: Spectrum(cells, nrows, ncols, level="none", padding=MirrorPadding(nrows, ncols), waves=whole_waves)
    flat = own.agg(F.avg("v")).first()[0]
    whole = own.select("row", "col", F.coalesce("v", F.lit(flat), F.lit(0.0)).alias("v"))
    named = lambda df, name, at: df.select("row", "col", F.lit(at).alias("at"), F.col(name).alias("x"))
    parts = [named(spectrum(own).filtered({"base": pole}, restore=False), "base", "base")]
    first = checkpointed(spectrum(whole).filtered(rates, restore=False))
    for name, rate in rates.items():
        last = first.select("row", "col", F.col(name).alias("v"))
        parts.append(named(last, "v", f"{name}0"))
        for k in (1, 2):
            s = spectrum(last)
            last = checkpointed(s.filtered({"v": rate}, restore=False))
            parts.append(named(last, "v", f"{name}{k}"))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    wide = union.groupBy("row", "col").agg(*[F.max(F.when(F.col("at") == c, F.col("x"))).alias(c) for c in ("base", *(f"{n}{k}" for n in rates for k in range(3)))])
    both = own.join(wide, ["row", "col"])
    off = {"inc": F.radians("inclination") - inc, "dec": F.radians("declination") - dec}
    taylor = sum((TAYLOR[k] * F.col(f"{n}{k}") * off[n] ** (k + 1) for n in rates for k in range(3)), F.col("base"))
    seen = lambda c: F.when(F.col("v").isNotNull(), c)
    return both.select((nrows - 1 - F.col("row")).alias("row"), "col", seen(taylor).alias("v"), seen(F.col("base")).alias("base"), "inclination", "declination")


GRADIENT = {"dx": derivative("x"), "dy": derivative("y"), "dz": derivative("z")}


def total_horizontal_gradient(s: Spectrum) -> DataFrame:
    g = s.several({t: GRADIENT[t] for t in ("dx", "dy")})
    return g.select("row", "col", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2).alias("v"))


def analytic_signal(s: Spectrum) -> DataFrame:
    g = s.several(GRADIENT)
    return g.select("row", "col", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2).alias("v"))


def tilt_angle(s: Spectrum, degrees: bool = False) -> DataFrame:
    """Radians, or degrees."""
    g = s.several(GRADIENT)
    angle = F.atan2(F.col("dz"), F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2))
    return g.select("row", "col", (F.degrees(angle) if degrees else angle).alias("v"))


def directional_clean(s: Spectrum, line_spacing: float, azimuth: float, scale: float) -> DataFrame:
    """The grid minus the scaled directional band of wavelengths below the line spacing, whose level is that of the grid."""
    band = s.apply(directional_butterworth(line_spacing, 1e-8, azimuth)).withColumnRenamed("v", "b")
    return s.grid.join(band, ["row", "col"]).select("row", "col", (F.col("v") - scale * F.col("b")).alias("v"))


def radial_power(grid: DataFrame, nrows: int, ncols: int, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """``(ring, k, log_power)``: mean power in rings as wide as one frequency step, NULL as 0, no taper."""
    step = max(2 * math.pi / (ncols * dx), 2 * math.pi / (nrows * dy))
    most = min((ncols - 1) // 2 * 2 * math.pi / (ncols * dx), (nrows - 1) // 2 * 2 * math.pi / (nrows * dy))
    s = Spectrum(grid, nrows, ncols, dx, dy, pads=((0, 0), (0, 0)), window="none", level="none", fill="level")

    def rings(block: int, spectrum: np.ndarray, kx: np.ndarray, ky: np.ndarray, k: np.ndarray) -> pd.DataFrame:
        ring = np.ceil(k / step - 0.5).astype(np.int32).ravel()
        power = pd.DataFrame({"ring": ring, "p": (np.abs(spectrum) ** 2).ravel()})
        return power[ring * step <= most + 1e-9].groupby("ring", as_index=False).agg(n=("p", "size"), p=("p", "sum"))

    sums = s.columns(rings, "ring int, n long, p double").groupBy("ring").agg((F.sum("p") / F.sum("n")).alias("p"))
    return sums.select("ring", (F.col("ring") * step).alias("k"), F.log("p").alias("log_power"))


def integer_radius_spectrum(grid: DataFrame, nrows: int, ncols: int, cell: float = 1.0) -> DataFrame:
    """``(radius, k, log_power)``: mean power at whole distances from zero frequency, holes filled by their nearest value."""
    s = Spectrum(grid, nrows, ncols, pads=((0, 0), (0, 0)), window="none", level="none")

    def rings(block: int, spectrum: np.ndarray, kx: np.ndarray, ky: np.ndarray, k: np.ndarray) -> pd.DataFrame:
        u, w = np.rint(ky * nrows / (2 * math.pi)), np.rint(kx * ncols / (2 * math.pi))
        radius = np.floor(np.sqrt(u * u + w * w)).astype(np.int32).ravel()
        power = pd.DataFrame({"radius": radius, "p": (np.abs(spectrum) ** 2).ravel()})
        inside = (radius >= 1) & (radius < min(nrows // 2, ncols // 2))
        return power[inside].groupby("radius", as_index=False).agg(n=("p", "size"), p=("p", "sum"))

    sums = s.columns(rings, "radius int, n long, p double").groupBy("radius").agg((F.sum("p") / F.sum("n")).alias("p"))
    return sums.select("radius", (F.col("radius") / (min(nrows, ncols) * cell)).alias("k"), F.log(F.col("p") + 1e-10).alias("log_power"))
