"""Main field synthesis from spherical harmonic coefficients."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.functions import scalar

REFERENCE_RADIUS = 6371.2
#: Coefficients that are sent to every task at most (degree 99).
MOST_COEFFICIENTS = 10_000


def at_date(coefficients: DataFrame, date: float, clamp: bool = False) -> DataFrame:
    """``(n, m, coef)`` of ``coefficients(n, m, year, coef)`` at a decimal year, linear between epochs.

    Before the first and after the last epoch the outer segment goes on, or its end value stays
    if ``clamp``.  Sine coefficients have a negative ``m``.
    """
    w = Window.partitionBy("n", "m").orderBy("year")
    seg = coefficients.select("n", "m", "year", "coef", F.lead("year").over(w).alias("y1"), F.lead("coef").over(w).alias("c1"), F.lag("year").over(w).alias("y_before"))
    lone = F.col("y_before").isNull() & F.col("y1").isNull()
    low, high = F.col("y_before").isNull() | (F.col("year") <= date), F.lead("y1").over(w).isNull() | (F.lit(date) < F.col("y1"))
    x = F.lit(float(date))
    x = F.least(F.greatest(x, F.col("year")), F.col("y1")) if clamp else x
    value = F.col("coef") + (F.col("c1") - F.col("coef")) * (x - F.col("year")) / (F.col("y1") - F.col("year"))
    chosen = seg.withColumn("use", lone | (F.col("y1").isNotNull() & low & high)).where("use")
    return chosen.select("n", "m", F.when(lone, F.col("coef")).otherwise(value).alias("coef"))


def _functions(degree: int, colatitude: np.ndarray) -> tuple[dict, dict, dict]:
    """Schmidt functions P, their derivatives, and P over the sine (for m > 0), each finite at the poles."""
    c, s = np.cos(colatitude), np.sin(colatitude)
    one, zero = np.ones_like(c), np.zeros_like(c)
    p, d, q = {(0, 0): one}, {(0, 0): zero}, {(1, 1): one}
    for m in range(degree + 1):
        if m:
            f = 1.0 if m == 1 else math.sqrt((2 * m - 1) / (2 * m))
            p[m, m] = f * s * p[m - 1, m - 1]
            d[m, m] = f * (s * d[m - 1, m - 1] + c * p[m - 1, m - 1])
            if m > 1:
                q[m, m] = f * s * q[m - 1, m - 1]
        for n in range(m + 1, degree + 1):
            a, b, norm = 2 * n - 1, math.sqrt((n - 1) ** 2 - m * m), math.sqrt(n * n - m * m)
            p[n, m] = (a * c * p[n - 1, m] - b * p.get((n - 2, m), zero)) / norm
            d[n, m] = (a * (c * d[n - 1, m] - s * p[n - 1, m]) - b * d.get((n - 2, m), zero)) / norm
            if m:
                q[n, m] = (a * c * q[n - 1, m] - b * q.get((n - 2, m), zero)) / norm
    return p, d, q


def synthesise(points: DataFrame, coefficients: DataFrame, radius: str, colatitude: str, longitude: str) -> DataFrame:
    """``points`` with ``b_r, b_theta, b_phi`` of ``coefficients(n, m, coef)`` at geocentric places (km, degrees).

    The coefficients go to every task as a bounded list; a NULL place has no field.
    """
    rows = coefficients.limit(MOST_COEFFICIENTS + 1).collect()
    if len(rows) > MOST_COEFFICIENTS:
        raise ValueError(f"more than {MOST_COEFFICIENTS} coefficients")
    terms = [(r["n"], r["m"], float(r["coef"])) for r in rows]
    degree = max((n for n, _, _ in terms), default=0)

    @F.pandas_udf("b_r double, b_theta double, b_phi double")
    def field(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for r, t, l in batches:
            r, t, l = r.to_numpy(float) / REFERENCE_RADIUS, np.radians(t.to_numpy(float)), np.radians(l.to_numpy(float))
            p, d, q = _functions(degree, t)
            out = np.zeros((3, len(r)))
            for n, m, g in terms:
                k, far = abs(m), g * r ** -(n + 2.0)
                wave, turn = (np.cos(k * l), k * np.sin(k * l)) if m >= 0 else (np.sin(k * l), -k * np.cos(k * l))
                out += far * np.stack([(n + 1) * p[n, k] * wave, -d[n, k] * wave, q[n, k] * turn if k else np.zeros_like(r)])
            yield pd.DataFrame(out.T, columns=["b_r", "b_theta", "b_phi"])

    at = [F.col(c).cast("double") for c in (radius, colatitude, longitude)]
    b = points.withColumn("_field", field(*at))
    ok = at[0].isNotNull() & at[1].isNotNull() & at[2].isNotNull()
    return b.select(*points.columns, *[F.when(ok, F.col(f"_field.{c}")).alias(c) for c in ("b_r", "b_theta", "b_phi")])


def main_field(points: DataFrame, coefficients: DataFrame, date: float, geodetic: bool = True) -> DataFrame:
    """``points(lat, lon, alt)`` with ``inc, dec, intensity`` at a decimal year.

    ``lat`` is geodetic and ``alt`` above the ellipsoid in km, and the components are turned back
    to the geodetic vertical; otherwise they are the geocentric latitude and the height over the
    reference radius.  Rows outside -90..90 or -180..360 degrees have no field.
    """
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 360)
    colatitude = F.when(ok, 90.0 - F.col("lat"))
    if geodetic:
        g = scalar.geodetic_to_geocentric(F.col("alt"), colatitude)
        place = points.withColumn("_r", g["radius"]).withColumn("_t", g["colatitude"])
    else:
        place = points.withColumn("_r", F.col("alt") + REFERENCE_RADIUS).withColumn("_t", colatitude)
    b = synthesise(place, at_date(coefficients, date), "_r", "_t", "lon")
    turn = F.radians(colatitude - F.col("_t")) if geodetic else F.lit(0.0)
    north, down = -F.col("b_theta"), -F.col("b_r")
    x, y, z = north * F.cos(turn) + down * F.sin(turn), F.col("b_phi"), down * F.cos(turn) - north * F.sin(turn)
    f = scalar.field_components(x, y, z)
    return b.select(*points.columns, f["i"].alias("inc"), f["d"].alias("dec"), f["f"].alias("intensity"))


def corner_field(coefficients: DataFrame, date: float, south: float, north: float, west: float, east: float, alt: float = 0.0, geodetic: bool = True) -> DataFrame:
    """``(place, lat, lon, inc, dec, intensity)`` at the four corners and the centre of a box in degrees."""
    spark = coefficients.sparkSession
    rows = [("nw", north, west), ("ne", north, east), ("sw", south, west), ("se", south, east), ("centre", (south + north) / 2, (west + east) / 2)]
    points = spark.createDataFrame([(p, float(a), float(o), float(alt)) for p, a, o in rows], "place string, lat double, lon double, alt double")
    return main_field(points, coefficients, date, geodetic).drop("alt")
