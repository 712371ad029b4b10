"""Column functions for dates, angles and field components."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS = 6371000.0
ECCENTRICITY2 = 0.00669438


def threshold(v: Column, condition: str, above: float | None = None, below: float | None = None) -> Column:
    """NULL for values above, below or strictly between the limits."""
    bad = {"above": v > above if above is not None else None, "below": v < below if below is not None else None}
    if condition == "between":
        bad["between"] = (v > below) & (v < above)
    if bad.get(condition) is None:
        raise ValueError(f"unknown condition or missing limit: {condition}")
    return F.when(~bad[condition], v)


def decimal_year(d: Column) -> Column:
    return F.year(d) + (F.dayofyear(d) - 1) / F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31)))


def metres_per_degree(lat: Column) -> dict[str, Column]:
    """Length in metres of one degree of longitude (``dx``) and of latitude (``dy``)."""
    arc = math.pi / 180 * EARTH_RADIUS
    s = F.sin(F.radians(lat))
    return {"dx": arc * F.cos(F.radians(lat)), "dy": arc * F.sqrt(1 - ECCENTRICITY2 * s * s)}


def field_components(x: Column, y: Column, z: Column) -> dict[str, Column]:
    """Declination, horizontal, inclination (degrees) and total intensity."""
    h = F.sqrt(x * x + y * y)
    return {"d": F.degrees(F.atan2(y, x)), "h": h, "i": F.degrees(F.atan2(z, h)), "f": F.sqrt(h * h + z * z)}


def geodetic_to_geocentric(height_km: Column, colatitude: Column) -> dict[str, Column]:
    """Radius (km) and geocentric colatitude (degrees) on WGS84."""
    a2, b2 = 6378.137**2, 6356.752314245**2
    c, s = F.cos(F.radians(colatitude)), F.sin(F.radians(colatitude))
    rho = F.sqrt(a2 * s * s + b2 * c * c)
    radius = F.sqrt(height_km * (height_km + 2 * rho) + (a2 * a2 * s * s + b2 * b2 * c * c) / (rho * rho))
    cd = (height_km + rho) / radius
    sd = (a2 - b2) / rho * c * s / radius
    return {"radius": radius, "colatitude": F.degrees(F.acos(c * cd - s * sd))}


def geocentric_to_geodetic(radius_km: Column, colatitude: Column) -> dict[str, Column]:
    """Height (km) and geodetic colatitude (degrees) on WGS84; three steps of the reduced-latitude rule leave less than a millimetre."""
    a, b = 6378.137, 6356.752314245
    e2, second = 1 - (b / a) ** 2, (a / b) ** 2 - 1
    r, z = radius_km * F.sin(F.radians(colatitude)), radius_km * F.cos(F.radians(colatitude))
    reduced = F.atan2(z * a, r * b)
    for _ in range(3):
        lat = F.atan2(z + second * b * F.sin(reduced) ** 3, r - e2 * a * F.cos(reduced) ** 3)
        reduced = F.atan2(F.sin(lat) * b, F.cos(lat) * a)
    height = r * F.cos(lat) + z * F.sin(lat) - a * F.sqrt(1 - e2 * F.sin(lat) ** 2)
    return {"height": height, "colatitude": 90 - F.degrees(lat)}


def component_rates(x: Column, y: Column, z: Column, dx: Column, dy: Column, dz: Column) -> dict[str, Column]:
    """Rates of declination and inclination (minutes of arc), horizontal and total intensity, from those of the components."""
    h2 = x * x + y * y
    h, f2 = F.sqrt(h2), h2 + z * z
    dh = (x * dx + y * dy) / h
    return {"d": 60 * F.degrees((x * dy - y * dx) / h2), "h": dh, "i": 60 * F.degrees((h * dz - dh * z) / f2), "f": (x * dx + y * dy + z * dz) / F.sqrt(f2)}


def number(text: Column, whole: bool = False) -> Column:
    """A decimal number written with a comma or a point and blanks anywhere; NULL if it is none.  ``whole`` cuts the fraction off."""
    value = F.regexp_replace(F.regexp_replace(text, r"\s", ""), ",", ".").try_cast("double")
    return value.cast("long") if whole else value


def sexagesimal(text: Column) -> Column:
    """Decimal degrees of ``D M S`` with any separators and a sign or hemisphere letter; minutes and seconds may be left out."""
    part = lambda k: F.coalesce(F.regexp_extract(text, r"(\d+(?:\.\d+)?)\D*(\d+(?:\.\d+)?)?\D*(\d+(?:\.\d+)?)?", k).try_cast("double"), F.lit(0.0))
    size = part(1) + part(2) / 60 + part(3) / 3600
    return F.when(text.rlike(r"\d"), F.when(text.rlike(r"(?i)^\s*-|[sw]"), -size).otherwise(size))


def close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Equal within ``atol + rtol * |b|``; infinite values only to themselves, NaN and NULL to nothing."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))
    near = F.when(finite(a) & finite(b), F.abs(a - b) <= atol + rtol * F.abs(b)).otherwise((a == b) & ~F.isnan(a))
    return F.coalesce(near, F.lit(False))


def degrees_minutes(degrees: Column, minutes: Column, most: float) -> Column:
    """Decimal degrees of whole degrees and minutes with the sign of the degrees; NULL beyond ``most`` or outside 0..60 minutes."""
    value = degrees + F.when(F.signum(degrees) < 0, -minutes).otherwise(minutes) / 60
    return F.when(minutes.between(0, 60) & (F.abs(value) <= most), value)


def odd(n: Column) -> Column:
    """The next odd whole number from ``n`` on, at least 1."""
    least = F.greatest(F.ceil(n), F.lit(1))
    return least + F.when(least % 2 == 0, 1).otherwise(0)


def map_coordinates(row: Column, col: Column, transform: tuple[float, ...]) -> dict[str, Column]:
    """Map place of a pixel place under an affine transform ``(x0, dx, row-x, y0, col-y, dy)``."""
    x0, dx, rx, y0, cy, dy = map(float, transform)
    return {"x": x0 + col * dx + row * rx, "y": y0 + col * cy + row * dy}


def pixel_coordinates(x: Column, y: Column, transform: tuple[float, ...]) -> dict[str, Column]:
    """Pixel place of a map place: the inverse of :func:`map_coordinates`."""
    x0, dx, rx, y0, cy, dy = map(float, transform)
    det = dx * dy - rx * cy
    if det == 0:
        raise ValueError("the transform has no inverse")
    u, v = x - x0, y - y0
    return {"row": (v * dx - u * cy) / det, "col": (u * dy - v * rx) / det}


def geographic_of_utm(east: Column, north: Column, zone: Column, southern: Column) -> dict[str, Column]:
    """Latitude and longitude (WGS84 degrees) of transverse Mercator metres, by the series in the third flattening to its fourth power."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    # Coefficients of the inverse series, and below of the one from conformal to geodetic latitude.
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    xi, eta = (north - F.when(southern, 1e7).otherwise(0.0)) / (0.9996 * radius), (east - 500000.0) / (0.9996 * radius)
    x = xi - sum(b * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, b in enumerate(beta))
    e = eta - sum(b * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, b in enumerate(beta))
    chi = F.asin(F.sin(x) / F.cosh(e))
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    lat = chi + sum(d * F.sin(2 * (k + 1) * chi) for k, d in enumerate(delta))
    return {"lat": F.degrees(lat), "lon": zone * 6 - 183 + F.degrees(F.atan2(F.sinh(e), F.cos(x)))}


def utm_of_geographic(lat: Column, lon: Column, zone: Column) -> dict[str, Column]:
    """Transverse Mercator metres in a zone; northings of southern latitudes count from ten million."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius, ecc = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64), math.sqrt(f * (2 - f))
    # Coefficients of the forward series.
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    s, away = F.sin(F.radians(lat)), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(s) - ecc * F.atanh(ecc * s))
    xi, eta = F.atan2(t, F.cos(away)), F.asinh(F.sin(away) / F.sqrt(t * t + F.cos(away) ** 2))
    x = xi + sum(c * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, c in enumerate(alpha))
    e = eta + sum(c * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, c in enumerate(alpha))
    return {"east": 500000.0 + 0.9996 * radius * e, "north": 0.9996 * radius * x + F.when(lat < 0, 1e7).otherwise(0.0)}


def angle_between_axes(a: Column, b: Column) -> Column:
    """Difference of two axial orientations in degrees, 0..90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)
