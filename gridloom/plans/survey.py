"""Queries of edges, field synthesis, wavelets, outlines, scalars and statistics, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions import scalar
from gridloom.operators import field, focal, graph, lines, outlines, stats, streamlines, surfaces, wavelet, worms
from gridloom.plans.registry import CELLS, GRID_SQL, N, add, grid, out, rounded
from gridloom.sources import fixtures

# --- edges on a grid that closes on itself --------------------------------------------------

_LEVEL_SQL = f"{GRID_SQL}, f AS (SELECT row, col, v - 48000.0 AS v FROM full_)"


def _level(s: SparkSession, d: str) -> DataFrame:
    return grid(s, d, False).select("row", "col", (F.col("v") - 48_000.0).alias("f"))


_at = lambda name, dr, dc: f"JOIN f {name} ON {name}.row = (a.row + {dr} + {N}) % {N} AND {name}.col = (a.col + {dc} + {N}) % {N}"
add(
    "sign_changes", lambda s, d: worms.sign_changes(_level(s, d)),
    f"WITH {_LEVEL_SQL} SELECT a.row, a.col, least(a.v * r.v, a.v * l.v, a.v * u.v, a.v * o.v) < 0 AS edge FROM f a {_at('r', 0, 1)} {_at('l', 0, -1)} {_at('u', 1, 0)} {_at('o', -1, 0)}",
)
_ways = {"r": (0, 1), "u": (1, 0), "ru": (1, 1), "ro": (-1, 1)}
add(
    "fractional_changes", lambda s, d: worms.fractional_changes(_level(s, d)),
    f"WITH {_LEVEL_SQL} SELECT a.row, a.col, coalesce(" + " OR ".join(f"coalesce(a.v / nullif(a.v - {n}.v, 0) BETWEEN 0 AND 1, false)" for n in _ways) + ", false) AS edge FROM f a " + " ".join(_at(n, *w) for n, w in _ways.items()),
)
add(
    "wrapped_gradient", lambda s, d: out(worms.wrapped_gradient(_level(s, d), "f", "gx", "gy", 2.0, 4.0).select("row", "col", "gx", "gy"), 6, "gx", "gy"),
    f"WITH {_LEVEL_SQL} SELECT a.row, a.col, round((r.v - l.v) / 2, 6) + 0.0 AS gx, round((u.v - o.v) / 4, 6) + 0.0 AS gy FROM f a {_at('r', 0, 1)} {_at('l', 0, -1)} {_at('u', 1, 0)} {_at('o', -1, 0)}",
)

_P, _M = 10, 68  # a fifth of 48 rounded up to an even number, and 48 with both pads
_RAMP = f"(CASE WHEN {{i}} < {_P} THEN {{i}} / {_P}.0 WHEN {{i}} >= {N + _P} THEN ({_M - 1} - {{i}}) / {_P}.0 ELSE 1 END)"
_HANN = f"(0.5 - 0.5 * cos(2 * pi() * {{i}} / {_M - 1}))"
_near = lambda i: f"least(greatest({i} - {_P}, 0), {N - 1})"
_ang = lambda a, b: f"2 * pi() * (({a} * {b}) % {_M}) / {_M}"
_freq = lambda i: f"2 * pi() * (CASE WHEN {i} < {_M // 2} THEN {i} ELSE {i} - {_M} END) / {_M}"
_wrap = lambda name, t, dr, dc: f"JOIN {t} {name} ON {name}.z = a.z AND {name}.row = (a.row + {dr} + {_M}) % {_M} AND {name}.col = (a.col + {dc} + {_M}) % {_M}"
WORM_SQL = f"""WITH {GRID_SQL}, i AS (SELECT CAST(range AS INTEGER) AS i FROM range({_M})), m AS (SELECT avg(v) AS m FROM g), z AS (SELECT unnest([1.0, 2.0, 3.0]) AS z),
x AS (SELECT r.i AS row, c.i AS col, coalesce(g.v - m.m, 0) * {_RAMP.format(i='r.i')} * {_RAMP.format(i='c.i')} * {_HANN.format(i='r.i')} * {_HANN.format(i='c.i')} AS x FROM i r, i c, m, g WHERE g.row = {_near('r.i')} AND g.col = {_near('c.i')}),
a1 AS (SELECT row, i AS w, sum(x * cos({_ang('col', 'i')})) AS re, -sum(x * sin({_ang('col', 'i')})) AS im FROM x, i GROUP BY 1, 2),
s AS (SELECT i AS u, w, sum(re * cos({_ang('row', 'i')}) + im * sin({_ang('row', 'i')})) AS re, sum(im * cos({_ang('row', 'i')}) - re * sin({_ang('row', 'i')})) AS im FROM a1, i GROUP BY 1, 2),
h AS (SELECT z, u, w, re * exp(-z * sqrt(power({_freq('w')}, 2) + power({_freq('u')}, 2))) AS re, im * exp(-z * sqrt(power({_freq('w')}, 2) + power({_freq('u')}, 2))) AS im FROM s, z),
b AS (SELECT z, i AS row, w, sum(re * cos({_ang('u', 'i')}) - im * sin({_ang('u', 'i')})) / {_M} AS re, sum(im * cos({_ang('u', 'i')}) + re * sin({_ang('u', 'i')})) / {_M} AS im FROM h, i GROUP BY 1, 2, 3),
t AS (SELECT z, row, i AS col, sum(re * cos({_ang('w', 'i')}) - im * sin({_ang('w', 'i')})) / {_M} AS v FROM b, i GROUP BY 1, 2, 3),
gr AS (SELECT a.z, a.row, a.col, r.v - l.v AS gx, u.v - o.v AS gy, sqrt(power(r.v - l.v, 2) + power(u.v - o.v, 2)) AS v FROM t a {_wrap('r', 't', 0, 1)} {_wrap('l', 't', 0, -1)} {_wrap('u', 't', 1, 0)} {_wrap('o', 't', -1, 0)}),
e AS (SELECT a.z, a.row, a.col, a.v AS modulus, CASE WHEN a.v <= 1e-8 THEN 0 ELSE ((r.v - l.v) * a.gx + (u.v - o.v) * a.gy) / a.v END AS f FROM gr a {_wrap('r', 'gr', 0, 1)} {_wrap('l', 'gr', 0, -1)} {_wrap('u', 'gr', 1, 0)} {_wrap('o', 'gr', -1, 0)}),
c AS (SELECT a.z, a.row, a.col, a.modulus, a.f / nullif(a.f - r.f, 0) AS sx, a.f / nullif(a.f - u.f, 0) AS sy FROM e a {_wrap('r', 'e', 0, 1)} {_wrap('u', 'e', 1, 0)}),
pp AS (SELECT z, col + sx AS x, row AS y, modulus AS val FROM c WHERE sx BETWEEN 0 AND 1 UNION ALL SELECT z, col, row + sy, modulus FROM c WHERE sy BETWEEN 0 AND 1)
SELECT CAST(z AS DOUBLE) AS z, round(x - {_P}, 4) + 0.0 AS x, round(y - {_P}, 4) + 0.0 AS y, round(val, 3) + 0.0 AS val FROM pp WHERE x BETWEEN {_P} AND {_P + N} AND y BETWEEN {_P} AND {_P + N}"""


def _worms(s: SparkSession, d: str) -> DataFrame:
    found = worms.worms(grid(s, d), N, N, 3, 1.0, 1.0)
    return out(out(found, 4, "x", "y"), 3, "val")


add("worm_points", _worms, WORM_SQL)


def _places(s: SparkSession, d: str) -> DataFrame:
    """Parts as points on three levels."""
    p = fixtures.table(s, d, "part")
    return p.select(((F.col("p_size") % 3).cast("double")).alias("z"), F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7 % 293 / 3).alias("x"), (F.col("p_partkey") * 11 % 311 / 3).alias("y"))


add(
    "worm_clusters", lambda s, d: worms.clusters(_places(s, d), 2.5).select("id", "cluster"),
    """WITH RECURSIVE p AS (SELECT p_size % 3 AS z, p_partkey AS id, p_partkey * 7 % 293 / 3 AS x, p_partkey * 11 % 311 / 3 AS y FROM part WHERE p_size % 3 >= 1),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.z = b.z AND a.id <> b.id AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 6.25),
r(id, root) AS (SELECT id, id FROM p UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), l AS (SELECT id, min(root) AS cluster FROM r GROUP BY id)
SELECT id, cluster FROM l WHERE cluster IN (SELECT cluster FROM l GROUP BY 1 HAVING count(*) > 1)""",
)
add("worm_polylines", lambda s, d: worms.as_wkt(worms.polylines(_places(s, d), 2.5), ["z", "cluster", "line"]))

# --- field ----------------------------------------------------------------------------------

_TERMS = [(1, 0), (1, 1), (1, -1), (2, 0), (2, 1), (2, -1), (2, 2), (2, -2)]


def _harmonics(s: SparkSession, d: str) -> DataFrame:
    """Eight coefficients at three epochs from the prices of the first parts, with changing signs."""
    names = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in _TERMS])
    p = fixtures.table(s, d, "part").where("p_partkey BETWEEN 1 AND 24").withColumn("k", ((F.col("p_partkey") - 1) % 8).cast("int"))
    year = 2000 + 5 * F.floor((F.col("p_partkey") - 1) / 8)
    return p.select(F.get(names, "k")["n"].alias("n"), F.get(names, "k")["m"].alias("m"), year.cast("double").alias("year"), (F.col("p_retailprice") * 10 * F.when(F.col("k") % 2 == 0, -1).otherwise(1)).alias("coef"))


_HARM = """co AS (SELECT CAST((p_partkey - 1) % 8 AS INTEGER) AS k, 2000 + 5 * floor((p_partkey - 1) / 8) AS year, p_retailprice * 10 * CASE WHEN (p_partkey - 1) % 8 % 2 = 0 THEN -1 ELSE 1 END AS coef FROM part WHERE p_partkey BETWEEN 1 AND 24)"""
for name, date, clamp in (("coefficients_at", 2007.5, False), ("coefficients_beyond", 2013.0, False), ("coefficients_clamped", 2013.0, True)):
    seg = (2005, 2010)
    t = (min(date, 2010) if clamp else date) - 2005
    add(
        name, lambda s, d, x=date, c=clamp: out(field.at_date(_harmonics(s, d), x, c), 6, "coef"),
        f"WITH {_HARM}, t(k, n, m) AS (VALUES {', '.join(f'({k}, {n}, {m})' for k, (n, m) in enumerate(_TERMS))}) SELECT t.n, t.m, round(a.coef + (b.coef - a.coef) * {t / 5}, 6) + 0.0 AS coef FROM t JOIN co a ON a.k = t.k AND a.year = 2005 JOIN co b ON b.k = t.k AND b.year = 2010",
    )


def _stations(s: SparkSession, d: str) -> DataFrame:
    c = fixtures.table(s, d, "customer")
    return c.select("c_custkey", (F.col("c_custkey") * 37 % 17900 / 100.0 - 89.5).alias("lat"), (F.col("c_custkey") * 53 % 36000 / 100.0 - 180).alias("lon"), (F.col("c_acctbal") / 1000).alias("alt"))


def _field_sql(geodetic: bool) -> str:
    place = """g AS (SELECT *, sqrt(40680631.59076899 * sin(gt) * sin(gt) + 40408299.98466144 * cos(gt) * cos(gt)) AS rho FROM p),
q AS (SELECT *, sqrt(alt * (alt + 2 * rho) + (power(40680631.590769, 2) * sin(gt) * sin(gt) + power(40408299.98466144, 2) * cos(gt) * cos(gt)) / (rho * rho)) AS r FROM g),
e AS (SELECT *, acos(cos(gt) * (alt + rho) / r - sin(gt) * ((40680631.590769 - 40408299.98466144) / rho * cos(gt) * sin(gt) / r)) AS t FROM q)""" if geodetic else "e AS (SELECT *, alt + 6371.2 AS r, gt AS t FROM p)"
    return f"""WITH {_HARM}, c AS (SELECT k, max(CASE WHEN year = 2005 THEN coef END) * 0.5 + max(CASE WHEN year = 2010 THEN coef END) * 0.5 AS v FROM co GROUP BY k),
w AS (SELECT {', '.join(f'max(CASE WHEN k = {k} THEN v END) AS c{k}' for k in range(8))} FROM c),
p AS (SELECT c_custkey, c_custkey * 37 % 17900 / 100.0 - 89.5 AS lat, radians(c_custkey * 53 % 36000 / 100.0 - 180) AS l, c_acctbal / 1000 AS alt, radians(90 - (c_custkey * 37 % 17900 / 100.0 - 89.5)) AS gt FROM customer),
{place}, f AS (SELECT e.*, w.*, power(6371.2 / r, 3) AS r1, power(6371.2 / r, 4) AS r2, cos(t) AS c, sin(t) AS s FROM e, w),
a AS (SELECT *, c1 * cos(l) + c2 * sin(l) AS h11, c4 * cos(l) + c5 * sin(l) AS h21, c6 * cos(2 * l) + c7 * sin(2 * l) AS h22, c1 * sin(l) - c2 * cos(l) AS k11, c4 * sin(l) - c5 * cos(l) AS k21, 2 * (c6 * sin(2 * l) - c7 * cos(2 * l)) AS k22 FROM f),
b AS (SELECT *, 2 * r1 * (c0 * c + h11 * s) + 3 * r2 * (c3 * (3 * c * c - 1) / 2 + h21 * sqrt(3) * s * c + h22 * sqrt(3) / 2 * s * s) AS br,
 -r1 * (-c0 * s + h11 * c) - r2 * (-c3 * 3 * c * s + h21 * sqrt(3) * (c * c - s * s) + h22 * sqrt(3) * s * c) AS bt, r1 * k11 + r2 * (k21 * sqrt(3) * c + k22 * sqrt(3) / 2 * s) AS bp FROM a),
x AS (SELECT c_custkey, -bt * cos(gt - t) - br * sin(gt - t) AS x, bp AS y, -br * cos(gt - t) + bt * sin(gt - t) AS z FROM b)
SELECT c_custkey, round(degrees(atan2(z, sqrt(x * x + y * y))), 5) + 0.0 AS inc, round(degrees(atan2(y, x)), 5) + 0.0 AS dec, round(sqrt(x * x + y * y + z * z), 4) + 0.0 AS intensity FROM x"""


for name, geodetic in (("main_field", True), ("main_field_geocentric", False)):
    add(
        name, lambda s, d, g=geodetic: out(out(field.main_field(_stations(s, d), _harmonics(s, d), 2007.5, g).select("c_custkey", "inc", "dec", "intensity"), 5, "inc", "dec"), 4, "intensity"),
        _field_sql(geodetic),
    )
add("corner_field", lambda s, d: out(field.corner_field(_harmonics(s, d), 2007.5, -32.0, -30.0, 118.0, 121.0), 4, "inc", "dec", "intensity"))

# --- scalars --------------------------------------------------------------------------------

_LL = "c_custkey * 37 % 1600 / 10.0 - 80"


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    """Geodetic to geocentric places and back."""
    c = fixtures.table(s, d, "customer").select("c_custkey", F.expr(f"90 - ({_LL})").alias("t"), (F.col("c_acctbal") / 1000).alias("h"))
    there = scalar.geodetic_to_geocentric(F.col("h"), F.col("t"))
    c = c.withColumn("r", there["radius"]).withColumn("g", there["colatitude"])
    back = scalar.geocentric_to_geodetic(F.col("r"), F.col("g"))
    return out(c.select("c_custkey", back["height"].alias("height"), back["colatitude"].alias("colatitude")), 5, "height", "colatitude")


add("geocentric_to_geodetic", _round_trip, f"SELECT c_custkey, round(c_acctbal / 1000, 5) + 0.0 AS height, round(90 - ({_LL}), 5) + 0.0 AS colatitude FROM customer")


def _utm(s: SparkSession, d: str) -> DataFrame:
    c = fixtures.table(s, d, "customer").select("c_custkey", F.expr(_LL).cast("double").alias("lat"), (F.col("c_custkey") * 53 % 600 / 100.0 + 114).alias("lon"), F.lit(50).alias("zone"))
    m = scalar.utm_of_geographic(F.col("lat"), F.col("lon"), F.col("zone"))
    return c.withColumn("east", m["east"]).withColumn("north", m["north"])


add(
    "utm", lambda s, d: out(_utm(s, d).select("c_custkey", "east", "north"), 0, "east", "north"),
    f"""WITH p AS (SELECT c_custkey, radians({_LL}) AS b, radians(c_custkey * 53 % 600 / 100.0 + 114 - 117) AS dl, 6378137.0 AS a, 0.0066943799901413165 AS e2 FROM customer),
q AS (SELECT *, e2 / (1 - e2) AS ep, a / sqrt(1 - e2 * sin(b) * sin(b)) AS v, tan(b) * tan(b) AS t, e2 / (1 - e2) * cos(b) * cos(b) AS c, dl * cos(b) AS g,
 a * ((1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * power(e2, 3) / 256 - 175 * power(e2, 4) / 16384) * b - (3 * e2 / 8 + 3 * e2 * e2 / 32 + 45 * power(e2, 3) / 1024 + 105 * power(e2, 4) / 4096) * sin(2 * b)
 + (15 * e2 * e2 / 256 + 45 * power(e2, 3) / 1024 + 525 * power(e2, 4) / 16384) * sin(4 * b) - (35 * power(e2, 3) / 3072 + 175 * power(e2, 4) / 12288) * sin(6 * b) + 315 * power(e2, 4) / 131072 * sin(8 * b)) AS m FROM p)
SELECT c_custkey, round(500000 + 0.9996 * v * (g + (1 - t + c) * power(g, 3) / 6 + (5 - 18 * t + t * t + 14 * c - 58 * t * c + 13 * c * c) * power(g, 5) / 120 + (61 - 479 * t + 179 * t * t - power(t, 3)) * power(g, 7) / 5040), 0) + 0.0 AS east,
round(CASE WHEN b < 0 THEN 10000000 ELSE 0 END + 0.9996 * (m + v * tan(b) * (g * g / 2 + (5 - t + 9 * c + 4 * c * c) * power(g, 4) / 24 + (61 - 58 * t + t * t + 270 * c - 330 * t * c + 445 * c * c) * power(g, 6) / 720 + (1385 - 3111 * t + 543 * t * t - power(t, 3)) * power(g, 8) / 40320)), 0) + 0.0 AS north FROM q""",
)


def _utm_back(s: SparkSession, d: str) -> DataFrame:
    g = scalar.geographic_of_utm(F.col("east"), F.col("north"), F.col("zone"), F.col("lat") < 0)
    return out(_utm(s, d).select("c_custkey", g["lat"].alias("la"), g["lon"].alias("lo")), 7, "la", "lo")


add("utm_inverse", _utm_back, f"SELECT c_custkey, round({_LL}, 7) + 0.0 AS la, round(c_custkey * 53 % 600 / 100.0 + 114, 7) + 0.0 AS lo FROM customer")


def _rates(s: SparkSession, d: str) -> DataFrame:
    q = fixtures.table(s, d, "lineitem")
    f = scalar.component_rates(F.col("l_extendedprice"), F.col("l_quantity") * 1000 - 25000, F.col("l_discount") * 1e5, F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 50 - 3)
    return out(q.select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in f.items()]), 6, *f)


add(
    "dhif_rates", _rates,
    """WITH q AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_quantity * 1000 - 25000 AS y, l_discount * 1e5 AS z, l_quantity AS a, l_tax * 100 AS b, l_discount * 50 - 3 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(degrees((b * x - a * y) / (x*x + y*y)) * 60, 6) + 0.0 AS d, round((x * a + y * b) / sqrt(x*x + y*y), 6) + 0.0 AS h,
round(degrees((sqrt(x*x + y*y) * c - (x * a + y * b) / sqrt(x*x + y*y) * z) / (x*x + y*y + z*z)) * 60, 6) + 0.0 AS i, round((x * a + y * b + z * c) / sqrt(x*x + y*y + z*z), 6) + 0.0 AS f FROM q""",
)


def _written(s: SparkSession, d: str) -> DataFrame:
    """Numbers and angles written as text, read back."""
    q = fixtures.table(s, d, "lineitem").where("l_linenumber <= 2")
    text = F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit(","), F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0"), F.lit(" "))
    angle = F.concat((F.col("l_partkey") % 180).cast("string"), F.lit("° "), (F.col("l_suppkey") % 60).cast("string"), F.lit("' "), (F.col("l_orderkey") % 60).cast("string"), F.lit('" '), F.when(F.col("l_linenumber") == 1, "S").otherwise("E"))
    return q.select("l_orderkey", "l_linenumber", F.round(scalar.number(text), 6).alias("v"), scalar.number(text, True).alias("whole"), (F.round(scalar.sexagesimal(angle), 8) + 0.0).alias("angle"))


add(
    "written_numbers", _written,
    """SELECT l_orderkey, l_linenumber, round(l_orderkey + l_partkey % 100 / 100.0, 6) AS v, l_orderkey AS whole,
round((l_partkey % 180 + l_suppkey % 60 / 60.0 + l_orderkey % 60 / 3600.0) * CASE WHEN l_linenumber = 1 THEN -1 ELSE 1 END, 8) + 0.0 AS angle FROM lineitem WHERE l_linenumber <= 2""",
)


def _small(s: SparkSession, d: str) -> DataFrame:
    q = fixtures.table(s, d, "lineitem")
    t = (1000.0, 25.0, 1.5, 9000.0, -0.5, -30.0)
    there = scalar.map_coordinates(F.col("l_partkey") % 500, F.col("l_suppkey") % 300, t)
    q = q.withColumn("x", there["x"]).withColumn("y", there["y"])
    back = scalar.pixel_coordinates(F.col("x"), F.col("y"), t)
    return q.select(
        "l_orderkey", "l_linenumber", (F.round("x", 5) + 0.0).alias("x"), (F.round("y", 5) + 0.0).alias("y"), (F.round(back["row"], 6) + 0.0).alias("r"), (F.round(back["col"], 6) + 0.0).alias("c"),
        scalar.odd(F.col("l_quantity")).alias("odd"), scalar.close(F.col("l_discount"), F.col("l_tax"), 0.2, 0.001).alias("near"),
        (F.round(scalar.degrees_minutes(F.col("l_partkey") % 200 - 100, F.col("l_suppkey") % 70, 90.0), 8) + 0.0).alias("deg"),
    )


add(
    "small_functions", _small,
    """SELECT l_orderkey, l_linenumber, round(1000 + l_suppkey % 300 * 25 + l_partkey % 500 * 1.5, 5) + 0.0 AS x, round(9000 - l_suppkey % 300 * 0.5 - l_partkey % 500 * 30, 5) + 0.0 AS y,
CAST(l_partkey % 500 AS DOUBLE) AS r, CAST(l_suppkey % 300 AS DOUBLE) AS c, CAST(greatest(ceil(l_quantity), 1) + CASE WHEN CAST(greatest(ceil(l_quantity), 1) AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS odd,
abs(l_discount - l_tax) <= 0.001 + 0.2 * abs(l_tax) AS near, CASE WHEN l_suppkey % 70 <= 60 AND abs(deg) <= 90 THEN round(deg, 8) + 0.0 END AS deg
FROM (SELECT *, l_partkey % 200 - 100 + CASE WHEN l_partkey % 200 < 100 THEN -(l_suppkey % 70) ELSE l_suppkey % 70 END / 60.0 AS deg FROM lineitem)""",
)

# --- statistics -----------------------------------------------------------------------------

_EST = "est AS (SELECT l_linenumber AS si, CAST(l_partkey % 1000 AS DOUBLE) AS y, CAST(l_orderkey % 1000 AS DOUBLE) AS x, l_extendedprice AS z FROM lineitem)"


def _estimates(s: SparkSession, d: str) -> DataFrame:
    q = fixtures.table(s, d, "lineitem")
    return q.select(F.col("l_linenumber").alias("si"), (F.col("l_partkey") % 1000).cast("double").alias("y"), (F.col("l_orderkey") % 1000).cast("double").alias("x"), F.col("l_extendedprice").alias("z"))


add(
    "estimates_within", lambda s, d: out(stats.mean_places(stats.within(_estimates(s, d), 100, 900, 50, 950)), 8, "mean_x_km", "mean_y_km", "mean_z_km"),
    f"WITH {_EST} SELECT si, round(avg(x) / 1000, 8) AS mean_x_km, round(avg(y) / 1000, 8) AS mean_y_km, round(avg(z) / 1000, 8) AS mean_z_km FROM est WHERE y > 100 AND y < 900 AND x > 50 AND x < 950 GROUP BY si",
)
add(
    "extreme_to_null", lambda s, d: out(stats.extreme_to_null(grid(s, d), 36000.0)), rounded(f"WITH {GRID_SQL} SELECT row, col, CASE WHEN v >= 36000 THEN v END AS v FROM g"),
)
add(
    "grid_frame", lambda s, d: stats.grid_frame(fixtures.stations(s, d), 3.0),
    """WITH b AS (SELECT min(p_partkey % 50) AS lx, max(p_partkey % 50) AS hx, min(p_size) AS ly, max(p_size) AS hy FROM part)
SELECT CAST(lx AS DOUBLE) AS x0, CAST(ly AS DOUBLE) AS y0, CAST(floor((hx - lx) / 3) AS BIGINT) AS ncols, CAST(floor((hy - ly) / 3) AS BIGINT) AS nrows, (lx + hx) / 2 AS centre_x, (ly + hy) / 2 AS centre_y FROM b""",
)


def _orthogonal_sql(source: str, by: str) -> str:
    """``flat``: ``source(by, row, col, v)`` minus its quadric, by taking the terms off one after another, each made orthogonal to those before."""
    terms = ["1.0", "c", "r", "c * c", "c * r", "r * r"]
    key, on = (f"{by}, " if by else ""), (f"a.{by} = b.{by}" if by else "true")
    cols = ", ".join(f"{t} AS q{k}" for k, t in enumerate(terms))
    sql, last = [f"e0 AS (SELECT *, {cols} FROM (SELECT {key}row, col, v, v AS y, col / {N}.0 - 0.5 AS c, row / {N}.0 - 0.5 AS r FROM {source}))"], "e0"
    for j in range(len(terms)):
        rest = [f"q{k}" for k in range(j + 1, len(terms))] + ["y"]
        sums = ", ".join(f"sum(CASE WHEN v IS NOT NULL THEN {x} * q{j} END) / sum(CASE WHEN v IS NOT NULL THEN q{j} * q{j} END) AS m_{x}" for x in rest)
        group = f" GROUP BY {by}" if by else ""
        kept = ", ".join(f"a.q{k}" for k in range(j + 1))
        new = ", ".join(f"a.{x} - b.m_{x} * a.q{j} AS {x}" for x in rest)
        sql.append(f"s{j} AS (SELECT {key}{sums} FROM {last}{group})")
        sql.append(f"e{j + 1} AS (SELECT {f'a.{by}, ' if by else ''}a.row, a.col, a.v, {kept}, {new} FROM {last} a JOIN s{j} b ON {on})")
        last = f"e{j + 1}"
    return ", ".join(sql) + f", flat AS (SELECT {key}row, col, CASE WHEN v IS NOT NULL THEN y END AS d FROM {last})"


add("detrend_quadric", lambda s, d: out(stats.detrend_quadric(grid(s, d), N, N), 3), f"WITH {GRID_SQL}, {_orthogonal_sql('g', '')} SELECT row, col, round(d, 3) + 0.0 AS v FROM flat")
add(
    "normalise_grids_2", lambda s, d: out(stats.normalise_grids(fixtures.grid_set(s, d, N), 2, N, N), 3),
    f"""WITH gs AS (SELECT l_linenumber AS grid_id, CAST(l_partkey % {N} AS INTEGER) AS row, CAST(l_orderkey % {N} AS INTEGER) AS col, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3),
{_orthogonal_sql('gs', 'grid_id')}, s AS (SELECT grid_id, avg(d) AS a, stddev_pop(d) AS sd FROM flat GROUP BY 1 HAVING stddev_pop(d) > 0)
SELECT flat.grid_id, row, col, round((SELECT arg_min(sd, grid_id) FROM s) * (d - a) / sd, 3) + 0.0 AS v FROM flat JOIN s ON s.grid_id = flat.grid_id""",
)


def _bands(s: SparkSession, d: str) -> DataFrame:
    q = fixtures.table(s, d, "lineitem").groupBy((F.col("l_partkey") % N).cast("int").alias("row"), (F.col("l_orderkey") % N).cast("int").alias("col"))
    return q.agg(F.avg("l_extendedprice").alias("b1"), F.avg("l_quantity").alias("b2"), F.avg("l_discount").alias("b3"))


def _ratios(s: SparkSession, d: str) -> DataFrame:
    _, ratios, _ = stats.principal_components(_bands(s, d), ["b1", "b2", "b3"])
    return s.createDataFrame([(k, round(r, 7)) for k, r in enumerate(ratios, 1)], "k int, ratio double")


# Eigenvalues of a 3 x 3 correlation matrix by the cosine form of the cubic's roots: 1 + 2 p cos(.).
add(
    "pca_ratios", _ratios,
    f"""WITH q AS (SELECT l_partkey % {N} AS row, l_orderkey % {N} AS col, avg(l_extendedprice) AS b1, avg(l_quantity) AS b2, avg(l_discount) AS b3 FROM lineitem GROUP BY 1, 2),
c AS (SELECT corr(b1, b2) AS x, corr(b1, b3) AS y, corr(b2, b3) AS z FROM q), p AS (SELECT sqrt((x*x + y*y + z*z) / 3) AS p, x * y * z AS h FROM c),
a AS (SELECT p, acos(least(1, greatest(-1, h / power(p, 3)))) / 3 AS a FROM p)
SELECT k, round((1 + 2 * p * cos(a + CASE k WHEN 1 THEN 0 WHEN 2 THEN 4 ELSE 2 END * pi() / 3)) / 3, 7) AS ratio FROM a, (SELECT unnest([1, 2, 3]) AS k)""",
)


def _mixed(s: SparkSession, d: str) -> DataFrame:
    """Two mixtures of two columns that know nothing of each other."""
    q = fixtures.table(s, d, "lineitem")
    return q.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10 + F.col("l_quantity") / 100).cast("double").alias("b1"), (F.col("l_quantity") / 25 - F.col("l_discount") * 7).cast("double").alias("b2"))


def _ica_sql(rounds: int = 14) -> str:
    """Two bands: whitened along the diagonals, turned by the orthogonal matrix nearest to the moments, from another start."""
    sql = """WITH q AS (SELECT l_orderkey, l_linenumber, CAST(l_discount * 10 + l_quantity / 100 AS DOUBLE) AS b1, CAST(l_quantity / 25 - l_discount * 7 AS DOUBLE) AS b2 FROM lineitem),
m AS (SELECT avg(b1) AS m1, avg(b2) AS m2, stddev_pop(b1) AS s1, stddev_pop(b2) AS s2, corr(b1, b2) AS r FROM q),
x AS MATERIALIZED (SELECT l_orderkey, l_linenumber, r, ((b1 - m1) / s1 + (b2 - m2) / s2) / sqrt(2 * (1 + r)) AS p, ((b1 - m1) / s1 - (b2 - m2) / s2) / sqrt(2 * (1 - r)) AS n FROM q, m),
w0 AS (SELECT cos(0.3) AS a, sin(0.3) AS b, -sin(0.3) AS c, cos(0.3) AS d)"""
    for k in range(rounds):
        sql += f""",
h{k} AS (SELECT avg(g * p) - avg(1 - g * g) * any_value(a) AS a, avg(g * n) - avg(1 - g * g) * any_value(b) AS b, avg(e * p) - avg(1 - e * e) * any_value(c) AS c, avg(e * n) - avg(1 - e * e) * any_value(d) AS d
  FROM (SELECT x.*, w.*, (exp(2 * (a * p + b * n)) - 1) / (exp(2 * (a * p + b * n)) + 1) AS g, (exp(2 * (c * p + d * n)) - 1) / (exp(2 * (c * p + d * n)) + 1) AS e FROM x, w{k} w)),
w{k + 1} AS MATERIALIZED (SELECT CASE WHEN a * d > b * c THEN (a + d) / t ELSE (a - d) / t END AS a, CASE WHEN a * d > b * c THEN (b - c) / t ELSE (b + c) / t END AS b,
  CASE WHEN a * d > b * c THEN (c - b) / t ELSE (b + c) / t END AS c, CASE WHEN a * d > b * c THEN (a + d) / t ELSE (d - a) / t END AS d
  FROM (SELECT *, CASE WHEN a * d > b * c THEN sqrt((a + d) * (a + d) + (b - c) * (b - c)) ELSE sqrt((a - d) * (a - d) + (b + c) * (b + c)) END AS t FROM h{k}))"""
    # Weights over the bands: the component that leans on the first band comes first, its largest weight positive.
    return sql + f""",
f AS (SELECT w.*, a / sqrt(2 * (1 + r)) + b / sqrt(2 * (1 - r)) AS f11, a / sqrt(2 * (1 + r)) - b / sqrt(2 * (1 - r)) AS f12, c / sqrt(2 * (1 + r)) + d / sqrt(2 * (1 - r)) AS f21, c / sqrt(2 * (1 + r)) - d / sqrt(2 * (1 - r)) AS f22 FROM w{rounds} w, m),
y AS (SELECT l_orderkey, l_linenumber, (a * p + b * n) * sign(CASE WHEN abs(f11) >= abs(f12) THEN f11 ELSE f12 END) AS u, (c * p + d * n) * sign(CASE WHEN abs(f21) >= abs(f22) THEN f21 ELSE f22 END) AS v, abs(f11) >= abs(f12) AS lead FROM x, f)
SELECT l_orderkey, l_linenumber, round(CASE WHEN lead THEN u ELSE v END, 4) + 0.0 AS ic1, round(CASE WHEN lead THEN v ELSE u END, 4) + 0.0 AS ic2 FROM y"""


add("ica_scores", lambda s, d: out(stats.independent_components(_mixed(s, d), ["b1", "b2"], tolerance=1e-14)[0], 4, "ic1", "ic2"), _ica_sql())

# --- lines and wavelets ---------------------------------------------------------------------


def _path(s: SparkSession, d: str) -> DataFrame:
    e = fixtures.table(s, d, "orders").where("o_custkey % 10 = 1")
    c = e.select((F.col("o_custkey")).alias("line_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") * 7 % 101).cast("double").alias("x"), (F.col("o_orderkey") * 13 % 89).cast("double").alias("y"))
    p = lines.along_path(c, 7.5)
    return out(p.select("line_id", F.col("k").cast("long").alias("k"), "x", "y"), 6, "x", "y")


add(
    "along_path", _path,
    """WITH c AS (SELECT o_custkey AS line_id, o_orderkey AS seq, CAST(o_orderkey * 7 % 101 AS DOUBLE) AS x, CAST(o_orderkey * 13 % 89 AS DOUBLE) AS y FROM orders WHERE o_custkey % 10 = 1),
g AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM c WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
h AS (SELECT *, sqrt(power(x1 - x, 2) + power(y1 - y, 2)) AS step FROM g), f AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY line_id ORDER BY seq) AS d1 FROM h),
l AS (SELECT line_id, max(d1) AS len FROM f GROUP BY 1), t AS (SELECT line_id, range AS k, range * 7.5 AS d FROM l, range(100000) WHERE range * 7.5 <= len),
m AS (SELECT t.line_id, t.k, arg_min(struct_pack(x := x, y := y, x1 := x1, y1 := y1, step := step, d0 := d1 - coalesce(step, 0)), d1) AS b, t.d FROM t JOIN f ON f.line_id = t.line_id AND f.d1 >= t.d - 1e-12 AND (f.step > 0 OR t.d = 0) GROUP BY 1, 2, 4)
SELECT line_id, k, round(b.x + coalesce((b.x1 - b.x) * (d - b.d0) / nullif(b.step, 0), 0), 6) + 0.0 AS x, round(b.y + coalesce((b.y1 - b.y) * (d - b.d0) / nullif(b.step, 0), 0), 6) + 0.0 AS y FROM m""",
)


def _signals(s: SparkSession, d: str) -> DataFrame:
    return lines.along(fixtures.survey_lines(s, d)).select("line_id", (F.col("pos") - 1).alias("pos"), "v")


_SIG = """pts AS (SELECT user_id AS line_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, value AS v FROM events),
mm AS (SELECT line_id, min(v) AS lo, max(v) AS hi, count(*) AS n FROM pts GROUP BY 1), sg AS (SELECT pts.line_id, pos, (v - lo) / (hi - lo) AS x FROM pts JOIN mm USING (line_id) WHERE hi > lo),
sc AS (SELECT line_id, CAST(k.range AS INTEGER) AS scale_no, power(10, k.range * log10(greatest(n / 4.0, 1)) / 4) AS scale FROM mm, range(5) k WHERE hi > lo),
kk AS (SELECT sc.*, b.pos, sum(a.x * sqrt(scale) * 2 / sqrt(3) / power(pi(), 0.25) * (
  least(8, greatest(-8, (b.pos - a.pos + 0.5) / scale)) * exp(-power(least(8, greatest(-8, (b.pos - a.pos + 0.5) / scale)), 2) / 2) - least(8, greatest(-8, (b.pos - a.pos - 0.5) / scale)) * exp(-power(least(8, greatest(-8, (b.pos - a.pos - 0.5) / scale)), 2) / 2))) AS w
 FROM sc JOIN sg a ON a.line_id = sc.line_id JOIN sg b ON b.line_id = sc.line_id GROUP BY 1, 2, 3, 4)"""
add(
    "wavelet", lambda s, d: out(wavelet.transform(_signals(s, d), 5).select("line_id", "scale_no", "pos", "w"), 6, "w"),
    f"WITH {_SIG} SELECT line_id, scale_no, pos, round(w, 6) + 0.0 AS w FROM kk",
)


def _maxima(s: SparkSession, d: str) -> DataFrame:
    return wavelet.modulus_maxima(wavelet.transform(_signals(s, d), 5), 0.05, 1)


_MAX = f"""{_SIG}, ab AS (SELECT *, abs(w) AS a, max(abs(w)) OVER (PARTITION BY line_id, scale_no) AS top, lag(abs(w)) OVER o AS l, lead(abs(w)) OVER o AS r FROM kk WINDOW o AS (PARTITION BY line_id, scale_no ORDER BY pos)),
mx AS (SELECT line_id, scale_no, scale, pos, a AS value FROM ab WHERE a > coalesce(l, -1) AND a > coalesce(r, -1) AND a > 0.05 * top)"""
add("wavelet_maxima", lambda s, d: out(_maxima(s, d).select("line_id", "scale_no", "pos", "value"), 6, "value"), f"WITH {_MAX} SELECT line_id, scale_no, pos, round(value, 6) AS value FROM mx")
# Peaks closer than three places, from the highest down, the later of equal ones first.
add(
    "wavelet_maxima_apart", lambda s, d: out(wavelet.modulus_maxima(wavelet.transform(_signals(s, d), 5)).select("line_id", "scale_no", "pos", "value"), 6, "value"),
    f"""WITH {_MAX}, kept AS (SELECT line_id, scale_no, unnest(list_reduce(list([pos] ORDER BY value DESC, pos DESC), lambda a, p: CASE WHEN len(list_filter(a, lambda q: abs(q - p[1]) < 3)) > 0 THEN a ELSE list_concat(a, p) END)) AS pos FROM mx GROUP BY 1, 2)
SELECT line_id, scale_no, pos, round(value, 6) AS value FROM mx JOIN kept USING (line_id, scale_no, pos)""",
)


def _chains_sql() -> str:
    """Each scale's maxima nearest to where the chains stand, in one relation per scale."""
    sql = f"""WITH {_MAX}, lv AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY line_id ORDER BY scale_no) AS k FROM mx),
c1 AS (SELECT line_id, pos AS start, pos AS here, 1 AS k, scale FROM lv WHERE scale_no = 0)"""
    for k in range(2, 6):
        sql += f""", n{k} AS (SELECT c.line_id, c.start, arg_min(lv.pos, (abs(lv.pos - c.here), lv.pos)) AS pos FROM c{k - 1} c JOIN lv ON lv.line_id = c.line_id AND lv.k = {k} AND abs(lv.pos - c.here) < 2.0 * lv.scale / c.scale GROUP BY 1, 2),
c{k} AS (SELECT c.line_id, c.start, coalesce(n.pos, c.here) AS here, {k} AS k, coalesce(s.scale, c.scale) AS scale FROM c{k - 1} c LEFT JOIN n{k} n USING (line_id, start) LEFT JOIN (SELECT line_id, any_value(scale) AS scale FROM lv WHERE k = {k} GROUP BY 1) s USING (line_id))"""
    met = " UNION ALL ".join(["SELECT line_id, start, 1 AS k, start AS pos FROM c1", *(f"SELECT line_id, start, {k}, pos FROM n{k}" for k in range(2, 6))])
    return sql + f""", p AS (SELECT *, count(*) OVER (PARTITION BY line_id, start) AS n FROM ({met})), q AS (SELECT *, dense_rank() OVER (PARTITION BY line_id ORDER BY start) - 1 AS chain FROM p WHERE n > 1)
SELECT q.line_id, CAST(chain AS INTEGER) AS chain, lv.scale_no, q.pos, round(lv.value, 6) AS value FROM q JOIN lv ON lv.line_id = q.line_id AND lv.k = q.k AND lv.pos = q.pos"""


add("wavelet_chains", lambda s, d: out(wavelet.chains(_maxima(s, d)).select("line_id", "chain", "scale_no", "pos", "value"), 6, "value"), _chains_sql())
add(
    "singularity_spectrum", lambda s, d: out(wavelet.singularity_spectrum(_maxima(s, d), [-2.0, -1.0, 0.0, 1.0, 2.0]), 5, "tau", "h", "d"),
    f"""WITH {_MAX}, qs AS (SELECT unnest([-2.0, -1.0, 0.0, 1.0, 2.0])::DOUBLE AS q), z AS (SELECT line_id, q, scale_no, ln(sum(power(value, q))) AS z, ln(min(scale)) AS a FROM mx, qs GROUP BY 1, 2, 3),
t AS (SELECT line_id, q, CASE WHEN count(*) > 1 THEN regr_slope(z, a) ELSE 0 END AS tau FROM z GROUP BY 1, 2),
h AS (SELECT *, (coalesce(lead(tau) OVER w, tau) - coalesce(lag(tau) OVER w, tau)) / (coalesce(lead(q) OVER w, q) - coalesce(lag(q) OVER w, q)) AS h FROM t WINDOW w AS (PARTITION BY line_id ORDER BY q)),
d AS (SELECT *, q * h - tau AS d0, max(q * h - tau) OVER (PARTITION BY line_id) AS top FROM h)
SELECT line_id, q, round(tau, 5) + 0.0 AS tau, round(h, 5) + 0.0 AS h, round(CASE WHEN top > 0 THEN d0 / top ELSE d0 END, 5) + 0.0 AS d FROM d""",
)

# --- outlines, streamlines, surfaces ---------------------------------------------------------


def _islands(s: SparkSession, d: str) -> DataFrame:
    return grid(s, d).select("row", "col", F.when(F.col("v") > 50_000, F.col("v")).alias("v"))


_ISLANDS = f"{GRID_SQL}, ok AS (SELECT row, col, row * {N} + col AS id FROM g WHERE v > 50000)"
_REACH = """e AS (SELECT a.id AS a, b.id AS b FROM ok a JOIN ok b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
reach(id, root) AS (SELECT id, id FROM ok UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.id), lab AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""


def _outlines(s: SparkSession, d: str) -> DataFrame:
    """Area of each outlined region and how many holes it has."""
    return outlines.polygons(_islands(s, d)).groupBy("area", "holes").agg(F.count("*").alias("n"))


# Holes of a region: one less its Euler number, which is cells less neighbours plus full squares of four.
add(
    "outline_polygons", _outlines,
    f"""WITH RECURSIVE {_ISLANDS}, {_REACH}, cell AS (SELECT ok.*, root FROM ok JOIN lab USING (id)),
n AS (SELECT c.root, count(*) AS cells, sum(CASE WHEN r.id IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN u.id IS NOT NULL THEN 1 ELSE 0 END) AS pairs, sum(CASE WHEN r.id IS NOT NULL AND u.id IS NOT NULL AND x.id IS NOT NULL THEN 1 ELSE 0 END) AS quads
 FROM cell c LEFT JOIN ok r ON r.row = c.row AND r.col = c.col + 1 LEFT JOIN ok u ON u.row = c.row + 1 AND u.col = c.col LEFT JOIN ok x ON x.row = c.row + 1 AND x.col = c.col + 1 GROUP BY 1)
SELECT CAST(cells AS DOUBLE) AS area, CAST(1 - (cells - pairs + quads) AS BIGINT) AS holes, count(*) AS n FROM n GROUP BY 1, 2""",
)
def _peaks(s: SparkSession, d: str) -> DataFrame:
    """Cells that stand out by two measures; ids are unique over both."""
    g = grid(s, d)
    level = g.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))  # one row
    levels = F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.lit(k).alias("k")) for z, k in ((0, 0.9), (1, 1.2))])).alias("l")
    cells = g.crossJoin(F.broadcast(level)).select("row", "col", "v", "m", "sd", levels).where(F.col("v") > F.col("m") + F.col("l.k") * F.col("sd"))
    return cells.select("l.z", (F.col("l.z") * N * N + F.col("row") * N + F.col("col")).cast("long").alias("id"), "row", "col")


#: Of all links in the order of weight and ids, those whose ends no earlier links connect.
_TREE = f"""{GRID_SQL}, pk AS (SELECT z, CAST(z * {N * N} + row * {N} + col AS BIGINT) AS id, row, col FROM g, (VALUES (0, 0.9), (1, 1.2)) l(z, k) WHERE v > (SELECT avg(v) FROM g) + k * (SELECT stddev_pop(v) FROM g)),
nb AS (SELECT a.id AS x, b.id AS y, (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) AS d, row_number() OVER (PARTITION BY a.id ORDER BY (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col), b.row, b.col) AS k
  FROM pk a JOIN pk b ON a.z = b.z AND a.id <> b.id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
li AS MATERIALIZED (SELECT x, y, d, row_number() OVER (ORDER BY d, x, y) AS o FROM (SELECT DISTINCT least(x, y) AS x, greatest(x, y) AS y, d FROM nb WHERE k <= 2)),
way AS MATERIALIZED (SELECT x AS a, y AS b, o FROM li UNION ALL SELECT y, x, o FROM li),
met(o, id) AS (SELECT o, x FROM li UNION SELECT met.o, way.b FROM met JOIN way ON way.a = met.id AND way.o < met.o),
tree AS MATERIALIZED (SELECT x AS src, y AS dst, sqrt(d) AS weight FROM li WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.o = li.o AND met.id = li.y))"""
add(
    "worm_tree", lambda s, d: out(graph.minimum_spanning_forest(worms.neighbour_links(_peaks(s, d), ["z"])), 7, "weight"),
    f"WITH RECURSIVE {_TREE} SELECT src, dst, round(weight, 7) AS weight FROM tree",
)
add(
    "worm_segments", lambda s, d: worms.edge_segments(_peaks(s, d), ["z"]),
    f"""WITH RECURSIVE {_TREE}, arc AS (SELECT src AS a, dst AS b FROM tree UNION ALL SELECT dst, src FROM tree), deg AS (SELECT a AS id, count(*) AS n FROM arc GROUP BY a),
walk(start, path, prev, id) AS (SELECT a, [a, b], a, b FROM arc JOIN deg ON deg.id = a WHERE n <> 2
  UNION ALL SELECT start, list_append(path, arc.b), walk.id, arc.b FROM walk JOIN deg ON deg.id = walk.id AND deg.n = 2 JOIN arc ON arc.a = walk.id AND arc.b <> walk.prev)
SELECT start || '-' || id AS segment, CAST(generate_subscripts(path, 1) - 1 AS BIGINT) AS seq, unnest(path) AS id FROM walk JOIN deg USING (id) WHERE n <> 2 AND start < id""",
)
add(
    "outline_corners", lambda s, d: outlines.rings(_islands(s, d)).groupBy("row", "col").agg((F.sum(F.when(F.col("seq") > 0, 1).otherwise(0))).alias("n")),
    f"""WITH {_ISLANDS}, side AS (SELECT row + dr AS row, col + dc AS col FROM ok CROSS JOIN (VALUES (-1, 0, 0, 0), (0, 1, 0, 1), (1, 0, 1, 1), (0, -1, 1, 0)) w(nr, nc, dr, dc) WHERE NOT EXISTS (SELECT 1 FROM ok o WHERE o.row = ok.row + nr AND o.col = ok.col + nc))
SELECT row, col, count(*) AS n FROM side GROUP BY 1, 2""",
)
# Walks from every side that could be its ring's smallest; those that meet a smaller one on the way are given up.
add(
    "outline_wkt", lambda s, d: outlines.polygons(_islands(s, d), 100.0, 50.0, 2.0, -1.5),
    f"""WITH RECURSIVE {_ISLANDS}, {_REACH},
side AS MATERIALIZED (SELECT (row + dr) * 1000 + (col + dc) * 4 + d AS id, row + dr AS r, col + dc AS c, row + er AS r1, col + ec AS c1, d, root
  FROM ok JOIN lab USING (id) CROSS JOIN (VALUES (-1, 0, 0, 0, 0, 1, 0), (0, 1, 0, 1, 1, 1, 1), (1, 0, 1, 1, 1, 0, 2), (0, -1, 1, 0, 0, 0, 3)) w(nr, nc, dr, dc, er, ec, d)
  WHERE NOT EXISTS (SELECT 1 FROM ok o WHERE o.row = ok.row + nr AND o.col = ok.col + nc)),
nxt AS MATERIALIZED (SELECT a.id, arg_min(b.id, CASE WHEN b.d = (a.d + 1) % 4 THEN 0 ELSE 1 END) AS to_ FROM side a JOIN side b ON b.r = a.r1 AND b.c = a.c1 GROUP BY a.id),
walk(start, seq, id, home) AS (SELECT id, 0, id, false FROM side WHERE d < 2 UNION ALL SELECT start, seq + 1, to_, to_ = start FROM walk JOIN nxt USING (id) WHERE NOT home AND to_ >= start),
ring AS (SELECT w.start, string_agg(CAST(100.0 + c * 2.0 AS DOUBLE) || ' ' || CAST(50.0 - r * 1.5 AS DOUBLE), ', ' ORDER BY seq) AS text, any_value(root) AS root, sum(c * r1 - c1 * r) FILTER (WHERE NOT home) < 0 AS hole
  FROM walk w JOIN side ON side.id = w.id WHERE w.start IN (SELECT start FROM walk WHERE home) GROUP BY 1),
size_ AS (SELECT root, count(*) AS n FROM lab GROUP BY 1), poly AS (SELECT root, min(start) FILTER (WHERE NOT hole) AS place, count(*) - 1 AS holes, string_agg('(' || text || ')', ', ' ORDER BY hole, start) AS text FROM ring GROUP BY 1)
SELECT row_number() OVER (ORDER BY place) AS id, 'Multipolygon boundary' AS type, CAST(n AS DOUBLE) AS area, holes, 'POLYGON (' || text || ')' AS wkt FROM poly JOIN size_ USING (root)""",
)
add("streamline_length", lambda s, d: out(streamlines.streamline_length(focal.anisotropy(grid(s, d), N, N), N, N, most=40)))


def _spline_sql(levels: int = 4) -> str:
    """Level by level: control values from the points' residuals, then heights of points and cells."""
    basis = lambda k, u: f"(CASE {k} WHEN 0 THEN power(1 - {u}, 3) WHEN 1 THEN 3 * power({u}, 3) - 6 * {u} * {u} + 4 WHEN 2 THEN 3 * {u} * {u} + 3 * {u} + 1 - 3 * power({u}, 3) ELSE power({u}, 3) END / 6)"
    sql = f"""WITH {CELLS}, r0 AS (SELECT row_number() OVER (ORDER BY x, y) AS id, x / {N} AS s, y / {N} AS t, z FROM (SELECT CAST(p_partkey % 50 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, avg(p_retailprice) AS z FROM part GROUP BY 1, 2)),
a0 AS (SELECT row, col, (col + 0.5) / {N} AS s, (row + 0.5) / {N} AS t, 0.0 AS v FROM cells), k4(m, n) AS (SELECT a.range, b.range FROM range(4) a, range(4) b)"""
    for k in range(levels):
        n = 2 << k
        cut = lambda source, keep: f"SELECT {keep}, CAST(least(floor(s * {n}), {n - 1}) AS INTEGER) AS i, CAST(least(floor(t * {n}), {n - 1}) AS INTEGER) AS j, s, t FROM {source}"  # noqa: B023, E731
        around = lambda source, keep: f"SELECT {keep}, i + m AS a, j + n AS b, {basis('m', f'(s * {n} - i)')} * {basis('n', f'(t * {n} - j)')} AS w FROM ({source}), k4"  # noqa: B023, E731
        sql += f""", q{k} AS MATERIALIZED ({around(cut(f'r{k}', 'id, z'), 'id, z, s, t')}),
f{k} AS MATERIALIZED (SELECT a, b, sum(w * w * w * z / total) / sum(w * w) AS phi FROM (SELECT *, sum(w * w) OVER (PARTITION BY id) AS total FROM q{k} WHERE s BETWEEN 0 AND 1 AND t BETWEEN 0 AND 1) GROUP BY 1, 2),
r{k + 1} AS MATERIALIZED (SELECT id, s, t, z - coalesce(h, 0) AS z FROM r{k} LEFT JOIN (SELECT id, sum(w * phi) AS h FROM q{k} JOIN f{k} USING (a, b) GROUP BY 1) USING (id)),
g{k} AS ({around(cut(f'a{k}', 'row, col'), 'row, col')}),
a{k + 1} AS MATERIALIZED (SELECT row, col, s, t, v + coalesce(h, 0) AS v FROM a{k} LEFT JOIN (SELECT row, col, sum(w * phi) AS h FROM g{k} JOIN f{k} USING (a, b) GROUP BY 1, 2) USING (row, col))"""
    return sql + f" SELECT row, col, round(v, 4) + 0.0 AS v FROM a{levels}"


add("b_spline", lambda s, d: out(surfaces.b_spline(fixtures.stations(s, d), N, N, 4), 4), _spline_sql())
# The same with every lattice joined by place.
add("b_spline_joined", lambda s, d: out(surfaces.b_spline(fixtures.stations(s, d), N, N, 3, dense=0), 4), _spline_sql(3))
add(
    "hull_mask", lambda s, d: surfaces.hull_mask(fixtures.stations(s, d).where("x + y BETWEEN 20 AND 70 AND y < x + 25"), N, N),
    f"WITH {CELLS}, p AS (SELECT DISTINCT CAST(p_partkey % 50 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y FROM part WHERE p_partkey % 50 + p_size BETWEEN 20 AND 70 AND p_size < p_partkey % 50 + 25), w AS (SELECT cos(2 * pi() * range / 7200) AS c, sin(2 * pi() * range / 7200) AS s FROM range(7200)),"
    " far AS (SELECT c, s, max(x * c + y * s) AS d FROM p, w GROUP BY c, s) SELECT row, col, bool_and((col + 0.5) * c + (row + 0.5) * s <= d + 1e-9) AS inside FROM cells, far GROUP BY row, col",
)
