"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.functions import scalar
from gridloom.operators import crossings, euler, focal, graph, lines, quantiles, spectral, stats, surfaces, terrain
from gridloom.plans.registry import CELLS as _CELLS, GRID_SQL, N, ORACLES, QUERIES, add as _add, grid as _grid, out as _out, rounded as _rounded
from gridloom.plans import formats, frames, poles, survey  # noqa: F401  they register their queries
from gridloom.sources import fixtures

# --- windows -------------------------------------------------------------------------------

_EDGE_SQL = {
    "none": "{i}",
    "symmetric": f"CASE WHEN {{i}} < 0 THEN -1 - {{i}} WHEN {{i}} >= {N} THEN {2 * N - 1} - {{i}} ELSE {{i}} END",
    "wrap": f"(({{i}}) + {N}) % {N}",
    "edge": f"least(greatest({{i}}, 0), {N - 1})",
}


def square_sql(h: int, columns: str = "1.0 AS w", where: str = "true") -> str:
    """Relation ``o(dr, dc, ..)`` of the places within ``h`` of a cell."""
    return f"SELECT dr, dc, {columns} FROM (SELECT CAST(a.range AS INTEGER) - {h} AS dr, CAST(b.range AS INTEGER) - {h} AS dc FROM range({2 * h + 1}) a, range({2 * h + 1}) b) WHERE {where}"


def window_sql(o: str, edge: str, select: str, source: str = "g") -> str:
    """Gather form: every cell joins the cells its window ``o`` asks for."""
    r, c = _EDGE_SQL[edge].format(i="(c.row + o.dr)"), _EDGE_SQL[edge].format(i="(c.col + o.dc)")
    return f"""WITH {GRID_SQL}, o AS ({o}), hit AS (SELECT c.row, c.col, o.*, s.v FROM cells c CROSS JOIN o JOIN {source} s ON s.row = {r} AND s.col = {c})
SELECT row, col, {select} FROM hit GROUP BY row, col"""


_CONV = "CASE WHEN sum(CASE WHEN v IS NOT NULL THEN w END) <> 0 THEN sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END) END AS v"
for size in (3, 5):
    _add(f"focal_mean_{size}x{size}", lambda s, d, n=size: _out(focal.mean_filter(_grid(s, d), n, N, N)), _rounded(window_sql(square_sql(size // 2), "symmetric", _CONV)))
_add("focal_gaussian_s1", lambda s, d: _out(focal.gaussian_filter(_grid(s, d), 1.0, N, N)), _rounded(window_sql(square_sql(2, "exp(-(dr * dr + dc * dc) / 2.0) AS w"), "symmetric", _CONV)))
_add("focal_median_3x3", lambda s, d: _out(focal.median_filter(_grid(s, d), 3, N, N), 9), _rounded(window_sql(square_sql(1), "none", "quantile_cont(v, 0.5) AS v"), 9))
#: What a compass kernel weighs the neighbour at (dr, dc) with, once the convolution has turned it.
_COMPASS_SQL = {
    "n": "-dr", "s": "dr", "e": "-dc", "w": "dc", "ne": "sign(dc - dr)", "nw": "-sign(dr + dc)", "se": "sign(dr - dc)", "sw": "sign(dr + dc)",
}
for way, w in _COMPASS_SQL.items():
    _add(
        f"dir_{way}", lambda s, d, w=way.upper(): _out(focal.directional(_grid(s, d), w, N, N)),
        _rounded(window_sql(square_sql(1, f"{w} AS w"), "symmetric", "CASE WHEN count(v) = count(*) THEN sum(w * v) END AS v")),
    )
_STATS = {
    "min": "min(v)", "max": "max(v)", "mean": "avg(v)", "median": "quantile_cont(v, 0.5)", "variance": "var_pop(v)", "std": "stddev_pop(v)",
    "skewness": "(avg(v*v*v) - 3*avg(v)*avg(v*v) + 2*avg(v)*avg(v)*avg(v)) / nullif(power(var_pop(v), 1.5), 0)", "kurtosis": "kurtosis_pop(v)",
}
for stat, sql in _STATS.items():
    digits = 6 if stat in ("skewness", "kurtosis") else 4 if stat == "variance" else 7
    _add(
        f"ss_{stat}", lambda s, d, st=stat, k=digits: _out(focal.windowed_stat(_grid(s, d), st, 5, N, N), k),
        _rounded(window_sql(square_sql(2, where="dr * dr + dc * dc <= 4"), "none", f"CASE WHEN count(v) >= 3 AND max(CASE WHEN dr = 0 AND dc = 0 THEN v END) IS NOT NULL THEN {sql} END AS v"), digits),
    )

# Altitude 45 and azimuth 315 degrees: the light's parts are 1/2, 1/2 and the root of 1/2.
_add(
    "sun_simple", lambda s, d: _out(focal.sun_simple(_grid(s, d), N, N), 6),
    "SELECT row, col, round(CASE WHEN n = 4 THEN (dx / 2 - dy / 2 + sqrt(0.5)) / sqrt(dx*dx + dy*dy + 1) END, 6) + 0.0 AS v FROM ("
    + window_sql(square_sql(1, where="abs(dr) + abs(dc) = 1"), "wrap", "sum(dc * v) / 2 AS dx, sum(dr * v) / 2 AS dy, count(v) AS n") + ")",
)
# The difference kernels turned by the convolution: east minus west, and south minus north, both halves of the published formula.
_add(
    "relief_grass", lambda s, d: _out(focal.relief(_grid(s, d), N, N), 4),
    """SELECT row, col, round(CASE WHEN n = 9 THEN 255 * (0.5 * sin(sl) + sqrt(0.75) * cos(sl) * cos(2 * pi() - asp)) END, 4) + 0.0 AS v FROM (
SELECT row, col, n, pi() / 2 - atan(sqrt(dx*dx + dy*dy)) AS sl, CASE WHEN dx = 0 AND dy = 0 THEN pi() / 180 ELSE atan2(dy, dx) END AS asp FROM ("""
    + window_sql(square_sql(1), "edge", "sum(dc * (2 - abs(dr)) * v) / 4 AS dx, sum(dr * (2 - abs(dc)) * v) / 4 AS dy, count(v) AS n") + "))",
)
_sym = lambda i: _EDGE_SQL["symmetric"].format(i=i)


def aniso_sql(smooth: str) -> str:
    """Saliency and orientation; ``smooth`` weighs the place (dr, dc) within nine of the cell."""
    return f"""{GRID_SQL}, so AS ({square_sql(1)}), bo AS ({square_sql(5, f"{smooth} AS w", f"{smooth} > 0")}),
gr AS (SELECT c.row, c.col, sum(dc * (2 - abs(dr)) * coalesce(s.v, 0)) AS gx, sum(dr * (2 - abs(dc)) * coalesce(s.v, 0)) AS gy FROM cells c CROSS JOIN so JOIN g s ON s.row = {_sym('(c.row + so.dr)')} AND s.col = {_sym('(c.col + so.dc)')} GROUP BY 1, 2),
j AS (SELECT c.row, c.col, sum(w * gx * gx) / sum(w) AS xx, sum(w * gy * gy) / sum(w) AS yy, sum(w * gx * gy) / sum(w) AS xy FROM cells c CROSS JOIN bo JOIN gr s ON s.row = {_sym('(c.row + bo.dr)')} AND s.col = {_sym('(c.col + bo.dc)')} GROUP BY 1, 2),
sal AS (SELECT row, col, sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) AS s, ((degrees(atan2(2 * xy, xx - yy) / 2) % 180) + 180) % 180 AS o FROM j),
an AS (SELECT sal.row, sal.col, CASE WHEN g.v IS NOT NULL THEN least(1.0, s / ((SELECT quantile_cont(s, 0.99) FROM sal) + 1e-10)) END AS magnitude, CASE WHEN g.v IS NOT NULL THEN o END AS orientation FROM sal JOIN g ON g.row = sal.row AND g.col = sal.col)"""


_BOX_SQL = "(CASE WHEN abs(dr) <= 3 AND abs(dc) <= 3 THEN 1 ELSE 0 END)"
#: Window 7: a deviation of 7/6, cut off after 4 deviations, at 5 cells.
_BELL_SQL = "exp(-(dr * dr + dc * dc) * 18.0 / 49)"
ANISO_SQL = aniso_sql(_BOX_SQL)
for shape, smooth in (("box", _BOX_SQL), ("gaussian", _BELL_SQL)):
    tail = "" if shape == "box" else "_gaussian"
    _add(
        f"aniso_mag{tail}", lambda s, d, k=shape: _out(focal.anisotropy(_grid(s, d), N, N, 7, k).select("row", "col", F.col("magnitude").alias("v")), 6),
        f"WITH {aniso_sql(smooth)} SELECT row, col, round(magnitude, 6) + 0.0 AS v FROM an",
    )
    _add(
        f"aniso_orient{tail}", lambda s, d, k=shape: _out(focal.anisotropy(_grid(s, d), N, N, 7, k).select("row", "col", F.col("orientation").alias("v")), 4),
        f"WITH {aniso_sql(smooth)} SELECT row, col, round(orientation, 4) + 0.0 AS v FROM an",
    )


def _chain(s: SparkSession, d: str, threshold: float = 0.75, tolerance: float = 15.0) -> DataFrame:
    an = focal.anisotropy(_grid(s, d), N, N, 7, "box").where(F.col("magnitude") >= threshold).select("row", "col", "orientation")
    near = scalar.angle_between_axes(F.col("a.orientation"), F.col("b.orientation")) <= tolerance
    return graph.grid_components(an, graph.disk_offsets(2), near).select("row", "col", F.col("size").cast("long").alias("size"))


_add(
    "chain_length", _chain,
    f"""WITH RECURSIVE {ANISO_SQL}, act AS (SELECT row, col, row * {N} + col AS id, orientation AS o FROM an WHERE magnitude >= 0.75),
e AS (SELECT a.id AS x, b.id AS y FROM act a JOIN act b ON (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) BETWEEN 1 AND 4
  AND least(abs(a.o - b.o) % 180, 180 - abs(a.o - b.o) % 180) <= 15.0),
reach(id, root) AS (SELECT id, id FROM act UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.id),
lab AS (SELECT id, min(root) AS root FROM reach GROUP BY id), n AS (SELECT root, count(*) AS size FROM lab GROUP BY root)
SELECT row, col, size FROM act JOIN lab USING (id) JOIN n USING (root)""",
)


def _regions(s: SparkSession, d: str) -> DataFrame:
    """8-connected regions of cells above the grid's third quartile, with their shape."""
    g = _grid(s, d)
    cut = quantiles.quantiles(g, "v", [0.75])[0]
    found = graph.grid_components(g.where(F.col("v") >= cut).select("row", "col"), [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)])
    shape = found.groupBy("component").agg(F.count("*").alias("area"), F.var_pop("row").alias("vr"), F.var_pop("col").alias("vc"), F.covar_pop("row", "col").alias("cov"))
    label = (F.floor(F.col("component") / (1 << 31)) * N + F.col("component") % (1 << 31)).cast("long")
    return _out(shape.select(label.alias("label"), "area", "vr", "vc", "cov"), 6, "vr", "vc", "cov")


_add(
    "components_8", _regions,
    f"""WITH RECURSIVE {GRID_SQL}, act AS (SELECT row, col, row * {N} + col AS id FROM g WHERE v >= (SELECT quantile_cont(v, 0.75) FROM g)),
e AS (SELECT a.id AS x, b.id AS y FROM act a JOIN act b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.id <> b.id),
reach(id, root) AS (SELECT id, id FROM act UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.id),
lab AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT CAST(root AS BIGINT) AS label, count(*) AS area, round(var_pop(row), 6) + 0.0 AS vr, round(var_pop(col), 6) + 0.0 AS vc, round(covar_pop(row, col), 6) + 0.0 AS cov FROM act JOIN lab USING (id) GROUP BY root""",
)

FILL_SQL = """near AS (SELECT h.row, h.col, arg_min(s.v, (h.row - s.row) * (h.row - s.row) + (h.col - s.col) * (h.col - s.col) + s.row / 1e4 + s.col / 1e7) AS v
  FROM g h, g s WHERE h.v IS NULL AND s.v IS NOT NULL GROUP BY 1, 2),
filled AS (SELECT row, col, v FROM g WHERE v IS NOT NULL UNION ALL SELECT row, col, v FROM near)"""
_add("nn_fill", lambda s, d: _out(focal.fill_nearest(_grid(s, d), N, N)), f"WITH {GRID_SQL}, {FILL_SQL} " + _rounded("SELECT * FROM filled"))

# --- scalars -------------------------------------------------------------------------------

_LIMITS = {"above": (40000.0, None), "below": (None, 36000.0), "between": (40000.0, 36000.0)}
for cond, (hi, lo) in _LIMITS.items():
    bad = {"above": f"v > {hi}", "below": f"v < {lo}", "between": f"v > {lo} AND v < {hi}"}[cond]
    _add(
        f"threshold_{cond}", lambda s, d, c=cond, a=hi, b=lo: _out(_grid(s, d).select("row", "col", scalar.threshold(F.col("v"), c, a, b).alias("v"))),
        _rounded(f"WITH {GRID_SQL} SELECT row, col, CASE WHEN NOT ({bad}) THEN v END AS v FROM g"),
    )
_add(
    "decimal_year", lambda s, d: fixtures.table(s, d, "orders").select("o_orderkey", F.round(scalar.decimal_year(F.to_date("o_orderdate")), 6).alias("y")),
    "SELECT o_orderkey, round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / dayofyear(make_date(year(o_orderdate), 12, 31)), 6) AS y FROM orders",
)
_LAT = "((c_custkey * 37) % 181 - 90)"


def _customers(s: SparkSession, d: str) -> DataFrame:
    return fixtures.table(s, d, "customer").select("c_custkey", F.expr(_LAT).cast("double").alias("lat"), "c_acctbal")


def _arc(s: SparkSession, d: str) -> DataFrame:
    m = scalar.metres_per_degree(F.col("lat"))
    return _customers(s, d).select("c_custkey", (F.round(m["dx"], 4) + 0.0).alias("dx"), (F.round(m["dy"], 4) + 0.0).alias("dy"))


_add(
    "arc_degree", _arc,
    f"SELECT c_custkey, round(pi() / 180 * 6371000 * cos(radians({_LAT})), 4) + 0.0 AS dx, round(pi() / 180 * 6371000 * sqrt(1 - 0.00669438 * sin(radians({_LAT})) * sin(radians({_LAT}))), 4) + 0.0 AS dy FROM customer",
)


def _geocentric(s: SparkSession, d: str) -> DataFrame:
    g = scalar.geodetic_to_geocentric(F.col("c_acctbal") / 1000, 90 - F.col("lat"))
    return _customers(s, d).select("c_custkey", (F.round(g["radius"], 6) + 0.0).alias("radius"), (F.round(g["colatitude"], 6) + 0.0).alias("colatitude"))


_add(
    "geodetic_to_geocentric", _geocentric,
    f"""WITH a AS (SELECT c_custkey, c_acctbal / 1000 AS h, cos(radians(90.0 - {_LAT})) AS c, sin(radians(90.0 - {_LAT})) AS s, 6378.137 * 6378.137 AS a2, 6356.752314245 * 6356.752314245 AS b2 FROM customer),
b AS (SELECT *, sqrt(CAST(a2 AS DOUBLE) * s * s + CAST(b2 AS DOUBLE) * c * c) AS rho FROM a),
r AS (SELECT *, sqrt(h * (h + 2 * rho) + (CAST(a2 AS DOUBLE) * a2 * s * s + CAST(b2 AS DOUBLE) * b2 * c * c) / (rho * rho)) AS radius FROM b)
SELECT c_custkey, round(radius, 6) + 0.0 AS radius, round(degrees(acos(c * (h + rho) / radius - s * ((a2 - b2) / rho * c * s / radius))), 6) + 0.0 AS colatitude FROM r""",
)


def _dhif(s: SparkSession, d: str) -> DataFrame:
    f = scalar.field_components(F.col("l_extendedprice"), F.col("l_quantity") * 1000 - 25000, F.col("l_discount") * 1e5)
    return fixtures.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *[(F.round(c, 5) + 0.0).alias(k) for k, c in f.items()])


_add(
    "dhif", _dhif,
    """WITH q AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_quantity * 1000 - 25000 AS y, l_discount * 1e5 AS z FROM lineitem)
SELECT l_orderkey, l_linenumber, round(degrees(atan2(y, x)), 5) + 0.0 AS d, round(sqrt(x*x + y*y), 5) + 0.0 AS h, round(degrees(atan2(z, sqrt(x*x + y*y))), 5) + 0.0 AS i, round(sqrt(x*x + y*y + z*z), 5) + 0.0 AS f FROM q""",
)
_add(
    "misorientation", lambda s, d: fixtures.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(scalar.angle_between_axes(F.col("l_quantity") * 7, F.col("l_tax") * 2000), 6).alias("v")),
    "SELECT l_orderkey, l_linenumber, round(least(abs(l_quantity * 7 - l_tax * 2000) % 180, 180 - abs(l_quantity * 7 - l_tax * 2000) % 180), 6) AS v FROM lineitem",
)

# --- trends and statistics -----------------------------------------------------------------

_PLANE = """m AS (SELECT {by} avg(col) AS mc, avg(row) AS mr, avg(v) AS mv, var_pop(col) AS cc, var_pop(row) AS rr, covar_pop(col, row) AS cr, covar_pop(col, v) AS cv, covar_pop(row, v) AS rv FROM {src} WHERE v IS NOT NULL {grp}),
flat AS (SELECT {src}.*, {src}.v - mv - (cv * rr - rv * cr) / (cc * rr - cr * cr) * (col - mc) - (rv * cc - cv * cr) / (cc * rr - cr * cr) * (row - mr) AS d FROM {src}, m {on})"""
_add("detrend_plane", lambda s, d: _out(stats.detrend_plane(_grid(s, d)), 3), f"WITH {GRID_SQL}, {_PLANE.format(by='', src='g', grp='', on='')} SELECT row, col, round(d, 3) + 0.0 AS v FROM flat")
_add(
    "normalise_grids", lambda s, d: _out(stats.normalise_grids(fixtures.grid_set(s, d, N)), 3),
    f"""WITH gs AS (SELECT l_linenumber AS grid_id, CAST(l_partkey % {N} AS INTEGER) AS row, CAST(l_orderkey % {N} AS INTEGER) AS col, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3),
{_PLANE.format(by='grid_id,', src='gs', grp='GROUP BY grid_id', on='WHERE gs.grid_id = m.grid_id')}, s AS (SELECT grid_id, avg(d) AS a, stddev_pop(d) AS sd FROM flat GROUP BY 1 HAVING stddev_pop(d) > 0)
SELECT flat.grid_id, row, col, round((SELECT arg_min(sd, grid_id) FROM s) * (d - a) / sd, 3) + 0.0 AS v FROM flat JOIN s ON s.grid_id = flat.grid_id""",
)
_add(
    "grid_summary", lambda s, d: _out(stats.summary(_grid(s, d)), 4, "mean", "std", "least", "most", "median"),
    f"WITH {GRID_SQL} SELECT count(v) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(min(v), 4) AS least, round(max(v), 4) AS most, round(quantile_cont(v, 0.5), 4) AS median FROM g",
)


def _estimates(s: SparkSession, d: str) -> DataFrame:
    q = fixtures.table(s, d, "lineitem")
    return q.select(F.col("l_linenumber").alias("si"), (F.col("l_partkey") % 1000).cast("double").alias("y"), (F.col("l_orderkey") % 1000).cast("double").alias("x"), F.col("l_extendedprice").alias("z"), F.col("l_quantity").alias("base"))


_EST = "est AS (SELECT l_linenumber AS si, CAST(l_partkey % 1000 AS DOUBLE) AS y, CAST(l_orderkey % 1000 AS DOUBLE) AS x, l_extendedprice AS z, l_quantity AS base FROM lineitem)"
_WIN = f"""{_EST}, ws AS (SELECT si, CAST(floor(y / 250) AS INTEGER) AS window_row, CAST(floor(x / 250) AS INTEGER) AS window_col, count(*) AS n_estimates, avg(y) AS mean_y, avg(x) AS mean_x, avg(z / 1000) AS mean_depth_km,
avg(base) AS mean_base_level, stddev_pop(y) AS std_y, stddev_pop(x) AS std_x, stddev_pop(z / 1000) AS std_depth_km, min(z / 1000) AS min_depth_km, max(z / 1000) AS max_depth_km FROM est GROUP BY 1, 2, 3)"""
_WCOLS = ("mean_y", "mean_x", "mean_depth_km", "mean_base_level", "std_y", "std_x", "std_depth_km", "min_depth_km", "max_depth_km")
_add(
    "euler_window_stats", lambda s, d: _out(stats.window_stats(_estimates(s, d), 0, 0, 250, 250), 5, *_WCOLS),
    f"WITH {_WIN} " + _rounded("SELECT * FROM ws", 5, "si, window_row, window_col, n_estimates", _WCOLS),
)
_add(
    "euler_summary", lambda s, d: _out(stats.window_summary(stats.window_stats(_estimates(s, d), 0, 0, 250, 250)), 5, "mean_depth_km", "std_depth_km"),
    f"WITH {_WIN} SELECT si, count(*) AS windows_with_data, CAST(sum(n_estimates) AS BIGINT) AS total_estimates, round(avg(mean_depth_km), 5) + 0.0 AS mean_depth_km, round(stddev_pop(mean_depth_km), 5) + 0.0 AS std_depth_km FROM ws GROUP BY si",
)


def _bands(s: SparkSession, d: str) -> DataFrame:
    q = fixtures.table(s, d, "lineitem").groupBy((F.col("l_partkey") % N).cast("int").alias("row"), (F.col("l_orderkey") % N).cast("int").alias("col"))
    return q.agg(F.avg("l_extendedprice").alias("b1"), F.avg("l_quantity").alias("b2"), F.avg("l_discount").alias("b3"))


_add("pca_scores", lambda s, d: _out(stats.principal_components(_bands(s, d), ["b1", "b2", "b3"])[0], 5, "pc1", "pc2", "pc3"))
_add(
    "band_correlation", lambda s, d: _bands(s, d).agg(*[F.round(F.corr(a, b), 8).alias(f"{a}_{b}") for a, b in (("b1", "b2"), ("b1", "b3"), ("b2", "b3"))]),
    f"WITH q AS (SELECT l_partkey % {N} AS row, l_orderkey % {N} AS col, avg(l_extendedprice) AS b1, avg(l_quantity) AS b2, avg(l_discount) AS b3 FROM lineitem GROUP BY 1, 2) SELECT round(corr(b1, b2), 8) AS b1_b2, round(corr(b1, b3), 8) AS b1_b3, round(corr(b2, b3), 8) AS b2_b3 FROM q",
)

# --- lines ---------------------------------------------------------------------------------

_LINES = """pts AS (SELECT user_id AS line_id, event_id AS seq, epoch_us(ts) / 1e6 AS x, CAST(user_id AS DOUBLE) AS y, value AS v FROM events),
al AS (SELECT *, row_number() OVER w AS pos, coalesce(x - lag(x) OVER w, 0) AS step FROM pts WINDOW w AS (PARTITION BY line_id ORDER BY x, seq)),
ds AS (SELECT *, sum(step) OVER (PARTITION BY line_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS dist FROM al)"""
_add(
    "line_distance", lambda s, d: lines.along(fixtures.survey_lines(s, d)).select("line_id", "seq", F.col("pos").cast("long").alias("pos"), F.round("dist", 3).alias("dist")),
    f"WITH {_LINES} SELECT line_id, seq, pos, round(dist, 3) AS dist FROM ds",
)
_add(
    "line_regularise", lambda s, d: lines.regularise(fixtures.survey_lines(s, d), 3600.0).select("line_id", "k", F.round("d", 2).alias("d"), (F.round("v", 3) + 0.0).alias("v")),
    f"""WITH {_LINES}, n AS (SELECT line_id, max(dist) AS len, CAST(floor(max(dist) / 3600.0) AS INTEGER) + 1 AS n FROM ds GROUP BY 1),
t AS (SELECT line_id, CAST(k.range AS INTEGER) AS k, k.range * len / (n - 1) AS d FROM n, range(100000) k WHERE n > 1 AND len > 0 AND k.range < n),
b AS (SELECT t.line_id, t.k, t.d, a.dist AS d0, a.v AS v0 FROM t ASOF JOIN ds a ON a.line_id = t.line_id AND a.dist <= t.d),
c AS (SELECT b.*, lead_.dist AS d1, lead_.v AS v1 FROM b LEFT JOIN (SELECT line_id, dist AS d0, lead(dist) OVER w AS dist, lead(v) OVER w AS v FROM ds WINDOW w AS (PARTITION BY line_id ORDER BY pos)) lead_ ON lead_.line_id = b.line_id AND lead_.d0 = b.d0)
SELECT line_id, k, round(d, 2) AS d, round(CASE WHEN d1 > d0 THEN v0 + (v1 - v0) * (d - d0) / (d1 - d0) ELSE v0 END, 3) + 0.0 AS v FROM c""",
)
_add(
    "local_maxima_1d", lambda s, d: lines.local_maxima(fixtures.survey_lines(s, d)).select("line_id", F.col("pos").cast("long").alias("pos"), "v"),
    f"WITH {_LINES}, nb AS (SELECT line_id, pos, v, lag(v) OVER w AS a, lead(v) OVER w AS b, max(v) OVER (PARTITION BY line_id) AS top FROM ds WINDOW w AS (PARTITION BY line_id ORDER BY pos)) SELECT line_id, pos, v FROM nb WHERE v > a AND v > b AND v > 0.05 * top",
)

# --- spectral ------------------------------------------------------------------------------


def _tukey_sql(i: str) -> str:
    x = f"({i} / {N - 1}.0)"
    return f"(CASE WHEN {x} < 0.25 THEN 0.5 * (1 + cos(4 * pi() * ({x} - 0.25))) WHEN {x} >= 0.75 THEN 0.5 * (1 + cos(4 * pi() * ({x} - 0.75))) ELSE 1.0 END)"


def dft_sql(responses: dict[str, tuple[str, str]], final: str) -> str:
    """Separable discrete Fourier transform, filter and inverse; ``t(tag, row, col, v)`` feeds ``final``."""
    forms = " UNION ALL ".join(f"SELECT '{t}' AS tag, u, w, re, im, {re} AS hr, {im} AS hi FROM kk" for t, (re, im) in responses.items())
    ang = lambda a, b: f"2 * pi() * (({a} * {b}) % {N}) / {N}"
    return f"""WITH {GRID_SQL}, {FILL_SQL}, med AS (SELECT quantile_cont(v, 0.5) AS m FROM g), f AS (SELECT CAST(range AS INTEGER) AS i FROM range({N})),
x AS (SELECT row, col, (v - m) * {_tukey_sql('row')} * {_tukey_sql('col')} AS x FROM filled, med),
a AS (SELECT row, i AS w, sum(x * cos({ang('col', 'i')})) AS re, -sum(x * sin({ang('col', 'i')})) AS im FROM x, f GROUP BY 1, 2),
s AS (SELECT i AS u, w, sum(re * cos({ang('row', 'i')}) + im * sin({ang('row', 'i')})) AS re, sum(im * cos({ang('row', 'i')}) - re * sin({ang('row', 'i')})) AS im FROM a, f GROUP BY 1, 2),
k0 AS (SELECT *, 2 * pi() * (CASE WHEN w < {N // 2} THEN w ELSE w - {N} END) / {N} AS kx, -2 * pi() * (CASE WHEN u < {N // 2} THEN u ELSE u - {N} END) / {N} AS ky FROM s),
kk AS (SELECT *, sqrt(kx * kx + ky * ky) AS k FROM k0), hh AS ({forms}),
z AS (SELECT tag, u, w, re * hr - im * hi AS re, re * hi + im * hr AS im FROM hh),
b AS (SELECT tag, i AS row, w, sum(re * cos({ang('u', 'i')}) - im * sin({ang('u', 'i')})) / {N} AS re, sum(im * cos({ang('u', 'i')}) + re * sin({ang('u', 'i')})) / {N} AS im FROM z, f GROUP BY 1, 2, 3),
t AS (SELECT tag, row, i AS col, sum(re * cos({ang('w', 'i')}) - im * sin({ang('w', 'i')})) / {N} AS v FROM b, f GROUP BY 1, 2, 3)
{final}"""


_ONE = "SELECT t.row, t.col, round(CASE WHEN g.v IS NOT NULL THEN t.v{level} END, {digits}) + 0.0 AS v FROM t JOIN g ON g.row = t.row AND g.col = t.col, med"


def _taper_sql(short: float, long: float) -> str:
    """Place within the taper that reaches from the longer to the shorter wavelength, 0..1."""
    return f"((k - 2 * pi() / {long}) / (2 * pi() / {short} - 2 * pi() / {long}))"


_BUTTER_SQL = "(CASE WHEN k = 0 THEN 0 ELSE 1 / (1 + power(2 * pi() / {long} / k, 8)) / (1 + power(k * {short} / (2 * pi()), 8)) END)"
#: Angle between the wave and an azimuth in degrees, wrapped to +-pi.
_OFF_SQL = "atan2(sin(atan2(ky, kx) - radians({az})), cos(atan2(ky, kx) - radians({az})))"
_DIRECTED_SQL = "(" + _BUTTER_SQL + " * CASE WHEN abs(" + _OFF_SQL + ") <= radians({width}) THEN power(cos(pi() * " + _OFF_SQL + " / (2 * radians({width}))), 2) ELSE 0 END)"
# Inclination -60: the field term is a + ib with a = -sin(60) k and b = cos(60) (sin 5 kx + cos 5 ky).
_POLE_SQL = "(-sin(radians(60)) * (k + 1e-10))", "(cos(radians(60)) * (sin(radians(5)) * kx + cos(radians(5)) * ky))"
_EQ_C = "cos(radians(5) - atan2(kx, ky))"
_EQ_DEN = f"(0.75 + 0.25 * {_EQ_C} * {_EQ_C} * 0.75 + 0.25 * {_EQ_C} * {_EQ_C} + 1e-10)"
_LONG, _SHORT = _taper_sql(14.0, 18.0), _taper_sql(3.5, 4.5)
#: Real and imaginary part of each response, and whether the level comes back.
_FILTERS: dict[str, tuple[spectral.Response, tuple[str, str], bool]] = {
    "upward": (spectral.upward(2.0), ("exp(-2 * k)", "0"), True),
    "downward": (spectral.downward(0.5), ("exp(k / 2)", "0"), True),
    "vint": (spectral.vertical_integration(), ("1 / greatest(k, 0.0001)", "0"), True),
    "vint_capped": (spectral.vertical_integration(0.3, 2.0), ("1 / least(greatest(k, 0.3), 2.0)", "0"), True),
    "dx1": (spectral.derivative("x"), ("0", "kx"), False),
    "dy1": (spectral.derivative("y"), ("0", "ky"), False),
    "dz1": (spectral.derivative("z"), ("k", "0"), False),
    "dx2": (spectral.derivative("x", 2.0), ("-kx * kx", "0"), False),
    "dz_frac": (spectral.derivative("z", 0.5), ("sqrt(k)", "0"), False),
    "lowpass": (spectral.low_pass(8.0, 4.0), (f"CASE WHEN k <= 2 * pi() / 10 THEN 1 WHEN k >= 2 * pi() / 6 THEN 0 ELSE 0.5 * (1 + cos(pi() * {_taper_sql(6.0, 10.0)})) END", "0"), True),
    "lowpass_sharp": (spectral.low_pass(8.0), ("CASE WHEN k <= 2 * pi() / 8.0 THEN 1 ELSE 0 END", "0"), True),
    "highpass": (spectral.high_pass(12.0, 6.0), (f"CASE WHEN k <= 2 * pi() / 15 THEN 0 WHEN k >= 2 * pi() / 9 THEN 1 ELSE 0.5 * (1 - cos(pi() * {_taper_sql(9.0, 15.0)})) END", "0"), True),
    "bandpass": (
        spectral.band_pass(16.0, 4.0, 4.0, 1.0),
        (f"CASE WHEN k > 2 * pi() / 4.5 AND k <= 2 * pi() / 3.5 THEN 0.5 * (1 + cos(pi() * {_SHORT})) WHEN k >= 2 * pi() / 18 AND k < 2 * pi() / 14 THEN 0.5 * (1 - cos(pi() * {_LONG})) WHEN k >= 2 * pi() / 14 AND k <= 2 * pi() / 4.5 THEN 1 ELSE 0 END", "0"), True,
    ),
    # A taper of 10 around 4 passes wavelength 0: its upper edge falls back to 1.5 times the cut-off's wavenumber; 4 - 10 < 0.001 moves the cut-off by 0.001.
    "bandpass_wide": (
        spectral.band_pass(16.0, 4.0, 4.0, 10.0),
        (f"CASE WHEN k > 2 * pi() / 9.001 AND k <= 3 * pi() / 4.001 THEN 0.5 * (1 + cos(pi() * (k - 2 * pi() / 9.001) / (3 * pi() / 4.001 - 2 * pi() / 9.001))) WHEN k >= 2 * pi() / 18 AND k < 2 * pi() / 14 THEN 0.5 * (1 - cos(pi() * {_LONG})) WHEN k >= 2 * pi() / 14 AND k <= 2 * pi() / 9.001 THEN 1 ELSE 0 END", "0"), True,
    ),
    "bandpass_sharp": (spectral.sharp_band(16.5, 4.5), ("CASE WHEN k >= 2 * pi() / 16.5 AND k <= 2 * pi() / 4.5 THEN 1 ELSE 0 END", "0"), True),
    "butterworth": (spectral.butterworth(16.0, 4.0), (_BUTTER_SQL.format(long=16.0, short=4.0), "0"), True),
    "dir_butterworth": (spectral.directional_butterworth(16.0, 4.0, 30.0, 25.0), (_DIRECTED_SQL.format(long=16.0, short=4.0, az=30, width=25), "0"), True),
    "dir_cosine": (spectral.directional_cosine(30.0, 2.0), ("power(cos(atan2(ky, kx) - radians(30)), 2)", "0"), True),
    "rtp": (
        spectral.reduction_to_pole(-60.0, 5.0),
        tuple(f"(k * k * {top} / power({a} * {a} + {b} * {b}, 2))" for a, b in [_POLE_SQL] for top in (f"({a} * {a} - {b} * {b})", f"(-2 * {a} * {b})")), True,
    ),
    "rte": (
        spectral.reduction_to_equator(-60.0, 5.0),
        (f"(-(0.75 - 0.25 * {_EQ_C} * {_EQ_C}) * {_EQ_C} * {_EQ_C} / {_EQ_DEN})", f"(-sqrt(0.75) * {_EQ_C} * {_EQ_C} * {_EQ_C} / {_EQ_DEN})"), True,
    ),
}
for name, (response, forms, level) in _FILTERS.items():
    _add(
        name, lambda s, d, r=response, k=level: _out(spectral.Spectrum(_grid(s, d), N, N).apply(r, k), 3),
        dft_sql({"x": forms}, _ONE.format(level=" + med.m" if level else "", digits=3)),
    )
_GRADIENT_SQL = {"dx": ("0", "kx"), "dy": ("0", "ky"), "dz": ("k", "0")}


def _combined(expr: str, digits: int) -> str:
    return dft_sql(_GRADIENT_SQL, f"""SELECT g.row, g.col, round(CASE WHEN g.v IS NOT NULL THEN {expr} END, {digits}) + 0.0 AS v FROM
(SELECT row, col, max(CASE WHEN tag = 'dx' THEN v END) AS dx, max(CASE WHEN tag = 'dy' THEN v END) AS dy, max(CASE WHEN tag = 'dz' THEN v END) AS dz FROM t GROUP BY 1, 2) q JOIN g ON g.row = q.row AND g.col = q.col""")


_add("thg", lambda s, d: _out(spectral.total_horizontal_gradient(spectral.Spectrum(_grid(s, d), N, N)), 3), _combined("sqrt(dx*dx + dy*dy)", 3))
_add("analytic_signal", lambda s, d: _out(spectral.analytic_signal(spectral.Spectrum(_grid(s, d), N, N)), 3), _combined("sqrt(dx*dx + dy*dy + dz*dz)", 3))
_add("tilt_degrees", lambda s, d: _out(spectral.tilt_angle(spectral.Spectrum(_grid(s, d), N, N), True), 4), _combined("degrees(atan2(dz, sqrt(dx*dx + dy*dy)))", 4))
_add("tilt", lambda s, d: _out(spectral.tilt_angle(spectral.Spectrum(_grid(s, d), N, N)), 5), _combined("atan2(dz, sqrt(dx*dx + dy*dy))", 5))
_add(
    "dir_clean", lambda s, d: _out(spectral.directional_clean(spectral.Spectrum(_grid(s, d), N, N), 8.0, 30.0, 0.5), 3),
    dft_sql({"x": (_DIRECTED_SQL.format(long=8.0, short=1e-8, az=30, width=20), "0")}, "SELECT t.row, t.col, round(g.v - 0.5 * (t.v + med.m), 3) + 0.0 AS v FROM t JOIN g ON g.row = t.row AND g.col = t.col, med"),
)
_add(
    "radial_spectrum", lambda s, d: spectral.radial_power(_grid(s, d), N, N).select("ring", F.round("k", 8).alias("k"), F.round("log_power", 5).alias("log_power")),
    f"""WITH {GRID_SQL}, f AS (SELECT CAST(range AS INTEGER) AS i FROM range({N})),
a AS (SELECT row, i AS w, sum(coalesce(v, 0) * cos(2 * pi() * ((col * i) % {N}) / {N})) AS re, -sum(coalesce(v, 0) * sin(2 * pi() * ((col * i) % {N}) / {N})) AS im FROM g, f GROUP BY 1, 2),
s AS (SELECT i AS u, w, sum(re * cos(2 * pi() * ((row * i) % {N}) / {N}) + im * sin(2 * pi() * ((row * i) % {N}) / {N})) AS re, sum(im * cos(2 * pi() * ((row * i) % {N}) / {N}) - re * sin(2 * pi() * ((row * i) % {N}) / {N})) AS im FROM a, f GROUP BY 1, 2),
q AS (SELECT re * re + im * im AS p, CAST(ceil(sqrt(power(CASE WHEN w < {N // 2} THEN w ELSE w - {N} END, 2) + power(CASE WHEN u < {N // 2} THEN u ELSE u - {N} END, 2)) - 0.5) AS INTEGER) AS ring FROM s)
SELECT ring, round(ring * 2 * pi() / {N}, 8) AS k, round(ln(avg(p)), 5) AS log_power FROM q WHERE ring <= {(N - 1) // 2} GROUP BY ring""",
)


# --- thresholds, crossings, sampling, depth estimates --------------------------------------

_add(
    "blank_between", lambda s, d: _out(crossings.blank(_grid(s, d), "between", above=50_000.0, below=45_000.0)),
    _rounded(f"WITH {GRID_SQL} SELECT row, col, CASE WHEN v > 45000 AND v < 50000 THEN NULL ELSE v END AS v FROM g"),
)


def _crossings(s: SparkSession, d: str) -> DataFrame:
    level = _grid(s, d).select("row", "col", (F.col("v") - 48_000.0).alias("v"))
    return _out(crossings.zero_crossings(level, N, N), 6, "x", "y")


_add(
    "zero_crossings", _crossings,
    f"""WITH {GRID_SQL}, f AS (SELECT row, col, v - 48000.0 AS v FROM g),
s AS (SELECT a.row, a.col, 0 AS axis, a.v / nullif(a.v - b.v, 0) AS s FROM f a JOIN f b ON b.row = a.row AND b.col = (a.col + 1) % {N}
UNION ALL SELECT a.row, a.col, 1, a.v / nullif(a.v - b.v, 0) FROM f a JOIN f b ON b.col = a.col AND b.row = (a.row + 1) % {N}),
xy AS (SELECT col + CASE WHEN axis = 0 THEN s ELSE 0 END AS x, row + CASE WHEN axis = 1 THEN s ELSE 0 END AS y, row, col, axis FROM s WHERE s BETWEEN 0 AND 1)
SELECT round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, row, col, axis FROM xy WHERE x < {N} AND y < {N}""",
)


def _sampled(s: SparkSession, d: str) -> DataFrame:
    points = fixtures.table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 500 / 10.0).alias("x"), F.col("p_size").cast("double").alias("y"))
    return _out(crossings.sample(_grid(s, d), points))


_add(
    "sample_points", _sampled,
    f"""WITH {GRID_SQL}, pt AS (SELECT p_partkey, p_partkey % 500 / 10.0 AS x, CAST(p_size AS DOUBLE) AS y FROM part)
SELECT p_partkey, x, y, round(g.v, 7) + 0.0 AS v FROM pt LEFT JOIN g ON g.row = floor(y) AND g.col = floor(x)""",
)


#: Edge values out to 64 cells, transformed without taper; ``d(row, col, v, dx, dy, dz)`` are the field and its derivatives.
_E = 64
_eang = lambda a, b: f"2 * pi() * (({a} * {b}) % {_E}) / {_E}"
_efreq = lambda i: f"2 * pi() * (CASE WHEN {i} < {_E // 2} THEN {i} ELSE {i} - {_E} END) / {_E}"
DERIVATIVE_SQL = f"""{GRID_SQL}, {FILL_SQL}, i AS (SELECT CAST(range AS INTEGER) AS i FROM range({_E})),
x AS (SELECT r.i AS row, c.i AS col, s.v AS x FROM i r, i c, filled s WHERE s.row = least(greatest(r.i - 8, 0), {N - 1}) AND s.col = least(greatest(c.i - 8, 0), {N - 1})),
a1 AS (SELECT row, i AS w, sum(x * cos({_eang('col', 'i')})) AS re, -sum(x * sin({_eang('col', 'i')})) AS im FROM x, i GROUP BY 1, 2),
s AS (SELECT i AS u, w, sum(re * cos({_eang('row', 'i')}) + im * sin({_eang('row', 'i')})) AS re, sum(im * cos({_eang('row', 'i')}) - re * sin({_eang('row', 'i')})) AS im FROM a1, i GROUP BY 1, 2),
z AS (SELECT 'dx' AS tag, u, w, -im * {_efreq('w')} AS re, re * {_efreq('w')} AS im FROM s UNION ALL SELECT 'dy', u, w, -im * {_efreq('u')}, re * {_efreq('u')} FROM s
 UNION ALL SELECT 'dz', u, w, re * sqrt(power({_efreq('w')}, 2) + power({_efreq('u')}, 2)), im * sqrt(power({_efreq('w')}, 2) + power({_efreq('u')}, 2)) FROM s),
b AS (SELECT tag, i AS row, w, sum(re * cos({_eang('u', 'i')}) - im * sin({_eang('u', 'i')})) / {_E} AS re, sum(im * cos({_eang('u', 'i')}) + re * sin({_eang('u', 'i')})) / {_E} AS im FROM z, i GROUP BY 1, 2, 3),
t AS (SELECT tag, row - 8 AS row, i - 8 AS col, sum(re * cos({_eang('w', 'i')}) - im * sin({_eang('w', 'i')})) / {_E} AS v FROM b, i GROUP BY 1, 2, 3),
d AS (SELECT f.row, f.col, any_value(f.v) AS v, max(CASE WHEN tag = 'dx' THEN t.v END) AS dx, max(CASE WHEN tag = 'dy' THEN t.v END) AS dy, max(CASE WHEN tag = 'dz' THEN t.v END) AS dz FROM filled f JOIN t ON t.row = f.row AND t.col = f.col GROUP BY 1, 2)"""


def _filled(s: SparkSession, d: str) -> DataFrame:
    return focal.fill_nearest(_grid(s, d), N, N)


# The small shift keeps means of a few prices away from the middle between two roundings.
_add(
    "euler_derivatives", lambda s, d: _out(_out(euler.derivatives(_filled(s, d), N, N).withColumn("v", F.col("v") + 1.3e-6), 4, "v"), 3, "dx", "dy", "dz"),
    f"WITH {DERIVATIVE_SQL} SELECT row, col, round(v + 1.3e-6, 4) + 0.0 AS v, round(dx, 3) + 0.0 AS dx, round(dy, 3) + 0.0 AS dy, round(dz, 3) + 0.0 AS dz FROM d",
)


def _det(rows: list[list[str]]) -> str:
    """Determinant as SQL, along the first row."""
    if len(rows) == 1:
        return rows[0][0]
    return "(" + " ".join(f"{'-' if k % 2 else '+'} {x} * {_det([r[:k] + r[k + 1:] for r in rows[1:]])}" for k, x in enumerate(rows[0])) + ")"


_LEFT = [["aa", "ab", "ac", "k * a"], ["ab", "bb", "bc", "k * b"], ["ac", "bc", "cc", "k * c"], ["k * a", "k * b", "k * c", "k * k * 49"]]
_LEFT = [[f"({x})" for x in row] for row in _LEFT]
_RIGHT = ["(fa + k * va)", "(fb + k * vb)", "(fc + k * vc)", "(k * (f + k * v))"]
_SOLVED = [_det([row[:j] + [y] + row[j + 1:] for row, y in zip(_LEFT, _RIGHT)]) for j in range(4)]


def _depths(s: SparkSession, d: str) -> DataFrame:
    """The tenth of all windows with the most varied vertical derivative, for three structural indices."""
    field = euler.derivatives(_filled(s, d), N, N)
    found = euler.keep_most_varied(euler.deconvolve(field, [1.0, 2.0, 3.0], 7, N, N), 0.1)
    return _out(found.withColumn("base", F.round("base", 0) + 0.0), 2, "x", "y", "z", "stdz")


_add(
    "euler_deconvolution", _depths,
    f"""WITH {DERIVATIVE_SQL}, o AS (SELECT CAST(a.range AS INTEGER) AS p, CAST(b.range AS INTEGER) AS q FROM range(7) a, range(7) b), si AS (SELECT unnest([1.0, 2.0, 3.0])::DOUBLE AS k),
h AS (SELECT d.row - p AS r0, d.col - q AS c0, d.v, dx AS a, dy AS b, dz AS c, dx * q + dy * p AS f FROM d, o WHERE d.row - p BETWEEN 0 AND {N - 7} AND d.col - q BETWEEN 0 AND {N - 7}),
w AS (SELECT r0, c0, sum(a*a) AS aa, sum(a*b) AS ab, sum(a*c) AS ac, sum(a) AS a, sum(b*b) AS bb, sum(b*c) AS bc, sum(b) AS b, sum(c*c) AS cc, sum(c) AS c, sum(f*a) AS fa, sum(f*b) AS fb, sum(f*c) AS fc, sum(f) AS f,
 sum(v*a) AS va, sum(v*b) AS vb, sum(v*c) AS vc, sum(v) AS v, stddev_samp(c) AS stdz FROM h GROUP BY 1, 2),
e AS (SELECT k AS si, r0 AS row, c0 AS col, {_det(_LEFT)} AS det, {', '.join(f'{x} AS p{j}' for j, x in enumerate(_SOLVED))}, stdz FROM w, si),
n AS (SELECT *, row_number() OVER (PARTITION BY si ORDER BY stdz DESC, row, col) AS k, count(*) OVER (PARTITION BY si) AS n FROM e)
SELECT si, row, col, round(p0 / det + col, 2) + 0.0 AS x, round(p1 / det + row, 2) + 0.0 AS y, round(p2 / det, 2) + 0.0 AS z, round(p3 / det, 0) + 0.0 AS base, round(stdz, 2) + 0.0 AS stdz FROM n WHERE k <= floor(n * 0.1)""",
)


# --- gain control, terrain, gridding, colours, outlines ------------------------------------

_PAD = 6


def _mirror_sql(i: str) -> str:
    """Index within the grid of a place up to the Gaussian's reach outside the mirrored grid."""
    j = f"(CASE WHEN {i} < {-_PAD} THEN {-2 * _PAD - 1} - {i} WHEN {i} >= {N + _PAD} THEN {2 * (N + _PAD) - 1} - {i} ELSE {i} END)"
    return f"(CASE WHEN {j} < 0 THEN -{j} WHEN {j} >= {N} THEN {2 * (N - 1)} - {j} ELSE {j} END)"


#: Deviation 2, cut off at 8 cells.
_BELL = "SELECT d, exp(-d * d / 8.0) / sum(exp(-d * d / 8.0)) OVER () AS w FROM (SELECT CAST(range AS INTEGER) - 8 AS d FROM range(17))"
_add(
    "agc", lambda s, d: _out(terrain.gain_control(_grid(s, d), 2.0, N, N)),
    f"""WITH {GRID_SQL}, {FILL_SQL}, o AS ({_BELL}),
a AS (SELECT c.row, c.col, sum(w * abs(s.v)) AS v FROM cells c CROSS JOIN o JOIN filled s ON s.row = c.row AND s.col = {_mirror_sql('(c.col + o.d)')} GROUP BY 1, 2),
b AS (SELECT c.row, c.col, sum(w * s.v) AS v FROM cells c CROSS JOIN o JOIN a s ON s.col = c.col AND s.row = {_mirror_sql('(c.row + o.d)')} GROUP BY 1, 2)
SELECT g.row, g.col, round(g.v / b.v, 7) + 0.0 AS v FROM g JOIN b ON b.row = g.row AND b.col = g.col""",
)


def _heights(s: SparkSession, d: str) -> DataFrame:
    """The price grid in units that make slopes of every kind; few holes, as each hides its surroundings."""
    v = F.when(~((F.col("row") % 16 == 5) & (F.col("col") % 16 == 9)), F.col("v") / 8000)
    return focal.fill_nearest(_grid(s, d, False), N, N).select("row", "col", v.alias("v"))


def _sum_sql(name: str, source: str, values: str, select: str, on: str) -> str:
    return f"{name} AS (SELECT c.row, c.col, {select} FROM cells c CROSS JOIN ({values}) o JOIN {source} s ON {on} GROUP BY 1, 2)"


#: Deviation 1, cut off at 4 cells.
_BELL1 = "SELECT {0} AS dr, {1} AS dc, exp(-d * d / 2.0) / sum(exp(-d * d / 2.0)) OVER () AS w, 0.0 AS w1 FROM (SELECT CAST(range AS INTEGER) - 4 AS d FROM range(9))"
#: Along over the squared distance, turned by the convolution; the absolute weights 1/2 and 1 sum to 4.
_ODD = square_sql(1, "CASE WHEN dc = 0 THEN 0 ELSE -dc / (dr * dr + dc * dc) / 4.0 END AS w, CASE WHEN dr = 0 THEN 0 ELSE -dr / (dr * dr + dc * dc) / 4.0 END AS w1")
_SYM_ON = f"s.row = {_EDGE_SQL['symmetric'].format(i='(c.row + o.dr)')} AND s.col = {_EDGE_SQL['symmetric'].format(i='(c.col + o.dc)')}"
_WHOLE = "CASE WHEN count(s.v) = 9 THEN sum(w * s.v) END AS v"
_DIFF = "({a} - {b}) / nullif((CASE WHEN lead({i}) OVER w{i} IS NULL THEN 0 ELSE 1 END) + (CASE WHEN lag({i}) OVER w{i} IS NULL THEN 0 ELSE 1 END), 0)"


def _diff_sql(v: str, i: str) -> str:
    ahead, behind = (f"(CASE WHEN {f}({i}) OVER w{i} IS NULL THEN {v} ELSE {f}({v}) OVER w{i} END)" for f in ("lead", "lag"))
    return _DIFF.format(a=ahead, b=behind, i=i)


TERRAIN_SQL = f"""{GRID_SQL},
fn AS (SELECT h.row, h.col, arg_min(s.v, (h.row - s.row) * (h.row - s.row) + (h.col - s.col) * (h.col - s.col) + s.row / 1e4 + s.col / 1e7) AS v FROM full_ h, full_ s WHERE h.v IS NULL AND s.v IS NOT NULL GROUP BY 1, 2),
ff AS (SELECT row, col, v FROM full_ WHERE v IS NOT NULL UNION ALL SELECT row, col, v FROM fn),
h AS (SELECT row, col, CASE WHEN NOT (row % 16 = 5 AND col % 16 = 9) THEN v / 8000 END AS v FROM ff),
{_sum_sql('s1', 'h', _BELL1.format('0', 'd'), _WHOLE, _SYM_ON)},
{_sum_sql('s2', 's1', _BELL1.format('d', '0'), _WHOLE, _SYM_ON)},
{_sum_sql('d0', 's2', _ODD, 'CASE WHEN count(s.v) = count(*) THEN sum(w * s.v) END AS dx, CASE WHEN count(s.v) = count(*) THEN sum(w1 * s.v) END AS dy', 's.row = c.row + o.dr AND s.col = c.col + o.dc')},
d1 AS (SELECT row, col, dx, dy, {_diff_sql('dx', 'row')} AS dxx, {_diff_sql('dx', 'col')} AS dxy, {_diff_sql('dy', 'col')} AS dyy FROM d0 WINDOW wrow AS (PARTITION BY col ORDER BY row), wcol AS (PARTITION BY row ORDER BY col)),
sc AS (SELECT row, col, degrees(atan(sqrt(dx*dx + dy*dy))) AS slope, (dx*dx*dxx + 2*dx*dy*dxy + dy*dy*dyy) / (CASE WHEN dx*dx + dy*dy > 0 THEN dx*dx + dy*dy ELSE power(2.0, -52) END * sqrt(power(dx*dx + dy*dy + 1, 3))) AS curvature FROM d1)"""
_add(
    "slope_curvature", lambda s, d: _out(terrain.slope_curvature(_heights(s, d), N, N), 5, "slope", "curvature"),
    f"WITH {TERRAIN_SQL} SELECT row, col, round(slope, 5) + 0.0 AS slope, round(curvature, 5) + 0.0 AS curvature FROM sc",
)
_add(
    "dtm_class", lambda s, d: terrain.classify(_heights(s, d), N, N),
    f"""WITH RECURSIVE {TERRAIN_SQL}, act AS (SELECT row, col, row * {N} + col AS id FROM sc WHERE slope >= 45.0),
e AS (SELECT a.id AS x, b.id AS y FROM act a JOIN act b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.id <> b.id),
reach(id, root) AS (SELECT id, id FROM act UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.id),
lab AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
sh AS (SELECT root, count(*) AS area, var_pop(row) AS r, var_pop(col) AS c, covar_pop(row, col) AS rc FROM act JOIN lab USING (id) GROUP BY root),
ax AS (SELECT root, area, (r + c) / 2 + sqrt(power((r - c) / 2, 2) + rc * rc) AS major, greatest((r + c) / 2 - sqrt(power((r - c) / 2, 2) + rc * rc), 0) AS minor FROM sh),
lin AS (SELECT act.row, act.col FROM act JOIN lab USING (id) JOIN ax USING (root) WHERE area >= 5 AND major > 0 AND (sqrt(1 - minor / major) > 0.8 OR major > 9 * minor))
SELECT h.row, h.col, CAST(CASE WHEN h.v IS NULL THEN -15 WHEN CASE WHEN (SELECT count(*) FROM lin) > 0 THEN lin.row IS NOT NULL ELSE coalesce(slope >= 45.0, false) END THEN 2
WHEN curvature > 0.01 THEN -1 WHEN curvature < -0.01 THEN 1 ELSE 0 END AS INTEGER) AS v FROM h JOIN sc ON sc.row = h.row AND sc.col = h.col LEFT JOIN lin ON lin.row = h.row AND lin.col = h.col""",
)
_add(
    "idw_grid", lambda s, d: _out(surfaces.inverse_distance(fixtures.stations(s, d), N, N, 3.0), 9),
    f"""WITH {_CELLS}, pt AS (SELECT CAST(p_partkey % 50 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, avg(p_retailprice) AS z FROM part GROUP BY 1, 2),
h AS (SELECT row, col, z, sqrt(power(x - col - 0.5, 2) + power(y - row - 0.5, 2)) AS d FROM cells, pt WHERE abs(x - col - 0.5) <= 3 AND abs(y - row - 0.5) <= 3)
SELECT row, col, round(coalesce(avg(CASE WHEN d = 0 THEN z END), sum(CASE WHEN d > 0 THEN z / (d * d) END) / sum(CASE WHEN d > 0 THEN 1 / (d * d) END)), 9) + 0.0 AS v, count(*) AS n FROM h WHERE d <= 3 GROUP BY row, col""",
)
_RAMP = surfaces.colour_ramp([(0, 0, 255), (0, 255, 255), (255, 255, 0), (255, 0, 0)], 128)
_RGB = "CAST(l_quantity * 5 % 256 AS INTEGER) AS r, CAST(l_partkey * 3 % 256 AS INTEGER) AS g, CAST(l_suppkey * 17 % 256 AS INTEGER) AS b"
_add(
    "rgb_to_scalar",
    lambda s, d: _out(surfaces.colour_to_scalar(fixtures.table(s, d, "lineitem").selectExpr("l_orderkey AS row", "l_linenumber AS col", *_RGB.split(", ")), _RAMP, 10.0, 90.0)),
    f"""WITH px AS (SELECT l_orderkey AS row, l_linenumber AS col, {_RGB} FROM lineitem), t AS (SELECT CAST(range AS INTEGER) AS k, range * 3 / 127.0 AS t FROM range(128)),
lut AS (SELECT k, CAST(floor(255 * least(1, greatest(0, t - 1)) + 1e-9) AS INTEGER) AS r, CAST(floor(255 * CASE WHEN t <= 1 THEN t WHEN t <= 2 THEN 1 ELSE 3 - t END + 1e-9) AS INTEGER) AS g, CAST(floor(255 * least(1, greatest(0, 2 - t)) + 1e-9) AS INTEGER) AS b FROM t),
u AS (SELECT DISTINCT r, g, b FROM px WHERE NOT (r = g AND g = b AND r IN (0, 255))),
n AS (SELECT u.r, u.g, u.b, min(((u.r - lut.r) * (u.r - lut.r) + (u.g - lut.g) * (u.g - lut.g) + (u.b - lut.b) * (u.b - lut.b)) * 1000 + k) % 1000 AS k FROM u, lut GROUP BY 1, 2, 3)
SELECT row, col, round(10.0 + n.k * (80.0 / 127), 7) + 0.0 AS v FROM px LEFT JOIN n ON n.r = px.r AND n.g = px.g AND n.b = px.b""",
)
_add(
    "boundary_edges", lambda s, d: surfaces.boundary_edges(_grid(s, d)),
    f"""WITH {GRID_SQL}, ok AS (SELECT row, col FROM g WHERE v IS NOT NULL),
n(dr, dc, er, ec, axis) AS (VALUES (-1, 0, 0, 0, 0), (1, 0, 1, 0, 0), (0, -1, 0, 0, 1), (0, 1, 0, 1, 1))
SELECT ok.row + er AS row, ok.col + ec AS col, axis FROM ok CROSS JOIN n LEFT JOIN ok b ON b.row = ok.row + dr AND b.col = ok.col + dc WHERE b.row IS NULL""",
)
_add(
    "point_trend", lambda s, d: _out(surfaces.point_trend(fixtures.stations(s, d), 1)[0], 5, "z", "trend", "residual"),
    """WITH pt AS (SELECT CAST(p_partkey % 50 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, avg(p_retailprice) AS z FROM part GROUP BY 1, 2),
m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM pt),
t AS (SELECT x, y, z, mz + (xz * yy - yz * xy) / (xx * yy - xy * xy) * (x - mx) + (yz * xx - xz * xy) / (xx * yy - xy * xy) * (y - my) AS trend FROM pt, m)
SELECT x, y, round(z, 5) + 0.0 AS z, round(trend, 5) + 0.0 AS trend, round(z - trend, 5) + 0.0 AS residual FROM t""",
)


from gridloom.plans import ridges  # noqa: E402, F401  its queries need the transform above
