"""What an affine placement ``x0, dx, row-x, y0, col-y, dy`` (an array column) says about its grid."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def at(transform: Column, col: Column, row: Column) -> Column:
    """``(x, y)`` of a place given in columns and rows from the grid's first corner."""
    return F.struct((transform[0] + col * transform[1] + row * transform[2]).alias("x"), (transform[3] + col * transform[4] + row * transform[5]).alias("y"))


def cell_size(transform: Column) -> Column:
    """``(dx, dy)``: lengths of a cell's sides, to seven digits."""
    return F.struct(F.round(F.hypot(transform[1], transform[4]), 7).alias("dx"), F.round(F.hypot(transform[2], transform[5]), 7).alias("dy"))


def rotation(transform: Column) -> Column:
    """Degrees as the definition gives them, by the hyperbolic tangent of the ratio of the row's steps; 0 without a step."""
    return F.when(transform[5] == 0, 0.0).otherwise(F.degrees(F.tanh(transform[2] / transform[5])))


def centre(transform: Column, ncols: Column, nrows: Column) -> Column:
    return at(transform, ncols / 2, nrows / 2)


def control_points(transform: Column, ncols: Column, nrows: Column) -> Column:
    """Array of ``(id, col, row, x, y)`` of the corners: down the first column's side, then down the last one's."""
    zero = F.lit(0)
    point = lambda k, c, r: F.struct(F.lit(k).alias("id"), c.cast("double").alias("col"), r.cast("double").alias("row"), at(transform, c, r)["x"].alias("x"), at(transform, c, r)["y"].alias("y"))
    return F.array(*[point(k, c, r) for k, (c, r) in enumerate(((zero, zero), (zero, nrows), (ncols, zero), (ncols, nrows)))])


def extent(transform: Column, ncols: Column, nrows: Column) -> Column:
    """``(west, south, east, north)`` of the four corners."""
    points = control_points(transform, ncols, nrows)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))
