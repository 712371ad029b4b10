"""Exact order statistics of whole columns without a buffer that grows with the data.

Values are counted in buckets of their range; only the buckets that hold a wanted rank are cut
further, each between its own least and greatest value, until one holds a single value or few
enough to be read whole.  A round is one aggregation of at most ``BUCKETS`` groups per wanted
rank, combined before the shuffle, and most columns need two.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 4096
#: Values of one bucket that are read whole.
FEW = 4096


def _bucket(value: Column, low: float, high: float) -> Column:
    """0..BUCKETS-1 in the order of the values; a quarter of each keeps differences finite."""
    if math.isinf(low) or math.isinf(high):  # the infinite ones apart, all others between
        return F.when(value == float("-inf"), 0).when(value == float("inf"), BUCKETS - 1).otherwise(BUCKETS // 2)
    share = (value / 4 - low / 4) / F.lit(high / 4 - low / 4)
    return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The value at each rank (from 0) among the values of ``column`` that are neither NULL nor NaN."""
    values = df.select(F.col(column).cast("double").alias("q_")).where(F.col("q_").isNotNull() & ~F.isnan("q_"))
    whole = values.agg(F.count("*").alias("n"), F.min("q_").alias("low"), F.max("q_").alias("high")).first()
    return _select(values, [(whole.low, whole.high, whole.n, sorted({r for r in ranks if 0 <= r < whole.n}))])


def _select(values: DataFrame, parts: list[tuple[float, float, int, list[int]]]) -> dict[int, float]:
    """``parts`` are ``(least, greatest, number of values, ranks within)``, ranks counted from the part's first value."""
    found: dict[int, float] = {}
    shift: dict[tuple[int, int], int] = {}  # (part, rank within) -> rank asked for
    for k, (_, _, _, ranks) in enumerate(parts):
        shift |= {(k, r): r for r in ranks}
    while shift:
        for k, (low, high, _, ranks) in enumerate(parts):
            if low == high:
                found |= {shift.pop((k, r)): low for r in ranks}
        few = [k for k, (_, _, n, ranks) in enumerate(parts) if n <= FEW and any((k, r) in shift for r in ranks)]
        if few:
            inside = F.coalesce(*[F.when(F.col("q_").between(parts[k][0], parts[k][1]), k) for k in few])
            rows: dict[int, list[float]] = {k: [] for k in few}
            for r in values.select(inside.alias("k"), "q_").where("k IS NOT NULL").collect():  # at most FEW a part
                rows[r.k].append(r.q_)
            for k in few:
                rows[k].sort()
                found |= {shift.pop((k, r)): rows[k][r] for r in parts[k][3]}
        open_ = [k for k, (*_, ranks) in enumerate(parts) if any((k, r) in shift for r in ranks)]
        if not open_:
            break
        part = F.coalesce(*[F.when(F.col("q_").between(parts[k][0], parts[k][1]), k) for k in open_])
        bucket = F.coalesce(*[F.when(F.col("k") == k, _bucket(F.col("q_"), parts[k][0], parts[k][1])) for k in open_])
        counts = values.select(part.alias("k"), "q_").where("k IS NOT NULL").groupBy("k", bucket.alias("b")).agg(F.count("*").alias("n"), F.min("q_").alias("low"), F.max("q_").alias("high"))
        cut: dict[int, list] = {k: [] for k in open_}
        for r in counts.collect():  # at most BUCKETS rows a part
            cut[r.k].append((r.b, r.low, r.high, r.n))
        new, moved = [], {}
        for k in open_:
            before = 0
            for _, low, high, n in sorted(cut[k]):
                mine = [r for r in parts[k][3] if before <= r < before + n]
                if mine:
                    moved |= {(len(new), r - before): shift[k, r] for r in mine}
                    new.append((low, high, n, [r - before for r in mine]))
                before += n
        parts, shift = new, moved
    return found


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Each share's value with the places between two ranks interpolated; None without values."""
    n = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    if not n:
        return [None] * len(shares)
    at = [q * (n - 1) for q in shares]
    value = order_statistics(df, column, [r for a in at for r in (math.floor(a), math.ceil(a))])
    return [value[math.floor(a)] + (a - math.floor(a)) * (value[math.ceil(a)] - value[math.floor(a)]) if a > math.floor(a) else value[math.floor(a)] for a in at]
