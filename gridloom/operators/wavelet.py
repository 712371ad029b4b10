"""Wavelet modulus maxima of survey lines: transform, maxima, chains over scales, singularity spectrum."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.plans.scratch import checkpointed

_HAT = 2 / (math.sqrt(3) * math.pi**0.25)
_REACH = 8.0


def _kernel(scale: float) -> np.ndarray:
    """Integral of the Mexican hat over each sample's width, out to eight scales on both sides."""
    h = math.ceil(_REACH * scale)
    edge = np.clip((np.arange(-h, h + 2) - 0.5) / scale, -_REACH, _REACH)
    return np.diff(_HAT * edge * np.exp(-edge * edge / 2)) * math.sqrt(scale)


#: Samples of a line that one row of the transform holds.
BLOCK = 1 << 16
_DIRECT = 1 << 24


def _response(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """``np.convolve(x, kernel)``; by a transform where that is many products."""
    if len(x) * len(kernel) <= _DIRECT:
        return np.convolve(x, kernel)
    n = len(x) + len(kernel) - 1
    m = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, m) * np.fft.rfft(kernel, m), m)[:n]


def transform(points: DataFrame, n_scales: int = 10, scales: list[float] | None = None, block: int = BLOCK) -> DataFrame:
    """``(line_id, scale_no, scale, pos, w)`` of ``points(line_id, pos, v)``, ``pos`` from 0 without gaps.

    Values are scaled to 0..1 along each line; beyond its ends they count as 0.  Without given
    scales there are ``n_scales`` from 1 to a quarter of the line's length, at even ratios.  Lines of
    fewer than two samples or of one value have no transform.

    Lines are cut into blocks; a task makes one stretch of one line on one scale from the blocks
    within the wavelet's reach of eight scales.  Stretches grow with the scale, so that a block is
    sent to about three of them: fine scales of a long line are many tasks, and the coarsest ones
    hold the line's packed values.
    """
    ok = points.where("v IS NOT NULL").select("line_id", "pos", F.col("v").cast("double").alias("v"), F.floor(F.col("pos") / block).alias("b"))
    blocks = ok.groupBy("line_id", "b").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("p"))
    blocks = checkpointed(blocks.select("line_id", "b", F.col("p.v").alias("v")))
    spans = blocks.groupBy("line_id").agg(F.sum(F.size("v")).alias("n"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).where("n > 1 AND high > low")
    if scales is None:
        top, steps = F.log10(F.greatest(F.col("n") / 4, F.lit(1.0))), max(n_scales - 1, 1)
        all_ = F.transform(F.sequence(F.lit(0), F.lit(n_scales - 1)), lambda k: F.struct(k.alias("scale_no"), F.pow(F.lit(10.0), k * top / steps).alias("scale")))
    else:
        all_ = F.array(*[F.struct(F.lit(k).alias("scale_no"), F.lit(float(a)).alias("scale")) for k, a in enumerate(scales)])
    each = blocks.join(spans, "line_id").select("line_id", "b", "n", "low", "high", "v", F.explode(all_).alias("s")).select("*", "s.scale_no", "s.scale")
    reach = F.ceil(F.lit(_REACH) * F.col("scale"))
    span = (F.greatest(F.lit(1), F.ceil(reach / block)) * block).cast("long")
    first = F.greatest(F.lit(0), F.floor((F.col("b") * block - reach) / span)).cast("long")
    last = F.least(F.floor((F.col("n") - 1) / span), F.floor((F.col("b") * block + block - 1 + reach) / span)).cast("long")
    parts = each.select("line_id", "scale_no", "scale", "n", "low", "high", "b", "v", span.alias("span"), F.explode(F.sequence(first, last)).alias("part"))

    # A line of one block is a part by itself; the blocks of a longer one meet in their parts.
    name = ["line_id", "scale_no", "scale", "n", "low", "high", "span", "part"]
    whole = parts.where(F.col("n") <= block).select(*name, "b", "v")
    longer = parts.where(F.col("n") > block).groupBy(*name).agg(F.min("b").alias("b"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("b", "v"))), lambda p: p["v"])).alias("v"))
    at, to = F.col("part") * F.col("span"), F.least((F.col("part") + 1) * F.col("span"), F.col("n"))

    @F.pandas_udf("array<double>")
    def response(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for b in batches:
            rows = []
            for v, low, high, scale, skip, count in zip(*b):
                kernel = _kernel(scale)
                skip += len(kernel) // 2
                rows.append(_response((v - low) / (high - low), kernel)[skip : skip + count])
            yield pd.Series(rows, dtype=object)

    made = whole.unionByName(longer).select("line_id", "scale_no", "scale", at.alias("at"), response("v", "low", "high", "scale", at - F.col("b") * block, to - at).alias("w"))
    rows = made.select("line_id", "scale_no", "scale", "at", F.posexplode("w").alias("k", "w"))
    return rows.select(F.col("line_id").cast("long").alias("line_id"), "scale_no", "scale", (F.col("at") + F.col("k")).cast("int").alias("pos"), "w")


def _apart(at: np.ndarray, height: np.ndarray, distance: int) -> list[bool]:
    """Which of the peaks at rising places stay, by going down from the highest, the later of equal ones first."""
    kept: list[int] = []
    chosen = [False] * len(at)
    for k in np.lexsort((at, height))[::-1].tolist():
        i = bisect_left(kept, at[k])
        if (i == 0 or at[k] - kept[i - 1] >= distance) and (i == len(kept) or kept[i] - at[k] >= distance):
            kept.insert(i, at[k])
            chosen[k] = True
    return chosen


def peaks(rows: DataFrame, keys: list[str], value: str, least: float = 0.0, distance: int = 1, block: int = BLOCK) -> DataFrame:
    """Rows of ``(keys.., pos, value)`` above both neighbours (one at an end) and above ``least`` times the group's maximum.

    Of peaks closer than ``distance`` only the highest stays, by going down from the highest; of
    equal ones the later place goes first.  A group is cut into blocks of places; what a block needs
    of others (the value before and behind it, the group's maximum) is one row for each block.
    Peaks are thinned block by block, those of blocks together whose outermost peaks are closer than
    ``distance``.
    """
    own = lambda c: F.coalesce(F.col(value) > c, F.lit(True))
    cut = rows.withColumn("_b", F.floor(F.col("pos") / block))
    edges = cut.groupBy(*keys, "_b").agg(F.min_by(value, "pos").alias("_first"), F.max_by(value, "pos").alias("_last"), F.max(value).alias("_top"))
    line = Window.partitionBy(*keys).orderBy("_b")
    edges = edges.select(*keys, "_b", F.lag("_last").over(line).alias("_before"), F.lead("_first").over(line).alias("_behind"), F.max("_top").over(Window.partitionBy(*keys)).alias("_top"))
    w = Window.partitionBy(*keys, "_b").orderBy("pos")
    found = cut.join(edges, [*keys, "_b"]).withColumn("_up", own(F.coalesce(F.lag(value).over(w), "_before")) & own(F.coalesce(F.lead(value).over(w), "_behind")))
    found = found.where(F.col("_up") & ((F.col(value) > F.col("_top") * least) if least > 0 else F.lit(True))).select(*rows.columns, "_b")
    if distance <= 1:
        return found.drop("_b")
    found = checkpointed(found)
    ends = found.groupBy(*keys, "_b").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    free = F.coalesce(F.col("_first") - F.lag("_last").over(line) >= distance, F.lit(True))
    runs = ends.select(*keys, "_b", free.cast("int").alias("_free")).select(*keys, "_b", F.sum("_free").over(line).alias("_run"))

    @F.pandas_udf("array<boolean>")
    def highest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([_apart(at, height, distance) for at, height in zip(*b)], dtype=object)

    rest = [c for c in rows.columns if c not in (*keys, "pos")]
    runs = found.join(runs, [*keys, "_b"]).groupBy(*keys, "_run").agg(F.sort_array(F.collect_list(F.struct("pos", *rest))).alias("_p"))
    kept = runs.select(*keys, "_p", highest("_p.pos", f"_p.{value}").alias("_kept"))
    kept = kept.select(*keys, F.explode(F.filter("_p", lambda _, k: F.get("_kept", k))).alias("_p"))
    return kept.select(*[c if c in keys else F.col(f"_p.{c}").alias(c) for c in rows.columns])


def modulus_maxima(coefficients: DataFrame, least: float = 0.05, distance: int = 3) -> DataFrame:
    """``(line_id, scale_no, scale, pos, value)``: peaks of the modulus on every scale."""
    rows = coefficients.select("line_id", "scale_no", "scale", "pos", F.abs("w").alias("value"))
    return peaks(rows, ["line_id", "scale_no"], "value", least, distance)


def _followed(number: np.ndarray, scale: np.ndarray, at: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(chain, index of a maximum) of the chains of two maxima or more through one line's maxima, sorted by scale and place."""
    cuts = [0, *(np.flatnonzero(np.diff(scale)) + 1).tolist(), len(at)]
    start = np.arange(cuts[1] if number[0] == 0 else 0)
    here, chain, place = at[start].astype(float), [start], [start]
    for before, (low, high) in zip(cuts, zip(cuts[1:-1], cuts[2:])):
        if not len(start):
            break
        near, level = reach * scale[low] / scale[before], at[low:high]
        right = np.minimum(np.searchsorted(level, here), len(level) - 1)
        left = np.maximum(right - 1, 0)
        best = np.where(np.abs(level[left] - here) <= np.abs(level[right] - here), left, right)
        met = np.flatnonzero(np.abs(level[best] - here) < near)
        chain.append(met)
        place.append(low + best[met])
        here[met] = level[best[met]]
    names, places = np.concatenate(chain), np.concatenate(place)
    long_ = np.bincount(names, minlength=1)[names] > 1
    return np.unique(names[long_], return_inverse=True)[1].astype(np.int32), places[long_]


def chains(maxima: DataFrame, reach: float = 2.0) -> DataFrame:
    """``(line_id, chain, scale_no, scale, pos, value)``: maxima followed from the finest scale up.

    A chain takes the nearest maximum of the next scale within ``reach`` times the ratio of the
    scales, the first one of equally near; where there is none it waits for the scale after.
    Chains may share maxima; those of one point are dropped.
    """

    names = ["line_id", "chain", "scale_no", "scale", "pos", "value"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts: list[tuple] = []
            for line, number, scale, at, value in b.itertuples(index=False):
                chain, place = _followed(number, scale, at, reach)
                parts.append((np.full(len(chain), line), chain, number[place], scale[place], at[place], value[place]))
            if parts:
                yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*parts)))))

    each = maxima.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("scale", "pos", "scale_no", "value"))).alias("p"))
    each = each.select("line_id", "p.scale_no", "p.scale", "p.pos", "p.value")
    return each.mapInPandas(run, "line_id long, chain int, scale_no int, scale double, pos int, value double")


def singularity_spectrum(maxima: DataFrame, qs: list[float] | None = None) -> DataFrame:
    """``(line_id, q, tau, h, d)``: slopes of the partition function over the scales, and its Legendre transform.

    ``d`` is divided by the line's largest if that is positive.
    """
    qs = [-5 + k / 4 for k in range(41)] if qs is None else qs
    z = maxima.select("line_id", "scale_no", "scale", "value", F.explode(F.array(*map(F.lit, map(float, qs)))).alias("q"))
    z = z.groupBy("line_id", "q", "scale_no").agg(F.log(F.sum(F.pow("value", "q"))).alias("z"), F.log(F.first("scale")).alias("a"))
    fine = z.where(F.col("z").isNotNull() & (F.abs("z") < math.inf) & ~F.isnan("z"))
    tau = fine.groupBy("line_id", "q").agg(F.when(F.count("*") > 1, F.regr_slope("z", "a")).otherwise(0.0).alias("tau"))
    w = Window.partitionBy("line_id").orderBy("q")
    ahead = lambda c: F.coalesce(F.lead(c).over(w), F.col(c))
    back = lambda c: F.coalesce(F.lag(c).over(w), F.col(c))
    tau = tau.withColumn("h", (ahead("tau") - back("tau")) / F.nullif(ahead("q") - back("q"), F.lit(0.0)))
    tau = tau.withColumn("d", F.col("q") * F.col("h") - F.col("tau"))
    top = F.max("d").over(Window.partitionBy("line_id"))
    return tau.select("line_id", "q", "tau", "h", F.when(top > 0, F.col("d") / top).otherwise(F.col("d")).alias("d"))
