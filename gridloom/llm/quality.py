"""Quality scores from two Zstandard dictionaries, one of good and one of bad text.

A text is cut into blocks (a block is short enough that the dictionary, not the text itself,
is what the compressor draws on) and every block is compressed with either dictionary.  The
difference of the two compressed sizes over the plain compressed size, summed over the whole
text, tells which side it resembles.  A logistic curve fitted on labelled rows that went into
neither dictionary turns it into a probability; the curve also takes the plain compressed
density (log of compressed over raw size), without which text that repeats itself, and so is
small under either dictionary, would look neutral.

Training looks at a bounded sample: at most ``DICT_BLOCKS`` blocks and ``FIT_DOCS`` texts of
each class, out of at most as many texts, chosen by hash of their id, from rows outside the
held-out fold.  Scoring covers
every row and every character.

Nulls: a null text counts as empty; an empty text has difference 0 and gets the curve's value
there.  Without labels of both classes every score is 0.5, or the one class that is known.
Repeated rows and equal texts score alike; a score of exactly 0.5 counts as good.  An empty table
gives an empty result; other columns, whatever their names, are ignored or passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.columns import free
from gridloom.llm.sampling import held_out, labelled, per_class, with_texts
from gridloom.plans.scratch import materialise

FOLDS, FOLD = 3, 1
BLOCK_BYTES = 1024
DICT_BLOCKS = 4_000
DICT_BYTES = 112 * 1024
FIT_DOCS = 3_000
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    density: float
    offset: float


def blocks(text: str | None, size: int = BLOCK_BYTES) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdCompressionDict(content, dict_type=kind) if content else None
    if d is not None:
        d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False)


class Sizes:
    """Normalised compressed-size differences; positive leans to good."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad, self.plain = _compressor(good), _compressor(bad), _compressor(b"")

    def of(self, text: str | None) -> tuple[float, float]:
        """Normalised difference and log density; (0, 0) for an empty text."""
        g = b = p = n = 0
        for x in blocks(text):
            g += len(self.good.compress(x))
            b += len(self.bad.compress(x))
            p += len(self.plain.compress(x))
            n += len(x)
        return ((b - g) / p, float(np.log(p / n))) if p else (0.0, 0.0)


def _dictionary(pieces: list[bytes]) -> bytes:
    """Raw dictionary content: evenly spread pieces up to ``DICT_BYTES``; the library's trainer picks the segments."""
    if not pieces:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(pieces)[-DICT_BYTES:]


def _logistic(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the columns of ``f`` and offset by Newton steps, with targets smoothed as by Platt."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = np.append(np.where(f.std(axis=0) > 0, f.std(axis=0), 1.0), 1.0)
    x = np.column_stack([f, np.ones(len(f))]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-4 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Model:
    rows = materialise(labelled(docs, labels, label, id_col, FOLDS, FOLD), "quality-labels")
    side = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(2))

    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(blocks)

    texts = materialise(with_texts(docs, rows.where(side == 0), id_col, text_col, DICT_BLOCKS, 1), "quality-texts")
    pieces = texts.repartition(texts.sparkSession.sparkContext.defaultParallelism * 2, "id").select("id", "y", F.posexplode(cut("text")).alias("at", "block"))
    pieces = pieces.withColumn("key", F.xxhash64("id", "at"))
    sample = per_class(pieces, DICT_BLOCKS, 1, "key").select("y", "block").collect()
    of = {y: [bytes(r["block"]) for r in sample if r["y"] == y] for y in (0, 1)}
    good, bad = _dictionary(of[1]), _dictionary(of[0])
    fit = materialise(with_texts(docs, rows.where(side == 1), id_col, text_col, FIT_DOCS, 2), "quality-fit")
    fit = fit.repartition(fit.sparkSession.sparkContext.defaultParallelism * 2, "id").select("y", _features(good, bad, "text").alias("f")).select("y", "f.*").collect()
    # The sample holds as many of either class as it can; the offset gives the classes their true shares.
    share = {r["y"]: r["n"] for r in rows.where(side == 1).groupBy("y").agg(F.count("*").alias("n")).collect()}
    y, f = np.array([r["y"] for r in fit], dtype=int), np.array([(r["d"], r["density"]) for r in fit], dtype=float)
    if len(set(y.tolist())) < 2:
        known = set(y.tolist()) | {k for k in of if of[k]}
        return Model(good, bad, 0.0, 0.0, 0.0 if len(known) != 1 else 30.0 if 1 in known else -30.0)
    slope, density, offset = map(float, _logistic(f, y))
    taken = {k: (y == k).sum() for k in (0, 1)}
    prior = np.log(share[1] / share[0]) - np.log(taken[1] / taken[0])
    return Model(good, bad, slope, density, offset + float(prior))


def _features(good: bytes, bad: bytes, text_col: str) -> Column:
    @F.pandas_udf("struct<d:double,density:double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sizes = Sizes(good, bad)
        for texts in batches:
            yield pd.DataFrame([sizes.of(t) for t in texts], columns=["d", "density"])

    return run(F.col(text_col))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is good."""
    f = free(docs, "_f")[0]
    z = F.col(f"{f}.d") * F.lit(model.slope) + F.col(f"{f}.density") * F.lit(model.density) + F.lit(model.offset)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return docs.withColumn(f, _features(model.good, model.bad, text_col)).withColumn(out, p).drop(f)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, held_out, score, predicted)`` for every row."""
    model = train(docs, labels, id_col, text_col)
    out = with_score(docs.select(id_col, F.col(text_col).alias("_text")), model, "_text")
    return out.select(id_col, held_out(id_col, FOLDS, FOLD).alias("held_out"), "score").withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are predicted bad."""
    q = free(docs, "_q")[0]
    return with_score(docs, train(docs, labels, id_col, text_col), text_col, q).where(F.col(q) >= 0.5).drop(q)
