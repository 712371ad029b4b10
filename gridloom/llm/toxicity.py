"""Toxicity by multiple-instance learning: a text is toxic if at least one sentence is.

Every sentence gets a logistic score over a learned vocabulary of words and word beginnings
(four to eight letters, so that inflected and compound forms count together); the sentence
scores of a text are combined by noisy-or, P = 1 - prod(1 - p).  Only whole texts carry
labels, so the weights are trained through that combination, and the trained sentence scores
then say where the offence lies.

Training uses a bounded sample outside the held-out fold: at most ``FIT_DOCS`` texts of each
class by hash of their id, with class weights that restore the true shares.  The vocabulary
holds at most ``VOCABULARY`` terms of that sample, those that lean to the toxic class with
the largest log-likelihood ratio.  Scoring covers every row and every sentence.

Nulls: a null text counts as empty; a text without sentences scores as one with an empty
sentence.  Without labels of both classes the vocabulary is empty and all scores are near 0.
Repeated rows and equal texts score alike; of equally bad sentences the first is named; a score
of exactly 0.5 counts as toxic.  Texts of any length are scored whole, a sentence at a time.  An
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.sampling import held_out, labelled, with_texts
from gridloom.plans.scratch import materialise

FOLDS, FOLD = 5, 0
VOCABULARY = 2_000
MIN_DOCS = 3
FIT_DOCS = 5_000
#: Words that one task remembers at most.
CACHE_WORDS = 200_000
#: Rows of one batch that a task hands back.
OUT_ROWS = 10_000
_BEGINNINGS = (4, 5, 6, 7, 8)
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0


def word_terms(word: str) -> list[str]:
    """A word and its proper beginnings, these marked with a hyphen."""
    return [word, *(word[:n] + "-" for n in _BEGINNINGS if len(word) > n)]


def lowered(text: str | None) -> str:
    """Lower case with every character kept in its place."""
    text = text or ""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Known(dict):
    """word -> numbers of its vocabulary terms, filled as words are met and bounded."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = tuple(self.number[t] for t in word_terms(word) if t in self.number)
        self[word] = found
        return found

    def sentences(self, text: str | None) -> Iterator[tuple[tuple[int, int], set[int]]]:
        """Span and vocabulary terms of each sentence of the text."""
        get = self.__getitem__
        for m in _SENTENCE.finditer(lowered(text)):
            yield m.span(), set().union(*filter(None, map(get, _WORD.findall(m.group()))))


def _scan(weights: np.ndarray, bias: float, known: Known, text: str | None) -> tuple[float, int, int, float]:
    """Noisy-or score of the text; span and score of its most offensive sentence (empty span: none stands out)."""
    rest, best, at, total = 0, -np.inf, (0, 0), 0.0
    for span, found in known.sentences(text):
        if not found:
            rest += 1
            continue
        z = bias + sum(weights[t] for t in found)
        total += np.logaddexp(0.0, z)
        if z > best:
            best, at = z, span
    if total == 0.0:
        rest = max(1, rest)
    p = -np.expm1(-(total + rest * np.logaddexp(0.0, bias)))
    return float(p), *at, float(1 / (1 + np.exp(-np.clip(best, -30, 30)))) if best > -np.inf else 0.0


def choose_terms(rows: DataFrame, total: dict[int, int], n: int = VOCABULARY) -> list[str]:
    """The ``n`` terms of ``rows(text, y)`` that lean to the toxic class with the largest log-likelihood ratio."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for x in batches:
            for text, y in zip(x.column("text").to_pylist(), x.column("y").to_pylist()):
                words = set(_WORD.findall(lowered(text)))
                seen[y].update(set(chain.from_iterable(map(word_terms, words))))
        terms = sorted(seen[0].keys() | seen[1].keys())
        for k in range(0, len(terms), OUT_ROWS):
            part = terms[k : k + OUT_ROWS]
            counts = [pa.array([seen[y][t] for t in part], pa.int64()) for y in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *counts], names=["term", "a", "b"])

    n1, n0 = float(total.get(1, 0)), float(total.get(0, 0))
    if not n1 or not n0:
        return []
    c = rows.select("text", "y").mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    c = c.where(F.col("a") >= MIN_DOCS).where(F.col("a") / n1 > 2 * F.col("b") / n0)
    ln = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(F.lit(0.0))
    share = (F.col("a") + F.col("b")) / (n1 + n0)
    g = ln(F.col("a"), share * n1) + ln(F.col("b"), share * n0) + ln(n1 - F.col("a"), (1 - share) * n1) + ln(n0 - F.col("b"), (1 - share) * n0)
    return [r["term"] for r in c.withColumn("g", g).orderBy(F.desc("g"), "term").limit(n).collect()]


def _fit(bags: list[list[list[int]]], sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, n_terms: int) -> tuple[np.ndarray, float]:
    """Weights by gradient steps (Adam) on the noisy-or likelihood.

    ``bags``: for every text its sentences that hold vocabulary terms, as term numbers;
    ``sizes``: all its sentences, those without any term included.
    """
    rows = [(d, s) for d, bag in enumerate(bags) for s in bag]
    doc = np.array([d for d, _ in rows], dtype=int)
    at = np.repeat(np.arange(len(rows)), [len(s) for _, s in rows])
    col = np.array([t for _, s in rows for t in s], dtype=int)
    plain = sizes - np.bincount(doc, minlength=len(bags))
    w, b = np.full(n_terms, 1.0), -6.0
    m = np.zeros(n_terms + 1)
    v = np.zeros(n_terms + 1)
    for step in range(1, 401):
        z = b + np.bincount(at, w[col], minlength=len(rows))
        soft = np.logaddexp(0, z)
        s = np.bincount(doc, soft, minlength=len(bags)) + plain * np.logaddexp(0, b)
        p = np.clip(-np.expm1(-s), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence: p_ij where the text is clean, -p_ij (1 - P) / P where it is toxic.
        scale = weight * np.where(y == 1, -(1 - p) / p, 1.0)
        gz = scale[doc] / (1 + np.exp(-z))
        g = np.append(np.bincount(col, gz[at], minlength=n_terms), gz.sum() + (scale * plain).sum() / (1 + np.exp(-b)))
        g = g / weight.sum() + np.append(1e-4 * w, 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Model:
    rows = labelled(docs, labels, label, id_col, FOLDS, FOLD)
    share = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sample = materialise(with_texts(docs, rows, id_col, text_col, FIT_DOCS, 3), "toxicity-sample").repartition(rows.sparkSession.sparkContext.defaultParallelism * 2, "id")
    taken = {0: 0, 1: 0} | {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = choose_terms(sample, taken)
    if not chosen:
        return Model()
    number = {t: k for k, t in enumerate(chosen)}

    @F.pandas_udf("struct<size:int,bag:array<array<int>>>")
    def bag(texts: pd.Series) -> pd.DataFrame:
        known, out = Known(number), []
        for t in texts:
            found = [sorted(f) for _, f in known.sentences(t)]
            out.append((max(1, len(found)), [f for f in found if f]))
        return pd.DataFrame(out, columns=["size", "bag"])

    got = sample.select("id", "y", bag("text").alias("b")).select("id", "y", "b.*").orderBy("id").collect()
    y = np.array([r["y"] for r in got])
    weight = np.array([share[k] / taken[k] for k in y.tolist()])
    w, b = _fit([[list(s) for s in r["bag"]] for r in got], np.array([r["size"] for r in got]), y, weight, len(chosen))
    return Model({t: float(x) for t, x in zip(chosen, w)}, b)


def locate(model: Model, text_col: str = "text") -> Column:
    """Struct ``(score, start, end, sentence_score)``: the text's score and its worst sentence, in code points."""
    number = {t: k for k, t in enumerate(model.weights)}
    weights, bias = list(model.weights.values()), model.bias

    @F.pandas_udf("struct<score:double,start:int,end:int,sentence_score:double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Known(number)
        for texts in batches:
            yield pd.DataFrame([_scan(weights, bias, known, t) for t in texts], columns=["score", "start", "end", "sentence_score"])

    return run(F.col(text_col))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, held_out, score, predicted, start, end, sentence_score)`` for every row."""
    model = train(docs, labels, id_col, text_col)
    found = docs.select(id_col, held_out(id_col, FOLDS, FOLD).alias("held_out"), locate(model, text_col).alias("t"))
    return found.select(id_col, "held_out", "t.score", F.when(F.col("t.score") >= 0.5, 1).otherwise(0).alias("predicted"), "t.start", "t.end", "t.sentence_score")
