"""Benchmark decontamination by template windows.

Texts are reduced to templates: numbers, units after a number and names (capitalised words,
those that begin a sentence only if they are no function word) become typed placeholders, and
adjacent numbers or names one placeholder, so that "Paris" and "New York" or "25" and "twenty
five" stand in the same slot; other words are lower-cased and stripped of punctuation.  Every
window of ``WINDOW`` template tokens is hashed and joined with the windows of the benchmark.
Matches of one text and one item are lined up by their offset; where words were put in or left
out, matches that run on at an offset up to ``DRIFT`` tokens away are chained.  If an alignment
covers enough of the item, the values that stand in the placeholders are compared: the item is
leaked if each of its values maps to one value of the text throughout (all equal: ``verbatim``,
otherwise ``reparameterised``), and not if the values contradict each other.

The benchmark's windows and texts go to every task only while they are small, which is measured
(``BROADCAST_WINDOWS``, ``BROADCAST_CHARS``); beyond that the windows of the texts are dealt by
hash and joined in Spark.  Both ways give the same rows.  Items shorter than a window are matched
by windows of their own length.  Windows with fewer than ``MIN_WORDS`` ordinary words say nothing
as templates and are left out on both sides.  Every item is also matched by windows of its
lower-cased tokens, values included, which find copies with the same values whatever their case
(``PLAIN_COVERAGE`` of them), and items that are dense in names or numbers; those windows have a
negative ``length``.

Ties between alignments go to the one with more windows, then with fewer changed values.  Texts
of any length are read whole, a few MB at a time.
Nulls: null texts and items count as empty and match nothing; different texts under one item id
are searched one by one and reported under that id, as are texts without an id under a null one;
repeated rows of a text or an item are reported once per id; rows with a null id are matched under that null id.  Texts that
share an id are judged one by one, each as its own row.  Empty tables give an empty result; other
columns, whatever their names, are ignored or passed through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.columns import free
from gridloom.plans.scratch import materialise

WINDOW = 8
MIN_WORDS = 4
#: Share of an item's windows that must match on one alignment.
COVERAGE = 0.6
#: The same for windows with values included, of items that can be told by their template.
PLAIN_COVERAGE = 0.9
#: Tokens by which an alignment may shift between one matched window and the next.
DRIFT = 3
#: Largest benchmark window table, and characters of benchmark text, that are sent to every task.
BROADCAST_WINDOWS = 1_000_000
BROADCAST_CHARS = 20_000_000
#: Raw tokens that one task remembers at most.
CACHE_TOKENS = 200_000
_CHUNK_CHARS = 2_000_000

# Number words and units that get a placeholder.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "km m cm mm mi mile miles ft foot feet inch inches kg g mg lb lbs pound pounds ounce ounces l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years % percent dollar dollars euro euros cent cents usd eur mph kmh degrees degree celsius fahrenheit watt watts volt volts joule joules".split()

# Words that are no names where they begin a sentence.
FUNCTION_WORDS = frozenset(
    "a an the this that these those he she it they we you i his her its their our your my who what when where which why how if then than as at by for from in into of on onto to with without over under after "
    "before during while until since because so and or but nor not no yes is are was were be been has have had do does did can could may might must shall should will would there here each every all any some "
    "many much more most few find compute calculate determine show prove given let suppose assume choose select answer question der die das ein eine und oder wenn wie was wer le la les un une et ou si el los "
    "las una y o que de des du en im am auf von mit zu".split()
)

WORD, NAME, NUMBER, UNIT = 0, 1, 2, 3
#: A function word with a capital: a name within a sentence only.
MAYBE = 4
_EDGE = re.compile(r"^[^\w%$€£]+|[^\w%]+$")
_NUMERIC = re.compile(r"^[$€£]?[+-]?\d[\d.,:/]*[a-z%]{0,3}$", re.IGNORECASE)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 7)


_MARK = np.array([0, _hash("<name>"), _hash("<number>"), _hash("<unit>")], dtype=np.uint64)


class Lexicon(dict):
    """raw token -> row of (hash of the plain word, kind by itself, ends a sentence); -1 for bare punctuation."""

    def __init__(self):
        super().__init__()
        self.hash: list[int] = []
        self.kind: list[int] = []
        self.ends: list[bool] = []

    def __missing__(self, raw: str) -> int:
        bare = _EDGE.sub("", raw)
        ends = raw[-1] in ".!?:;" or raw[-1] in "\"')" and len(raw) > 1 and raw[-2] in ".!?"
        low = bare.lower()
        if not bare:
            low, kind = "", -1
        elif _NUMERIC.match(bare) or all(part in NUMBER_WORDS for part in low.split("-")):
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif bare[0].isupper() and bare[1:] == bare[1:].lower() and len(bare) > 1:
            kind = MAYBE if low in FUNCTION_WORDS else NAME
        else:
            kind = WORD
        at = len(self.hash)
        self.hash.append(_hash(low))
        self.kind.append(kind)
        self.ends.append(ends)
        self[raw] = at
        return at

    def trimmed(self) -> "Lexicon":
        return Lexicon() if len(self) >= CACHE_TOKENS else self


class Templates:
    """Template tokens of several texts, laid end to end."""

    def __init__(self, texts: list[str | None], lexicon: Lexicon):
        raw = [(t or "").split() for t in texts]
        sizes = list(map(len, raw))
        self.raw = list(chain.from_iterable(raw))
        code = np.fromiter(map(lexicon.__getitem__, self.raw), np.int64, len(self.raw))
        doc = np.repeat(np.arange(len(raw)), sizes)
        kind = np.array(lexicon.kind or [0], dtype=np.int8)[code]
        ends = np.array(lexicon.ends or [False])[code]
        first = np.ones(len(code), bool)
        # A mark that stands alone still ends the sentence for the next token.
        first[1:] = (doc[1:] != doc[:-1]) | ends[:-1]
        real = kind >= 0
        place = np.nonzero(real)[0]
        kind, doc, first, code = kind[real], doc[real], first[real], code[real]
        kind = np.where(kind == MAYBE, np.where(first, WORD, NAME), kind)
        after_number = np.zeros(len(kind), bool)
        after_number[1:] = (kind[:-1] == NUMBER) & (doc[1:] == doc[:-1])
        kind = np.where((kind == UNIT) & ~after_number, WORD, kind)
        plain = np.array(lexicon.hash or [0], dtype=np.uint64)[code]
        # Adjacent names, or numbers, of one sentence are one placeholder.
        goes_on = np.zeros(len(kind), bool)
        goes_on[1:] = (kind[1:] == kind[:-1]) & ((kind[1:] == NAME) | (kind[1:] == NUMBER)) & (doc[1:] == doc[:-1]) & ~first[1:]
        begins = np.nonzero(~goes_on)[0]
        self.kind, self.doc = kind[begins], doc[begins]
        self.hash = np.where(self.kind == WORD, plain[begins], _MARK[self.kind])
        self.place, self.until = place[begins], np.append(place[begins[1:] - 1], place[-1:]) + 1
        #: The tokens as they stand, lower-cased and not folded, for windows with values included.
        self.plain, self.plain_doc, self.plain_place = plain, doc, place

    def value(self, at: int) -> str:
        return " ".join(filter(None, (_EDGE.sub("", w).lower() for w in self.raw[self.place[at] : self.until[at]])))

    def size(self, n: int) -> int:
        return len(self.hash) if n > 0 else len(self.plain)

    def docs(self, n: int) -> np.ndarray:
        """Which text each token belongs to, of the tokens that windows of length ``n`` are made of."""
        return self.doc if n > 0 else self.plain_doc

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of all windows of ``n`` tokens that stay in one text and hold enough words; of ``-n`` plain tokens if negative."""
        tokens, doc, seed, size = (self.hash if n > 0 else self.plain), self.docs(n), np.int64(n).view(np.uint64), abs(n)
        count = len(tokens) - size + 1
        if count <= 0:
            return np.array([], dtype=np.int64), np.array([], dtype=np.uint64)
        h = np.full(count, seed)
        for j in range(size):
            h = (h ^ (h >> np.uint64(29))) * _MIX + tokens[j : j + count]
        fine = doc[size - 1 :] == doc[:count]
        if n > 0:
            words = np.concatenate(([0], np.cumsum(self.kind == WORD)))
            fine &= words[size:] - words[:-size] >= min(MIN_WORDS, -(-size // 2))
        at = np.nonzero(fine)[0]
        return at, h[at]


class Item:
    """One benchmark text: kinds and values of its tokens, and how many windows of each length it has."""

    __slots__ = ("kinds", "values", "totals", "dense")

    def __init__(self, t: Templates):
        self.kinds = t.kind.tolist()
        self.values = [t.value(i) if k != WORD else "" for i, k in enumerate(self.kinds)]
        found = _windows_of(t)
        self.totals = {n: len(at) for n, (at, _) in found.items() if len(at)}
        #: Most of its template windows hold too few words.
        self.dense = any(n > 0 and 2 * len(at) < len(self.kinds) - n + 1 for n, (at, _) in found.items())

    def least(self, n: int) -> float:
        """Windows of length ``n`` that must match."""
        return self.totals.get(n, 0) * (COVERAGE if n > 0 or self.dense else PLAIN_COVERAGE)

    def slots(self, n: int, at: int) -> list[int]:
        """Places of the placeholders within the item's window at ``at``."""
        return [at + j for j in range(n) if self.kinds[at + j] != WORD] if n > 0 else []


def _windows_of(t: Templates) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length -> windows by which an item is matched."""
    n, m = min(WINDOW, t.size(1)), min(WINDOW, t.size(-1))
    return {k: t.windows(k) for k in (n, -m) if k}


def numbered(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, item_id, text)`` of the different pairs of id and text: each text of an id is an item of its own, and so is one without an id."""
    rows = bench.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    return rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")


def item_windows(items: DataFrame) -> DataFrame:
    """``(item, length, at, h)`` of ``items(item, text)``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for i, text in zip(x["item"], x["text"]):
                for n, found in _windows_of(Templates([text], Lexicon())).items():
                    out += [(i, n, int(a), int(np.uint64(h).view(np.int64))) for a, h in zip(*found)]
            yield pd.DataFrame(out, columns=["item", "length", "at", "h"])

    return items.select("item", "text").mapInPandas(cut, "item long, length int, at int, h long")


def _verdict(item: Item, slots: dict[int, str]) -> tuple[int, int] | None:
    """(placeholders, changed) if the values map consistently, else None."""
    maps: dict[tuple[int, str], str] = {}
    changed = 0
    for at, value in slots.items():
        key = (item.kinds[at], item.values[at])
        if maps.setdefault(key, value) != value:
            return None
        changed += value != item.values[at]
    return len(slots), changed


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of (item place, text place) that rises in both; of equal ones the first found."""
    tails: list[int] = []  # text place at the end of the best chain of each length
    ends: list[int] = []
    before: list[int] = []
    ordered = sorted(pairs, key=lambda x: (x[0], -x[1]))
    for k, (_, pos) in enumerate(ordered):
        at = bisect_left(tails, pos)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [pos], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(ordered[k])
        k = before[k]
    return out[::-1]


def _alignments(pairs: list[tuple[int, int]], least: float) -> Iterator[list[tuple[int, int]]]:
    """Matched (item place, text place) at one offset, or chained around it, if there are at least ``least``."""
    by_offset: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for w, pos in pairs:
        by_offset[pos - w].append((w, pos))
    for offset, exact in by_offset.items():
        if len(exact) >= least:
            yield exact
            continue
        band = [p for o in range(offset - DRIFT, offset + DRIFT + 1) for p in by_offset.get(o, ())]
        if len({w for w, _ in band}) >= least:
            chained = _chain(band)
            if len(chained) >= least:
                yield chained


def _judge(item: Item, n: int, pairs: list[tuple[int, int]], values) -> tuple[int, int, int] | None:
    """Best consistent alignment of distinct ``pairs``: (matched windows, placeholders, changed).

    ``values(w, pos)`` gives the text's values in the placeholders of the window at ``pos``, the item's at ``w``.
    """
    least, best = item.least(n), None
    if not least or len({w for w, _ in pairs}) < least:
        return None
    for aligned in _alignments(pairs, least):
        slots: dict[int, str] = {}
        for w, pos in aligned:
            for place, value in zip(item.slots(n, w), values(w, pos)):
                slots.setdefault(place, value)
        got = _verdict(item, slots)
        if got is not None and (best is None or (len(aligned), -got[1]) > (best[0], -best[2])):
            best = (len(aligned), *got)
    return best


_ROW = "id long, th long, "
_LEAK = "item long, matched int, total int, slots int, changed int"


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, Templates]]:
    """((id, text hash) of each text, templates) of a few MB of text at a time; one lexicon serves all, started anew when full."""
    lexicon = Lexicon()
    for x in batches:
        rows, texts, at = list(zip(x["id"].tolist(), x["th"].tolist())), x["text"].tolist(), 0
        while at < len(texts):
            stop, chars = at, 0
            while stop < len(texts) and (chars == 0 or chars < _CHUNK_CHARS):
                chars += len(texts[stop] or "")
                stop += 1
            lexicon = lexicon.trimmed()
            yield rows[at:stop], Templates(texts[at:stop], lexicon)
            at = stop


def _scan_broadcast(owners, items, lengths):
    ordered = np.sort(np.fromiter(owners, np.uint64, len(owners)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, t in _chunks(batches):
            yield pd.DataFrame(_hits(keys, t, ordered, owners, items, lengths), columns=["id", "th", "item", "matched", "total", "slots", "changed"])

    return scan


def _hits(keys, t: Templates, ordered, owners, items, lengths) -> list[tuple]:
    found: dict[tuple[int, int, int], set[tuple[int, int]]] = defaultdict(set)
    for n in lengths:
        at, h = t.windows(n)
        near = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
        hit = ordered[near] == h
        doc = t.docs(n)
        for a, x in zip(at[hit].tolist(), h[hit].tolist()):
            for item, w in owners[x]:
                if n in items[item].totals:
                    found[int(doc[a]), item, n].add((w, a))
    out = []
    for (d, item, n), pairs in found.items():
        it = items[item]
        best = _judge(it, n, sorted(pairs), lambda w, a: [t.value(a + p - w) for p in it.slots(n, w)])  # noqa: B023
        if best:
            out.append((*keys[d], item, best[0], it.totals[n], best[1], best[2]))
    return out


def _by_broadcast(docs: DataFrame, windows: DataFrame, bench: list) -> DataFrame:
    owners: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for r in windows.collect():
        owners[int(np.int64(r["h"]).view(np.uint64))].append((r["item"], r["at"]))
    items = {i: Item(Templates([t], Lexicon())) for i, t in bench}
    lengths = sorted({n for it in items.values() for n in it.totals})
    if not owners:
        return docs.sparkSession.createDataFrame([], _ROW + _LEAK)
    return docs.mapInPandas(_scan_broadcast(dict(owners), items, lengths), _ROW + _LEAK)


def _by_shuffle(docs: DataFrame, windows: DataFrame, bench: DataFrame) -> DataFrame:
    lengths = [r["length"] for r in windows.select("length").distinct().collect()]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, t in _chunks(batches):
            places = np.nonzero(t.kind != WORD)[0]
            values = [t.value(int(p)) for p in places]
            for n in lengths:
                at, h = t.windows(n)
                doc = t.docs(n)
                begins = np.searchsorted(doc, np.arange(len(keys)))
                lo, hi = (np.searchsorted(places, at), np.searchsorted(places, at + n)) if n > 0 else (np.zeros(len(at), int), np.zeros(len(at), int))
                doc = doc[at]
                yield pd.DataFrame({
                    "id": pd.Series([keys[d][0] for d in doc.tolist()], dtype=object), "th": [keys[d][1] for d in doc.tolist()], "length": n, "pos": at - begins[doc], "h": h.view(np.int64),
                    "slots": pd.Series([values[p:q] for p, q in zip(lo.tolist(), hi.tolist())], dtype=object),
                })

    hits = docs.mapInPandas(cut, _ROW + "length int, pos long, h long, slots array<string>").join(windows, ["h", "length"])
    # The matches of one text and one item are at most the text's windows times the places of a window in the item.
    lined = hits.groupBy("id", "th", "item", "length").agg(F.collect_set(F.struct("at", "pos", "slots")).alias("hits"))
    rows = bench.select("item", "text")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for i, th, item, length, text, met in zip(x["id"], x["th"], x["item"], x["length"], x["text"], x["hits"]):
                it = Item(Templates([text], Lexicon()))
                values = {(m["at"], m["pos"]): list(m["slots"]) for m in met}
                best = _judge(it, length, sorted(values), lambda w, pos: values[w, pos])  # noqa: B023
                if best:
                    out.append((i, th, item, best[0], it.totals[length], best[1], best[2]))
            yield pd.DataFrame(out, columns=["id", "th", "item", "matched", "total", "slots", "changed"])

    return lined.join(rows, "item").mapInPandas(judge, _ROW + _LEAK)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, broadcast_windows: int) -> DataFrame:
    """``(id, th, item, ..)``: leaks of each row, which its id and its text's hash name, of ``numbered`` items."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), _text_hash(text_col).alias("th"), F.col(text_col).alias("text"))
    windows = materialise(item_windows(items), "benchmark-windows")
    texts = items.select("item", "text").join(windows.select("item").distinct(), "item", "left_semi")
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    if windows.count() > broadcast_windows or size > BROADCAST_CHARS:
        return _by_shuffle(slim, windows, items)
    return _by_broadcast(slim, windows, [(r["item"], r["text"]) for r in texts.collect()])


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``(<id_col>, <item_col>, coverage, slots, changed, kind)``: one row for each id and each item that a text of it leaks."""
    items = materialise(numbered(bench, item_col, item_text), "benchmark-items")
    found = _found(docs, items, id_col, text_col, broadcast_windows).join(items.select("item", "item_id"), "item")
    best = found.groupBy("id", "item_id").agg(F.max(F.struct((F.col("matched") / F.col("total")).alias("coverage"), "matched", (-F.col("changed")).alias("same"), "slots", "total")).alias("b"))
    changed = -F.col("b.same")
    return best.select(
        F.col("id").alias(id_col), F.col("item_id").alias(item_col), "b.coverage",
        F.col("b.slots").alias("slots"), changed.alias("changed"), F.when(changed == 0, "verbatim").otherwise("reparameterised").alias("kind"),
    )


def keep_clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` without the rows that leak a benchmark item; other rows of the same id stay."""
    row_id, row_th, own_th = free(docs, "_id", "_th", "_own")
    items = materialise(numbered(bench, "item_id", "text"), "benchmark-items")
    dirty = _found(docs, items, id_col, text_col, broadcast_windows).select(F.col("id").alias(row_id), F.col("th").alias(row_th)).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col(row_id)) & (F.col(own_th) == F.col(row_th))
    return docs.withColumn(own_th, _text_hash(text_col)).join(dirty, same, "left_anti").select(*docs.columns)
