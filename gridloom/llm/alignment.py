"""Alignment of the tokens that two tokenizers cut the same bytes into.

Every text gets a blank in front; its bytes are cut by a byte-level tokenizer A and by a piece
tokenizer B.  All tokens of both are sorted together by their starts and the running maximum of
their ends is taken: a group ends where a start reaches that maximum.  Within a group, every token
behind the first overlaps the newest token of the other side, which lists each overlapping pair once.

Both tokenizers end a token where white space begins (but for the few characters of it that stand
inside B's pieces), so texts are cut there and equal stretches are encoded and aligned once per
worker; a bounded number of them is remembered.  Vocabularies with merges over blanks are taken text
by text instead.

How often a pair of ids is linked is counted over the whole corpus: counts per document are summed
per pair.  Pairs with more than one in ``HOT_SHARE`` of all links, fewer than ``HOT_SHARE`` by that
rule whatever the data, are broadcast to the documents; the others meet them in a shuffled join.

A null or empty text, and one whose tokens do not spell it (it holds U+2581, say), has no tokens:
zeros and an empty string.  Very long texts are encoded whole; one text and its tokens must fit in
memory.  Repeated rows count each time and have a result each.  Null ids are passed through.  Pairs
that tie for the highest count of their B id are all best.  An empty table gives an empty result.
Columns named like a result column are replaced; all others but the text pass through.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from gridloom.llm.columns import free
from gridloom.plans.scratch import materialise

#: Stretches of at most this many characters are remembered, and so many of them by a worker.
SHORT, REMEMBERED = 48, 300_000
#: Characters that are aligned at a time.
CHUNK_CHARS = 2_000_000
#: Pairs with more than one in this many links are broadcast, so at most this many.
HOT_SHARE = 400_000
_FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<struct<pair:long,n:long>>"
_B_BITS = 32


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def coalesce_intervals(starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, group of each, left, right): intervals of kinds 0 and 1, which each cover the same range without gaps.

    ``order`` sorts them by start, kind 0 first; ``left`` and ``right`` are the indices of
    overlapping intervals of kind 0 and 1, each pair once, by group.
    """
    order = np.lexsort((kinds, starts))
    s, kind = starts[order], kinds[order]
    reach = np.maximum.accumulate(ends[order]) if len(order) else ends[order]
    breaks = np.ones(len(order), dtype=bool)
    breaks[1:] = s[1:] >= reach[:-1]
    at = np.arange(len(order))
    newest = [np.maximum.accumulate(np.where(kind == k, at, 0)) for k in (0, 1)]
    inner = ~breaks
    return order, np.cumsum(breaks) - 1, order[newest[0][inner]], order[newest[1][inner]]


class Aligner:
    """Both tokenizers and the aligned stretches that one worker process remembers."""

    def __init__(self, a_path: str, b_path: str, remembered: int = REMEMBERED):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letters = _bytes_of_letters()
        size = self.a.get_vocab_size(with_added_tokens=True)
        tokens = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        #: Bits of B's ids and of a pair; a text's number takes the rest of 63.
        self.b_bits = len(pieces).bit_length()
        self.pair_bits = self.b_bits + size.bit_length()
        self.blank = self.b.piece_to_id("▁")
        rules = json.loads(self.a.to_str())
        first = rules["pre_tokenizer"] or {}
        by_words = rules["normalizer"] is None and first.get("type") == "ByteLevel" and first.get("use_regex") is True and not first.get("add_prefix_space")
        whole = [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and len(p) > 1]
        #: White space and what follows it, up to white space that may begin a stretch.
        glued = re.escape("".join(sorted({c for p in whole for c in p[1:] if c.isspace()})))
        self.stretch = re.compile(rf"[^\S{glued}]\s*\S*" + (rf"(?:[{glued}]\s*\S*)*" if glued else ""))
        self.cuts = by_words and not any("▁" in p.lstrip("▁") for p in whole)
        #: Decimal ids with what may follow: , within a kind of a group, | before B, ; behind a group.
        self.cells = [f"{i}{c}" for c in ",|" for i in range(size)] + [f"{i}{c}" for c in ",;" for i in range(len(pieces))]
        self.remembered, self.core = remembered, 0
        self._forget(0)

    def _forget(self, keep: int) -> None:
        """Keep the first ``keep`` stretches."""
        if not keep:
            self.known, self.text = {}, []
            self.facts, self.at, self.pairs = np.zeros((0, 4), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
        else:
            self.known = {c: i for c, i in self.known.items() if i < keep}
            del self.text[keep:]
            self.facts, self.at = self.facts[:keep].copy(), self.at[: keep + 1].copy()
            self.pairs = self.pairs[: self.at[-1]].copy()

    def _b_ids(self, stretches: list[str]) -> list[list[int]]:
        """B's ids of each stretch, which begins with white space, as they stand inside a text."""
        blanks = [c[0] == " " for c in stretches]
        # The library puts a blank in front, which stands for the one cut off, or is taken off again.
        found = self.b.encode([c[1:] if blank else c for c, blank in zip(stretches, blanks)], num_threads=1)
        return [(ids or [self.blank]) if blank else ids[1:] for ids, blank in zip(found, blanks)]

    def _spelt(self, raw: list[bytes], ids: list[list[int]], table: list[bytes]) -> bool:
        """Whether the tokens of every stretch spell it: all of them together, and each to its length."""
        upto = np.cumsum([len(x) for x in ids])
        flat = list(map(table.__getitem__, chain.from_iterable(ids)))
        ends = np.append(0, np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat))))[upto]
        return bool((ends == np.cumsum([len(r) for r in raw])).all()) and b"".join(flat) == b"".join(raw)

    def _learn(self, stretches: list[str]) -> None:
        """Encode and align new stretches, all in one sweep over their bytes laid end to end."""
        a = [e.ids for e in self.a.encode_batch_fast(stretches, add_special_tokens=False)]
        b = self._b_ids(stretches)
        raw = [c.encode() for c in stretches]
        good = np.ones(len(raw), dtype=bool)
        if not all(self._spelt(raw, x, y) for x, y in ((a, self.a_bytes), (b, self.b_bytes))):
            good = np.array([b"".join(map(self.a_bytes.__getitem__, x)) == r == b"".join(map(self.b_bytes.__getitem__, y)) for r, x, y in zip(raw, a, b)], dtype=bool)
            a, b = ([x if g else [] for x, g in zip(ids, good)] for ids in (a, b))
        n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (a, b))
        ids = [np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b)]
        ends = [np.cumsum(size[x]) for size, x in zip((self.a_len, self.b_len), ids)]
        starts = [e - size[x] for e, size, x in zip(ends, (self.a_len, self.b_len), ids)]
        of = np.concatenate([np.repeat(np.arange(len(stretches)), n) for n in (n_a, n_b)])
        both, kinds = np.concatenate(ids), np.repeat([0, 1], [len(ids[0]), len(ids[1])])
        order, group, left, right = coalesce_intervals(np.concatenate(starts), np.concatenate(ends), kinds)
        breaks = np.diff(group, prepend=-1).astype(bool)
        n_groups = np.bincount(of[order[breaks]], minlength=len(stretches))
        n_links = np.bincount(of[left], minlength=len(stretches))
        facts = np.stack([n_a, n_b, n_groups, np.where(good, n_links, -1)], axis=1)
        self.facts = np.concatenate([self.facts, facts])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n_links)])
        self.pairs = np.concatenate([self.pairs, both[left] << self.b_bits | both[right]])
        # Within a group first all of A, then all of B, each by start.
        by = np.lexsort((kinds[order], group))
        token, g = order[by], group[by]
        follows = np.append((g[1:] != g[:-1]) | (kinds[token[1:]] != kinds[token[:-1]]), True).astype(np.int64)
        size = len(self.a_bytes), len(self.b_bytes)
        cell = both[token] + np.where(kinds[token] == 0, follows * size[0], 2 * size[0] + follows * size[1])
        words = list(map(self.cells.__getitem__, cell.tolist()))
        upto = np.cumsum(n_a + n_b).tolist()
        self.text += ["".join(words[lo:hi])[:-1] for lo, hi in zip([0, *upto], upto)]

    def _places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(places of all stretches of the texts among the known ones, how many each text has)."""
        split = [self.stretch.findall(f" {t}") if self.cuts else [f" {t}"] if t else [] for t in texts]
        new = list(dict.fromkeys(c for c in chain.from_iterable(split) if c not in self.known))
        new.sort(key=lambda c: len(c) > SHORT)
        self.fresh_short = len(self.text) + sum(len(c) <= SHORT for c in new)
        if new:
            base = len(self.text)
            self._learn(new)
            self.known.update((c, base + i) for i, c in enumerate(new))
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64), np.array([len(x) for x in split], dtype=np.int64)

    def align(self, texts: list[str | None]) -> pa.StructArray:
        """``n_a, n_b, n_groups, n_links, groups, pairs`` of each text; a pair is A's id times 2^32 plus B's."""
        # Many small lists and no cycles: searching them for garbage takes a quarter of the time.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._aligned(texts)
        finally:
            if collects:
                gc.enable()

    def _aligned(self, texts: list[str | None]) -> pa.StructArray:
        full = [t or "" for t in texts]
        place, count = self._places(full)
        doc = np.repeat(np.arange(len(full)), count)
        facts = self.facts[place]
        bad = np.bincount(doc, weights=facts[:, 3] < 0, minlength=len(full)) > 0
        bad |= np.array([not t for t in full], dtype=bool)
        ok = ~bad[doc]
        doc, place, facts = doc[ok], place[ok], facts[ok]
        sums = [np.bincount(doc, weights=facts[:, k], minlength=len(full)).astype(np.int64) for k in range(4)]
        edge = np.searchsorted(doc, np.arange(len(full) + 1)).tolist()
        words = list(map(self.text.__getitem__, place.tolist()))
        groups = [";".join(words[lo:hi]) for lo, hi in zip(edge, edge[1:])]
        # Links of all stretches of all texts, counted by (text, pair).
        n = facts[:, 3]
        where = np.repeat(self.at[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair, owner = self.pairs[where], np.repeat(doc, n)
        key = np.sort(owner << self.pair_bits | pair)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(first, append=len(key))
        key = key[first]
        offsets = np.searchsorted(key >> self.pair_bits, np.arange(len(full) + 1)).astype(np.int32)
        pair = key & (1 << self.pair_bits) - 1
        pair = pair >> self.b_bits << _B_BITS | pair & (1 << self.b_bits) - 1
        items = pa.StructArray.from_arrays([pa.array(pair), pa.array(times)], names=["pair", "n"])
        self._trim()
        return pa.StructArray.from_arrays([*[pa.array(x) for x in sums], pa.array(groups, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), items)], names=["n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    def _trim(self) -> None:
        """Forget long stretches, and all but the first half where there are too many: among these are nearly all frequent ones."""
        keep = self.fresh_short
        if not self.core and keep >= self.remembered // 2:
            self.core = keep
        if keep > self.remembered:
            keep = self.core
        if keep < len(self.text):
            self._forget(keep)


@lru_cache(maxsize=2)
def shared_aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def vocabulary_paths(a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(a), public_tokenizers.path(b)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` without its texts and with ``n_a, n_b, n_groups, n_links, groups, pairs``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: decimal ids of A and B per group; ``pairs`` counts the links
    of each pair of ids within the text.
    """
    a_path, b_path = a_path or vocabulary_paths()[0], b_path or vocabulary_paths()[1]
    added = StructType.fromDDL(_FIELDS)
    replaced = {f.name.lower() for f in added} | {text_col.lower()}
    keep = [c for c in docs.columns if c.lower() not in replaced]
    text = free(docs, "_text")[0]
    schema = StructType([docs.schema[c] for c in keep] + list(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared_aligner(a_path, b_path)
        for batch in batches:
            texts, at = batch.column(len(keep)).to_pylist(), 0
            while at < len(texts):
                upto, chars = at, 0
                while upto < len(texts) and chars < CHUNK_CHARS:
                    chars += len(texts[upto] or "")
                    upto += 1
                found = aligner.align(texts[at:upto])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, upto - at) for k in range(len(keep))), *found.flatten()], names=[f.name for f in schema])
                at = upto

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias(text)).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, links, best)``: how many links of the corpus hold a pair, and whether no other pair of its B id has more."""
    counts = materialise(aligned.select(F.explode("pairs").alias("p")).groupBy("p.pair").agg(F.sum("p.n").alias("links")), "pair-counts")
    b = F.col("pair").bitwiseAND(2**_B_BITS - 1)
    # One row per id of B's vocabulary.
    highest = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return counts.join(F.broadcast(highest), b == F.col("b")).select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def link_scores(aligned: DataFrame, key: str) -> DataFrame:
    """``(<key>, n_best, count_sum)`` of the rows of ``aligned`` that have links; ``key`` tells its rows apart."""
    counts = materialise(pair_counts(aligned), "pair-scores")
    total = counts.agg(F.sum("links")).first()[0] or 0
    hot, rest = counts.where(F.col("links") * HOT_SHARE > total), counts.where(F.col("links") * HOT_SHARE <= total)
    links = aligned.select(key, F.explode("pairs").alias("p")).select(key, "p.pair", "p.n")
    sums = lambda rows: rows.groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))
    common = sums(links.join(F.broadcast(hot), "pair"))
    rare = sums(links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(rest, "pair"))
    return common.unionByName(rare).groupBy(key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def digests(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every document."""
    found = align(docs.select(id_col, text_col), a_path, b_path, text_col)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    # The number of a row is fixed once it is written.
    found = materialise(found.select(F.monotonically_increasing_id().alias("row_"), id_col, "n_a", "n_b", "n_groups", "n_links", digest, "pairs"), "aligned")
    scores = link_scores(found, "row_")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.drop("pairs").join(scores, "row_", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
