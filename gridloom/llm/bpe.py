"""BPE encoding and decoding with tree concatenation of long texts.

Where the vocabulary's rule drops blanks and splits words before any merge, a text's pieces are
encoded one by one, as their ids do not depend on their neighbours.  Each worker keeps the ids of
the pieces that it has met, and their finished strings of ids and tokens, in a bounded cache.
Where only ids are asked for, it keeps those of whole words of plain text instead, and the words
that a batch of texts brings along are merged together, one merge of each word at a time.
Other vocabularies, and rare characters, go through the library directly.

A long text is halved again and again into leaves of bounded length, which are dealt over
the cluster and encoded independently.  A cut beside a blank needs no work.  A cut inside
unsplit text leaves wrong tokens at both edges: a window around the join is encoded again,
growing until it shares tokens (same id, same place) with the left and the right side; from
there on both sides agree exactly, since a sequence of BPE tokens is the encoding of its text
if every adjacent pair is.  Joins settled inside their two leaves are independent of all
others, so each is a task's row of its own and only the ids meet in the end.  Where a join
finds no shared token inside its leaves (one character repeated over the whole leaf), the
leaves of that unsplit stretch are joined in a tree in one task.

Nulls: a null text counts as empty; an empty text has no ids and decodes to the empty string.
Repeated rows each get their own result row.  Equal long texts are encoded once.  An empty
table gives an empty result; columns other than the text are passed through untouched, whatever
their names, except those named like a result column, which it replaces.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.columns import free
from gridloom.plans.scratch import materialise

#: Texts of more characters than this go through tree concatenation, in leaves of at most this many.
LEAF_CHARS = 32_768
#: Whole words that one task remembers at most; besides half as many pieces as packed ids and a quarter as many as texts.
CACHE_PIECES = 600_000
#: Longer words of plain text are put together from their pieces each time; longer pieces go through the library.
WORD_CHARS = 64
#: New words that are merged together.
MERGED_WORDS = 16_384
_FIRST_WINDOW = 32
_SHARED_RUN = 3


@lru_cache(maxsize=4)
def load(vocab_path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocab_path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The split rule of the lower-casing word vocabulary, as its file states it.
WORD_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Texts of these characters only (no special-token bracket) are split the same way by the plain rule below.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: The characters that stand for the bytes of plain letters: printable bytes for themselves, others from U+0100 on.
_SPARE = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_PLAIN_RULE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
#: The same, with the line ends between words as pieces of their own.
_PLAIN_LINES = re.compile(_PLAIN_RULE.pattern + "|\n")
#: The character by which byte-level vocabularies name each byte.
_NAMES = [chr(256 + _SPARE.index(b)) if b in _SPARE else chr(b) for b in range(256)]
_BYTES = {c: "".join(_NAMES[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Codec:
    """Encodes and decodes within one task."""

    def __init__(self, vocab_path: str, cache_pieces: int = CACHE_PIECES):
        self.tok = load(vocab_path)
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.token = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.digits = [str(i) for i in range(size)]
        rules = json.loads(self.tok.to_str())
        first = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.drops_blanks = first.get("pattern") == {"Regex": WORD_RULE} and first.get("invert") is True
        self.joins_tokens = rules["decoder"] is None
        texts = lambda ids: (" ".join([self.digits[i] for i in ids]), " ".join([self.token[i] for i in ids]))
        self.id_dtype = "<u2" if size <= 1 << 16 else "<u4"
        words = Words(Merges(rules["model"], self.id_dtype), self.tok.model.tokenize, cache_pieces) if self.drops_blanks and Merges.hold(rules["model"]) else None
        #: Of each piece its ids as decimal text and its tokens as text, or its ids as two or four bytes each.
        # Texts take several times the memory of packed ids, so fewer are kept.
        self.texts, self.packed = Pieces(self.tok, texts, cache_pieces // 4), Pieces(self.tok, lambda ids: np.array(ids, self.id_dtype).tobytes(), cache_pieces // 2, words)

    def pack_many(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Exactly the library's ids of each text, in order, as arrays of ``id_dtype``."""
        if not self.drops_blanks:
            yield from (np.array(self.tok.encode(t or "", add_special_tokens=False).ids, self.id_dtype) for t in texts)
            return
        at, words = 0, self.packed.words
        while at < len(texts):
            some, chars = [], 0
            while at + len(some) < len(texts) and chars < 4_000_000:
                some.append(texts[at + len(some)] or "")
                chars += len(some[-1])
            whole = [words is not None and _is_plain(t) for t in some]
            plain = iter(words.of([t for t, w in zip(some, whole) if w]) if any(whole) else [])
            other = self.packed.of([t for t, w in zip(some, whole) if not w])
            for w in whole:
                yield next(plain) if w else np.frombuffer(b"".join(next(other)), self.id_dtype)
            at += len(some)

    def encode_many(self, texts: list[str | None]) -> Iterator[list[int]]:
        yield from (ids.tolist() for ids in self.pack_many(texts))

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_many([text]))

    def encode_spans(self, text: str) -> list[tuple[int, int, int]]:
        e = self.tok.encode(text, add_special_tokens=False)
        return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets)]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes: where the vocabulary names no decoder, token strings joined by blanks."""
        if self.joins_tokens:
            return " ".join(map(self.token.__getitem__, ids))
        return self.tok.decode(ids, skip_special_tokens=False)

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), _sha256(" ".join(map(self.digits.__getitem__, ids))), _sha256(self.decode(ids))

    def digest_many(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """``digest`` of each text, put together from the finished strings of its pieces."""
        if not (self.drops_blanks and self.joins_tokens):
            yield from map(self.digest, self.encode_many(texts))
            return
        for found in self.texts.of(texts):
            ids = " ".join([ids for ids, _ in found if ids])
            yield ids.count(" ") + bool(ids), _sha256(ids), _sha256(" ".join([tokens for _, tokens in found if tokens]))


def _is_plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None and "<|" not in text


class Merges:
    """Merges of a byte-level vocabulary on many pieces at once: each step merges, in every piece, the first of its best pairs."""

    def __init__(self, model: dict, dtype: str):
        ids, pairs, end = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]], model["end_of_word_suffix"] or ""
        self.dtype, self.size, self.none = dtype, 1 + max(ids.values()), len(pairs)
        #: Ids of the bytes 0 to 255 inside a piece, then of the same bytes at its end.
        self.bytes = np.array([ids[c + e] for e in ("", end) for c in _NAMES])
        self.made = np.array([ids[a + b] for a, b in pairs])
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs])
        self.rank = np.append(np.argsort(keys), self.none)
        self.keys = np.append(keys[self.rank[:-1]], self.size**2)
        self.byte_ranks = self._ranks(np.repeat(self.bytes, 512), np.tile(self.bytes, 512)).astype("<i4")

    @staticmethod
    def hold(model: dict) -> bool:
        """Whether the library does nothing but such merges, each of which makes another token."""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges"))
        named = all(c + e in model["vocab"] for c in _NAMES for e in ("", model.get("end_of_word_suffix") or ""))
        return model.get("type") == "BPE" and plain and named and 0 < len(pairs) == len({a + b for a, b in pairs})

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def merged(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids after all merges, number of piece of each), given the bytes of pieces of ``size`` bytes each, 256 added to each last."""
        piece, start, done, ids = np.arange(len(size)), np.cumsum(size) - size, [], self.bytes[data]
        rank = np.append(self.byte_ranks[data[:-1] * 512 + data[1:]].astype(np.int64), self.none)
        rank[start[1:] - 1] = self.none
        while len(size):
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), start)
            live = best >> 32 < self.none
            stay = np.repeat(live, size)
            done.append((ids[~stay], np.repeat(piece[~live], size[~live])))
            at = best[live] & 0xFFFFFFFF
            ids[at] = self.made[best[live] >> 32]
            stay[at + 1] = False
            at -= start[live]
            ids, rank, piece, size = ids[stay], rank[stay], piece[live], size[live] - 1
            start = np.cumsum(size) - size
            rank[start + at] = self.none
            for here in ((start + at)[at + 1 < size], (start + at - 1)[at > 0]):
                rank[here] = self._ranks(ids[here], ids[here + 1])
        ids, piece = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(piece, kind="stable")
        return ids[order], piece[order]

    def of(self, words: list[str]) -> list[bytes]:
        """Packed ids of each lower-cased word of plain text."""
        text = np.frombuffer("\t".join(_PLAIN_LINES.findall("\n".join(words) + "\n")).encode() + b"\t", np.uint8)
        last = np.append(text[1:] == 9, False)
        byte = (text != 9) & (text != 10)
        if not byte.any():
            return [b""] * len(words)
        size = np.diff(np.nonzero(last[byte])[0], prepend=-1)
        ids, piece = self.merged((text + 256 * last.astype(np.int64))[byte], size)
        word = np.cumsum(text == 10)[byte & last]
        ends = np.cumsum(np.bincount(word[piece], minlength=len(words))) * np.dtype(self.dtype).itemsize
        packed = ids.astype(self.dtype).tobytes()
        return [packed[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


class Words(dict):
    """Packed ids of each lower-cased word of plain text; those met first stay."""

    def __init__(self, merges: Merges, whole, most: int):
        super().__init__()
        self.merges, self.whole, self.most = merges, whole, most

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts.  No piece of a plain text reaches over a blank."""
        split = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, "string")))
        coded = split.flatten().dictionary_encode()
        found = self.packed(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, which = np.frombuffer(b"".join(found), self.merges.dtype), coded.indices.to_numpy()
        size = np.fromiter(map(len, found), np.int64, len(found)) // ids.itemsize
        many = size[which]
        end = np.cumsum(many)
        ids = ids[np.repeat((np.cumsum(size) - size)[which] - (end - many), many) + np.arange(many.sum())]
        return np.split(ids, np.append(0, end)[split.offsets.to_numpy()[1:-1]])

    def packed(self, words: list[str]) -> list[bytes]:
        """What is kept of different words; new ones are merged together."""
        found = list(map(self.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        pieces = {w: _PLAIN_RULE.findall(w) for w in new if len(w) > WORD_CHARS}
        parts = set(chain.from_iterable(pieces.values()))
        long = {p: np.array([t.id for t in self.whole(p.translate(_BYTES))], self.merges.dtype).tobytes() for p in parts if len(p) > WORD_CHARS}
        short = list(dict.fromkeys([w for w in new if w not in pieces] + [p for p in parts if p not in long]))
        met = dict(zip(short, chain.from_iterable(self.merges.of(short[k : k + MERGED_WORDS]) for k in range(0, len(short), MERGED_WORDS))))
        self.update(islice(met.items(), max(0, self.most - len(self))))
        met |= long
        met |= {w: b"".join([met[p] for p in ps]) for w, ps in pieces.items()}
        return [met[w] if ids is None else ids for w, ids in zip(words, found)]


class Pieces:
    """Bounded cache of what is kept of the ids of each piece of text; plain texts may be looked up in ``words`` instead."""

    def __init__(self, tok, keep, most: int, words: Words | None = None):
        self.tok, self.keep, self.most, self.words = tok, keep, most, words
        self.known: dict[str, object] = {}
        #: The pieces met first, among them nearly all frequent ones, stay when the cache is full.
        self.core: list[str] = []

    def _cut(self, text: str) -> tuple[list[str], bool]:
        if _is_plain(text):
            return _PLAIN_RULE.findall(text.lower()), True
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "), False

    def _learn(self, pieces: set[str], plain: bool) -> None:
        """Plain pieces are what the library's merges start from; others take its whole way."""
        new = list(pieces.difference(self.known))
        if len(self.known) + len(new) > self.most:
            self.known = {p: self.known[p] for p in self.core[: self.most // 2]}
            new = list(pieces.difference(self.known))
        if plain:
            merge = self.tok.model.tokenize
            coded = ([t.id for t in merge(p if p.isascii() else p.translate(_BYTES))] for p in new)
        else:
            coded = (e.ids for e in self.tok.encode_batch_fast(new, add_special_tokens=False))
        for p, ids in zip(new, coded):
            self.known[p] = self.keep(ids)
        if len(self.core) < self.most // 2:
            self.core += new

    def of(self, texts: list[str | None]) -> Iterator[list]:
        """What is kept of the pieces of each text, in order; a few MB of text at a time."""
        at = 0
        while at < len(texts):
            split, chars = [], 0
            while at + len(split) < len(texts) and chars < 2_000_000:
                t = texts[at + len(split)] or ""
                chars += len(t)
                split.append(self._cut(t))
            for plain in (True, False):
                self._learn(set(chain.from_iterable(p for p, kind in split if kind is plain)), plain)
                for k, (pieces, kind) in enumerate(split):
                    if kind is plain:
                        split[k] = list(map(self.known.__getitem__, pieces)), None
            yield from (found for found, _ in split)
            at += len(split)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@lru_cache(maxsize=2)
def shared_codec(vocab_path: str) -> Codec:
    """One codec, and so one bounded cache, for all tasks and groups that a worker process runs."""
    return Codec(vocab_path)


def _safe(text: str, at: int) -> bool:
    """No composition of characters can reach over this cut."""
    left, right = text[at - 1], text[at]
    if right.isascii() and left.isascii():
        return True
    return not unicodedata.combining(right) and unicodedata.category(right)[0] != "M" and not "ᄀ" <= right <= "ᇿ"


def cut(text: str, leaf: int = LEAF_CHARS, at_blanks: bool = True) -> list[tuple[str, bool]]:
    """Halve until no leaf is longer than ``leaf``: (leaf, whether its right edge lies beside a blank)."""
    done, todo = [], [(text, True)]
    while todo:
        t, soft = todo.pop()
        if len(t) <= leaf or len(t) < 4:
            done.append((t, soft))
            continue
        mid, reach = len(t) // 2, max(1, min(leaf // 4, len(t) // 4))
        at = max(t.rfind(" ", mid - reach, mid), t.rfind("\n", mid - reach, mid)) if at_blanks else -1
        blank = at > 0
        if not blank:
            at = mid
            while at > 1 and not _safe(t, at):
                at -= 1
            if at <= 1:  # nothing but combining marks before the middle: such a leaf stays whole
                done.append((t, soft))
                continue
        todo += [(t[at:], soft), (t[:at], blank)]
    return done


def _agree(left: list[tuple[int, int, int]], window: list[tuple[int, int, int]], last: bool) -> tuple[int, int] | None:
    """Indices (in left, in window) of a token in a run that both hold at the same places."""
    places = {x: k for k, x in enumerate(left)}
    run = 0
    for k in range(len(window)) if not last else range(len(window) - 1, -1, -1):
        run = run + 1 if window[k] in places else 0
        if run == _SHARED_RUN:
            return places[window[k]], k
    return None


def join(codec: Codec, a_text: str, a: list, b_text: str, b: list) -> list:
    """Spans of ``a_text + b_text`` from those of its parts, ``a`` and ``b`` (each from 0)."""
    n, w = len(a_text), _FIRST_WINDOW
    b = [(i, s + n, e + n) for i, s, e in b]
    while w < max(n, len(b_text)):
        lo, hi = max(0, n - w), min(n + len(b_text), n + w)
        while 0 < lo < n and not _safe(a_text, lo):
            lo -= 1
        shifted = [(i, s + lo, e + lo) for i, s, e in codec.encode_spans(a_text[lo:] + b_text[: hi - n])]
        tail = [x for x in a if x[1] >= lo and x[2] < n]
        head = [x for x in b if x[2] < hi and x[1] > n]
        inner_left = [x for x in shifted if x[2] < n]
        inner_right = [x for x in shifted if x[1] > n]
        left = (0, -1) if lo == 0 else _agree(tail, inner_left, last=False)
        right = (0, len(shifted)) if hi == n + len(b_text) else _agree(head, inner_right, last=True)
        if left and right:
            if lo == 0:
                start, keep = 0, []
            else:
                t = tail[left[0]]
                keep = a[: a.index(t) + 1]
                start = shifted.index(t) + 1
            if hi == n + len(b_text):
                stop, rest = len(shifted), []
            else:
                u = head[right[0]]
                stop, rest = shifted.index(u), b[b.index(u) :]
            if start <= stop:
                return keep + shifted[start:stop] + rest
        w *= 2
    return codec.encode_spans(a_text + b_text)


def seam(codec: Codec, a_text: str, a: list, b_text: str, b: list) -> tuple[int, list[int], int] | None:
    """(tokens of ``a`` that stay, ids between, first token of ``b`` that stays), or None if that needs more than the two leaves."""
    n, w = len(a_text), _FIRST_WINDOW
    while w < min(n, len(b_text)):
        lo = n - w
        while 0 < lo and not _safe(a_text, lo):
            lo -= 1
        hi = n + w
        if lo == 0:
            return None
        window = [(i, s + lo, e + lo) for i, s, e in codec.encode_spans(a_text[lo:] + b_text[: hi - n])]
        first = next((k for k in range(len(a) - 1, -1, -1) if a[k][1] < lo), -1) + 1
        stop = next((k for k in range(len(b)) if b[k][2] + n >= hi), len(b))
        tail = [x for x in a[first:] if x[2] < n]
        head = [(i, s + n, e + n) for i, s, e in b[:stop] if s > 0]
        left = _agree(tail, [x for x in window if x[2] < n], last=False)
        right = _agree(head, [x for x in window if x[1] > n], last=True)
        if left and right:
            t, u = tail[left[0]], head[right[0]]
            return first + a[first:].index(t) + 1, [i for i, _, _ in window[window.index(t) + 1 : window.index(u)]], b.index((u[0], u[1] - n, u[2] - n))
        w *= 2
    return None


def merge_tree(codec: Codec, leaves: list[tuple[str, bool, list[int] | None]]) -> list[int]:
    """Ids of the whole text from its leaves in order; ids are None where a hard edge asks for spans."""
    out: list[int] = []

    def flush(run: list[tuple[str, list]]) -> None:
        while len(run) > 1:  # pairwise, level by level
            run = [(x[0][0] + x[1][0], join(codec, *x[0], *x[1])) if len(x) == 2 else x[0] for x in (run[i : i + 2] for i in range(0, len(run), 2))]
        out.extend(i for i, _, _ in run[0][1])

    run: list[tuple[str, list]] = []
    for text, soft, known in leaves:
        if soft and not run:
            out.extend(known if known is not None else codec.encode(text))
            continue
        run.append((text, codec.encode_spans(text)))
        if soft:
            flush(run)
            run = []
    if run:
        flush(run)
    return out


def encode_whole(codec: Codec, text: str | None, leaf: int = LEAF_CHARS) -> list[int]:
    """The method within one process, for texts of any length."""
    if not text or len(text) <= leaf:
        return codec.encode(text)
    return merge_tree(codec, [(t, soft, None) for t, soft in cut(text, leaf, codec.drops_blanks)])


def _with_short(part: DataFrame, vocab: str, text_col: str, schema: str, many, name: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = shared_codec(vocab)
        for texts in batches:
            yield pd.DataFrame(list(many(codec, texts.tolist())), columns=columns)

    return part.withColumn(name, run(F.col(text_col)))


def _long(texts: DataFrame, vocab: str, leaf: int, schema: str, shape) -> DataFrame:
    """``texts(key, text)`` of long texts, distinct by key -> ``(key, <schema>)``."""

    rows = materialise(_leaves(texts, vocab, leaf), "bpe-leaves")
    columns = [c.split()[0] for c in schema.split(", ")]

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = shared_codec(vocab)
        for values in batches:
            yield pd.Series([ids.astype("<i4") for ids in codec.pack_many(values.tolist())], dtype=object)

    def merge(key, group: pd.DataFrame) -> pd.DataFrame:
        codec, ids, run = shared_codec(vocab), [], []
        for x in group.sort_values("at").itertuples():
            run.append(x)
            if x.soft:
                if all(r.sound for r in run):
                    ids += [r.ids for r in run]
                else:
                    ids.append(merge_tree(codec, [(r.text, r.soft, None) for r in run]))
                run = []
        return pd.DataFrame([(key[0], *shape(codec, np.concatenate(ids).astype("<u4")))], columns=["key", *columns])

    n = max(8, texts.sparkSession.sparkContext.defaultParallelism * 4)
    easy = rows.where("NOT hard").repartition(n, "key", "at")
    easy = easy.select("key", "at", F.lit(True).alias("soft"), F.lit(True).alias("sound"), F.lit(None).cast("string").alias("text"), encode("text").alias("ids"))
    parts = easy if rows.where("hard").isEmpty() else easy.union(hard_parts(rows.where("hard"), vocab, n))
    return parts.groupBy("key").applyInPandas(merge, "key string, " + schema)


def _leaves(texts: DataFrame, vocab: str, leaf: int) -> DataFrame:
    """``(key, at, text, soft, hard)``: a leaf is hard if either edge lies in unsplit text, soft if its right edge does not."""

    @F.pandas_udf("array<struct<text:string,soft:boolean,hard:boolean>>")
    def leaves(values: pd.Series) -> pd.Series:
        blanks = shared_codec(vocab).drops_blanks

        def of(text: str) -> list[dict]:
            got = cut(text, leaf, blanks)
            before = [True, *(s for _, s in got)]
            return [{"text": x, "soft": s, "hard": not (s and b)} for (x, s), b in zip(got, before)]

        return values.map(of)

    return texts.select("key", F.posexplode(leaves("text")).alias("at", "leaf")).select("key", "at", "leaf.*")


def hard_parts(hard: DataFrame, vocab: str, n: int) -> DataFrame:
    """``(key, at, soft, sound, text, ids)`` of hard leaves: ids that stay and those of the seam behind.

    Every leaf and every seam is a row of its own, dealt over the cluster.  Texts with a leaf
    that is not ``sound`` carry all hard leaves' texts along.
    """
    spans = "ids array<int>, starts array<int>, ends array<int>"

    @F.pandas_udf(spans)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = shared_codec(vocab)
        for values in batches:
            yield pd.DataFrame([tuple(map(list, zip(*codec.encode_spans(t)))) or ([], [], []) for t in values], columns=["ids", "starts", "ends"])

    @F.pandas_udf("stay int, ids array<int>, first int")
    def sewn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = shared_codec(vocab)
        for x in batches:
            out = []
            for r in x.itertuples():
                a, b = (list(zip(*(v.tolist() for v in vs))) for vs in ((r.ai, r.as_, r.ae), (r.bi, r.bs, r.be)))
                out.append(seam(codec, r.at_, a, r.bt, b) or (-1, [], -1))
            yield pd.DataFrame(out, columns=["stay", "ids", "first"])

    coded = hard.repartition(n, "key", "at").withColumn("t", encode("text"))
    coded = materialise(coded.select("key", "at", "soft", "text", "t.*"), "bpe-hard-leaves")
    a = coded.where("NOT soft").select("key", "at", F.col("text").alias("at_"), F.col("ids").alias("ai"), F.col("starts").alias("as_"), F.col("ends").alias("ae"))
    b = coded.select("key", (F.col("at") - 1).alias("at"), F.col("text").alias("bt"), F.col("ids").alias("bi"), F.col("starts").alias("bs"), F.col("ends").alias("be"))
    seams = a.join(b, ["key", "at"]).repartition(n, "key", "at").select("key", "at", sewn(F.struct("at_", "ai", "as_", "ae", "bt", "bi", "bs", "be")).alias("s"))
    seams = materialise(seams.select("key", "at", "s.*"), "bpe-seams")
    behind = seams.select("key", "at", "stay", F.col("ids").alias("between"))
    ahead = seams.select("key", (F.col("at") + 1).alias("at"), "first")
    parts = coded.drop("starts", "ends").join(behind, ["key", "at"], "left").join(ahead, ["key", "at"], "left")
    # Without a seam on a side, that edge of the leaf lies beside a blank or ends the text.
    parts = parts.withColumns({"stay": F.coalesce("stay", F.size("ids")), "first": F.coalesce("first", F.lit(0))})
    parts = parts.withColumn("sound", F.expr("first >= 0 AND first < stay"))
    kept = F.concat(F.slice("ids", F.col("first") + 1, F.col("stay") - F.col("first")), F.coalesce("between", F.array().cast("array<int>")))
    unsound = parts.where("NOT sound").select("key", F.lit(True).alias("unsound")).distinct()
    parts = parts.join(unsound, "key", "left")
    return parts.select("key", "at", "soft", "sound", F.when(F.col("unsound"), F.col("text")).alias("text"), F.when(F.col("sound"), kept).alias("ids"))


def is_long(text_col: str, leaf: int = LEAF_CHARS) -> Column:
    return F.length(F.coalesce(F.col(text_col), F.lit(""))) > leaf


def long_rows(docs: DataFrame, schema: str, shape, vocab: str, text_col: str, leaf: int) -> DataFrame:
    """The rows of ``docs`` with a text longer than a leaf, and the columns of ``schema`` from ``shape(codec, ids)``."""
    names = [c.split()[0] for c in schema.split(", ")]
    keep = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    key = free(docs, "_key")[0]
    keyed = docs.where(is_long(text_col, leaf)).withColumn(key, F.sha2(F.col(text_col), 256))
    texts = keyed.groupBy(F.col(key).alias("key")).agg(F.min(text_col).alias("text"))
    done = materialise(_long(texts, vocab, leaf, schema, shape), "bpe-long").withColumnRenamed("key", key)
    return keyed.join(done, key).select(*[keyed[c] for c in keep], *[done[c] for c in names])


def apply(docs: DataFrame, schema: str, shape, many, vocab_path: str | None = None, text_col: str = "text", leaf: int = LEAF_CHARS) -> DataFrame:
    """``docs`` with the columns of ``schema``, which replace columns of the same names.

    ``many(codec, texts)`` gives the values of texts up to the length of a leaf, ``shape(codec, ids)``
    those of a longer text from the array of its joined ids.
    """
    vocab = vocab_path or vocabulary_path()
    names = [c.split()[0] for c in schema.split(", ")]
    keep = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    out = free(docs, "_bpe")[0]
    short = _with_short(docs.where(~is_long(text_col, leaf)), vocab, text_col, schema, many, out).select(*keep, *[f"{out}.{c}" for c in names])
    return short.unionByName(long_rows(docs, schema, shape, vocab, text_col, leaf))


def encode(docs: DataFrame, vocab_path: str | None = None, text_col: str = "text", leaf: int = LEAF_CHARS) -> DataFrame:
    """``docs`` with ``ids array<int>``."""
    many = lambda codec, texts: ((ids,) for ids in codec.encode_many(texts))
    return apply(docs, "ids array<int>", lambda codec, ids: (ids.tolist(),), many, vocab_path, text_col, leaf)


def decode(coded: DataFrame, vocab_path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``coded`` with ``decoded string``; null ids decode to the empty string."""
    vocab = vocab_path or vocabulary_path()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = shared_codec(vocab)
        for ids in batches:
            yield ids.map(lambda x: "" if x is None else codec.decode([int(i) for i in x]))

    return coded.withColumn("decoded", run(F.col(ids_col)))


def digests(docs: DataFrame, vocab_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF_CHARS) -> DataFrame:
    """``(<id_col>, n_tokens, ids_sha256, decoded_sha256)`` of every whole text."""
    slim = docs.select(id_col, text_col)
    out = apply(slim, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda codec, ids: codec.digest(ids.tolist()), lambda codec, texts: codec.digest_many(texts), vocab_path, text_col, leaf)
    return out.drop(text_col)
