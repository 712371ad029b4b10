"""Training-order materialisation: every sequence gets a global slot of a keyed permutation.

Texts become token ids and are cut into sequences of ``STRIDE`` ids.  Sequences are numbered
0..N-1, and a keyed Feistel network over the smallest even number of bits that holds N, walked
along its cycle until the value is below N, maps each number to its slot.  Slots are dense and
evenly spread, so range partitions of them are equal whatever the input's skew.  Each
partition writes shards of ``SHARD_SLOTS`` consecutive slots with a fixed stride: slot s lies
in shard ``s // SHARD_SLOTS`` at byte ``(s % SHARD_SLOTS) * STRIDE * id_bytes``, so reading is
sequential and can resume anywhere.

The ids are those of a BPE vocabulary of at most 65,536 tokens, two bytes each (:mod:`.bpe`);
any other encoder and width can be given.  The texts are put in order by id, hash of the text and,
among rows that agree in both, an arbitrary number that spreads them, so that the sequence
numbers do not depend on how the input is split into files or dealt over tasks.  Numbers are given out in two levels: a task packs consecutive texts into packs of
bounded size, the pack table is written once to the shared folder, and running sums over
partitions and over the packs of each give the first number of every pack.  From then on all
numbering reads that table, so lost executors change nothing.

Nulls: a null text counts as empty, and an empty text has no sequences.  Rows with a null id
are written under that null id, after all others; repeated rows are separate sequences, which tie
and may take each other's numbers.  A text of any length is cut into as many sequences as it
needs.  An empty table gives no shards and an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gridloom.llm import bpe
from gridloom.plans.scratch import materialise

STRIDE = 1024
SHARD_SLOTS = 4096
PACK_BYTES = 4 * 1024 * 1024
ROUNDS = 6
#: First numbers of at most this many packs (16 bytes each) are sent to every task.
BROADCAST_PACKS = 200_000
KEY = 0x5EED
#: Shards that one task writes.
SHARDS_PER_TASK = 4
_SHARD = "shard long, first_slot long, n_slots int, payload binary, sha256 string, doc_ids array<long>, seq_nos array<int>, lengths array<int>"


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key & (1 << 64) - 1)) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """Keyed permutation of 0..n-1."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        bits = max(2, (max(1, n) - 1).bit_length())
        self.n, self.half = n, np.uint64((bits + 1) // 2)
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "big") for r in range(rounds)]

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ (_mix(left, k) & self.mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & self.mask)
        return left << self.half | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x, dtype=np.uint64), back)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


#: Characters of text that one task encodes and packs.
PART_CHARS = 64 * 1024 * 1024


class BpeBodies:
    """Ids of a BPE vocabulary, each a number of ``dtype``, which must hold every id."""

    def __init__(self, dtype: str = "uint16", vocab_path: str | None = None, leaf: int = bpe.LEAF_CHARS):
        self.dtype, self.vocab, self.leaf = dtype, vocab_path or bpe.vocabulary_path(), leaf

    def prepared(self, slim: DataFrame) -> DataFrame:
        """``slim`` with ``body``, filled for long texts, whose ``text`` is dropped."""
        short = slim.where(~bpe.is_long("text", self.leaf)).withColumn("body", F.lit(None).cast("binary"))
        dtype = self.dtype
        long = bpe.long_rows(slim, "body binary", lambda codec, ids: (ids.astype(dtype).tobytes(),), self.vocab, "text", self.leaf)
        return short.unionByName(long.withColumn("text", F.lit(None).cast("string")))

    def many(self, texts: list[str | None]) -> list[bytes]:
        return [ids.astype(self.dtype, copy=False).tobytes() for ids in bpe.shared_codec(self.vocab).pack_many(texts)]


class ByteBodies:
    """UTF-8 bytes as ids."""

    dtype = "uint8"

    def prepared(self, slim: DataFrame) -> DataFrame:
        return slim.withColumn("body", F.lit(None).cast("binary"))

    def many(self, texts: list[str | None]) -> list[bytes]:
        return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", encoder=None, stride: int = STRIDE, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Written table ``(part, at, n_seqs, doc_ids, lengths, body)`` of packs of token ids, in order."""
    encoder = encoder or BpeBodies()
    width = np.dtype(encoder.dtype).itemsize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, at, ids, lengths, body, size = TaskContext.get().partitionId(), 0, [], [], [], 0
        press = zstandard.ZstdCompressor(level=1)

        def close() -> pd.DataFrame:
            n = sum(-(-x // stride) for x in lengths)
            row = {"part": part, "at": at, "n_seqs": n, "doc_ids": pd.Series([ids], dtype=object), "lengths": pd.Series([lengths], dtype=object), "body": [press.compress(b"".join(body))]}
            return pd.DataFrame(row)

        for x in batches:
            for i, known, raw in zip(x["id"], x["body"], encoder.many(x["text"].tolist())):
                raw = raw if known is None else known
                if not raw:
                    continue
                ids.append(None if pd.isna(i) else int(i))
                lengths.append(len(raw) // width)
                body.append(raw)
                size += len(raw)
                if size >= pack_bytes:
                    yield close()
                    at, ids, lengths, body, size = at + 1, [], [], [], 0
        if ids:
            yield close()

    text = F.col(text_col)
    # Rows that agree in id and text are dealt by a number of their place in the input, so that no range grows with their count.
    slim = docs.select(F.col(id_col).isNull().alias("last"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("uid"), text.alias("text"))
    total = docs.agg(F.sum(F.length(text))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism * 4, total // PART_CHARS)
    order = ["last", "id", "th", "uid"]
    ordered = encoder.prepared(slim).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text", "body")
    return materialise(ordered.mapInPandas(run, "part int, at int, n_seqs long, doc_ids array<long>, lengths array<int>, body binary"), "order-packs")


def numbered(packs: DataFrame) -> tuple[DataFrame, int]:
    """``packs`` with ``first``, the number of its first sequence, and the count of all sequences."""
    slim = packs.select("part", "at", "n_seqs")
    # One row for each task of the packing stage: far fewer than there are packs or texts.
    parts = slim.groupBy("part").agg(F.sum("n_seqs").alias("n"), F.count("*").alias("packs")).collect()
    starts, total = [], 0
    for r in sorted(parts, key=lambda r: r["part"]):
        starts.append((r["part"], total))
        total += r["n"]
    base = packs.sparkSession.createDataFrame(starts, "part int, base long")
    inside = Window.partitionBy("part").orderBy("at")
    firsts = slim.withColumn("before", F.sum("n_seqs").over(inside) - F.col("n_seqs")).join(base, "part")
    firsts = firsts.select("part", "at", (F.col("base") + F.col("before")).alias("first"))
    if sum(r["packs"] for r in parts) <= BROADCAST_PACKS:
        firsts = F.broadcast(firsts)  # else the packs are shuffled to meet their numbers
    return packs.join(firsts, ["part", "at"]), total


_MOVED = "task int, slots array<long>, doc_ids array<long>, seq_nos array<int>, lengths array<int>, body binary"


def assigned(packs: DataFrame, total: int, key: int = KEY, stride: int = STRIDE, shard_slots: int = SHARD_SLOTS, dtype: str = "uint16") -> DataFrame:
    """Sequences with their slots, those of one pack and one writing task in one row, compressed together."""
    order, width, per_task = Permutation(total, key), np.dtype(dtype).itemsize, shard_slots * SHARDS_PER_TASK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press, expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for x in batches:
            for first, docs, lengths, body in zip(x["first"], x["doc_ids"], x["lengths"], x["body"]):
                raw = expand.decompress(body)
                lengths = np.asarray(lengths, dtype=np.int64)
                n = -(-lengths // stride)
                owner = np.repeat(np.arange(len(n)), n)
                seq = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(np.cumsum(lengths) - lengths, n) + seq * stride
                size = np.minimum(stride, np.repeat(lengths, n) - seq * stride)
                slots = order.slots(first + np.arange(n.sum()))
                task = slots // per_task
                by_task = np.lexsort((slots, task))
                docs = [None if pd.isna(d) else int(d) for d in docs]
                out = []
                for part in np.split(by_task, np.nonzero(np.diff(task[by_task]))[0] + 1):
                    ids = b"".join(raw[a * width : (a + m) * width] for a, m in zip(start[part].tolist(), size[part].tolist()))
                    out.append((int(task[part[0]]), slots[part].tolist(), [docs[o] for o in owner[part].tolist()], seq[part].tolist(), size[part].tolist(), press.compress(ids)))
                yield pd.DataFrame(out, columns=["task", "slots", "doc_ids", "seq_nos", "lengths", "body"])

    return packs.select("first", "doc_ids", "lengths", "body").mapInPandas(run, _MOVED)


def shards(moved: DataFrame, total: int, stride: int = STRIDE, shard_slots: int = SHARD_SLOTS, dtype: str = "uint16") -> DataFrame:
    """Written table of shards, each a run of ``shard_slots`` slots of ``stride`` ids (the last may be shorter).

    A task owns a fixed range of slots, so it lays its sequences straight into a buffer of
    that size, whatever their order of arrival.
    """
    width, per_task = np.dtype(dtype).itemsize, shard_slots * SHARDS_PER_TASK
    tasks = max(1, -(-total // per_task))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expand, base, buffer, meta = zstandard.ZstdDecompressor(), None, None, None
        for x in batches:
            for task, slots, docs, seqs, lengths, body in zip(x["task"], x["slots"], x["doc_ids"], x["seq_nos"], x["lengths"], x["body"]):
                if base is None:
                    base = int(task) * per_task
                    n = min(per_task, total - base)
                    buffer, meta = bytearray(n * stride * width), [None] * n
                ids, at = expand.decompress(body), 0
                for slot, doc, seq, m in zip(slots, docs, seqs, lengths):
                    k = int(slot) - base
                    buffer[k * stride * width : (k * stride + int(m)) * width] = ids[at : at + int(m) * width]
                    at += int(m) * width
                    meta[k] = (None if pd.isna(doc) else int(doc), int(seq), int(m))
        if base is None:
            return
        if None in meta:
            raise ValueError(f"slot {base + meta.index(None)} was not assigned")
        for k in range(0, len(meta), shard_slots):
            docs, seqs, lengths = zip(*meta[k : k + shard_slots])
            payload = bytes(buffer[k * stride * width : (k + len(docs)) * stride * width])
            yield pd.DataFrame({
                "shard": [(base + k) // shard_slots], "first_slot": base + k, "n_slots": len(docs), "payload": [payload], "sha256": hashlib.sha256(payload).hexdigest(),
                "doc_ids": pd.Series([list(docs)], dtype=object), "seq_nos": pd.Series([list(seqs)], dtype=object), "lengths": pd.Series([list(lengths)], dtype=object),
            })

    return materialise(moved.repartitionById(tasks, F.col("task")).mapInPandas(run, _SHARD), "order-shards", "zstd")


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: int = KEY, stride: int = STRIDE, shard_slots: int = SHARD_SLOTS, encoder=None) -> DataFrame:
    encoder = encoder or BpeBodies()
    dtype = encoder.dtype
    packs, total = numbered(pack(docs, id_col, text_col, encoder, stride))
    return shards(assigned(packs, total, key, stride, shard_slots, dtype), total, stride, shard_slots, dtype)


def read(written: DataFrame, from_slot: int = 0, stride: int = STRIDE, shard_slots: int = SHARD_SLOTS, dtype: str = "uint16") -> DataFrame:
    """``(slot, shard, doc_id, seq_no, n_ids, ids)`` from ``from_slot`` on; earlier shards are not read."""
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for shard, first, payload, digest, docs, seq, n in zip(x["shard"], x["first_slot"], x["payload"], x["sha256"], x["doc_ids"], x["seq_nos"], x["lengths"]):
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"shard {shard} is damaged")
                ids = [payload[k * stride * width : (k * stride + m) * width] for k, m in enumerate(n)]
                out = pd.DataFrame({"slot": first + np.arange(len(n)), "shard": shard, "doc_id": pd.array([None if pd.isna(d) else int(d) for d in docs], dtype="Int64"), "seq_no": seq, "n_ids": n, "ids": ids})
                yield out[out["slot"] >= from_slot]

    rows = written.where(F.col("shard") >= from_slot // shard_slots)
    return rows.mapInPandas(run, "slot long, shard long, doc_id long, seq_no int, n_ids int, ids binary")


def layout(docs: DataFrame) -> DataFrame:
    """Write all sequences in training order and read them back: ``(slot, shard, doc_id, seq_no, n_ids, ids_sha256)``."""
    return read(write(docs)).select("slot", "shard", "doc_id", "seq_no", "n_ids", F.sha2("ids", 256).alias("ids_sha256"))
