"""WARC records in seekable Zstandard bundles.

Records are grouped into frames of bounded size, every frame compressed on its own; a bundle
is a run of frames followed by the seek table of the seekable format (a skippable frame that
lists the sizes of all frames), so a record is read by decompressing one frame.  An index maps
record identifiers to bundle, frame and offset in the frame's content.

A bundle is one binary value of a table, written and read by Spark alone: any store that Spark
reaches will do, and a lost executor's bundles are written again.  The bytes of a value are a
complete ``.warc.zst`` file.

Of records with equal payloads the one with the smallest id is a response, the others are
revisits that refer to it.  Nulls: a null payload counts as empty; a null id is larger than
any other, is written without an identifier of its own and can't be looked up.  Repeated rows
with the smallest id are all responses.  A payload of any length is one record, in a frame of its
own if it is longer than one.  An empty table gives no bundles and no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from gridloom.plans.scratch import materialise

FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 4 * 1024 * 1024
LEVEL = 3
#: Payloads of more than one in this many of the pages that share theirs are looked up by broadcast, so fewer than this many.
HOT_SHARE = 10_000
# Magic numbers of the seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload but its digest and length."""
    revisit = refers_to is not None
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Date", _DATE)]
    if page_id is not None:
        head += [("WARC-Record-ID", record_id(page_id)), ("X-Page-ID", str(page_id))]
    if url:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    head += [("WARC-Payload-Digest", "sha1:" + payload_digest(payload)), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode() + block + b"\r\n\r\n"


def read_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, payload) of the records in a frame's content."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        block = content[end + 4 : end + 4 + size]
        yield at, head, block[block.index(b"\r\n\r\n") + 4 :]
        at = end + 4 + size + 4


class Bundle:
    """Collects frames and their seek table."""

    def __init__(self):
        self.body, self.frames = io.BytesIO(), []

    def add(self, content: bytes) -> None:
        packed = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True).compress(content)
        self.frames.append((len(packed), len(content)))
        self.body.write(packed)

    def finish(self) -> bytes:
        entries = b"".join(struct.pack("<II", c, d) for c, d in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return self.body.getvalue() + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, content size) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, table = 0, []
    for k in range(n):
        c, d = struct.unpack_from("<II", bundle, len(bundle) - 9 - (n - k) * width)
        table.append((at, c, d))
        at += c
    return table


def read_frame(bundle: bytes, frame: int) -> bytes:
    at, c, d = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + c], max_output_size=d)


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bundle, records, size, index, total = Bundle(), [], 0, [], 0

    def close() -> pd.DataFrame:
        name = hashlib.sha256(body := bundle.finish()).hexdigest()
        rows = [{"page_id": p, "frame": f, "at": a} for p, f, a in index]
        return pd.DataFrame({"bundle": [name], "n_frames": [len(bundle.frames)], "n_records": [len(index)], "body": [body], "records": pd.Series([rows], dtype=object)})

    for x in batches:
        for p, url, html, refers in zip(x["page_id"], x["url"], x["html"], x["refers_to"]):
            p, refers = None if pd.isna(p) else int(p), None if pd.isna(refers) else int(refers)
            record = write_record(p, url, (html or "").encode("utf-8", "surrogatepass"), refers)
            index.append((p, len(bundle.frames), size))
            records.append(record)
            size += len(record)
            total += len(record)
            if size >= FRAME_BYTES:
                bundle.add(b"".join(records))
                records, size = [], 0
                if total >= BUNDLE_BYTES:
                    yield close()
                    bundle, index, total = Bundle(), [], 0
    if records:
        bundle.add(b"".join(records))
    if index:
        yield close()


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, html, refers_to)``: the smallest id with an equal payload, null for that one itself."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("html"))
    slim = p.where(F.octet_length("html") >= min_bytes).select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"))
    firsts = slim.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialise(firsts, "equal-payloads")
    # Payloads of a large share of the pages meet them by broadcast, fewer than HOT_SHARE whatever the data; those pages pass the join under keys of their own.
    shared = firsts.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_SHARE > shared
    hot = F.broadcast(firsts.where(is_hot).select("sha", F.col("first").alias("hot")))
    keyed = p.withColumn("sha", F.sha1(F.col("html").cast("binary"))).join(hot, "sha", "left")
    keyed = keyed.withColumn("k", F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    keyed = keyed.join(firsts.where(~is_hot).select(F.col("sha").alias("k"), "first"), "k", "left").withColumn("first", F.coalesce("hot", "first"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return keyed.select("page_id", "url", "html", F.when(again, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Bundles of all pages as a table ``(bundle, n_frames, n_records, body, records)`` in the shared folder."""
    rows = with_revisits(pages, min_bytes=min_bytes, **columns)
    schema = "bundle string, n_frames int, n_records int, body binary, records array<struct<page_id:long,frame:int,at:int>>"
    return materialise(rows.mapInPandas(_pack, schema), "warc")


def index(bundles: DataFrame) -> DataFrame:
    """``(record_id, page_id, bundle, frame, at)``: where each record starts within its frame's content."""
    rows = bundles.select("bundle", F.explode("records").alias("r")).select("bundle", "r.*").where("page_id IS NOT NULL")

    @F.pandas_udf("string")
    def name(ids: pd.Series) -> pd.Series:
        return ids.map(record_id)

    return rows.select(name("page_id").alias("record_id"), "page_id", "bundle", "frame", "at")


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _row(head: dict[str, str], payload: bytes, keep: bool) -> tuple:
    revisit = head["WARC-Type"] == "revisit"
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (payload_digest(payload) != digest or len(payload) != int(head["X-Payload-Length"])):
        raise ValueError("payload does not match its digest")
    page, refers = head.get("X-Page-ID"), head.get("X-Refers-To-Page")
    return (page and int(page), head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), digest, head["WARC-Type"], refers and int(refers), payload if keep and not revisit else None)


def _frame_of(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _READ.split(", ")])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read(bundles: DataFrame, payloads: bool = False) -> DataFrame:
    """All records of the bundles, frame by frame, payloads checked against their digests."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for body in x["body"]:
                for frame in range(len(seek_table(body))):
                    yield _frame_of([_row(head, payload, payloads) for _, head, payload in read_records(read_frame(body, frame))])

    return bundles.select("body").mapInPandas(scan, _READ)


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records of ``wanted(record_id)`` with payloads; only their frames are decompressed."""
    places = index(bundles).join(wanted.select("record_id").distinct(), "record_id")
    # One row for each bundle, so that its body moves once however many of its records are wanted.
    per = places.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("frame", "at"))).alias("places"))
    rows = per.join(bundles.select("bundle", "body"), "bundle").select("body", "places")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for body, places in zip(x["body"], x["places"]):
                last, content = None, b""
                for place in places:
                    if place["frame"] != last:
                        last, content = place["frame"], read_frame(body, place["frame"])
                    _, head, payload = next(read_records(content[place["at"] :]))
                    yield _frame_of([_row(head, payload, True)])

    return rows.mapInPandas(scan, _READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read the archive back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``."""
    return read(write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
