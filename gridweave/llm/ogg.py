"""Media columns in Ogg: pages, packets, logical streams, time stamps.

A text's bytes become 8-bit samples at 8000 Hz in packets of 576 samples. They form one logical
stream; a second one, interleaved with it, describes it. Reading checks each page's sum, puts packets
together from lacing values across pages, keeps logical streams apart by serial number and takes
times from granule positions.

Null text counts as empty: one packet of bytes 255. Equal texts give equal media. Each stream begins
with its first page and ends with its last, and the number of samples is the one that the second stream
tells; a page with a wrong sum, a short or missing page (the last ones too), a packet without an end or
a missing stream raises ValueError. Rows stay one for one, those without doc_id and repeated ones too. A
text of any length is stored whole; one above the batch bound comes alone. Of other columns, whatever
their names, none is read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import chunks

HEAD = struct.Struct("<4sBBqIIIB")
PCM = struct.Struct("<8sIB")
CONTINUED, FIRST, LAST = 1, 2, 4
SAMPLES, RATE = 576, 8000
SOUND, NOTES = 1, 2
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_sum(page: bytes) -> int:
    """Ogg's CRC (polynomial 04c11db7, most significant bit first, from 0): zlib's with bits reversed."""
    crc = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(REVERSED), "big")


def pages(serial: int, packets: list[bytes], granules: list[int]) -> Iterator[bytes]:
    """The pages of a logical stream; granules: the position after each packet. The first packet has a page of its own."""
    sequence, table, body, position, carried = 0, bytearray(), [], -1, False

    def flush(last: bool) -> bytes:
        nonlocal sequence, table, body, position
        flags = CONTINUED * carried | FIRST * (sequence == 0) | LAST * last
        rest = bytes([len(table)]) + bytes(table) + b"".join(body)
        page = HEAD.pack(b"OggS", 0, flags, position, serial, sequence, 0, len(table)) + rest[1:]
        sequence, table, body, position = sequence + 1, bytearray(), [], -1
        return page[:22] + struct.pack("<I", page_sum(page)) + page[26:]

    for i, (packet, granule) in enumerate(zip(packets, granules, strict=True)):
        lacing = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while lacing:
            if len(table) == 255:
                yield flush(False)
                carried = at > 0
            part, lacing = lacing[: 255 - len(table)], lacing[255 - len(table) :]
            size = sum(part)
            table += part
            body.append(packet[at : at + size])
            at += size
            if lacing:
                yield flush(False)
                carried = True
        position = granule
        if i == 0 or i == len(packets) - 1:
            yield flush(i == len(packets) - 1)
            carried = False


def multiplex(streams: list[tuple[int, list[bytes], list[int]]]) -> bytes:
    """First pages of all streams come first; then a page of each in turn."""
    waiting, out = [pages(*s) for s in streams], []
    while waiting:
        found = [next(w, None) for w in waiting]
        out += [p for p in found if p is not None]
        waiting = [w for w, p in zip(waiting, found, strict=True) if p is not None]
    return b"".join(out)


def demultiplex(raw: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """By serial number: packets, each with the granule position of the page that ends it, or -1 where a later packet ends there too."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    open_: dict[int, list[bytes]] = {}
    expected: dict[int, int] = {}
    ended: set[int] = set()
    at = 0
    while at < len(raw):
        if len(raw) - at < HEAD.size:
            raise ValueError(f"the page at byte {at} is cut short")
        mark, version, flags, granule, serial, sequence, crc, n = HEAD.unpack_from(raw, at)
        table = raw[at + 27 : at + 27 + n]
        start = at + 27 + n
        end = start + sum(table)
        if mark != b"OggS" or version or end > len(raw) or page_sum(raw[at : at + 22] + b"\0\0\0\0" + raw[at + 26 : end]) != crc:
            raise ValueError(f"the page at byte {at} is damaged")
        if sequence != expected.get(serial, 0) or bool(flags & CONTINUED) != (serial in open_) or bool(flags & FIRST) != (sequence == 0):
            raise ValueError(f"a page of stream {serial} is missing before byte {at}")
        if serial in ended:
            raise ValueError(f"the page at byte {at} follows the last one of stream {serial}")
        expected[serial] = sequence + 1
        if flags & LAST:
            ended.add(serial)
        packets, begin = streams.setdefault(serial, []), start
        for size in table:
            start += size
            if size < 255:
                packets.append((b"".join(open_.pop(serial, [])) + raw[begin:start], -1))
                begin = start
        if begin < start:
            open_.setdefault(serial, []).append(raw[begin:start])
        if granule >= 0 and packets:
            packets[-1] = (packets[-1][0], granule)
        at = end
    if open_:
        raise ValueError("a packet has no end")
    if ended != set(streams):
        raise ValueError(f"the last pages of streams {sorted(set(streams) - ended)} are missing")
    return streams


def from_text(raw: bytes) -> bytes:
    """The Ogg form of a text's bytes."""
    whole = raw + b"\xff" * (-len(raw) % SAMPLES or SAMPLES * (not raw))
    packets = [whole[i : i + SAMPLES] for i in range(0, len(whole), SAMPLES)]
    about = json.dumps({"bytes": len(raw), "samples": len(whole)}).encode()
    return multiplex(
        [
            (SOUND, [PCM.pack(b"PCM8\0\0\0\0", RATE, 8), *packets], [0, *range(SAMPLES, len(whole) + 1, SAMPLES)]),
            (NOTES, [b"NOTES\0\0\0", about], [0, 0]),
        ]
    )


def read_media(raw: bytes) -> tuple[int, bytes, float]:
    """Length of the text in bytes, the whole payload, its seconds."""
    streams = demultiplex(raw)
    if set(streams) != {SOUND, NOTES} or len(streams[SOUND]) < 2 or len(streams[NOTES]) != 2:
        raise ValueError("a logical stream is missing")
    (head, _), *sound = streams[SOUND]
    if len(head) != PCM.size or not head.startswith(b"PCM8"):
        raise ValueError("the first packet isn't a head of 8-bit samples")
    _, rate, _ = PCM.unpack(head)
    about, payload = json.loads(streams[NOTES][1][0]), b"".join(p for p, _ in sound)
    if not about["bytes"] <= about["samples"] == len(payload) == sound[-1][1]:
        raise ValueError(f"{len(payload)} samples are there, {about['samples']} were written")
    return about["bytes"], payload, sound[-1][1] / rate


def feature(payload: bytes, seconds: float) -> str:
    """Duration, level, share of sign changes about the middle, and entropy of the samples."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    value = np.arange(256) - 128.0
    level = float(np.sqrt(share @ value**2))
    crossings = float(np.count_nonzero((x[1:] ^ x[:-1]) & 128)) / max(1, len(x) - 1)
    some = share[share > 0]
    return f"seconds={seconds:.4f};rms={level:.4f};crossings={crossings:.4f};entropy={float(-(some * np.log2(some)).sum()):.4f}"


def encode(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and media, the Ogg form of each whole text."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([from_text(x or b"") for x in raw], pa.binary())], names=["doc_id", "media"])

    return df.select("doc_id", F.col(text).alias("text")).mapInArrow(step, "doc_id long, media binary")


def describe(df: DataFrame) -> DataFrame:
    """What the stored bytes of (doc_id, media) hold."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
        + [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column("media").to_pylist():
                n, payload, seconds = read_media(media)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, seconds)))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.mapInArrow(step, fields)
