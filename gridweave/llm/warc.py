"""WARC archives with a two-level capture index.

Records are written in the order of their reversed-host URL keys, a file per key range. Beside each
archive lies its index: entries (key, page_id, offset, length) in compressed blocks, and a directory
with the first entry of each block. A search takes the archive by its first key, finds the block by
binary search in the directory, the entry by binary search in the block, and reads the record's range.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id
holds the payload; the others are revisits. Null html is an empty payload, a null url an empty key.
Rows that repeat a page_id with the same payload are of the same type. A row without page_id is a
revisit where a page with an id has its payload, else a response. Payloads of any length are stored
whole; one above the batch bound comes alone. Columns beside page_id, url and html are not read, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import chunks, filesystem, partitions, stored, work_path

BLOCK_ENTRIES = 256
NO_ID = -(1 << 63)
ENTRY = struct.Struct("<IqQI")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url) -> F.Column:
    """Host labels in reverse order, then the rest of the url."""
    url = F.coalesce(url, F.lit(""))
    parts = [F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)(.*)$", i) for i in (1, 2)]
    return F.concat(F.array_join(F.reverse(F.split(F.lower(parts[0]), r"\.")), ","), F.lit(")"), parts[1])


def header(lines: list[tuple[str, str]], first: str) -> bytes:
    clean = "".join(f"{k}: {''.join(f'%{ord(c):02X}' if c < ' ' else c for c in v)}\r\n" for k, v in lines)
    return f"{first}\r\n{clean}\r\n".encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record, compressed by itself. A revisit keeps the response's head, with the payload's length, without its payload."""
    http = header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if refers_to is not None else http + payload
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>")]
    lines += [("WARC-Date", "1970-01-01T00:00:00Z")] + [("WARC-Target-URI", url)] * (url is not None) + [("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return gzip.compress(header(lines, "WARC/1.1") + block + b"\r\n\r\n", 1, mtime=0)


def parse(raw: bytes) -> dict:
    """A record's type, page and payload facts; a response's payload is checked against its digest."""
    raw = gzip.decompress(raw)
    head, _, rest = raw.partition(b"\r\n\r\n")
    names = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(names["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    own = names["WARC-Record-ID"][10:-1]
    out = {"page_id": int(own) if own else None, "payload_bytes": size, "payload_digest": names["WARC-Payload-Digest"][5:], "record_type": names["WARC-Type"], "refers_to": None}
    if names["WARC-Type"] == "revisit":
        return out | {"refers_to": int(names["WARC-Refers-To"][10:-1])}
    if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != out["payload_digest"]:
        raise ValueError(f"the payload of page {own} doesn't match its digest")
    return out | {"payload": payload}


def packed(entries: list[tuple[bytes, int, int, int]]) -> bytes:
    return zlib.compress(b"".join(ENTRY.pack(len(k), p, o, n) + k for k, p, o, n in entries))


def unpacked(raw: bytes) -> list[tuple[bytes, int, int, int]]:
    raw, at, out = zlib.decompress(raw), 0, []
    while at < len(raw):
        size, page, offset, length = ENTRY.unpack_from(raw, at)
        at += ENTRY.size
        out.append((raw[at : at + size], page, offset, length))
        at += size
    return out


def write(pages: DataFrame, root: str, min_bytes: int = 0) -> DataFrame:
    """Writes the archives of pages (page_id, url, html) below root; a row per archive: part, first_key, first_page, n_records.

    Files take their final names when they are whole; a task that is run again replaces them.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    first = rows.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = rows.join(stored(first.select("digest", "response"), "digests"), "digest", "left").withColumn("key", url_key(F.col("url")))
    spread = keyed.select("key", "page_id", "url", "payload", "digest", "response").repartitionByRange(partitions(pages.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(root)
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():06d}"
        trial, out, at, block, directory, total, index = f".{context.taskAttemptId()}", None, 0, [], [], 0, None

        def close_block() -> None:
            raw = packed(block)
            directory.append((block[0][0], block[0][1], index.tell(), len(raw)))
            index.write(raw)
            block.clear()

        for batch in chunks(batches, "payload"):
            if out is None:
                fs.create_dir(folder, recursive=True)
                out, index = fs.open_output_stream(f"{name}.warc.gz{trial}", compression=None), fs.open_output_stream(f"{name}.idx{trial}")
            for row in batch.to_pylist():
                page, response = row["page_id"], row["response"]
                refers_to = None if response is None or page == response else response
                raw = record(page, row["url"], row["payload"], base64.b32encode(bytes.fromhex(row["digest"])).decode(), refers_to)
                out.write(raw)
                block.append((row["key"].encode(), NO_ID if page is None else page, at, len(raw)))
                at, total = at + len(raw), total + 1
                if len(block) == BLOCK_ENTRIES:
                    close_block()
        if out is None:
            return
        if block:
            close_block()
        with fs.open_output_stream(f"{name}.dir{trial}") as f:
            f.write(packed(directory))
        for kind, open_ in ((".warc.gz", out), (".idx", index), (".dir", None)):
            if open_ is not None:
                open_.close()
            fs.move(f"{name}{kind}{trial}", f"{name}{kind}")
        yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "first_key": [directory[0][0]], "first_page": [directory[0][1]], "n_records": [total]})

    return spread.mapInArrow(step, "part long, first_key binary, first_page long, n_records long")


class CaptureIndex:
    """Searches the archives below root. parts: (first key, first page, part), in order."""

    def __init__(self, root: str, parts: list[tuple[bytes, int, int]]):
        self.parts, self.root, self.part = parts, root, None
        self.fs, self.folder = filesystem(root)

    def open(self, part: int) -> None:
        if part != self.part:
            name = f"{self.folder}/part-{part:06d}"
            with self.fs.open_input_stream(f"{name}.dir") as f:
                self.directory = unpacked(f.read())
            self.index, self.archive = self.fs.open_input_file(f"{name}.idx"), self.fs.open_input_file(f"{name}.warc.gz")
            self.part, self.at = part, None

    def entries(self, i: int) -> list[tuple[bytes, int, int, int]]:
        if self.at != i:
            _, _, offset, length = self.directory[i]
            self.block, self.at = unpacked(self.index.read_at(length, offset)), i
        return self.block

    def find(self, key: bytes, page_id: int | None) -> list[dict]:
        """The records of a key and page, in the order of the archive."""
        want = (key, NO_ID if page_id is None else page_id)
        p = max(0, bisect.bisect_left(self.parts, want, key=lambda x: x[:2]) - 1)
        out = []
        while p < len(self.parts) and self.parts[p][:2] <= want:
            self.open(self.parts[p][2])
            i = max(0, bisect.bisect_left(self.directory, want, key=lambda x: x[:2]) - 1)
            while i < len(self.directory) and self.directory[i][:2] <= want:
                block = self.entries(i)
                j = bisect.bisect_left(block, want, key=lambda x: x[:2])
                while j < len(block) and block[j][:2] == want:
                    out.append(parse(self.archive.read_at(block[j][3], block[j][2])))
                    j += 1
                i += 1
            p += 1
        return out


def search(keys: DataFrame, root: str, parts: list[tuple[bytes, int, int]]) -> DataFrame:
    """The records of keys (key, page_id): page_id, payload_bytes, payload_digest, record_type, refers_to."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(root, parts)
        for batch in batches:
            found = [r for key, page in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id")), strict=True) for r in index.find(key.encode(), page)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], k) for c, k in zip(names, kinds, strict=True)], names=names)

    spread = keys.dropDuplicates(["key", "page_id"]).repartitionByRange(partitions(keys.sparkSession), "key", "page_id").sortWithinPartitions("key", "page_id")
    return spread.mapInArrow(step, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def write_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives all pages, then finds each of them through the index."""
    spark = pages.sparkSession
    root = work_path(spark, "archives")
    listed = stored(write(pages, root, min_bytes), "archive-list")
    parts = sorted((bytes(r.first_key), r.first_page, r.part) for r in listed.collect())  # as many as archives
    return search(pages.select(url_key(F.col("url")).alias("key"), "page_id"), root, parts)
