"""Token ids in binary files, with document boundaries in Elias-Fano form.

A file holds the ids of the documents of one range of doc_id, in ascending order, end to end, in two
bytes each where the vocabulary allows it, else four; then the boundaries and the document ids as two Elias-Fano sequences, then a footer. A sequence keeps the
low bits of each value packed and the high bits in unary; a sample of every 256th one bit lets
``select`` find a value without a table of 64-bit offsets.

Null text is an empty document: the end id alone. Rows without doc_id come first. Rows that repeat a
doc_id all stay, ordered by text. Texts of any length are encoded whole; one above the batch bound comes
alone. Columns beside doc_id and text are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.bpe import BATCH_BYTES, Numbers, Segments, default_tokenizer, gathered
from gridweave.llm.common import chunks, filesystem, partitions, work_path

MAGIC = b"GWTOKEN1"
SAMPLE = 256
#: Words that a worker knows.
LIBRARY_WORDS = 900_000
#: Documents whose ids are read at a time.
READ_DOCS = 2048


class EliasFano:
    """A non-decreasing sequence of integers from 0 to 2 ** 64 - 1; select gives them modulo 2 ** 64, as signed ones."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values).astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.packbits((values[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((top >> bits) + n + 1, np.uint8)
        high[ones] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def dump(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> EliasFano:
        n, bits, low, high, samples = struct.unpack_from("<QBQQQ", raw)
        at = struct.calcsize("<QBQQQ")
        return cls(n, bits, np.frombuffer(raw, np.uint8, low, at), np.frombuffer(raw, np.uint8, high, at + low), np.frombuffer(raw, "<u4", samples, at + low + high))

    def select(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1: from the sample before i, as far as the one bit of j - 1."""
        if i >= j:
            return np.zeros(0, np.int64)
        first = int(self.samples[i // SAMPLE])
        until = (j - 1) // SAMPLE + 1
        end = int(self.samples[until]) if until < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[first // 8 : end // 8 + 1], bitorder="little")
        bits[: first % 8] = 0
        skip = i - i // SAMPLE * SAMPLE
        high = np.flatnonzero(bits)[skip : skip + j - i] + first // 8 * 8 - np.arange(i, j)
        if not self.low_bits:
            return high
        k = self.low_bits
        raw = np.unpackbits(self.low[i * k // 8 : j * k // 8 + 1], bitorder="little")
        raw = raw[i * k % 8 :][: (j - i) * k].reshape(-1, k).astype(np.uint64)
        return (high.astype(np.uint64) << np.uint64(k) | raw @ (np.uint64(1) << np.arange(k, dtype=np.uint64))).view(np.int64)


class LibraryEncoder(Segments):
    """The tokenizers library, over the words that this worker hasn't seen."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(LIBRARY_WORDS)
        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]  # a character stands for a byte
        self.id_bytes = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.library.no_truncation()
        self.library.no_padding()

    def encode_each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces, where each piece's begin, and how many there are.

        Words of a space and letters go to the library as one text: each is a pre-token there too, and
        the lengths of the tokens in bytes tell where its own end.
        """
        start, count = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        plain = np.array([p[:1] == " " and p[1:].isalpha() for p in pieces], bool)
        found = self.library.encode_batch_fast(["".join(p for p, x in zip(pieces, plain, strict=True) if x)], add_special_tokens=False)
        together = np.array(found[0].ids, np.int64)
        ends = np.cumsum([len(p.encode()) for p, x in zip(pieces, plain, strict=True) if x])
        at = np.searchsorted(np.cumsum(self.bytes_of[together]), ends, "right")
        start[plain] = np.concatenate([[0], at[:-1]]) if len(at) else at
        count[plain] = np.diff(at, prepend=0)
        found = self.library.encode_batch_fast([p for p, x in zip(pieces, plain, strict=True) if not x], add_special_tokens=False)
        alone = np.array([len(e.ids) for e in found], np.int64)
        start[~plain] = len(together) + np.cumsum(alone) - alone
        count[~plain] = alone
        return np.concatenate([together, np.fromiter((i for e in found for i in e.ids), np.int64, alone.sum())]), start, count

    def encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A mark after a letter is a pre-token of its own, so words that differ in it alone are encoded once."""
        numbers = Numbers()
        number, stems, marks = numbers.__getitem__, [], []
        for p in pieces:
            split = len(p) > 2 and p[-1] in ".,;:!?" and p[-2].isalpha()
            stems.append(number(p[:-1] if split else p))
            marks.append(number(p[-1] if split else ""))
        pairs = np.array([stems, marks], np.int64).T
        ids, start, count = self.encode_each(numbers.fresh)
        length = count[pairs]
        return gathered(ids, start[pairs.ravel()], length.ravel()), length.sum(1)


@cache
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write(df: DataFrame, root: str, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Writes the files of df (doc_id, text) below root; a row per file: part, file, n_docs, n_ids.

    A file takes its final name when it is whole, and a task that is run again replaces it.
    """
    path = path or default_tokenizer()
    end = np.uint32(end_id)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(root)
        context = TaskContext.get()
        part, own = context.partitionId(), encoder(path)
        name, counts, doc_ids, nulls = f"{folder}/part-{part:06d}.gwt", [], [], 0
        trial = f"{name}.{context.taskAttemptId()}"
        out = None
        for batch in chunks(batches, "text", BATCH_BYTES):
            if out is None:
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(trial)
            found = [np.append(x, end) for x in own.encode(batch.column("text").to_pylist())]
            out.write(np.concatenate(found).astype(f"<u{own.id_bytes}").tobytes())
            counts.append(np.array([len(x) for x in found], np.int64))
            nulls += batch.column("doc_id").null_count
            doc_ids.append(batch.column("doc_id").drop_null().to_numpy(zero_copy_only=False))
        if out is None:
            return
        ends, keys = np.cumsum(np.concatenate(counts)), np.concatenate(doc_ids)
        base = int(keys[0]) if len(keys) else 0
        bounds, docs = EliasFano.build(ends).dump(), EliasFano.build(keys.view(np.uint64) - np.int64(base).view(np.uint64)).dump()
        footer = json.dumps({"n_docs": len(ends), "n_ids": int(ends[-1]), "nulls": nulls, "base": base, "id_bytes": own.id_bytes, "bounds": len(bounds), "docs": len(docs)}).encode()
        out.write(bounds + docs + footer + struct.pack("<I", len(footer)) + MAGIC)
        out.close()
        fs.move(trial, name)
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{root}/part-{part:06d}.gwt"], "n_docs": [len(ends)], "n_ids": [int(ends[-1])]})

    spread = df.select("doc_id", "text").repartitionByRange(partitions(df.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return spread.mapInArrow(step, "part long, file string, n_docs long, n_ids long")


class TokenFile:
    """One file, read in ranges."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.f = fs.open_input_file(path)
        size = self.f.size()
        (n,) = struct.unpack("<I", self.f.read_at(12, size - 12)[:4])
        if self.f.read_at(8, size - 8) != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        at = size - 12 - n
        foot = json.loads(self.f.read_at(n, at))
        self.n_docs, self.nulls, self.base, self.id_bytes = foot["n_docs"], foot["nulls"], foot["base"], foot["id_bytes"]
        self.docs = EliasFano.load(self.f.read_at(foot["docs"], at - foot["docs"]))
        self.bounds = EliasFano.load(self.f.read_at(foot["bounds"], at - foot["docs"] - foot["bounds"]))

    def offsets(self, i: int, j: int) -> np.ndarray:
        """Where documents i to j - 1 begin, and where the last ends."""
        return np.concatenate([[0], self.bounds.select(0, j)]) if i == 0 else self.bounds.select(i - 1, j)

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        nulls = max(0, min(j, self.nulls) - i)
        return [None] * nulls + (self.docs.select(max(0, i - self.nulls), max(0, j - self.nulls)) + self.base).tolist()

    def ids(self, offsets: np.ndarray) -> np.ndarray:
        raw = self.f.read_at(int(offsets[-1] - offsets[0]) * self.id_bytes, int(offsets[0]) * self.id_bytes)
        return np.frombuffer(raw, f"<u{self.id_bytes}").astype("<u4")


def read(files: DataFrame) -> DataFrame:
    """Per document of the files (part, file, n_ids): doc_id, start, n_tokens, ids_crc32."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                own = TokenFile(uri)
                for i in range(0, own.n_docs, READ_DOCS):
                    j = min(i + READ_DOCS, own.n_docs)
                    at = own.offsets(i, j)
                    raw, rel = own.ids(at).tobytes(), ((at - at[0]) * 4).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own.doc_ids(i, j), pa.int64()),
                            pa.array(at[:-1] + before),
                            pa.array(np.diff(at)),
                            pa.array([zlib.crc32(raw[a:b]) for a, b in zip(rel, rel[1:], strict=False)], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0).cast("long"))).select("file", "before")
    return placed.repartition(partitions(files.sparkSession), "file").mapInArrow(step, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(df: DataFrame, path: str | None = None) -> DataFrame:
    spark = df.sparkSession
    root, listed = work_path(spark, "token-files"), work_path(spark, "token-list")
    write(df, root, path).write.parquet(listed)
    return read(spark.read.schema("part long, file string, n_docs long, n_ids long").parquet(listed))
