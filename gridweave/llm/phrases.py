"""Phrase collocation mining: word sequences that occur together more often than their parts tell.

Texts are lower-cased in A-Z and split at marks and line ends into pieces, those at spaces and tabs into
words. All counts are per language; rows without language are "und". A phrase has 2 to 5 words and
at least 100 occurrences within pieces, overlapping ones included.

1. Sketch. Each task adds the hashes of all sequences of 1 to 5 words to a count-min sketch of two rows.
   A task's counters stop at 255, sums at the threshold: only whether a cell reaches it matters. Blocks of
   cells are summed where they meet, so a task holds its share of the sketch. What is kept is a bit a cell.
   A sequence can reach the threshold only if its cells in both rows do.
2. Automata. A task takes its texts in shards. The sequences of a shard that the sketch leaves are compiled
   into an Aho-Corasick automaton, each between spaces, so that words match as wholes; pieces are parted by
   a line feed, which no sequence has. The automaton scans the shard and counts every match.
3. Counts leave a shard packed, a row for each bucket of phrases by hash; buckets of all shards are summed by
   text one after the other, and the threshold is applied to the sums. So the sketch and its hashes choose what
   is counted, and never what is returned.
4. Every cut of a phrase into two parts is scored in exact decimals, the lowest score counts. Phrases
   inside a longer one with as many occurrences go.

The sketch has a fixed size, which bounds the memory; the more sequences a cell has, the looser are its bounds and
the more are counted, with the same result. Automata are bounded by SHARD_BYTES, or one longer text.

Null texts are empty. Rows stay apart, repeated ones count again. Texts of any length are read whole. Other
columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import chunks, filesystem, partitions, release, stored, work_path
from gridweave.llm.shingles import combine, mix, piece_hashes

LONGEST, LEAST, TOP = 5, 100, 2000
MARKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z to small letters, tabs to spaces, marks to a byte that no text has.
PLAIN = bytes(255 if b in MARKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
BOUND = b" \xff "
#: Cells of a row of the sketch, a power of two; a task holds a byte for each.
CELLS, ROWS = 1 << 25, 2
BLOCK = 1 << 16
#: Bytes of text that make an automaton.
SHARD_BYTES = 8 << 20
#: Counts are summed in so many buckets at least, and in one for so many bytes of text.
FEWEST_BUCKETS, BUCKET_BYTES = 256, 32 << 20
#: Parts in which a language's phrases are ranked before they meet.
SALTS = 64


def normal(texts: list[str]) -> bytes:
    """The words of all texts with one space between, and bounds between pieces and texts."""
    raw = b"\xff".join(t.encode() for t in texts).translate(PLAIN).replace(b"\xff", BOUND)
    return b" ".join(filter(None, raw.split(b" ")))


class Sequences:
    """The words of a normal text, and the hashes of their sequences within pieces."""

    def __init__(self, text: bytes, lang: str):
        self.text = text
        raw = np.frombuffer(text + b" ", np.uint8)
        self.words, self.start = piece_hashes(raw) if text else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.end = np.append(self.start[1:] - 1, len(text)) if len(self.start) else self.start
        self.inside = raw[self.start] != 255
        self.seed = mix(np.frombuffer(lang.encode().ljust(len(lang.encode()) // 8 * 8 + 8, b"\0"), np.uint64) + np.arange(len(lang.encode()) // 8 + 1, dtype=np.uint64)).sum(dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where sequences of n words begin, and their hashes."""
        last = len(self.words) - n + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = self.inside[:last].copy()
        for k in range(1, n):
            whole &= self.inside[k : last + k]
        at = np.flatnonzero(whole)
        return at, mix(combine(self.words, at, n) + self.seed)


def cells(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each hash in each row."""
    return [((hashes >> np.uint64(32 * row)) & np.uint64(width - 1)).astype(np.int64) for row in range(ROWS)]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Sequences]]:
    """The sequences of each language's texts, so many bytes at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def each() -> Iterator[tuple[str, Sequences]]:
        table = pa.Table.from_batches(held)
        by: dict[str, list[str]] = {}
        for lang, text in zip(table.column("lang").to_pylist(), table.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            yield lang, Sequences(normal(texts), lang)

    for batch in batches:
        for part in chunks([batch], "text"):
            if held and size + part.nbytes > SHARD_BYTES:
                yield from each()
                held, size = [], 0
            held.append(part)
            size += part.nbytes
    if held:
        yield from each()


def buckets_for(documents: DataFrame) -> int:
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(FEWEST_BUCKETS, size // BUCKET_BYTES)


def sketch(documents: DataFrame, width: int, least: int) -> str:
    """Writes (block, bits): whether each cell reaches the threshold. Returns the folder."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((ROWS, width), np.uint8)
        seen = False
        for _, own in shards(batches):
            for n in range(1, LONGEST + 1):
                for row, cell in enumerate(cells(own.of(n)[1], width)):
                    cell.sort()
                    first = np.flatnonzero(np.diff(cell, prepend=-1))
                    times = np.minimum(np.diff(np.append(first, len(cell))), 255)
                    at = cell[first]
                    counts[row, at] = np.minimum(counts[row, at] + times, 255)
                    seen = seen or len(at) > 0
        if seen:
            for k, block in enumerate(counts.reshape(-1, BLOCK)):
                if block.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pa.compress(block.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["block", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                more = np.frombuffer(pa.decompress(raw, BLOCK, "zstd", asbytes=True), np.uint8)
                sums[k] = np.minimum(sums[k] + more.astype(np.int64), least) if k in sums else np.minimum(more.astype(np.int64), least)
        for k, block in sums.items():
            if (block >= least).any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(block >= least).tobytes()], pa.binary())], names=["block", "bits"])

    spark = documents.sparkSession
    path = work_path(spark, "sketch")
    parts = documents.mapInArrow(add, "block int, counts binary").repartition(partitions(spark), "block")
    parts.mapInArrow(total, "block int, bits binary").write.parquet(path)
    return path


@lru_cache(maxsize=1)
def bits_of(path: str, width: int) -> list[np.ndarray]:
    """The bits of each row of the sketch, once a worker."""
    import pyarrow.parquet as pq

    fs, folder = filesystem(path)
    table = pq.read_table(folder, filesystem=fs)
    bits = np.zeros(ROWS * width // 8, np.uint8)
    for k, raw in zip(table.column("block").to_pylist(), table.column("bits").to_pylist(), strict=True):
        bits[k * BLOCK // 8 : (k + 1) * BLOCK // 8] = np.frombuffer(raw, np.uint8)
    return list(bits.reshape(ROWS, -1))


def bounded_below(bits: list[np.ndarray], hashes: np.ndarray, width: int) -> np.ndarray:
    """Whether the sketch's upper bound of each hash reaches the threshold."""
    out = np.ones(len(hashes), bool)
    for row, cell in zip(bits, cells(hashes, width), strict=True):
        out &= (row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def left(own: Sequences, bits: list[np.ndarray], width: int) -> list[str]:
    """The different sequences of a shard that may reach the threshold."""
    out = []
    for n in range(1, LONGEST + 1):
        at, hashes = own.of(n)
        kept = bounded_below(bits, hashes, width)
        _, first = np.unique(hashes[kept], return_index=True)
        at = at[kept][first]
        out += [own.text[i:j].decode() for i, j in zip(own.start[at].tolist(), own.end[at + n - 1].tolist(), strict=True)]
    return out


def count(text: bytes, sequences: list[str]) -> Counter:
    """How often each sequence occurs in a normal text, by an automaton of all of them between spaces."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k, s in enumerate(sequences):
        automaton.add_word(f" {s} ", k)
    if not sequences:
        return Counter()
    automaton.make_automaton()
    return Counter(map(itemgetter(1), automaton.iter(f" {text.replace(BOUND.strip(), b'\n').decode()} ")))


def packed(lang: str, times: dict[str, int], buckets: int) -> pa.RecordBatch:
    """A row for each bucket: phrases in order, and their counts."""
    by: dict[int, list[str]] = {}
    for phrase in sorted(times):
        by.setdefault(zlib.crc32(phrase.encode()) % buckets, []).append(phrase)
    lists = [pa.compress("\n".join(own).encode(), "zstd", asbytes=True) for own in by.values()]
    sizes = [sum(len(p.encode()) + 1 for p in own) - 1 for own in by.values()]
    numbers = [np.array([times[p] for p in own], np.int64).tobytes() for own in by.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(by), pa.int64()), pa.array([lang] * len(by), pa.string()), pa.array(lists, pa.binary()), pa.array(sizes, pa.int64()), pa.array(numbers, pa.binary())],
        names=["bucket", "lang", "phrases", "size", "counts"],
    )


def counts(documents: DataFrame, path: str, width: int, least: int, buckets: int) -> DataFrame:
    """(lang, phrase, a) of all phrases that reach the threshold; the empty phrase has the number of all words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bits_of(path, width)
        for lang, own in shards(batches):
            sequences = left(own, bits, width)
            times = {sequences[k]: n for k, n in count(own.text, sequences).items()}
            yield packed(lang, times | {"": int(own.inside.sum())}, buckets)
        release()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, times in sums.items():
                kept = [(p, n) for p, n in times.items() if n >= least or not p]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kept), pa.string()), pa.array([p for p, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["lang", "phrase", "a"])

        for batch in batches:
            for bucket, lang, phrases, size, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from flush()
                    now, sums = bucket, {}
                own = sums.setdefault(lang, Counter())
                for p, n in zip(pa.decompress(phrases, size, "zstd", asbytes=True).decode().split("\n"), np.frombuffer(numbers, np.int64).tolist(), strict=True):
                    own[p] += n
        yield from flush()

    rows = documents.mapInArrow(scan, "bucket long, lang string, phrases binary, size long, counts binary")
    spread = rows.repartition(partitions(documents.sparkSession), "bucket").sortWithinPartitions("bucket")
    return spread.mapInArrow(total, "lang string, phrase string, a long")


def part(words: str, begin: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, begin, n), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of frequent phrases (lang, phrase, a, n, words): the cut with the lowest score, of those the first."""
    size = F.size("words")
    cuts = frequent.where(size > 1).select("lang", "phrase", "a", "n", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "n", "k", part("words", F.lit(1), F.col("k")).alias("head"), part("words", F.col("k") + 1, size - F.col("k")).alias("tail"))
    of = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    both = cuts.join(of("head", "l"), ["lang", "head"]).join(of("tail", "r"), ["lang", "tail"])
    # a * n * 1000 may pass 64 bits; 38 digits hold it for up to 10 ** 17 words
    exact = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"CAST(CAST({exact('a')} * {exact('n')} AS DECIMAL(35, 0)) * CAST(1000 AS DECIMAL(4, 0)) AS DECIMAL(38, 0)) DIV CAST({exact('l')} * {exact('r')} AS DECIMAL(38, 0))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")
    return both.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))


def contained(frequent: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) inside a longer phrase that has at least so many per cent of its occurrences."""
    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: part("words", i, n))))
    longer = frequent.where(size > 2).select("lang", "a", F.explode(inner).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return frequent.join(most, ["lang", "phrase"]).where(F.col("most") * 100 >= F.col("a") * percent).select("lang", "phrase")


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, percent: int = 100, width: int = CELLS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's first phrases by score, occurrences and text."""
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found = stored(counts(texts, sketch(texts, width, least), width, least, buckets_for(texts)), "phrases")
    total = found.where("phrase = ''").select("lang", F.col("a").alias("n"))
    frequent = found.where("phrase <> ''").join(total, "lang").select("lang", "phrase", "a", "n", F.split("phrase", " ").alias("words"))
    kept = scored(frequent).join(contained(frequent, percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's phrases are ranked in parts first, so that no task sorts all of them
    first = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    ranked = first.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


