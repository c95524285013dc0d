"""Substring dedup: long spans that a document with a smaller doc_id has too are removed.

Words are runs of characters other than space and 0x09 to 0x0D, unchanged. A window is 50 consecutive
words. Windows are the edges of a De Bruijn graph over words; its nodes are the 49 words that two
windows share.

1. Candidates. Of documents with the same words the least stays in the graph; the others are copies of it.
   Each window's least hash among its runs of 20 words is its mark. Equal windows have equal marks, so only
   windows whose mark occurs in several texts can repeat; the others leave the graph.
2. Compaction. An edge that is preceded, or followed, by different words in different places ends a
   path there. Where it isn't, all occurrences go on alike, so they have the same documents. Such edges
   are found by an aggregation over all occurrences and joined back to the documents that hold them, and
   each document's runs of candidates are cut there. So every piece is a whole nonbranching path: any two
   documents that share a window of it share all of it.
3. Verification. Pieces are compared by the digest of all their words, and each has source coordinates:
   the document and the word where it begins. The source of a piece is its least coordinate. If that is
   in a smaller document, all words of the piece go.

Hashes of 64 bits only choose candidates and cuts: a collision makes a cut too many, or is met by the
digest. A hot passage, a frequent line or a periodic text counts as one edge a document; nothing lists pairs.

Rows without doc_id are no source and stay whole. Rows that repeat a doc_id aren't each other's source;
each is judged by itself. Null texts have no words. Texts of any length are taken whole. Other
columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import chunks, stored
from gridweave.llm.shingles import mix, powers, word_hashes

WINDOW, RUN = 50, 20
#: Windows that are hashed at a time.
BLOCK = 1 << 17
SPACES = "\t\n\x0b\x0c\r"


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = powers.get(len(words))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up)])
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1] + np.uint64(n))


def least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of the n values from each place on."""
    span = 1
    while span * 2 <= n:
        values, span = np.minimum(values[:-span], values[span:]), span * 2
    return np.minimum(values[: len(values) - (n - span)], values[n - span :]) if span < n else values


def windows(words: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the mark of each window."""
    count = max(0, len(words) - window + 1)
    hashes, marks = np.empty(count, np.uint64), np.empty(count, np.uint64)
    for at in range(0, count, BLOCK):
        to = min(at + BLOCK, count)
        own = words[at : to + window - 1]
        hashes[at:to] = rolling(own, window)
        marks[at:to] = least(rolling(own, run), window - run + 1)
    return hashes, marks


def documents_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The word hashes of each text (column words: words with one space between)."""
    texts = [t.encode() for t in batch.column("words").to_pylist()]
    hashes, at = word_hashes(texts, fold=False)
    for i, j in zip(at[:-1], at[1:], strict=True):
        yield hashes[i:j]


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def unsigned(values: list[int] | None) -> np.ndarray:
    return np.array(values or [], np.int64).view(np.uint64)


def normal(text: str = "text") -> Column:
    """The words with one space between. Plain replacements come first, as most texts need no pattern then."""
    spaced = F.coalesce(F.col(text), F.lit(""))
    for c in SPACES:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.trim(F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced))


def marks_of(rows: DataFrame, window: int, run: int) -> DataFrame:
    """A row (text_hash, digest, doc_id) for each row (doc_id, text_hash, words), and rows (text_hash, mark): the different marks of those with doc_id."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks([batch], "words"):
                ids, keys, out, count = part.column("doc_id"), part.column("text_hash").to_numpy(zero_copy_only=False), [], []
                for words, named in zip(documents_of(part), ids.is_valid().to_pylist(), strict=True):
                    found = np.unique(windows(words, window, run)[1]) if named else np.zeros(0, np.uint64)
                    out.append(found)
                    count.append(len(found))
                n = sum(count)
                digests = [hashlib.md5(t.encode(), usedforsecurity=False).digest() for t in part.column("words").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("text_hash"), pa.nulls(len(ids), pa.int64()), ids, pa.array(digests, pa.binary())], names=["text_hash", "mark", "doc_id", "digest"])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, count)), signed(np.concatenate(out)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=["text_hash", "mark", "doc_id", "digest"])

    return rows.select("doc_id", "text_hash", "words").mapInArrow(step, "text_hash long, mark long, doc_id long, digest binary")


def candidates(documents: DataFrame, window: int, run: int, whole: bool) -> DataFrame:
    """doc_id, text_hash, n_words, kept_sha256 (of all words), first (the least doc_id with the same words), marks and words of every row.

    marks: those that other texts have too; null where there are none, and in copies of a smaller document.
    words: null where marks is, unless ``whole``.
    """
    rows = documents.select("doc_id", normal().alias("words")).withColumn("text_hash", F.xxhash64("words"))
    table = stored(marks_of(rows, window, run), "marks")
    marks = table.where("mark is not null").select("text_hash", "mark")
    shared = marks.groupBy("mark").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b")).where("a < b").select("mark")
    held = marks.join(shared, "mark").groupBy("text_hash").agg(F.collect_set("mark").alias("marks"))
    known = table.where("mark is null").groupBy("digest", "text_hash").agg(F.min("doc_id").alias("first")).join(held, "text_hash", "left").select("digest", "first", "marks")
    own = F.when(F.col("doc_id") == F.col("first"), F.col("marks"))
    n = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1).cast("long")
    met = rows.withColumn("digest", F.unhex(F.md5("words"))).join(known, "digest").select("doc_id", "text_hash", n.alias("n_words"), F.sha2("words", 256).alias("kept_sha256"), "first", own.alias("marks"), "words")
    return met if whole else met.withColumn("words", F.when(F.col("marks").isNotNull(), F.col("words")))


def graph(rows: DataFrame, window: int, run: int) -> DataFrame:
    """(text_hash, edge, before, after): the different candidate windows of each document, with the words beside them; 0 where there is none."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks([batch], "words"):
                keys, out, count = part.column("text_hash").to_numpy(zero_copy_only=False), [], []
                for words, shared in zip(documents_of(part), part.column("marks").to_pylist(), strict=True):
                    hashes, marks = windows(words, window, run)
                    at = np.flatnonzero(np.isin(marks, unsigned(shared)))
                    beside = np.concatenate([np.zeros(1, np.uint64), words, np.zeros(1, np.uint64)])
                    found = np.unique(np.stack([hashes[at], beside[at], beside[at + window + 1]], 1), axis=0)
                    out.append(found)
                    count.append(len(found))
                each = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, count)), *(signed(np.ascontiguousarray(each[:, k])) for k in range(3))], names=["text_hash", "edge", "before", "after"])

    return rows.select("text_hash", "words", "marks").mapInArrow(step, "text_hash long, edge long, before long, after long")


def cuts(edges: DataFrame) -> DataFrame:
    """(text_hash, starts, ends): the edges of each document before and after which paths end."""
    beside = edges.groupBy("edge").agg((F.min("before") < F.max("before")).alias("starts"), (F.min("after") < F.max("after")).alias("ends"))
    held = edges.select("text_hash", "edge").join(beside.where("starts or ends"), "edge")
    return held.groupBy("text_hash").agg(*[F.collect_set(F.when(F.col(k), F.col("edge"))).alias(k) for k in ("starts", "ends")])


def pieces(rows: DataFrame, window: int, run: int) -> DataFrame:
    """(digest, doc_id, text_hash, at, n_words): the paths of each document (doc_id, text_hash, words, marks, starts, ends), and all words where one begins."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks([batch], "words"):
                lists = zip(*(part.column(c).to_pylist() for c in ("doc_id", "text_hash", "words", "marks", "starts", "ends")), documents_of(part), strict=True)
                out: list[tuple] = []
                for doc_id, text_hash, text, shared, starts, ends, words in lists:
                    hashes, marks = windows(words, window, run)
                    held = np.isin(marks, unsigned(shared))
                    cut = np.isin(hashes, unsigned(starts))
                    cut[1:] |= ~held[:-1] | np.isin(hashes[:-1], unsigned(ends))
                    cut[:1] = True
                    begin = np.flatnonzero(held & cut)
                    # a piece ends before the next one, or where candidates end
                    stops = np.flatnonzero(np.concatenate([cut | ~held, [True]]))
                    end = stops[np.searchsorted(stops, begin, "right")] + window - 1
                    raw = text.encode()
                    gaps = np.concatenate([[-1], np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), [len(raw)]])
                    places: dict[tuple[bytes, int], list[int]] = {}
                    for i, j in zip(begin.tolist(), end.tolist(), strict=True):
                        places.setdefault((hashlib.md5(raw[gaps[i] + 1 : gaps[j]], usedforsecurity=False).digest(), j - i), []).append(i)
                    out += [(digest, doc_id, text_hash, at, n) for (digest, n), at in places.items()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()), strict=True)], names=["digest", "doc_id", "text_hash", "at", "n_words"])

    return rows.select("doc_id", "text_hash", "words", "marks", "starts", "ends").mapInArrow(step, "digest binary, doc_id long, text_hash long, at array<long>, n_words long")


def traced(documents: DataFrame, window: int, run: int, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows, and the spans of candidates that repeat."""
    rows = stored(candidates(documents, window, run, whole), "candidates")
    marked = rows.where("marks is not null")
    parts = stored(pieces(marked.join(cuts(graph(marked, window, run)), "text_hash", "left"), window, run), "pieces")
    source = parts.groupBy("digest").agg(F.min(F.struct("doc_id", F.get("at", F.lit(0)).alias("start_word"))).alias("source"))
    repeated = parts.join(source, "digest").where(F.col("source.doc_id") < F.col("doc_id"))
    return rows, repeated.select("doc_id", "text_hash", F.explode("at").alias("start_word"), "n_words", F.col("source.doc_id").alias("source_doc_id"), F.col("source.start_word").alias("source_start"))


def is_copy(window: int) -> Column:
    """Whether a smaller document has the same words, as many as a window at least."""
    return F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window), F.lit(False))


def repeated_spans(documents: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, start_word, n_words, source_doc_id, source_start: spans of documents (doc_id, text) whose windows all begin in a smaller document too, with their first source. Spans may overlap."""
    rows, spans = traced(documents, window, run)
    nought = F.lit(0).cast("long")
    copies = rows.where(is_copy(window)).select("doc_id", nought.alias("start_word"), "n_words", F.col("first").alias("source_doc_id"), nought.alias("source_start"))
    return spans.drop("text_hash").unionByName(copies).distinct()


def remove(documents: DataFrame, window: int = WINDOW, run: int = RUN, whole: bool = True) -> DataFrame:
    """doc_id, words (what is left, one space between), n_words, n_removed and kept_sha256 of every row (doc_id, text). Without ``whole`` the words of rows that stay as they are are null."""
    rows, spans = traced(documents, window, run, whole)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks([batch], "words"):
                texts, gone = [], []
                for text, spans in zip(part.column("words").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    words = text.split(" ")
                    kept = np.ones(len(words), bool)
                    for s in spans:
                        kept[s["start_word"] : s["start_word"] + s["n_words"]] = False
                    texts.append(" ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k))
                    gone.append(len(words) - int(kept.sum()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), part.column("n_words"), pa.array(gone, pa.int64())], names=["doc_id", "words", "n_words", "n_removed"])

    listed = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start_word", "n_words")).alias("spans"))
    met = stored(rows.where("marks is not null").join(listed, ["doc_id", "text_hash"], "left"), "spans")
    cut = met.where("spans is not null").select("doc_id", "words", "n_words", "spans").mapInArrow(step, "doc_id long, words string, n_words long, n_removed long")
    columns = ["doc_id", "words", "n_words", "n_removed", "kept_sha256"]
    copy = is_copy(window)
    nought = F.lit(0).cast("long")
    other = rows.where("marks is null").withColumns({"words": F.when(copy, "").otherwise(F.col("words")), "n_removed": F.when(copy, F.col("n_words")).otherwise(nought), "kept_sha256": F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256"))})
    as_they_are = met.where("spans is null").withColumn("n_removed", nought)
    return cut.withColumn("kept_sha256", F.sha2("words", 256)).select(columns).unionByName(as_they_are.select(columns)).unionByName(other.select(columns))


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    return remove(documents, whole=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
