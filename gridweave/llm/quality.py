"""A quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte has a learned
embedding; learned filters see twelve bytes, every four bytes, and beside them how often the eight
bytes at hand recur in the chunk. Each filter's responses are max-pooled over the chunk; a text's
greatest and mean responses over its chunks are combined into one probability.

It learns from a bounded sample of labelled rows, those first in the order of a hash of doc_id: at most
``TRAIN_ROWS`` of them, and so many that their texts have ``TRAIN_BYTES`` bytes together; never from
held-out rows. Their texts are seen whole, a batch of chunks at a time. Of several labels of a doc_id the greatest counts, of
several texts the least. A share of the good texts is seen as passages of some words. Text is its only input.

Every whole text gets a score, whatever its length; null text counts as empty, and equal texts have
equal scores. Without labelled rows every score is 0.5. Rows stay one for one, those without doc_id and
repeated ones too; columns beside the text stay as they are, one of the score's name is replaced. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import chunks, release

TRAIN_ROWS, TRAIN_BYTES = 4000, 128 << 20
#: Chunks that are rows at a time.
ROWS = 128
THRESHOLD = 0.3
BLOCK, WIDTH, EMBEDDING, FILTERS = 4, 3, 4, 16
CHUNK_BLOCKS, STEP_BLOCKS = 512, 496
ROW = (CHUNK_BLOCKS + WIDTH - 1) * BLOCK
SLOTS = 4096
EPOCHS, BATCH, RATE = 12, 64, 0.02
#: In training, this share of the good texts is seen as a passage of some words, so that shortness is no sign of poor quality.
CROPPED, LEAST_CROP, MOST_CROP = 0.35, 12, 400


def places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, where in them each chunk begins, how many bytes of it are text, and each chunk's text."""
    size = np.array([len(t) for t in texts], np.int64)
    step, overlap = STEP_BLOCKS * BLOCK, (CHUNK_BLOCKS - STEP_BLOCKS) * BLOCK
    count = np.maximum(1, -(-(size - overlap) // step))
    owner = np.repeat(np.arange(len(texts)), count)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * step
    length = np.minimum(size[owner] - start, CHUNK_BLOCKS * BLOCK)
    flat = np.frombuffer(b"".join(texts) + bytes(ROW), np.uint8)
    return flat, (np.cumsum(size) - size)[owner] + start, length, owner


def rows_of(flat: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Chunks as rows of bytes, zero beyond their length."""
    rows = flat[np.minimum(at[:, None] + np.arange(ROW), len(flat) - 1)]
    rows[np.arange(ROW) >= length[:, None]] = 0
    return rows


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks as rows of bytes, how many bytes of each row are text, and each chunk's text."""
    flat, at, length, owner = places(texts)
    return rows_of(flat, at, length), length, owner


def recurrence(rows: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each block, how often the eight bytes that begin in it recur in the chunk, from 0 to 1."""
    eight = np.lib.stride_tricks.sliding_window_view(rows, 8, axis=1).view("<u8")[..., 0]
    slot = ((eight * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64) + np.arange(len(rows))[:, None] * SLOTS
    full = np.arange(slot.shape[1]) <= length[:, None] - 8
    seen = np.bincount(slot[full], minlength=len(rows) * SLOTS)
    level = np.where(full, np.minimum(seen[slot], 17) - 1, 0).astype(np.float32) / 16
    level = np.pad(level, ((0, 0), (0, ROW - level.shape[1])))
    return level.reshape(len(rows), -1, BLOCK).max(2)


class Network:
    """weights: embedding, filters (one matrix for each of WIDTH blocks), filter offsets, outputs, output offset."""

    def __init__(self, seed: int = 1):
        random = np.random.default_rng(seed)
        inputs = BLOCK * EMBEDDING + 1
        self.p = {
            "embedding": random.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
            "filters": random.normal(0, (inputs * WIDTH) ** -0.5, (WIDTH, inputs, FILTERS)).astype(np.float32),
            "offsets": np.zeros(FILTERS, np.float32),
            "outputs": np.zeros(2 * FILTERS, np.float32),
            "bias": np.zeros(1, np.float32),
        }

    def respond(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks' inputs, and each filter's response at each block."""
        p, n = self.p, len(rows)
        x = np.empty((n, ROW // BLOCK, BLOCK * EMBEDDING + 1), np.float32)
        x[..., :-1] = p["embedding"][rows].reshape(n, ROW // BLOCK, -1)
        x[..., -1] = recurrence(rows, length)
        flat = x.reshape(-1, x.shape[2])
        h = sum((flat @ p["filters"][k]).reshape(n, -1, FILTERS)[:, k : k + CHUNK_BLOCKS] for k in range(WIDTH))
        h += p["offsets"]
        h[np.arange(CHUNK_BLOCKS) >= np.maximum(1, -(-length // BLOCK))[:, None]] = -np.inf
        return x, h

    def combine(self, pooled: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """A text's greatest and mean pooled responses."""
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        count = np.diff(np.append(first, len(owner)))
        return np.concatenate([np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / count[:, None]], 1)

    def score(self, texts: list[bytes], batch: int = ROWS) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        flat, at, length, owner = places(texts)
        each = (slice(i, i + batch) for i in range(0, len(at), batch))  # so that a long text's chunks aren't all rows at once
        pooled = np.concatenate([np.maximum(self.respond(rows_of(flat, at[k], length[k]), length[k])[1].max(1), 0) for k in each])
        logit = self.combine(pooled.astype(np.float64), owner) @ self.p["outputs"].astype(np.float64) + float(self.p["bias"][0])
        return np.round(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 6)

    def peaks(self, texts: list[bytes], batch: int = ROWS) -> tuple[np.ndarray, ...]:
        """Each chunk's text, its pooled responses, and the inputs and bytes that each filter has at its greatest response."""
        flat, at, length, owner = places(texts)
        parts = []
        for i in range(0, len(at), batch):
            k = slice(i, i + batch)
            rows = rows_of(flat, at[k], length[k])
            x, h = self.respond(rows, length[k])
            best = h.argmax(1)
            one = np.arange(len(x))[:, None, None]
            pooled = np.maximum(np.take_along_axis(h, best[:, None], 1)[:, 0], 0)
            parts.append((pooled, x[one, best[:, :, None] + np.arange(WIDTH)], rows[one, best[:, :, None] * BLOCK + np.arange(WIDTH * BLOCK)]))
        return owner, *(np.concatenate(p) for p in zip(*parts, strict=True))

    def gradient(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss; through a maximum only the greatest response has one."""
        p = self.p
        owner, pooled, seen, byte = self.peaks(texts)  # seen: chunk, filter, block, input
        vector = self.combine(pooled, owner)
        delta = (1 / (1 + np.exp(-np.clip(vector @ p["outputs"] + p["bias"], -30, 30))) - labels) / len(labels)
        delta *= np.where(labels > 0, 1, (1 - THRESHOLD) / THRESHOLD)  # even odds then fall on the threshold
        back = delta[:, None] * p["outputs"]
        count = np.bincount(owner)
        at_top = (pooled == vector[owner, :FILTERS]) & (pooled > 0)
        to_pool = (back[owner, :FILTERS] * at_top + back[owner, FILTERS:] / count[owner, None]) * (pooled > 0)
        out = {"outputs": vector.T @ delta, "bias": np.array([delta.sum()]), "offsets": to_pool.sum(0)}
        out["filters"] = np.einsum("cf,cfki->kif", to_pool, seen)
        out["embedding"] = np.zeros_like(p["embedding"])
        to_input = np.einsum("cf,kif->cfki", to_pool, p["filters"])[..., :-1].reshape(*pooled.shape, WIDTH * BLOCK, EMBEDDING)
        np.add.at(out["embedding"], byte, to_input)
        return out

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> Network:
        """Adam; as many passes as give small samples 300 steps too."""
        random = np.random.default_rng(seed)
        epochs = max(epochs, min(40, -(-300 * BATCH // max(1, len(texts)))))
        mean, square, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            order = random.permutation(len(texts))
            for i in range(0, len(order), BATCH):
                pick, t = order[i : i + BATCH], t + 1
                rate = RATE * (1 - 0.9 * epoch / epochs)
                seen = [cropped(texts[j], random) if labels[j] and random.random() < CROPPED else texts[j] for j in pick]
                for k, g in self.gradient(seen, labels[pick]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def cropped(text: bytes, random: np.random.Generator) -> bytes:
    """A passage of whole words, short ones as often as long ones in proportion."""
    size = int(np.exp(random.uniform(np.log(LEAST_CROP), np.log(MOST_CROP))))
    if len(text) <= size:
        return text
    start = int(random.integers(0, len(text) - size))
    start = text.find(b" ", start) + 1 if start else 0
    end = text.find(b" ", start + size)
    return text[start:] if end < 0 else text[start:end]


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Network | None:
    """From labels (doc_id, quality) outside the held-out fold; None where there are none."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    order = F.xxhash64("doc_id")
    chosen = usable.orderBy(order, "doc_id").limit(rows)
    texts = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    each = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    before = F.sum(F.octet_length("text")).over(Window.orderBy(order, "doc_id"))  # of at most ``rows`` rows
    found = each.withColumn("bytes", before).where(F.col("bytes") <= most_bytes).orderBy("doc_id").select("text", "label").collect()  # at most most_bytes
    if not found:
        return None
    return Network().fit([r.text.encode() for r in found], np.array([float(r.label) for r in found]))


def score(documents: DataFrame, model: Network | None, out: str = "score") -> DataFrame:
    """documents with the probability of label 1 beside them."""
    kept = [c for c in documents.columns if c != out]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 2 << 20):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            found = np.full(len(texts), 0.5) if model is None else model.score(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.float64())], names=[*kept, out])
        release()

    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept), f"`{out}` double"])
    return documents.select(*[f"`{c}`" for c in kept]).mapInArrow(step, schema)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents."""
    scored = score(documents.select("doc_id", "text"), train(documents, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
