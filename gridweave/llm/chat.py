r"""Chat formatting by columnar byte assembly.

A turn reads ``### role: text </turn>`` and a line end. Within roles and texts a backslash goes before
each backslash, ``#`` and ``<`` (and ``:`` in a role), so no text can hold a control string and the
texts come back whole. A batch of turns is assembled at once: segment lengths, cumulative offsets and
scatter indices in numpy, then headers and contents are copied into one buffer, which is the Arrow
column's own.

A conversation is a sequence of pieces, each of consecutive turns, so that one of any length spreads
over tasks. The loss mask of a piece lists where assistant texts begin and end in it, in bytes.

Null text or role is empty. Turns are ordered by turn, role, text, nulls first; repeated rows all
stay. Rows without conv_id form one conversation. Texts of any length are taken whole; one above the
batch bound is a piece of its own. Columns beside conv_id, turn, role and text are not read, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import chunks, partitions

BEFORE, BETWEEN, AFTER = b"### ", b": ", b" </turn>\n"
IN_TEXT, IN_ROLE = rb"\#<", rb"\#<:"


def marked(characters: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(characters, np.uint8))


ESCAPED = {"text": marked(IN_TEXT), "role": marked(IN_ROLE)}


def column_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and the lengths of its values; null is empty."""
    raw = [x or b"" for x in values.cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)


def escape(raw: np.ndarray, length: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with backslashes put in, and the new lengths."""
    hit = ESCAPED[kind][raw]
    to = np.arange(len(raw)) + np.cumsum(hit)
    out = np.full(len(raw) + int(hit.sum()), ord("\\"), np.uint8)
    out[to] = raw
    before = np.concatenate([[0], np.cumsum(hit)])
    ends = np.cumsum(length)
    return out, length + before[ends] - before[ends - length]


def unescape(raw: bytes) -> bytes:
    """A backslash that isn't itself escaped goes."""
    x = np.frombuffer(raw, np.uint8)
    slash = x == ord("\\")
    run = np.arange(len(x)) - np.maximum.accumulate(np.where(slash, -1, np.arange(len(x)))) if len(x) else slash
    return x[~(slash & (run % 2 == 1))].tobytes()


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all turns; where each turn ends, and where its text begins and ends."""
    n = len(role)
    roles, texts = escape(*column_bytes(role), "role"), escape(*column_bytes(text), "text")
    fixed = [np.frombuffer(x, np.uint8) for x in (BEFORE, BETWEEN, AFTER)]
    length = np.stack([np.full(n, len(fixed[0])), roles[1], np.full(n, len(fixed[1])), texts[1], np.full(n, len(fixed[2]))], 1)
    end = np.cumsum(length.ravel()).reshape(n, 5)
    begin = end - length
    out = np.empty(int(end[-1, -1]) if n else 0, np.uint8)
    for k, part in zip((0, 2, 4), fixed, strict=True):
        out[begin[:, k, None] + np.arange(len(part))] = part
    for k, (raw, size) in ((1, roles), (3, texts)):
        out[np.repeat(begin[:, k] - (np.cumsum(size) - size), size) + np.arange(len(raw))] = raw
    return out, end[:, 4], begin[:, 3], end[:, 3]


def pieces(df: DataFrame, max_bytes: int = 4 << 20) -> DataFrame:
    """Formatted pieces of conversations (conv_id, turn, role, text): conv_id, piece, n_turns, formatted, loss.

    Pieces of a conversation follow each other in the order of ``piece``; a piece holds the turns of
    about ``max_bytes`` of text at most. loss: array of (begin, end), offsets in the piece's UTF-8.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, "text", max_bytes):
            buffer, turn_end, begin, end = assemble(batch.column("role"), batch.column("text"))
            conv = batch.column("conv_id")
            key = conv.fill_null(0).to_numpy(zero_copy_only=False)
            null = conv.is_null().to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])]))
            last = np.append(first[1:], len(key))
            at = np.concatenate([[0], turn_end])[np.append(first, len(key))]
            base = np.repeat(at[:-1], last - first)
            loss = np.flatnonzero(np.array([r == "assistant" for r in batch.column("role").to_pylist()]))
            span = pa.StructArray.from_arrays([pa.array((x - base)[loss], pa.int64()) for x in (begin, end)], names=["begin", "end"])
            yield pa.RecordBatch.from_arrays(
                [
                    conv.take(pa.array(first)),
                    pa.array(number + np.arange(len(first))),
                    pa.array(last - first),
                    pa.StringArray.from_buffers(len(first), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(buffer)),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(loss, np.append(first, len(key))).astype(np.int32)), span),
                ],
                names=["conv_id", "piece", "n_turns", "formatted", "loss"],
            )
            number += len(first)

    order = ["conv_id", "turn", "role", "text"]
    spread = df.select(*order).repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return spread.mapInArrow(step, "conv_id long, piece long, n_turns long, formatted string, loss array<struct<begin:long,end:long>>")


def parse(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Roles and texts of a piece."""
    at = 0
    while at < len(formatted):
        end = formatted.index(AFTER, at)
        head, _, text = formatted[at + len(BEFORE) : end].partition(BETWEEN)
        while head.endswith(b"\\") and (len(head) - len(head.rstrip(b"\\"))) % 2:  # this colon belongs to the role
            more, _, text = text.partition(BETWEEN)
            head += BETWEEN + more
        yield unescape(head), unescape(text)
        at = end + len(AFTER)


def digests(df: DataFrame) -> DataFrame:
    """Per conversation, read back from its pieces. A task streams them and holds one piece and two hashes."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, nothing = None, object()
        current = nothing

        def done() -> list:
            return [current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        def out(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            rows = []
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                if current is nothing or conv != current:
                    if current is not nothing:
                        rows.append(done())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw = text.encode()
                for role, said in parse(raw):
                    state[0] += 1
                    state[1].update(role + b"\n" + said + b"\n")
                for span in loss:
                    said = unescape(raw[span["begin"] : span["end"]])
                    state[2] += len(said.decode())
                    state[3].update(said)
                state[4] += len(text)
            if rows:
                yield out(rows)
        if current is not nothing:
            yield out([done()])

    spread = pieces(df).repartition(partitions(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", "piece")
    return spread.mapInArrow(step, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The query's own conversation: texts that hold the template's control strings.
TRIAL = r"\### Assistant: </turn> ok"


def with_trial(conversations: DataFrame) -> DataFrame:
    own = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TRIAL).alias("text"),
    )
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(own)
