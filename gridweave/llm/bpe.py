"""Byte-level BPE by an index of pair occurrences.

The new words of a chunk lie end to end in one array of symbols. An index maps the rank of each
pair that merges to the positions where it occurs. The ranks are taken in ascending order; all
positions of a rank merge at once, and the pairs that arise left and right of them join the lists of
their own ranks. The ids of words that this worker has seen are kept.

Null and empty texts have no ids. Ids outside the vocabulary raise KeyError when decoded. Texts of any
length are encoded whole; one above the batch bound comes alone. Rows stay one for one, repeated ones
and those without doc_id too. Columns beside the text stay as they are, and one of the name of the
result is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridweave.llm.common import chunks, release

#: The code points with Unicode's White_Space property.
WHITE_SPACE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
SPACE = "".join(map(chr, WHITE_SPACE))
#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Words that a worker knows; when there are more, it forgets those that it has met once.
KNOWN_WORDS = 400_000
#: Bytes of text encoded at a time.
BATCH_BYTES = 4 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [chr(hidden.get(b, b)) for b in range(256)]


class Numbers(dict):
    """Numbers words from 0 as they are first asked for; the new ones gather in ``fresh``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        n = self[word] = len(self)
        return n


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``start``, end to end."""
    ends = np.cumsum(length)
    return flat[np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


class Segments:
    """Cuts texts at single spaces and numbers the words; ``encode_new`` gives the ids of words not yet known.

    A cut is safe where the space stands before a character that isn't white space: no pre-token
    crosses it. A text with any other cut is encoded whole.
    """

    def __init__(self, limit: int = KNOWN_WORDS):
        self.limit = limit
        self.forget()

    def forget(self, again: np.ndarray | None = None) -> None:
        """All words, or all but those of the given numbers."""
        known = list(self.numbers) if again is not None else []
        again = np.zeros(0, np.int64) if again is None or 2 * len(again) > self.limit else again
        start, length = (self.start[again], self.length[again]) if len(again) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.numbers = Numbers()
        self.numbers.update((known[i], n) for n, i in enumerate(again.tolist()))
        real = np.maximum(length, 0)
        self.flat = gathered(self.flat, start, real) if len(again) else np.zeros(0, np.uint32)
        self.start, self.length, self.met = np.cumsum(real) - real, length, np.zeros(len(again), np.int64)

    def encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces end to end, and how many each has."""
        raise NotImplementedError

    def learn(self, fresh: list[str]) -> None:
        safe = np.array([s != "" and (s[0] == " " or not s[0].isspace()) for s in fresh], bool)
        ids, count = self.encode_new([s[1:] if s[0] == " " else f" {s}" for s, good in zip(fresh, safe, strict=True) if good])
        length = np.full(len(fresh), -1)
        length[safe] = count
        real = np.maximum(length, 0)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(real) - real])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        texts = [t or "" for t in texts]
        if len(self.numbers) > self.limit:
            self.forget(np.flatnonzero(self.met > 1))
        number, found = self.numbers.__getitem__, []
        for t in texts:
            parts = t.split(" ")
            parts[0] = f" {parts[0]}"  # no other part holds a space
            found.append(np.fromiter(map(number, parts), np.int32, len(parts)))
        if self.numbers.fresh:
            self.learn(self.numbers.fresh)
            self.numbers.fresh = []
        if not found:
            return []
        word = np.concatenate(found)
        self.met = np.bincount(word, minlength=len(self.length)) + np.pad(self.met, (0, len(self.length) - len(self.met)))
        length = self.length[word]
        ids = gathered(self.flat, self.start[word], np.maximum(length, 0))
        at = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        ends = np.concatenate([[0], np.cumsum(np.maximum(length, 0))])[at]
        odd = np.concatenate([[0], np.cumsum(length < 0)])[at]
        return [self.encode_new([t])[0].astype(np.uint32) if o else ids[i:j] for t, i, j, o in zip(texts, ends, ends[1:], np.diff(odd), strict=False)]


class PairIndexCodec(Segments):
    """Encodes as the vocabulary's own library does without special tokens added, and decodes."""

    def __init__(self, path: str, limit: int = KNOWN_WORDS):
        super().__init__(limit)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        value = {c: b for b, c in enumerate(alphabet)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(value[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.byte_id = np.array([vocab[c] for c in alphabet], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.left, self.right, self.made = left.astype(np.int32), right.astype(np.int32), made
        keys = left << 32 | right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        self.byte_length = np.array([len(p) for p in pieces], np.int64)
        self.known = self.byte_length > 0
        self.byte_start = np.concatenate([[0], np.cumsum(self.byte_length)[:-1]])
        self.flat_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.words = regex.compile(PATTERN)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.opening = {t[0] for t in self.special}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it doesn't merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def merge(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that lie end to end in ``raw``, and where each word's begin; the last entry is their number."""
        n = len(raw)
        sym = self.byte_id[np.frombuffer(raw, np.uint8)]
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[starts] = -1
        after[starts[1:] - 1] = -1
        after[-1] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Index the pairs that begin at these positions."""
            rank = self.ranks(sym[at], sym[after[at]])
            keep = rank >= 0
            rank, at = rank[keep], at[keep]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            edge = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate([[0], edge])].tolist(), np.split(at, edge), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        enter(np.flatnonzero(after >= 0))
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
            a, b = self.left[r], self.right[r]
            at = at[sym[at] == a]
            to = after[at]
            at = at[(to >= 0) & (sym[to] == b)]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # of overlapping pairs the first, third, ... merge
                chained = np.concatenate([[False], at[1:] == after[at[:-1]]])
                begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            sym[at], sym[gone], after[at] = self.made[r], -1, beyond
            some = beyond >= 0
            before[beyond[some]] = at[some]
            back = before[at]
            enter(np.unique(np.concatenate([back[back >= 0], at[some]])))
        alive = sym >= 0
        count = np.concatenate([[0], np.cumsum(alive)])
        return sym[alive], np.append(count[starts], count[-1])

    def encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        find, numbers, special = self.words.findall, Numbers(), {}
        number, found, count = numbers.__getitem__, [], []
        for piece in pieces:
            before = len(found)
            if any(c in piece for c in self.opening) and len(parts := self.apart.split(piece)) > 1:
                for i, part in enumerate(parts):
                    if i % 2:
                        found.append(-1 - special.setdefault(part, self.special[part]))
                    else:
                        found += map(number, find(part))
            else:
                found += map(number, find(piece))
            count.append(len(found) - before)
        ids, at = np.zeros(0, np.int64), np.zeros(1, np.int64)
        if numbers.fresh:
            raw = [w.encode() for w in numbers.fresh]
            ids, at = self.merge(b"".join(raw), np.concatenate([[0], np.cumsum([len(w) for w in raw])[:-1]]).astype(np.int64))
        # special tokens follow the words, each an id of its own
        ids = np.concatenate([ids, np.array(list(special.values()), np.int64)])
        place = {i: k for k, i in enumerate(special.values())}
        at = np.concatenate([at, at[-1] + 1 + np.arange(len(special))])
        word = np.array([x if x >= 0 else len(numbers) + place[-1 - x] for x in found], np.int64) if special else np.array(found, np.int64)
        length = np.diff(at)[word] if len(word) else word
        to = np.concatenate([[0], np.cumsum(length)])
        ends = np.cumsum([0, *count])
        return gathered(ids, at[word], length), np.diff(to[ends])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        if ids.max() >= len(self.known) or not self.known[ids].all():
            raise KeyError("an id is not in the vocabulary")
        return gathered(self.flat_bytes, self.byte_start[ids], self.byte_length[ids]).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@cache
def codec(path: str) -> PairIndexCodec:
    """One for each worker."""
    return PairIndexCodec(path)


def encode(df: DataFrame, text: str = "text", path: str | None = None, out: str = "token_ids") -> DataFrame:
    """Adds the ids of each whole text as array<int>."""
    path = path or default_tokenizer()
    kept = [c for c in df.columns if c != out]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in chunks(batches, text, BATCH_BYTES):
            found = own.encode(batch.column(text).to_pylist())
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), ids], names=[*kept, out])
        release()

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), f"`{out}` array<int>"])
    return df.select(*[f"`{c}`" for c in kept]).mapInArrow(step, schema)


def decode(df: DataFrame, ids: str = "token_ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids; null ids give an empty text."""
    path = path or default_tokenizer()
    kept = [c for c in df.columns if c != out]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.asarray(x.values if x.is_valid else [], np.int64)) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, out])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), f"`{out}` string"])
    return df.select(*[f"`{c}`" for c in kept]).mapInArrow(step, schema)


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: the number of its ids, their digest, and the digest of the text decoded from them."""
    path = path or default_tokenizer()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        number = np.array([str(i) for i in range(len(own.known))], object)
        for batch in chunks(batches, "text", BATCH_BYTES):
            raw = own.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in raw], pa.int64()),
                    pa.array([hashlib.sha256(",".join(number[x].tolist()).encode()).hexdigest() for x in raw]),
                    pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in raw]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select("doc_id", "text").mapInArrow(step, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
