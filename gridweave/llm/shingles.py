"""Sets of word shingles of whole texts, as 64-bit hashes, for a batch of texts at once in numpy.

Words are runs of bytes other than space and 0x09 to 0x0D, A-Z lower-cased. A text of fewer words than
a shingle has its whole sequence as one; a text without words has none.
"""

from __future__ import annotations

import numpy as np

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that are hashed at a time, or one word where it is longer.
PIECE = 1 << 20
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
_random = np.random.default_rng(20_240_229)
BYTE_VALUE = _random.integers(1, 1 << 63, 256, np.uint64)
FACTOR = np.uint64(0x5851F42D4C957F2D)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))
PLACE = _random.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the factor and of its inverse, as many as the longest piece so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, f)])) for f in (FACTOR, INVERSE))
        return self.up[:n], self.down[:n]


powers = Powers()


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and where each text's begin; the last entry is their number. fold: A-Z count as small letters."""
    together = b" ".join(texts) + b" "
    raw = np.frombuffer(together.translate(LOWER) if fold else together, np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(raw):
        # a piece ends with a space, so that no word is cut
        to = min(at + PIECE, len(raw)) - 1
        while not SPACES[raw[to : to + PIECE]].any():
            to += PIECE
        to += int(SPACES[raw[to : to + PIECE]].argmax()) + 1
        found, start = piece_hashes(raw[at:to])
        hashes.append(found)
        starts.append(start + at)
        at = to
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begin)


def piece_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words in these bytes, which end with a space, and where each word begins."""
    edge = np.diff(np.concatenate([[True], SPACES[raw]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers.get(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[raw] * up)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def combine(hashes: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """One hash of the n words from each start on."""
    out = np.full(len(start), n, np.uint64)
    for k in range(n):
        out += hashes[start + k] * PLACE[k]
    return mix(out)


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, ascending, end to end, and where each text's begin; the last entry is their number."""
    words, at = word_hashes(texts)
    count = np.diff(at)
    each = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    to = np.concatenate([[0], np.cumsum(each)])
    out = np.empty(to[-1], np.uint64)
    full = np.flatnonzero(count >= width)
    place = np.repeat(to[full] - np.concatenate([[0], np.cumsum(each[full])[:-1]]), each[full]) + np.arange(each[full].sum())
    first = np.repeat(at[full] - to[full], each[full]) + place
    out[place] = combine(words, first, width)
    for n in range(1, width):
        short = np.flatnonzero(count == n)
        out[to[short]] = combine(words, at[short], n)
    for i, j in zip(to[:-1].tolist(), to[1:].tolist(), strict=True):
        out[i:j].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[to[:-1][each > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], kept[to]
