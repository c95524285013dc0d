"""Personal data, replaced by format-preserving Feistel pseudonyms.

Found are mail addresses, telephone numbers, IPv4 addresses, payment card numbers, IBANs, social
security numbers, dates, access keys and secrets. Each is checked for its form (octets, Luhn and IBAN
check digits, area codes, the calendar), and left alone where it fails; what is valid is permuted under
a key within the values of its form: a card stays a card with a right check digit, a date stays a date, a
separator stays where it was. A value is taken without its separators, so one number written in two
ways has the same pseudonym, in any document.

A permutation is a balanced Feistel network of eight keyed rounds over the smallest power of four
that holds the form's values, walked until it falls within them again. As any permutation it may leave
a value where it is: one in 73 049 for dates, fewer for numbers, more often for addresses of a few letters.
A secret of any length is moved whole: beyond 255 characters in pieces, each under a key that depends
on what stands before it.

The key is a parameter; ``session_key`` takes it from the session. Null text stays null, with no
findings. Text without findings comes back as it was. A text of any length is searched whole, in time
proportional to its length; one above the batch bound comes alone. Equal values have equal pseudonyms
in all rows, repeated rows stay one for one, columns beside the text stay as they are, and columns of
the names pii_count and pii_kinds are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import warnings
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import merge

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridweave.llm.common import chunks

#: For trials: whoever has it can turn pseudonyms back. A corpus of one's own takes a secret of one's own.
KEY = b"gridweave pseudonyms"
#: Where a session names its own key.
KEY_SETTING = "spark.gridweave.pii.key"
ROUNDS = 8
#: Characters that are moved as one number; what is longer goes in pieces of so many, the last up to twice as long.
PIECE = 128
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


@lru_cache(1 << 16)
def permute(key: bytes, form: str, size: int, value: int) -> int:
    """A keyed permutation of 0 to size - 1, its own for each form."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    about = hashlib.blake2b(form.encode(), digest_size=16).digest()
    own = key if len(key) <= 64 else hashlib.blake2b(key).digest()

    def mixed(right: int, r: int) -> int:
        one = hashlib.blake2b(right.to_bytes(width, "big"), digest_size=min(width, 64), key=own, salt=bytes([r]), person=about).digest()
        # a half of more bits than one digest has is filled by an extendable one
        return int.from_bytes(one if width <= 64 else hashlib.shake_256(one).digest(width), "big") & mask

    def network(x: int) -> int:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            left, right = right, left ^ mixed(right, r)
        return left << half | right

    x = network(value)
    while x >= size:
        x = network(x)
    return x


def moved(key: bytes, form: str, size: int, value: int, valid: Callable[[int], bool] = lambda _: True) -> int:
    """The next value of the permutation's cycle that is valid: itself a permutation of the valid values."""
    x = permute(key, form, size, value)
    while not valid(x):
        x = permute(key, form, size, x)
    return x


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def put(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def characters(key: bytes, form: str, text: str, lower: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    """Each digit, small and capital letter becomes one of its kind; all of a piece are one number in mixed radix."""
    out, before = [], hashlib.blake2b(digest_size=16)
    for i in range(0, max(1, len(text) - PIECE + 1), PIECE):
        piece = text[i:] if i + 2 * PIECE > len(text) else text[i : i + PIECE]
        out.append(piece_moved(key, f"{form}{before.hexdigest() if i else ''}", piece, lower))
        before.update(piece.encode())
    return "".join(out)


def piece_moved(key: bytes, form: str, text: str, lower: str) -> str:
    kinds = ["0123456789", lower, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    of = [next((k for k in kinds if c in k), "") for c in text]
    value, size = 0, 1
    for c, k in zip(text, of, strict=True):
        if k:
            value, size = value * len(k) + k.index(c), size * len(k)
    if size == 1:
        return text
    value = permute(key, f"{form}{''.join(str(kinds.index(k)) if k else '-' for k in of)}", size, value)
    out = []
    for c, k in zip(reversed(text), reversed(of), strict=True):
        if k:
            value, i = divmod(value, len(k))
            c = k[i]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> str:
    """The check digit that follows these."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


#: The first digits of payment cards.
ISSUERS = re.compile(r"[3-6]|2[2-7]")


def card(key: bytes, text: str) -> str | None:
    """A number with a right check digit that begins as cards do: its first two digits stay, and the check digit is right again."""
    d = digits_of(text)
    if not ISSUERS.match(d) or luhn(d[:-1]) != d[-1]:
        return None
    n = len(d) - 3
    inner = d[:2] + str(permute(key, "card", 10**n, int(d[2:-1]))).zfill(n)
    return put(text, inner + luhn(inner))


def phone(key: bytes, text: str) -> str | None:
    """The last ten digits move, what stands before them stays. Where area and exchange begin with 2 to 9 they do so after, elsewhere not both do."""
    d = digits_of(text)
    if len(d) > 13:
        return None
    valid = lambda x: x // 10**9 >= 2 and x // 10**6 % 10 >= 2
    kind = valid(int(d[-10:]))
    return put(text, d[:-10] + str(moved(key, "phone", 10**10, int(d[-10:]), lambda x: valid(x) == kind)).zfill(10))


def address(key: bytes, text: str) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    x = permute(key, "ip", 1 << 32, int.from_bytes(bytes(octets), "big"))
    return ".".join(map(str, x.to_bytes(4, "big")))


def mail(key: bytes, text: str) -> str:
    """The local part moves, with the host's labels before the last two."""
    local, _, host = text.partition("@")
    labels = host.split(".")
    moved_ = characters(key, "mail", "@".join([local, ".".join(labels[:-2])]))
    local, _, front = moved_.partition("@")
    return f"{local}@{'.'.join([front] * (len(labels) > 2) + labels[-2:])}"


def security(key: bytes, text: str) -> str | None:
    """Social security number: area 1 to 899 but 666, group and serial not 0."""
    good = lambda x: 0 < x // 10**6 < 900 and x // 10**6 != 666 and x // 10**4 % 100 and x % 10**4
    x = int(digits_of(text))
    return put(text, str(moved(key, "security", 10**9, x, good)).zfill(9)) if good(x) else None


def date(key: bytes, text: str) -> str | None:
    """Year first, or day first with points, or month first with strokes; years 1900 to 2099. One that is written without leading zeros stays so."""
    a, b, c = (int(x) for x in re.split(r"[-./]", text))
    order = "ymd" if a > 31 else "mdy" if "/" in text and a <= 12 else "dmy"
    part = dict(zip(order, (a, b, c), strict=True))
    try:
        day = datetime.date(part["y"], part["m"], part["d"]).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    size = LAST_DAY - FIRST_DAY + 1
    # a first number above 12 with strokes is a day, and has to be read as one again
    good = lambda x: order != "dmy" or "/" not in text or datetime.date.fromordinal(FIRST_DAY + x).day > 12
    new = datetime.date.fromordinal(FIRST_DAY + moved(key, "date", size, day - FIRST_DAY, good))
    width = 1 if re.search(r"(?<!\d)\d(?!\d)", text) else 2
    put_in = {"y": f"{new.year:04}", "m": f"{new.month:0{width}}", "d": f"{new.day:0{width}}"}
    mark = re.sub(r"\d", "", text)
    return put_in[order[0]] + mark[0] + put_in[order[1]] + mark[1] + put_in[order[2]]


def iban(key: bytes, text: str) -> str | None:
    """Check digits are right before and after."""
    bare = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(bare) <= 34 or number(bare[4:] + bare[:4]) % 97 != 1:
        return None
    account = characters(key, "iban", bare[4:])
    bare = iter(bare[:2] + str(98 - number(account + bare[:2] + "00") % 97).zfill(2) + account)
    return "".join(c if c == " " else next(bare) for c in text)


def secret(key: bytes, text: str) -> str:
    """A hexadecimal one becomes a hexadecimal one; others never do, so that no two secrets share a pseudonym."""
    if not (other := re.compile("[g-zA-Z]")).search(text):
        return characters(key, "secret", text, "abcdef")
    while not other.search(text := characters(key, "secret", text)):
        pass
    return text


#: Kind, what a text must hold for a search to be worth it, pattern (group 1, or all of it, is replaced), replacement.
KINDS: list[tuple[str, str, re.Pattern, Callable[[bytes, str], str | None]]] = [
    ("secret", "AKIA", re.compile(r"(?<![A-Za-z0-9])AKIA([A-Z0-9]{16})(?![A-Za-z0-9])"), secret),
    ("secret", "=", re.compile(r"""(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)["']?\s*[=:]\s*["']?([A-Za-z0-9+/_-]{8,})"""), secret),
    ("mail", "@", re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"), mail),
    ("iban", "", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), iban),
    ("ip", ".", re.compile(r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"), address),
    ("date", "", re.compile(r"(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})(?:(?=T\d\d:?\d\d)|(?![\w/-]|\.\d))"), date),
    ("security", "-", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), security),
    ("phone", "", re.compile(r"(?<![\w.+])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w|[.-]\d)|(?<![\w.])\+\d{11,13}(?!\w)"), phone),
    ("card", "", re.compile(r"(?<![\w-])(?<!\d\.)\d(?:\d{12,18}|\d{3}(?:[ -]\d{4}){3}|\d{3}[ -]\d{6}[ -]\d{5})(?!\w|[.-]\d)"), card),
]
DIGIT = re.compile(r"\d")


def pseudonymise(text: str, key: bytes = KEY) -> tuple[str, Counter]:
    """The text with its findings replaced, and their number by kind. A finding inside an earlier kind's is left alone."""
    found: Counter = Counter()
    if not (DIGIT.search(text) or "@" in text or "=" in text or "AKIA" in text or ":" in text):
        return text, found
    taken: list[tuple[int, int, str]] = []  # in order and apart, so that a search by halves finds what overlaps
    for kind, sign, pattern, change in KINDS:
        if sign not in text and not (sign == "=" and ":" in text):
            continue
        fresh = []
        for m in pattern.finditer(text):
            i, j = m.span(1 if m.lastindex else 0)
            k = bisect_left(taken, (j,))
            if k and taken[k - 1][1] > i:
                continue
            new = change(key, text[i:j])
            if new is not None:
                fresh.append((i, j, new))
        if fresh:
            found[kind] += len(fresh)
            taken = list(merge(taken, fresh))
    if not taken:
        return text, found
    out, at = [], 0
    for i, j, new in taken:
        out += [text[at:i], new]
        at = j
    return "".join([*out, text[at:]]), found


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names; without one the trial key, with a warning."""
    named = spark.conf.get(KEY_SETTING, None)
    if not named:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with the public trial key", stacklevel=2)
    return named.encode() if named else KEY


def apply(df: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """df with its text pseudonymised, and pii_count (long) and pii_kinds (kind=number, by name) beside it."""
    kept = [c for c in df.columns if c not in ("pii_count", "pii_kinds")]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            done = [(None, Counter()) if t is None else pseudonymise(t, key) for t in batch.column(text).to_pylist()]
            columns = [pa.array([t for t, _ in done], pa.string()) if c == text else batch.column(c) for c in kept]
            columns += [pa.array([n.total() for _, n in done], pa.int64()), pa.array([",".join(f"{k}={v}" for k, v in sorted(n.items())) for _, n in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "pii_count", "pii_kinds"])

    fields = [*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), "pii_count long", "pii_kinds string"]
    return df.select(*[f"`{c}`" for c in kept]).mapInArrow(step, ", ".join(fields))
