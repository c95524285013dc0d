import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gridweave.llm import repeats
from gridweave.llm.common import bounded

SCHEMA = "doc_id long, text string"


def plain(rows, window=50):
    """The contract: every window against every document."""
    words = [(key, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for key, text in rows]
    first: dict[tuple, int] = {}
    for key, w in words:
        for i in range(len(w) - window + 1) if key is not None else ():
            x = tuple(w[i : i + window])
            first[x] = min(first.get(x, key), key)
    out = []
    for key, w in words:
        gone: set[int] = set()
        for i in range(len(w) - window + 1) if key is not None else ():
            if first[tuple(w[i : i + window])] < key:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df, window=50, run=20):
    bounded(df.sparkSession)
    found = repeats.remove(df, window, run)
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.words.encode()).hexdigest()) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_every_window(spark, seed):
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(3, 25))] for _ in range(12)]
    rows = []
    for key in rng.sample(range(1000), 120):
        w: list[str] = []
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(passages)
            i = rng.randrange(len(p))
            w += p[i : i + rng.randrange(1, 25)] if rng.random() < 0.5 else p if rng.random() < 0.7 else [rng.choice("ab") for _ in range(rng.randrange(12))]
        rows.append((key, rng.choice([" ", "\n", "\t "]).join(w)))
    assert result(spark.createDataFrame(rows, SCHEMA), 6, 3) == plain(rows, 6)


def test_edges_of_the_contract(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    other = " ".join(f"o{k}" for k in range(49))
    rows = [
        (5, f"x {passage} y"), (3, f"{passage}"), (9, f"{passage} z {passage}"), (7, " ".join(passage.split()[:50])), (8, " ".join(passage.split()[:49])), (2, other), (4, other),
        (10, passage.upper()), (11, passage.replace(" ", "\r\n\x0b\x0c\t")), (12, passage.replace(" ", " ")), (13, None), (14, ""), (15, " \n "), (16, "one"), (None, passage), (17, "a " * 300), (18, "a " * 200), (19, "b a " * 90), (20, "a b " * 60),
        (21, f"{passage} tail"), (21, f"{passage} tail"), (21, f"other {passage}"), (1, "q " + " ".join(f"r{k}" for k in range(70))), (1, "s " + " ".join(f"r{k}" for k in range(70))), (-(2**63), "a " * 55), (2**63 - 1, f"{passage} z"),
    ]
    assert result(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_long_texts_cross_blocks(spark, monkeypatch):
    rng = random.Random(5)
    long = [f"w{rng.randrange(10_000)}" for _ in range(repeats.BLOCK + 5_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["x", *long[repeats.BLOCK - 100 : repeats.BLOCK + 100], "y"])), (3, " ".join(long[1:])), (4, " ".join(long[:60] + long[-60:]))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df) == plain(rows)


def test_spans_have_their_source(spark):
    passage = " ".join(f"p{k}" for k in range(80))
    rows = [(1, f"head {passage}"), (2, f"{passage} tail"), (3, f"a b {passage}")]
    found = repeats.repeated_spans(spark.createDataFrame(rows, SCHEMA))
    texts = {k: t.split() for k, t in rows}
    spans = [(r.doc_id, r.start_word, r.n_words, r.source_doc_id, r.source_start) for r in found.collect()]
    assert {d for d, *_ in spans} == {2, 3}
    for d, i, n, s, j in spans:
        assert s < d and n >= 50 and texts[d][i : i + n] == texts[s][j : j + n]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    names = ("words", "marks", "mark", "edge", "before", "after", "starts", "ends", "digest", "spans", "text_hash", "n_words", "source", "a", "b")
    assert result(df.withColumns({c: F.lit("?") for c in names})) == plain([(1, "a b"), (2, None)])
    assert result(df.limit(0)) == []
    assert repeats.digests(df.limit(0)).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_hot_passage_makes_rows_in_proportion(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"u{k} {passage} v{k}") for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert repeats.repeated_spans(df).count() == 399
    assert result(df) == plain(rows)
