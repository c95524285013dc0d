import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.llm import phrases
from gridweave.llm.common import bounded

SCHEMA = "doc_id long, lang string, text string"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top, percent=100):
    """The contract with a counter of all sequences."""
    total, f = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + n])) for n in range(1, 6) for i in range(len(w) - n + 1))
    often = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    inside: dict[tuple, int] = {}
    for (lang, w), a in often.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                key = (lang, w[i : i + n])
                inside[key] = max(inside.get(key, 0), a)
    by: dict[str, list] = {}
    for (lang, w), a in often.items():
        if 100 * inside.get((lang, w), 0) >= percent * a:
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        by.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out = []
    for lang, found in by.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def result(df, *args, **kw):
    bounded(df.sparkSession)
    return sorted(tuple(r) for r in phrases.collocations(df, *args, **kw).collect())


def made(seed, docs=150):
    rng = random.Random(seed)
    pool = ["a", "b", "A", "é", "É", "x y", "\u0085", "ß", "日本", "-", "ab", "\x00", "\x01"]
    join = [" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!?", " ; "]
    return [(k, rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(pool) + rng.choice(join) for _ in range(rng.randrange(60)))) for k in range(docs)]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_sequences(spark, seed):
    rows = made(seed)
    assert result(spark.createDataFrame(rows, SCHEMA), 4, 25) == plain(rows, 4, 25)


def test_a_crowded_sketch_changes_nothing(spark):
    rows = made(7)
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df, 5, 1000, width=phrases.BLOCK) == plain(rows, 5, 1000) == result(df, 5, 1000, width=1 << 22)
    assert result(df, 5, 1000, 60) == plain(rows, 5, 1000, 60)


def test_many_shards_and_partitions(spark, monkeypatch):
    rows = made(9, 400)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 1)
    texts = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert phrases.buckets_for(texts) == phrases.FEWEST_BUCKETS
    assert result(texts, 20, 2000, width=1 << 18) == plain(rows, 20, 2000)
    monkeypatch.setattr(phrases, "FEWEST_BUCKETS", 1)
    assert result(texts, 20, 2000, width=1 << 18) == plain(rows, 20, 2000)


def test_bounds_are_never_below(spark):
    texts = [" ".join(random.Random(k).choices("abcdef", k=200)) for k in range(20)]
    own = phrases.Sequences(phrases.normal(texts), "en")
    for n in range(1, 6):
        at, hashes = own.of(n)
        assert len(at) == 20 * (200 - n + 1)
        words = [t.split() for t in texts]
        assert len(np.unique(hashes)) == len({tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)})


def test_overlaps_ties_nulls_and_repeats(spark):
    rows = [(1, "en", "a a a a a"), (1, "en", "a a a a a"), (2, "en", None), (3, None, ""), (4, "en", " . , "), (5, "x", "p q. p q, r s! r s"), (6, "x", "P Q\tp  q\nR S r S"), (None, "x", "q p"), (7, "long", "w " * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(df, 2, 2000) == plain(rows, 2, 2000)
    assert result(df, 2, 1) == plain(rows, 2, 1)


def test_scores_beyond_64_bits(spark):
    frequent = spark.createDataFrame([("en", "p q", 10**9, 10**15, ["p", "q"]), ("en", "p", 2 * 10**9, 10**15, ["p"]), ("en", "q", 3 * 10**9 + 1, 10**15, ["q"])], "lang string, phrase string, a long, n long, words array<string>")
    (row,) = phrases.scored(frequent).collect()
    assert (row.l, row.r, row.score) == (2 * 10**9, 3 * 10**9 + 1, 1000 * 10**9 * 10**15 // (2 * 10**9 * (3 * 10**9 + 1)))


def test_empty_table_and_clashing_columns(spark):
    rows = made(3)
    df = spark.createDataFrame(rows, SCHEMA)
    names = ("phrase", "words", "a", "n", "l", "r", "k", "rank", "salt", "score", "block", "counts", "head", "tail", "most")
    assert result(df.withColumns({c: F.lit("?") for c in names}), 4, 25) == plain(rows, 4, 25)
    assert result(df.limit(0)) == []
    assert phrases.collocations(df.limit(0)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
