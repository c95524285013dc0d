"""Near duplicates, components, decontamination and the pipeline against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from gridweave.llm import common, decontam, neardup, shingles
from gridweave.operators import components


def words(n, seed, letters="abcdefgh"):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(n)]


def edited(own, seed, changes):
    rnd, own = random.Random(seed), list(own)
    for _ in range(changes):
        own[rnd.randrange(len(own))] = f"x{rnd.random()}"
    return own


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain_components(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).update(plain_set(t))
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 75 * len(sets[a] | sets[b]):
                    x, y = sorted((label[a], label[b]))
                    label = {k: x if v == y else v for k, v in label.items()}
    return sets, label


@pytest.fixture(scope="module")
def texts():
    rows, n = [], 0
    for g in range(12):
        base = words(80 + 30 * g, g)
        for k in range(9):
            rows.append((n, " ".join(edited(base, 100 * g + k, k))))
            n += 1
    passage = words(40, 999)
    for k in range(40):
        rows.append((n, " ".join([*words(30, 2000 + k), *passage])))
        n += 1
    odd = [None, "", " \n\t", "one", "One", "ONE two", "one\ttwo", "a b c d", "a b c d e", "a b c d e f", "É é", "é é", "w " * 60_000, "W " * 60_000, "a\x1cb c d e f"]
    return rows + [(n + k, t) for k, t in enumerate(odd)]


def test_near_duplicates(spark, texts):
    df = spark.createDataFrame([*texts, texts[3], texts[3], (None, texts[0][1]), (None, None)], "doc_id long, text string").selectExpr("*", "1 AS n_shingles", "'x' AS digest")
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(texts) + 4
    sets, label = plain_components(texts)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), label[r.doc_id], label[r.doc_id] == r.doc_id), r
    assert 60 < len({r.component_id for r in got}) < len(texts)
    assert neardup.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("rows", [2, 4])
def test_small_blocks_and_buckets_lose_nothing(spark, texts, monkeypatch, rows):
    """Blocks of a few classes, and buckets beyond their limit."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows)
    monkeypatch.setattr(neardup, "BUCKET", 3)
    monkeypatch.setattr(neardup, "SLICE", 2)
    _, label = plain_components(texts)
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == label


def test_a_large_group_is_compared_in_proportion(spark, monkeypatch):
    """Near copies meet the first block and their own; only what that leaves apart meets the whole group."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 5)
    base = words(300, 7)
    copies = [(n, " ".join(edited(base, n, 1))) for n in range(80)]
    apart = [(100 + n, " ".join(edited(base, 50 + n, 9 + n))) for n in range(12)]
    rows = copies + apart
    seen, plain = [], neardup.compared
    monkeypatch.setattr(neardup, "compared", lambda documents, members: seen.append(members) or plain(documents, members))
    members = [(i, bytearray(neardup.hashlib.blake2b(shingles.shingle_sets([t.encode()])[0].tobytes(), digest_size=16).digest()), len(plain_set(t)), 1) for i, t in rows]
    edges = neardup.links(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(members, "rep long, digest binary, n_shingles long, grp long"))
    found = {r.node: r.component for r in components.components(edges).collect()}
    _, label = plain_components(rows)
    assert {i: found.get(i, i) for i, _ in rows} == label and 3 < len(set(label.values())) < 13
    met = lambda m: m.selectExpr("sum(upto + int(own and block >= upto))").first()[0]
    several = -(-len(rows) // 5)
    assert met(seen[0]) < 4 * len(rows) < several * len(rows)
    assert len(seen) == 2 and met(seen[1]) <= several * len(rows) / 2


def some_signatures(n, seed):
    """Groups about centres, each signature with some values drawn anew."""
    rnd = np.random.default_rng(seed)
    centre = rnd.integers(0, 1 << 16, (6, neardup.VALUES))
    out = centre[rnd.integers(0, 6, n)]
    for row in out:
        at = rnd.permutation(neardup.VALUES)[: rnd.integers(0, 40)]
        row[at] = rnd.integers(0, 1 << 16, len(at))
    return out.astype(np.uint16)


@pytest.mark.parametrize("bucket", [3, 20, 4096])
def test_candidates_do_not_depend_on_the_size_of_buckets(spark, monkeypatch, bucket):
    """The forests connect all pairs within the radius, and only pairs that share a key and whose sketches are within it."""
    monkeypatch.setattr(neardup, "BUCKET", bucket)
    monkeypatch.setattr(neardup, "SLICE", max(1, bucket // 2))
    signature = some_signatures(150, 3)
    sketch, keys = neardup.sketch_of(signature), neardup.keys_of(signature)
    label = np.arange(150)
    for a in range(150):
        for b in range(a + 1, 150):
            near = neardup.differ(sketch[a], sketch[b]) <= neardup.MOST_DIFFERENT and np.intersect1d(keys[a], keys[b]).size
            assert near or (signature[a] != signature[b]).sum() > neardup.MOST_DIFFERENT
            if near:
                label[label == max(label[a], label[b])] = min(label[a], label[b])
    rows = [(i, bytearray(x.tobytes())) for i, x in enumerate(signature)]
    got = components.components(neardup.candidates(spark.createDataFrame(rows, "rep long, signature binary"))).collect()
    found = {r.node: r.component for r in got}
    assert [found.get(i, i) for i in range(150)] == label.tolist() and 1 < len(set(label.tolist())) < 150


def test_keys_hold_the_radius():
    """Signatures within the radius share a key wherever the differences lie, and their sketches are within it too."""
    rnd = np.random.default_rng(5)
    one = rnd.integers(0, 1 << 16, (1, neardup.VALUES)).astype(np.uint16)
    for _ in range(300):
        other = one.copy()
        at = rnd.permutation(neardup.VALUES)[: neardup.MOST_DIFFERENT]
        other[0, at] ^= rnd.integers(1, 1 << 16, neardup.MOST_DIFFERENT).astype(np.uint16)
        assert np.intersect1d(neardup.keys_of(one), neardup.keys_of(other)).size
        assert neardup.differ(neardup.sketch_of(one), neardup.sketch_of(other))[0] <= neardup.MOST_DIFFERENT


def test_runs():
    import pyarrow as pa

    key = [1, 1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 4]
    for size in (1, 2, 3, 5, 20):
        for limit in (None, 2, 3):
            batches = [pa.RecordBatch.from_pydict({"k": key[i : i + size], "v": list(range(i, min(i + size, len(key))))}) for i in range(0, len(key), size)]
            seen = {}
            for batch, long in neardup.runs(iter(batches), ["k"], limit):
                for k, v in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist(), strict=True):
                    seen.setdefault(v, []).append((k, long))
                if not long:
                    for k in set(batch.column("k").to_pylist()):
                        assert batch.column("k").to_pylist().count(k) == key.count(k)
                else:
                    assert len(set(batch.column("k").to_pylist())) == 1
            assert sorted(seen) == list(range(len(key))) and all(key[v] == k for v, x in seen.items() for k, _ in x)


def test_shingle_sets_do_not_depend_on_the_batch(texts):
    raw = [(t or "").encode() for _, t in texts]
    flat, at = shingles.shingle_sets(raw)
    for i, t in enumerate(raw):
        alone, _ = shingles.shingle_sets([t])
        assert flat[at[i] : at[i + 1]].tolist() == alone.tolist()
        assert len(alone) == len(plain_set(texts[i][1]))


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_word_hashes_do_not_depend_on_the_pieces(monkeypatch, piece):
    rnd = random.Random(5)
    texts = [bytes(rnd.choice(b"aZ \t\n\xc3\xa4") for _ in range(rnd.randrange(300))) for _ in range(40)] + [b"", b" ", b"x" * 500]
    whole = shingles.word_hashes(texts)
    monkeypatch.setattr(shingles, "PIECE", piece)
    cut = shingles.word_hashes(texts)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut, strict=True))
    assert len(whole[0]) == sum(len(re.findall(rb"[^\x20\x09-\x0D]+", t)) for t in texts)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + rnd.randrange(300), 1000 + rnd.randrange(300)) for _ in range(250)] + [(5000, 5000 + i) for i in range(1, 400)] + [(9, 9)]
    label = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = sorted((label[a], label[b]))
        label = {k: x if v == y else v for k, v in label.items()}
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def test_decontamination(spark):
    bench = [(i, " ".join(words(20 + 3 * i, 50 + i)) + ".") for i in range(12)] + [(12, "too few words"), (13, None), (14, ""), (15, "a b c d e"), (None, "no id item here at all"), (16, " ".join(["again"] * 30))]
    bench += [bench[0]]
    filler = lambda k: " ".join(words(60, 900 + k, "ijklmnop"))
    docs = [(i, filler(i)) for i in range(20)]
    docs += [(100 + i, f"{filler(i)} {bench[i][1].upper()} {filler(i + 30)}") for i in range(12)]
    docs += [(200 + i, " ".join([filler(i), *edited(plain_words(bench[i][1]), i, 1), filler(i)])) for i in range(12)]
    docs += [(300 + i, " ".join([filler(i), *plain_words(bench[i][1])[: 12 + i], filler(i)])) for i in range(12)]
    docs += [(400, None), (401, ""), (402, "a b c d e"), (403, "A, b; c\nd e"), (404, bench[3][1]), (405, "again " * 5000), (None, bench[4][1]), (100, docs[20][1])]
    docs = [(d, t, "clash") for d, t in docs]
    items = {i: Counter(tuple(plain_words(t)[k : k + 5]) for k in range(len(plain_words(t)) - 4)) for i, t in bench}
    sizes = {i: len(plain_words(t)) for i, t in bench}
    want = {}
    for d, t, _ in docs:
        w = plain_words(t)
        for i, own in items.items():
            for s in range(-sizes[i] + 5, len(w) - 4) if own else ():
                part = w[max(s, 0) : s + sizes[i]]
                found = Counter(tuple(part[k : k + 5]) for k in range(len(part) - 4))
                n = (found & own).total()
                if n and 100 * n >= 75 * (found | own).total():
                    want[d, i] = max(want.get((d, i), 0), round(n / (found | own).total(), 6))
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = decontam.matches(df, table).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == want and len(got) == len(want)
    assert {d for d, _ in want} >= {None, 402, 403, 404, 405, *range(100, 112)} and not {d for d, _ in want} & set(range(20))
    left = decontam.decontaminate(df, table)
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _, _ in docs if d not in {x for x, _ in want})
    assert decontam.matches(df.where("false"), table).count() == 0 and decontam.matches(df, table.where("false")).count() == 0


def test_no_match_is_lost_at_the_threshold(spark):
    """Passages with as many words cut at the document's end, or replaced at either end, as a similarity of 0.75 allows."""
    bench, docs, want = [], [], set()
    for i in range(300):
        own = words(16 + i % 85, 10_000 + i, "abcdefghijkl")
        n = len(own) - 4
        bench.append((i, " ".join(own)))
        other = words(90, 20_000 + i, "mnopqrstuvwx")
        cut, gone = n // 4, n // 7
        docs.append((3 * i, " ".join(other + own[: len(own) - cut])))
        docs.append((3 * i + 1, " ".join(other[:40] + own[: len(own) - gone] + other[40:])))
        docs.append((3 * i + 2, " ".join(other[:40] + own[gone:] + other[40:])))
        want |= {(3 * i + k, i) for k in range(3)}
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    lost = want - {(r.doc_id, r.item_id) for r in got}
    assert not lost, [sum(d % 3 == k for d, _ in lost) for k in range(3)]
    assert len(got) == len(want) and all(0.75 <= r.similarity <= 1 for r in got)


def best_windows(docs, bench):
    """{(doc, item): (similarity, start, words)}: windows at every place, those that begin with a shared shingle or reach beyond the document's begin."""
    want = {}
    for i, t in bench:
        n, own = len(t), Counter(tuple(t[k : k + 5]) for k in range(len(t) - 4))
        for d, w in docs:
            for s in range(5 - n, len(w) - 4):
                part = w[max(s, 0) : s + n]
                if s >= 0 and tuple(part[:5]) not in own:
                    continue
                found = Counter(tuple(part[k : k + 5]) for k in range(len(part) - 4))
                both = (found & own).total()
                if both and 100 * both >= 75 * (found | own).total():
                    want[d, i] = max(want.get((d, i), (0, 0, 0)), (round(both / (found | own).total(), 6), -max(s, 0), len(part)))
    return {k: (a, -b, c) for k, (a, b, c) in want.items()}


@pytest.mark.parametrize(("step", "limit"), [(1024, 1 << 24), (7, 1 << 24), (16, 0)])
def test_windows_against_all_starts(spark, monkeypatch, step, limit):
    """Turned halves, exchanged thirds, edited tails, repeats; short blocks; a benchmark too large to be broadcast."""
    monkeypatch.setattr(decontam, "STEP", step)
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    bench, docs, rnd = [], [], random.Random(77)
    for i in range(10):
        own, other = words(18 + 9 * i, 60_000 + i, "abcdefghijkl"), words(200, 61_000 + i, "mnopqrstuvwx")
        bench.append((i, own))
        half, third = len(own) // 2, len(own) // 3
        docs += [own[half:] + own[:half], other[:30] + own[half:] + own[:half] + other[30:60], other[:3] + own[2 * third :] + own[:third] + own[third : 2 * third] + other[3:20]]
        docs += [other[:20] + own[third:] + own[:third] + other[20:30], other[:9] + own[: len(own) - rnd.randint(1, 8)] + other[9:30], own[rnd.randint(1, 8) :] + other[:40]]
        docs += [own[:third] + other[-1:] + own[third + 1 :] + other[:50], own[:half] + other[:1] + own[half:], own + own, other]
    verse = words(9, 63_000, "abcdefghijkl")
    bench += [(50, verse * 4), (51, verse * 2 + words(20, 63_001, "abcdefghijkl") + verse), (52, ["again"] * 12), (53, bench[0][1] + words(30, 63_002))]
    docs += [verse * 9, verse * 3, verse[3:] + verse * 3 + words(9, 63_003), ["again"] * 40, ["so", *["again"] * 9], bench[-1][1]]
    want = best_windows(list(enumerate(docs)), bench)
    df = spark.createDataFrame([(d, " ".join(w), "x") for d, w in enumerate(docs)], "doc_id long, text string, leak string")
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in bench], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in decontam.matches(df, table).collect()}
    assert got == want and len(want) > 60
    kept = decontam.decontaminate(df, table)
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {d for d, _ in want} and kept.columns == df.columns


def test_edited_tails_are_all_found(spark):
    """400 items whose last words are replaced, at a similarity of 0.75 or just above."""
    bench, docs = [], []
    for i in range(400):
        own = words((40, 60, 100)[i % 3], 70_000 + i, "abcdefghijkl")
        gone = (len(own) - 4) // 7
        bench.append((i, " ".join(own)))
        docs.append((i, " ".join(words(25, 71_000 + i, "mnopqrstuvwx") + own[: len(own) - gone] + words(gone + 30, 72_000 + i, "mnopqrstuvwx"))))
    got = {r.doc_id for r in decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == set(range(400))


def test_leak_in_a_very_long_text(spark):
    bench = [(1, " ".join(words(40, 80_000, "abcdefghijkl")))]
    filler = " ".join(words(900, 80_001, "mnopqrstuvwx"))
    text = " ".join([filler] * 1000 + [bench[0][1]] + [filler] * 200)
    got = decontam.matches(spark.createDataFrame([(1, text), (2, filler)], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert len(text) > common.CHUNK_BYTES and [(r.doc_id, r.similarity, r.start_word) for r in got] == [(1, 1.0, 900_000)]


def test_windows_between_the_diagonals(spark):
    """Trimmed passages with words put in, heads of passages that a document begins with, and repeated shingles, against all starts."""
    bench, docs = [], []
    for i in range(12):
        own, other = words(40 + 10 * i, 30_000 + i, "abcdefghijkl"), words(300, 40_000 + i, "mnopqrstuvwx")
        trim, half = (len(own) - 4) // 24, len(own) // 2
        bench.append((i, " ".join(own)))
        inner = own[trim : len(own) - trim]
        docs.append(other[:50] + inner[:half] + other[50 : 50 + 1 + len(own) // 17] + inner[half:] + other[60:120])
        docs.append(own[: len(own) - (len(own) - 4) // 4] + other[:150])
        docs.append(other[:2] + own[: len(own) - (len(own) - 4) // 5] + other[2:150])
        docs.append(other[:150] + own[(len(own) - 4) // 4 :])
    verse = words(9, 50_000, "abcdefghijkl")
    bench += [(50, " ".join(verse * 4)), (51, " ".join(verse * 2 + words(20, 50_001, "abcdefghijkl") + verse))]
    docs += [verse * 4 + words(40, 50_002), words(30, 50_003) + verse * 3 + words(40, 50_004), verse * 9, verse * 3, bench[-1][1].split()[5:] + verse]
    docs.append(words(30, 50_005) + bench[-1][1].split()[4:-4] + words(30, 50_006))
    want = {}
    for d, w in enumerate(docs):
        for i, t in bench:
            n, own = len(t.split()), Counter(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4))
            for s in range(5 - n, len(w) - 4):
                part = w[max(s, 0) : s + n]
                found = Counter(tuple(part[k : k + 5]) for k in range(len(part) - 4))
                both = (found & own).total()
                if both and 100 * both >= 75 * (found | own).total():
                    want[d, i] = max(want.get((d, i), 0), round(both / (found | own).total(), 6))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.matches(df, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert not want.keys() - got.keys(), sorted(want.keys() - got.keys())
    assert all(got[k] >= v for k, v in want.items()) and len(want) > 30


def test_blocks_hold_the_radius(spark):
    rnd = random.Random(4)
    pairs = []
    for _ in range(200):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), decontam.RADIUS):
            y ^= 1 << b
        pairs.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a long, b long")
    one = decontam.entries(df.selectExpr("id", "a AS fp"), "id", 0)
    two = decontam.entries(df.selectExpr("id", "b AS fp"), "id", decontam.TURNED)
    assert one.join(two.withColumnRenamed("fp", "other"), ["id", "entry"]).select("id").distinct().count() == 200


def test_plan_is_native(spark, capsys):
    df = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    decontam.matches(df, spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from gridweave.llm import bpe, pii, quality

    rnd = random.Random(8)
    good = [" ".join(words(rnd.randint(40, 200), 10 + i)) + "." for i in range(300)]
    junk = [" ".join(f"{w.upper()}!!" for w in words(100, 700 + i)) for i in range(120)]
    bench = [(i, " ".join(words(40, 5000 + i, "qrstuvwx"))) for i in range(3)]
    extra = [good[0], good[1] + " end", f"{good[2]} {bench[1][1]}", "call +1 (988) 555-2485 " + " ".join(words(60, 77)), good[5]]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good + junk + extra)] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i in range(420)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = {r.doc_id: r.predicted for r in quality.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    left = [(r[0], r[1]) for r in rows if scores[r[0]]]
    _, label = plain_components(left)
    left = [(i, t) for i, t in left if label[i] == i and not any(b in (t or "") for _, b in bench)]
    own = bpe.codec(bpe.default_tokenizer())
    want = {i: own.encode([pii.pseudonymise(t)[0] if t else ""])[0].tolist() for i, t in left}
    assert {i: r.token_ids for i, r in got.items()} == want
    assert all(r.n_tokens == len(r.token_ids) for r in got.values())
    assert 0 in got and not {420, 421, 422, 424} & set(got) and 423 in got


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, kept_id long, leak string, matched string, quality_score double, place int, kept boolean, score double"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "leak", "m", 0.5, 3, False, 0.1) for i, t, s in rows], CLASHING)


@pytest.fixture
def side_tables(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(words(40, 5000, "qrstuvwx")))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_with_clashing_columns_and_repeats(spark, side_tables):
    import corpus_pipeline

    one, other, leak = " ".join(words(50, 1)), " ".join(words(50, 2)), " ".join(words(40, 5000, "qrstuvwx"))
    rows = [(1, one, "a"), (1, one, "b"), (1, one, "a"), (2, one, "a"), (3, other, "a"), (3, leak, "a"), (None, one, "a"), (None, None, "a"), (4, None, "a"), (5, "", "a"), (6, "ip 10.1.2.3", "a")]
    docs = clashing(spark, rows)
    stage = dict(corpus_pipeline.STAGES)
    assert sorted(map(str, stage["quality"](spark, docs, side_tables).collect())) == sorted(map(str, docs.collect()))
    distinct = stage["near_duplicates"](spark, docs, side_tables)
    assert distinct.schema == docs.schema
    assert sorted([(r.doc_id, r.text, r.source) for r in distinct.collect()], key=str) == sorted([(1, one, "a"), (3, other, "a"), (3, leak, "a"), (None, one, "a"), (None, None, "a"), (4, None, "a"), (5, "", "a"), (6, "ip 10.1.2.3", "a")], key=str)
    left = stage["decontamination"](spark, docs, side_tables)
    assert left.schema == docs.schema and sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted((str(i), str(t)) for i, t, _ in rows if i != 3)
    hidden = stage["pseudonyms"](spark, docs, side_tables)
    assert hidden.schema == docs.schema and [r.n_chars == len(r.text) and r.text != rows[-1][1] for r in hidden.where("doc_id = 6").collect()] == [True]
    assert hidden.where("doc_id <> 6 or doc_id is null").exceptAll(docs).count() == 0
    coded = stage["tokens"](spark, docs, side_tables).collect()
    assert len(coded) == len(rows) and [r.n_tokens for r in coded if r.doc_id in (4, 5)] == [0, 0]


def test_stages_of_empty_tables(spark, side_tables):
    import corpus_pipeline

    docs = clashing(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, side_tables).count() == 0
    docs.write.parquet(f"{side_tables}/documents.parquet")
    assert corpus_pipeline.run(spark, side_tables).count() == 0


def test_near_duplicates_of_long_texts(spark):
    """Texts above the batch bound, whole: they differ only at the end, or in more than the threshold."""
    base = words(700_000, 4, "abcdefghijklmnop")
    rows = [(1, " ".join(base)), (2, " ".join(base[:-5] + ["other"] * 5)), (3, " ".join(base[: len(base) // 2] + words(350_000, 5, "abcdefghijklmnop"))), (4, "short text of some six words")]
    assert len(rows[0][1]) > 3 << 20
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
