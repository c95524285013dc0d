"""BPE and token files against the tokenizers library, on odd texts and over a small table."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridweave.llm import bpe, tokenfile

ODD = [
    None, "", "a", "   a", "a   b \n \n c\t d", " x", "x ", "aaaa aaaaa aaaaaaaa", "<|endoftext|>", "foo <|endoftext|> bar<|endoftext|>", "don't I'll 's",
    "é日本語 🎉🎉", "\x1c\x1d a\x85b", "\n\n\n  x", "  \n", "a  b", "a \nb", "\\u3000\u3000 x", "long " * 30_000, "z" * 50_000, "same text", "same text",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "no id", "x"), (3, "again", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_codec_equals_library(library):
    own = bpe.PairIndexCodec(bpe.default_tokenizer(), limit=40)
    for _ in range(2):
        for t, ids in zip(ODD, own.encode(ODD), strict=True):
            want = library.encode(t or "", add_special_tokens=False).ids
            assert ids.tolist() == want
            assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_unknown_id():
    with pytest.raises(KeyError):
        bpe.codec(bpe.default_tokenizer()).decode(np.array([10**6]))


def test_encode_decode_columns(docs):
    out = bpe.decode(bpe.encode(docs)).collect()
    assert len(out) == len(ODD) + 2
    assert all(r.decoded == (r.text or "") for r in out)
    assert set(out[0].asDict()) == {"doc_id", "text", "n_tokens", "token_ids", "decoded"}


def test_digests(docs, library):
    for r in bpe.digests(docs.where("doc_id > 3")).collect():
        ids = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest()


def test_token_files(docs, library):
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    got = sorted(tokenfile.write_and_read(docs).collect(), key=lambda r: r.start)
    start = 0
    assert len(got) == len(rows)
    for r, g in zip(rows, got, strict=True):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert (g.doc_id, g.start, g.n_tokens) == (r.doc_id, start, len(ids))
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_no_documents(docs):
    assert tokenfile.write_and_read(docs.where("false")).count() == 0
    assert bpe.digests(docs.where("false")).count() == 0
    assert bpe.decode(bpe.encode(docs.where("false"))).count() == 0


def test_texts_above_the_batch_bound(spark, library):
    """Longer than a batch, alone and beside short ones; repeated rows."""
    long = "the river bank, " * 400_000
    rows = [(2, long), (1, "a"), (3, "b"), (3, "b"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = library.encode(long[:1600], add_special_tokens=False).ids
    got = bpe.encode(df).orderBy("doc_id").collect()
    assert [len(r.token_ids) for r in got[:2]] == [0, 1] and got[3].token_ids == got[4].token_ids
    assert got[2].token_ids[: len(want) - 5] == want[:-5]
    assert bpe.decode(bpe.encode(df.where("doc_id = 2"))).first().decoded == long
    files = {r.doc_id: r for r in tokenfile.write_and_read(df.where("doc_id < 3")).collect()}
    assert files[2].n_tokens == len(got[2].token_ids) + 1 and files[2].start == 2
    assert files[2].ids_crc32 == zlib.crc32(np.array([*got[2].token_ids, 0], "<u4").tobytes())


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 2000])
@pytest.mark.parametrize("step", [0, 1, 7, 5000])
def test_elias_fano(n, step):
    values = np.cumsum(np.random.default_rng(n).integers(0, step + 1, n))
    own = tokenfile.EliasFano.load(tokenfile.EliasFano.build(values).dump())
    for i, j in [(0, n), (n // 2, n), (n // 3, n // 3 + 1), (n, n)]:
        assert own.select(i, j).tolist() == values[i:j].tolist()


def test_doc_ids_of_any_width(spark, library):
    ids = [-(2**63), -6 * 10**18, -1, 0, 1, 6 * 10**18, 2**63 - 1]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = sorted(tokenfile.write_and_read(df).collect(), key=lambda r: r.start)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [r.doc_id for r in got] == ids
    assert [r.n_tokens for r in got] == [len(library.encode(f"text {i}", add_special_tokens=False).ids) + 1 for i in ids]


def test_elias_fano_of_64_bits():
    values = np.array([0, 1, 2**63 - 1, 2**63, 2**64 - 2, 2**64 - 1, 2**64 - 1], np.uint64)
    own = tokenfile.EliasFano.load(tokenfile.EliasFano.build(values).dump())
    assert own.select(0, 7).view(np.uint64).tolist() == values.tolist() and own.select(3, 5).view(np.uint64).tolist() == values[3:5].tolist()


def test_special_tokens_of_any_look(tmp_path):
    """Not only those that begin with a bracket of one kind."""
    import json

    from tokenizers import Tokenizer

    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    last = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    spec["added_tokens"] += [{"id": last + 1 + k, "content": c, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for k, c in enumerate(["[PAD]", "§§"])]
    path = tmp_path / "more.json"
    path.write_text(json.dumps(spec))
    library = Tokenizer.from_file(str(path))
    texts = ["a [PAD] b§§c", "[PAD]", "[PA", "no special", "§", "<|x|> [PAD]"]
    found = bpe.PairIndexCodec(str(path)).encode(texts)
    assert [x.tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]
