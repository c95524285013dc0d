"""Near duplicates by a multi-index Hamming join of MinHash signatures.

1. Each text's set of five-word shingles gives a digest and a signature of 64 MinHash values of 16
   bits. Texts with equal sets are one class, represented by its least doc_id.
2. The distance of two signatures is the number of values in which they differ; at most 31 is near. The
   signature is split into 16 chunks of four values, so of two near ones a chunk differs in at most one
   value (pigeonhole). Each way to leave out one value of a chunk is a key: 64 keys a class, and all near
   pairs share one.
3. Classes that share a key and differ in at most 31 values of three bits are candidates: all near pairs,
   and few others. At a similarity of 0.75 two signatures aren't near with a probability of 2e-5, which
   the keys beyond the guarantee and the shorter values bring down to 1e-6 for being no candidates. What
   leaves a bucket is a forest that connects its candidates, not their pairs.
4. The components of these forests are groups; no candidate pair crosses them. The full sets of a
   group's classes meet and are compared: linked where 100 * intersection >= 75 * union. Again a forest
   leaves the task. A large group comes in blocks. Each is compared within itself and with the first one;
   what that leaves unconnected is compared with the whole of its group, so no link between two
   components is missed, and a group that hangs together costs rows in proportion to its size.
5. The components of the links, over classes, give each document its component.

A bucket of more than ``BUCKET`` classes comes in parts. Each is compared within itself; the parts of a
bucket that the forests so far don't connect are then compared in pairs, by the same distance, so what
a bucket finds doesn't depend on its size.

Texts without words (null or empty) are linked with nothing. Rows without doc_id are too; their component
is null and they are kept. Rows that repeat a doc_id and text have the same component; different texts of
one doc_id may be one node. A text of any length is taken whole; one above the batch bound comes alone.
Columns beside doc_id and text are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import chunks, partitions, release, stored
from gridweave.llm.shingles import shingle_sets
from gridweave.operators.components import components

VALUES, CHUNK_VALUES = 64, 4
CHUNKS = VALUES // CHUNK_VALUES
#: The radius that the keys guarantee.
MOST_DIFFERENT = 2 * CHUNKS - 1
SKETCH_BITS = 3
SKETCH = [f"sketch_{k}" for k in range(SKETCH_BITS)]
BUCKET = 4096
#: Rows that are taken from a batch at a time.
SLICE = 2048
#: Classes whose keys are made at a time; each has VALUES rows.
KEYED_ROWS = 512
#: Classes and bytes of sets in a block; a task compares two blocks at most.
BLOCK_ROWS, BLOCK_BYTES = 1500, 8 << 20
#: Texts are profiled in batches of this many bytes.
BATCH_BYTES = 1 << 20
_random = np.random.default_rng(75)
FACTORS = _random.integers(1, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _random.integers(0, 1 << 63, VALUES, np.uint64)


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of 16 bits for each non-empty set; zeros for an empty one."""
    out = np.zeros((len(at) - 1, VALUES), np.uint16)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        for k in range(VALUES):
            least = np.minimum.reduceat(sets * FACTORS[k] + TERMS[k], at[some])
            out[some, k] = least >> np.uint64(20) & np.uint64(0xFFFF)
    return out


def keys_of(signature: np.ndarray) -> np.ndarray:
    """The keys of each signature: hashes of a chunk, a value to leave out and the other values."""
    chunked = signature.astype(np.uint64).reshape(-1, CHUNKS, CHUNK_VALUES)
    out = []
    for left in range(CHUNK_VALUES):
        rest = [k for k in range(CHUNK_VALUES) if k != left]
        word = chunked[:, :, rest[0]]
        for k in rest[1:]:
            word = (word * np.uint64(0x9E3779B97F4A7C15)) ^ (word >> np.uint64(29)) ^ chunked[:, :, k]
        out.append((word * np.uint64(0xD6E8FEB86659FD93)) ^ np.arange(left, VALUES, CHUNK_VALUES, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return np.concatenate(out, 1).view(np.int64)


def sketch_of(signature: np.ndarray) -> np.ndarray:
    """The lowest bits of each value, a 64-bit word for each bit."""
    place = np.arange(VALUES, dtype=np.uint64)
    return np.stack([np.bitwise_or.reduce((signature.astype(np.uint64) >> np.uint64(k) & np.uint64(1)) << place, axis=1) for k in range(SKETCH_BITS)], 1)


def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many values two sketches differ; never more than their signatures do."""
    return np.bitwise_count(np.bitwise_or.reduce(a ^ b, axis=-1)).astype(np.int64)


def profile(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (null without words), signature."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", BATCH_BYTES):
            sets, at = shingle_sets([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            signature = signatures(sets, at).tobytes()
            raw, to = sets.tobytes(), (at * 8).tolist()
            digests = [hashlib.blake2b(raw[i:j], digest_size=16).digest() if j > i else None for i, j in zip(to, to[1:], strict=False)]
            own = [signature[i : i + 2 * VALUES] for i in range(0, len(signature), 2 * VALUES)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(digests, pa.binary()), pa.array(own, pa.binary())], names=["doc_id", "n_shingles", "digest", "signature"]
            )
        release()

    return documents.select("doc_id", "text").mapInArrow(step, "doc_id long, n_shingles long, digest binary, signature binary")


class Forest:
    """Union by least member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        labels = np.unique(np.append(self.label[others], self.label[i]))
        if len(labels) > 1:
            self.label[np.isin(self.label, labels[1:])] = labels[0]


def whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def runs(batches: Iterator[pa.RecordBatch], by: list[str], limit: int | None = None) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Rows sorted by the columns ``by``, in batches of whole runs of equal values, and 0.

    A run of more than ``limit`` rows comes in parts, numbered from 1, all but the first with the run's first row before them.
    """
    held: list[pa.RecordBatch] = []
    last, n, part = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in by:
            x = batch.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= x[1:] != x[:-1]
        key = tuple(batch.column(c)[0].as_py() for c in by)
        change[0] = last is not None and key != last
        last = tuple(batch.column(c)[-1].as_py() for c in by)
        cut = np.flatnonzero(change)
        if len(cut):
            if part:
                yield whole([*held, batch.slice(0, cut[0])]), part + 1
                done = batch.slice(cut[0], cut[-1] - cut[0])
                if done.num_rows:
                    yield done, 0
            else:
                yield whole([*held, batch.slice(0, cut[-1])]), 0
            held, n, part = [batch.slice(cut[-1])], batch.num_rows - cut[-1], 0
        else:
            held.append(batch)
            n += batch.num_rows
        if limit is not None and n > limit:
            part += 1
            yield whole(held), part
            held, n = [held[0].slice(0, 1)], 1
    if held:
        yield whole(held), part and part + 1


def sketches(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in SKETCH], 1).view(np.uint64)


def near_forest(sketch: np.ndarray) -> np.ndarray:
    """Labels of a forest that connects all rows that differ in at most MOST_DIFFERENT values."""
    forest = Forest(len(sketch))
    for k in range(len(sketch) - 1):
        rest = np.flatnonzero(forest.label[k + 1 :] != forest.label[k]) + k + 1
        if len(rest):
            forest.join(k, rest[differ(sketch[k], sketch[rest]) <= MOST_DIFFERENT])
    return forest.label


def in_buckets(classes: DataFrame) -> DataFrame:
    """Forests (a, b) of each bucket or part of one; and where a bucket has parts, its rows: key, part, a, sketch."""
    columns = ["a", "b", "key", "part", *SKETCH]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, KEYED_ROWS):
            signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, VALUES)
            keys, sketch = keys_of(signature), sketch_of(signature).view(np.int64)
            again = [np.repeat(x, keys.shape[1]) for x in (batch.column("rep").to_numpy(), *sketch.T)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel(), *again)], names=["key", "rep", *SKETCH])
        release()

    def rows(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None = None, part: int = 0, sketch: np.ndarray | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        rest = [none, pa.nulls(len(a), pa.int32()), *[none] * SKETCH_BITS] if key is None else [pa.array(key), pa.array(np.full(len(a), part, np.int32)), *(pa.array(x.copy()) for x in sketch.view(np.int64).T)]
        return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), *rest], names=columns)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in runs(sliced(batches, SLICE), ["key"], BUCKET):
            key, rep, sketch = batch.column("key").to_numpy(), batch.column("rep").to_numpy(), sketches(batch)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(first, len(key)))
            pair = first[count == 2]
            pair = pair[differ(sketch[pair], sketch[pair + 1]) <= MOST_DIFFERENT]
            a, b = [rep[pair]], [rep[pair + 1]]
            for i, n in zip(first[count > 2].tolist(), count[count > 2].tolist(), strict=True):
                label = near_forest(sketch[i : i + n])
                moved = np.flatnonzero(label != np.arange(n))
                a.append(rep[i + moved])
                b.append(rep[i + label[moved]])
            edges = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
            edges = edges[edges[:, 0] != edges[:, 1]]
            if len(edges):
                yield rows(edges[:, 0].copy(), edges[:, 1].copy())
            if part:
                own = slice(part > 1, None)  # without the first row, which is in the first part
                yield rows(rep[own], None, key[own], part, sketch[own])
        release()

    each = classes.select("rep", "signature").mapInArrow(keyed, f"key long, rep long, {', '.join(f'{c} long' for c in SKETCH)}")
    spread = each.repartition(partitions(classes.sparkSession), "key").sortWithinPartitions("key", "rep")
    return spread.mapInArrow(step, f"a long, b long, key long, part int, {', '.join(f'{c} long' for c in SKETCH)}")


def across_parts(overfull: DataFrame, edges: DataFrame) -> DataFrame:
    """Forests (a, b) over pairs of parts of the buckets that ``edges`` leave unconnected."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in runs(sliced(batches, SLICE), ["key", "i", "j"]):
            key, i, j, part, rep, component = (batch.column(c).to_numpy() for c in ("key", "i", "j", "part", "a", "component"))
            sketch = sketches(batch)
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            a, b = [rep[:0]], [rep[:0]]
            for f, t in zip(first.tolist(), np.append(first[1:], len(key)).tolist(), strict=True):
                forest = Forest(t - f)
                _, where, back = np.unique(component[f:t], return_index=True, return_inverse=True)
                forest.label = where[back]
                begun = forest.label.copy()
                right = np.flatnonzero(part[f:t] == j[f])
                for k in np.flatnonzero(part[f:t] == i[f]):
                    rest = right[forest.label[right] != forest.label[k]]
                    if len(rest):
                        forest.join(k, rest[differ(sketch[f + k], sketch[f + rest]) <= MOST_DIFFERENT])
                moved = np.flatnonzero(forest.label != begun)
                a.append(rep[f + moved])
                b.append(rep[f + forest.label[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
        release()

    label = components(edges)
    named = overfull.join(label, F.col("a") == F.col("node"), "left").withColumn("component", F.coalesce("component", "a"))
    several = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max("part").alias("parts")).where("least < most").select("key", "parts")
    open_ = named.join(several, "key").select("key", "part", "a", "component", *SKETCH, F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("other")).where("part <> other")
    paired = open_.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "a", "component", *SKETCH)
    spread = paired.repartition(partitions(edges.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "a")
    return spread.mapInArrow(step, "a long, b long")


def candidates(classes: DataFrame) -> DataFrame:
    """Forests (a, b) that connect all candidates among the classes (rep, signature)."""
    found = stored(in_buckets(classes).distinct(), "candidates")  # a pair shares many keys; what is left of it lies in few files
    edges, overfull = found.where("part is null").select("a", "b"), found.where("part is not null").drop("b")
    return edges if overfull.isEmpty() else edges.union(across_parts(overfull, edges))


def linked(sizes: np.ndarray, left: np.ndarray, counts: np.ndarray, own: int) -> np.ndarray:
    """Which of the sets ``left`` have 100 * intersection >= 75 * union with one of size ``own``."""
    return left[100 * counts >= 75 * (sizes[left] + own - counts)]


def compare(sets: list[np.ndarray], side: np.ndarray, across: bool) -> np.ndarray:
    """Labels of a forest over all linked pairs, within one block or across two, by inverted index."""
    sizes = np.array([len(s) for s in sets])
    forest = Forest(len(sets))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    token = np.cumsum(np.concatenate([[0], np.diff(flat[order]) != 0]).astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], np.diff(token) != 0]))
    holders = owner[order]
    df = np.diff(np.append(first, len(token)))
    of = np.empty(len(flat), np.int64)
    of[order] = token
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(len(sets)):
        if across and side[i]:
            continue
        mine = of[at[i] : at[i + 1]]
        mine = mine[df[mine] > 1]
        if not len(mine):
            continue
        n = df[mine]
        where = np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        counts = np.bincount(holders[where], minlength=len(sets))
        others = np.flatnonzero(counts)
        others = others[(side[others] > 0) if across else (others > i)]
        others = others[forest.label[others] != forest.label[i]]
        if len(others):
            forest.join(i, linked(sizes, others, counts[others], sizes[i]))
    return forest.label


def compared(documents: DataFrame, members: DataFrame) -> DataFrame:
    """Forests (grp, a, b) over the links between blocks; members: rep, digest, grp, block, upto, own. A block meets those below ``upto``, and itself where ``own``."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "block", "upto", "own", "rep"]
        for batch in chunks(batches, "text", BATCH_BYTES):
            sets, at = shingle_sets([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            raw, to = sets.tobytes(), (at * 8).tolist()
            found = [raw[i:j] for i, j in zip(to, to[1:], strict=False)]
            same = pa.array([hashlib.blake2b(x, digest_size=16).digest() == d for x, d in zip(found, batch.column("digest").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.binary())], names=[*names, "shingles"]).filter(same)
        release()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in runs(sliced(batches, 256), ["grp", "i", "j"]):
            grp, i, j, block, rep = (batch.column(c).to_numpy() for c in ("grp", "i", "j", "block", "rep"))
            first = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            sets = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
            of, a, b = [], [], []
            for f, t in zip(first, np.append(first[1:], len(grp)), strict=True):
                if t - f > 1:
                    label = compare(sets[f:t], (block[f:t] == j[f]).astype(np.int8), bool(i[f] != j[f]))
                    moved = np.flatnonzero(label != np.arange(t - f))
                    of.append(grp[f + moved])
                    a.append(rep[f + moved])
                    b.append(rep[f + label[moved]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (of, a, b)], names=["grp", "a", "b"])
        release()

    # by shuffle at any size: members grow with the documents, so no broadcast of them is bounded
    texts = documents.select(F.col("doc_id").alias("rep"), "text").join(members.hint("merge"), "rep").select("grp", "block", "upto", "own", "rep", "digest", "text")
    sets = texts.mapInArrow(sets_of, "grp long, block int, upto int, own boolean, rep long, shingles binary")
    below = F.sequence(F.lit(0), F.col("upto") - 1)
    others = F.when(F.col("own") & (F.col("block") >= F.col("upto")), F.concat(below, F.array("block"))).otherwise(below)
    paired = sets.select("grp", "block", "rep", "shingles", F.explode(others).alias("other"))
    paired = paired.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "shingles")
    spread = paired.repartition(partitions(documents.sparkSession), "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "rep")
    return spread.mapInArrow(step, "grp long, a long, b long")


def block_count(rows: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(shingles * 8 / BLOCK_BYTES)).cast("int")


def links(documents: DataFrame, members: DataFrame) -> DataFrame:
    """Forests (a, b) that connect all that links within groups connect; members: rep, digest, n_shingles, grp."""
    share = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    # tables of large groups alone, so that adaptive execution can split a hot group in these joins
    large = stored(members.groupBy("grp").agg(block_count(F.count(F.lit(1)), F.sum("n_shingles")).alias("blocks")).where("blocks > 1"), "large-groups")
    block = F.coalesce(share(F.col("blocks")), F.lit(0))
    begun = members.join(large, "grp", "left").select("rep", "digest", "grp", block.alias("block"), "blocks")
    upto = F.when(F.col("block") == 0, F.coalesce("blocks", F.lit(1))).otherwise(1).cast("int")
    first = stored(compared(documents, begun.select("rep", "digest", "grp", "block", upto.alias("upto"), F.lit(True).alias("own"))).distinct(), "links")
    if large.isEmpty():
        return first.select("a", "b")

    label = components(first.join(large, "grp", "left_semi").select("a", "b"))
    named = members.join(large, "grp", "left_semi").join(label, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    parts = named.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    main = parts.groupBy("grp").agg(F.max(F.struct("n", "component", "s")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("parts > 1")
    rest, most = block_count(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")), block_count(F.col("main.n"), F.col("main.s"))
    unfinished = stored(main.select("grp", F.col("main.component").alias("main"), rest.alias("rest"), most.alias("most")), "unfinished-groups")
    # the largest component's blocks come after the others and don't meet each other
    own = named.select("rep", "digest", "grp", "component").join(unfinished, "grp")
    in_main = F.col("component") == F.col("main")
    block = F.when(in_main, F.col("rest") + share(F.col("most"))).otherwise(share(F.col("rest")))
    upto = F.when(in_main, F.col("rest")).otherwise(F.col("rest") + F.col("most"))
    second = compared(documents, own.select("rep", "digest", "grp", block.alias("block"), upto.alias("upto"), F.lit(False).alias("own")))
    return first.union(second).select("a", "b")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of all documents (doc_id, text)."""
    profiled = stored(profile(documents), "profiles")
    known = profiled.where("digest is not null and doc_id is not null")
    classes = stored(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    own = known.withColumnRenamed("doc_id", "rep").join(classes, ["digest", "rep"], "left_semi").dropDuplicates(["digest", "rep"])
    own = stored(own.select("rep", "digest", "n_shingles", "signature"), "signatures")
    groups = components(candidates(own))
    member = groups.withColumnsRenamed({"node": "rep", "component": "grp"}).join(own.drop("signature"), "rep")
    member = stored(member, "members")
    found = components(links(documents, member)).withColumnRenamed("node", "rep")
    placed = stored(classes.join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")), "components")
    # texts without words have no class; each looks for one under its own id, so that they don't meet in one task
    look = F.coalesce("digest", F.col("doc_id").cast("string").cast("binary"))
    out = profiled.select("doc_id", "n_shingles", look.alias("digest")).join(placed, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
