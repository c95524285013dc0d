"""OpenStreetMap PBF files as a Spark data source, a partition per blob.

``spark.dataSource.register(OsmPbf)`` and ``spark.read.format("osm_pbf").load(uri)`` give one row per
entity: type, id, lat, lon, nodes, members, tags, meta; uri names a file or a folder of files. Filters on type
are pushed down: groups of other types aren't decoded. Numbers are decoded in numpy, rows leave as Arrow
batches. ``write`` makes a file from Python rows, ``write_tables`` a folder of files from tables, in tasks.
"""

from __future__ import annotations

import datetime
import lzma
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from gridweave.storage import work_path

META = "struct<version:int,timestamp:timestamp,changeset:long,user_id:int,user:string>"
SCHEMA = f"type string, id long, lat double, lon double, nodes array<long>, members array<struct<id:long,type:string,role:string>>, tags map<string,string>, meta {META}"
STAMP = pa.struct([("version", pa.int32()), ("timestamp", pa.timestamp("us", "UTC")), ("changeset", pa.int64()), ("user_id", pa.int32()), ("user", pa.string())])
MEMBER = pa.struct([("id", pa.int64()), ("type", pa.string()), ("role", pa.string())])
ARROW = pa.schema([("type", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("nodes", pa.list_(pa.int64())), ("members", pa.list_(MEMBER)), ("tags", pa.map_(pa.string(), pa.string())), ("meta", STAMP)])
#: The order of member types in the format.
MEMBER_TYPES = ["node", "way", "relation"]


class OsmReadError(ValueError):
    """A file that can't be decoded."""


def file_system(uri: str):
    from pyarrow import fs

    if "://" not in uri:  # a path, or as Hadoop writes that of a local file
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


def varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def signed(x: int) -> int:
    """Zigzag."""
    return x >> 1 ^ -(x & 1)


def int64(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def message(raw: bytes) -> dict[int, list]:
    """The fields of a protocol buffer message by number; varints as int, the rest as bytes."""
    out: dict[int, list] = {}
    at = 0
    while at < len(raw):
        key, at = varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(raw, at)
        elif kind == 2:
            size, at = varint(raw, at)
            value, at = raw[at : at + size], at + size
            if len(value) != size:
                raise OsmReadError("a field ends early")
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        else:
            raise OsmReadError(f"unknown wire type {kind}")
        out.setdefault(key >> 3, []).append(value)
    return out


def varints(raw: bytes) -> np.ndarray:
    """All varints of a packed field, unsigned."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data < 128)
    if len(data) and (not len(ends) or ends[-1] != len(data) - 1):
        raise OsmReadError("a field ends early")
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def packed(fields: dict[int, list], number: int) -> np.ndarray:
    parts = [np.array([raw], np.uint64) if isinstance(raw, int) else varints(raw) for raw in fields.get(number, [])]
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts])


def summed(values: np.ndarray) -> np.ndarray:
    """Zigzag differences to values."""
    return np.cumsum((values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64))


def blobs(uri: str) -> list[tuple[str, int, int]]:
    """(kind, offset, size) of the blobs of a file."""
    fs, path = file_system(uri)
    out = []
    with fs.open_input_file(path) as f:
        at, size = 0, f.size()
        while at < size:
            head = f.read_at(4, at)
            n = struct.unpack(">I", head)[0] if len(head) == 4 else size
            if n > 1 << 16 or at + 4 + n > size:
                raise OsmReadError(f"no blob header at byte {at}")
            fields = message(f.read_at(n, at + 4))
            if 1 not in fields or 3 not in fields:
                raise OsmReadError(f"no blob header at byte {at}")
            data = fields[3][0]
            if at + 4 + n + data > size:
                raise OsmReadError(f"the blob at byte {at} ends early")
            out.append((fields[1][0].decode(), at + 4 + n, data))
            at += 4 + n + data
    return out


def unpack(raw: bytes) -> bytes:
    fields = message(raw)
    if 1 in fields:
        return fields[1][0]
    if 3 in fields:
        return zlib.decompress(fields[3][0])
    if 4 in fields:
        return lzma.decompress(fields[4][0])
    if 7 in fields:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(fields[7][0], max_output_size=fields.get(2, [0])[0])
    raise OsmReadError("a blob is neither raw nor packed by zlib, lzma or zstd")


def meta(version, stamp, changeset, uid, user) -> dict:
    when = None if stamp is None else datetime.datetime.fromtimestamp(stamp, datetime.timezone.utc)
    return {"version": version, "timestamp": when, "changeset": changeset, "user_id": uid, "user": user}


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


def tag_maps(words: np.ndarray, count: int, text: list[str]) -> pa.Array:
    """The tags of dense nodes: for each node keys and values in turn, then a zero."""
    if not len(words):
        return pa.array([[]] * count, ARROW.field("tags").type)
    zeros = np.flatnonzero(words == 0)
    size = np.diff(zeros, prepend=-1) - 1
    if len(zeros) == count and zeros[-1] == len(words) - 1 and not (size % 2).any():
        flat = words[words != 0].astype(np.int64)
        strings = pa.array(text, pa.string())
        ends = np.concatenate([[0], np.cumsum(size // 2)]).astype(np.int32)
        return pa.MapArray.from_arrays(pa.array(ends), strings.take(pa.array(flat[0::2])), strings.take(pa.array(flat[1::2])))
    out, it = [], iter(words.tolist())  # a value may be the empty string, whose number is zero
    for _ in range(count):
        own = {}
        while (word := next(it, 0)) != 0:
            own[text[word]] = text[next(it)]
        out.append(list(own.items()))
    return pa.array(out, ARROW.field("tags").type)


def entities(block: bytes, kinds: frozenset[str] = frozenset(MEMBER_TYPES)) -> Iterator[pa.RecordBatch]:
    """The rows of a primitive block that are of these kinds; groups of others aren't decoded."""
    top = message(block)
    groups = [message(g) for g in top.get(2, [])]
    wanted = {1: "node", 2: "node", 3: "way", 4: "relation"}
    if not any(wanted.get(k) in kinds for fields in groups for k in fields):
        return
    text = [s.decode() for s in message(top[1][0]).get(1, [])]
    grain = top.get(17, [100])[0]
    lat0, lon0, date_grain = int64(top.get(19, [0])[0]), int64(top.get(20, [0])[0]), top.get(18, [1000])[0]
    angle = lambda offset, x: (offset + grain * x) * 1e-9
    tags = lambda f: dict(zip((text[i] for i in packed(f, 2).tolist()), (text[i] for i in packed(f, 3).tolist()), strict=True))

    def info(f: dict[int, list]) -> dict | None:
        if 4 not in f:
            return None
        i = message(f[4][0])
        one = lambda k: int64(i[k][0]) if k in i else None
        return meta(one(1), None if one(2) is None else one(2) * date_grain / 1000, one(3), one(4), text[i[5][0]] if 5 in i else None)

    def dense(f: dict[int, list]) -> pa.RecordBatch:
        ids, lats, lons = (summed(packed(f, k)) for k in (1, 8, 9))
        n, stamps = len(ids), pa.nulls(len(ids), STAMP)
        if 5 in f:
            i = message(f[5][0])
            columns = [packed(i, 1).astype(np.int64), *(summed(packed(i, k)) for k in (2, 3, 4, 5))]
            if all(len(c) == n for c in columns):
                stamps = pa.array([meta(v, t * date_grain / 1000, c, u, text[s]) for v, t, c, u, s in zip(*(c.tolist() for c in columns), strict=True)], STAMP)
        none = [pa.nulls(n, ARROW.field(k).type) for k in ("nodes", "members")]
        return pa.RecordBatch.from_arrays([pa.array(["node"]).take(pa.array(np.zeros(n, np.int64))), pa.array(ids), pa.array(angle(lat0, lats)), pa.array(angle(lon0, lons)), *none, tag_maps(packed(f, 10), n, text), stamps], schema=ARROW)

    for fields in groups:
        rows: list[tuple] = []
        if "node" in kinds:
            for raw in fields.get(1, []):
                f = message(raw)
                rows.append(("node", signed(f[1][0]), angle(lat0, signed(f[8][0])), angle(lon0, signed(f[9][0])), None, None, tags(f), info(f)))
            for raw in fields.get(2, []):
                yield dense(message(raw))
        for raw in fields.get(3, []) if "way" in kinds else ():
            f = message(raw)
            rows.append(("way", int64(f[1][0]), None, None, summed(packed(f, 8)).tolist(), None, tags(f), info(f)))
        for raw in fields.get(4, []) if "relation" in kinds else ():
            f = message(raw)
            types = [MEMBER_TYPES[t] if t < 3 else "unrecognized" for t in packed(f, 10).tolist()]
            members = zip(summed(packed(f, 9)).tolist(), types, (text[i] for i in packed(f, 8).tolist()), strict=True)
            rows.append(("relation", int64(f[1][0]), None, None, None, [dict(zip(("id", "type", "role"), m, strict=True)) for m in members], tags(f), info(f)))
        if rows:
            yield batch_of(rows)


def files_of(uri: str) -> list[str]:
    """The file, or the map files in a folder."""
    from pyarrow import fs as pa_fs

    fs, path = file_system(uri)
    if fs.get_file_info(path).type != pa_fs.FileType.Directory:
        return [uri]
    root = uri.rstrip("/")
    return sorted(f"{root}/{f.base_name}" for f in fs.get_file_info(pa_fs.FileSelector(path)) if f.base_name.endswith(".pbf"))


class Blob(InputPartition):
    def __init__(self, file: str, offset: int, size: int):
        super().__init__((file, offset, size))


class PbfReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri, self.kinds = uri, frozenset(MEMBER_TYPES)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes those on type; the rest is Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("type",):
                self.kinds &= {f.value}
            elif isinstance(f, In) and f.attribute == ("type",):
                self.kinds &= set(f.value)
            else:
                yield f

    def partitions(self):
        try:
            return [Blob(file, at, size) for file in files_of(self.uri) for kind, at, size in blobs(file) if kind == "OSMData"]
        except Exception as e:
            raise OsmReadError(f"Reading failed due to: {e}") from e

    def read(self, partition):
        if partition is None:  # a file without blobs
            return
        file, offset, size = partition.value
        fs, path = file_system(file)
        try:
            with fs.open_input_file(path) as f:
                yield from entities(unpack(f.read_at(size, offset)), self.kinds)
        except Exception as e:
            raise OsmReadError(f"Reading failed due to: {e}") from e


class OsmPbf(DataSource):
    @classmethod
    def name(cls):
        return "osm_pbf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PbfReader(self.options["path"])


def read(spark: SparkSession, uri: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, ways and relations of a file. An empty path or a broken file raises OsmReadError before any job starts."""
    if not uri:
        raise OsmReadError("the path of the map is empty")
    try:
        for file in files_of(uri):
            blobs(file)
    except Exception as e:
        raise OsmReadError(f"Reading failed due to: {e}") from e
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OsmPbf)
    return by_type(spark.read.format("osm_pbf").load(uri))


def read_once(spark: SparkSession, uri: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``read``, but the file is decoded once, into tables by type in the shared folder: each later read takes one type's rows and the columns it needs."""
    read(spark, uri)
    path = work_path(spark, "map")
    spark.read.format("osm_pbf").load(uri).write.partitionBy("type").parquet(path)
    return by_type(spark.read.schema(SCHEMA).parquet(path))


def by_type(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    of = lambda kind, *columns: rows.where(rows.type == kind).selectExpr(*columns, "tags", "meta")
    return of("node", "id AS node_id", "lat", "lon"), of("way", "id AS way_id", "nodes"), of("relation", "id AS rel_id", "members")


def put(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return number_bytes(number << 3) + number_bytes(value)
    return number_bytes(number << 3 | 2) + number_bytes(len(value)) + value


def number_bytes(x: int) -> bytes:
    x &= (1 << 64) - 1
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes([*out, x])


def zigzag(x: int) -> int:
    return x << 1 ^ x >> 63


def put_packed(number: int, values: list[int]) -> bytes:
    return put(number, b"".join(map(number_bytes, values)))


def differences(values: list[int]) -> list[int]:
    return [zigzag(b - a) for a, b in zip([0, *values], values, strict=False)]


def write(path: str, nodes=(), ways=(), relations=(), dense: bool = True, per_block: int = 8000, packing: str = "zlib") -> None:
    """A file of nodes (id, lat, lon, tags), ways (id, node ids, tags) and relations (id, [(id, type, role)], tags); blobs are raw or packed by zlib, lzma or zstd."""

    def pack(raw: bytes) -> bytes:
        if packing == "zstd":
            import zstandard

            return put(7, zstandard.ZstdCompressor().compress(raw))
        return {"raw": lambda: put(1, raw), "zlib": lambda: put(3, zlib.compress(raw)), "lzma": lambda: put(4, lzma.compress(raw))}[packing]()

    def blob(kind: str, raw: bytes) -> bytes:
        body = put(2, len(raw)) + pack(raw)
        head = put(1, kind.encode()) + put(3, len(body))
        return struct.pack(">I", len(head)) + head + body

    def block(kind: str, rows: list) -> bytes:
        table: dict[str, int] = {"": 0}
        at = lambda s: table.setdefault(s, len(table))
        tagged = lambda tags: put_packed(2, [at(k) for k in tags]) + put_packed(3, [at(v) for v in tags.values()])
        fine = lambda x: round(x * 1e7)
        if kind == "node" and dense:
            words = [w for _, _, _, tags in rows for w in [*(x for k, v in tags.items() for x in (at(k), at(v))), 0]]
            group = put(2, put_packed(1, differences([r[0] for r in rows])) + put_packed(8, differences([fine(r[1]) for r in rows])) + put_packed(9, differences([fine(r[2]) for r in rows])) + put_packed(10, words))
        elif kind == "node":
            group = b"".join(put(1, put(1, zigzag(i)) + tagged(t) + put(8, zigzag(fine(a))) + put(9, zigzag(fine(o)))) for i, a, o, t in rows)
        elif kind == "way":
            group = b"".join(put(3, put(1, i) + tagged(t) + put_packed(8, differences(refs))) for i, refs, t in rows)
        else:
            group = b"".join(
                put(4, put(1, i) + tagged(t) + put_packed(8, [at(m[2]) for m in ms]) + put_packed(9, differences([m[0] for m in ms])) + put_packed(10, [MEMBER_TYPES.index(m[1]) for m in ms]))
                for i, ms, t in rows
            )
        return blob("OSMData", put(1, b"".join(put(1, s.encode()) for s in table)) + put(2, group))

    parts = [blob("OSMHeader", put(4, b"OsmSchema-V0.6") + put(4, b"DenseNodes"))]
    for kind, rows in (("node", list(nodes)), ("way", list(ways)), ("relation", list(relations))):
        parts += [block(kind, rows[i : i + per_block]) for i in range(0, len(rows), per_block)]
    fs, place = file_system(path)
    with fs.open_output_stream(place) as f:
        f.write(reduce(lambda a, b: a + b, parts))


def write_tables(nodes: DataFrame, ways: DataFrame, relations: DataFrame, path: str, packing: str = "zlib") -> None:
    """A folder of map files: nodes (node_id, lat, lon, tags), ways (way_id, nodes, tags), relations (rel_id, members, tags). Each task writes its rows, a file a batch."""

    def rows_of(kind: str, batch: pa.RecordBatch) -> list[tuple]:
        columns = [c.to_pylist() for c in batch.columns]
        columns[-1] = [dict(t or ()) for t in columns[-1]]
        if kind == "relations":
            columns[1] = [[(m["id"], m["type"], m["role"]) for m in ms] for ms in columns[1]]
        return list(zip(*columns, strict=True))

    def step(kind: str):
        def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context = TaskContext.get()
            fs, folder = file_system(path)
            for k, batch in enumerate(b for b in given if b.num_rows):
                name = f"{kind}-{context.partitionId():06d}-{k:06d}"
                trial = f"{path}/.{name}.{context.taskAttemptId()}"
                write(trial, **{kind: rows_of(kind, batch)}, packing=packing)
                fs.move(file_system(trial)[1], f"{folder}/{name}.pbf")
                yield pa.RecordBatch.from_pydict({"file": [f"{name}.pbf"]})

        return batches

    fs, folder = file_system(path)
    fs.create_dir(folder, recursive=True)
    tables = {"nodes": nodes.select("node_id", "lat", "lon", "tags"), "ways": ways.select("way_id", "nodes", "tags"), "relations": relations.select("rel_id", "members", "tags")}
    written = [df.mapInArrow(step(kind), "file string") for kind, df in tables.items()]
    reduce(DataFrame.unionByName, written).agg(F.count(F.lit(1))).first()
