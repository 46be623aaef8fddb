"""Vector-tile bytes (MVT 2.1, gzip) for point features, and folders of such tiles.

The tile table is the system of record; bytes are an export, encoded in Arrow batches, one tile a row.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENT = 4096


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _value(v: bool | int | float | str) -> bytes:
    if isinstance(v, bool):
        return _varint(7 << 3) + _varint(int(v))
    if isinstance(v, int):
        return _varint(4 << 3) + _varint(v & ((1 << 64) - 1))
    if isinstance(v, float):
        return _varint(3 << 3 | 1) + struct.pack("<d", v)
    return _field(1, v.encode())


def layer(name: str, features: list[tuple[int | None, int, int, dict]], extent: int = EXTENT) -> bytes:
    """One layer of points (id, px, py, properties); keys and values are pooled."""
    keys: dict[str, int] = {}
    values: dict[tuple[type, object], int] = {}
    body = _varint(15 << 3) + _varint(2) + _field(1, name.encode())
    for id_, px, py, properties in features:
        tags = b"".join(_varint(keys.setdefault(k, len(keys))) + _varint(values.setdefault((type(v), v), len(values))) for k, v in properties.items() if v is not None)
        zigzag = lambda n: _varint(((n << 1) ^ (n >> 63)) & ((1 << 64) - 1))
        feature = (b"" if id_ is None else _varint(1 << 3) + _varint(id_)) + (_field(2, tags) if tags else b"") + _varint(3 << 3) + _varint(1)
        body += _field(2, feature + _field(4, _varint(1 << 3 | 1) + zigzag(px) + zigzag(py)))
    body += b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, _value(v)) for _, v in values)
    return body + _varint(5 << 3) + _varint(extent)


def tile(layers: dict[str, bytes]) -> bytes:
    return gzip.compress(b"".join(_field(3, body) for body in layers.values()), mtime=0)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if b[at - 1] < 128:
            return n, at


def _fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
    at = 0
    while at < len(b):
        key, at = _read_varint(b, at)
        if key & 7 == 2:
            n, at = _read_varint(b, at)
            yield key >> 3, b[at : at + n]
            at += n
        elif key & 7 == 1:
            yield key >> 3, b[at : at + 8]
            at += 8
        else:
            n, at = _read_varint(b, at)
            yield key >> 3, n


def decode(raw: bytes) -> dict[str, list[tuple[int | None, int, int, dict]]]:
    """Layers of point features of a tile (gzipped or not)."""
    out = {}
    for _, body in _fields(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
        parts = list(_fields(body))
        keys = [v.decode() for k, v in parts if k == 3]
        values = []
        for k, v in parts:
            if k == 4:
                (kind, x), *_ = _fields(v)
                values.append(x.decode() if kind == 1 else struct.unpack("<d", x)[0] if kind == 3 else bool(x) if kind == 7 else x - (1 << 64) if x >> 63 else x)
        features = []
        for k, v in parts:
            if k == 2:
                f = dict(_fields(v))
                numbers = lambda b: [n for at in [0] for n in _numbers(b, at)]
                tags, geometry = numbers(f.get(2, b"")), numbers(f[4])
                zag = lambda n: (n >> 1) ^ -(n & 1)
                features.append((f.get(1), zag(geometry[1]), zag(geometry[2]), {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2])}))
        out[next(v for k, v in parts if k == 1).decode()] = features
    return out


def _numbers(b: bytes, at: int) -> Iterator[int]:
    while at < len(b):
        n, at = _read_varint(b, at)
        yield n


def _encode(name: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for features in batch.column("features").to_pylist():
                rows = []
                for f in features:
                    code, c, r = f["cell"], 0, 0
                    for i in range(bits):
                        c |= (code >> 2 * i & 1) << i
                        r |= (code >> 2 * i + 1 & 1) << i
                    step = EXTENT >> bits
                    rows.append((code, c * step + step // 2, r * step + step // 2, {**dict(f["values"]), "__id": code}))
                raw.append(tile({name: layer(name, rows)}))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in "zxy"), pa.array(raw, pa.binary())], names=["z", "x", "y", "mvt"])

    return run


def encode_tiles(features: DataFrame, name: str, bits: int) -> DataFrame:
    """z, x, y, mvt of features (z, x, y, cell, values map); cells of a tile are at most 4**bits, so a row stays bounded."""
    rows = features.groupBy("z", "x", "y").agg(F.array_sort(F.collect_list(F.struct("cell", F.map_entries("values").alias("values")))).alias("features"))
    rows = rows.select("z", "x", "y", F.transform("features", lambda f: F.struct(f["cell"].alias("cell"), F.map_from_entries(f["values"]).alias("values"))).alias("features"))
    return rows.mapInArrow(_encode(name, bits), "z int, x long, y long, mvt binary")


def export(tiles: DataFrame, folder: str) -> DataFrame:
    """Writes every tile to folder/z/x/y.mvt; returns (z, x, y, size). Evaluate the result to write."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
        for batch in batches:
            sizes = []
            for z, x, y, raw in zip(*(batch.column(c).to_pylist() for c in ("z", "x", "y", "mvt"))):
                files.create_dir(f"{base}/{z}/{x}", recursive=True)
                with files.open_output_stream(f"{base}/{z}/{x}/{y}.mvt", compression=None) as f:
                    f.write(raw)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in "zxy"), pa.array(sizes, pa.int64())], names=["z", "x", "y", "size"])

    return tiles.mapInArrow(run, "z int, x long, y long, size long")


_READ = "z int, x long, y long, layer string, id long, px int, py int, properties map<string,string>"
_READ_PA = pa.schema([("z", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("layer", pa.string()), ("id", pa.int64()), ("px", pa.int32()), ("py", pa.int32()), ("properties", pa.map_(pa.string(), pa.string()))])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            z, x, y = path.removesuffix(".mvt").split("/")[-3:]
            for name, features in decode(raw).items():
                rows += [(int(z), int(x), int(y), name, i, px, py, [(k, str(v)) for k, v in p.items()]) for i, px, py, p in features]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ_PA)], schema=_READ_PA)


def read_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Point features of folder/z/x/y.mvt: z, x, y, layer, id, px, py, properties; a missing folder has none."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.mvt").option("recursiveFileLookup", True).load(folder)
    except AnalysisException:
        return spark.createDataFrame([], _READ)
    return found.select("path", "content").mapInArrow(_decode, _READ)
