"""Shared plumbing of the corpus operators.

Bucketed request / reply.  Operators that compare every document with every other never ship
rows per word or byte.  ``bucketed`` shuffles the texts once into balanced buckets; each bucket
summarises itself (local duplicates collapse here, so a key that a third of all rows share is sent
once a bucket, not once a row) and posts one packed message per hash range; ``reduce_parts`` joins
the messages of a range and answers every bucket with bits aligned to what it sent.  Messages are
deterministic functions of a bucket's sorted rows, so a lost executor only costs recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = -(2**63)
REQUEST = "part int, bucket int, kind int, payload binary"
REPLY = "bucket int, part int, kind int, payload binary"
_REQUEST_PA = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_REPLY_PA = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
DATA, MEMO = 0, 1


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local master without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kartolith-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark would give it, for readers outside the JVM."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(place).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of ``written`` that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_written_at", None)
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


_C1, _C2, _C3, _C4, _C5 = (pow(c, -1, 2**32) for c in (0xCC9E2D51, 0x1B873593, 5, 0x85EBCA6B, 0xC2B2AE35))


class _Ints:
    """32-bit operations on 64-bit numpy integers or columns."""

    low = 2**32 - 1

    def __init__(self, xor, shr, shl, keep, times, plus):
        self.xor, self.shr, self.shl, self.keep, self.times, self.plus = xor, shr, shl, keep, times, plus

    def mul(self, x, m: int):
        return self.keep(self.plus(self.times(x, m & 0xFFFF), self.shl(self.keep(self.times(x, m >> 16), 0xFFFF), 16)), self.low)

    def rotr(self, x, n: int):
        return self.keep(self.plus(self.shr(x, n), self.shl(x, 32 - n)), self.low)


#: Spark's hash of an int (Murmur3 of 4 bytes, seed 42), undone step by step.
_UNDO = (
    lambda o, h: o.xor(h, o.shr(h, 16)),
    lambda o, h: o.mul(h, _C5),
    lambda o, h: o.xor(o.xor(h, o.shr(h, 13)), o.shr(h, 26)),
    lambda o, h: o.mul(h, _C4),
    lambda o, h: o.xor(h, o.shr(h, 16)),
    lambda o, h: o.keep(o.plus(o.xor(h, 4), 2**32 - 0xE6546B64), o.low),
    lambda o, h: o.mul(h, _C3),
    lambda o, h: o.xor(o.rotr(h, 13), 42),
    lambda o, h: o.mul(h, _C2),
    lambda o, h: o.rotr(h, 15),
    lambda o, h: o.mul(h, _C1),
)
_NUMPY = _Ints(lambda x, y: x ^ np.int64(y) if isinstance(y, int) else x ^ y, lambda x, n: x >> n, lambda x, n: x << n, lambda x, m: x & m, lambda x, m: x * m, lambda x, y: x + y)
_long = lambda x: F.lit(x).cast("long") if isinstance(x, int) else x
_COLUMNS = _Ints(lambda x, y: x.bitwiseXOR(_long(y)), F.shiftright, F.shiftleft, lambda x, m: x.bitwiseAND(_long(m)), lambda x, m: x * _long(m), lambda x, y: x + _long(y))


def balanced_labels(width: int, each: int) -> np.ndarray:
    """width * each int labels; repartition(width, label) puts label i in partition i % width."""
    h = np.arange(width * each, dtype=np.int64)
    for step in _UNDO:
        h = step(_NUMPY, h)
    return h.astype(np.uint32).view(np.int32)


def with_label(df: DataFrame, slot: Column, name: str = "bucket") -> DataFrame:
    """df with the label of a slot, for slots of any number; a projection a step, so that no step is evaluated twice."""
    df = df.withColumn(name, slot.cast("long"))
    for step in _UNDO:
        df = df.withColumn(name, step(_COLUMNS, F.col(name)))
    return df.withColumn(name, F.when(F.col(name) >= 2**31, F.col(name) - 2**32).otherwise(F.col(name)).cast("int"))


def dealt(df: DataFrame, width: int, each: int, *by: Column | str) -> DataFrame:
    """df with a ``bucket`` by hash, partitioned by it: every partition holds ``each`` of the width * each buckets."""
    return with_label(df, F.pmod(F.xxhash64(*by), F.lit(width * each))).repartition(width, "bucket")


def bucketed(docs: DataFrame, id_col: str, text_col: str, each: int, carry: str | None = None) -> tuple[DataFrame, int]:
    """(bucket, doc_id, text) with nulls replaced, hash-partitioned by bucket; and the partition count.

    carry: a column that travels along as ``carried``.

    Rows of one identifier share a bucket, but rows without one are spread by text and input partition.  All later steps
    of one query start from this frame, whose exchange Spark reuses, so texts move once.
    """
    width = shuffle_width(docs.sparkSession)
    spread = F.when(F.col("doc_id") == NULL_ID, F.xxhash64("text", F.spark_partition_id())).otherwise(F.lit(0))
    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *([F.col(f"`{carry}`").alias("carried")] if carry else []),
    )
    return dealt(rows, width, each, "doc_id", spread).select("bucket", "doc_id", "text", *(["carried"] if carry else [])), width


def null_ids(df: DataFrame, *cols: str) -> DataFrame:
    """Turns the stand-in for a null identifier into null again."""
    return df.withColumns({c: F.when(F.col(c) != NULL_ID, F.col(c)) for c in cols})


def _ordered(table: pa.Table) -> pa.Table:
    """In the bucket's one order.  Texts get 64-bit offsets: a bucket may hold more than 2 GiB."""
    at = table.schema.get_field_index("text")
    table = table.set_column(at, "text", table.column(at).cast(pa.large_string()))
    return table.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])


def bucket_carried(table: pa.Table) -> pa.Array:
    """The carried column in the order of ``bucket_rows``."""
    return _ordered(table.select(["doc_id", "text", "carried"])).column("carried").combine_chunks()


def bucket_rows(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """bucket, ids, bytes, offsets of a bucket in its one order: by doc_id, then text."""
    order = _ordered(table.select(["bucket", "doc_id", "text"]))
    ids = order.column("doc_id").to_numpy()
    data, off = utf8(order.column("text"))
    return int(table.column("bucket")[0].as_py()), ids, data, off


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls, without copying."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], col.type)
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def string_array(data: np.ndarray, off: np.ndarray, binary: bool = False) -> pa.ChunkedArray:
    """A string or binary column, in chunks of less than 2 GiB."""
    data, chunks, a = np.ascontiguousarray(data), [], 0
    while True:
        b = len(off) - 1 if off[-1] - off[a] < 2**31 else max(a + 1, int(np.searchsorted(off, off[a] + 2**31 - 1, side="right")) - 1)
        places, part = pa.py_buffer((off[a : b + 1] - off[a]).astype(np.int32)), pa.py_buffer(data[off[a] : off[b]])
        chunks.append(pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, places, part]) if binary else pa.StringArray.from_buffers(b - a, places, part))
        if b == len(off) - 1:
            return pa.chunked_array(chunks)
        a = b


def requests_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(cols, _REQUEST_PA)], schema=_REQUEST_PA)


def replies_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(cols, _REPLY_PA)], schema=_REPLY_PA)


def part_edges(n: int) -> np.ndarray:
    """Starts of n equal ranges of the 64-bit hashes."""
    return np.array([(i << 64) // n for i in range(n)], dtype=np.uint64)


def messages(table: pa.Table) -> list[tuple[int, int, bytes]]:
    """(bucket or part, kind, payload) in one order; the first column is the part or bucket itself."""
    names = [c for c in table.column_names if c in ("bucket", "part")][1]
    rows = zip(table.column(names).to_pylist(), table.column("kind").to_pylist(), table.column("payload").to_pylist())
    return sorted(rows, key=lambda r: (r[1], r[0]))


def reduce_parts(requests: DataFrame, width: int, answer) -> DataFrame:
    """Groups requests by part, applies ``answer`` and sends the replies to their buckets' partitions."""
    return requests.repartition(width, "part").groupBy("part").applyInArrow(answer, REPLY).repartition(width, "bucket")


def pack_bits(x: np.ndarray) -> bytes:
    return np.packbits(x.astype(bool)).tobytes()


def unpack_bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
