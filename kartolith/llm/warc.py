"""Operator 9: WARC archives with a Merkle fixity audit.

``write_warc`` writes rows as WARC/1.1 resource records, one gzip member each, one file a task, and
returns the index: the ordered offset ranges of every file.  ``read_warc`` reads such files back.

``merkle_tree`` hashes every record's stored bytes and then ordered groups of ``FANOUT`` neighbouring
ranges, level by level, up to one root a file; a node binds its offset range and its children's
digests.  ``audit`` compares the roots of two replicas and descends only below nodes that differ,
one level a step, until it holds the differing records: both trees' nodes of a level are cut down to the children of
suspects before they are compared, so one damaged record costs ``FANOUT`` nodes a level.  Ranges come from the index, so a replica whose
records no longer parse, or that is cut short, is audited all the same.

Files are written under a name of their own and then renamed, so a repeated task does no harm; file
names and bytes depend on the input alone.  A tree's nodes are stored by level, each with the level of its root, and
joins are on (file, node), which no hot value can overload.  Paths without a scheme are on Spark's default file system.

Null payload: empty record.  Null name: no target URI.  Null identifiers are stored as absent and read as
null.  Very long payloads: one record each, held in memory one at a time.  Repeated rows: one record each.  Empty table: no files, empty index, empty audit.  Columns other
than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, qualified, shared_dir, written

FANOUT = 16
DATE = "2024-01-01T00:00:00Z"
_INDEX = "file string, ordinal long, offset long, length long, record_id long"
_INDEX_PA = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.int64())])
_RECORD = "file string, ordinal long, offset long, length long, record_id long, uri string, payload binary"
_RECORD_PA = pa.schema([*_INDEX_PA, ("uri", pa.string()), ("payload", pa.binary())])
_NODE = "file string, level int, node long, first_offset long, end_offset long, digest binary, top int"
_NODE_PA = pa.schema([("file", pa.string()), ("level", pa.int32()), ("node", pa.int64()), ("first_offset", pa.int64()), ("end_offset", pa.int64()), ("digest", pa.binary()), ("top", pa.int32())])
_HIDE = {ord(c): f"%{ord(c):02X}" for c in "\r\n%"}


def _place(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path)


def record(payload: bytes, uri: str | None, record_id: int | None, name: str, date: str = DATE) -> bytes:
    """One WARC record as a gzip member; line breaks and percent signs of the URI are escaped."""
    head = [
        "WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16])}>", f"WARC-Date: {date}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", "Content-Type: text/html", f"Content-Length: {len(payload)}",
    ]
    if uri is not None:
        head.append(f"WARC-Target-URI: {uri.translate(_HIDE)}")
    if record_id is not None:
        head.append(f"X-Row-ID: {record_id}")
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + pack.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def _write(paths: list[str], harm: Callable[[int | None, str | None, bytes], bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        attempt = uuid.uuid4().hex
        places = [_place(p) for p in paths]
        outs, ordinal, offset = [], 0, 0
        for batch in batches:
            rows = []
            for record_id, uri, payload in zip(*(batch.column(c).to_pylist() for c in ("record_id", "uri", "payload"))):
                if not outs:
                    outs = [f.open_output_stream(f"{d}/.{name}-{attempt}", compression=None) for f, d in places]
                raw = record(payload or b"", uri, record_id, f"{name}#{ordinal}")
                outs[0].write(raw)
                for out in outs[1:]:
                    out.write(harm(record_id, uri, raw) if harm else raw)
                rows.append((name, ordinal, offset, len(raw), record_id))
                ordinal, offset = ordinal + 1, offset + len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _INDEX_PA)], schema=_INDEX_PA)
        for out, (files, d) in zip(outs, places):
            out.close()
            files.move(f"{d}/.{name}-{attempt}", f"{d}/{name}")

    return run


def write_warc(rows: DataFrame, paths: list[str], id_col: str, uri_col: str, payload_col: str, harm: Callable[[int | None, str | None, bytes], bytes] | None = None) -> DataFrame:
    """Writes one archive, and equal replicas of it, to ``paths``; returns the index.

    harm: what happens to the stored bytes of a record in all replicas but the first (for tests of the audit); it
    must keep their number.
    """
    paths = [qualified(rows.sparkSession, p) for p in paths]
    for p in paths:
        files, d = _place(p)
        files.create_dir(d, recursive=True)
    picked = rows.select(F.col(f"`{id_col}`").cast("long").alias("record_id"), F.col(f"`{uri_col}`").cast("string").alias("uri"), F.col(f"`{payload_col}`").cast("binary").alias("payload"))
    return written(picked.mapInArrow(_write(paths, harm), _INDEX), "warc-index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    files, d = _place(path)
    names = sorted(x.base_name for x in files.get_file_info(FileSelector(d, allow_not_found=True)) if x.base_name.endswith(".warc.gz"))
    return spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, len(names)), "file")


def _read(path: str, chunk: int = 1 << 16):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, d = _place(path)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held, offset, ordinal = [], 0, 0, 0
                with files.open_input_stream(f"{d}/{name}", compression=None) as f:
                    rest = b""
                    while rest or (rest := f.read(chunk)):
                        member, text, length = zlib.decompressobj(31), [], 0
                        while not member.eof:
                            if not rest and not (rest := f.read(chunk)):
                                raise ValueError(f"{name} ends inside the record at {offset}")
                            text.append(member.decompress(rest))
                            length += len(rest) - len(member.unused_data)
                            rest = member.unused_data
                        headers, payload = parse(b"".join(text))
                        uri, row = headers.get("warc-target-uri"), headers.get("x-row-id")
                        if uri is not None:
                            uri = uri.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
                        rows.append((name, ordinal, offset, length, None if row is None else int(row), uri, payload))
                        held += len(payload)
                        ordinal, offset = ordinal + 1, offset + length
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f_.type) for c, f_ in zip(zip(*rows), _RECORD_PA)], schema=_RECORD_PA)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f_.type) for c, f_ in zip(zip(*rows), _RECORD_PA)], schema=_RECORD_PA)

    return run


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all ``*.warc.gz`` files in ``path``: file, ordinal, offset, length, record_id, uri, payload.

    Raises ValueError for a file that is damaged; audit it to learn where.
    """
    path = qualified(spark, path)
    return _files(spark, path).mapInArrow(_read(path), _RECORD)


def tree_levels(digests: list[tuple[int, int, bytes]], fanout: int = FANOUT) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(level, node, first offset, end offset, digest) of all nodes over ordered (first, end, digest) leaves."""
    level, now = 0, digests
    while True:
        for i, (a, b, d) in enumerate(now):
            yield level, i, a, b, d
        if len(now) <= 1:
            return
        groups = [now[i : i + fanout] for i in range(0, len(now), fanout)]
        now = [(g[0][0], g[-1][1], hashlib.sha256(b"".join(x.to_bytes(8, "big") for c in g for x in c[:2]) + b"".join(c[2] for c in g)).digest()) for g in groups]
        level += 1


def _hash(path: str):
    def run(table: pa.Table) -> pa.Table:
        files, d = _place(path)
        name = table.column("file")[0].as_py()
        ranges = sorted(zip(table.column("offset").to_pylist(), table.column("length").to_pylist()))
        leaves, end = [], 0
        try:
            stream = files.open_input_file(f"{d}/{name}")
        except FileNotFoundError:
            return pa.Table.from_batches([], schema=_NODE_PA)
        with stream as f:
            size = f.size()
            for offset, length in ranges:
                if offset != f.tell():
                    f.seek(min(offset, size))
                leaves.append((offset, offset + length, hashlib.sha256(f.read(length) if offset < size else b"").digest()))
                end = max(end, offset + length)
            if size > end:  # bytes after the last range
                leaves.append((end, end + 1, b"more"))
        nodes = list(tree_levels(leaves))
        top = max((x[0] for x in nodes), default=0)
        return pa.Table.from_arrays([pa.array([name] * len(nodes)), *(pa.array(c, f_.type) for c, f_ in zip(zip(*nodes), list(_NODE_PA)[1:-1])), pa.array([top] * len(nodes), pa.int32())], schema=_NODE_PA)

    return run


def merkle_tree(index: DataFrame, path: str) -> DataFrame:
    """Nodes of the trees of all indexed files as stored in ``path``: file, level, node, first_offset, end_offset, digest, top.

    One task reads one file in order, and skips what the index leaves out.  Level 0 holds the records; ``top`` is the level of the
    file's root.
    """
    spark = index.sparkSession
    nodes = index.select("file", "offset", "length").groupBy("file").applyInArrow(_hash(qualified(spark, path)), _NODE)
    at = f"{shared_dir(spark)}/merkle-{uuid.uuid4().hex}"
    nodes.write.partitionBy("level").option("compression", "zstd").parquet(at)
    return spark.read.schema(nodes.schema).parquet(at)


def below(tree: DataFrame, level: int, suspects: DataFrame | None, fanout: int = FANOUT) -> DataFrame:
    """The nodes of a level that a descent reads: children of ``suspects`` (file, node one level up), and roots."""
    rows = tree.where(F.col("level") == level).select("file", "node", "first_offset", "end_offset", "digest", "top")
    roots = rows.where(F.col("top") == level)
    if suspects is None:
        return roots.drop("top")
    above = suspects.select("file", F.col("node").alias("parent"))
    under = rows.where(F.col("top") > level).withColumn("parent", F.floor(F.col("node") / fanout)).join(above, ["file", "parent"], "left_semi").drop("parent")
    return under.select(roots.columns).union(roots).drop("top")


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Differing records of two replicas' trees: file, ordinal, first_offset, end_offset, state.

    state: ``changed``, or ``missing`` / ``extra`` where only the left / the right tree has the range.
    """
    level = max([x for (x,) in left.agg(F.max("level")).union(right.agg(F.max("level"))).collect() if x is not None], default=0)
    suspects = None
    while level >= 0:
        mine, yours = (below(t, level, suspects, fanout) for t in (left, right))
        pairs = mine.alias("a").join(yours.alias("b"), ["file", "node"], "full").where(~F.col("a.digest").eqNullSafe(F.col("b.digest")) | ~F.col("a.end_offset").eqNullSafe(F.col("b.end_offset")))
        state = F.when(F.col("b.digest").isNull(), "missing").when(F.col("a.digest").isNull(), "extra").otherwise("changed")
        pairs = pairs.select("file", "node", F.coalesce("a.first_offset", "b.first_offset").alias("first_offset"), F.coalesce("a.end_offset", "b.end_offset").alias("end_offset"), state.alias("state"))
        above, suspects = suspects, written(pairs, "suspects")
        if above is not None:
            discard(above)
        level -= 1
    return suspects.withColumnRenamed("node", "ordinal")


def flip(record_id: int | None, uri: str | None, raw: bytes) -> bytes:
    """Damages about one record in 256, chosen by its identifier and name, in one byte."""
    if hashlib.md5(f"{'' if record_id is None else record_id} {uri or ''}".encode()).digest()[0]:
        return raw
    at = len(raw) // 2
    return raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page twice, damages the second replica (``flip``), and audits it; texts are read back from the first."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    base = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    good, bad = f"{base}/a", f"{base}/b"
    index = write_warc(pages, [good, bad], "page_id", "url", "html", harm=flip)
    wrong = audit(merkle_tree(index, good), merkle_tree(index, bad))
    stored = read_warc(spark, good).select("file", "ordinal", F.col("record_id").alias("page_id"), "uri", F.length("payload").cast("long").alias("n_bytes"), F.sha2("payload", 256).alias("payload_sha256"))
    return stored.join(wrong.select("file", "ordinal", F.lit(False).alias("same")), ["file", "ordinal"], "left").select("page_id", F.col("uri").alias("url"), "n_bytes", "payload_sha256", F.coalesce("same", F.lit(True)).alias("intact"))
