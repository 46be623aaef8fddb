"""Operator 2: exact deduplication by a content sort.

Sampled splitters range-partition the (normalised) texts by their first characters, a hash and the
identifier, an external sort puts equal texts side by side, and each text is compared in full with its
neighbour.  The identifier in the splitters lets a text that a third of all rows share spread over many
partitions; only the first and the last run of a partition can continue next door, so at most two texts
a partition are compared across.  The splitters sample bounded prefixes, never whole texts.

Null text: empty.  Null id: the smallest.  Repeated rows (equal id and text): exactly one is kept.
Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import NULL_ID, null_ids, shuffle_width, utf8, written

PREFIX = 32
_OUT = pa.schema([("doc_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("stays", pa.bool_()), ("digest", pa.binary()), ("edge", pa.string()), ("edge_text", pa.string())])
_OUT_DDL = "doc_id long, keep_id long, group_size long, stays boolean, digest binary, edge string, edge_text string"


class _Run:
    """A run of equal texts, in the order of their identifiers."""

    def __init__(self, text: bytes, number: int):
        self.text, self.number = text, number
        self.digest = hashlib.sha256(text).digest()
        self.ids: list[np.ndarray] = []

    def rows(self, largest: bool, edge: str | None) -> pa.Table:
        ids = np.concatenate(self.ids)
        n = len(ids)
        stays = np.zeros(n, bool)
        stays[n - 1 if largest else 0] = True
        keep = ids[-1 if largest else 0]
        texts = [self.text.decode()] + [None] * (n - 1) if edge else [None] * n
        return pa.table([ids, np.full(n, keep), np.full(n, n), stays, pa.array([self.digest] * n, pa.binary()), pa.array([edge] * n, pa.string()), pa.array(texts, pa.string())], schema=_OUT)


def _neighbours(largest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        open_: _Run | None = None
        number = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, h = batch.column("doc_id").to_numpy(), batch.column("h").to_numpy()
            data, off = utf8(batch.column("text"))
            view, size = memoryview(data), np.diff(off)
            alike = np.zeros(len(ids), bool)
            alike[1:] = (h[1:] == h[:-1]) & (size[1:] == size[:-1])
            for i in np.flatnonzero(alike).tolist():
                alike[i] = view[off[i] : off[i + 1]] == view[off[i - 1] : off[i]]
            leads = np.flatnonzero(~alike)
            ends = np.append(leads[1:], len(ids))
            ready: list[pa.Table] = []
            plain: list[tuple[int, int, bytes]] = []
            for a, b in zip(leads.tolist(), ends.tolist()):
                text = view[off[a] : off[a + 1]]
                if open_ is not None and a == 0 and open_.text == text:
                    open_.ids.append(ids[a:b])
                    continue
                if open_ is not None:
                    ready.append(open_.rows(largest, None if open_.number else f"{place}:0"))
                    open_ = None
                if b == len(ids) or number == 0:
                    open_ = _Run(bytes(text), number)
                    open_.ids.append(ids[a:b])
                else:
                    plain.append((a, b, hashlib.sha256(text).digest()))
                number += 1
            if plain:
                a = np.array([p[0] for p in plain])
                n = np.array([p[1] for p in plain]) - a
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
                pick = a + n - 1 if largest else a
                ready.append(pa.table([ids[at], np.repeat(ids[pick], n), np.repeat(n, n), at == np.repeat(pick, n), pa.array([p[2] for p, k in zip(plain, n.tolist()) for _ in range(k)], pa.binary()), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.string())], schema=_OUT))
            for t in ready:
                yield from t.to_batches()
        if open_ is not None:
            yield from open_.rows(largest, f"{place}:{open_.number}").to_batches()

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, keep: str = "smallest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    normalise: an expression for the text to compare (the text itself by default).
    keep: "smallest" or "largest" identifier of a group.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be smallest or largest")
    spark = docs.sparkSession
    text = F.coalesce((F.col(f"`{text_col}`") if normalise is None else normalise).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text.alias("text"))
    keys = [F.substring("text", 1, PREFIX).alias("p"), F.xxhash64("text").alias("h")]
    ordered = rows.select("doc_id", "text", *keys).repartitionByRange(shuffle_width(spark), "p", "h", "doc_id").sortWithinPartitions("p", "h", "text", "doc_id")
    local = written(ordered.select("doc_id", "text", "h").mapInArrow(_neighbours(keep == "largest"), _OUT_DDL), "exact")
    best = F.max if keep == "largest" else F.min
    edges = local.where(F.col("edge_text").isNotNull()).select("edge", "edge_text", "keep_id", "group_size")
    whole = edges.groupBy("edge_text").agg(best("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"))
    across = edges.join(whole, "edge_text").select("edge", "all_keep", "all_size")  # two rows a partition at most
    out = local.join(F.broadcast(across), "edge", "left").select(
        "doc_id",
        F.coalesce("all_keep", "keep_id").alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"),
        (F.col("stays") & (F.coalesce("all_keep", "keep_id") == F.col("doc_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return null_ids(out, "doc_id", "keep_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")
