"""Operator 6: line deduplication with levelled sorted runs of line hashes.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` and lower-cased (A-Z).  Keys of ``min_chars``
code points held by ``min_docs`` documents lose all their lines except in the largest document that
holds them.  Keys are 128-bit digests.

``SortedRuns`` is the index of one hash range.  A batch (what one bucket of documents holds, already
aggregated) is merge-anti-joined with the runs, newest level first: keys found there are updated, the
others become a new run; ``fanout`` runs of a level are merged into one of the next.  Hash ranges are
independent tasks, and a key that a third of all rows hold reaches its range once a bucket.

Null or empty text: one empty line.  Very long texts: whole, in the bucket of their document.  Null id: the smallest.  Repeated ids count as one document.
Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import REQUEST, DATA, NULL_ID, balanced_labels, bucket_carried, bucket_rows, bucketed, messages, null_ids, pack_bits, reduce_parts, replies_table, requests_table, string_array, unpack_bits
from ._hashing import IS_WS, LOWER, classes, dense_rank
from .substring_dedup import _slices

#: What a document without an identifier counts in a bucket; over all buckets it is one.
NAMELESS = 1 << 40


class SortedRuns:
    """Levels of sorted runs (h1, h2, documents, largest document), compacted when a level is full."""

    def __init__(self, fanout: int = 4):
        self.fanout = fanout
        self.levels: list[list[tuple[np.ndarray, ...]]] = [[]]

    def add(self, h1: np.ndarray, h2: np.ndarray, docs: np.ndarray, top: np.ndarray) -> None:
        """Merges a batch sorted by h1; keys must be unique in it."""
        for level in self.levels:
            for r1, r2, n, t in reversed(level):
                if not len(h1):
                    return
                at = np.minimum(np.searchsorted(r1, h1), len(r1) - 1)
                hit = (r1[at] == h1) & (r2[at] == h2)
                n[at[hit]] += docs[hit]
                t[at[hit]] = np.maximum(t[at[hit]], top[hit])
                h1, h2, docs, top = h1[~hit], h2[~hit], docs[~hit], top[~hit]
        if len(h1):
            self.levels[0].append((h1, h2, docs.copy(), top.copy()))
            self._compact()

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._merge(self.levels[k]))
                self.levels[k] = []

    @staticmethod
    def _merge(runs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        h1, h2, n, t = (np.concatenate(c) for c in zip(*runs))
        order, first = classes(h1, h2)
        lead = order[first]
        return h1[lead], h2[lead], np.add.reduceat(n[order], first), np.maximum.reduceat(t[order], first)

    def merged(self) -> tuple[np.ndarray, ...]:
        """One run with everything."""
        return self._merge([r for level in self.levels for r in level])


class _Lines:
    """Lines of a bucket and its unique keys with their documents."""

    def __init__(self, table: pa.Table, min_chars: int):
        self.bucket, self.ids, self.data, self.off = bucket_rows(table)
        data, off = self.data, self.off
        breaks = np.flatnonzero(data == 10)
        self.count = np.diff(np.searchsorted(breaks, off)) + 1
        last = np.cumsum(self.count) - 1
        self.ends = np.empty(int(self.count.sum()), np.int64)
        inner = np.ones(len(self.ends), bool)
        inner[last] = False
        self.ends[inner], self.ends[last] = breaks, off[1:]
        self.begins = np.empty_like(self.ends)
        self.begins[1:] = self.ends[:-1] + 1
        self.begins[last - self.count + 1] = off[:-1]
        self.doc = np.repeat(np.arange(len(self.ids)), self.count)
        solid = np.flatnonzero(~IS_WS[data])
        lo, hi = np.searchsorted(solid, self.begins), np.searchsorted(solid, self.ends)
        full = np.flatnonzero(hi > lo)
        a, b = solid[lo[full]], solid[hi[full] - 1] + 1
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        long = points[b] - points[a] >= min_chars
        self.line, a, b = full[long], a[long], b[long]
        low = LOWER[data].tobytes()
        digest = b"".join([hashlib.blake2b(low[i:j], digest_size=16).digest() for i, j in zip(a.tolist(), b.tolist())])
        h = np.frombuffer(digest, np.uint64).reshape(-1, 2)
        self.order, self.first = classes(h[:, 0], h[:, 1])
        lead = self.order[self.first]
        self.keys, self.more = h[lead, 0], h[lead, 1]
        rank = dense_rank(self.ids)[self.doc[self.line]][self.order]
        if len(lead):
            new = np.ones(len(rank), bool)
            by = np.lexsort((rank, np.repeat(np.arange(len(lead)), np.diff(np.append(self.first, len(rank))))))
            rank = rank[by]
            new[1:] = rank[1:] != rank[:-1]
            new[self.first] = True
            nameless = np.where(self.ids[0] == NULL_ID, rank == 0, False)  # these rows are one document, but spread over buckets
            self.docs = np.add.reduceat(np.where(new, np.where(nameless, NAMELESS, 1), 0), self.first)
            self.top = np.unique(self.ids)[np.maximum.reduceat(rank, self.first)]
        else:
            self.docs = self.top = np.empty(0, np.int64)


def _keys(labels: np.ndarray, min_chars: int):
    def run(table: pa.Table) -> pa.Table:
        x = _Lines(table, min_chars)
        rows = []
        for part, a, b in _slices(x.keys, labels):
            rows.append((part, x.bucket, DATA, b"".join(v[a:b].tobytes() for v in (x.keys, x.more, x.docs, x.top))))
        return requests_table(rows)

    return run


def _decide(min_docs: int, fanout: int):
    def run(table: pa.Table) -> pa.Table:
        part, got = table.column("part")[0].as_py(), messages(table)
        runs = SortedRuns(fanout)
        batches = [np.frombuffer(m, np.uint64).reshape(4, -1) for _, _, m in got]
        for h1, h2, docs, top in batches:
            runs.add(h1, h2, docs.astype(np.int64), top.view(np.int64))
        r1, r2, n, t = runs.merged()
        out = []
        for (bucket, _, _), (h1, h2, _, _) in zip(got, batches):
            at = np.searchsorted(r1, h1)
            while (wrong := r2[at] != h2).any():  # keys that agree in their first half
                at = at + wrong
            drop = (n[at] % NAMELESS) + (n[at] >= NAMELESS) >= min_docs
            out.append((bucket, part, DATA, pack_bits(drop) + t[at[drop]].tobytes()))
        return replies_table(out)

    return run


_OUT = "doc_id long, n_lines long, n_dropped long, kept_text string"


def _drop(labels: np.ndarray, min_chars: int, carry: str | None):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            extra = [left.column("carried").combine_chunks()] if carry else []
            return pa.table([*(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())), *extra], names=["doc_id", "n_lines", "n_dropped", "kept_text", *([carry] if carry else [])])
        x = _Lines(left, min_chars)
        by = {p: m for p, _, m in messages(right)}
        gone = np.zeros(len(x.ends), bool)
        each = np.diff(np.append(x.first, len(x.order)))
        for part, a, b in _slices(x.keys, labels):
            drop = unpack_bits(by[part], b - a)
            keeper = np.zeros(b - a, np.int64)
            keeper[drop] = np.frombuffer(by[part], np.int64, -1, (b - a + 7) // 8)
            lo = x.first[a]
            line = x.line[x.order[lo : lo + each[a:b].sum()]]
            gone[line] = np.repeat(drop, each[a:b]) & (x.ids[x.doc[line]] != np.repeat(keeper, each[a:b]))
        which = np.flatnonzero(~gone)
        lead = np.ones(len(which), np.int64)
        lead[:1] = 0
        lead[1:][x.doc[which[1:]] != x.doc[which[:-1]]] = 0
        flag = np.zeros(len(x.data) + 1, np.int8)
        np.add.at(flag, x.begins[which] - lead, 1)
        np.add.at(flag, x.ends[which], -1)
        take = np.cumsum(flag[:-1], dtype=np.int8) > 0
        dropped = np.bincount(x.doc[gone], minlength=len(x.ids))
        out = pa.table({"doc_id": x.ids, "n_lines": x.count, "n_dropped": dropped, "kept_text": string_array(x.data[take], np.concatenate([[0], np.cumsum(take)])[x.off])})
        return out.append_column(carry, bucket_carried(left)) if carry else out

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, fanout: int = 4, carry: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_text (kept lines joined by a line feed) and the column ``carry``."""
    if carry in ("doc_id", "n_lines", "n_dropped", "kept_text"):
        raise ValueError("carry is a name of the result")
    rows, width = bucketed(docs, id_col, text_col, 4, carry)
    kind = f", `{carry}` {docs.schema[carry].dataType.simpleString()}" if carry else ""
    labels = balanced_labels(width, 1)
    grouped = rows.groupBy("bucket")
    replies = reduce_parts(grouped.applyInArrow(_keys(labels, min_chars), REQUEST), width, _decide(min_docs, fanout))
    return null_ids(grouped.cogroup(replies.groupBy("bucket")).applyInArrow(_drop(labels, min_chars, carry), _OUT + kind), "doc_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
