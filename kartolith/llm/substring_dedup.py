"""Operator 1: word-level substring deduplication by fixed-block anchors.

A window of ``window`` words that also starts in a document with a smaller identifier is a repeat;
every word under a repeat goes.  Any window holds a whole block of ``window // 2`` words aligned in
its document, so the index holds non-overlapping blocks only and every rolling window of that length
probes it.  Around hits that two documents share, anchors are extended to maximal exact repeats:
all windows over a hit are compared by 96-bit fingerprints, from two independent hashes of every word, and the smallest
document of each kept.

Three passes over one shuffle of the texts (see ``_common``): probes (32 bits a probe in a hash range,
unique per bucket; false hits only cost work), windows around hits, removal.

Null text: no words.  Very long texts: whole, in the bucket of their document.  Null id: compared as the smallest.  Repeated ids: rows of one id never
remove each other's words.  Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import (
    DATA, MEMO, REQUEST, balanced_labels, bucket_rows, bucketed, messages, null_ids, pack_bits, part_edges, reduce_parts, replies_table, requests_table, string_array, unpack_bits,
)
from ._hashing import BASE, BASE2, classes, dense_rank, prefix, windows, within, word_hashes, word_spans

LOW32 = np.uint64(0xFFFFFFFF)


class _Probes:
    """The unique block-length windows of a bucket, sorted by hash."""

    def __init__(self, table: pa.Table, window: int):
        self.bucket, self.ids, self.data, self.off = bucket_rows(table)
        self.rank = dense_rank(self.ids)
        self.starts, self.ends, self.words = word_spans(self.data, self.off)
        self.w = word_hashes(self.data, self.starts, self.ends)
        block = self.block = window // 2
        self.at, doc = within(self.words, block, window)
        h = windows(prefix(self.w, BASE2), block, BASE2)[self.at]
        aligned = (self.at - self.words[doc]) % block == 0
        self.order, self.first = classes(h)
        self.keys = h[self.order[self.first]] if len(h) else h
        if len(h):
            r = self.rank[doc][self.order]
            self.indexed = np.logical_or.reduceat(aligned[self.order], self.first)
            self.several = np.minimum.reduceat(r, self.first) != np.maximum.reduceat(r, self.first)

    def candidates(self, shared: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows over at least one shared block-length window, and their documents."""
        hit = np.zeros(len(self.w) + 1, np.int64)
        if len(self.at):
            per = np.zeros(len(self.order), np.int64)
            per[self.first[1:]] = 1
            hit[self.at[self.order]] = shared[np.cumsum(per)]
        count = np.concatenate([[0], np.cumsum(hit)])
        at, doc = within(self.words, window)
        keep = count[at + (window - self.block + 1)] > count[at]
        return at[keep], doc[keep]


def _slices(keys: np.ndarray, labels: np.ndarray):
    cuts = np.append(np.searchsorted(keys, part_edges(len(labels))), len(keys))
    return [(int(labels[i]), int(cuts[i]), int(cuts[i + 1])) for i in range(len(labels)) if cuts[i + 1] > cuts[i]]


def _concat_replies(replies: list[tuple[int, int, bytes]], kind: int, slices) -> np.ndarray:
    by = {p: b for p, k, b in replies if k == kind}
    return np.concatenate([unpack_bits(by[p], b - a) for p, a, b in slices] or [np.zeros(0, bool)])


def _probe(labels: np.ndarray, window: int):
    def run(table: pa.Table) -> pa.Table:
        p = _Probes(table, window)
        rows = []
        for part, a, b in _slices(p.keys, labels):
            rows.append((part, p.bucket, DATA, np.array([b - a], np.int64).tobytes() + (p.keys[a:b] & LOW32).astype(np.uint32).tobytes() + pack_bits(p.indexed[a:b]) + pack_bits(p.several[a:b])))
        return requests_table(rows)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Which probes meet an indexed block and occur in two documents at least."""
    part = table.column("part")[0].as_py()
    got = messages(table)
    sizes = [int(np.frombuffer(m, np.int64, 1)[0]) for _, _, m in got]
    keys = np.concatenate([np.frombuffer(m, np.uint32, n, 8) for n, (_, _, m) in zip(sizes, got)])
    flags = [np.frombuffer(m, np.uint8, -1, 8 + 4 * n) for n, (_, _, m) in zip(sizes, got)]
    indexed = np.concatenate([np.unpackbits(f[: (n + 7) // 8], count=n) for n, f in zip(sizes, flags)])
    several = np.concatenate([np.unpackbits(f[(n + 7) // 8 :], count=n) for n, f in zip(sizes, flags)])
    order, first = classes(keys)
    count = np.diff(np.append(first, len(keys)))
    ok = np.maximum.reduceat(indexed[order], first).astype(bool) & ((count > 1) | np.maximum.reduceat(several[order], first).astype(bool))
    bits = np.empty(len(keys), bool)
    bits[order] = np.repeat(ok, count)
    cuts = np.cumsum([0, *sizes])
    return replies_table([(b, part, DATA, pack_bits(bits[cuts[i] : cuts[i + 1]])) for i, (b, _, _) in enumerate(got)])


class _Windows:
    """The unique candidate windows of a bucket with the smallest document of each."""

    def __init__(self, p: _Probes, shared: np.ndarray, window: int):
        self.at, doc = p.candidates(shared, window)
        w2 = word_hashes(p.data, p.starts, p.ends, 1) if len(self.at) else p.w
        self.a = windows(prefix(p.w, BASE2), window, BASE2)[self.at]
        self.b = (windows(prefix(w2, BASE), window, BASE)[self.at] >> np.uint64(32)).astype(np.uint32)
        self.order, self.first = classes(self.a, self.b)
        self.rank = p.rank[doc]
        self.least = np.minimum.reduceat(self.rank[self.order], self.first) if len(self.at) else np.empty(0, np.int64)
        self.keys = self.a[self.order[self.first]]


def _extend(labels: np.ndarray, window: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return requests_table([])
        p = _Probes(left, window)
        shared = _concat_replies(messages(right), DATA, _slices(p.keys, labels))
        rows = [(int(labels[p.bucket % len(labels)]), p.bucket, MEMO, pack_bits(shared))]
        x = _Windows(p, shared, window)
        ids = np.unique(p.ids)
        small = x.b[x.order[x.first]]
        for part, a, b in _slices(x.keys, labels):
            used, index = np.unique(x.least[a:b], return_inverse=True)
            index = index.astype(np.uint16 if len(used) < 65536 else np.uint32)
            head = np.array([b - a, len(used), index.itemsize], np.int64)
            rows.append((part, p.bucket, DATA, b"".join(v.tobytes() for v in (head, x.keys[a:b], ids[used], small[a:b], index))))
        return requests_table(rows)

    return run


def _smallest(table: pa.Table) -> pa.Table:
    """Whether another bucket holds a window in a smaller document."""
    part = table.column("part")[0].as_py()
    got = messages(table)
    out = [(b, part, MEMO, m) for b, kind, m in got if kind == MEMO]
    got = [x for x in got if x[1] == DATA]
    if not got:
        return replies_table(out)
    a, b, d = [], [], []
    for _, _, m in got:
        n, u, size = np.frombuffer(m, np.int64, 3)
        a.append(np.frombuffer(m, np.uint64, n, 24))
        b.append(np.frombuffer(m, np.uint32, n, 24 + 8 * (n + u)))
        d.append(np.frombuffer(m, np.int64, u, 24 + 8 * n)[np.frombuffer(m, np.uint16 if size == 2 else np.uint32, n, 24 + 8 * (n + u) + 4 * n)])
    cuts = np.cumsum([0, *map(len, a)])
    a, b, d = map(np.concatenate, (a, b, d))
    order, first = classes(a, b)
    least = np.minimum.reduceat(d[order], first)
    bits = np.empty(len(a), bool)
    bits[order] = d[order] > np.repeat(least, np.diff(np.append(first, len(a))))
    return replies_table(out + [(bucket, part, DATA, pack_bits(bits[cuts[i] : cuts[i + 1]])) for i, (bucket, _, _) in enumerate(got)])


_OUT = "doc_id long, n_words long, n_removed long, kept_text string"


def _remove(labels: np.ndarray, window: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        p = _Probes(left, window)
        got = messages(right)
        shared = next((unpack_bits(m, len(p.keys)) for _, kind, m in got if kind == MEMO), np.zeros(len(p.keys), bool))
        x = _Windows(p, shared, window)
        smaller = _concat_replies(got, DATA, _slices(x.keys, labels))
        edge = np.zeros(len(p.w) + 1, np.int64)
        if len(x.at):
            each = np.diff(np.append(x.first, len(x.order)))
            gone = (x.rank[x.order] > np.repeat(x.least, each)) | np.repeat(smaller, each)
            at = x.at[x.order[gone]]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
        kept = np.cumsum(edge[:-1]) == 0
        doc = np.repeat(np.arange(len(p.ids)), np.diff(p.words))
        n_kept = np.bincount(doc[kept], minlength=len(p.ids))
        flag = np.zeros(len(p.data) + 1, np.int8)  # a kept word from its start, with the white space before it unless it is the document's first
        which = np.flatnonzero(kept)
        lead = np.ones(len(which), np.int64)
        lead[:1] = 0
        lead[1:][doc[which[1:]] != doc[which[:-1]]] = 0
        np.add.at(flag, p.starts[which] - lead, 1)
        np.add.at(flag, p.ends[which], -1)
        take = np.cumsum(flag[:-1], dtype=np.int8) > 0
        text = p.data.copy()
        text[p.starts[which[lead == 1]] - 1] = 32
        off = np.concatenate([[0], np.cumsum(take)])[p.off]
        n = np.diff(p.words)
        return pa.table({"doc_id": p.ids, "n_words": n, "n_removed": n - n_kept, "kept_text": string_array(text[take], off)})

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    if window < 2:
        raise ValueError("window must be 2 at least")
    rows, width = bucketed(docs, id_col, text_col, 4)
    labels = balanced_labels(width, 1)
    grouped = rows.groupBy("bucket")
    shared = reduce_parts(grouped.applyInArrow(_probe(labels, window), REQUEST), width, _shared)
    least = reduce_parts(grouped.cogroup(shared.groupBy("bucket")).applyInArrow(_extend(labels, window), REQUEST), width, _smallest)
    return null_ids(grouped.cogroup(least.groupBy("bucket")).applyInArrow(_remove(labels, window), _OUT), "doc_id")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
