"""Operator 10: near-duplicates by an LSH forest over MinHash signatures.

A document is the set of its distinct ``shingle``-word shingles (lower-cased A-Z); documents whose sets
have a Jaccard similarity of ``percent`` / 100 or more are linked, and the connected components are the
groups.  Documents with equal sets form one class first, collapsed in every bucket before any join, so copies are
never expanded into pairs.

The forest has ``trees`` sorted orders of signatures, each with hash functions of its own, cut into ranges of signatures.  The
depth at which an order is read adapts to the region: a leaf is the shortest common prefix (2 to 8 values) that at most
``LEAF`` sets share, and its sets are compared in full.  Sorted neighbours that share 2 values are compared everywhere, and
where more than LEAF sets share 4 values (a dense region), each also meets the first of every longer prefix.
Candidates are screened by 128 one-bit MinHashes, six standard deviations below the threshold, and confirmed on full sets.

Dense regions are settled exactly.  The sets of their documents are stored once; a region of one block at most that holds several
components is compared in full at once, in a task with the other regions of its smallest document, so that sets they share move once.
While a wider region holds several components, its documents go through further forests with new hash functions, across components only,
and when one joins nothing more, what is left is compared in full: documents outside a region's greatest component meet all others, in
blocks.  So no two documents that share 4 values of an order stay uncompared, however dense their region; a pair at 70 %
that shares no 4 values in any of 32 orders (1.5 in 10,000) is found by a leaf of 2 or 3 values where its surroundings are
sparse.  ``exact`` compares all documents by a prefix-filter join instead, without a chance of a miss.

A region of which one bucket alone holds more than ``LOCAL`` sets is thinned before the shuffle: sets that are linked with the bucket's
first one there stay at home, and the region counts as dense.  So a family of near copies that a third of all rows belong to sends a
few rows a bucket and order.

All exchanges are packed (see ``_common``): texts move once, a leader's set moves once per bucket
of documents that it meets, and no region's sets meet in one task; the full comparison sends a set once a pair of blocks.

Null, empty and white-space texts: empty set, linked with nothing.  Very long texts: whole, in the bucket of their document.  Fewer
words than a shingle: the whole sequence is the one shingle.  Null id: the smallest; repeated ids are one node, so their rows stay or
go together.  Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import DATA, MEMO, REQUEST, balanced_labels, bucket_rows, bucketed, dealt, discard, messages, null_ids, pack_bits, reduce_parts, replies_table, requests_table, unpack_bits, utf8, written
from ._hashing import BASE2, LOWER, mix, prefix, spans, windows, within, word_hashes, word_spans
from .substring_dedup import _slices

DEPTH, DEEP, LEAF, SHALLOW = 4, 4, 8, 2
LOCAL = 16
HOME = 2  # a message that a bucket sends itself
BLOCK, BLOCK_SHINGLES, CELL_SHINGLES = 512, 1 << 19, 1 << 23
_NODE = "doc_id long, n_shingles long, d1 long, d2 long, links array<long>, regions array<long>, shingles binary"
_NODE_PA = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("links", pa.list_(pa.int64())), ("regions", pa.list_(pa.int64())), ("shingles", pa.binary())])


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document, and their offsets."""
    low = LOWER[data]
    starts, ends, words = word_spans(low, off)
    sums = prefix(word_hashes(low, starts, ends), BASE2)
    n = np.diff(words)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    so = np.concatenate([[0], np.cumsum(count)])
    h = np.empty(so[-1], np.uint64)
    at, doc = within(words, size)
    h[so[doc] + at - words[doc]] = windows(sums, size, BASE2)[at]
    short = np.flatnonzero((n > 0) & (n < size))
    h[so[short]] = spans(sums, words[short], words[short + 1], BASE2)
    for a, b in zip(so[:-1].tolist(), so[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[so[:-1][count > 0]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[so]


def signatures(sh: np.ndarray, so: np.ndarray, count: int, seed: int) -> np.ndarray:
    """MinHash values of non-empty sets, 16 bits each: one row a hash function."""
    factors = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((count, len(so) - 1), np.uint16)
    a = 0
    while a < len(so) - 1:
        b = max(a + 1, int(np.searchsorted(so, so[a] + 16384, side="right")) - 1)
        part, cuts = sh[so[a] : so[b]], so[a:b] - so[a]
        buffer = np.empty_like(part)
        for i, f in enumerate(factors):
            np.multiply(part, f, out=buffer)
            out[i, a:b] = mix(np.minimum.reduceat(buffer, cuts)) >> np.uint64(48)
        a = b
    return out


def _digests(sh: np.ndarray, so: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over every set; 0 for an empty one."""
    one, two = np.zeros(len(so), np.uint64), np.zeros(len(so), np.uint64)
    full = np.flatnonzero(np.diff(so))
    if len(full):
        one[full] = np.add.reduceat(mix(sh ^ np.uint64(0x5851F42D4C957F2D)), so[full])
        two[full] = np.add.reduceat(mix(sh ^ np.uint64(0x14057B7EF767814F)), so[full])
    return one[:-1], two[:-1]


def _classes(d1: np.ndarray, d2: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For every set the first that equals it; -1 for empty ones."""
    order = np.lexsort((np.arange(len(n)), d2, d1))
    order = order[n[order] > 0]
    first = np.ones(len(order), bool)
    first[1:] = (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
    out = np.full(len(n), -1, np.int64)
    if len(order):
        out[order] = order[first][np.cumsum(first) - 1]
    return out


def _load(table: pa.Table, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bucket, ids, components, shingles and offsets of a bucket of texts, or of stored sets, in its one order."""
    if "shingles" not in table.column_names:
        bucket, ids, data, off = bucket_rows(table)
        return bucket, ids, ids, *shingle_sets(data, off, size)
    at = table.schema.get_field_index("shingles")
    table = table.set_column(at, "shingles", table.column(at).cast(pa.large_binary())).combine_chunks().sort_by([("doc_id", "ascending"), ("shingles", "ascending")])
    raw, off = utf8(table.column("shingles"))
    sh = np.frombuffer(raw.tobytes(), np.uint64)
    return int(table.column("bucket")[0].as_py()), table.column("doc_id").to_numpy(), table.column("component").to_numpy(), sh, off // 8


def _sketches(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a signature: the low bit of each of its first values."""
    bits = (sig[:128] & 1).astype(np.uint8)
    packed = np.packbits(np.concatenate([bits, np.zeros((128 - len(bits), bits.shape[1]), np.uint8)]).T, axis=1)
    words = np.ascontiguousarray(packed).view(np.uint64)
    return words[:, 0], words[:, 1]


def allowed(values: int, percent: int) -> int:
    """Bits in which the sketches of two sets at the threshold may differ: six standard deviations over the mean."""
    m, p = min(values, 128), (1 - percent / 100) / 2
    return math.ceil(m * p + 6 * math.sqrt(m * p * (1 - p))) + 1


def _forest(labels: np.ndarray, size: int, percent: int, trees: int, seed: int, first_round: bool):
    def run(table: pa.Table) -> pa.Table:
        bucket, ids, component, sh, so = _load(table, size)
        n = np.diff(so)
        d1, d2 = _digests(sh, so)
        own = np.unique(_classes(d1, d2, n))
        own = own[own >= 0]
        if not len(own):
            return requests_table([])
        take = np.repeat(np.isin(np.arange(len(n)), own), n)
        sig = signatures(sh[take], np.concatenate([[0], np.cumsum(n[own])]), trees * DEPTH, seed)
        s1, s2 = _sketches(sig)
        sig = sig.astype(np.uint64)
        keys, deep = np.empty((trees, len(own)), np.uint64), np.empty((trees, len(own)), np.uint32)
        for t in range(trees):  # 8 bits of tree and 4 values of 14 bits; then 4 values of 8 bits
            k = np.full(len(own), t * 256 // trees, np.uint64)
            for v in sig[t * DEPTH : (t + 1) * DEPTH]:
                k = (k << np.uint64(14)) | (v >> np.uint64(2))
            keys[t] = k
            lo = np.zeros(len(own), np.uint64)
            for j in range(DEEP):
                lo = (lo << np.uint64(8)) | (sig[((t + 1) * DEPTH + j) % len(sig)] & np.uint64(255))
            deep[t] = lo
        post, heavy, home = _thin(keys, ids, sh, so, own, percent)
        rows = [(int(labels[bucket % len(labels)]), bucket, HOME, home)] if home else []
        keys, deep, heavy, doc = keys[post], deep[post], heavy[post], np.tile(np.arange(len(own)), (trees, 1))[post]
        by = np.argsort(keys)
        keys, deep, heavy, doc = keys[by], deep[by], heavy[by], doc[by]
        for part, a, b in _slices(keys, labels):
            used, index = np.unique(doc[a:b], return_inverse=True)
            which = own[used]
            index = index.astype(np.uint16 if len(used) < 65536 else np.uint32)
            known = component[:0] if first_round else component[which]  # at first every document is a component
            head = np.array([b - a, len(used), index.itemsize, len(known)], np.int64)
            rows.append((part, bucket, DATA, b"".join(v.tobytes() for v in (head, keys[a:b], known, d1[which], s1[used], s2[used], deep[a:b], which.astype(np.uint32), n[which].astype(np.uint32), index)) + pack_bits(heavy[a:b])))
        return requests_table(rows)

    return run


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _thin(keys: np.ndarray, ids: np.ndarray, sh: np.ndarray, so: np.ndarray, own: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Which keys (a row an order) to post, which of them speak for a region that is dense in this bucket, and, for the bucket itself, the links
    found and the regions of all members."""
    post, heavy = np.ones(keys.shape, bool), np.zeros(keys.shape, bool)
    known: dict[tuple[int, int], bool] = {}
    regions, members = [], []
    for t in range(len(keys)):
        by = np.argsort(keys[t], kind="stable")
        cuts = np.flatnonzero(np.append(_same(keys[t][by]), True))
        for k in np.flatnonzero(np.diff(cuts) > LOCAL).tolist():
            inside = np.sort(by[cuts[k] : cuts[k + 1]])
            first = int(inside[0])
            heavy[t, inside] = True
            regions.append(np.full(len(inside), keys[t, first]))
            members.append(own[inside])
            for i in inside[1:].tolist():
                if (first, i) not in known:
                    x, y = own[first], own[i]
                    known[first, i] = linked(sh[so[x] : so[x + 1]], sh[so[y] : so[y + 1]], percent)
                post[t, i] = not known[first, i]
    pairs = np.array([p for p, yes in known.items() if yes], np.int64).reshape(-1, 2)
    if not regions:
        return post, heavy, b""
    flat = np.concatenate(members)
    return post, heavy, np.array([len(pairs), len(flat)], np.int64).tobytes() + own[pairs].astype(np.int64).tobytes() + np.concatenate(regions).tobytes() + flat.astype(np.int64).tobytes()


def _same(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """Where sorted keys begin a new group."""
    new = np.append(True, x[1:] != x[:-1])
    if y is not None:
        new[1:] |= y[1:] != y[:-1]
    return new


def _regions(percent: int, differ: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        cols: list[list[np.ndarray]] = [[] for _ in range(11)]
        got = messages(table)
        out = [(bucket, part, HOME, m) for bucket, kind, m in got if kind == HOME]
        for bucket, kind, m in got:
            if kind == HOME:
                continue
            n, u, width, k = np.frombuffer(m, np.int64, 4).tolist()
            keys, at = np.frombuffer(m, np.uint64, n, 32), 32 + 8 * n
            comp = np.frombuffer(m, np.int64, k, at)
            d1, s1, s2 = np.frombuffer(m, np.uint64, 3 * u, at + 8 * k).reshape(3, u)
            at += 8 * k + 24 * u
            deep = np.frombuffer(m, np.uint32, n, at)
            which, sizes = np.frombuffer(m, np.uint32, 2 * u, at + 4 * n).reshape(2, u)
            index = np.frombuffer(m, np.uint16 if width == 2 else np.uint32, n, at + 4 * n + 8 * u)
            heavy = unpack_bits(m[at + 4 * n + 8 * u + width * n :], n)
            ids = (bucket << 32) + which.astype(np.int64)  # a bucket's documents in the order of their identifiers
            comp = comp if k else ids
            for c, v in zip(cols, (keys, deep, ids[index], d1[index], np.full(n, bucket, np.int64), which[index], sizes[index].astype(np.int64), comp[index], s1[index], s2[index], heavy)):
                c.append(v)
        if not cols[0]:
            return replies_table(out)
        every = [np.concatenate(c) for c in cols]
        order = np.argsort(every[0], kind="stable")
        start = np.flatnonzero(_same(every[0][order] >> np.uint64(14 * (DEPTH - SHALLOW))))
        count = np.diff(np.append(start, len(order)))
        order = order[np.repeat(count > 1, count)]  # alone in its region: nothing to compare
        if not len(order):
            return replies_table(out)
        order = order[np.lexsort(tuple(every[k][order] for k in (2, 3, 1, 0)))]
        every = [c[order] for c in every]
        fresh = _same(every[0], every[3])  # equal sets: the first speaks for all
        hot = np.logical_or.reduceat(every[10], np.flatnonzero(fresh))
        key, deep, ids, _, bucket, which, sizes, comp, s1, s2, _ = (c[fresh] for c in every)
        leaf = np.full(len(key), -1, np.int64)
        left, right, dense = [], [], np.zeros(len(key), bool)
        for level in range(SHALLOW, DEPTH + DEEP + 1):
            new = _same(key >> np.uint64(14 * (DEPTH - level))) if level <= DEPTH else _same(key, deep >> np.uint32(8 * (DEPTH + DEEP - level)))
            group, start = np.cumsum(new) - 1, np.flatnonzero(new)
            count = np.diff(np.append(start, len(key)))
            small = (leaf < 0) & (count <= LEAF)[group]
            leaf[small] = level * len(key) + group[small]
            if level == SHALLOW:  # sorted neighbours
                left.append(np.flatnonzero(~new) - 1)
                right.append(np.flatnonzero(~new))
            if level >= DEPTH:
                many = np.flatnonzero((count > LEAF)[group])
                by = np.lexsort((ids[many], group[many]))
                first = by[_same(group[many])] if len(many) else by
                left.append(many[first][np.cumsum(_same(group[many])) - 1] if len(many) else many)
                right.append(many)
            if level == DEPTH:
                dense[np.flatnonzero(((count > LEAF) | np.logical_or.reduceat(hot, start))[group])] = True
        for step in range(1, LEAF):
            a = np.flatnonzero((leaf[:-step] == leaf[step:]) & (leaf[step:] >= 0))
            left.append(a)
            right.append(a + step)
        a, x = np.concatenate(left), np.concatenate(right)
        lo, hi = np.minimum(sizes[a], sizes[x]), np.maximum(sizes[a], sizes[x])
        ok = (comp[a] != comp[x]) & (100 * lo >= percent * hi)  # in one component already: nothing to learn
        ok &= np.bitwise_count(s1[a] ^ s1[x]).astype(np.int64) + np.bitwise_count(s2[a] ^ s2[x]) <= differ
        a, x = a[ok], x[ok]
        swap = ids[a] > ids[x]
        a, x = np.where(swap, x, a), np.where(swap, a, x)
        pairs = np.unique(np.stack([bucket[a], which[a].astype(np.int64), bucket[x], which[x].astype(np.int64)], axis=1), axis=0)
        cuts = np.flatnonzero(_same(pairs[:, 0])) if len(pairs) else np.empty(0, np.int64)
        for i, j in zip(cuts.tolist(), np.append(cuts[1:], len(pairs)).tolist()):
            out.append((int(pairs[i, 0]), part, DATA, pairs[i:j, 1:].astype(np.int32).tobytes()))
        many = np.flatnonzero(dense)
        by = many[np.argsort(bucket[many], kind="stable")]
        cuts = np.flatnonzero(_same(bucket[by])) if len(by) else np.empty(0, np.int64)
        for i, j in zip(cuts.tolist(), np.append(cuts[1:], len(by)).tolist()):
            out.append((int(bucket[by[i]]), part, MEMO, np.array([j - i], np.int64).tobytes() + key[by[i:j]].tobytes() + which[by[i:j]].tobytes()))
        return replies_table(out)

    return run


def _send_sets(size: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return requests_table([])
        got = messages(right)
        bucket = int(left.column("bucket")[0].as_py())
        rows = [(bucket, bucket, kind, m) for _, kind, m in got if kind in (MEMO, HOME)]
        asked = [np.frombuffer(m, np.int32).reshape(-1, 3) for _, kind, m in got if kind == DATA]
        if not asked:
            return requests_table(rows)
        bucket, ids, _, sh, so = _load(left, size)
        pairs = np.unique(np.concatenate(asked).astype(np.int64)[:, [1, 0, 2]], axis=0)
        cuts = np.flatnonzero(_same(pairs[:, 0]))
        for i, j in zip(cuts.tolist(), np.append(cuts[1:], len(pairs)).tolist()):
            used, index = np.unique(pairs[i:j, 1], return_inverse=True)
            head = np.array([j - i, len(used)], np.int64)
            sets = np.concatenate([sh[so[k] : so[k + 1]] for k in used.tolist()])
            rows.append((int(pairs[i, 0]), bucket, DATA, b"".join(v.tobytes() for v in (head, ids[used], np.diff(so)[used], index.astype(np.int64), pairs[i:j, 2], sets))))
        return requests_table(rows)

    return run


def _confirm(size: int, percent: int, first_round: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], schema=_NODE_PA)
        bucket, ids, _, sh, so = _load(left, size)
        n = np.diff(so)
        d1, d2 = _digests(sh, so)
        own = _classes(d1, d2, n)
        links: dict[int, set[int]] = {}
        regions: dict[int, set[int]] = {}
        for _, kind, m in messages(right):
            if kind == HOME:
                k, u = np.frombuffer(m, np.int64, 2).tolist()
                for i, j in np.frombuffer(m, np.int64, 2 * k, 16).reshape(-1, 2).tolist():
                    links.setdefault(j, set()).add(int(ids[i]))
                for r, i in zip(np.frombuffer(m, np.int64, u, 16 + 16 * k).tolist(), np.frombuffer(m, np.int64, u, 16 + 16 * k + 8 * u).tolist()):
                    regions.setdefault(i, set()).add(r)
                continue
            if kind == MEMO:
                k = int(np.frombuffer(m, np.int64, 1)[0])
                for r, i in zip(np.frombuffer(m, np.int64, k, 8).tolist(), np.frombuffer(m, np.uint32, k, 8 + 8 * k).tolist()):
                    regions.setdefault(i, set()).add(r)
                continue
            k, u = np.frombuffer(m, np.int64, 2).tolist()
            theirs, sizes, index, mine = np.split(np.frombuffer(m, np.int64, 2 * (u + k), 16), [u, 2 * u, 2 * u + k])
            sets = np.frombuffer(m, np.uint64, int(sizes.sum()), 16 + 16 * (u + k))
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            for j, i in zip(index.tolist(), mine.tolist()):
                if theirs[j] != ids[i] and linked(sets[cuts[j] : cuts[j + 1]], sh[so[i] : so[i + 1]], percent):
                    links.setdefault(i, set()).add(int(theirs[j]))
        for i in np.flatnonzero((own >= 0) & (own != np.arange(len(own)))).tolist():
            links.setdefault(i, set()).add(int(ids[own[i]]))
        speaks = own == np.arange(len(own))  # for its class in this bucket
        lists = lambda found: pa.array([sorted(found[i]) if i in found else None for i in range(len(ids))], pa.list_(pa.int64()))
        stored = pa.array([sh[so[i] : so[i + 1]].tobytes() if first_round and i in regions else None for i in range(len(ids))], pa.binary())
        return pa.Table.from_arrays([pa.array(ids), pa.array(n), pa.array(d1.view(np.int64), mask=~speaks), pa.array(d2.view(np.int64), mask=~speaks), lists(links), lists(regions), stored], schema=_NODE_PA)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of the edges (u, v): alternating large-star and small-star contraction.

    Stars are minima joined back to the edges, so a node of any degree is spread over tasks.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).union(least.select("u", "m")).where("a <> b").distinct()
        old, now = now, written(small.toDF("u", "v"), "edges")
        discard(old)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = state


def _round(rows: DataFrame, width: int, shingle: int, percent: int, trees: int, number: int) -> DataFrame:
    """One forest over buckets of texts (number 0) or of stored sets."""
    labels = balanced_labels(width, 1)
    grouped = rows.groupBy("bucket")
    pairs = reduce_parts(grouped.applyInArrow(_forest(labels, shingle, percent, trees, 7919 + number, not number), REQUEST), width, _regions(percent, allowed(trees * DEPTH, percent)))
    sets = grouped.cogroup(pairs.groupBy("bucket")).applyInArrow(_send_sets(shingle), REQUEST).repartition(width, "part")
    return written(grouped.cogroup(sets.groupBy("part")).applyInArrow(_confirm(shingle, percent, not number), _NODE), "nodes")


def shared_counts(sh: np.ndarray, so: np.ndarray, first: np.ndarray, second: np.ndarray, width: int = 4096) -> np.ndarray:
    """Common shingles of each of the sets ``first`` with each of ``second``."""
    values, column, times = np.unique(sh, return_inverse=True, return_counts=True)
    held = times > 1  # in one set only: common to none
    column = np.where(held, np.cumsum(held) - 1, -1)[column]
    row = np.repeat(np.arange(len(so) - 1), np.diff(so))[column >= 0]
    column = column[column >= 0]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    out = np.zeros((len(first), len(second)), np.float32)
    for a in range(0, int(held.sum()), width):
        i, j = np.searchsorted(column, [a, a + width])
        x = np.zeros((len(so) - 1, width), np.float32)
        x[row[i:j], column[i:j] - a] = 1
        out += x[first] @ x[second].T
    return out.astype(np.int64)


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        slot, comp = table.column("slot").to_numpy(), table.column("component").to_numpy()
        raw, off = utf8(table.column("shingles"))
        sh, so = np.frombuffer(raw.tobytes(), np.uint64), off // 8
        n = np.diff(so)
        first, second = np.flatnonzero(slot == i), np.flatnonzero(slot == j)
        both = shared_counts(sh, so, first, second)
        ok = (100 * both >= percent * (n[first][:, None] + n[second][None, :] - both)) & (both > 0) & (comp[first][:, None] != comp[second][None, :])
        a, x = np.nonzero(ok)
        links = np.unique(np.stack([comp[first[a]], comp[second[x]]], axis=1), axis=0)
        return pa.table({"u": pa.array(links[:, 0], pa.int64()), "v": pa.array(links[:, 1], pa.int64())})

    return run


def _compare_cell(percent: int):
    def run(table: pa.Table) -> pa.Table:
        comp, regions = table.column("component").to_numpy(), table.column("regions").combine_chunks()
        raw, off = utf8(table.column("shingles"))
        sh, so = np.frombuffer(raw.tobytes(), np.uint64), off // 8
        n = np.diff(so)
        if len(comp) <= 2 * BLOCK:
            groups = [np.arange(len(comp))]
        else:
            doc, region = np.repeat(np.arange(len(comp)), regions.value_lengths().to_numpy(zero_copy_only=False)), regions.flatten().to_numpy()
            by = np.argsort(region, kind="stable")
            groups = [np.unique(g) for g in np.split(doc[by], np.flatnonzero(_same(region[by]))[1:])]
        links = []
        for g in groups:
            part = np.concatenate([sh[so[k] : so[k + 1]] for k in g.tolist()])
            every = np.arange(len(g))
            both = shared_counts(part, np.concatenate([[0], np.cumsum(n[g])]), every, every)
            a, x = np.nonzero((100 * both >= percent * (n[g][:, None] + n[g][None, :] - both)) & (both > 0) & (comp[g][:, None] < comp[g][None, :]))
            links.append(np.stack([comp[g[a]], comp[g[x]]], axis=1))
        links = np.unique(np.concatenate(links), axis=0)
        return pa.table({"u": pa.array(links[:, 0], pa.int64()), "v": pa.array(links[:, 1], pa.int64())})

    return run


def narrow(placed: DataFrame) -> DataFrame:
    """The regions of one block at most, and the cells in which they are compared: the regions of one smallest document, or each alone if these hold too much."""
    each = placed.groupBy("region").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.sum("n_shingles").alias("s")).where((F.col("n") <= BLOCK) & (F.col("s") <= BLOCK_SHINGLES))
    full = each.groupBy("least").agg(F.sum("s").alias("all"))
    return each.join(full, "least").select("region", "least", F.when(F.col("all") > CELL_SHINGLES, F.col("region")).alias("alone"))


def settle_narrow(sets: DataFrame, placed: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between the components of regions of one block at most, all their documents compared on full sets."""
    docs = placed.join(cells, "region").groupBy("least", "alone", "doc_id").agg(F.first("component").alias("component"), F.collect_list("region").alias("regions"))
    return docs.join(sets, "doc_id").groupBy("least", "alone").applyInArrow(_compare_cell(percent), "u long, v long").distinct()


def settle(sets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between the components of every region, all documents of different components compared on full sets.

    sets: doc_id, shingles.  placed: region, doc_id, n_shingles, component.  The documents outside a region's greatest component
    meet each other and that component's, in blocks; those inside it do not meet each other.
    """
    each = placed.groupBy("region", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    every = each.groupBy("region").agg(F.max(F.struct("n", "component", "s")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    cut = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    plan = every.select("region", F.col("top.component").alias("inside"), cut(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("out"), cut(F.col("top.n"), F.col("top.s")).alias("in")).where("`out` > 0")
    slot = F.when(F.col("component") == F.col("inside"), F.col("out") + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("in"))).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("out"))).cast("int")
    slots = placed.join(plan, "region").withColumn("slot", slot)
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("slot") < F.col("out"), F.col("out") + F.col("in")).otherwise(F.col("out")) - 1)).alias("other")
    meet = slots.select("region", "slot", "doc_id", "component", other).select("region", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "slot", "doc_id", "component")
    return meet.join(sets, "doc_id").groupBy("region", "i", "j").applyInArrow(_compare(percent), "u long, v long").where("u <> v").distinct()


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of the stored sets by an exact prefix-filter join: two sets at the threshold share one of the least hashes of each."""
    need = F.ceil(F.col("n") * percent / 100)
    rows = sets.select("doc_id", F.expr("length(shingles) div 8").alias("n"), "shingles").where("n > 0")
    first = rows.select("doc_id", "n", F.explode(F.transform(F.sequence(F.lit(0), (F.col("n") - need).cast("int")), lambda i: F.substring("shingles", i * 8 + 1, F.lit(8)))).alias("h"))
    a, b = (first.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), "h") for c in "uv")
    pairs = a.join(b, "h").where(f"u < v and 100 * least(nu, nv) >= {percent} * greatest(nu, nv)").select("u", "v").distinct()
    side = lambda c: rows.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(_verify(percent), "u long, v long")


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            u, v, a, b = (batch.column(c).to_pylist() for c in ("u", "v", "su", "sv"))
            keep = []
            for k, (x, y) in enumerate(zip(a, b)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([u[k] for k in keep], pa.int64()), pa.array([v[k] for k in keep], pa.int64())], names=["u", "v"])

    return run


def _sets(size: int):
    def run(table: pa.Table) -> pa.Table:
        _, ids, _, sh, so = _load(table, size)
        n = np.diff(so)
        d1, d2 = _digests(sh, so)
        own = _classes(d1, d2, n)
        speaks = own == np.arange(len(own))
        links = pa.array([None if k < 0 or s else [int(ids[k])] for k, s in zip(own.tolist(), speaks.tolist())], pa.list_(pa.int64()))
        sets = pa.array([sh[a:b].tobytes() if s else None for a, b, s in zip(so[:-1].tolist(), so[1:].tolist(), speaks.tolist())], pa.binary())
        return pa.Table.from_arrays([pa.array(ids), pa.array(n), pa.array(d1.view(np.int64), mask=~speaks), pa.array(d2.view(np.int64), mask=~speaks), links, pa.nulls(len(ids), pa.list_(pa.int64())), sets], schema=_NODE_PA)

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 70, trees: int = 32, exact: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, n_links, component_id, kept.

    component_id: the smallest identifier reachable over links; kept: whether that is the document itself.
    n_links: confirmed links of the first forest that it attributes to this document, one to an equal set of its bucket included.
    exact: compare all sets by a prefix-filter join instead of the forest (dearer; a hash that very many sets share is one join key).
    """
    rows, width = bucketed(docs, id_col, text_col, 4)
    if exact:
        nodes = written(rows.groupBy("bucket").applyInArrow(_sets(shingle), _NODE), "nodes")
        stored = nodes.where("shingles is not null").select("doc_id", "shingles")
        nodes, pairs = nodes.drop("shingles"), prefix_pairs(stored, percent)
    else:
        nodes = _round(rows, width, shingle, percent, trees, 0)
        pairs = None
    speak = nodes.where("d1 is not null").select("doc_id", "d1", "d2", "n_shingles")  # one row a class and bucket
    same = speak.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = speak.join(same, ["d1", "d2", "n_shingles"]).select("u", F.col("doc_id").alias("v")).union(nodes.select(F.col("doc_id").alias("u"), F.explode("links").alias("v")))
    found = written(components(edges if pairs is None else edges.union(pairs)), "components")
    sets = nodes.where("regions is not null").select("doc_id", "n_shingles", "shingles", "regions") if pairs is None else None
    number, wide = 0, None
    while sets is not None:
        owned = sets.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        placed = owned.select("doc_id", "n_shingles", "component", F.explode("regions").alias("region"))
        placed = placed if wide is None else placed.join(wide, "region", "left_semi")
        torn = placed.groupBy("region").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("region")
        placed = written(placed.join(torn, "region", "left_semi"), "placed")
        again = placed.select("doc_id").distinct()
        if placed.isEmpty():
            break
        if wide is None:  # the narrow regions in full, once for all
            cells = written(narrow(placed), "cells")
            fresh = written(settle_narrow(sets.select("doc_id", "shingles"), placed, cells, percent), "links")
            wide = written(placed.select("region").distinct().join(cells, "region", "left_anti"), "wide")
            if not fresh.isEmpty():
                found = written(components(fresh.union(found.select(F.col("id").alias("u"), F.col("component").alias("v")))), "components")
            if wide.isEmpty():
                break
            continue
        number += 1
        left = dealt(owned.join(again, "doc_id", "left_semi").select("doc_id", "component", "shingles"), width, 4, "doc_id")
        more = _round(left, width, shingle, percent, trees, number)
        comp = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"{c}c"))
        extra = more.select(F.col("doc_id").alias("u"), F.explode("links").alias("v"))
        fresh = written(extra.join(comp("u"), "u", "left").join(comp("v"), "v", "left").select(F.coalesce("uc", "u").alias("u"), F.coalesce("vc", "v").alias("v")).where("u <> v").distinct(), "links")
        settled = fresh.isEmpty()
        if settled:  # forests find no more: the regions still torn in full
            fresh = written(settle(sets.select("doc_id", "shingles"), placed, percent), "links")
            if fresh.isEmpty():
                break
        found = written(components(fresh.union(found.select(F.col("id").alias("u"), F.col("component").alias("v")))), "components")
        if settled:
            break
    out = nodes.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce(F.size("links"), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "doc_id").alias("component_id"),
        (F.col("doc_id") == F.coalesce("component", "doc_id")).alias("kept"),
    )
    return null_ids(out, "doc_id", "component_id")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_links")
