"""Operator 8: byte-level deduplication with suffix arrays built by deep-shallow sorting.

Every byte covered by a ``length``-byte string that also starts earlier (smaller id, or the same
document at an earlier start) is removed.  The suffixes are those ``length``-byte strings, and two
equal strings must meet in one task without moving each string: a string is sent where the hash of
its minimizer (the least ``gram``-byte gram in it) sends it, and neighbouring strings share theirs, so
they travel as one overlapping segment.  Strings whose minimizer occurs once in the corpus cannot
repeat and stay at home; strings a bucket holds several times leave it once.

In a task, multikey quicksort with 8-byte characters orders the suffixes to depth 16; groups that still
agree are ordered by blind tries, built a level at a time for all groups together: each suffix is
compared with one leaf of its node, and branches by the depth and byte at which it leaves it.  Suffixes equal to an earlier one
(by a rolling hash and a comparison of the bytes, run by run) stand behind it without being sorted, and those whose hash no other has
stay out.  The result is the suffix array of the task's strings that may repeat, with its LCPs; where the LCP reaches ``length``, the
least location of the run survives.  Copies inside a bucket are found before that in the same way, and are not sent.

Null text: no bytes.  Very long texts: whole, in the bucket of their document.  Null id: the smallest.  Repeated ids: in the order of their texts, one after
the other.  Texts shorter than ``length`` stay.  Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import (
    DATA, MEMO, REQUEST, balanced_labels, bucket_rows, bucketed, messages, null_ids, pack_bits, part_edges, reduce_parts, replies_table, requests_table, string_array, unpack_bits,
)
from ._hashing import BASE, BYTE_A, classes, mix, prefix, windows
from .substring_dedup import _concat_replies, _slices

LOW32 = np.uint64(0xFFFFFFFF)
SLICE = 1 << 16
POSITION = np.uint64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    done = 1
    while done * 2 <= size:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = size - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class _Runs:
    """Maximal runs of consecutive window starts with one minimizer position."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.bucket, self.ids, self.data, self.off = bucket_rows(table)
        n = len(self.data)
        valid = np.ones(n, bool)
        tail = np.minimum(np.diff(self.off), length - 1)  # no string of the document starts there
        valid[_expand(self.off[1:] - tail, tail)] = False
        where, anchor, hashes = [], [], []
        for a in range(0, n, SLICE):
            piece = self.data[a : a + SLICE + length - 1]
            if len(piece) < length:
                break
            g = windows(prefix(BYTE_A[piece], BASE), gram, BASE)
            least = _sliding_min((g & ~POSITION) | np.arange(len(g), dtype=np.uint64), length - gram + 1)
            ok = valid[a : a + len(least)]
            lead = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])))
            many = np.diff(np.append(lead, len(least)))[ok[lead]]
            lead = lead[ok[lead]]
            at = (least[lead] & POSITION).astype(np.int64)
            where.append(np.stack([lead + a, many]))
            anchor.append(at + a)
            hashes.append(mix(g[at] ^ np.uint64(0x2545F4914F6CDD1D)))
        if where:
            start, size = np.concatenate(where, axis=1)
            anchor, h = np.concatenate(anchor), np.concatenate(hashes)
        else:
            start = size = anchor = np.empty(0, np.int64)
            h = np.empty(0, np.uint64)
        again = np.zeros(len(start), bool)  # the same run, cut where a slice ended
        again[1:] = (anchor[1:] == anchor[:-1]) & (start[1:] == start[:-1] + size[:-1])
        lead = np.flatnonzero(~again)
        self.start, self.h = start[lead], h[lead]
        self.size = np.add.reduceat(size, lead) if len(lead) else size
        self.order, self.first = classes(self.h)
        self.keys = self.h[self.order[self.first]]
        self.count = np.diff(np.append(self.first, len(self.order)))

    def repeated(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.order), bool)
        out[self.order] = np.repeat(bits, self.count)
        return out


def _anchors(labels: np.ndarray, length: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        r = _Runs(table, length, gram)
        several = r.count > 1
        rows = [
            (part, r.bucket, DATA, np.array([b - a], np.int64).tobytes() + (r.keys[a:b] & LOW32).astype(np.uint32).tobytes() + pack_bits(several[a:b]))
            for part, a, b in _slices(r.keys, labels)
        ]
        return requests_table(rows)

    return run


def _recurring(table: pa.Table) -> pa.Table:
    """Which minimizers occur twice at least."""
    part, got = table.column("part")[0].as_py(), messages(table)
    sizes = [int(np.frombuffer(m, np.int64, 1)[0]) for _, _, m in got]
    keys = np.concatenate([np.frombuffer(m, np.uint32, n, 8) for n, (_, _, m) in zip(sizes, got)])
    several = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8, -1, 8 + 4 * n), count=n) for n, (_, _, m) in zip(sizes, got)])
    order, first = classes(keys)
    count = np.diff(np.append(first, len(keys)))
    bits = np.empty(len(keys), bool)
    bits[order] = np.repeat((count > 1) | np.maximum.reduceat(several[order], first).astype(bool), count)
    cuts = np.cumsum([0, *sizes])
    return replies_table([(b, part, DATA, pack_bits(bits[cuts[i] : cuts[i + 1]])) for i, (b, _, _) in enumerate(got)])


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as one big-endian character."""
    view = np.ndarray((max(0, len(data) - 7),), dtype=">u8", buffer=data, strides=(1,)) if len(data) > 7 else np.empty(0, ">u8")
    return view[at].astype(np.uint64)


class _Segments:
    """What a bucket sends: the first local copy of every candidate string, as runs of starts."""

    def __init__(self, r: _Runs, bits: np.ndarray, labels: np.ndarray, length: int):
        live = np.flatnonzero(r.repeated(bits)) if len(r.order) else np.empty(0, np.int64)
        size = r.size[live]
        run = np.repeat(np.arange(len(live)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + r.start[live][run]
        gone = first_copies(r.data, at, length) != np.arange(len(at))
        self.copies = at[gone]
        at, run = at[~gone], run[~gone]
        new = np.ones(len(at), bool)
        new[1:] = (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1)
        lead = np.flatnonzero(new)
        start, size = at[lead], np.diff(np.append(lead, len(at)))
        part = np.searchsorted(part_edges(len(labels)), r.h[live][run[lead]] if len(lead) else np.empty(0, np.uint64), side="right") - 1
        by = np.argsort(part, kind="stable")
        self.start, self.size, part = start[by], size[by], part[by]
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
        self.parts = [(int(labels[part[cuts[i]]]), int(cuts[i]), int(cuts[i + 1])) for i in range(len(cuts) - 1)]

    def starts(self, a: int, b: int) -> np.ndarray:
        size = self.size[a:b]
        return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[a:b], size)


def _inverse_powers(n: int) -> np.ndarray:
    from ._hashing import powers

    return powers(pow(BASE, -1, 2**64), n)


def window_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes at each position."""
    if not len(at):
        return np.empty(0, np.uint64)
    sums = prefix(BYTE_A[data], BASE)
    return mix((sums[at + length] - sums[at]) * _inverse_powers(len(sums))[at])


def first_copies(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """For every string at ``at``, the index of the first one equal to it.

    Strings of one hash are compared with their first in runs: neighbours whose firsts are neighbours overlap in all bytes but one.
    """
    order, first = classes(window_hashes(data, at, length))
    size = np.diff(np.append(first, len(at)))
    head = np.arange(len(at))
    many = np.repeat(size > 1, size)
    order, size = order[many], size[size > 1]
    while len(order):
        lead = np.cumsum(size) - size
        head[order] = np.repeat(np.minimum.reduceat(order, lead), size)
        copy = np.sort(order[head[order] != order])
        if not len(copy):
            break
        p, q = at[copy], at[head[copy]]
        new = np.append(True, (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1))
        run = np.flatnonzero(new)
        n = np.diff(np.append(run, len(copy)))
        here, there = _expand(p[run], n + length - 1), _expand(q[run], n + length - 1)
        unlike = np.flatnonzero(data[here] != data[there])
        if not len(unlike):
            break
        wide = np.cumsum(n + length - 1) - (n + length - 1)
        odd = np.unique(np.searchsorted(wide, unlike, side="right") - 1)  # runs with a string of equal hash that differs
        which = copy[_expand(run[odd], n[odd])]
        same = np.ones(len(which), bool)
        for o in [*range(0, length - 8, 8), length - 8]:
            same &= words_at(data, at[which] + o) == words_at(data, at[head[which]] + o)
        which = which[~same]
        old = head[which]
        head[which] = which
        by = np.lexsort((which, old))
        order, lead = which[by], np.flatnonzero(np.append(True, old[by][1:] != old[by][:-1]))
        size = np.diff(np.append(lead, len(order)))
    return head


def _expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def _post(labels: np.ndarray, length: int, gram: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return requests_table([])
        r = _Runs(left, length, gram)
        bits = _concat_replies(messages(right), DATA, _slices(r.keys, labels))
        s = _Segments(r, bits, labels, length)
        rows = [(int(labels[r.bucket % len(labels)]), r.bucket, MEMO, pack_bits(bits))]
        for part, a, b in s.parts:
            doc = np.searchsorted(r.off, s.start[a:b], side="right") - 1
            text = r.data[_expand(s.start[a:b], s.size[a:b] + length - 1)]
            head = np.array([b - a, s.size[a:b].sum()], np.int64)
            rows.append((part, r.bucket, DATA, b"".join(v.tobytes() for v in (head, r.ids[doc], s.start[a:b] - r.off[doc], s.size[a:b].astype(np.uint32), text))))
        return requests_table(rows)

    return run


def _first_byte(d: np.ndarray) -> np.ndarray:
    """The place (0 to 7) of the first byte in which two big-endian characters with the difference ``d`` (not 0) differ."""
    place = np.zeros(len(d), np.int64)
    for bits in (32, 16, 8):
        low = (d >> np.uint64(64 - bits)) == 0
        place += np.where(low, bits // 8, 0)
        d = np.where(low, d << np.uint64(bits), d)
    return place


def suffix_order(data: np.ndarray, at: np.ndarray, length: int, head: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``at``, cut at ``length`` bytes, in lexicographic order (equal ones by place in ``at``), and the LCP of each with
    the one before it (0 for the first).  head: what ``first_copies`` found."""
    head = first_copies(data, at, length) if head is None else head
    own = np.flatnonzero(head == np.arange(len(at)))
    by, between = _distinct_order(data, at[own], length)
    rank = np.empty(len(at), np.int64)
    rank[own[by]] = np.arange(len(own))
    rank = rank[head]
    order = _sorted_by(rank, np.arange(len(at)), len(own), len(at))
    lcp = np.full(len(at), length, np.int64)
    lcp[np.flatnonzero(np.append(True, rank[order][1:] != rank[order][:-1])[: len(at)])] = between
    return order, lcp


def _sorted_by(x: np.ndarray, y: np.ndarray, most_x: int, most_y: int) -> np.ndarray:
    """Order by x, then by y, then by place where that is cheap; both from 0 up to less than a bound."""
    low, place = int(most_y).bit_length(), int(len(x)).bit_length()
    if int(most_x).bit_length() + low + place <= 64:  # sorting values is many times faster than sorting places by two keys
        packed = (x.astype(np.uint64) << np.uint64(low + place)) | (y.astype(np.uint64) << np.uint64(place)) | np.arange(len(x), dtype=np.uint64)
        packed.sort()
        return (packed & np.uint64((1 << place) - 1)).astype(np.int64)
    return np.lexsort((y, x))


def _distinct_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``suffix_order`` of suffixes no two of which are equal.

    Deep-shallow sorting: multikey quicksort to depth 16, then blind tries.  A trie's node holds one leaf; of the others, the smaller ones
    stand before it with the earlier branches first, the greater ones behind it with the later branches first.
    """
    n = len(at)
    order, lcp = np.empty(n, np.int64), np.zeros(n, np.int64)
    item, group, base = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)  # base: the first place of the item's group
    for depth in (0, 8):  # shallow
        if not len(item):
            break
        key = words_at(data, at[item] + depth)
        by = np.argsort(key)
        if depth:
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            by = _sorted_by(group, rank, int(group[-1]) + 1, len(by))
        key, item, group, base = key[by], item[by], group[by], base[by]
        fresh = np.append(True, group[1:] != group[:-1])
        lead = np.flatnonzero(fresh)
        place = base + np.arange(len(item)) - np.repeat(lead, np.diff(np.append(lead, len(item))))
        order[place] = item
        new = fresh | np.append(True, key[1:] != key[:-1])
        split = np.flatnonzero(new & ~fresh)
        lcp[place[split]] = depth + _first_byte(key[split] ^ key[split - 1])
        item, group, base = _unsettled(item, new, place)
    while len(item):  # one level of every blind trie
        fresh = np.append(True, group[1:] != group[:-1])
        lead = np.flatnonzero(fresh)
        size = np.diff(np.append(lead, len(item)))
        leaf = np.repeat(item[lead + size // 2], size)
        code, branch = np.full(len(item), length * 256, np.int64), np.full(len(item), length, np.int64)
        open_ = np.flatnonzero(item != leaf)
        for o in [*range(16, length - 8, 8), length - 8]:
            if not len(open_):
                break
            x, y = words_at(data, at[item[open_]] + o), words_at(data, at[leaf[open_]] + o)
            apart = np.flatnonzero(x != y)
            if len(apart):
                x, y, which = x[apart], y[apart], open_[apart]
                byte = _first_byte(x ^ y)
                value = (x >> ((7 - byte) * 8).astype(np.uint64) & np.uint64(255)).astype(np.int64)
                branch[which] = o + byte
                code[which] = np.where(x < y, (o + byte) * 256 + value, length * 256 + 1 + (length - 1 - o - byte) * 256 + value)
                keep = np.ones(len(open_), bool)
                keep[apart] = False
                open_ = open_[keep]
        by = _sorted_by(group, code, int(group[-1]) + 1, 2 * length * 256 + 1)
        item, group, base, code, branch = item[by], group[by], base[by], code[by], branch[by]
        place = base + np.arange(len(item)) - np.repeat(lead, size)
        order[place] = item
        new = fresh | np.append(True, code[1:] != code[:-1])
        split = np.flatnonzero(new & ~fresh)
        lcp[place[split]] = np.minimum(branch[split], branch[split - 1])
        item, group, base = _unsettled(item, new, place)
    return order, lcp


def _unsettled(item: np.ndarray, new: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of groups of two at least, their groups and the groups' first places."""
    lead = np.flatnonzero(new)
    size = np.diff(np.append(lead, len(item)))
    many = np.repeat(size > 1, size)
    few = size[size > 1]
    return item[many], np.repeat(np.arange(len(few)), few), np.repeat(place[lead][size > 1], few)


def first_equal(data: np.ndarray, at: np.ndarray, length: int, head: np.ndarray | None = None) -> np.ndarray:
    """For every suffix, the index of the first of those whose ``length`` bytes equal its own: runs of the suffix array whose LCP is ``length``."""
    order, lcp = suffix_order(data, at, length, head)
    root = np.empty(len(at), np.int64)
    if len(at):
        lead = np.flatnonzero((lcp < length) | (np.arange(len(at)) == 0))
        root[order] = np.repeat(np.minimum.reduceat(order, lead), np.diff(np.append(lead, len(at))))
    return root


def _sort_suffixes(length: int):
    def run(table: pa.Table) -> pa.Table:
        part, got = table.column("part")[0].as_py(), messages(table)
        out = [(b, part, MEMO, m) for b, kind, m in got if kind == MEMO]
        got = [x for x in got if x[1] == DATA]
        if not got:
            return replies_table(out)
        ids, begin, size, text, counts = [], [], [], [], []
        for _, _, m in got:
            n, total = np.frombuffer(m, np.int64, 2)
            counts.append(int(total))
            ids.append(np.frombuffer(m, np.int64, n, 16))
            begin.append(np.frombuffer(m, np.int64, n, 16 + 8 * n))
            size.append(np.frombuffer(m, np.uint32, n, 16 + 16 * n).astype(np.int64))
            text.append(np.frombuffer(m, np.uint8, -1, 16 + 20 * n))
        ids, begin, size, text = map(np.concatenate, (ids, begin, size, text))
        room = size + length - 1
        base = np.cumsum(room) - room
        by = np.lexsort((begin, ids))  # segments in the order of their locations; starts inside one follow
        at = _expand(base[by], size[by])
        head = first_copies(text, at, length)
        live = np.bincount(head, minlength=len(at))[head] > 1  # the others have no equal
        place = np.cumsum(live) - 1
        later = np.zeros(len(at), bool)
        later[live] = first_equal(text, at[live], length, place[head[live]]) != np.arange(live.sum())
        begun = np.empty(len(size), np.int64)
        begun[by] = np.cumsum(size[by]) - size[by]
        bits = later[_expand(begun, size)]
        cuts = np.cumsum([0, *counts])
        return replies_table(out + [(b, part, DATA, pack_bits(bits[cuts[i] : cuts[i + 1]])) for i, (b, _, _) in enumerate(got)])

    return run


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary"


def _remove(labels: np.ndarray, length: int, gram: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(),) * 4 + (pa.binary(),)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes"])
        r = _Runs(left, length, gram)
        got = messages(right)
        bits = next((unpack_bits(m, len(r.keys)) for _, kind, m in got if kind == MEMO), np.zeros(len(r.keys), bool))
        s = _Segments(r, bits, labels, length)
        by = {p: m for p, kind, m in got if kind == DATA}
        edge = np.zeros(len(r.data) + 1, np.int32)
        gone = [s.copies]
        for part, a, b in s.parts:
            at = s.starts(a, b)
            gone.append(at[unpack_bits(by[part], len(at))])
        gone = np.concatenate(gone)
        edge[gone] += 1
        edge[gone + length] -= 1
        cut = np.cumsum(edge[:-1]) > 0
        begins = cut.copy()
        begins[1:] &= ~cut[:-1]
        starts = r.off[:-1][r.off[1:] > r.off[:-1]]
        begins[starts] = cut[starts]
        total = np.concatenate([[0], np.cumsum(cut)])[r.off]
        opened = np.concatenate([[0], np.cumsum(begins)])[r.off]
        kept = r.off - total
        return pa.table({"doc_id": r.ids, "n_bytes": np.diff(r.off), "n_removed": np.diff(total), "n_spans": np.diff(opened), "kept_bytes": string_array(r.data[~cut], kept, binary=True)})

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 32) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_bytes."""
    if not (gram + 8 <= length and length >= 24 and gram >= 4):
        raise ValueError("length must be 24 at least and exceed gram by 8")
    rows, width = bucketed(docs, id_col, text_col, 8)
    labels = balanced_labels(width, 2)
    grouped = rows.groupBy("bucket")
    twice = reduce_parts(grouped.applyInArrow(_anchors(labels, length, gram), REQUEST), width, _recurring)
    first = reduce_parts(grouped.cogroup(twice.groupBy("bucket")).applyInArrow(_post(labels, length, gram), REQUEST), width, _sort_suffixes(length))
    return null_ids(grouped.cogroup(first.groupBy("bucket")).applyInArrow(_remove(labels, length, gram), _OUT), "doc_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
