"""Operator 5: packing tokenised documents by first-fit decreasing with a tournament tree.

Every document is tokenised whole, closed by ``end_id`` and cut at multiples of ``capacity``; full
pieces are sequences of their own.  What is left over is packed in randomised groups of documents that
are independent tasks: in a group the pieces go, longest first, into the first sequence with room,
which a tournament tree over the free room of all sequences finds in logarithmic time.

Tokens never move: cuts depend on the document alone, so a map step emits counts and checksums (and the
ids themselves if asked for), and only these are shuffled.  Groups are dealt by row number in the
written piece table, not by a key, so no repeated row or identifier can make one large.

Tokenising is exact but remembers: texts are cut, in the bytes of a whole batch at once, where the
pre-tokeniser always ends a word, and each distinct piece is encoded once a task.

Null text: empty, one piece holding ``end_id``.  Null id: passed through.  Repeated rows: each is packed.
Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import utf8, written

#: A piece that begins with a space before a visible character, where the pre-tokeniser always begins a word, and has no other space.
_LED = re.compile("\x20[!-~À-߿][^\x20]*")
_BARE = re.compile(r"\S+")
GROUP_DOCS = 20_000
_MEMO_WORDS, _MEMO_BYTES, _JOINED, _BATCH_BYTES = 300_000, 16 << 20, 1000, 4 << 20
_LETTER, _DIGIT, _SIGN, _QUOTE, _BLANK, _BREAK, _SEEN, _ELSE = range(8)  # _SEEN: visible, of any class


def _kinds() -> np.ndarray:
    """The class of every byte that says it alone; leads of U+00C0 to U+023F are letters, those up to U+07FF visible."""
    kind = np.full(256, _ELSE, np.uint8)
    kind[0x21:0x7F] = _SIGN
    for a, b, k in ((0x30, 0x3A, _DIGIT), (0x41, 0x5B, _LETTER), (0x61, 0x7B, _LETTER), (0x09, 0x0E, _BREAK), (0xC3, 0xC9, _LETTER), (0xC9, 0xE0, _SEEN)):
        kind[a:b] = k
    kind[0x20], kind[0x27] = _BLANK, _QUOTE
    return kind


def _pairs(found) -> np.ndarray:
    return np.array([found(a, b) for a in range(8) for b in range(8)])


_KIND = _kinds()
_VISIBLE = (_LETTER, _DIGIT, _SIGN, _QUOTE, _SEEN)
#: Neighbours (8 * class + class) of which the first is a space that begins a word.
_AT_SPACE = _pairs(lambda a, b: a == _BLANK and b in _VISIBLE)
#: Neighbours that never share a word: of two classes, or white space after anything.  A contraction begins with a quote.
_APART = _pairs(lambda a, b: a < _BLANK and b <= _BREAK and a != b and (a, b) not in ((_SIGN, _QUOTE), (_QUOTE, _SIGN), (_QUOTE, _LETTER)))
#: What follows a line break is another word; a break before which there is no other white space is one also where the text ends.
_AFTER_BREAK = _pairs(lambda a, b: a == _BREAK and b in _VISIBLE)


def piece_starts(data: np.ndarray, off: np.ndarray, spaces_only: bool) -> np.ndarray:
    """Where to cut texts so that the pre-tokeniser makes the same words of the pieces: at least at the start of every text that is not empty."""
    n = len(data)
    mark = np.zeros(n + 1, bool)
    if n > 1:
        kind = _KIND[data]
        lead = np.flatnonzero((data >= 0xC3) & (data < 0xC9))
        second = data[np.minimum(lead + 1, n - 1)]
        sign = (data[lead] == 0xC3) & ((second == 0x97) | (second == 0xB7))  # the multiplication and division signs
        kind[lead[sign]] = _SEEN
        kind[lead[~sign] + 1] = _LETTER
        pair = kind[:-1] * 8 + kind[1:]
        mark[: n - 1] = _AT_SPACE[pair]
        ends = off[1:-1]
        mark[ends[(ends > 0) & (ends < n)] - 1] = False  # the space ends its text
        if not spaces_only:
            mark[1:n] |= _APART[pair]
            mark[2:n] |= _AFTER_BREAK[pair[1:]] & (kind[:-2] < _BLANK)
    mark[off[:-1][off[1:] > off[:-1]]] = True
    return np.flatnonzero(mark[:n])
_DOC = "doc_id long, doc_tokens long, crcs array<long>"
_DOC_PA = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("crcs", pa.list_(pa.int64()))])


class _Words(dict):
    """Numbers words as they come; ids of new ones wait for the next ``learn``.

    Two generations bound the memory: a full one becomes the old one, from which words in use return.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, None
        self._begin()

    def _begin(self) -> None:
        self.new: list[str] = []
        self.flat, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.bytes = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def turn(self) -> None:
        """Starts a new generation if this one is full."""
        if len(self) > _MEMO_WORDS or self.bytes > _MEMO_BYTES:
            self.old = dict(self), self.flat, self.start, self.size
            self.clear()
            self._begin()

    def learn(self) -> None:
        if not self.new:
            return
        flat, size = [self.flat], np.zeros(len(self.new), np.int64)
        known = np.array([self.old[0].get(w, -1) for w in self.new], np.int64) if self.old else np.full(len(self.new), -1)
        back, unknown = np.flatnonzero(known >= 0), np.flatnonzero(known < 0)
        order = np.concatenate([back, unknown])
        if len(back):
            _, ids, start, n = self.old
            size[back] = n[known[back]]
            flat.append(ids[_ranges(start[known[back]], size[back])])
        if len(unknown):
            words = [self.new[i] for i in unknown.tolist()]
            ids, size[unknown] = self.encode(words)
            flat.append(ids)
            self.bytes += sum(map(len, words))
        start = np.empty(len(self.new), np.int64)
        start[order] = len(self.flat) + np.cumsum(size[order]) - size[order]
        self.flat = np.concatenate(flat)
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
        self.new = []


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start[i] .. start[i] + size[i] - 1, one range after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


class Encoder:
    """Ids of whole texts, equal to those of ``tokenizers`` without special tokens added."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker a core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True  # byte-level BPE's sign for a space
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_end = self.tokenizer.token_to_id("\u010a")
        self.words = _Words(self._joined)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(got), np.array([len(x) for x in got], np.int64)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many pieces in one text: those after a space are told apart by it, those without white space by line breaks between them."""
        size, ids, at = np.zeros(len(words), np.int64), [], []
        led = [i for i, w in enumerate(words) if _LED.fullmatch(w)]
        alone = np.ones(len(words), bool)
        alone[led] = False
        bare = [i for i in np.flatnonzero(alone).tolist() if _BARE.fullmatch(words[i])] if self.line_end is not None else []
        alone[bare] = False
        for some, between in ((led, ""), (bare, "\n")):
            parts = [some[k : k + _JOINED] for k in range(0, len(some), _JOINED)]
            for part, x in zip(parts, self.tokenizer.encode_batch_fast([between.join([words[i] for i in part]) for part in parts], add_special_tokens=False)):
                got = np.array(x.ids, np.uint32)
                if between:
                    ends = np.append(np.flatnonzero(got == self.line_end), len(got))
                    size[part] = np.diff(ends, prepend=-1) - 1
                    got = got[got != self.line_end]
                else:
                    size[part] = np.diff(np.append(np.flatnonzero(self.spaced[got]), len(got)))
                ids.append(got)
                at.extend(part)
        odd = np.flatnonzero(alone).tolist()
        if odd:
            got, size[odd] = self._each([words[i] for i in odd])
            ids.append(got)
            at.extend(odd)
        flat, at = np.concatenate(ids), np.array(at)
        start = np.empty(len(words), np.int64)
        start[at] = np.cumsum(size[at]) - size[at]
        return flat[_ranges(start, size)], size

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        data, off = utf8(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        raw = data.tobytes()
        starts = piece_starts(data, off, any(t in raw for t in self.added))
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(raw)).dictionary_encode()
        self.words.turn()
        number = np.array([self.words[w] for w in pieces.dictionary.to_pylist()], np.int64)
        self.words.learn()
        words = number[pieces.indices.to_numpy()]
        n = self.words.size[words]
        ids = self.words.flat[_ranges(self.words.start[words], n)]
        cuts = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, off)].tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _tokenise(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            bytes_ = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))])
            at = 0
            while at < batch.num_rows:
                begin, at = at, max(at + 1, int(np.searchsorted(bytes_, bytes_[at] + _BATCH_BYTES, side="right")) - 1)
                part = batch.slice(begin, at - begin)
                totals, crcs, kept = [], [], []
                for ids in encoder.encode(part.column("text")):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    totals.append(len(ids))
                    raw = memoryview(ids).cast("B")
                    crcs.append([zlib.crc32(raw[4 * i : 4 * (i + capacity)]) for i in range(0, len(ids), capacity)])
                    if with_ids:
                        kept.append(ids.astype(np.int32))
                cols = [part.column("doc_id"), pa.array(totals, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
                if with_ids:
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.list_(pa.int32()))], schema=_DOC_PA.append(pa.field("ids", pa.list_(pa.int32()))))
                else:
                    yield pa.RecordBatch.from_arrays(cols, schema=_DOC_PA)

    return run


class TournamentTree:
    """Room of the open bins; each inner node holds the greater room of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Puts ``size`` into the first bin with room for it."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        found = at - self.leaves
        room[at] -= size
        at //= 2
        while at:
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
            at //= 2
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size."""
    tree = TournamentTree(max(1, len(sizes)), capacity)
    used: list[int] = []
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        b = tree.place(size)
        if b == len(used):
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
    return bins, offsets


_PIECES_PA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("row", pa.int64())])
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row long"


def _pack(capacity: int, group_bits: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("row")
        group = int(table.column("group")[0].as_py())
        ids, total, row = table.column("doc_id"), table.column("doc_tokens").to_numpy(), table.column("row").to_numpy()
        crcs = table.column("crcs").combine_chunks().flatten().to_numpy()
        pieces = -(-total // capacity)
        doc = np.repeat(np.arange(len(total)), pieces)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
        length = np.minimum(capacity, total[doc] - start)
        part = np.flatnonzero(length < capacity)
        sequence, offset = np.empty(len(doc), np.int64), np.zeros(len(doc), np.int64)
        sequence[part], offset[part] = first_fit_decreasing(length[part], capacity)
        whole = np.flatnonzero(length == capacity)
        sequence[whole] = np.arange(len(whole)) + (sequence[part].max() + 1 if len(part) else 0)
        return pa.Table.from_arrays([ids.take(pa.array(doc)).combine_chunks(), start, length, crcs, total[doc], (group << group_bits) + sequence, offset, row[doc]], schema=_PIECES_PA)

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    group_docs: documents a group holds on average; the number of groups follows the input.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    tokens = written(rows.mapInArrow(_tokenise(tokenizer_path, capacity, end_id, with_ids), _DOC + ", ids array<int>" * with_ids), "tokens")
    groups = max(1, -(-tokens.count() // group_docs))
    numbered = tokens.withColumn("row", F.monotonically_increasing_id())
    pieces = (
        numbered.select("doc_id", "doc_tokens", "crcs", "row", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))
        .repartition(min(groups, 100_000), "group")
        .groupBy("group")
        .applyInArrow(_pack(capacity, 36), _PIECES)
    )
    if with_ids:
        texts = numbered.select("row", F.col("ids").alias("all_ids"))
        pieces = pieces.join(texts, "row").withColumn("ids", F.slice("all_ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))).drop("all_ids")
    return pieces.drop("row")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
