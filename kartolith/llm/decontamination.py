"""Operator 3: benchmark items inside documents, by size-partitioned MinHash containment search.

An item and a document are sets of ``shingle``-word shingles (A-Z lower-cased).  A document is
contaminated by an item when it holds ``percent`` of the item's shingles.  The item, not the document, is
sketched: items are partitioned by size, and an item of m shingles keeps the bottom k of them by hash with
k = m - ceil(m * percent / 100) + 1, so a document at the threshold must hold one of the k however long
it is (fewer would leave room for all k among the shingles it lacks).  A document probes only the
partitions whose smallest item it could hold.  Hits are verified by exact containment of word sequences.

Documents never move: the benchmark goes to them in blocks of at most ``block_items`` items and
``block_words`` words, so what a task receives is bounded; a larger benchmark takes more blocks,
which tasks read from the shared folder one after the other.  Without a benchmark nothing is contaminated.

Null or empty text or item: no words, contains nothing and is found nowhere.  Fewer words than a shingle: the
whole sequence is the one shingle.  Repeated items: each is reported.  Null ids pass through; repeated
documents are each tested.  Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import qualified, shared_dir, utf8
from ._hashing import BASE2, LOWER, prefix, spans, windows, within, word_hashes, word_spans

_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_FILTER_BITS = 20
_HELD = 32 << 20
_NEW = ("item_ids", "n_items", "containment", "contaminated")


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def _hashes(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every document and their documents."""
    low = LOWER[data]
    starts, ends, words = word_spans(low, off)
    sums = prefix(word_hashes(low, starts, ends), BASE2)
    n = np.diff(words)
    at, doc = within(words, size)
    short = np.flatnonzero((n > 0) & (n < size))
    return np.concatenate([windows(sums, size, BASE2)[at], spans(sums, words[short], words[short + 1], BASE2)]), np.concatenate([doc, short])


class Index:
    """Bottom-k sketches of one block of items, by size partition (powers of two)."""

    def __init__(self, items: list[tuple[int | None, bytes]], size: int, percent: int):
        self.size, self.percent, self.ids = size, percent, [i for i, _ in items]
        self.sets = [shingles(_WORD.findall(t.lower()), size) for _, t in items]
        texts = [t for _, t in items]
        data = np.frombuffer(b"".join(texts), np.uint8)
        h, item = _hashes(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), size)
        order = np.lexsort((h, item))
        h, cuts = h[order], np.searchsorted(item[order], np.arange(len(items) + 1))
        keys, owner, least = [], [], []
        for i, own in enumerate(self.sets):
            if own:
                need = -(-len(own) * percent // 100)
                keys.append(np.unique(h[cuts[i] : cuts[i + 1]])[: len(own) - need + 1])
                owner.append(i)
                least.append(need)
        part = [(n - 1).bit_length() for n in (len(self.sets[i]) for i in owner)]
        smallest: dict[int, int] = {}
        for p, need in zip(part, least):
            smallest[p] = min(need, smallest.get(p, need))
        #: By partition: the least document size, sorted keys and their items.
        self.partitions = []
        for p in sorted(smallest):
            mine = [k for k in range(len(owner)) if part[k] == p]
            flat = np.concatenate([keys[k] for k in mine])
            who = np.repeat([owner[k] for k in mine], [len(keys[k]) for k in mine])
            order = np.argsort(flat, kind="stable")
            self.partitions.append((smallest[p], flat[order], who[order]))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        for _, flat, _ in self.partitions:
            self.filter[(flat >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, data: np.ndarray, off: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs that share a sketched shingle."""
        h, doc = _hashes(data, off, self.size)
        n = np.bincount(doc, minlength=len(off) - 1)
        maybe = self.filter[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        h, doc = h[maybe], doc[maybe]
        found: set[tuple[int, int]] = set()
        for least, keys, who in self.partitions:
            able = n[doc] >= least
            x, d = h[able], doc[able]
            lo, hi = np.searchsorted(keys, x), np.searchsorted(keys, x, side="right")
            for i in np.flatnonzero(hi > lo).tolist():
                found.update((int(d[i]), int(w)) for w in who[lo[i] : hi[i]])
        return found

    def verify(self, doc: set[tuple[bytes, ...]], item: int) -> int:
        """Shared shingles if there are enough, else 0."""
        both = len(self.sets[item] & doc)
        return both if 100 * both >= self.percent * len(self.sets[item]) else 0


def _search(blocks: list, size: int, percent: int):
    """blocks: the one block's items, or the paths of several."""

    def indexes() -> Iterator[Index]:
        for block in blocks:
            if isinstance(block, str):
                files, path = FileSystem.from_uri(block)
                with files.open_input_stream(path) as f:
                    block = pickle.loads(f.read())
            yield Index(block, size, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = next(indexes()) if len(blocks) == 1 else None
        waiting: list[pa.RecordBatch] = []
        held = 0

        def answer() -> Iterator[pa.RecordBatch]:
            hits: list[dict[int, list[tuple]]] = [{} for _ in waiting]
            for index in [only] if only else indexes():
                for batch, found in zip(waiting, hits):
                    _match(index, batch.column("__text"), found)
            for batch, found in zip(waiting, hits):
                cols = [c for n, c in zip(batch.schema.names, batch.columns) if n != "__text"]
                names = [n for n in batch.schema.names if n != "__text"]
                got = [sorted(found.get(d, ()), key=lambda x: (x[0] is None, x[0] or 0)) for d in range(batch.num_rows)]
                ids = pa.array([[x[0] for x in g] or None for g in got], pa.list_(pa.int64()))
                best = pa.array([max((x[1] / x[2] for x in g), default=0.0) for g in got], pa.float64())
                yield pa.RecordBatch.from_arrays([*cols, ids, pa.array([len(g) for g in got], pa.int64()), best, pa.array([bool(g) for g in got])], names=[*names, *_NEW])

        for batch in batches:
            waiting.append(batch)
            held += batch.nbytes
            if only or held > _HELD:
                yield from answer()
                waiting, held = [], 0
        yield from answer()

    return run


def _match(index: Index, texts: pa.Array, found: dict[int, list[tuple]]) -> None:
    """Adds (item, shared shingles, the item's shingles) by document."""
    for at in range(0, len(texts), 512):
        data, off = utf8(texts.slice(at, 512))
        sets: dict[int, set] = {}
        for d, item in index.candidates(data, off):
            if d not in sets:
                sets[d] = shingles(_WORD.findall(data[off[d] : off[d + 1]].tobytes().lower()), index.size)
            both = index.verify(sets[d], item)
            if both:
                found.setdefault(at + d, []).append((index.ids[item], both, len(index.sets[item])))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_items: int, block_words: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The benchmark piece by piece; the driver holds one block at a time."""
    block: list[tuple[int | None, bytes]] = []
    words = 0
    for item, text in benchmark.select(F.col(f"`{item_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).toLocalIterator():
        raw = text.encode()
        size = len(raw.split())
        if block and (len(block) >= block_items or words + size > block_words):
            yield block
            block, words = [], 0
        block.append((item, raw))
        words += size
    if block:
        yield block


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, percent: int = 70, block_items: int = 20_000, block_words: int = 1_000_000
) -> DataFrame:
    """The columns ``keep`` of every document with item_ids (null if clean), n_items, containment (the greatest), contaminated.

    Raises ValueError if ``keep`` holds one of these names.
    """
    if {*_NEW, "__text"} & set(keep):
        raise ValueError("keep holds a name of the result")
    if not 0 < percent <= 100:
        raise ValueError("percent must be over 0 and at most 100")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    blocks: list = []
    for block in _blocks(benchmark, item_col, item_text_col, block_items, block_words):
        if len(blocks) == 1 and not isinstance(blocks[0], str):
            blocks = [_stored(docs.sparkSession, blocks[0])]
        blocks.append(_stored(docs.sparkSession, block) if blocks else block)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(_search(blocks, shingle, percent), schema + "item_ids array<long>, n_items long, containment double, contaminated boolean")


def _stored(spark: SparkSession, block: list) -> str:
    """The block in the shared folder."""
    path = qualified(spark, f"{shared_dir(spark)}/benchmark-{uuid.uuid4().hex}")
    files, place = FileSystem.from_uri(path)
    with files.open_output_stream(place) as f:
        f.write(pickle.dumps(block))
    return path


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items, ["doc_id"]).select("doc_id", "contaminated", "n_items", F.coalesce(F.array_join("item_ids", ","), F.lit("")).alias("item_ids"), "containment")
