"""Operator 7: language identification by nearest centroid.

A text is the L2-normalised TF-IDF vector of its character 1- to 3-grams (letters lower-cased, everything
else one space) hashed to ``FEATURES`` cells.  Each language has several centroids, found by spherical
k-means; a text takes the language of the centroid with the greatest cosine, and is rejected when even
that one is too far away.  How near a text of the language itself comes depends on its length, so the limits are set by
the number of distinct n-grams (powers of two), on cosines that sampled documents have with centroids learned without them.

Document frequencies are counted over all labelled training documents.  Only the clustering uses a
bounded sample: about ``fit_docs`` documents a language (a parameter, 1,500 by default), picked by a hash of identifier and text
so that the files' layout does not matter, whose vectors
of at most ``FEATURES`` cells are gathered on the driver.  The model is at most ``FEATURES`` cells a centroid.
Predictions read the text alone, in one map step without a shuffle.

Null text or no letter: ``und``, score 0, rejected.  Very long texts: whole, a few at a time.  Null id: predicted, not learned from.  Null language:
predicted, not learned from.  Nothing to learn from: everything is ``und``.  Repeated rows: each counts.
Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import written

FEATURES = 8192
UNKNOWN = "und"
_CELLS = 1 << 20


class Grams:
    """Counts of hashed character n-grams of whole texts."""

    def __init__(self):
        self.to = np.full(0x110000, -1, np.int32)

    def _letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased letters with one 0 around and between runs of them in every text, and the texts' bounds."""
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        new = np.unique(cp[self.to[cp] < 0]) if len(cp) else cp
        for c in new.tolist():
            self.to[c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else 0
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        x = np.insert(self.to[cp], np.concatenate([off[:-1], off[1:]]), 0)  # a boundary before and after every text, so no text depends on its neighbours
        off = off + 2 * np.arange(len(off))
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
        keep[off[:-1]] = True
        at = np.concatenate([[0], np.cumsum(keep)])
        return x[keep].astype(np.uint32), at[off]

    def counts(self, texts: list[str]) -> np.ndarray:
        """One row of counts a text."""
        x, off = self._letters(texts)
        out = np.zeros((len(texts), FEATURES), np.float32)
        if not x.any():
            return out
        doc = np.searchsorted(off[1:], np.arange(len(x)), side="right").astype(np.int64)
        doc = np.minimum(doc, len(texts) - 1)
        a = x * np.uint32(0x9E3779B1)
        b = (a[:-1] ^ (a[:-1] >> np.uint32(15))) + x[1:] * np.uint32(0x85EBCA77)
        b *= np.uint32(0xC2B2AE3D)
        c = (b[:-1] ^ (b[:-1] >> np.uint32(13))) + x[2:] * np.uint32(0x27D4EB2F)
        c *= np.uint32(0x165667B1)
        cells = np.zeros(len(texts) * FEATURES, np.int64)
        for n, h in ((1, a), (2, b), (3, c)):
            # a gram ends in the text it starts in, and is more than a boundary
            ok = (x[: len(h)] != 0) if n == 1 else (doc[: len(h)] == doc[n - 1 :]) & ((x[: len(h)] != 0) | (x[1 : len(h) + 1] != 0))
            h = (h ^ (h >> np.uint32(16))) % np.uint32(FEATURES)
            cells += np.bincount(doc[: len(h)][ok] * FEATURES + h[ok], minlength=len(cells))
        return cells.reshape(out.shape).astype(np.float32)


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of limited total length; a long text is a range of its own."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and (size + len(t) > _CELLS or i - a >= 64):
            yield a, i
            a = i
            size = 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.maximum(norm, 1e-12)[:, None]


@dataclass
class LanguageModel:
    """langs[i] is the language of centroids[i]; of a text of 2**k to 2**(k+1) distinct n-grams a cosine under limits[k] is a rejection."""

    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    limits: np.ndarray

    def predict(self, grams: Grams, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        langs, scores, rejected = [], np.zeros(len(texts)), np.ones(len(texts), bool)
        for a, b in chunks(texts):
            counts = grams.counts(texts[a:b])
            lettered = counts.any(axis=1)
            if not self.langs:
                langs += [UNKNOWN] * (b - a)
                continue
            cosine = _weigh(counts, self.idf) @ self.centroids.T
            best = cosine.argmax(axis=1)
            value = np.clip(cosine[np.arange(b - a), best], 0, 1)
            langs += [self.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), lettered.tolist())]
            scores[a:b] = np.where(lettered, value, 0)
            rejected[a:b] = ~lettered | (value < self.limits[_length(counts)])
        return langs, scores, rejected


def _length(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(1, np.count_nonzero(counts, axis=1))).astype(np.int64)


def length_limits(lengths: np.ndarray, cosines: np.ndarray, share: float, slack: float, least: int = 30) -> np.ndarray:
    """Limits by length: ``slack`` times the cosine that all but ``share`` of the documents of that length reach.

    Lengths with fewer than ``least`` documents: longer ones take the limit of the next shorter length, shorter ones a third of the
    shortest's.
    """
    out = np.full(1 + FEATURES.bit_length(), np.nan)
    for k in range(len(out)):
        mine = cosines[lengths == k]
        if len(mine) >= least:
            out[k] = slack * np.quantile(mine, share)
    known = np.flatnonzero(~np.isnan(out))
    if not len(known):
        return np.zeros(len(out))
    out[: known[0]] = out[known[0]] / 3
    for k in range(known[0] + 1, len(out)):
        out[k] = out[k - 1] if np.isnan(out[k]) else out[k]
    return out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows, started far from each other."""
    start = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[start[0]]
    for _ in range(1, min(k, len(x))):
        start.append(int(near.argmin()))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1), 1e-12)[:, None]
    return c


_FIT = "lang string, df binary, cells binary"
_FIT_PA = pa.schema([("lang", pa.string()), ("df", pa.binary()), ("cells", pa.binary())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the partition, and the vectors of the sampled documents."""
    grams, df, seen = Grams(), np.zeros(FEATURES + 1, np.int64), False
    for batch in batches:
        texts, langs, picked = (batch.column(c).to_pylist() for c in ("text", "lang", "picked"))
        for a, b in chunks(texts):
            counts = grams.counts(texts[a:b])
            df[:-1] += (counts > 0).sum(axis=0)
            df[-1] += counts.any(axis=1).sum()
            seen = True
            rows = [i for i in range(b - a) if picked[a + i] and counts[i].any()]
            if rows:
                cells = []
                for i in rows:
                    at = np.flatnonzero(counts[i]).astype(np.int32)
                    cells.append(at.tobytes() + counts[i][at].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([langs[a + i] for i in rows]), pa.nulls(len(rows), pa.binary()), pa.array(cells, pa.binary())], schema=_FIT_PA)
    if seen:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([df.tobytes()], pa.binary()), pa.nulls(1, pa.binary())], schema=_FIT_PA)


def _add(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = np.zeros(FEATURES + 1, np.int64), False
    for batch in tables:
        for m in batch.column("df").to_pylist():
            total += np.frombuffer(m, np.int64)
            seen = True
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["df"])


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None, centroids: int = 4, fit_docs: int = 1500, slack: float = 0.6, share: float = 0.001, seed: int = 11, id_col: str | None = "doc_id") -> LanguageModel:
    """Learns from the rows with a language (and ``where``).

    fit_docs: documents a language whose vectors are clustered, on average.
    slack, share: a text is rejected below ``slack`` times the cosine that all but ``share`` of the sampled documents of its length reach.
    id_col: a column that, with the text, decides what is sampled; it is no input of a prediction.
    """
    known = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    if where is not None:
        known = known.where(where)
    chance = F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{text_col}`"), *([F.col(f"`{id_col}`")] if id_col in docs.columns else [])), F.lit(1 << 30)) / F.lit(float(1 << 30))
    known = known.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), chance.alias("chance"))
    sizes = dict(known.groupBy("lang").count().collect())
    if not sizes:
        return LanguageModel([], np.zeros((0, FEATURES), np.float32), np.ones(FEATURES, np.float32), np.zeros(1 + FEATURES.bit_length()))
    picked = F.coalesce(F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, fit_docs / n))])[F.col("lang")], F.lit(0.0))
    found = written(known.withColumn("picked", F.col("chance") < picked).mapInArrow(_count, _FIT), "languages")
    parts = found.where("df is not null").select("df")
    df = np.zeros(FEATURES + 1, np.int64)
    for (m,) in parts.repartition(64).mapInArrow(_add, "df binary").collect():  # 64 vectors at most
        df += np.frombuffer(m, np.int64)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + np.float32(1)
    names, cents, lengths, cosines = [], [], [], []
    sample = found.where("cells is not null")
    for lang in sorted(sizes):  # the driver holds one language's sample at a time
        cells = sorted(m for (m,) in sample.where(F.col("lang") == lang).select("cells").collect())
        if not cells:
            continue
        rows = np.zeros((len(cells), FEATURES), np.float32)
        for i, m in enumerate(cells):
            n = len(m) // 8
            rows[i, np.frombuffer(m, np.int32, n)] = np.frombuffer(m, np.float32, n, 4 * n)
        x = _weigh(rows, idf)
        c = spherical_kmeans(x, centroids)
        used = np.unique((x @ c.T).argmax(axis=1))
        names += [lang] * len(used)
        cents.append(c[used])
        for half in (0, 1):  # cosines with centroids that were learned without the document
            other, mine = x[1 - half :: 2], x[half::2]
            if len(other) and len(mine):
                cosines.append((mine @ spherical_kmeans(other, centroids, 6).T).max(axis=1))
                lengths.append(_length(rows[half::2]))
    limits = length_limits(np.concatenate([[0], *lengths])[1:], np.concatenate([[0.0], *cosines])[1:], share, slack)
    return LanguageModel(names, np.concatenate([np.zeros((0, FEATURES)), *cents]).astype(np.float32), idf, limits)


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            langs, scores, rejected = model.predict(grams, batch.column("__text").to_pylist())
            i = batch.schema.get_field_index("__text")
            cols = [c for k, c in enumerate(batch.columns) if k != i]
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)], names=[*names, "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with lang_pred, score (cosine, 0 to 1) and rejected.

    Raises ValueError if ``keep`` holds one of these names.
    """
    if {"lang_pred", "score", "rejected", "__text"} & set(keep):
        raise ValueError("keep holds a name of the result")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(_predict(model), schema + (", " if schema else "") + "lang_pred string, score double, rejected boolean")


def remainder(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, where=remainder() != 2)
    return identify(docs, model, ["doc_id"]).select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
