"""Dealt operators against brute force, over nulls, ties, repeats, odd texts, empty tables and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import cases

from kartolith.llm.decontamination import decontaminate
from kartolith.llm.exact_dedup import exact_dedup
from kartolith.llm.language_id import identify, learn, remainder, spherical_kmeans
from kartolith.llm.line_dedup import SortedRuns, line_dedup
from kartolith.llm.near_dedup import components, near_dedup
from kartolith.llm.packing import Encoder, TournamentTree, first_fit_decreasing, pack
from kartolith.llm.substring_dedup import substring_dedup
from kartolith.llm.suffix_dedup import first_equal, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WS = "\x20\t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FIRST = -(2**63)
key = lambda i: FIRST if i is None else i
rows = lambda df: Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("window", [4, 7, 50])
def test_substring(docs, no_docs, window):
    texts = [(i, WORD.findall(t or "")) for i, t in cases()]
    least = {}
    for i, w in texts:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, key(i)), key(i))
    want = Counter()
    for i, w in texts:
        gone = {p for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < key(i) for p in range(k, k + window)}
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert rows(substring_dedup(docs, window=window)) == want
    assert substring_dedup(no_docs).count() == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(docs, no_docs, keep):
    groups = defaultdict(list)
    for i, t in cases():
        groups[t or ""].append(i)
    got = exact_dedup(docs, keep=keep).collect()
    assert Counter((r.doc_id, r.group_size, r.text_sha256) for r in got) == Counter((i, len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    pick = (max if keep == "largest" else min)
    for t, g in groups.items():
        digest = hashlib.sha256(t.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == digest]
        best = pick(g, key=key)
        assert {r.keep_id for r in mine} == {best} and [r.doc_id for r in mine if r.kept] == [best]
    assert exact_dedup(no_docs).count() == 0


def test_exact_normalised(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "c")], "doc_id long, text string")
    assert {(r.doc_id, r.kept) for r in exact_dedup(df, normalise=F.lower("text")).collect()} == {(1, True), (2, False), (3, True)}


def test_exact_spread_group(spark):
    """A text that most rows share spreads over partitions and is still one group."""
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact_dedup(df, keep="largest").where("text_sha256 = sha2('same', 256)")
    assert [tuple(r) for r in got.groupBy("keep_id", "group_size").count().collect()] == [(19_998, 6667, 6667)] and got.where("kept").count() == 1


@pytest.mark.parametrize("least,docs_needed", [(20, 3), (3, 2)])
def test_lines(docs, no_docs, least, docs_needed):
    held = defaultdict(set)
    for i, t in cases():
        for line in (t or "").split("\n"):
            k = line.strip(WS).translate(LOW)
            if len(k) >= least:
                held[k].add(key(i))
    want = Counter()
    for i, t in cases():
        lines = (t or "").split("\n")
        gone = [len(held.get(k := x.strip(WS).translate(LOW), ())) >= docs_needed and max(held[k]) != key(i) for x in lines]
        want[i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)] += 1
    assert rows(line_dedup(docs, min_chars=least, min_docs=docs_needed)) == want
    assert line_dedup(no_docs).count() == 0
    carried = line_dedup(docs, min_chars=least, min_docs=docs_needed, carry="lang")
    assert carried.columns[-1] == "lang" and rows(carried.drop("lang")) == want


def test_sorted_runs():
    rng = np.random.default_rng(5)
    runs, want = SortedRuns(3), {}
    for _ in range(40):
        h = np.unique(rng.integers(0, 300, 30).astype(np.uint64))
        for x in h.tolist():
            n, t = want.get(x, (0, 0))
            want[x] = n + 1, max(t, x * 2)
        runs.add(h, h + np.uint64(1), np.ones(len(h), np.int64), (h * np.uint64(2)).astype(np.int64))
        assert all(len(level) < 3 for level in runs.levels)
    h1, _, n, t = runs.merged()
    assert dict(zip(h1.tolist(), zip(n.tolist(), t.tolist()))) == want


@pytest.mark.parametrize("length,gram", [(24, 8), (100, 32)])
def test_suffixes(docs, no_docs, length, gram):
    texts = sorted(((key(i), (t or "").encode()) for i, t in cases()))
    seen, want = set(), Counter()
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want[None if i == FIRST else i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in suffix_dedup(docs, length=length, gram=gram).collect())
    assert got == want
    assert suffix_dedup(no_docs).count() == 0


def test_first_equal():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    data[300:450] = data[:150]
    at = np.arange(len(data) - 32)
    seen = {}
    want = [seen.setdefault(data[i : i + 32].tobytes(), i) for i in at]
    assert first_equal(data, at, 32).tolist() == want


def brute_components(texts, percent=70, size=5):
    sets = defaultdict(list)
    for i, t in texts:
        w = WORD.findall((t or "").translate(LOW))
        sets[key(i)].append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for n, (i, a) in enumerate(flat):
        for j, b in flat[:n]:
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}, sets


def test_near(docs, no_docs):
    want, sets = brute_components(cases())
    got = near_dedup(docs).collect()
    assert len(got) == len(cases())
    for r in got:
        assert key(r.component_id) == want[key(r.doc_id)] and r.kept == (r.doc_id == r.component_id or r.doc_id is None)
        assert r.n_shingles in {len(s) for s in sets[key(r.doc_id)]}
    assert near_dedup(no_docs).count() == 0


def test_near_dense_family(spark):
    """Many near copies around the threshold: dense regions, several rounds."""
    import random

    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"m{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    want, _ = brute_components(texts)
    got = near_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_links_between_followers(spark):
    """A dense family just below the threshold, with pairs just above it that leaders and neighbours leave out."""
    from kartolith.llm.near_dedup import shared_counts

    core = " ".join(f"c{k}" for k in range(392))
    own = lambda i, n: " ".join(f"u{i}x{k}" for k in range(n))
    pairs = {70 + i: 31 + i for i in range(0, 30, 7)}
    texts = [(i, f"{core} {own(pairs.get(i, i), 5)} {own(-i - 1, 7)}") for i in range(120)]  # 388 of 412 shingles are common, 393 of 407 in pairs
    got = near_dedup(spark.createDataFrame(texts, "doc_id long, text string"), percent=95, trees=4).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id != r.component_id} == pairs
    sets = [[1, 2, 3, 9], [2, 3], [], [3, 9, 11]]
    counts = shared_counts(np.array(sum(sets, []), np.uint64), np.cumsum([0, *map(len, sets)]), np.array([0, 2]), np.array([1, 2, 3]), 2)
    assert counts.tolist() == [[len(set(sets[i]) & set(sets[j])) for j in (1, 2, 3)] for i in (0, 2)]


def test_components(spark):
    import random

    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    parent = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and parent[a] != parent[b]:
                parent[a] = parent[b] = min(parent[a], parent[b])
                changed = True
    assert {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()} == parent


ITEMS = [(1, " ".join(f"q{i}" for i in range(30))), (2, "tiny item"), (3, None), (4, ""), (None, " ".join(f"z{i}" for i in range(12))), (1, " ".join(f"q{i}" for i in range(30)))]


@pytest.mark.parametrize("blocks", [20_000, 2])
def test_contamination(spark, docs, no_docs, blocks):
    long = " ".join(f"f{i}" for i in range(5000))
    q = ITEMS[0][1].split()
    extra = [(200, f"{long} {ITEMS[0][1].upper()} {long}"), (201, " ".join(q[:25])), (202, " ".join(q[:18])), (203, "tiny item"), (204, "a tiny item"), (205, ITEMS[4][1] + " " + ITEMS[0][1])]
    texts = cases() + extra
    df = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")

    def sets(t):
        w = WORD.findall((t or "").translate(LOW))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    items = [(i, sets(t)) for i, t in ITEMS]
    want = Counter()
    for i, t in texts:
        s = sets(t)
        hit = [(j, len(x & s) / len(x)) for j, x in items if x and 100 * len(x & s) >= 70 * len(x)]
        ids = sorted((j for j, _ in hit), key=lambda j: (j is None, j or 0))
        want[i, str(ids or None), len(hit), round(max((c for _, c in hit), default=0.0), 9), bool(hit)] += 1
    got = decontaminate(df, bench, ["doc_id"], block_items=blocks).collect()
    assert Counter((r.doc_id, str(r.item_ids), r.n_items, round(r.containment, 9), r.contaminated) for r in got) == want
    assert decontaminate(no_docs, bench, ["doc_id", "kept", "h"]).count() == 0
    assert decontaminate(docs, bench.where("false"), ["doc_id", "part"]).where("contaminated").count() == 0
    with pytest.raises(ValueError):
        decontaminate(docs.withColumnRenamed("h", "n_items"), bench, ["n_items"])


def test_packing(spark, docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    capacity = 64
    got = pack(docs, path, capacity=capacity, group_docs=20, with_ids=True).collect()
    want = Counter()
    for i, t in cases():
        want[i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id, r.doc_tokens].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s)])[:-1].tolist() and sum(r.length for r in s) <= capacity
    assert sum(len(k[1]) * n for k, n in want.items()) == sum(r.length for r in got)
    for (i, n), own in pieces.items():
        docs_of = [ids for (j, ids), c in want.items() for _ in range(c) if j == i and len(ids) == n]
        assert Counter((r.start, tuple(r.ids)) for r in own) == Counter((a, ids[a : a + capacity]) for ids in docs_of for a in range(0, n, capacity))
    assert pack(no_docs, path).count() == 0


def test_encoder_equals_tokenizers():
    import random

    import public_tokenizers
    from kartolith.llm import packing

    encoder, rng = Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    texts = ["", " ", "a  b\n c", "it's <|endoftext|> x <|endoftext|>y"] + ["".join(rng.choice(" \n\taé'sl1 !  ßЖ語🙂<|>") for _ in range(rng.randrange(60))) for _ in range(4000)]
    limit, packing._MEMO_WORDS = packing._MEMO_WORDS, 500
    try:
        for k in range(0, len(texts), 200):
            for t, ids in zip(texts[k : k + 200], encoder.encode(texts[k : k + 200])):
                assert ids.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
    finally:
        packing._MEMO_WORDS = limit


def test_encoder_encodes_a_word_once():
    """Words that differ in what follows them are one piece, known from then on; cuts leave the ids as they are."""
    import random

    import public_tokenizers

    encoder, rng = Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    marks = [".", ",", "###", "\n", ".\n", "?!", " ", " |", "12", "'", "'s"]
    words = ["".join(rng.choice("abcdeß") for _ in range(9)) for _ in range(300)]
    for mark in marks:
        encoder.encode([" ".join(w + mark for w in words)])
    assert len(encoder.words) <= len(words) + 60
    odd = list(" \n\r\tab'sßÇ×÷ȿɐЖ\u0301\xa0\u2003\x85\x1c\x00\x7fª语🙂19.#'") + ["'ll", "'ve", "  ", "\n\n", " \n", "\n ", "<|endoftext|>"]
    for _ in range(300):
        pool = rng.sample(odd, rng.randrange(2, 9))
        texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(25))) for _ in range(60)]
        for t, ids in zip(texts, encoder.encode(texts)):
            assert ids.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_first_fit():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 300)
    bins, offsets = first_fit_decreasing(sizes, 100)
    room: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        assert bins[i] == b and offsets[i] == 100 - room[b]
        room[b] -= sizes[i]
    assert TournamentTree(1, 5).place(5) == 0


def test_language(spark, docs, no_docs):
    import random

    rng = random.Random(6)
    syllables = {"xx": ["ka", "to", "mi", "re"], "yy": ["sch", "ung", "ber", "ich"], "zz": ["ção", "mente", "es", "lla"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3)))
    data = [(i, " ".join(word(lang) for _ in range(rng.randint(5, 40))), lang) for i, lang in enumerate(rng.choice(list(syllables)) for _ in range(600))]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = learn(df, where=remainder() != 2)
    got = identify(df, model, ["doc_id", "lang"]).where(remainder() == 2).collect()
    assert len(got) > 80 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97 and not any(r.rejected for r in got)
    alien = identify(spark.createDataFrame([(1, "Жжщ Ыфц ъэю"), (2, None), (3, ""), (4, "12 !! 34"), (5, "Kato")], "doc_id long, text string"), model, ["doc_id"]).orderBy("doc_id").collect()
    assert alien[0].rejected and [r.lang_pred for r in alien[1:4]] == ["und"] * 3 and all(r.score == 0 and r.rejected for r in alien[1:4]) and alien[4].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got + alien)
    assert identify(docs, learn(docs), ["doc_id", "h", "part"]).count() == len(cases())
    assert identify(docs, learn(no_docs), ["doc_id"]).where("lang_pred <> 'und'").count() == 0 and identify(no_docs, model, ["doc_id"]).count() == 0


def test_kmeans():
    x = np.eye(6, dtype=np.float32)[[0, 0, 1, 1, 2, 2]]
    c = spherical_kmeans(x, 3)
    assert np.allclose((x @ c.T).max(axis=1), 1)
