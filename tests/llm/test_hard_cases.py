"""Cases that broke weaker versions: colliding words, hot keys, deep pages, foreign languages, gaps of an index, descent of the audit."""

import random
import time

import numpy as np
import pytest

from kartolith.llm import warc
from kartolith.llm._common import balanced_labels, string_array, with_label
from kartolith.llm._hashing import word_hashes, word_spans
from kartolith.llm.html_extraction import main_text
from kartolith.llm.language_id import Grams, identify, learn, length_limits, remainder, spherical_kmeans
from kartolith.llm.near_dedup import allowed, near_dedup
from kartolith.llm.substring_dedup import substring_dedup
from kartolith.llm.suffix_dedup import suffix_order


def thue_morse(n: int) -> tuple[str, str]:
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [8, 64, 512, 1024, 2048, 4096])
def test_words_do_not_collide(size):
    data = np.frombuffer(" ".join(thue_morse(size)).encode(), np.uint8)
    for seed in (0, 1):
        a, b = word_hashes(data, *word_spans(data, np.array([0, len(data)]))[:2], seed)
        assert a != b


def test_word_hashes_are_content_alone():
    words = [b"a", b"ab", b"a" * 8, b"a" * 9, b"b" * 64, b"b" * 65, "日本".encode()]
    one, two = np.frombuffer(b" ".join(words), np.uint8), np.frombuffer(b"xx " + b"  ".join(words[::-1]), np.uint8)
    a = word_hashes(one, *word_spans(one, np.array([0, len(one)]))[:2])
    b = word_hashes(two, *word_spans(two, np.array([0, len(two)]))[:2])
    assert len(set(a.tolist())) == len(words) and a.tolist() == b[1:].tolist()[::-1]


def test_documents_of_colliding_words_stay(spark):
    x, y = thue_morse(2048)
    common = " ".join(f"w{i}" for i in range(49))
    df = spark.createDataFrame([(1, f"{common} {x}"), (2, f"{common} {y}"), (3, f"p {x}"), (4, f"p {y}")], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup(df).collect()} == {0}
    near = {r.doc_id: r.component_id for r in near_dedup(df).collect()}
    assert near[3] == 3 and near[4] == 4


@pytest.mark.parametrize("width,each", [(7, 4), (51, 8), (3000, 4)])
def test_labels_are_dealt_exactly(spark, width, each):
    from pyspark.sql import functions as F

    got = with_label(spark.range(width * each), F.col("id"), "label").withColumn("part", F.pmod(F.hash("label"), F.lit(width))).orderBy("id").collect()
    assert [r.label for r in got] == balanced_labels(width, each).tolist() and all(r.part == r.id % width for r in got)


def test_string_array_keeps_offsets():
    data, off = np.frombuffer(b"abcdef", np.uint8), np.array([0, 2, 2, 6])
    assert string_array(data, off).to_pylist() == ["ab", "", "cdef"] and string_array(data, off, binary=True).to_pylist() == [b"ab", b"", b"cdef"]
    assert string_array(data[:0], np.zeros(1, np.int64)).to_pylist() == []


def family(copies: int, edits: tuple[int, int], seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for i in range(copies):
        w = list(base)
        for _ in range(rng.randint(*edits)):
            w[rng.randrange(len(w))] = f"m{rng.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return out


def test_forest_equals_the_exact_join(spark):
    """Recall of the forest against the prefix-filter join, on families around the threshold, copies and strangers."""
    rng = random.Random(9)
    texts = family(90, (0, 6), 1) + [(1000 + i, t) for i, t in family(40, (3, 5), 2)] + [(2000 + i, " ".join(f"s{rng.randrange(10**7)}" for _ in range(60))) for i in range(60)]
    texts += [(3000 + i, texts[i][1]) for i in range(0, 60, 3)] + [(None, "a b"), (4000, ""), (4001, None), (4002, "a b")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    forest, exact = ({r.doc_id: r.component_id for r in near_dedup(df, exact=e).collect()} for e in (False, True))
    assert forest == exact and len(set(exact.values())) > 60


def test_screen_is_far_below_the_threshold():
    assert allowed(128, 70) >= 43 and allowed(16, 95) >= 4


def test_deep_pages_take_linear_time():
    for tag in ("<ul><li>", "<div>", "<nav><div>"):
        began = time.time()
        text = main_text("<body><p>Some words here.</p>" + tag * 16_000 + "deep words")
        assert text.startswith("Some words here.") and time.time() - began < 5


def test_links_decide_where_no_name_does():
    """Pages without article, main or telling names: what is mostly links goes because of its density, paragraphs stay."""
    text = "This sentence belongs to the page and is long enough to matter here. " * 3
    links = "".join(f"<li><a href=/{i}>Some link of several words {i}</a></li>" for i in range(12))
    advert = "<div><a href=/buy>" + "Buy this very useful thing now, it is cheap. " * 4 + "</a></div>"
    assert main_text(f"<body><div><ul>{links}</ul></div><div><p>{text}</p><p>{text}</p></div>{advert}<div><ul>{links}</ul></div></body>") == f"{text.strip()}\n{text.strip()}"
    plain = main_text(f"<body><div><ul>{links.replace('<a', '<b').replace('</a', '</b')}</ul></div><div><p>{text}</p><p>{text}</p></div></body>")
    assert "Some link of several words 3" in plain  # the same words without links are text


SYLLABLES = {"xx": ["ka", "to", "mi", "re", "no"], "yy": ["sch", "ung", "ber", "ich", "ein"], "zz": ["que", "mente", "es", "lla", "os"], "alien": ["wyn", "gwr", "dda", "ych", "lio", "fy"]}


def speech(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_that_were_not_learned_are_rejected(spark):
    rng = random.Random(4)
    data = [(i, speech(rng, lang, rng.randint(3, 60)), lang) for i, lang in enumerate(rng.choice(["xx", "yy", "zz"]) for _ in range(900))]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = learn(df, where=remainder() != 2)
    assert not any(r.rejected for r in identify(df, model, ["doc_id"]).where(remainder() == 2).collect())
    strange = [speech(rng, "alien", 40) for _ in range(50)] + ["def main(argv):\n    for x in range(10):\n        print(x, argv[x])\n    return None if not argv else sum(map(int, argv))"]
    _, scores, rejected = model.predict(Grams(), strange)
    assert rejected.mean() > 0.95 and scores.max() < 1
    again = learn(df.repartition(7), where=remainder() != 2)  # the sample does not depend on the layout
    assert again.langs == model.langs and np.allclose(again.limits, model.limits) and np.allclose(again.centroids, model.centroids)


def test_prediction_equals_brute_force(spark):
    """Cosines of TF-IDF vectors with every centroid, one text at a time, in dictionaries."""
    rng = random.Random(8)
    df = spark.createDataFrame([(i, speech(rng, lang, rng.randint(3, 30)), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 60)], "doc_id long, text string, lang string")
    model, grams = learn(df), Grams()
    texts = [r.text for r in df.limit(40).collect()]
    langs, scores, _ = model.predict(Grams(), texts)
    for text, lang, score in zip(texts, langs, scores):
        counts = {k: float(v) for k, v in enumerate(grams.counts([text])[0]) if v}
        vector = {k: np.log1p(v) * float(model.idf[k]) for k, v in counts.items()}
        norm = sum(v * v for v in vector.values()) ** 0.5
        cosines = [sum(v * float(c[k]) for k, v in vector.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert abs(cosines[best] - score) < 1e-4 and (lang == model.langs[best] or min(abs(cosines[i] - cosines[best]) for i in range(len(cosines)) if model.langs[i] == lang) < 1e-5)


def test_length_limits():
    limits = length_limits(np.repeat([4, 6], 50), np.repeat([0.3, 0.6], 50), 0.01, 0.5)
    assert np.allclose(limits[[3, 4, 5, 6, 9]], [0.05, 0.15, 0.15, 0.3, 0.3]) and not length_limits(np.array([]), np.array([]), 0.1, 0.5).any()
    assert spherical_kmeans(np.eye(2, dtype=np.float32), 4).shape == (2, 2)


def test_audit_reads_only_below_mismatches(spark, tmp_path):
    df = spark.range(600).selectExpr("id AS page_id", "concat('u', id) AS url", "repeat('x', 50) AS html", "'c' AS file", "1 AS level", "2 AS node").coalesce(1)
    good, bad = str(tmp_path / "g"), str(tmp_path / "b")
    index = warc.write_warc(df, [good, bad], "page_id", "url", "html", harm=lambda i, _, raw: raw[:-1] + bytes([raw[-1] ^ 1]) if i == 321 else raw)
    a, b = warc.merkle_tree(index, good), warc.merkle_tree(index, bad)
    suspects, top, read = None, a.selectExpr("max(level)").first()[0], []
    for level in range(top, -1, -1):
        mine, yours = ({(r.file, r.node): bytes(r.digest) for r in warc.below(t, level, suspects).collect()} for t in (a, b))
        read.append(len(mine))
        wrong = [k for k, d in mine.items() if yours[k] != d]
        suspects = spark.createDataFrame(wrong, "file string, node long")
    assert read == [1, 3, 16, 16] and wrong[0][1] == 321
    assert [(r.ordinal, r.state) for r in warc.audit(a, b).collect()] == [(321, "changed")]
    plan = a._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_audit_of_an_index_with_gaps(spark, tmp_path):
    df = spark.range(100).selectExpr("id AS page_id", "'u' AS url", "repeat('y', 30) AS html").coalesce(1)
    good, bad = str(tmp_path / "g"), str(tmp_path / "b")
    index = warc.write_warc(df, [good, bad], "page_id", "url", "html", harm=lambda i, _, raw: raw[:-1] + b"!" if i in (40, 77) else raw)
    some = index.where("ordinal % 10 = 7")
    found = warc.audit(warc.merkle_tree(some, good), warc.merkle_tree(some, bad)).collect()
    assert [r.ordinal for r in found] == [7]  # the eighth record of the index is the 78th of the file


@pytest.mark.parametrize("alphabet,n,length", [(2, 900, 24), (3, 500, 40), (1, 300, 32), (26, 800, 100), (2, 4000, 100)])
def test_suffix_order_is_lexicographic(alphabet, n, length):
    rng = np.random.default_rng(alphabet * n)
    data = rng.integers(97, 97 + alphabet, n).astype(np.uint8)
    data[n // 2 : n // 2 + n // 4] = data[: n // 4]
    data[n // 4 : n // 4 + 30] = 255  # bytes over 127 order as unsigned
    at = np.arange(len(data) - length)
    order, lcp = suffix_order(data, at, length)
    cut = [data[i : i + length].tobytes() for i in at]
    assert order.tolist() == sorted(range(len(at)), key=lambda i: (cut[i], i))
    for k in range(1, len(order)):
        a, b = cut[order[k - 1]], cut[order[k]]
        assert lcp[k] == next((i for i in range(length) if a[i] != b[i]), length)
    assert suffix_order(data, at[:0], length)[0].tolist() == []


def test_copies_are_not_sorted(monkeypatch):
    """Suffixes equal to an earlier one are found by runs: the bytes read by the sort follow the distinct ones, not all."""
    from kartolith.llm import suffix_dedup as s

    text = np.random.default_rng(3).integers(97, 105, 2000).astype(np.uint8)
    data, read, at = np.tile(text, 40), [], s._expand(np.arange(40) * 2000, np.full(40, 1901))
    words_at = s.words_at
    monkeypatch.setattr(s, "words_at", lambda d, i: read.append(len(i)) or words_at(d, i))
    assert s.first_equal(data, at, 100).tolist() == list(range(1901)) * 40
    assert sum(read) < len(at)


@pytest.mark.parametrize("hashes", [1, 7])
def test_strings_of_one_hash_are_told_apart(monkeypatch, hashes):
    from kartolith.llm import suffix_dedup as s

    rng = np.random.default_rng(hashes)
    data = rng.integers(97, 99, 700).astype(np.uint8)
    data[300:450] = data[:150]
    data[500:600] = data[310:410]
    at = np.concatenate([np.arange(250, 650), np.arange(250)])
    monkeypatch.setattr(s, "window_hashes", lambda d, i, n: d[i].astype(np.uint64) * 0 + (d[i] * 3 + d[i + n - 1] + d[i + 5] * 5).astype(np.uint64) % np.uint64(hashes))
    seen = {}
    want = [seen.setdefault(data[i : i + 32].tobytes(), k) for k, i in enumerate(at.tolist())]
    assert s.first_copies(data, at, 32).tolist() == want
    assert s.first_equal(data, at, 32).tolist() == want


def test_regions_thinned_in_their_bucket(spark, monkeypatch):
    """Families that are dense within single buckets: the same components as by the exact join."""
    from kartolith.llm import near_dedup as module

    texts = family(260, (0, 6), 11) + [(1000 + i, t) for i, t in family(120, (4, 6), 12)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    exact = {r.doc_id: r.component_id for r in near_dedup(df, exact=True).collect()}
    monkeypatch.setattr(module, "LOCAL", 2)
    assert {r.doc_id: r.component_id for r in near_dedup(df).collect()} == exact


def test_narrow_regions_need_no_further_forest(spark, monkeypatch):
    """Documents that share much, but less than the threshold: their regions are compared in full at once, sets moving once a cell."""
    from kartolith.llm import near_dedup as n

    rng = np.random.default_rng(8)
    word = lambda k: " ".join(map(str, rng.integers(0, 10**9, k)))
    common = word(90)
    texts = [(i, f"{common} {word(22)}") for i in range(120)]
    texts += [(500 + i, texts[i][1] + " " + word(3)) for i in range(0, 120, 10)]
    rounds, forest = [], n._round
    monkeypatch.setattr(n, "_round", lambda *a: rounds.append(a[-1]) or forest(*a))
    for limit in (n.CELL_SHINGLES, 0):  # regions of one document together, or each alone
        monkeypatch.setattr(n, "CELL_SHINGLES", limit)
        rounds.clear()
        got = {r.doc_id: r.component_id for r in n.near_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
        assert got == {i: i - 500 if i >= 500 else i for i, _ in texts} and rounds == [0]


def test_rows_of_one_identifier_are_no_link(spark):
    from kartolith.llm.near_dedup import near_dedup

    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(7, text), (7, text + " more")], "doc_id long, text string")
    assert [(r.component_id, r.n_links) for r in near_dedup(df).collect()] == [(7, 0)] * 2


@pytest.mark.parametrize("block", [3, 500])
def test_cells_compare_all_components(monkeypatch, block):
    import pyarrow as pa

    from kartolith.llm import near_dedup as n

    sets = [np.arange(a, a + 20, dtype=np.uint64) for a in (0, 1, 30, 32, 100, 2, 200)]
    monkeypatch.setattr(n, "BLOCK", block)
    table = pa.table({"component": pa.array([1, 2, 3, 4, 5, 1, 7]), "regions": [[1, 2], [1], [1, 2], [2], [2], [1], [1]], "shingles": [x.tobytes() for x in sets]})
    found = n._compare_cell(70)(table)
    assert list(zip(found["u"].to_pylist(), found["v"].to_pylist())) == [(1, 2), (3, 4)]


def test_counts_do_not_depend_on_neighbours():
    texts = ["abc def", "", "x.", "...", "y z!", "q", " lead", "ab"]
    together = Grams().counts(texts)
    for i, t in enumerate(texts):
        assert (together[i] == Grams().counts([t])[0]).all()
    assert (Grams().counts(["ab"])[0] == Grams().counts(["..ab!!"])[0]).all()
