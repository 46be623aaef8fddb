"""Pipeline stages on awkward rows and on the small tables, each held against brute force on its own input."""

import re

import corpus_pipeline as cp
import pytest
from llm_cases import cases

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in cp.STAGES:
        after = cp.written(stage(spark, docs, DATA), name)
        out.append((docs, after))
        docs = after
    return out


def test_shape(spark, stages):
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    for before, after in stages[:-1]:
        assert after.columns == cp.COLUMNS and after.dtypes == before.dtypes


def test_language_keeps_text(stages):
    before, after = stages[0]
    has = lambda r: any(c.isalpha() for c in r.text or "")
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if has(r)}


def test_lines(stages):
    from test_corpus_operators import LOW, WS

    before, after = stages[1]
    held: dict[str, set[int]] = {}
    for r in before.collect():
        for x in (r.text or "").split("\n"):
            k = x.strip(WS).translate(LOW)
            if len(k) >= 20:
                held.setdefault(k, set()).add(r.doc_id)
    want = {}
    for r in before.collect():
        want[r.doc_id] = "\n".join(x for x in (r.text or "").split("\n") if len(h := held.get(x.strip(WS).translate(LOW), ())) < 3 or max(h) == r.doc_id)
    got = {r.doc_id: r for r in after.collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_near(stages):
    from test_corpus_operators import brute_components

    before, after = stages[2]
    want, _ = brute_components([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, c in want.items() if i == c)


def test_contamination(spark, stages):
    before, after = stages[3]
    grams = lambda t: {tuple(w[k : k + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", t.lower())] for k in range(len(w) - 4)}
    items = [grams(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in before.collect() if any(i and 100 * len(i & grams(r.text)) >= 70 * len(i) for i in items)}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == bad


def test_packing(stages):
    before, after = stages[4]
    lengths = {r.doc_id: 0 for r in before.collect()}
    for r in after.collect():
        lengths[r.doc_id] += r.length
    assert lengths == {r.doc_id: r.doc_tokens for r in after.collect()}


def test_run(spark, stages):
    assert cp.run(spark, DATA).count() == stages[4][1].count()


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_rows(spark, empty):
    rows = [] if empty else [(i, t, None if k % 3 else "en", None, None, "extra") for k, (i, t) in enumerate(cases())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, DATA), name)
    assert (docs.count() == 0) == empty
