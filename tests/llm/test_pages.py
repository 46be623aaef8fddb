"""HTML extraction on hand-made pages; WARC round trips and audits with known damage."""

import hashlib
import random

import pytest

from kartolith.llm import warc
from kartolith.llm.html_extraction import extract_html, main_text

SENTENCE = "This sentence belongs to the article and is long enough to matter here. "
ARTICLE = f"<article><header><h1>Title &amp; more</h1></header><p>{SENTENCE * 3}</p><p>Second&nbsp;paragraph\n with <b>bold</b> and <a href='/x'>one link</a>.<p>{SENTENCE * 2}</article>"
TEXT = f"Title & more\n{(SENTENCE * 3).strip()}\nSecond paragraph with bold and one link.\n{(SENTENCE * 2).strip()}"


@pytest.mark.parametrize(
    "around",
    [
        "<html><body>{}</body></html>",
        "<!DOCTYPE html><head><title>t</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><nav><ul><li><a href=/>Home</a></ul></nav>{}<footer>Imprint text</footer>",
        "<body><header><p>Site header words</p></header><div class='ad-banner'><p>" + "Buy now. " * 40 + "</p></div>{}<div id=comments><article class='comment'><p>" + "First! " * 50 + "</p></article></div>",
        "<body><div><div><aside>" + "<p>Side words. </p>" * 9 + "</aside>{}</div></div><form><p>Your mail</p><input></form><!-- <p>gone</p> --></body>",
        "<body><div class=cookie-notice>We use cookies</div><ul><li><a href=a>A</a><li><a href=b>B</a></ul><main>{}</main><div role=contentinfo>x</div><div hidden>y</div>",
    ],
)
def test_article_alone(around):
    assert main_text(around.format(ARTICLE)) == TEXT


@pytest.mark.parametrize("html,want", [(None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<script>x</script>", ""), ("a &lt;b&gt;", "a <b>"), ("<br><br>", ""), ("< 3 hearts", "< 3 hearts"), ("<p>x" + "<div>" * 3000 + "deep", "x\ndeep")])
def test_odd_pages(html, want):
    assert main_text(html) == want


def test_pages_without_article_elements():
    body = "".join(f"<p>{SENTENCE * n}</p>" for n in (3, 1, 2))
    menu = "<div>" + "".join(f"<a href=/{i}>Link number {i}</a> " for i in range(30)) + "</div>"
    assert main_text(f"<body>{menu}<div><div>{body}</div></div>{menu}</body>") == "\n".join((SENTENCE * n).strip() for n in (3, 1, 2))


def test_text_beside_the_core():
    long, menu = (SENTENCE * 4).strip(), "<div>" + "".join(f"<a href=/{i}>Link number {i}</a> " for i in range(30)) + "</div>"
    body = f"<h1>A heading of few words</h1><p>{long}</p><div>{f'<p>{long}</p>' * 5}</div><section><p>Short.</p><p>Also short.</p></section>"
    for around in ("<body>{}</body>", f"<body>{menu}{{}}{menu}</body>"):
        assert main_text(around.format(body)) == "\n".join(["A heading of few words", *[long] * 6, "Short.", "Also short."])


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "post-with-comments", "share-enabled", "social-sciences"])
def test_names_that_only_hold_an_unwanted_part(name):
    text = (SENTENCE * 3).strip()
    page = f"<body><div class='{name}'><p>{text}</p><p>{text}</p><div class='site-footer'>Imprint</div></div><div class='ad-banner'><p>Buy now.</p></div></body>"
    assert main_text(page) == f"{text}\n{text}"


def test_wrapping_form_open_head_and_code():
    text = (SENTENCE * 3).strip()
    assert main_text(f"<body><form action=x><div><p>{text}</p></div></form><form><p>Your mail</p></form></body>") == text
    assert main_text(f"<head><title>t</title><p>{text}") == text and main_text(f"<head><title>t</title>{text}") == text
    assert main_text(f"<article><p>{text}</p><pre>x = 1 <span class='hljs-comment'># one</span> <span class='comment'># two</span></pre></article>") == f"{text}\nx = 1 # one # two"


def test_fuzz_never_fails():
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<div class='a", "'>", "<", ">", "&amp", "&#x;", "<!--", "-->", "<script>", "</script>", "</", "text ", "<li>", "<td>", "<table>", "\x00", '"', "=", "<a href=x>", "</a>", "<body>", "<article>", "</article>", "é", "<br/>", "<!doctype>", "<nav>"]
    for _ in range(3000):
        text = main_text("".join(rng.choice(bits) for _ in range(rng.randrange(40))))
        assert all(line and line == " ".join(line.split()) for line in text.split("\n")) or text == ""


def test_extract_frame(spark):
    rows = [(1, "u", ARTICLE, "t"), (None, None, None, "x"), (1, "u", ARTICLE, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_html(df, ["page_id", "url"]).collect()
    assert sorted(((r.page_id or 0), r.text, r.n_chars) for r in got) == [(0, "", 0), (1, TEXT, len(TEXT)), (1, TEXT, len(TEXT))]
    assert extract_html(df.where("false"), ["page_id"]).count() == 0
    with pytest.raises(ValueError):
        extract_html(df, ["text"])


ROWS = [(i, f"http://x/{i}%0D?\n", "é<p>" * (i % 50) + "\r\n\r\n" * (i % 3)) for i in range(400)] + [(None, "u", "z"), (7, None, None), (7, None, None), (8, "", "")]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    good, bad, same = (str(tmp_path_factory.mktemp("warc") / n) for n in "abc")
    return df, warc.write_warc(df, [good, bad, same], "page_id", "url", "html"), good, bad, same


def test_round_trip(spark, archive):
    _, index, good, *_ = archive
    got = warc.read_warc(spark, good).collect()
    assert sorted(((r.record_id, r.uri, bytes(r.payload)) for r in got), key=str) == sorted(((i, u, (h or "").encode()) for i, u, h in ROWS), key=str)
    assert sorted((r.file, r.ordinal, r.offset, r.length) for r in got) == sorted((r.file, r.ordinal, r.offset, r.length) for r in index.collect())


def test_audit_finds_damage(spark, archive):
    _, index, good, bad, same = archive
    assert warc.audit(warc.merkle_tree(index, good), warc.merkle_tree(index, same)).count() == 0
    ranges = sorted((r.file, r.ordinal, r.offset, r.length) for r in index.collect())
    hurt = [ranges[0], ranges[17], ranges[200], ranges[-1]]
    for file, _, offset, length in hurt:
        with open(f"{bad}/{file}", "r+b") as f:
            f.seek(offset + length // 2)
            b = f.read(1)
            f.seek(-1, 1)
            f.write(bytes([b[0] ^ 255]))
    found = warc.audit(warc.merkle_tree(index, good), warc.merkle_tree(index, bad)).collect()
    assert sorted((r.file, r.ordinal, r.first_offset, r.end_offset, r.state) for r in found) == [(f, o, a, a + n, "changed") for f, o, a, n in hurt]


def test_audit_of_cut_and_missing_files(spark, archive, tmp_path):
    import shutil

    _, index, good, *_ = archive
    shutil.copytree(good, tmp_path / "d")
    files = sorted({r.file for r in index.collect()})
    (tmp_path / "d" / files[0]).unlink()
    last = max((r.ordinal, r.offset) for r in index.collect() if r.file == files[1])
    with open(tmp_path / "d" / files[1], "r+b") as f:
        f.truncate(last[1] + 3)
    with open(tmp_path / "d" / files[2], "ab") as f:
        f.write(b"tail")
    found = warc.audit(warc.merkle_tree(index, good), warc.merkle_tree(index, str(tmp_path / "d"))).collect()
    n = sum(r.file == files[0] for r in index.collect())
    assert sum(r.file == files[0] and r.state == "missing" for r in found) == n
    assert [(r.ordinal, r.state) for r in found if r.file == files[1]] == [(last[0], "changed")]
    assert [r.state for r in found if r.file == files[2]] == ["extra"]


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.write_warc(df, [str(tmp_path / "e")], "page_id", "url", "html")
    assert index.count() == 0 and warc.read_warc(spark, str(tmp_path / "e")).count() == 0
    tree = warc.merkle_tree(index, str(tmp_path / "e"))
    assert warc.audit(tree, tree).count() == 0


def test_tree_binds_order_and_offsets():
    leaves = [(i * 10, i * 10 + 10, hashlib.sha256(bytes([i])).digest()) for i in range(40)]
    root = list(warc.tree_levels(leaves, 4))[-1]
    swapped = leaves[:3] + [(30, 40, leaves[4][2]), (40, 50, leaves[3][2])] + leaves[5:]
    assert root[0] == 3 and root[2:4] == (0, 400) and list(warc.tree_levels(swapped, 4))[-1][4] != root[4]
