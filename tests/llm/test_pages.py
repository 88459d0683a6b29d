"""WARC archives and main text of pages."""

import base64
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from regioscope.llm import scratch, site_style_tree, warc

PAGE = "page_id long, url string, html string, text string, payload string, first string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a.org/x y\r\n", "<p>same</p>"), (2, "http://a.org/2", "<p>same</p>"),
            (9, None, "<p>same</p>"), (None, "http://n.org", "<p>same</p>"), (3, "http://a.org/3", ""),
            (4, "http://a.org/4", None), (6, "http://b.org", "été 日本\r\n\r\nWARC/1.1\r\n"),
            (7, "http://b.org/long", "<div>" + "long text " * 50_000), (2, "http://a.org/2", "<p>same</p>"),
            (None, "http://c.org", "nobody else")]
    return spark.createDataFrame([(*r, "t", "p", "f") for r in rows], PAGE).repartition(3)


def expected(rows, min_bytes=0):
    smallest = {}
    for r in rows:
        p = (r["html"] or "").encode()
        if r["page_id"] is not None:
            smallest[p] = min(smallest.get(p, r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        p = (r["html"] or "").encode()
        first = smallest.get(p) if sum((x["html"] or "").encode() == p for x in rows) > 1 else None
        revisit = len(p) >= min_bytes and first is not None and r["page_id"] != first
        out.append((r["page_id"], len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
                    "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(pages, min_bytes):
    got = sorted(map(tuple, warc.round_trip(pages, min_bytes).collect()), key=str)
    assert got == expected(pages.collect(), min_bytes)


def test_round_trip_of_nothing(pages):
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_index_and_selected_reads(spark, pages, monkeypatch):
    target = scratch.folder(spark, "test-warc")
    index = warc.write(pages, target)
    rows = index.collect()
    path = target.removeprefix("file:")
    for r in rows:  # every index row leads to a record of its own, in archives that any tool can read
        with open(f"{path}/{r['file']}", "rb") as f:
            f.seek(r["offset"])
            record = zlib.decompress(f.read(r["length"]), 31)
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
        assert b"sha1:" + r["digest"].encode() in record
    some = warc.read(index.where("record_type = 'response' and page_id in (6, 7)"), target)
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in some.collect()}
    assert payloads == {r["page_id"]: r["html"] for r in pages.where("page_id in (6, 7)").collect()}
    monkeypatch.setattr(warc, "READ_BYTES", 1)
    assert warc.read(index, target).count() == len(rows)


def test_damage_is_seen():
    raw, _ = warc.record(1, "http://x", b"payload", None, False, "2000-01-01T00:00:00Z")
    assert warc.parse(zlib.compress(raw, wbits=31))["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(zlib.compress(raw.replace(b"payload\r\n\r\n", b"paXload\r\n\r\n"), wbits=31))


# ---- main text --------------------------------------------------------------------

def page(i, body, extra=""):
    return (f'<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t="</p><p>";</script></head>'
            f'<body><header class="site-header"><h2>My site</h2></header><nav><ul><li><a href="/">Home</a>'
            f'<li><a href="/x">News {i}</a></ul></nav><!-- <p>hidden</p> -->'
            f'<div class="ad">Buy now {i % 3}!</div><div class="box">Follow us</div><div id="main-column">{body}</div>'
            f'<aside>See also {i}</aside><form>Mail <input><button>Go</button></form>{extra}'
            f'<div class="comments"><p>Reader {i} says something of their own</p></div>'
            f'<footer>&copy; all pages</footer></body></html>')


@pytest.fixture(scope="module")
def site(spark):
    rows = [(i, f"https://News.example.org:80/{i}", page(i, f"<article><h1>Title &amp; {i}</h1><p>First  par\n{i}.<br>Next "
             f"&nbsp;line <b>bold</b>&#x21;<p>Second {i}<ul><li>one {i}<li>two</ul></article>")) for i in range(60)]
    rows += [(100, "http://one.org/a", page(100, "<article><p>Alone &lt;here&gt;</article>")),
             (101, None, None), (102, "http://one.org/b", ""), (103, "http://one.org/c", "plain text only"),
             (104, "http://deep.org", "<div>" * 3000 + "<p>deep</p>"), (105, "http://one.org/d", "<p>a < b</p><p unclosed"),
             (100, "http://one.org/a", page(100, "<article><p>Alone &lt;here&gt;</article>"))]
    return spark.createDataFrame([(*r, "t", "p", "f") for r in rows], PAGE).repartition(4)


def test_main_text(site, monkeypatch):
    rows = site_style_tree.extract(site).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    assert len(rows) == site.count()
    for i in range(60):
        assert got[i] == f"Title & {i}\n\nFirst par {i}. Next line bold!\n\nSecond {i}\n\none {i}\n\ntwo"
    assert got[100] == "Alone <here>"
    assert (got[101], got[102], got[103], got[104]) == ("", "", "plain text only", "deep")
    monkeypatch.setattr(site_style_tree, "SMALL_BYTES", -1)  # noise lists by join
    assert {r["page_id"]: r["text"] for r in site_style_tree.extract(site).collect()} == got


def test_boilerplate_without_telling_names_goes_by_entropy(spark):
    rows = [(i, f"http://h.org/{i}", f"<body><div class='x'><p>Always the same text here</p></div><div class='y'>"
             f"<p>Story number {i} with words {i * i}</p></div></body>", "", "", "") for i in range(50)]
    got = {r["page_id"]: r["text"] for r in site_style_tree.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert got[7] == "Story number 7 with words 49"


def test_same_article_on_all_pages_stays(spark):
    rows = [(i, f"http://h.org/{i}", "<body><div class='menu'>m</div><article><p>Printed again and again</p></article>",
             "", "", "") for i in range(50)]
    got = {r["text"] for r in site_style_tree.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {"Printed again and again"}


def test_no_pages(site):
    assert site_style_tree.extract(site.limit(0)).collect() == []


def test_roles_agree(spark):
    sigs = ["nav", "div", "div.ad", "div.main.column", "article.comment", "p.share", "header", "main", "body.nav"]
    df = spark.createDataFrame([(s,) for s in sigs], "s string").select("s", site_style_tree._role(F.col("s")).alias("r"))
    assert {r["s"]: r["r"] for r in df.collect()} == {s: site_style_tree.is_clutter(s) for s in sigs}


def test_copies_of_a_page_count_once(spark):
    body = "<body><div class='menu'>m</div><div class='x'><h1>Title {0}</h1><p>A text {0} without an article element</p></div></body>"
    rows = [(i, f"http://same.org/{i}", body.format(0), "", "", "") for i in range(50)]
    rows += [(100 + i, f"http://two.org/{i}", body.format(i % 2), "", "", "") for i in range(200)]
    rows += [(400 + i, f"http://menus.org/{i}", body.format(0).replace(">m<", f">m {i}<"), "", "", "") for i in range(50)]
    got = {r["page_id"]: r["text"] for r in site_style_tree.extract(spark.createDataFrame(rows, PAGE)).collect()}
    for i, _, page, *_ in rows:
        n = 1 if "Title 1" in page else 0
        assert got[i] == f"Title {n}\n\nA text {n} without an article element"


def test_entropy_decides_inside_main(spark):
    rows = [(i, f"http://in.org/{i}", f"<body><main><header><h1>Title {i}</h1></header><div class='x'><p>Read our terms first</p></div>"
             f"<section class='related work'><p>Prose {i} of its own</p></section><div class='share'>Share it</div>"
             f"<p>Story {i}</p></main></body>", "", "", "") for i in range(80)]
    got = {r["page_id"]: r["text"] for r in site_style_tree.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert all(got[i] == f"Title {i}\n\nProse {i} of its own\n\nStory {i}" for i in range(80))


@pytest.mark.parametrize("wrap", ["<div class='content-with-sidebar'>{}</div>", "<div id='header-fixed-layout'><main>{}</main></div>"])
def test_wrappers_with_clutter_names_keep_the_article(spark, wrap):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]

    def prose():
        return " ".join(rng.choice(words) for _ in range(30))
    rows, want = [], {}
    for i in range(40):
        text = [prose(), prose()]
        body = wrap.format("<article>" + "".join(f"<p>{t}</p>" for t in text) + "</article>")
        rows.append((i, f"https://h.example/{i}", "<html><body><div class='menu'><p>Home</p></div>" + body
                     + f"<div class='related'><p>{prose()}</p></div></body></html>"))
        want[i] = "\n\n".join(text)
    got = {r["page_id"]: r["text"] for r in site_style_tree.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_unclosed_tags_take_linear_time():
    import time
    for part in ("<a ", '<a "x ', "<a 'x ", "<a x=\"'", "<!-", "</a "):
        page = "<p>text</p>" + part * (300_000 // len(part))
        start = time.perf_counter()
        list(site_style_tree.blocks(page))
        assert time.perf_counter() - start < 2, part
