from __future__ import annotations

import base64
import gzip
import hashlib
import os
import re

import pytest
from tracelake.llm import html_extract, url_filter, warc

PAGES = "page_id long, url string, html string, host string, page string, text string"


@pytest.fixture(scope="module")
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, None, "p", "t") for r in rows], PAGES)


# --- WARC

ROWS = [(1, "http://a.org/é x", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://b.org", None), (4, "http://b.org", ""), (5, "u", "é" * 50_000), (None, "n", "<p>same</p>"), (6, "r", "twice"), (6, "r", "twice"), (7, "line\r\nbreak", "a\r\n\r\nb"), (None, "n", "alone"), (None, "m", "alone")]


def records(spark, pages, folder, rows, **how):
    uri = f"file://{folder}"
    manifest = warc.write_warc(pages(rows), uri, **how)
    return warc.read_warc(spark, uri, manifest, with_payload=True).collect(), manifest.collect()


def test_round_trip(spark, pages, tmp_path):
    got, files = records(spark, pages, tmp_path / "a", ROWS, roll_bytes=700, range_bytes=50_000)
    assert len(got) == len(ROWS) and all(r.intact for r in got)
    assert sum(f.records for f in files) == len(ROWS) and len(files) > 1
    top = {}
    for i, _, h in ROWS:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    plain = []
    for i, _, h in ROWS:
        b, best = (h or "").encode(), top[h or ""]
        first = best == -1 or i == best
        plain.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else best))
    assert sorted(map(repr, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(repr, plain))
    assert sorted(map(repr, ((r.page_id, r.url) for r in got))) == sorted(map(repr, ((i, u) for i, u, _ in ROWS)))
    text = {(i, h or "") for i, _, h in ROWS}
    assert all((r.page_id, r.payload.decode()) in text for r in got if r.record_type == "response")


def test_equal_input_gives_equal_bytes(spark, pages, tmp_path):
    for name, rows in (("x", ROWS), ("y", ROWS[::-1])):
        records(spark, pages, tmp_path / name, rows)
    one, two = ({f: (tmp_path / n / f).read_bytes() for f in os.listdir(tmp_path / n) if f.endswith(".gz")} for n in "xy")
    assert one == two and not [f for f in os.listdir(tmp_path / "x") if f.startswith(".tmp")]
    assert b"WARC/1.1\r\nWARC-Type: re" in gzip.decompress(b"".join(one.values()))


def test_equal_rows_give_equal_files_whatever_the_partitioning(spark, pages, tmp_path):
    rows = spark.range(40_000).selectExpr("if(id % 3 = 0, 7, id * id * 1000003) AS page_id", "concat('http://h.org/', id) AS url", "repeat(md5(cast(id as string)), 1 + cast(id % 9 as int)) AS html")
    made = {}
    for name, df in (("x", rows), ("y", rows.repartition(13, "url")), ("z", rows.orderBy("html"))):
        warc.write_warc(df, f"file://{tmp_path / name}", range_bytes=1 << 20)
        made[name] = {f: (tmp_path / name / f).read_bytes() for f in os.listdir(tmp_path / name) if f.endswith(".gz")}
    assert made["x"] == made["y"] == made["z"] and len(made["x"]) > 20
    assert max(map(len, made["x"].values())) < 4 * min(sorted(map(len, made["x"].values()))[2:])  # the hot id is dealt over ranges as well
    got = warc.read_warc(spark, f"file://{tmp_path / 'x'}")
    assert got.where("intact").count() == 40_000 and got.where("page_id = 7").count() == 13_334


@pytest.mark.parametrize("ids", [[-(2**63), 2**63 - 1, 0, 5], [3] * 50, [None, None], [2**62 + k for k in range(300)]])
def test_ranges(spark, ids):
    rows = spark.createDataFrame([(i, "ab", 1000) for i in ids], "page long, digest string, n long")
    ends, numbers, parts = warc.ranges_of(rows, 5000)
    assert list(ends) == sorted(ends) and list(numbers) == [sum(parts[:k]) for k in range(len(parts))]
    held = {}
    for i in ids:
        g = 0 if i is None else sum(e <= i for e in ends[1:].tolist())
        held[g] = held.get(g, 0) + 1700
    assert all(n <= 5000 * parts[g] for g, n in held.items())


def test_a_folder_with_files_is_refused_or_emptied(spark, pages, tmp_path):
    uri = f"file://{tmp_path / 'f'}"
    warc.write_warc(pages([(1, "http://a.org/%7e?q=a b", "old"), (2, "", "old")]), uri)
    with pytest.raises(FileExistsError):
        warc.write_warc(pages([(1, "u", "NEW text")]), uri)
    (tmp_path / "f" / ".tmp-left").write_text("x")
    warc.write_warc(pages([(1, "http://a.org/%7e?q=a b", "NEW text"), (2, "", "b"), (3, None, "c")]), uri, overwrite=True)
    got = sorted((r.page_id, r.url, bytes(r.payload)) for r in warc.read_warc(spark, uri, with_payload=True).collect())
    assert got == [(1, "http://a.org/%7e?q=a b", b"NEW text"), (2, "", b"b"), (3, None, b"c")]
    assert sorted(f for f in os.listdir(tmp_path / "f") if f[0] != "." and f[:5] != "part-") == ["_COMMITTED", "manifest.jsonl"] and not [f for f in os.listdir(tmp_path / "f") if f.startswith(".tmp")]


def test_small_payloads_and_empty_table(spark, pages, tmp_path):
    got, _ = records(spark, pages, tmp_path / "s", ROWS, min_bytes=12)
    assert {r.record_type for r in got} == {"response"}
    assert records(spark, pages, tmp_path / "e", [])[0] == []


def test_uncommitted_folder_is_refused(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        warc.read_warc(spark, f"file://{tmp_path}", spark.createDataFrame([], "file string"))


# --- URLs

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://example.org/en/2", "http://xexample.org/es/", "http://a.com/fr/x", "http://a.com/de/casino", "http://casino-win.net/a", "http://mycasino.net", "http://x.net/?phpsessid=1", "http://x.net/phpsessid", "//a://b.com/de/", "http://a.net/cheap-pills", "http://a.net/cheap-pillss", "http://org/x", "http://a.ORG?x=/", "http://free-bets.net#a", "http://a.net/\nadult"]


def plain_verdict(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    hit = next((v for v, p in url_filter.PATTERN_RULES if url is not None and re.search(p, url)), "allow")
    return host, path, None, hit


def test_urls(pages):
    rows = [(k, u, "h") for k, u in enumerate(URLS)] + [(None, URLS[5], "h"), (0, URLS[10], "h")]
    got = url_filter.judged(pages(rows)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *plain_verdict(u))) for i, u, _ in rows)
    assert url_filter.judged(pages([])).collect() == []


def test_long_rule_lists_are_joined(spark, pages):
    more = (("block", "b.org", "/xyz"), ("allow", "a.b.org", "/x"), ("block", "site7.net", ""), ("allow", "deep.site7.net", "/ok"), *[("block", f"h{k}.example.com", f"/{k % 7}") for k in range(3000)])
    rules = spark.createDataFrame([*url_filter.HOST_RULES, *more], "verdict string, host string, path string")
    urls = [*URLS, "http://a.b.org/xyz", "http://x.deep.site7.net/ok/1", "http://www.site7.net/", "http://h12.example.com/5/a", "http://h12.example.com/6", "http://" + "a." * 5000 + "site7.net/", "http://x.net/" + "y" * 300_000]
    rows = pages([(k, u, "h") for k, u in enumerate(urls)])
    got = url_filter.judged(rows, host_rules=rules)
    want = url_filter.judged(rows, host_rules=(*url_filter.HOST_RULES, *more[:4], *[r for r in more if r[1] == "h12.example.com"]))
    pick = ("page_id", "host", "path", "rule", "pattern", "verdict")
    assert sorted(map(repr, got.select(*pick).collect())) == sorted(map(repr, want.select(*pick).collect())) and len(got.columns) == len(want.columns)
    assert {r.page_id: r.rule for r in got.collect()}[len(URLS)] == "a.b.org/x"


def test_every_rule_is_filed_under_its_rarest_token():
    buckets = url_filter.pattern_index(url_filter.PATTERN_RULES)
    assert sorted(r[3] for b in buckets for r in b) == sorted(p for _, p in url_filter.PATTERN_RULES)
    assert url_filter.literal_tokens(r"(?i)\bfoo[a-z]*bar\b") == []
    assert url_filter.literal_tokens(r"/ab-cd?/") == ["ab"]
    with pytest.raises(ValueError):
        url_filter.pattern_index((("block", "a+"),))


# --- HTML

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>x</article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><nav><a href=1>Home</a></nav></header><div class="cookie-notice">We use cookies</div><div id=wrap><aside>Side</aside>
<article><header><h1>Head &amp; tail</h1><p>By me</p></header><p>One <b>two<br>three</b>&nbsp;four<!-- no --> five<p>Un<i>closed</i> <span class="ad">Buy!</span> end
<ul><li>first<li>second &lt;p&gt;</ul><form><input value=x><p>Mail?</p></form><div class="share-buttons">Tweet</div><table><tr><td>a<td>b</table>
<section id="comments"><p>Nice post</p></section><footer>by</footer></article></div><footer>&copy; x</footer></body></html>"""


def test_article():
    assert html_extract.main_text(ARTICLE).split("\n") == ["Head & tail", "One two three four five", "Unclosed end", "first", "second <p>", "a", "b"]


def test_template_finds_the_slots_of_pages_without_an_article(pages):
    rows = [(k, f"http://h.org/{k}", f"<body><div><p>Welcome to our site</p><p>All the news</p></div><div><p>story {k} tells {k * 7}</p><p>and more {k}</p></div><div><p>Imprint and so on</p></div></body>") for k in range(8)]
    rows += [(20, "http://one.org/", "<body><p>lonely page</p></body>"), (21, None, "<p>x</p>"), (22, "http://h.org/n", None), (23, "http://h.org/e", ""), (24, None, "plain text & <unclosed"), (None, "http://h.org/0", rows[0][2])]
    got = {(r.page_id, r.url): r for r in html_extract.extracted(pages(rows)).collect()}
    assert len(got) == len(rows)
    for k in range(8):
        assert got[k, f"http://h.org/{k}"].text == f"story {k} tells {k * 7}\nand more {k}"
    assert got[20, "http://one.org/"].text == "lonely page" and got[22, "http://h.org/n"].text == "" and got[23, "http://h.org/e"].n_chars == 0
    assert got[None, "http://h.org/0"].text == got[0, "http://h.org/0"].text
    assert html_extract.extracted(pages([])).collect() == []


def test_template_comes_before_marked_regions(pages):
    menu = "<nav><p>Home</p></nav>"
    notice = "<p>Read our other stories every day</p><p>Letters to the desk are welcome</p>"
    rows = [(k, f"http://a.org/{k}", f"<body>{menu}<article><p>story {k} tells {k * 7}</p>{notice}</article></body>") for k in range(8)]
    rows += [(100 + k, f"http://m.org/{k}", f"<body>{menu}<article><p>teaser {k}</p></article><main><p>the long body of page {k}</p><p>and its end {k * 3}</p></main></body>") for k in range(8)]
    rows += [(200 + k, f"http://d.org/{k}", f"<body>{menu}<article><p>card {k}</p></article><div><p>the long body of page {k}</p></div></body>") for k in range(8)]
    rows += [(300, "http://one.org/", f"<body>{menu}<article><p>only page of its host</p>{notice}</article></body>")]
    got = {r.page_id: r.text for r in html_extract.extracted(pages(rows)).collect()}
    for k in range(8):
        assert got[k] == f"story {k} tells {k * 7}"
        assert f"the long body of page {k}\nand its end {k * 3}" in got[100 + k]
        assert f"the long body of page {k}" in got[200 + k]
    assert got[300].split("\n") == ["only page of its host", "Read our other stories every day", "Letters to the desk are welcome"]


def plain_template(pages):
    """{tokens of valid classes} of one host's pages, all at once: vectors, order and nesting as the definitions say."""
    sequences = [html_extract.parse(p)[1] for p in dict.fromkeys(pages)]
    every = {t for s in sequences for t in s}
    by = {}
    for t in every:
        vector = tuple(s.count(t) for s in sequences)
        if sum(map(bool, vector)) >= max(3, len(sequences) / 2):
            by.setdefault(vector, []).append(t)
    good = set()
    for vector, tokens in by.items():
        if len(tokens) < 3:
            continue
        runs = [[t for t in s if t in tokens] for s in sequences]
        if all(r == (r[: len(tokens)]) * (len(r) // len(tokens)) and len(set(r[: len(tokens)])) == min(len(r), len(tokens)) for r in runs) and len({tuple(r[: len(tokens)]) for r in runs if r}) == 1:
            good |= set(tokens)
    return good


def test_classes_against_plain_python(spark, pages):
    from tracelake.llm.shared import Scratch

    def page(k):
        rows = "".join(f"<tr><td>name</td><td>v{k}{j}</td><td>unit</td></tr>" for j in range(1 + k % 3))
        return f"<body><div><p>Welcome</p><p>News</p></div><table>{rows}</table><div id=x><p>story {k}</p></div><div class=q><p>Imprint</p></div></body>"

    html = [page(k) for k in range(7)]
    got = html_extract.templates(pages([(k, "http://h.org/", p) for k, p in enumerate(html)]).selectExpr("'h.org' AS host", "html"), Scratch(spark, "t")).collect()
    assert len(got) == 1 and len(got[0].classes) == 2  # the rows of the table nest in the page's class
    assert {t & (1 << 64) - 1 for c in got[0].classes for t in c.tokens} == plain_template(html)
    template = html_extract.Template.of([c.asDict() for c in got[0].classes])
    for k, p in enumerate(html):
        own = html_extract.slots(*html_extract.parse(p), template)
        assert [b.text for b in own] == [f"v{k}{j}" for j in range(1 + k % 3)] + [f"story {k}"]
        assert len({b.slot for b in own}) == 2  # one slot for a cell of the rows, one for the story


def test_order_and_nesting_of_classes():
    of = lambda *classes: html_extract.Template.of([{"class": k + 1, "tokens": list(c)} for k, c in enumerate(classes)])
    two = of((10, 11, 12), (20, 21))
    assert html_extract.check([10, 20, 21, 20, 21, 11, 12], two) == ({}, {1: (0, 0), 2: (1, 0)}, set())
    assert html_extract.check([10, 11, 20, 21, 12], two)[1][2] == (1, 1)
    assert html_extract.check([10, 12, 11], two)[0] == {1: {1}} or html_extract.check([10, 12, 11], two)[0] == {1: {2}}
    assert html_extract.check([10, 20, 11, 12, 21], two)[2] == {2}
    assert html_extract.check([20, 21, 10, 20, 21, 11, 12], two)[2] == {2}
    assert html_extract.out_of_order([0, 3, 1, 2, 4]) == [3] and html_extract.out_of_order([]) == []


def test_pages_of_nothing_but_template_and_odd_markup(pages):
    shell = "<body><div><p>Welcome to our site</p><p>All the news</p></div>{}<div><p>Imprint and so on</p></div></body>"
    rows = [(k, f"http://h.org/{k}", shell.format(f"<div><p>story {k}</p></div>")) for k in range(8)] + [(9, "http://h.org/9", shell.format(""))]
    got = {r.page_id: r.text for r in html_extract.extracted(pages(rows)).collect()}
    assert got == {k: f"story {k}" for k in range(8)} | {9: ""}
    assert html_extract.main_text("İ" * 30 + "<script>x</script><p>hello world and more text</p>") == "İ" * 30 + "\nhello world and more text"
    assert html_extract.main_text("<SCRIPT>a</Script ><p>b</p><style>never closed") == "b"
    assert html_extract.main_text("<b>" * 30_000 + "deep" + "</i>" * 30_000) == "deep"
    assert html_extract.main_text("<div>" * 30_000 + "deep" + "</div>" * 60_000 + "<p>" + "long " * 200_000).count("long") == 200_000


def test_copies_of_one_page_are_no_template(pages):
    page = "<body><p>a</p><p>b</p><p>c</p></body>"
    assert {r.text for r in html_extract.extracted(pages([(k, "http://c.org/", page) for k in range(9)])).collect()} == {"a\nb\nc"}


def test_whole_table(spark, sf):
    import html as h

    got = {r.page_id: r.text for r in html_extract.op7_template_extraction(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)
