from pyspark.sql import functions as F

from tidewater.functions import html, text, urls


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("v")).first()["v"]


def test_title_is_composed_and_freed_of_space(spark):
    assert one(spark, text.normalize_title(F.col("t")), t=" Ａｂ　c Ｄ ") == "abcd"
    assert one(spark, text.normalize_title(F.col("t")), t=None) == ""


def test_canonical_url(spark):
    a = "https://example.com/a?utm_source=x"
    assert urls.canonical(a) == urls.canonical("https://EXAMPLE.com:443/a?utm_source=y#top") == "https://example.com/a"
    assert urls.canonical("http://u:p@Host:8080//a//b?b=2&a=&SPM=1&a=1") == "http://host:8080/a/b?a=&a=1&b=2"
    assert urls.canonical("") == urls.canonical(None) == ""
    assert urls.canonical("http://h/?q=%20~*") == "http://h/?q=+~%2A"
    assert one(spark, urls.canonical_url_native(F.col("u")), u="HTTP://H.com:80//x?from=a&z=1&b=2#f") == "http://h.com/x?b=2&z=1"


def test_dates(spark):
    assert one(spark, text.strict_date(F.col("d")), d="2026-7-1") is None
    assert str(one(spark, text.strict_date(F.col("d")), d="2026/07/01")) == "2026-07-01"
    assert one(spark, text.lenient_date(F.col("d")), d="2026/7/1") == "2026-07-01"
    assert one(spark, text.lenient_date(F.col("d")), d="2026-02-30") == ""
    assert one(spark, text.find_date(F.col("d")), d="于2026年7月1日发布") == "2026-7-1"
    assert one(spark, text.epoch_date(F.col("d")), d="timeConvert('1767225600')") == "2026-01-01"


def test_deadline(spark):
    value = text.infer_deadline(F.col("d"), F.lit(2026))
    assert one(spark, value, d="2026年8月24日9:00开通，9月23日17:00关闭") == "2026-09-23"
    assert one(spark, value, d="2025/12/31 至 2026/2/29") == "2025-12-31"
    assert one(spark, value, d="即日起") == ""


def test_years_dont_continue_numbers(spark):
    assert one(spark, text.years_in(F.col("t")), t="12026 2025年 2027年度") == [2025, 2027]


def test_domain_rules(spark):
    wide, strict = urls.domain_allowed_wide, urls.domain_allowed_strict
    assert one(spark, wide(F.col("h"), F.lit("x.gd.gov.cn"), []), h="a.gov.cn")
    assert not one(spark, strict(F.col("h"), F.lit("x.gd.gov.cn"), []), h="a.gov.cn")
    assert one(spark, strict(F.col("h"), F.lit("a.org"), ["b.org"]), h="c.b.org")


def test_readable_drops_navigation_and_scripts():
    body = "<html><body><nav>menu</nav><article><script>x()</script><p>" + "正文" * 20 + "</p></article></body></html>"
    assert html.readable(body) == "正文" * 20
    assert html.readable('<nav>n</nav><div class="contentDetail">' + "内容" * 20 + "</div>") == "内容" * 20
    assert html.readable("<body><p>short</p></body>") == "short"
    assert html.readable(None) == ""


def test_links_and_next_page():
    page = '<div id="Footer"><a href="/f">footer link</a></div><ul><li>2026-7-1 <a href="/a"><h3>head</h3>title text</a></li></ul><a class="page-NEXT" href="?p=3">go</a>'
    found = html.links(page)
    assert [(x["title"], x["heading"], x["date"], x["nav_wide"], x["nav_narrow"]) for x in found][:2] == [("footer link", "footer link", "", True, False), ("headtitle text", "head", "2026-7-1", False, False)]
    assert html.next_page(page, "http://x/l?p=2") == "http://x/l?p=3"
    assert html.next_page('<a href="javascript:go()">下一页</a><a href="/2">下页</a>', "http://x/") == "http://x/2"
    assert html.next_page("<a href='/1'>back</a>", "http://x/") is None


def test_search_results():
    box = '<div class="txt-box"><h3><a href="/link">标题</a></h3><p class="txt-info">摘要</p><span class="all-time-y2">某号</span><span class="s2"><script>document.write(timeConvert(\'1767225600\'))</script></span></div>'
    found = html.search_results(box + '<div class="txt-box"><p>none</p></div>')
    assert len(found) == 1 and found[0]["account"] == "某号" and "1767225600" in found[0]["time_text"]


def test_page_url(spark):
    url = urls.page_url(F.lit("p{n}"), F.col("n").cast("int"), F.col("first"), F.lit(1), F.lit(2))
    assert [one(spark, url, n=n, first="f") for n in "123"] == ["f", "p1", "p3"]
    assert [one(spark, url, n=n, first="") for n in "12"] == ["p1", "p3"]


def test_links_of_a_crowded_parent_take_linear_time():
    import time

    from tidewater.functions import html

    def page(n):
        return "<div class='list'>" + "".join(f"<li><a href='/{i}'>title {i}</a></li><a href='/x{i}'>no date</a>" for i in range(n)) + "on 2026-07-01</div><div id='Footer'><a href='/f'>2025年1月2日</a></div>"

    found = html.links(page(50))
    assert len(found) == 101 and found[1]["date"] == "2026-07-01" and found[0]["date"] == "" and found[-1]["date"] == "2025-1-2"
    took = []
    for n in (1500, 6000):
        began = time.process_time()
        assert len(html.links(page(n))) == 2 * n + 1
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.02)  # four times the links


def test_dates_of_links_are_those_of_their_texts():
    """The positions worked out once for a page give what a search of each text gives."""
    import random

    from tidewater.functions import html

    rnd = random.Random(3)
    bits = ["2026-07-01", "2026年7月", "1日", "20", "26-7-", "1", "<p>", "</p>", "<a href=x>", "</a>", "<div>", "</div>", "text ", "2026.1.2"]
    for _ in range(300):
        page = html.Page("".join(rnd.choice(bits) for _ in range(40)))
        for node in page.root.find(lambda n: True):
            m = html.DATE.search(node.text(strip=False))
            assert page.date_in(node) == (m.group() if m else "")



def test_names_without_a_semicolon_are_no_references():
    page = "<body><article><h1>Cut off &am</h1><p>terms &amp</p>&lt;b&gt; &copy2 &notit; &nosuch; &#38 &eacute; enough of a text</article><a href='/x?a=1&copy=2&amp;b=3'>a&lt</a></body>"
    assert html.readable(page) == "Cut off &am terms &amp <b> &copy2 &notit; &nosuch; & é enough of a text"
    (link,) = html.links(page)
    assert (link["href"], link["title"]) == ("/x?a=1&copy=2&b=3", "a&lt")


def test_pages_are_parsed_once_and_in_slices(spark, tmp_path, monkeypatch):
    """A filter on what a UDF gave doesn't run it again, and any number of pages is a few at a time."""
    import pyarrow as pa

    from tidewater.operators import filters

    spark.createDataFrame([(1, "http://h.com/", "<ul><li><a href='/x'>a long title</a></li></ul>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    for kind, selectors in (("wide", html.LIST_SELECTORS), ("narrow", None)):
        rows = filters.link_rows(pages.withColumn("links", html.links_column(selectors)("html")), kind, [])
        assert [(r.page_id, r.title, r.url) for r in rows.collect()] == [(1, "a long title", "http://h.com/x")]
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2  # one parses, one joins URLs
    seen = []
    monkeypatch.setattr(html, "SLICE", 10)
    got = html._by_slices(lambda h, n: seen.append(h) or f"{h}{n}", pa.string(), pa.array(["a" * 25, None, "b", ""]).slice(1), pa.array([1, 2, 3, 4]).slice(1))
    assert got.to_pylist() == ["None2", "b3", "4"] and html._by_slices(len, pa.int32(), pa.array([], pa.string())).to_pylist() == []
