import re
from collections import Counter

from pointloom.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">A</a></li><li>B</li></ul></nav><!-- ad --><div class="ad">Buy {n}</div>
<article><h1>Title&amp;{n}</h1><p><b>First&nbsp;one   two<br>three<p>Second <i>in</i>line &lt;tag&gt; {n}</p>
<div class="comments"><p>I liked it</p></div><form><p>Send</p></form><ul><li>x<li>y</ul></article>
<aside>Side {n}</aside><footer>&copy; foot</footer>"""


def text(page):
    return html.main_text(html.parse(page))


def test_article():
    assert text(PAGE.format(n=7)) == "Title&7\n\nFirst one two three\n\nSecond inline <tag> 7\n\nx\n\ny"


def test_lenient():
    assert text("plain <b>bold</b> text") == "plain bold text"
    assert text("<p>a<p>b</div></p>c") == "a\n\nb\n\nc"
    assert text("<div title='x > y'>in</div> 1 < 2") == "in\n\n1 < 2"
    assert text("<script>never closed <p>x") == "" == text("") == text("<!-- open")
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n\n2\n\n3"
    assert text("<div>" * 5000 + "deep" + "</div>" * 100) == "deep"
    assert text("<a href=\"x" * 2000) is not None
    assert text("<body class='menu open'><p>kept</p><div id='cookie-notice'>no</div></body>") == "kept"


def brute(x, y):
    """Simple tree matching by its plain recursion."""
    if x.tag != y.tag:
        return 0

    def lists(a, b):
        if not a or not b:
            return 0
        return max(lists(a[1:], b), lists(a, b[1:]), lists(a[1:], b[1:]) + brute(a[0], b[0]))

    return 1 + lists(x.children, y.children)


def test_matching_is_the_largest():
    pages = ["<div><p>1</p><ul><li>a</li><li>b</li></ul><b>x</b></div>", "<div><b>x</b><p>1</p><p>2</p><ul><li>a</li></ul></div>", "<ul><li>a</li></ul>", "<div><ul><li><b>1</b></li><li>2</li><li><b>3</b></li></ul></div>", ""]
    for a in pages:
        for b in pages:
            x, y = html.parse(a), html.parse(b)
            pairs = html.align(x, y)
            assert len(pairs) == brute(x[0], y[0])
            assert len(set(pairs.values())) == len(pairs)
            assert all(x[i].tag == y[j].tag for i, j in pairs.items())


def test_induction(spark):
    """Without marks, what a host repeats is template and what varies is content."""
    plain = "<div><div>My Shop Home About</div><div><p>Story number {n} is here</p><p>More {n}</p></div><div>All rights reserved</div></div>"
    rows = [(i, f"http://shop.example/{i}", plain.format(n=i)) for i in range(8)]
    rows += [(20 + i, f"https://Mag.example:80/{i}", PAGE.format(n=i % 2)) for i in range(6)]  # copies: marks overrule
    rows += [(40, None, plain.format(n=1)), (41, "http://shop.example/x", None), (42, "nonsense", ""), (0, rows[0][1], rows[0][2]), (None, "http://one.example", "<p>solo</p>")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, ref string").repartition(3)
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert all(got[i].text == f"Story number {i} is here\n\nMore {i}" for i in range(8))
    assert got[20].text.startswith("Title&0\n\nFirst") and got[20].n_chars == len(got[20].text)
    assert got[40].text.startswith("My Shop") and got[41].text == got[42].text == "" and got[None].text == "solo"
    assert html.extract(df).count() == len(rows)
    assert html.extract(df.limit(0)).count() == 0


def bare(page):
    """A page whose author marks nothing: all structure is div, without classes."""
    page = re.sub(r"<(/?)(?:article|main|nav|aside|footer|header|section)\b[^>]*>", r"<\1div>", page)
    return re.sub(r" (?:class|id|role)=(?:\"[^\"]*\"|'[^']*')", "", page)


def test_wrappers_replace_marks(spark):
    """On the shared pages, the wrapper finds without any mark what the marks tell, where a host has enough pages."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    rows = table.collect()
    hosts = Counter(re.sub(r"https?://([^/]+).*", r"\1", r.url or "") for r in rows)
    want = {r.page_id: html.main_text(html.parse(r.html or "")) for r in rows}
    got = {r.page_id: r.text for r in html.extract(table).collect()}
    assert got == want
    stripped = spark.createDataFrame([(r.page_id, r.url, bare(r.html)) for r in rows if r.html], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html.extract(stripped).collect()}
    many = [r.page_id for r in rows if r.html and hosts[re.sub(r"https?://([^/]+).*", r"\1", r.url or "")] >= 5]
    right = sum(found[i] == want[i] for i in many) / len(many)
    without = sum(html.main_text(html.parse(bare(r.html))) == want[r.page_id] for r in rows if r.page_id in set(many)) / len(many)
    print("right with the wrapper", right, "without", without)
    assert right >= 0.8 and without <= 0.1


def test_constant_notice_within_articles(spark):
    page = "<body><article><h1>Story {n}</h1><div><p>Please keep our rules in mind.</p></div><p>{t}</p></article></body>"
    rows = [(i, f"http://a.example/{i}", page.format(n=i, t=f"text {i} " * 40)) for i in range(6)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Story {r.page_id}\n\n" + (f"text {r.page_id} " * 40).strip() for r in got)


def test_deep_pages_align():
    page = html.parse("<div>" * 3000 + "<p>deep</p><b>x</b>" + "</div>" * 3000)
    other = html.parse("<div>" * 3000 + "<p>deep</p><i>y</i>" + "</div>" * 3000)
    assert len(html.align(page, other)) == 3002


def test_nothing_is_dropped_but_code():
    assert text("<p>Area <math>x=2</math> <svg><text>s</text></svg><object>o</object> ends") == "Area x=2 so ends"
