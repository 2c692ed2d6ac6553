import random

from fieldspan.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li>Home</li></ul></nav><!-- ad --><div class="ad">Buy</div><header>Site</header>
<article><header><h1>Head &amp; more</h1></header><p><b>One<br>two  <i>th</i>ree<p>Four</p><div class="share-buttons">Share</div><aside>Side</aside><form>Mail</form>
<section id="comments"><p>Nice!</p></section><p>Five &lt;b&gt; &#233;</p></article><footer>&copy; me</footer>"""


def test_marked_pages():
    assert H.main_text(H.blocks(PAGE), None) == "Head & more\nOne two three\nFour\nFive <b> é"
    assert H.main_text(H.blocks(""), None) == ""
    assert H.main_text(H.blocks("<p>a < b<p>c"), None) == "a < b\nc"


def test_common_lines():
    assert H.common(list("abxcde"), list("abydze")) == {0, 1, 4, 5}
    assert H.common([], list("a")) == set()


def test_differencing_and_whole_table(spark):
    body = lambda *lines: "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"
    rows = [
        (1, "http://h.org/a/1", body("Menu", "First text about one", "Imprint")),
        (2, "http://h.org/a/2", body("Menu", "Second text about two", "Imprint")),
        (3, "http://h.org/b", body("Menu", "Other text", "Imprint")),
        (4, "http://x.org/", body("Alone", "Here")),
        (5, "http://c.org/1", body("Copied text", "in two places")),
        (6, "http://c.org/2", body("Copied text", "in two places")),
        (7, None, None),
        (8, "http://m.org/", PAGE),
        (8, "http://m.org/", PAGE),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((r.page_id, r.text, r.n_chars) for r in H.extracted(df).collect())
    texts = {p: t for p, t, _ in got}
    assert len(got) == 9 and all(n == len(t) for _, t, n in got)
    assert texts[4] == "Alone\nHere" and texts[5] == texts[6] == "Copied text\nin two places" and texts[7] == ""
    assert "text about" in texts[1] and "text about" in texts[2]
    assert H.extracted(df.where("page_id < 0")).count() == 0


def test_shared_lines_go():
    near = ["Menu", "Other", "Imprint"]
    assert H.main_text([("Menu", 0), ("A long text of its own", 0), ("Imprint", 0)], near) == "A long text of its own"


def test_long_pages_of_repeated_lines():
    random.seed(6)
    a, b = (random.choices([f"line {k}" for k in range(40)], k=2200) for _ in "ab")
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    found = sorted(H.common(a, b))
    rest = iter(b)
    assert len(found) == row[-1] and all(a[i] in rest for i in found)


def test_differencing_decides_unmarked_lines_beside_main_text():
    page = [("Menu", 0), ("Shared article", 1), ("A line of its own", 0), ("An advert", -1), ("Imprint", 0)]
    assert H.main_text(page, ["Menu", "Shared article", "Imprint"]) == "Shared article\nA line of its own"


def test_ranges_do_not_show(spark):
    body = lambda *lines: "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"
    page = lambda h, k: body(f"Menu {h} {k // 2}", f"A long enough text about {k} of {h}", f"Imprint {h} {(k + 1) // 2}")
    rows = [(100 * h + k, f"http://h{h}.org/{k:02}", page(h, k)) for h in range(12) for k in range(2 + h % 4)]
    rows += [(9000, None, page(50, 1)), (None, None, page(50, 2)), (None, "http://h3.org/00", page(3, 0)), (300, "http://h3.org/00", page(3, 0))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    width, got = spark.conf.get("spark.sql.shuffle.partitions"), {}
    try:
        for n in (1, 2, 7, 60):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got[n] = sorted(map(tuple, H.extracted(df).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert len(got[1]) == len(rows) and got[1] == got[2] == got[7] == got[60]
    texts = {p: t for p, _, t, _ in got[60]}
    assert texts[401] == "A long enough text about 1 of 4\nImprint 4 1" and texts[400] == "A long enough text about 0 of 4\nImprint 4 0"
