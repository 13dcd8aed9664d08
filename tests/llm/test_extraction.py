"""Extraction of main text: alignment against a plain table, pages of one host, markup broken in many ways."""

import html
import random
import re

import numpy as np

from skyledger.llm import extraction

SCHEMA = "page_id long, url string, html string, drop string, host int, kept int"


def longest(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_is_a_longest_subsequence():
    r = random.Random(7)
    for n in (0, 1, 2, 5, 30, 90):
        for kinds in (1, 2, 6, 40):
            a, b = ([r.randrange(kinds) for _ in range(r.randint(0, n))] for _ in range(2))
            found = extraction.common(np.array(a, np.int64), np.array(b, np.int64))
            assert found == sorted(set(found)) and len(found) == longest(a, b)
            at = 0
            for i in found:  # in b in the same order
                at = b.index(a[i], at) + 1


def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{body}</body></html>"


def extracted(spark, rows):
    df = spark.createDataFrame([(i, u, h, "d", 1, 2) for i, u, h in rows], SCHEMA).repartition(3)
    return {(r.page_id, r.url): r for r in extraction.extract(df).collect()}


def test_differencing_without_articles(spark):
    """Pages of plain divs: the lines of the frame go, whatever their markup; the page of the nearest path decides."""
    frame = lambda x, extra="": page(f"<div><div>Home | News</div><div>Sign of the Times</div></div><div>{x}</div>{extra}<div>All rights reserved</div>")
    rows = [(i, f"https://a.org/news/{i}?q={i}", frame(f"<p>Story {i} &amp; more</p><p>It  ends\n{i}.</p>")) for i in range(5)]
    rows.append((10, "https://a.org/shop/1", page("<div>Buy now</div><div>Thing 1</div>")))
    rows.append((11, "https://a.org/shop/2", page("<div>Buy now</div><div>Thing 2</div>")))
    rows.append((12, "https://b.org/news/1", frame("alone on its host")))
    got = extracted(spark, rows)
    for i in range(5):
        r = got[i, f"https://a.org/news/{i}?q={i}"]
        assert r.text == f"Story {i} & more\nIt ends {i}." and r.n_shared == 3 and r.n_chars == len(r.text)
    assert [got[i, f"https://a.org/shop/{i - 9}"].text for i in (10, 11)] == ["Thing 1", "Thing 2"]
    assert got[12, "https://b.org/news/1"].text == "Home | News\nSign of the Times\nalone on its host\nAll rights reserved"


def test_both_ways_to_meet_the_lines(spark):
    rows = [(i, f"https://a.org/{i}", page(f"<div>Home</div><div>Story {i}</div>")) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, other = ({tuple(r) for r in extraction.extract(df, broadcast_bytes=n).collect()} for n in (0, 1 << 20))
    assert one == other and {r[2] for r in one} == {f"Story {i}" for i in range(6)}


def test_copies_are_no_boilerplate(spark):
    """Copies of a page on its host, and an article's lines that other pages repeat, stay."""
    same = page("<div>Menu</div><div>One long story that is told on two pages of a host, word for word.</div><div>And its end.</div>")
    rows = [(1, "http://h/a/1", same), (2, "http://h/a/2", same), (3, "http://h/a/3", same)]
    rows += [(i, f"http://g/{i}", page(f"<nav>Menu</nav><article><h1>Told twice</h1><p>The same words.</p></article><footer>{i}</footer>")) for i in (4, 5)]
    got = extracted(spark, rows)
    assert got[2, "http://h/a/2"].text.endswith("word for word.\nAnd its end.")
    assert got[4, "http://g/4"].text == got[5, "http://g/5"].text == "Told twice\nThe same words."


def test_markup(spark):
    cases = {
        "<article><p>a&nbsp;&lt;b&gt; &#233;&#x1F600; &copy &unknown;<br>c</p> tail <p><b>open<p>next</article>x": "a <b> é😀 © &unknown; c\ntail\nopen\nnext",
        "<nav>m</nav><header>h</header><main><header>title</header><div class='sidebar'>s</div>text<aside>n</aside></main><footer>f</footer>": "title\ntext",
        "<article><header><h1>Head</h1></header>body<div id=comments><article>reader</article></div><form>f<p>g</form><div class='adBox ad'>buy</div></article>": "Head\nbody",
        "<div class='page with-sidebar'><article>kept</article></div><div class='cookie-notice'>no</div>": "kept",
        "<article>1 < 2 and 3 > 2 <a title=don't href='x>y'>it's</a> <!-- <p>no --> ok<script>if (a</script >b": "1 < 2 and 3 > 2 it's okb",
        "<article><ul><li class=ad>ad<li>one<li>two</ul><table><tr><td>x<td>y</table></article>": "one\ntwo\nx\ny",
        "<article><p class='advert'>ad<div>kept</div><p hidden>no</p><p>yes</p></article><p": "kept\nyes",
        "plain text only": "plain text only",
        "<article class='post comments-open'>&am<i>p; &amp;lt;</i><article class='comment'>reader</article><div class='post-comments'>more</div></article>": "&amp; &lt;",
        "<article></article><style>x": "",
        "": "",
    }
    got = extracted(spark, [(i, f"http://{i}/", h) for i, h in enumerate(cases)])
    assert [got[i, f"http://{i}/"].text for i in range(len(cases))] == list(cases.values())


def test_nulls_repeats_and_none(spark):
    art = page("<article>x</article>")
    got = extraction.extract(spark.createDataFrame([(None, None, None), (1, "u", art), (1, "u", art), (2, "u", None), (3, None, art)], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "x", 1), (1, "x", 1), (2, "", 0), (3, "x", 1)]
    assert extraction.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_page():
    lines = extraction.lines_of("<article>" + "<p>word " * 100_000 + "<b" * 10_000)
    assert len(lines) == 100_000 and extraction.lines_of("<a b='" * 20_000 + ">") == []


def test_all_articles(spark):
    """The articles of the pages of a whole table, cut out by their tags."""
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = extraction.op11_nearest_url_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
