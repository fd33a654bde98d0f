"""HTML extraction: blocks, differencing, pairing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import html_extract, queries

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">Cookies?</div>
<article><h1>Head &amp;amp; line</h1><p><b>First
 para&nbsp;graph<br>same block<p>Second &lt;b&gt; &copy; &am<script>var t="</p>";</script></p>
<aside>Related</aside><form><input>Search</form><ul><li>one<li>two</ul>tail
<div class="comments"><p>Reader says</p></div></article><footer>&copy; me</footer><!-- <p>gone</p> -->"""


def text_of(page):
    found = html_extract.blocks_of(page)
    return html_extract.main_text([b for b, _ in found], [s for _, s in found], None)


def test_blocks():
    assert text_of(PAGE) == "Head &amp; line\nFirst para graph same block\nSecond <b> © &am\none\ntwo\ntail"
    assert text_of(None) == text_of("") == text_of("<p> </p>") == ""
    assert text_of("plain <b>text</b>") == "plain text"
    assert text_of("<p>a<div>b</div>c") == "a\nb\nc"
    assert text_of("<p>a <script>x</script>b &amp<i>;</i></p>") == "a b &;"
    assert text_of("<nav>menu<article><p>x</p></article>") == "x"
    assert text_of("<p>1 < 2 & 3 > 2</p><p") == "1 < 2 & 3 > 2\n<p"
    assert text_of("<article><p>x</article></div></p>y<script>unclosed") == "x"
    assert text_of("<main><p>" + "w " * 300_000 + "</main>") == ("w " * 300_000).strip()
    assert text_of("<div>" * 30_000 + "deep") == "deep"


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        used = sorted(html_extract.shared_lines(a, b))
        assert len(used) == lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in used)


def test_rows_beyond_memory_are_made_again(monkeypatch):
    monkeypatch.setattr(html_extract, "_MOST_CELLS", 1)
    a, b = ["x", "m1", "m2", "y", "m3"], ["m1", "z", "m2", "m3", "w"]
    assert html_extract.shared_lines(a, b) == {1, 2, 4}


def test_huge_pages_are_aligned_like_small_ones(monkeypatch):
    rng = random.Random(4)
    pairs = [[[rng.choice("abcd") for _ in range(rng.randint(0, 60))] for _ in range(2)] for _ in range(200)]
    small = [html_extract.shared_lines(a, b) for a, b in pairs]
    for cells in (1, 70, 500):
        monkeypatch.setattr(html_extract, "_MOST_CELLS", cells)
        assert [html_extract.shared_lines(a, b) for a, b in pairs] == small
    assert all(len(used) == lcs(a, b) for used, (a, b) in zip(small, pairs))


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_template_lines_go_and_copies_stay(spark):
    body = lambda *own: "<body><div>Home</div><div>About us</div>" + "".join(
        f"<p>{x}</p>" for x in own) + "<div>Imprint</div></body>"
    long = ["a rather long line of the story number %d" % k for k in range(6)]
    rows = [(1, "http://h.example/en/10", body(*[x + " A" for x in long])),
            (2, "http://h.example/en/11?x", body(*[x + " B" for x in long])),
            (3, "http://h.example/de/99", body(*[x + " C" for x in long])),
            (4, "http://copy.example/a", body(*long)), (5, "http://copy.example/b", body(*long)),
            (6, "http://alone.example/a", body(*long)), (7, None, body("x")), (8, "no url", None),
            (None, "http://h.example/en/10", body(*[x + " A" for x in long])),
            (1, "http://h.example/en/10", body(*[x + " A" for x in long]))]
    got = html_extract.extract(pages(spark, rows).withColumn("text", F.lit(1)).withColumn("partner", F.lit(2)))
    assert got.columns == ["page_id", "url", "partner", "text"]
    texts = {}
    for r in got.collect():
        texts.setdefault(r["page_id"], set()).add(r["text"])
    for k, mark in ((1, "A"), (2, "B"), (3, "C")):
        assert texts[k] == {"\n".join(f"{x} {mark}" for x in long)}
    assert texts[4] == texts[5] == texts[6] == {"\n".join(["Home", "About us", *long, "Imprint"])}
    assert texts[8] == {""} and got.count() == len(rows)
    assert html_extract.extract(pages(spark, [])).count() == 0


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in html_extract.extract(pages(spark, rows)).collect()}


def lines_of(*lines):
    return "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"


def test_a_long_template_goes_from_short_pages_and_from_copies(spark):
    menu = ["a long line of the menu that every page has, number %d" % k for k in range(8)]
    story = ["a line of the story that was copied %d" % k for k in range(6)]
    rows = [(k, f"http://short.example/{k}", lines_of(*menu, f"brief {k}", "Imprint")) for k in range(4)]
    rows += [(10 + k, f"http://h.example/news/{k}", lines_of("Home", *story, f"only here {k}", "Imprint")) for k in range(6)]
    rows += [(20, "http://h.example/de/x", lines_of("Home", "something else that is long enough", "Imprint"))]
    got = extracted(spark, rows)
    assert [got[k] for k in range(4)] == [f"brief {k}" for k in range(4)]
    assert [got[10 + k] for k in range(6)] == ["\n".join([*story, f"only here {k}"]) for k in range(6)]
    assert got[20] == "something else that is long enough"


def test_unmarked_template_lines_inside_articles_go(spark):
    page = lambda *own: "<body><article><p>Share this story</p>" + "".join(
        f"<p>{x}</p>" for x in own) + "<p>Read more of us</p></article></body>"
    story = ["a line of the story that was copied %d" % k for k in range(6)]
    rows = [(k, f"http://h.example/en/{k}", page(f"the first of article {k} with words", f"the last of article {k}"))
            for k in range(4)]
    rows += [(10, "http://h.example/en/10", page(*story, "one")), (11, "http://h.example/en/11", page(*story, "two"))]
    rows += [(20 + k, f"http://copies.example/{k}", page(*story, f"only here {k}")) for k in range(5)]
    got = extracted(spark, rows)
    for k in range(4):
        assert got[k] == f"the first of article {k} with words\nthe last of article {k}"
    assert got[10] == "\n".join([*story, "one"]) and got[11] == "\n".join([*story, "two"])
    for k in range(5):  # most of an article is no template
        assert got[20 + k] == "\n".join(["Share this story", *story, f"only here {k}", "Read more of us"])


def test_the_next_prefix_is_asked_when_the_nearest_page_is_a_copy(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "LEAST_TEXTS", 99, raising=False)
    story = ["a line of the story that was copied %d" % k for k in range(6)]
    rows = [(k, f"http://h.example/news/{k}", lines_of("Home", *story, f"only here {k}")) for k in range(2)]
    rows += [(10 + k, f"http://h.example/{c}/1", lines_of("Home", f"a text about {c} " * 9)) for k, c in enumerate("abcdef")]
    got = extracted(spark, rows)
    assert [got[k] for k in range(2)] == ["\n".join([*story, f"only here {k}"]) for k in range(2)]


def test_nearest_shares_the_longest_path(spark):
    rows = [(1, "http://H.example/en/x/12", 1), (2, "https://h.example/en/x/13#t", 2),
            (3, "http://h.example/en/y", 3), (4, "http://h.example/de", 4), (5, "http://other.example/en/x/12", 5),
            (6, None, 6), (7, "http://h.example/en/x/12", 1)]
    got = dict(html_extract.nearest(spark.createDataFrame(rows, "pk long, url string, content long")).collect())
    assert got[1] == got[7] == 2 and got[2] in (1, 7) and got[3] in (1, 2, 7) and got[4] in (1, 2, 3, 7) and 5 not in got and 6 not in got


def test_every_page_of_the_table(spark):
    """The plain rule of the generated pages: the blocks of their article."""
    import html
    import re
    got = {r["page_id"]: r for r in queries.op10_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    for r in queries.read(spark, "/root/testdata/sf0.01", "pages").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<(?!/?(?:p|h1)>)[^>]*>", " ", x)).split())
                  for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


@pytest.mark.parametrize("rows, keys, salts", [(1, 10_000, 5), (2, 1, 64), (3, 2, 2)])
def test_any_pick_of_hot_keys_gives_the_same_texts(spark, monkeypatch, rows, keys, salts):
    rng = random.Random(11)
    menus = {h: [f"{h} menu {k}" for k in range(4)] for h in ("big", "small", "lone")}
    pages = []
    for k in range(120):
        host = "big" if k % 3 else rng.choice(list(menus))
        own = [f"story {k // 2 if k % 7 == 0 else k} line {n} {rng.randrange(3) if n % 5 == 0 else ''}"
               for n in range(rng.randrange(1, 9))]
        lines = menus[host][:2] + own + menus[host][2:]
        body = "".join(f"<p>{x}</p>" for x in lines)
        pages.append((k, f"http://{host}/d{k % 4}/{k}", f"<article>{body}</article>" if k % 10 == 0 else body))
    pages += [(200, None, "<p>a</p>"), (201, "http://big/d1/1", None), (202, "nothing", "<p>big menu 1</p>")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = sorted(map(tuple, html_extract.extract(table).collect()), key=str)
    assert sum("menu" in (r[2] or "") for r in want) < 40  # the templates went
    for name, value in (("HOT_ROWS", rows), ("HOT_KEYS", keys), ("SALTS", salts)):
        monkeypatch.setattr(html_extract, name, value)
    assert sorted(map(tuple, html_extract.extract(table).collect()), key=str) == want
