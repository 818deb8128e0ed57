"""Page text: the alignment against dynamic programming, whole results against known articles."""

import html
import random

import pytest

from nightwarden.llm import page_blocks, page_text, registry

SCHEMA = "page_id long, url string, html string, text string, host string, path string, lines string, part string, gone string, page1 string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("cells", [1 << 26, 30])
def test_common_is_a_longest_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(page_text, "CELLS", cells)
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randrange(rng.choice((2, 5, 30))) for _ in range(rng.randrange(40))] for _ in range(2))
        at = page_text.common(a, b)
        picked = [a[i] for i in at]
        rest = iter(b)
        assert at == sorted(set(at)) and all(v in rest for v in picked) and len(picked) == lcs(a, b)


def test_long_alignment_is_bounded():
    a = [i % 7 for i in range(20_000)]
    b = [i % 5 for i in range(20_000)]
    assert len(page_text.common(a, b)) >= 4000
    assert page_text.common(a, a) == list(range(20_000))


def text_of(page):
    return " ".join(b.text for b in page_blocks.blocks(page))


MARKUP = [
    ("<article><h1>T</h1><p>a<b>b</b> c<br>d<p>e &amp; f&nbsp;g &eacute;&#233;&copy</article>", "T ab c d e & f g éé©"),
    ("<nav>menu</nav><div class='side-bar sidebar'>s</div><p>text<script>var t='</p>';</script> more</p><footer>f</footer>", "text more"),
    ("<form><p>f</p></form><div id=comments><p>no</p></div><div class=cookieNotice>no</div><p>yes", "yes"),
    ("<div class='page has-sidebar'><p>stays</p></div><div hidden>x</div><div style='display: none'>y</div>", "stays"),
    ("<form action=x><nav>n<article><p>inside a form</p></article></form>", "inside a form"),
    ("<article><header><h1>Title</h1><p>by line</p></header><p>body</p><footer>foot</footer>"
     "<section class='reader-comments'><article><p>c</p></article></section></article>", "Title body"),
    ("<main><p>main</p></main><p>outside</p>", "main"),
    ("<p>one<p>two<ul><li>three<li>four</ul><table><tr><td>five<td>six</table>", "one two three four five six"),
    ("<p title='a > b' data-x=\"<p>\">quoted</p><!-- <p>c</p> --><![CDATA[x]]><p>it's", "quoted it's"),
    ("<p>1 < 2 and a<3 &lt;b&gt; &unknown; &amp;amp;</p>", "1 < 2 and a<3 <b> &unknown; &amp;"),
    ("<script>never closed <p>x", ""), ("", ""), ("  plain\n\ttext ", "plain text"), ("<div class=sidebar><p>all there is</p></div>", "all there is"),
    ("<div class='entry-content'><p>kept</p></div><div><p>loose</p></div>", "kept"), ("<p>cut <b", "cut"),
]


@pytest.mark.parametrize("page,text", MARKUP)
def test_markup(page, text):
    assert text_of(page) == text


def site(rng, hosts, n):
    """Pages from per-host templates without telling names, and their article texts."""
    rows, want = [], {}
    templates = {h: [f"{h} line {k} " + " ".join(rng.choice("abcdefgh") * 3 for _ in range(4)) for k in range(6)] for h in hosts}
    for i in range(n):
        host = hosts[0] if i % 3 == 0 else rng.choice(hosts)
        paragraphs = [f"p{i} {k} " + " ".join(str(rng.randrange(10 ** 6)) for _ in range(30)) for k in range(rng.randrange(1, 6))]
        top, bottom = templates[host][:3], templates[host][3:]
        page = "<div class=x>" + "".join(f"<div>{t}</div>" for t in top) + "</div><div class=y>" + \
            "".join(f"<p>{p}</p>" for p in paragraphs) + "</div><div class=z>" + "".join(f"<p>{t}</p>" for t in bottom) + "</div>"
        rows.append((i, f"https://{host}/en/{rng.randrange(10 ** 5)}{rng.choice(['', '?a=b', '#top', '/'])}", page))
        want[i] = " ".join(paragraphs)
    return rows, want


def extracted(spark, rows):
    df = spark.createDataFrame([(*r, *"thplpgd") for r in rows], SCHEMA)
    out = page_text.main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    return out.collect()


def test_templates_go_without_telling_names(spark):
    rows, want = site(random.Random(2), [f"h{k}.example" for k in range(8)], 300)
    results = []
    for parts in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted((r.page_id, r.text) for r in extracted(spark, rows)))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == sorted(want.items())


def test_copies_and_shared_passages_stay(spark):
    passage = "This licence passage recurs in very many articles of the host, word for word."
    article = "<h1>Head</h1>" + "".join(f"<p>paragraph {k} of the copied article with several words</p>" for k in range(5))
    menu = "<div>Start Sport Weather</div>"
    rows = [(i, f"http://a/{i}", f"{menu}<div class=q>{article}</div>") for i in range(30)]  # copies only
    rows += [(100 + i, f"http://b/{i:02}", f"<article><p>own words {i}</p><p>{passage}</p><div>Share this page</div></article>{menu}") for i in range(20)]
    got = {r.page_id: r.text for r in extracted(spark, rows)}
    for i in range(30):
        assert got[i].endswith("Head " + " ".join(f"paragraph {k} of the copied article with several words" for k in range(5)))
    assert all(got[100 + i] == f"own words {i} {passage}" for i in range(20))


def test_odd_rows(spark):
    long = "<article>" + "".join(f"<p>w{i} &amp; x</p>" for i in range(60_000)) + "</article>"
    rows = [(None, None, None), (1, None, "<p>a</p>"), (1, None, "<p>a</p>"), (2, "", ""), (3, "no scheme", "<p>a</p>"), (4, "http://x/1", long),
            (5, "http://x/2", long), (6, "HTTP://X/2?q", "<p>b</p>"), (7, "http://x/2", None), (8, "http://x", "<div>\x00é\U0001f600</div>")]
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extracted(spark, rows)))
    assert [g[0] for g in got] == [0, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert all(n == len(t) for _, _, t, n in got)
    texts = {g[0]: g[2] for g in got}
    assert texts[0] == texts[2] == texts[7] == "" and texts[1] == "a" and texts[8].endswith("é\U0001f600")
    assert texts[4] == texts[5] == " ".join(f"w{i} & x" for i in range(60_000))
    assert extracted(spark, []) == []


def test_whole_table(spark, sf_dir):
    """Every page of the table against the text between its article tags."""
    import re
    pages = {r.page_id: r for r in registry.table(spark, sf_dir, "pages").collect()}
    got = registry.QUERIES["op13_page_text"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br|li|ul|div)[^>]*>", "\n", inner))
        assert r.text == " ".join(html.unescape(inner).split()) and r.url == pages[r.page_id].url
