import html
import random
import re
from collections import Counter, defaultdict

import pytest

from tidewatch.llm import html_text as ht
from tidewatch.llm import queries

SCHEMA = "page_id bigint, url string, html string, text string, host string, paths int"
WORDS = "river stone Grün été 中文 lamp &amp; &lt;b&gt; caf&eacute; &#x1F642; a&nbsp;b winter ‘quoted’ 5 &lt; 6 end.".split(" ")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def noise(rng, inside=False):
    """Parts that never belong to the text; an article's own header would keep its headings."""
    foreign = sentence(rng, 12)
    return rng.choice(
        [
            f"<nav><ul><li><a href='/x'>{foreign}</a></li></ul></nav>",
            f"<header>{'' if inside else '<h1>Site</h1>'}<p>{foreign}</header>",
            f"<div class='site-header'><p>{foreign}</p></div>",
            f"<div id=sidebar><p>{foreign}</p><ul><li>{foreign}</ul></div>",
            f"<aside><p>{foreign}</aside>",
            f"<div class='cookie-notice'>{foreign}</div>",
            f'<div class="ad">{foreign}</div><!-- {foreign} <p> -->',
            f"<form action='/s'><p>{foreign}</p><input name=q value='>'><button>Go</button></form>",
            f"<script>var t='</p><p>{foreign}';if(a<b)x()</script>",
            "<style>p{margin:0}</style><noscript><p>Turn it on</p></noscript>",
            f"<section class='comments'><div class=comment><p>{foreign} {foreign} {foreign}</p></div></section>",
            f"<div style='display: none'><p>{foreign}</p></div><p hidden>{foreign}</p>",
            f"<footer><p>&copy; {foreign}</footer>",
            f"<div role=alert><p>{foreign}</p></div>",
            f"<iframe src=x><p>{foreign}</iframe><select><option>{foreign}</select>",
        ]
    )


def blocks(rng, n):
    """Markup of an article's blocks, and their text."""
    marked, plain = [], []
    for _ in range(n):
        text = sentence(rng, rng.randrange(8, 40))
        kind = rng.randrange(6)
        first, rest = text[: len(text) // 2].rsplit(" ", 1)[0], text[len(text[: len(text) // 2].rsplit(" ", 1)[0]) :]
        marked.append(
            [
                f"<p>{text}</p>\n",
                f"<p>{text}",
                f"<p class=x>{first}<br/>{rest}</p>",
                f"<ul><li>{first}<li>{rest}</li></ul>",
                f"<blockquote><p><b>{first}</b>{rest}</blockquote>",
                f"<h2>{first}</h2><p>{rest}",
            ][kind]
        )
        plain.append(text)
    return "".join(marked), " ".join(plain)


def page(rng, template, n=None):
    title = sentence(rng, 5)
    marked, plain = blocks(rng, n or rng.randrange(4, 9))
    inner = [
        lambda: f"<article><h1>{title}</h1>{noise(rng, inside=True)}{marked}</article>",
        lambda: f"<div id='content' class='post-{rng.randrange(999)}'><h1>{title}</h1><div class=entry>{marked}</div></div>",
        lambda: f"<table><tr><td class=menu><a href=x>{title}</a><td class=text><h1>{title}</h1>{marked}</td></tr></table>",
        lambda: f"<main><h1>{title}</h1><section>{marked}</section></main>",
        lambda: f"<div class=wrap><div class='article-header'><h1>{title}</h1><span>By me</span></div>"
        f"<div class='article-body'>{marked}</div></div>",
        lambda: f"<form id=aspnet method=post><div class=page><h1>{title}</h1><p>{sentence(rng, 60)}</p>{marked}</div></form>",
        lambda: f"<div class='has-sidebar layout'><article class='post sidebar-left'><header><h1>{title}</h1><p>Tom</p></header>"
        f"{marked}</article></div>",
    ][template]()
    if template == 5:
        plain = html.unescape(re.search(r"<p>(.*?)</p>", inner)[1]) + " " + plain
    before, after = ("".join(noise(rng) for _ in range(rng.randrange(4))) for _ in range(2))
    cut = rng.choice(["</body></html>", "", "</body></html><a href='"])
    whole = f"<!DOCTYPE html><html><head><title>{title}</title><meta charset=utf-8></head><body class='x{rng.random()}'>{before}{inner}{after}{cut}"
    return whole, " ".join(html.unescape(f"{title} {plain}").split())


@pytest.mark.parametrize("template", range(7))
def test_text_of_made_pages(template):
    rng = random.Random(template)
    for _ in range(60):
        whole, text = page(rng, template)
        assert ht.main_text(whole, []) == text


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op11_html_text(spark, sf).collect()
    given = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(found) == len(given)
    for r in found:
        inner = given[r.page_id].html.split("<article>")[1].split("</article>")[0]
        text = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
        assert (r.url, r.text, r.n_chars) == (given[r.page_id].url, text, len(text))


def test_consensus_by_plain_python(spark, tmp_path):
    """Votes, winners and texts of mixed hosts equal the rule spelled out; one host has a third of the rows."""
    rng = random.Random(8)
    rows = []
    for k in range(240):
        host = "http://Big.example/" if k % 3 == 0 else f"https://u:p@h{k % 7}.example:80/a"
        template = 1 if k % 3 == 0 and k % 30 else rng.randrange(7)
        rows.append((k, host + "?q=1", page(rng, template)[0], "t", "h", 1))
    rows += [rows[3], rows[3]]
    rows += [(300, None, "<p>alone", "t", "h", 1), (301, "no url", None, "t", "h", 1), (302, "http://e/", "", "t", "h", 1)]
    rows += [(None, "http://e/", "plain &lt; text < 3", "t", "h", 1), (303, "http://e/", "<div>" * 20_000 + "deep", "t", "h", 1)]
    rows += [(304, "http://e/", "<p>" + "long word " * 200_000, "t", "h", 1)]
    votes = defaultdict(Counter)
    scores = defaultdict(Counter)

    def host_of(url):
        m = re.match(r"[a-z]+://(?:[^/@]*@)?([^/:?#]*)", (url or "").lower())
        return m[1] if m else ""

    for _, url, text, *_ in rows:
        p = ht.Page(text or "")
        best = p.best()
        if best:
            votes[host_of(url)][p.path(best[0])] += 1
            scores[host_of(url)][p.path(best[0])] += round(best[1])
    expect = Counter()
    for i, url, text, *_ in rows:
        h = host_of(url)
        ranked = sorted(votes[h], key=lambda path: (votes[h][path], scores[h][path], path), reverse=True)
        wins = [path for path in ranked if votes[h][path] * 4 >= sum(votes[h].values())] or ranked[:1]
        expect[i, url, ht.main_text(text, wins)] += 1
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.op11_html_text(spark, str(tmp_path)).collect()
    assert Counter((r.page_id, r.url, r.text) for r in found) == expect
    assert all(r.n_chars == len(r.text) for r in found)
    joined = ht.extract(spark.read.parquet(f"{tmp_path}/pages.parquet"), limit=0).collect()
    assert Counter(map(tuple, joined)) == expect
    texts = {r.page_id: r.text for r in found}
    assert (texts[300], texts[301], texts[302], texts[None]) == ("alone", "", "", "plain < text < 3")
    assert texts[303] == "deep" and len(texts[304]) == 200_000 * 10 - 1


def test_consensus_mends_pages_that_judge_wrongly(spark):
    """A page whose longest part is elsewhere still gives the part that the host's other pages chose."""
    good = "<div class='story s{0}'><h1>t {0}</h1><p>one two three four five six seven {0}</p></div><div class=extra><p>x {0}</p></div>"
    odd = "<div class='story s9'><p>short text</p></div><div class=extra><p>" + "many other words " * 9 + "</p></div>"
    rows = [(k, "http://a/", good.format(k), "", "", 1) for k in range(9)] + [(9, "http://a/", odd, "", "", 1)]
    rows += [(10, "http://b/", odd, "", "", 1)]
    found = {r.page_id: r.text for r in ht.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[9] == "short text" and found[0] == "t 0 one two three four five six seven 0"
    assert found[10] == ("many other words " * 9).strip()


def test_empty_table(spark):
    assert ht.extract(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize(
    "marked, text",
    [
        ("a<b>b</b>c <i>d</i>", "abc d"),
        ("<p>a<p>b", "a b"),
        ("a<br>b", "a b"),
        ("<p title='>'>a</p>", "a"),
        ('<p title=">a</p><p>b', "a b"),
        ("a <!-- b --!> c <!--> d <!bogus e> f <?g?> h </> i </3> j", "a c d f h i j"),
        ("<textarea><p>x</textarea><title>y</title>a&#65;&nbsp;&notit;", "aA ¬it;"),
        ("<td>a</td><td>b</td><tr><td>c", "a b c"),
        ("1 < 2 <3 & 4", "1 < 2 <3 & 4"),
        ("a<script>x</scripty></script>b", "ab"),
        ("a<span class=ad>x<span>y</span>z</span>b", "ab"),
        ("<P>A</P><SCRIPT>no</SCRIPT>", "A"),
    ],
)
def test_markup(marked, text):
    assert ht.main_text(marked, []) == text
