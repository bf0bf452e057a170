"""Pages that are deep, wide, repeated or have constant blocks beside their article."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corrweave.llm import wrappers


def texts(spark, pages, parts=4):
    rows = [(i, f"http://h.org/{i}", html) for i, html in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(parts, "page_id")
    return {r.page_id: r.text for r in wrappers.main_text(df).collect()}


def words(i, n=30):
    return " ".join(f"w{i}x{k}" for k in range(n))


@pytest.mark.parametrize("depth", [40, 3000])
def test_deep_pages_keep_their_text(spark, depth):
    """An article below any depth, beside a shallower block in it."""
    pages = [f"<body><h1>Head {i}</h1><p>intro {words(i, 3)}</p>" + "<div>" * depth + f"<p>{words(i)}</p>" + "</div>" * depth + "</body>" for i in range(6)]
    got = texts(spark, pages)
    assert all(words(i) in got[i] for i in range(6))


def test_wide_pages_of_many_layouts(spark):
    """200 unlike siblings; a layout of its own for each page, so that optional children add up; a constant block at the end."""
    def page(i):
        return "<body><div class=main>" + "".join(f"<div class='k{chr(97 + k // 26)}{chr(97 + k % 26)}'><p>{words(f'{i}y{k}', 2)}</p></div>" for k in range(200) if (k + i) % 9) + "<section><p>Read it all again</p></section></div></body>"

    got = texts(spark, [page(i) for i in range(8)])
    for i in range(8):
        assert all(words(f"{i}y{k}", 2) in got[i] for k in range(200) if (k + i) % 9)
        assert "Read it all again" not in got[i]


def test_constant_blocks_in_varying_runs(spark):
    """A notice among paragraphs of the same sign goes, also where their number differs and over many partitions; a rare repeat stays."""
    def page(i):
        body = [f"<p>{words(f'{i}y{k}', 8)}</p>" for k in range(1 + i % 4)]
        body.insert(i % len(body), "<p>Subscribe to the letter.</p>")
        return f"<body><div class=main><h1>Story {i}</h1>{''.join(body)}{'<p>To be or not to be.</p>' if i < 4 else ''}<p>Always the same line.</p></div></body>"

    for parts in (1, 8):
        got = texts(spark, [page(i) for i in range(16)], parts)
        for i in range(16):
            assert got[i] == " ".join([f"Story {i}", *(words(f"{i}y{k}", 8) for k in range(1 + i % 4)), *(["To be or not to be."] if i < 4 else [])])


def test_copies_count_once_at_every_partitioning(spark):
    """Six copies of a page, the only one of its host with a heading and a list, in one task or in eight."""
    special = f"<body><div class=main><p>{words(0)}</p><h2>Only here</h2><ul><li>{words('li')}</li></ul></div></body>"
    pages = [special] * 6 + [f"<body><div class=main><p>{words(i)}</p></div></body>" for i in range(1, 5)]
    one, many = texts(spark, pages, 1), texts(spark, pages, 8)
    assert one == many
    assert all(many[i] == f"{words(0)} Only here {words('li')}" for i in range(6))


def nameless(html):
    """The page without a telling name: no structural tags, no classes."""
    html = re.sub(r"<(/?)(?:nav|article|footer|header|main|section|aside)\b[^>]*>", r"<\1div>", html)
    return re.sub(r"<(div|p|ul|li)\s[^>]*>", r"<\1>", html)


def alone(html):
    return wrappers.extract(html, None)


def test_variance_decides_where_names_tell_nothing(spark):
    """Real-looking pages of hosts with enough of them, all telling names taken away: the wrapper finds the text that names would."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host = wrappers._host(F.col("url"))
    often = pages.groupBy(host.alias("h")).agg(F.count_distinct("html").alias("n")).where("n between 12 and 40").orderBy("h").limit(12)
    pages = pages.join(often, host == F.col("h"), "left_semi").select("page_id", "url", "html")
    rows = {r.page_id: r.html for r in pages.collect()}
    plain = spark.createDataFrame([(r.page_id, r.url, nameless(r.html)) for r in pages.collect()], "page_id bigint, url string, html string")
    want = {i: alone(h) for i, h in rows.items()}
    with_names = {r.page_id: r.text for r in wrappers.main_text(pages).collect()}
    without = {r.page_id: r.text for r in wrappers.main_text(plain).collect()}
    assert len(rows) > 100
    assert with_names == want
    assert without == want
    assert sum(alone(nameless(h)) != want[i] for i, h in rows.items()) > 0.1 * len(rows)  # by the page alone these keep a menu or a notice


def test_synthetic_hosts_without_names(spark):
    """Menus that change with the section but are links, constant notices, a varying article in nested boxes."""
    def page(i):
        menu = "".join(f"<div><a href=/{i % 3}{k}>{words(f'm{i % 3}k{k}', 3)}</a></div>" for k in range(4))
        return f"<body><table><tr><td>{menu}</td></tr></table><div><div>Notice for all readers</div><div><h1>Title {i}</h1><p>{words(i, 40)}</p><p>{words(f'{i}b', 25)}</p></div></div><div>Legal line of the house</div></body>"

    got = texts(spark, [page(i) for i in range(12)])
    assert got == {i: f"Title {i} {words(i, 40)} {words(f'{i}b', 25)}" for i in range(12)}


def test_names_part_what_varies_alike(spark):
    """Comments that vary as the article does go by their name, whatever their share."""
    pages = [f"<body><div class=box><article><p>{words(i, 40)}</p></article><div class=comments><p>{words(f'{i}c', 30)}</p></div></div></body>" for i in range(6)]
    assert texts(spark, pages) == {i: words(i, 40) for i in range(6)}


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_hosts_hot_and_rare_get_their_wrapper(spark, monkeypatch, most):
    """By a broadcast or by a shuffle, the same."""
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", most)
    rows = [(i, "http://hot.org/" if i % 3 else f"http://h{i}.org/", f"<body><div><p>Constant</p></div><div class=x><p>{words(i)}</p></div></body>") for i in range(60)] + [(None, None, None), (60, "no url", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_text(df.withColumn("salt", F.lit(1)).withColumn("wrapper", F.lit("z")).withColumn("host", F.lit(0))).collect()}
    assert len(got) == 62 and got[None] == "" and got[60] == ""
    assert all(got[i] == words(i) for i in range(60) if i % 3)


def test_inline_text_stays_whatever_its_class(spark):
    """Only hidden inline elements and inline adverts go, each with all that it holds, up to its own end or its block's."""
    def page(i):
        return (
            f"<body><nav><a href=/>home</a></nav><div class=article><p>see <a class='more'>detail{i}</a> and <code class='search'>find{i}</code>, <span class=share><b>b{i}</b>old</span>.</p>"
            f"<p>w{i} <span class='ad'><span>x</span> BUY <b>NOW</b></span>tail{i}<i hidden>no<i>no</i>no</i>end</p><div>u{i}<span class=sponsored>never closed <em>x</em></div><p>last{i}</p></div></body>"
        )

    want = {i: f"see detail{i} and find{i}, b{i}old. w{i} tail{i}end u{i} last{i}" for i in range(8)}
    assert texts(spark, [page(i) for i in range(8)]) == want
    assert {i: alone(page(i)) for i in range(8)} == want


def plain_text(leaves, page, of):
    """Of blocks in page order, each (words, whether it varies): those that are not the same on all of four pages or more."""
    return " ".join(page[k] for k in range(len(leaves)) if len({p[k] for p in of}) > 1)


@pytest.mark.parametrize("seed", range(4))
def test_wrapper_by_plain_recount(spark, seed):
    """Nameless boxes of random nesting: what stays the same over a host's pages goes, all else stays, as a recount of blocks says."""
    r = random.Random(seed)
    tags = ["p", "h2", "div", "section", "ul"]

    def tree(depth):
        kids = [r.choice(tags) if depth == 0 or r.random() < 0.6 else tree(depth - 1) for _ in range(r.randint(2, 5))]
        return (r.choice(["div", "section"]), kids)

    def leaves(t):
        return [x for k in t[1] for x in (leaves(k) if isinstance(k, tuple) else [k])]

    while True:  # no box holds most of the text, so that the root is the outermost
        skeleton = tree(3)
        blocks = leaves(skeleton)
        if len(blocks) > 8 and all(len(leaves(k)) < 0.6 * len(blocks) for k in skeleton[1] if isinstance(k, tuple)):
            break
    varies = [r.random() < 0.7 for _ in blocks]
    pages = [[words(f"{seed}b{k}p{i}" if v else f"{seed}b{k}", 6) for k, v in enumerate(varies)] for i in range(6)]

    def html(t, said):
        return f"<{t[0]}>" + "".join(html(k, said) if isinstance(k, tuple) else f"<{k}>{f'<li>{next(said)}</li>' if k == 'ul' else next(said)}</{k}>" for k in t[1]) + f"</{t[0]}>"

    got = texts(spark, ["<body>" + html(skeleton, iter(p)) + "</body>" for p in pages])
    assert got == {i: plain_text(blocks, p, pages) for i, p in enumerate(pages)}


@pytest.mark.parametrize("page", ["<x>" * 100_000, "<div>" + "<span class=ad>" * 70_000, "<div>" * 40_000 + "<p>x" * 120_000, "<span class=ad>x</span></b>" * 40_000, "<h2>a</h2><p>b</p>" * 55_000, "<div class=a>x</div><div class=b>y</div>" * 26_000, "<" * 1_000_000, '<a "' * 250_000, "<script>" * 120_000, "<!--" * 250_000])
def test_a_megabyte_takes_seconds(page):
    """Nothing grows with the square of a page: neither parsing nor alignment with another page, nor the text."""
    began = time.perf_counter()
    a, b = wrappers.shape(wrappers.parse(page)), wrappers.shape(wrappers.parse("<table></table>" + page + "<p>more</p>"))
    wrappers.merge(a, b)
    wrapper = wrappers.Wrapper(a)
    wrappers.extract(page, wrapper)
    assert time.perf_counter() - began < 60


def test_copies_beyond_the_bound_of_a_broadcast(spark, monkeypatch):
    pages = [f"<body><div class=main><p>{words(i % 5)}</p><p>Always here</p></div></body>" for i in range(20)]
    want = texts(spark, pages)
    monkeypatch.setattr(wrappers, "BROADCAST_COPIES", 0)
    assert texts(spark, pages) == want == {i: words(i % 5) for i in range(20)}
