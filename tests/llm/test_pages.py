"""Main text of web pages: the reader, tree matching, and templates found by aligning pages of one host."""

from __future__ import annotations

import html
import random
import re

import pytest

from dataproof.llm import common, page_tree, page_wrapper
from dataproof.llm.common import Words64


def read(page):
    return [block[3] for block in page_wrapper._read(page, Words64())[2]]


def plain_article(page):
    """The text of a page of the test tables, by expressions that know how they are made."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
    blocks = re.sub(r"</?(p|h1)>", "\x01", re.sub(r"</?b>", "", inside.replace("<br>", " "))).split("\x01")
    return "\n".join(x for x in (" ".join(html.unescape(block).split()) for block in blocks) if x)


def test_pages_of_the_tables(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {row.page_id: row for row in page_wrapper.extract(pages).collect()}
    assert len(found) == pages.count() > 0
    for row in pages.collect():
        assert found[row.page_id].text == plain_article(row.html)
        assert found[row.page_id].n_chars == len(found[row.page_id].text) and found[row.page_id].url == row.url


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("", []),
        ("plain  &amp; text", ["plain & text"]),
        ("a < b <", ["a < b <"]),
        ("<p>one<p>two<br>three</p>four", ["one", "two three", "four"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<p>x&nbsp;&nbsp;y\n z</p>", ["x y z"]),
        ("<p>in<b>li</b>ne <a href='/x>y'>link</a></p>", ["inline link"]),
        ("<script>if (a < b) '</p>'</script><p>x<!-- no --></p><style>p{}</style>", ["x"]),
        ("<p>kept<script>never closed <p>lost", ["kept"]),
        ("<article>x<nav>menu</nav><div class='comments'><p>reader</p></div></article><p>outside</p>", ["x"]),
        ("<main><p>x</p></main><p>outside</p>", ["x"]),
        ("<header><h1>Site</h1></header><article><header><h1>T</h1><p>by</p></header>y</article>", ["T", "y"]),
        ("<div class='sidebar-frame'><p>old</p><div><article><p>x</p></article></div></div>", ["x"]),
        ("<div id=cookieNotice>We use</div><form><p>mail</p></form><div role=navigation>go</div><p>x</p>", ["x"]),
        ("<p>x <button><div>press</div></button><span class=share>tell</span> y</p>", ["x y"]),
        ("<article class='no-sidebar'>x</article>", ["x"]),
        ("<section class='comment-list'><article>reader</article></section><p>x</p>", ["x"]),
        ("<p>x</p></div></article></p>y", ["x", "y"]),
        ("<div " * 3000 + ">x", ["x"]),
        ("<div>" * 3000 + "deep", ["deep"]),
        ('<a href="' * 3000, []),
    ],
)
def test_reader(page, texts):
    assert read(page) == texts


def test_children_of_one_shape_are_folded():
    short, long = ("<article><h1>t</h1>" + "<p>x</p><ul><li>y</li></ul>" * n + "</article>" for n in (1, 50))
    assert page_tree.fold(page_tree.read_page(short))[0] == page_tree.fold(page_tree.read_page(long))[0]


def tree(text):
    return page_tree.read_shape(text, 1)


def brute_match(a, b):
    """The most pairs of nodes of an order-preserving top-down mapping, by trying all of them."""
    if a.label != b.label:
        return 0

    def best(left, right):
        if not left or not right:
            return 0
        return max(best(left[1:], right), best(left, right[1:]), brute_match(left[0], right[0]) + best(left[1:], right[1:]))

    return 1 + best(a.children, b.children)


def random_tree(rng, depth=3):
    return rng.choice("abc") + "(" + " ".join(random_tree(rng, depth - 1) for _ in range(rng.randrange(4) if depth else 0)) + ")"


def test_matching_is_the_best_there_is():
    rng = random.Random(5)
    for _ in range(200):
        left, right = tree(f"r({random_tree(rng)} {random_tree(rng)})"), tree(f"r({random_tree(rng)} {random_tree(rng)})")
        assert page_tree.match(left, right)[0] == brute_match(left, right)


def test_partial_alignment_grows_the_seed():
    seed = tree("r(a(#) c(#))")
    page_tree.align_into(seed, tree("r(a(#) b(#) c(# d(#)))"))
    assert page_tree.write_shape(seed) == "r:2(a:2(#:2) b:1(#:1) c:2(#:2 d:1(#:1)))"
    again = page_tree.read_shape(page_tree.write_shape(seed), 0)
    assert page_tree.places(again, tree("r(b(#) c(d(#)))")) == [1, 3]
    page_tree.prune(seed, 2)
    assert page_tree.write_shape(seed) == "r:2(a:2(#:2) c:2(#:2))"


def words(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


def soup(rng, n, paragraphs=None):
    """A page without any telling name: constant lines, a rotating advert, a menu that varies, and text."""
    paragraphs = paragraphs or [words(rng, rng.randrange(8, 40)) for _ in range(rng.randrange(1, 6))]
    menu = "".join(f"<li><a href=/{x}>{x}</a></li>" for x in rng.sample(range(1000), 5))
    advert = f"<section><i>Buy number {n % 2} now</i></section>"
    page = f"<div><p>The Daily Site</p><ul>{menu}</ul></div>{advert}<div><h2>Title {words(rng, 4)}</h2>"
    page += "".join(f"<p>{p}</p>" for p in paragraphs) + "<p>Thank you for reading.</p></div><div><dl>All rights kept</dl></div>"
    title = re.search("<h2>(.*?)</h2>", page).group(1)
    return page, "\n".join([title, *paragraphs])


def test_templates_of_a_host(spark):
    rng = random.Random(3)
    made = [soup(rng, n) for n in range(40)]
    copies = soup(rng, 0)
    made += [copies] * 30  # copies of one page are one page
    rows = [(i, "http://Site.example/%d" % i, page, "x") for i, (page, _) in enumerate(made)]
    rows += [(100, "http://other.example/", made[0][0], "x"), (101, None, made[0][0], None), (102, "http://site.example/e", None, None)]
    rows += [(102, "http://site.example/e", "", None), (None, "no host", "<p>x</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumnRenamed("page_id", "host")
    found = page_wrapper.extract(df)
    assert found.columns == ["host", "url", "text", "n_chars"]
    texts = {row.host: row.text for row in found.collect()}
    assert found.count() == len(rows) and texts[102] == "" and texts[None] == "x"
    for i, (_, text) in enumerate(made):
        assert texts[i] == text
    # A lone page has no template to be aligned with; only its menu shows by itself.
    assert texts[100].startswith("The Daily Site\nBuy number 0 now\nTitle")
    assert page_wrapper.extract(df.where("false")).count() == 0


def test_article_that_many_pages_copy_is_kept(spark):
    rng = random.Random(4)
    shared = "".join(f"<p>{words(rng, 30)}</p>" for _ in range(6))
    rows = [(i, "http://h.example/", f"<article><h1>T {i}</h1>{shared}<p>{words(rng, 10)}</p></article>") for i in range(20)]
    rows += [(i, "http://g.example/", f"<article><h1>T {i}</h1><p>{words(rng, 60)}</p><p>Share this</p></article>") for i in range(20, 40)]
    found = {r.page_id: r.text for r in page_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(len(found[i].split("\n")) == 8 for i in range(20))
    assert all("Share this" not in found[i] and len(found[i].split("\n")) == 2 for i in range(20, 40))


def test_many_skeletons_are_aligned_in_levels(spark):
    """A node that more than half of the pages have stays in the seed, whatever group it is aligned in."""
    rng = random.Random(9)
    trees = set()
    while len(trees) < 300:
        odd = " ".join(f"s{rng.randrange(40)}(#)" for _ in range(rng.randrange(1, 4)))
        trees.add(f"html({odd}{' div(p(#))' if rng.random() < 0.7 else ''})")
    rows = [("h", x, rng.randrange(1, 4)) for x in sorted(trees)] + [("one", "html(p(#))", 5)]
    skeletons = spark.createDataFrame(rows, "host string, skeleton string, pages long")
    seeds = {r.host: r.seed for r in page_wrapper.host_seeds(skeletons).collect()}
    assert set(seeds) == {"h", "one"} and "div:" in seeds["h"]
    slots = page_wrapper.skeleton_slots(skeletons, page_wrapper.host_seeds(skeletons)).collect()
    last = {r.slots[-1] for r in slots if r.skeleton.endswith("div(p(#)))")}
    assert len(last) == 1 and -1 not in last
    assert all(len(r.slots) == r.skeleton.count("#") for r in slots)


def test_large_templates_are_joined_by_a_shuffle(spark, sf_dir, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "http://a.example/", soup(rng, i)[0]) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(map(tuple, page_wrapper.extract(df).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, page_wrapper.extract(df).collect())) == whole
