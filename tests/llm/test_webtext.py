"""Main text of pages by matching them against the wrapper of their host."""

import html
import json
import random
import re

import pytest

from conftest import rows
from quillwave.llm import webtext

SCHEMA = "page_id long, url string, html string, host string, blocks string"


def words(draw, n):
    return " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 8))) for _ in range(n))


def site(seed, names, n=24, article="div"):
    """Pages of one site and the text of their articles. ``names`` gives a class for each role."""
    draw = random.Random(seed)
    out = []
    for i in range(n):
        body = [words(draw, 4)] + [words(draw, draw.randint(30, 60)) for _ in range(draw.randint(2, 6))]
        related = "".join(f'<li><a href="/{k}">{words(draw, 3)}</a></li>' for k in range(draw.randint(3, 6)))
        ad = f'<div class="{names("ad")}">{words(draw, 5)}</div>' if draw.random() < 0.7 else ""
        talk = "".join(f'<div class="{names("remark")}"><b>{words(draw, 1)}</b> {words(draw, 9)}</div>' for _ in range(draw.randint(0, 3)))
        page = (
            f'<html><head><title>{body[0]}</title><body><div class="{names("top")}"><a href="/">Home</a> <a href="/n">News</a></div>{ad}'
            f'<{article} class="{names("story")}"><h1>{body[0]}</h1>' + "".join(f"<p>{p}<br>" for p in body[1:]) + f"</{article}>"
            f'<div class="{names("more")}"><ul>{related}</ul></div>'
            + (f'<div class="{names("comments")}">{talk}</div>' if talk else "")
            + f'<div class="{names("end")}">All rights kept by the owners of this site</div></body></html>'
        )
        out.append((i, f"http://site{seed}.example/{i}", page, "\n".join(body)))
    return out


def extracted(spark, pages):
    df = spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h, _ in pages], SCHEMA).repartition(3)
    return {r.page_id: r.text for r in webtext.main_text(df).collect()}


@pytest.mark.parametrize("article", ["article", "div"])
def test_article_is_found_whatever_the_classes_are(spark, article):
    draw = random.Random(8)
    renamed = {}
    plain = site(1, lambda role: role, article=article)
    random_names = site(1, lambda role: renamed.setdefault(role, words(draw, 1).replace("é", "e") + "x"), article=article)
    for pages in (plain, random_names):
        got = extracted(spark, pages)
        assert got == {i: text for i, _, _, text in pages}


def test_names_that_change_with_every_page(spark):
    draw = random.Random(9)
    pages = site(2, lambda role: f"{role[0]}{words(draw, 2).replace(' ', '').replace('é', 'e')}", n=60, article="article")
    assert extracted(spark, pages) == {i: text for i, _, _, text in pages}
    shapes = [webtext._packed(webtext.skeleton(webtext.parse(h))) for _, _, h, _ in pages]
    small = webtext._unpacked(webtext.aligned(shapes, most_nodes=60))
    assert webtext.size_of(small) <= 60


def test_given_pages_against_a_plain_reading(spark, small):
    """The pages of the table have one article each, up to its end tag or the footer."""
    table = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r.text for r in webtext.main_text(table).collect()}
    for r in table.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r.html, re.S).group(1)
        blocks = re.split(r"</?(?:p|h1|article|div|ul|li|footer)\b[^>]*>", inner)
        texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m.group().startswith("<br") else "", b)).split()) for b in blocks)
        assert got[r.page_id] == "\n".join(t for t in texts if t)


def test_each_text_is_matched_to_one_slot():
    draw = random.Random(5)
    for seed in range(30):
        pages = []
        for _ in range(8):
            parts = []
            for _ in range(draw.randint(0, 9)):
                tag = draw.choice(["p", "div", "ul", "section"])
                inner = "".join(f"<{draw.choice(['p', 'h2', 'li'])}>{draw.randint(0, 99)}" for _ in range(draw.randint(0, 4)))
                parts.append(f"<{tag}>{inner or draw.choice(['', 'x'])}</{tag}>")
            pages.append(webtext.parse("<body>" + "".join(parts)))
        wrapper = webtext._unpacked(webtext.aligned([webtext._packed(webtext.skeleton(p)) for p in pages]))
        pattern = webtext.Pattern(wrapper)
        for page in pages:
            every, stack = [], [page]
            while stack:
                node = stack.pop()
                stack.extend(reversed(node.children))
                if node.label == "#" and webtext.text_of(node):
                    every.append(webtext.text_of(node))
            assert [webtext.text_of(n) for _, n in pattern.match(page)] == every


def test_hard_pages(spark):
    deep = "<div>" * 10_000 + "deep" + "</div>" * 10_000 + "<p>after"
    cases = [
        (1, "http://a.example/1", deep, "deep\nafter"),
        (2, "http://b.example/1", "<p>one<svg-icon></svg-icon><p>two<button-bar><p>three", "one\ntwo\nthree"),
        (3, "http://c.example/1", "<html><head><title>t</title><meta x><body><p>text", "text"),
        (4, "http://d.example/1", None, ""),
        (5, None, "<p>no host</p>", "no host"),
        (6, "http://e.example/1", "<article>" + "<p>word " * 20_000, "\n".join(["word"] * 20_000)),
        (None, "http://f.example/1", "<p>a&nbsp;b&#x41;&lt;i&gt;<script>if (a<b) x</script><!-- c --><style>p{}", "a bA<i>"),
        (7, "http://g.example/1", "<p>x<svg><text>gone</text></svg>y<select><option>z</select>", "x y"),
    ]
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h, _ in cases], SCHEMA)
    assert rows(webtext.main_text(df), "page_id", "text") == rows(spark.createDataFrame([(i, t) for i, _, _, t in cases], "page_id long, text string"))
    assert webtext.main_text(df.limit(0)).collect() == []


def test_large_host_is_aligned_in_steps(spark):
    draw = random.Random(11)
    pages = []
    for i in range(300):
        parts = "".join(f"<section class=s{words(draw, 1)}><h2>{i}</h2><p>{words(draw, 5)}</section>" for _ in range(draw.randint(0, 4)))
        pages.append((i, "http://big.example/", f"<article><h1>{i}</h1>{parts}<p>{words(draw, 30)}</article>", None))
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h, _ in pages], SCHEMA)
    known = webtext.wrappers(df, together=4).collect()
    assert [r.host for r in known] == ["big.example"] and json.loads(known[0].wrapper)
    got = extracted(spark, pages)
    for i, _, page, _ in pages:
        want = [" ".join(re.sub("<[^>]*>", " ", b).split()) for b in re.split("<(?:section|h1|h2|p|/article)[^>]*>", page)]
        assert got[i] == "\n".join(w for w in want if w)
