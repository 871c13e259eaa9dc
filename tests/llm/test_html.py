"""Tag-path ratios: what selects content, what does not, and how work grows."""

import collections
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from signalloom.llm import htmltext

SF = "/root/testdata/sf0.01"
TEXT = "A sentence of the article, which is long enough to be one, says this and that; and then it ends. "
PARAGRAPHS = [f"{i}. {TEXT * 2}".strip() for i in range(12)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


def page(inner):
    return f"<html><head><title>T</title></head><body>{inner}</body></html>"


@pytest.mark.parametrize("names", ["content has-sidebar", "post comments-open", "no-comments entry", "ad-free story", "nav-open"])
def test_class_words_empty_no_article(names):
    assert htmltext.main_text(page(f'<div class="{names}">{BODY}</div>')).split("\n\n") == PARAGRAPHS


def test_side_by_side_stays():
    inner = f'<article>{BODY}<div class="side-by-side"><p>{PARAGRAPHS[0]}</p></div></article>'
    assert htmltext.main_text(page(inner)).split("\n\n") == [*PARAGRAPHS, PARAGRAPHS[0]]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div>{}</div>", "<main><div>{}</div></main>", "<form><div>{}</div></form>"])
def test_link_bars_and_adverts_without_names_go(wrap):
    bar = "<div><ul>" + "".join(f"<li><a href=/{i}>Topic number {i}</a></li>" for i in range(9)) + "</ul></div>"
    inner = bar + "<div>Buy this now, it is cheap.</div>" + wrap.format("<h1>Head</h1>" + BODY + "<ul><li>one item<li>another</ul>") + bar
    want = ["Head", *PARAGRAPHS, "one item", "another"]
    assert htmltext.main_text(page(inner)).split("\n\n") == want


def test_comments_of_readers_go_but_not_when_they_are_all():
    remarks = "".join(f"<p>{TEXT}</p>" for _ in range(5))
    for inner in (f'<article>{BODY}<section class="comments-area">{remarks}</section></article>', f'<div>{BODY}</div><div id="comments">{remarks}</div>'):
        assert htmltext.main_text(page(inner)).split("\n\n") == PARAGRAPHS
    assert htmltext.main_text(page(f'<div id="comments">{remarks}</div>')).split("\n\n") == [TEXT.strip()] * 5


def test_links_in_sentences_stay():
    inner = f"<article><p>See <a href=x>this page</a>, <b>and</b> <a href=y>that <i>one</i></a>, both of which say more on it.</p>{BODY}</article>"
    assert htmltext.main_text(page(inner)).startswith("See this page, and that one, both of which say more on it.\n\n0.")


def test_constant_scores_change_most_pages(monkeypatch):
    pages = [r[0] for r in duckdb.connect().execute(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()]
    real = [htmltext.main_text(p) for p in pages]
    monkeypatch.setattr(htmltext, "fused", lambda sums, above: dict.fromkeys(sums, 1.0))
    assert sum(a != htmltext.main_text(p) for a, p in zip(real, pages, strict=True)) > 0.5 * len(pages)


def test_articles_of_the_table_are_whole():
    wrong = 0
    rows = duckdb.connect().execute(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()
    for (html,) in rows:
        inner = html[html.index("<article>") : html.index("</article>")]
        wrong += htmltext.main_text(html) != htmltext.main_text(f"<html><body>{inner}</article></body></html>")
    assert wrong <= 0.01 * len(rows)


def test_path_numbers_give_the_scores_of_paths():
    html = page("<div><p>One, two.</p><p>Three <b>four</b>.</p><ul><li><a>x</a><li>y, z</ul></div><div><div><p>Other.</p></div></div>")
    read = htmltext._Reader(html)
    sums = collections.defaultdict(lambda: [0, 0, 0])
    for node, _, text in read.leaves:
        n, marks = htmltext._size(text)
        if n:
            sums[node.trail] = [a + b for a, b in zip(sums[node.trail], (1, n, marks), strict=True)]
    by_number, by_path = htmltext.trail_scores(sums, read.trails), htmltext.path_scores(read.leaves)
    assert len(by_path) == len(by_number) > 4
    assert all(by_path[node.path] == pytest.approx(by_number[node.trail]) for node, _, text in read.leaves if text.strip())


@pytest.mark.parametrize("make", [
    lambda n: "<div>" * n + BODY, lambda n: "<div>x, " * n, lambda n: "<p><span>" * n + TEXT, lambda n: "<div>" * n + "</span></p>" * n,
    lambda n: "<div><table><tr><td>" * (n // 4) + TEXT, lambda n: "<p><button><div>" * (n // 3), lambda n: "<ul><li>" * (n // 2) + "<li>" * n, lambda n: "<a b='" * n, lambda n: "<a b=\"x'" * n, lambda n: "<" * n, lambda n: "<div a=b" * n,
])
def test_time_grows_with_the_page_not_its_depth(make):
    took = []
    for n in (5_000, 50_000):
        html = page(make(n))
        began = time.process_time()
        htmltext.main_text(html)
        took.append(time.process_time() - began)
    assert took[1] < 40 * max(took[0], 0.02)


def test_rows(spark):
    rows = [(1, "u", page(BODY)), (1, "u", page(BODY)), (2, None, None), (None, "v", "<div>" * 3000 + "deep"), (3, "w", "".join(f"<{t}>" for t in ("b", "i", "u")) * 500 + "z, z.")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"TEXT": F.lit(1), "n_chars": F.lit("x"), "_c0": F.lit(2.0)}).select("*", F.lit("other").alias("Html"))
    got = [tuple(r) for r in htmltext.extracted(df).collect()]
    assert sorted(got, key=str) == sorted([(i, u, t, len(t)) for i, u, t in [(1, "u", "\n\n".join(PARAGRAPHS))] * 2 + [(2, None, ""), (None, "v", "deep"), (3, "w", "z, z.")]], key=str)
    assert htmltext.extracted(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"] and htmltext.extracted(df.limit(0)).count() == 0
