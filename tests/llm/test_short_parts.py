"""Short parts of an article stay, and a document of very many matches takes time in proportion to them."""

import time

import pytest

from spanview.llm import html_text, secret_scan

LONG = "Long words of the article go on and on. " * 20
DENSE = f"<p>{LONG}</p>" * 4


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<div id=content><h1>Head</h1><div><p>Intro short.</p></div><div>{DENSE}</div><div><p>Outro short.</p></div></div>", f"Head Intro short. {(LONG * 4).strip()} Outro short."),
        (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LONG}</p><h2>References</h2><ul><li><a href=1>First</a></li><li><a href=2>Second</a></li></ul></article><footer>f</footer>", f"T {LONG.strip()} References First Second"),
        (f"<div id=page><h1>Head</h1><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div>{DENSE}</div></div>", f"Head {(LONG * 4).strip()}"),
        (f"<article><p>{LONG}</p><ul class=menu><li><a href=1>Menu</a></li><li><a href=2>Menu</a></li></ul></article>", LONG.strip()),
        (f"<main><h1>A</h1><div>{DENSE}</div><ul><li><a href=1>Related one</a></li><li><a href=2>Related two</a></li></ul></main>", f"A {(LONG * 4).strip()}"),
    ],
)
def test_parts_under_one_heading_stay(page, want):
    assert html_text.main_text(page) == want


def test_links_of_very_many_matches(spark):
    def seconds(n):
        rows = [(1, i % 5, 40 * i, 40 * i + 30) for i in range(n)]
        df = spark.createDataFrame(rows, "uid long, kind int, start long, end long").cache()
        df.count()
        began = time.time()
        kept = secret_scan.linked(df).count()
        return time.time() - began, kept

    seconds(1000)
    (short, a), (long, b) = seconds(40_000), seconds(160_000)
    assert (a, b) == (40_000, 160_000) and long < 8 * short + 2
