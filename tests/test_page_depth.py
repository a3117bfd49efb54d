"""Elements end at their own close tag, and character references of every form are decoded."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators import pages

CASES = [
    ("<article><p>a</p><article>b</article><p>after</p></article><p>out</p>", "<p>a</p><article>b</article><p>after</p>"),
    ('<div role="main"><p>body</p><div>in</div></div><div><p>sidebar</p></div>', "<p>body</p><div>in</div>"),
    ('<body><div class="x document y"><div><div>d</div></div>e</div><div>f</div></body>', "<div><div>d</div></div>e"),
    ('<main><br><img src="a>b.png"><input/>x</main>y', '<br><img src="a>b.png"><input/>x'),
    ("<article>never closed <p>x</p>", "<article>never closed <p>x</p>"),
    ("<body class='q'><p>t</p>", "<p>t</p>"),
    ("no tags at all", "no tags at all"),
    ("", ""),
]


@pytest.mark.parametrize(("html", "want"), CASES)
def test_main_part(one, html, want):
    assert one(lambda d: pages.main_part(F.col("h")), h=html) == want


@pytest.mark.parametrize(("html", "want"), [
    ('<p>a</p><div class="related"><div>x</div><p>y</p></div><p>b</p>', "<p>a</p> <p>b</p>"),
    ("<nav><nav>x</nav>y</nav>z", " z"),
    ("<footer>f</footer>a<!-- <nav> -->b<script>if (a<b) '</div>'</script>c", " a b c"),
    ("a<nav>open<p>b", "a<nav>open<p>b"),
])
def test_without_noise(one, html, want):
    assert one(lambda d: pages.without_noise(F.col("h")), h=html) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("caf&eacute; &#8217; &#x2019; &amp;lt;", "café ’ ’ &lt;"), ("&#128512;&#x1F600;", "😀😀"), ("&nope; &#0; &#xD800; a & b;", "&nope; &#0; &#xD800; a & b;"),
    ("&apos;&nbsp;&hellip;", "'\xa0…"), ("plain", "plain"),
])
def test_unescape(one, raw, want):
    assert one(lambda d: tx.unescape(F.col("t")), t=raw) == want


def test_work_is_linear_in_tags(spark):
    """16 000 tags, most of them in noise elements and nested containers."""
    part = "<div class='related'><p>x</p></div><article><div><b>y</b></div></article>"
    page = "<section role=\"main\">" + part * 1600 + "</section>"
    assert page.count("<") > 16_000
    df = spark.createDataFrame([(page,)], "h string").select(pages.main_part(pages.without_noise(F.col("h"))).alias("out"))
    df.where("out = ''").count()  # planning and the first run of the code
    started = time.time()
    out = df.first()["out"]
    took = time.time() - started
    assert out == " <article><div><b>y</b></div></article>" * 1600
    assert took < 5, took


def test_the_cleaned_page_is_worked_out_once(spark):
    """Nested rules name their argument instead of repeating it."""
    df = spark.createDataFrame([("<p>x</p>",)], "h string").select(pages.main_part(pages.without_noise(F.col("h"))).alias("out"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<!--") == 1
