"""Pages are read the same by the short way as by the library's own loop, and tags met before are not taken apart again."""

import random
from datetime import datetime, timezone
from html.parser import HTMLParser

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenrank.operators import html
from lumenrank.plans import pages

NOW = datetime(2026, 10, 5, tzinfo=timezone.utc)
BITS = [
    "<", ">", '"', "'", "&amp;", "&lt", "&#39", "<!--", "-->", "<!doctype html>", "<![CDATA[x]]>", "<?php ?>", "</", "</>", "</ p >", "</p x>", "<br/>", '<img alt="a>b">', "<a href=/x/>t</a>", '<a href="https://www.one.example/p">x</a>', '<a href="//h.example/y">y</a>', '<a href="/..//x">z',
    '<a href="http://[no">z</a>', '<base href="https://b.example/d/">', '<base href="http://[x">', "<script>", "</script>", "<style>", "</style >", "<SCRIPT>if(a<b)</SCRIPT>", "<title>", "</title>", '<div class="cookie-bar">', "</div>", "<main>", "</main>", "<h1>", "</h1>", '<p class="author x">', "<button>Buy now</button>",
    '<p style="display:none">', "<nav>", "</nav>", "<p a = 1>", '<p a="1"b="2">', "<p =x>", "<é>", "<1>", "a@b.example", "ул. Х", "от 12,50 лв. / месец", "$ 7 $", "5 bgn", "price", "VAT no", "отзив", "case study", "2024", "word ", "\n",
]


class _ByLibrary(html._Page):
    goahead = HTMLParser.goahead
    parse_starttag = HTMLParser.parse_starttag


@pytest.mark.parametrize("seed", range(4))
def test_same_facts_as_by_the_library(monkeypatch, seed):
    draw = random.Random(seed)
    made = [("".join(draw.choice(BITS) for _ in range(draw.randrange(1, 40))), draw.choice(["https://made.example/p1", "http://www.a.example/x?y", "", "ftp://f.example/"])) for _ in range(300)]
    # a second reading meets the tags of the first
    short = [[html.extract(source, url, NOW) for source, url in made] for _ in range(2)]
    monkeypatch.setattr(html, "_Page", _ByLibrary)
    assert short[0] == short[1] == [html.extract(source, url, NOW) for source, url in made]


def test_known_tags_are_not_taken_apart_again(monkeypatch):
    source = '<div class="a"><p id=x>one</p><img src=a.png alt="a"><p hidden>two</p><script>var a = "<p>"</script><a href="/in">in</a></div>'
    first, asked = html.extract(source, "https://a.example/", NOW), []
    whole = HTMLParser.parse_starttag
    monkeypatch.setattr(HTMLParser, "parse_starttag", lambda self, i: asked.append(i) or whole(self, i))
    assert html.extract(source, "https://a.example/", NOW) == first
    assert asked == []


def test_tags_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(html, "_TAGS", {})
    monkeypatch.setattr(html, "TAGS_KEPT", 10)
    html.extract("".join(f"<p id=x{i}>" for i in range(50)) + f"<p id={'x' * 500}>", "https://a.example/", NOW)
    assert 0 < len(html._TAGS) <= 10 and max(map(len, html._TAGS)) < 20


def test_made_pages_are_dealt_out_before_they_are_made(spark):
    plan = pages.made_page_facts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Repartition") :]
    assert "doctype" in plan and "doctype" not in below


def test_facts_of_a_batch_are_made_a_few_pages_at_a_time(spark, monkeypatch):
    """What is turned into Arrow at once is bounded, whatever the batch."""
    kept, whole = [], F.arrow_udf
    monkeypatch.setattr(html.F, "arrow_udf", lambda kind: lambda run: kept.append(run) or whole(kind)(run))
    html.page_facts(spark.createDataFrame([], "url string, html string"), NOW)
    pages_of = lambda n: (pa.array(["https://a.example/"] * n, pa.string()), pa.array(["<p>x"] * n, pa.string()))
    made = list(kept[0](iter([pages_of(300), pages_of(0)])))
    assert sum(map(len, made)) == 300 and max(map(len, made)) <= 128


def test_every_page_of_a_batch_keeps_its_row(spark):
    rows = spark.range(0, 700, 1, 1).selectExpr("id", "case when id % 7 = 0 then 'https://[bad' else concat('https://a.example/', id) end AS url", "case when id % 5 > 0 then concat('<title>t', id, '</title>') end AS html")
    found = {r.id: (r.status, r.title) for r in html.page_facts(rows, NOW).select("id", "facts.status", "facts.title").collect()}
    assert found == {i: ("error", None) if i % 7 == 0 else ("ok", f"t{i}" if i % 5 else None) for i in range(700)}
