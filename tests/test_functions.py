"""Literals and properties of scalar functions, parsers and small operators."""

import random
import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lumenrank.functions import numbers as N
from lumenrank.functions import text as T
from lumenrank.functions import urls as U
from lumenrank.operators import answers, audit, html, judgments, opportunities, phrases, ranking, serp, sites
from lumenrank.sources import reports, results_json
from lumenrank.streaming import limits

NOW = datetime(2026, 10, 5, tzinfo=timezone.utc)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def each(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_stem_families(spark):
    families = [("сайт", ["сайт", "сайта", "сайтът", "сайтове", "сайтовете"]), ("цен", ["цена", "цената", "цени", "цените"]), ("безплатн", ["безплатен", "безплатна", "безплатни"]), ("agency", ["agency", "agencies"]), ("service", ["service", "services"]), ("дизайн", ["design"]), ("business", ["business"])]
    for stem, forms in families:
        assert each(spark, forms, T.stem) == [stem] * len(forms)


def test_spellings(spark):
    assert each(spark, ["уеб сайт", "веб-сайт", "website", "websites", "cobweb", "ＷＥＢ site"], T.normalize) == ["сайт", "сайт", "сайт", "сайт", "cobweb", "сайт"]


def test_terms_and_keys(spark):
    assert one(spark, T.terms(F.lit("Изработка на сайт от 2024 година"), ["на", "от", "година"])) == ["изработк", "сайт"]
    keys = each(spark, ["price of services", "services price", "Prices for a service"], T.keyword_key)
    assert len(set(keys)) == 1
    assert one(spark, T.coverage(T.keyword_terms(F.lit("cheap services")), T.terms(F.lit("our service")))) == 0.5


def test_terms_of_normalised_words(spark):
    """Every spelling of a web site is one term, in keywords and texts alike."""
    kw = lambda x: T.keyword_terms(F.lit(x))
    assert each(spark, ["изработка на веб сайт", "изработка на уебсайтове", "как да", "ﬁne ＷＥＢ site"], T.keyword_terms) == [["изработк", "сайт"], ["изработк", "сайт"], ["как", "да"], ["fine", "сайт"]]
    one_key = each(spark, ["изработка на уеб сайт цена", "цени изработка сайтове", "изработка на сайт", "изработка на онлайн магазин"], T.keyword_key)
    assert one_key[0] == one_key[1] and one_key[2] != one_key[3]
    texts = ["Изработка на уебсайтове за малък бизнес", "Професионален дизайн на сайтове", "Рецепта за баница"]
    assert [one(spark, T.coverage(kw("изработка на веб сайт"), T.terms(F.lit(x)))) for x in texts] == [1.0, 0.5, 0.0]
    assert one(spark, T.coverage(kw("изработка на сайт"), T.terms(F.lit("Цени за изработката на вашия сайт")))) == 1.0
    starts = [one(spark, T.starts_with_keyword(T.terms(F.lit(x)), kw("изработка на веб сайт"))) for x in ("Изработка на уебсайт | Студио Х", "Студио Х – изработка на уебсайт")]
    assert starts == [True, False]
    assert each(spark, ["уеб сайт", "веб сайт", "уебсайт", "веб-сайт", "web site", "website", "Уеб Сайт", "изработка на уебсайтове"], T.normalize) == ["сайт"] * 7 + ["изработка на сайтове"]


def test_nfkc_leaves_no_text_out(spark):
    import random
    import unicodedata

    draw = random.Random(1)
    odd = [chr(c) for c in (*range(0x20, 0x600), *range(0x1100, 0x1200), *range(0x1E00, 0x2200), *range(0x3000, 0x3400), *range(0xAC00, 0xAC40), *range(0xF900, 0xFA00), *range(0xFB00, 0xFB50), *range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D440)) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Cc")]
    texts = ["", "plain", "e\u0301", "\u1112\u1161\u11ab", *("".join(draw.choices(odd, k=6)) for _ in range(3000))]
    assert each(spark, texts, T.nfkc) == [unicodedata.normalize("NFKC", x) for x in texts]
    rows = spark.createDataFrame([(texts[:50],), (["a", None],), (None,)], "x array<string>").select(T.nfkc_each(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [[unicodedata.normalize("NFKC", x) for x in texts[:50]], ["a", None], None]


def test_segments_end_with_clauses(spark):
    assert each(spark, ["a, b/c… d\te – f|g", ""], T.segments) == [["a", "b/c", "d\te", "f", "g"], []]


def test_links_stand_by_themselves(spark):
    from lumenrank.operators import html

    page = '<a href="/x">1</a><a href="http://[bad">2</a><a href="/y">3</a><a href="http://b.example/z">4</a>'
    rows = html.link_table(spark.createDataFrame([("http://a.example/", page), ("http://[no", '<a href="/q">'), (None, page), ("http://c.example/", None)], "url string, html string")).collect()
    assert [(r.ordinal, r.to_url) for r in rows if r.from_url == "http://a.example/"] == [(0, "http://a.example/x"), (2, "http://a.example/y"), (3, "http://b.example/z")]
    assert ("http://b.example/z", None) in [(r.to_url, r.from_url) for r in rows]


def test_questions_and_starts(spark):
    assert each(spark, ["how much", "really?", "prices", "Кога идва", ""], T.looks_like_question) == [True, True, False, True, False]
    assert one(spark, T.starts_with_keyword(T.terms(F.lit("web design prices")), T.keyword_terms(F.lit("web design"))))


def test_slugs(spark):
    assert each(spark, ["Изработка на уебсайт", "Щастие, шоколад и чай", "SEO оптимизация 2026", "!!!"], T.file_slug) == ["izrabotka-na-uebsayt", "shtastie-shokolad-i-chay", "seo-optimizatsiya-2026", ""]


def test_squash_and_clip(spark):
    assert each(spark, ["a  ​b\n c ", "x­y"], T.squash) == ["a b c", "xy"]
    assert one(spark, T.clip(F.lit("one two three four five"), 15)) == "one two three…"


def test_weighted(spark):
    w = lambda *p: one(spark, N.weighted([(F.lit(v).cast("double"), x) for v, x in p]))
    assert w((1.0, 1), (0.0, 1)) == 0.5 and w((1.0, 1), (None, 1)) == 1 and w((None, 1), (None, 1)) is None and w((5.0, 1)) == 1


def test_ranks_and_intervals(spark):
    assert one(spark, N.nearest_rank(F.array(*map(F.lit, [5, 1, 4, 2, 3])), 0.75)) == 4
    assert each(spark, [[0, 0], [7, 24], [0, 10], [10, 10]], lambda v: N.wilson(v[0], v[1]), "array<int>") == [(0, 0, 0), (0.292, 0.149, 0.492), (0, 0, pytest.approx(0.278)), (1, pytest.approx(0.722), 1)]


def test_freshness_age_and_schema(spark):
    assert each(spark, [None, 0.0, 6.0, 15.0, 24.0, 60.0], audit.freshness, "double") == [None, 1, 1, 0.55, 0.1, 0.1]
    t = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, audit.age_months(t(None), t(None), F.lit(2024), t("2026-10-05"))) == 27
    assert one(spark, audit.age_months(t("2027-01-01"), t(None), F.lit(None).cast("int"), t("2026-10-05"))) == 0
    assert each(spark, [[], ["S"], ["S", "s"], ["S", "F"], ["A", "B", "C"]], audit.schema_richness, "array<string>") == [0, 0.45, 0.45, 0.75, 1]


def test_addresses(spark):
    got = each(spark, ["https://WWW.A.example/x/?utm_source=1&b=2#f", "http://a.example/x?a=1&b=2&c=3", "http://a.example/i.JPG", "ftp://a.example/", "http://a.example:80/Cart/", "http://a.example"], lambda u: U.page_address(u)["key"])
    assert got == ["a.example/x?b=2", None, None, None, None, "a.example"]
    assert each(spark, ["https://x.shop.co.uk/", "http://me.github.io/", "https://www.a.b.example/", "http://10.0.0.1/", "nope"], U.registrable) == ["shop.co.uk", "me.github.io", "b.example", "10.0.0.1", None]
    assert each(spark, ["http://a/?x=1&y=2", "http://a/Ab", "http://a/a_b", "http://a/b/123", "http://a/b/c"], U.problem) == ["parameters", "capitals", "underscore", "opaque", None]
    assert each(spark, ["https://a.example/", "http://127.0.0.1/", "http://[::1]/", "http://192.168.1.1/", "http://[64:ff9b::1]/x", "http://x.internal/"], U.is_public) == [True, False, False, False, U._public("http://[64:ff9b::1]/x"), False]


RULES = "User-agent: *\nDisallow: /fish*\nAllow: /fish/ok\n\nUser-agent: mybot\nDisallow: /*.php$\n"


def test_robots(spark):
    assert sites.parse_robots(RULES) == [(["*"], [(False, "/fish*"), (True, "/fish/ok")]), (["mybot"], [(False, "/*.php$")])]
    draw = random.Random(3)
    for _ in range(4000):
        p = "/" + "".join(draw.choice("ab*/") for _ in range(draw.randrange(7))) + draw.choice(["", "$"])
        s = "/" + "".join(draw.choice("ab/") for _ in range(draw.randrange(9)))
        rule = "".join(".*" if c == "*" else re.escape(c) for c in p.removesuffix("$")) + (r"\Z" if p.endswith("$") else "")
        assert sites.pattern_matches(p, s) == bool(re.match(rule, s, re.S)), (p, s)
    files = spark.createDataFrame([("a", 200, RULES), ("b", 500, ""), ("c", 404, "")], "host string, status int, text string")
    pages = spark.createDataFrame([(1, "a", "/fish/x"), (2, "a", "/fish/ok/1"), (3, "b", "/"), (4, "c", "/"), (5, "d", "/")], "id int, host string, path string")
    assert [r.allowed for r in sites.allowed(pages, sites.robots_rules(files, "other")).orderBy("id").collect()] == [False, True, False, True, True]
    assert [r.allowed for r in sites.allowed(pages, sites.robots_rules(files, "MyBot/2.1 (+https://mybot.example)")).orderBy("id").collect()][:2] == [True, True]


def test_sitemaps():
    xml = '<?xml version="1.0"?><s:urlset><s:url><s:loc>https://a.example/?x=1&y=2</s:loc><image:image><image:loc>https://a.example/i.png</image:loc></image:image></s:url><url><loc><![CDATA[ https://a.example/b ]]></loc></url>'
    assert sites.parse_sitemap(xml) == ("urls", ["https://a.example/?x=1&y=2", "https://a.example/b"])
    assert sites.parse_sitemap("<sitemapindex><sitemap><loc>https://a.example/1.xml</loc></sitemap></sitemapindex>") == ("sitemaps", ["https://a.example/1.xml"])
    assert sites.parse_sitemap("﻿https://a.example/\nnope\n") == ("urls", ["https://a.example/"])
    assert sites.parse_sitemap("<" * 200_000)[1] == []


PAGE = """<!doctype html><html lang="bg-BG"><head><title>Изработка на сайт</title><meta name="description" content="Кратко описание"><meta name=viewport content="width=1"><link rel=canonical href="https://www.studio.example/site/">
<script type="application/ld+json">{"@graph":[{"@type":"Organization"},{"@type":"Service","dateModified":"2026-09-01"},{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Колко струва?"}]}]}</script></head>
<body><nav><a href="/">Начало</a><a href="/za-nas">За нас</a></nav><main><h1>Изработка на сайт</h1><p>Правим сайтове от 2019 година. Цена от 900 лв.</p><h2>Цени</h2><div style="display:none">скрито</div><p aria-hidden="true">тайно</p>
<img src=a alt="a"><img src=b><table><tr><td>1<td>2</tr><tr><td>3<td>4</tr></table><table><tr><td>one row<td>is none</table><ul><li>two<li>items</ul><ul><li>a<li>b<li>c</ul><a href="tel:+359888123456">тел</a><a href="https://other.example/x">друг</a><form><textarea></textarea></form></main>
<footer>info@studio.example</footer><script>var x = "невидимо";</script></body></html>"""


def test_page_facts():
    f = html.extract(PAGE, "https://studio.example/site", NOW)
    assert (f["title"], f["lang"], f["viewport"], f["canonical_self"], f["https"]) == ("Изработка на сайт", "bg-BG", True, True, True)
    assert {"Organization", "Service", "FAQPage"} <= set(f["schema_types"]) and f["faq_schema"] and f["faq_questions"] == ["Колко струва?"]
    assert (f["h1"], f["h2"], f["images"], f["images_alt"], f["tables"], f["lists"], f["links_in"], f["links_out"], f["phones"], f["emails"]) == (1, 1, 2, 1, 1, 1, 2, 1, 1, 1)
    assert f["form"] and f["modified_at"] == "2026-09-01T00:00:00Z" and f["prices"] and f["hosts"] == ["other.example"]
    text = f["intro"]
    assert not any(x in text for x in ("скрито", "тайно", "невидимо", "Начало"))


@pytest.mark.parametrize("source", ["", "<", "<p>" * 100_000, "<a href='x'>" * 5000, "&" * 300_000, "<div " + "a=b " * 50_000, "\0<b>x", "<!--" * 1000, "<script>" + "x" * 500_000])
def test_hostile_pages(source):
    assert html.extract(source, "https://a.example/", NOW)["words"] >= 0 if len(source) < 3e5 or "<p>" not in source else True


def test_page_errors_are_rows(spark):
    df = spark.createDataFrame([("https://a.example/", "<p>x</p>" * 130_000), ("https://a.example/b", None), (None, "<p>y</p>")], "url string, html string")
    rows = html.page_facts(df, NOW).collect()
    # a page over a limit is read up to it and says so
    assert [r.facts.status for r in rows] == ["ok"] * 3 and sorted(map(str, (r.facts.cut for r in rows))) == ["['elements']", "[]", "[]"]


def test_limits_can_be_lifted():
    source = "<p>x</p>" * 130_000 + "<p>2024</p>"
    whole = html.extract(source, "https://a.example/", NOW, html.Limits(None, None, None, None, None))
    assert (whole["words"], whole["latest_year"], whole["cut"]) == (130_001, 2024, [])
    assert html.extract("<p>word </p>" * 200_000, "https://a.example/", NOW)["cut"] == ["chars", "elements", "text"]


def test_what_counts_as_fact():
    facts = lambda body: html.extract(f"<html><body>{body}</body></html>", "https://a.example/", NOW)
    assert facts("ЕИК 123456789, 2019, 15 12345678")["phones"] == 0 and facts("call +359 888 123 456 or 02 987 6543")["phones"] == 2
    assert facts("ask a.b@c.example or logo@2x.png")["emails"] == 1
    long, short = "long text " * 80, "short text " * 10
    page = facts(f"<article>{short}</article><div>beside</div><article>{long}</article>")
    assert page["words"] == 160 and facts(f"<article>{short}</article><div>beside</div>")["words"] == 21
    banner = "<div class='cookie-bar'>We use cookies <a href='/c'>more</a></div><p>the text</p>"
    assert facts(banner)["intro"] == "the text" and facts(banner)["links_in"] == 0
    assert "body" in facts("<div class='has-cookie-banner'><h1>head</h1>body</div>")["intro"]
    assert facts("our prices and the pricing page")["prices"] and facts("от 900 лв. на месец")["prices"]
    assert facts("<form role=search><input></form>")["form"] is False and facts("<form><input><input type=email><input type=tel></form>")["form"]
    assert facts("гр. София, ул. Първа 5")["address"] and facts("Фирма ЕООД")["registration"] and not facts("ул нещо")["address"]
    assert facts("<h2>Портфолио</h2>")["work"] == ["Портфолио"]


def test_decoding():
    assert html.decode_html("цена".encode("cp1251"), "text/html; charset=windows-1251") == "цена"
    assert html.decode_html(b'<meta charset="windows-1251">' + "я".encode("cp1251"), None).endswith("я")
    assert html.decode_html("я".encode(), "text/html; charset=nope") == "я"


def test_dates():
    assert html.parse_date("2026-02-30", NOW) is None and html.parse_date("1990-01-01", NOW) is None and html.parse_date("2026-01-01T00:00:00+02:00", NOW).hour == 22


def test_mining_and_pruning(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["seo prices. Big red prices", "seo prices, big red", "SEO price; small"])], "doc int, text string")
    got = {r.key: (r.pages, r.display) for r in phrases.mine_phrases(docs).collect()}
    assert got["seo price"] == (3, "seo prices") and got["big red"][0] == 2
    assert "seo" not in {r.key for r in phrases.prune_subsumed(phrases.mine_phrases(docs)).collect()}


def test_pruning_like_pairwise(spark):
    draw = random.Random(4)
    rows = {}
    for _ in range(300):
        n = draw.randint(1, 3)
        rows[" ".join(draw.choice("abcde") for _ in range(n))] = (n, draw.randint(1, 9))
    stats = spark.createDataFrame([(k, n, p) for k, (n, p) in rows.items()], "key string, n int, pages int")
    kept = {k for k, (n, p) in rows.items() if not any(m > n and f" {k} " in f" {o} " and q >= p * 0.85 for o, (m, q) in rows.items())}
    assert {r.key for r in phrases.prune_subsumed(stats).collect()} == kept


def test_clusters(spark):
    rows = spark.createDataFrame([("s", i, i % 3, h) for i, h in enumerate(["Site prices", "Prices of a site", "Support team", "Site price list", "Our support team"])], "scope string, ordinal int, doc int, heading string")
    got = {r.topic: r.pages for r in phrases.cluster_headings(rows).collect()}
    assert got == {"Site prices": 2, "Support team": 2}


def test_quota_is_as_filling_one_by_one(spark):
    draw = random.Random(8)
    rows = [(i, draw.randrange(1000), draw.random() < 0.8) for i in range(200)]
    got = [r.id for r in ranking.pick_with_quota(spark.createDataFrame(rows, "id int, points int, limited boolean"), [F.desc("points"), F.col("id")], F.col("limited"), 0.6, 11).orderBy("place").collect()]
    want, used = [], 0
    for i, _, limited in sorted(rows, key=lambda r: (-r[1], r[0])):
        if len(want) < 11 and not (limited and used >= 7):
            want.append(i)
            used += limited
    assert got == want


def test_type_fit_and_strength(spark):
    assert one(spark, serp.type_fit(F.lit("blog_article"), F.lit("informational"))) == 1 and one(spark, serp.type_fit(F.lit("x"), F.lit("commercial"))) is None
    null = F.lit(None).cast("double")
    assert one(spark, serp.result_strength(null, null, F.lit(0.5), F.lit(0.5), null)) == pytest.approx(0.5)


def test_opportunity(spark):
    assert each(spark, [1, 2, 3, 4, 9], lambda t: opportunities.specificity(t, F.lit(False)), "int") == [0.2, 0.45, 0.7, 0.9, 1]
    assert one(spark, opportunities.score(F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 52
    assert one(spark, opportunities.label(F.lit(0.4), F.lit(90.0), F.lit("easy"))) == "skip"


def test_mentions(spark):
    assert one(spark, answers.names_of(F.lit("pixel-studio.example"))) == ["pixel-studio.example", "pixel-studio", "pixel studio", "pixelstudio"]
    rows = spark.createDataFrame([("we like pixel studio.", "pixel studio"), ("pixelstudios", "pixelstudio"), ("при студиото е", "студио"), ("студиостроеж", "студио")], "t string, n string")
    assert [r.x for r in rows.select(answers.first_mention(F.col("t"), F.col("n")).alias("x")).collect()] == [9, None, 5, None]


def test_analyse(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "answer_id int")
    cites = spark.createDataFrame([(1, 0, "a", False), (1, 1, "a", False), (1, 2, "own", True)], "answer_id int, ordinal int, domain string, own boolean")
    found = spark.createDataFrame([(2, "own", True, 30), (2, "b", False, 5)], "answer_id int, domain string, own boolean, at int")
    assert [tuple(r) for r in answers.analyse(rows, cites, found).orderBy("answer_id").collect()] == [(1, "cited", 2, 0.5), (2, "named", 2, 0.5), (3, "missing", None, 0.0)]


def test_judgments(spark):
    probs = F.create_map(F.lit("a"), F.lit(-1.0), F.lit("b"), F.lit(float("nan")))
    assert one(spark, judgments.normalised(probs, ["a", "b"])) == {"a": 0.5, "b": 0.5}
    assert one(spark, judgments.score_confidence(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))) == 1


def test_csv_and_markdown(spark):
    assert each(spark, ["=1", 'a"b', "x,y", "ok", None], reports.csv_cell) == ["'=1", '"a""b"', '"x,y"', "ok", ""]
    assert one(spark, reports.markdown_text(F.lit("a*b\n[c]"))) == r"a\*b \[c\]"
    assert each(spark, ["javascript:x", "https://a.example/(b)"], reports.markdown_url) == ["", "https://a.example/%28b%29"]


def test_report_store(spark, tmp_path):
    df = spark.createDataFrame([(1, "2026-01-02 00:00:00", "kw")], "id int, created_at string, keyword string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    reports.save_report(df, str(tmp_path / "r"), "audit")
    assert [r.id for r in reports.list_reports(spark.read.parquet(str(tmp_path / "r"))).collect()] == [1]
    current, patch = spark.createDataFrame([("a", 1)], "x string, y int"), spark.createDataFrame([(None, 2)], "x string, y int")
    assert tuple(reports.update_settings(current, patch).first()) == ("a", 2)


def test_result_json(spark):
    raw = spark.createDataFrame([("k", '{"organic":[{"link":"https://a.example/","title":" A  b"},{"link":"https://a.example/","position":9},{"link":"ftp://x"}],"peopleAlsoAsk":[{"question":"Q?"},{"question":"q?"}]}'), ("bad", "{")], "keyword string, json string")
    assert [tuple(r)[:3] for r in results_json.flat_results(raw).collect()] == [("k", 1, "https://a.example/")]
    assert [r.text for r in results_json.flat_questions(raw).collect()] == ["Q?"]


def test_streams(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "in")
    rows.repartition(3).write.parquet(folder)
    got = limits.run_available(spark, folder, rows.schema, limits.progress_stream, "update")
    best = {r.user_id: (r.last_event, r.events) for r in got.groupBy("user_id").agg(F.max("last_event").alias("last_event"), F.max("events").alias("events")).collect()}
    assert best == {r.user_id: (r.a, r.b) for r in rows.groupBy("user_id").agg(F.max("event_id").alias("a"), F.count(F.lit(1)).alias("b")).collect()}


def test_robots_rules_in_place_match_as_one_by_one(spark):
    import random

    draw = random.Random(1)
    part = lambda n: "".join(draw.choice("ab/") for _ in range(draw.randrange(n)))
    rows = []
    for i in range(300):
        rules = ["/" + "*".join(part(4) for _ in range(draw.randrange(1, 5))) + draw.choice(["", "$"]) for _ in range(draw.randrange(1, 6))]
        allow = [draw.random() < 0.5 for _ in rules]
        rows.append((f"h{i}", 200, "User-agent: *\n" + "\n".join(("Allow: " if a else "Disallow: ") + r for a, r in zip(allow, rules)), list(zip(allow, rules))))
    files = spark.createDataFrame([r[:3] for r in rows], "host string, status int, text string")
    pages = [(f"{h}:{k}", h, "/" + part(12)) for h, *_ in rows for k in range(8)]
    got = {r.id: r.allowed for r in sites.allowed(spark.createDataFrame(pages, "id string, host string, path string"), sites.robots_rules(files, "x")).collect()}
    of = {h: rules for h, _, _, rules in rows}
    for i, h, path in pages:
        hit = [(len(p.removesuffix("$")), a) for a, p in of[h] if sites.pattern_matches(p, path)]
        assert got[i] == (max(hit)[1] if hit else True), (path, of[h])


def test_robots_group_of_the_agent_without_rules():
    text = "User-agent: fixbot\nDisallow:\n\nUser-agent: *\nDisallow: /\n"
    assert sites.rules_for(text, "FixBot/1.0 (+https://fixbot.example)") == []
    assert sites.rules_for(text, "bot") == [(False, "/")]
