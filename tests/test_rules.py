"""Rules of the audit, of questions and plans, of judging and fetching, on rows made for them."""

import gzip

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenrank.functions import draws
from lumenrank.functions import text as T
from lumenrank.operators import answers, buyers, desk, fetch, ideas, judge, recovery, signals
from lumenrank.sources import adapters


def each(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_slugs_and_phrases(spark):
    urls = ["https://x.example/izrabotka-na-sait/", "https://x.example/uslugi", "https://x.example/web-design", "nope"]
    assert each(spark, urls, lambda u: T.slug_matches(u, F.lit("изработка на сайт"))) == [True, False, False, False]
    assert each(spark, urls, lambda u: T.slug_matches(u, F.lit("design")))[2] is True
    assert each(spark, ["Our  Garden ", "abc", None], lambda h: T.phrase_of(h, F.lit("Tools for you | Shop"))) == ["our garden", "tools for you", "tools for you"]
    text = "Head line that is long enough to count as prose\nshort\n" + "a" * 50 + "\n" + "b" * 50 + "\n" + "c" * 50
    assert each(spark, [text], lambda t: T.intro_prose(t, F.array(F.lit("head line THAT is long enough to count as prose"))))[0] == "a" * 50 + " " + "b" * 50
    assert each(spark, [" 1) how much ", "Why?"], T.as_question) == ["How much?", "Why?"]
    assert each(spark, ["които", "like", "сайт", "the"], T.is_stop) == [True, False, False, True]


def test_draws(spark):
    assert each(spark, ["", "a", "foobar", "é", "🙂"], draws.fnv1a)[:3] == [2166136261, 0xE40C292C, 0xBF9CF968]

    def plain(s):
        h = 0x811C9DC5
        raw = s.encode("utf-16-le")
        for lo, hi in zip(raw[::2], raw[1::2]):
            h = (h ^ (lo | hi << 8)) * 0x01000193 & 0xFFFFFFFF
        return h

    assert each(spark, ["é", "🙂 x"], draws.fnv1a) == [plain("é"), plain("🙂 x")]
    assert sorted(draws.shuffled(list("abcdef"), 7)) == list("abcdef") and draws.shuffled(list("abcdef"), 7) == draws.shuffled(list("abcdef"), 7 + (1 << 32))
    drawn = each(spark, list(range(2000)), draws.draw, "long")
    assert 0 <= min(drawn) and max(drawn) < 1 and abs(sum(drawn) / 2000 - 0.5) < 0.03


@pytest.mark.parametrize(
    "stage,verdict,angle,first,step",
    [
        ("compare", "answered", None, None, "none"), ("compare", "no_page", None, None, "write_versus"), ("local", "no_page", None, None, "add_local"), ("howto", "no_page", None, None, "write_guide"), ("compare", "weak", 0.3, None, "write_versus"),
        ("price", "weak", 0.3, 0.9, "write_guide"), ("trust", "weak", 0.9, 0.2, "answer_at_top"), ("trust", "weak", None, None, "add_proof"), ("price", "weak", 0.9, 0.9, "add_prices"), ("local", "weak", 0.9, None, "add_local"), ("discover", "weak", 0.9, 0.9, "answer_at_top"),
    ],
)
def test_next_steps(spark, stage, verdict, angle, first, step):
    row = spark.createDataFrame([(stage, verdict, angle, first)], "s string, v string, a double, f double")
    assert row.select(buyers.next_step(F.col("s"), F.col("v"), F.col("a"), F.col("f")).alias("x")).first().x == step


def test_coverage_without_candidates_or_judgments(spark):
    questions = spark.createDataFrame([(1, "howto"), (2, "trust"), (3, "price")], "question_id long, stage string")
    met = spark.createDataFrame([(2, "a", 0.6), (2, "b", 0.4), (3, "a", 0.2)], "question_id long, url string, overlap double")
    judged = spark.createDataFrame([], "question_id long, url string, answer double, angle double")
    pages = spark.createDataFrame([("a", 0.9)], "url string, answer_first double")
    rows = {r.question_id: (r.best_page, r.match, r.verdict, r.next_step, r.judged) for r in buyers.check_coverage(questions, met, judged, pages).collect()}
    assert rows == {1: (None, 0.0, "no_page", "write_guide", True), 2: ("a", None, "weak", "add_proof", False), 3: (None, None, "no_page", "write_guide", False)}


def test_actions_and_reasons_to_be_cited(spark):
    rows = spark.createDataFrame([(["no_page"], None), (["wrong_angle"], 0.44), (["wrong_angle"], 0.45), (["thin"], None), (["wrong_angle"], None)], "r array<string>, m double")
    assert [r.a for r in rows.select(recovery.action_for(F.col("r"), F.col("m")).alias("a")).collect()] == ["create", "create", "rewrite", "rewrite", "create"]
    assert spark.range(1).select(recovery.plan_title(F.lit("create"), F.lit(None), F.lit(None), F.lit("how much?? ")).alias("t")).first().t == "How much"


def test_signals_of_an_unread_page(spark):
    m = {k: F.lit(None).cast(t) for k, t in {"words": "int", "title": "string", "description": "string", "images": "int", "images_alt": "int", "h1": "int", "latest_year": "int", "ttfb_ms": "int", "title_coverage": "double"}.items()}
    m |= {"schema_types": F.array().cast("array<string>"), "price_texts": F.array().cast("array<string>"), "cta_texts": F.array().cast("array<string>"), "fetch_status": F.lit("error")}
    m |= {k: F.lit(None).cast("boolean") for k in ("in_h1", "starts_title", "faq_schema", "faq_section", "viewport", "https", "noindex")}
    j = {k: F.lit(None).cast("double") for k in ("depth_confidence", "targets", "generic", "portfolio", "reviews", "cta", "identity", "type_confidence")} | {"depth": F.lit(0.9), "prices": F.lit(0.1), "page_type": F.lit("other")}
    peers = {"words": F.lit(500.0), "pages": F.lit(4), "faq_share": F.lit(0.6), "intent": F.lit("transactional")}
    found = spark.range(1).select(signals.page_signals(m, j, peers, 2026).alias("s")).first().s
    assert [(s.id, s.kind, s.source, s.confidence) for s in found] == [("no_pricing", "weakness", "judged", "high")]


def test_judge_failures(spark):
    sent = judge.requests(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, s string"), "id", F.struct("s"), F.array(F.lit("q")))
    keys = {r.id: r.request for r in sent.collect()}
    assert keys[1] == keys[2] != keys[3]
    came = spark.createDataFrame([(keys[1], "0.7", None), (keys[3], None, "timeout")], "request string, answer string, error string")
    assert {r.id: (r.answer, r.failed) for r in judge.asked(sent, came).collect()} == {1: ("0.7", False), 2: ("0.7", False), 3: (None, True)}
    with pytest.raises(PySparkException):
        judge.asked(sent, came.withColumn("error", F.lit("auth"))).collect()


def test_validated(spark):
    rows = spark.createDataFrame([(1,), (2,)], "a int")
    assert desk.validated(rows, {"positive": F.col("a") > 0}).count() == 2
    with pytest.raises(PySparkException):
        desk.validated(rows, {"small": F.col("a") < 2}).collect()


def test_unpacking():
    big = b"x" * 5000
    assert fetch.unpack(gzip.compress(big), "application/gzip", 5000) == (big, None)
    assert fetch.unpack(gzip.compress(big), None, 4999) == (None, "too_large")
    assert fetch.unpack(gzip.compress(b"\0" * (64 << 20)), None) == (None, "too_large")
    assert fetch.unpack(gzip.compress(big)[:2] + b"??", None) == (None, "broken")
    assert fetch.unpack(b"<a/>", "application/xml; x") == (b"<a/>", None) and fetch.unpack(b"..", "image/png") == (None, "not_text") and fetch.unpack(None, None) == (None, "empty")


def test_text_bodies(spark):
    rows = spark.createDataFrame([(1, bytearray(gzip.compress(b"hello")), "application/gzip"), (2, None, None)], "i int, body binary, content_type string")
    got = {r.i: (r.read.body, r.read.error) for r in fetch.text_bodies(rows).collect()}
    assert bytes(got[1][0]) == b"hello" and got[2] == (None, "empty")


def test_broken_answers(spark):
    raw = spark.createDataFrame([(1, "{"), (2, "{}"), (3, None)], "answer_id int, json string")
    for read in (adapters.output_answers, adapters.content_answers, adapters.part_answers):
        assert [(r.answer_id, r.text or "") for r in read(raw).orderBy("answer_id").collect()] == [(1, ""), (2, ""), (3, "")]


def test_mentions_of_cyrillic_names(spark):
    brands = spark.createDataFrame([("градина.example", True), ("тор.example", False), ("www.shop.example", False), ("blog.shop.example", False)], "domain string, own boolean")
    texts = ["в градината на", "градинарите", "mегаградина", "Градина.example!", "shopping at shop, twice: shop"]
    said = spark.createDataFrame(list(enumerate(texts)), "answer_id int, text string")
    got = sorted((r.answer_id, r.domain, r.at) for r in answers.mentions(said, brands).collect())
    assert got == [(0, "градина.example", 3), (3, "градина.example", 1), (4, "shop.example", 13)]
    assert {(r.domain, r.own) for r in answers.brand_table(brands).collect()} == {("градина.example", True), ("тор.example", False), ("shop.example", False)}


def test_local_modifiers(spark):
    words = ["сайт софия", "сайт в стара загора", "сайт стара", "website sofia", "hotel"]
    assert each(spark, words, ideas.has_local_modifier) == [True, True, False, False, False]


def test_choices_asked_both_ways(spark):
    sent = spark.createDataFrame([(1, "one state"), (2, "another"), (3, "third")], "id int, state string")
    choices = {"kind": ["a", "b", "c", "d"], "tone": ["x", "y"]}
    rows = {(r.id, r.wire_id): r.options for r in judge.wired(sent, choices, ["kind"]).collect()}
    assert len(rows) == 9 and rows[1, "kind"] == ["a", "b", "c", "d"] and rows[1, "kind__rev"] == ["d", "c", "b", "a"] and rows[2, "tone"] == ["x", "y"]
    mixed = judge.wired(sent, choices, ["kind"], shuffle=True)
    again = {(r.id, r.wire_id): r.options for r in mixed.collect()}
    assert again == {(r.id, r.wire_id): r.options for r in judge.wired(sent, choices, ["kind"], shuffle=True).collect()}
    assert all(sorted(x) == sorted(rows[k]) for k, x in again.items()) and len({tuple(again[i, "kind"]) for i in (1, 2, 3)}) > 1
    assert all(again[i, "kind__rev"] == again[i, "kind"][::-1] for i in (1, 2, 3))
    first = F.transform("options", lambda o, i: F.when(i == 0, 0.6).otherwise(0.4 / (F.size("options") - 1)))
    came = mixed.select("id", "wire_id", F.map_from_arrays("options", first).alias("probs")).where("not (id = 2 and wire_id = 'kind__rev')").withColumn("probs", F.when(~((F.col("id") == 3) & (F.col("wire_id") == "tone")), F.col("probs")))
    got = {(r.id, r.question_id): r for r in judge.unbiased(mixed, came).collect()}
    lean = got[1, "kind"]  # leaning to whatever is first cancels out between first and last
    assert (lean.value, lean.runner_up, lean.p) == (again[1, "kind"][0], again[1, "kind"][3], 0.367) and not lean.failed
    assert got[1, "tone"].value == again[1, "tone"][0] and got[1, "tone"].p == 0.6
    assert got[2, "kind"].failed and got[2, "kind"].value is None and got[3, "tone"].failed and got[2, "tone"].p == 0.6
    none = judge.unbiased(mixed, came.where("id = 0")).collect()
    assert len(none) == 6 and all(r.failed for r in none)


def test_cache_rounds(spark, tmp_path):
    from lumenrank.sources.cache import HOUR, LIFETIMES, Cache

    held, hour = Cache(spark, str(tmp_path / "cache"), 2 * HOUR), HOUR
    rows = lambda *r: spark.createDataFrame(list(r), "namespace string, key string, value string")
    asked = rows(("serp", "a", ""), ("serp", "b", ""), ("volume", "a", ""), ("serp", "zz", "")).drop("value")
    found = lambda now: {(r.namespace, r.key): r.value for r in held.get(asked, now).collect()}
    assert held.prune(0) == 0 and set(found(0).values()) == {None}
    held.put(rows(("serp", "a", "1"), ("serp", "a", "2"), ("serp", "b", None), ("volume", "a", "v"), ("serp", None, "x")), 0)
    assert found(1) == {("serp", "a"): "2", ("serp", "b"): None, ("volume", "a"): "v", ("serp", "zz"): None}
    assert {(r.key, r.hit) for r in held.get(asked.where("namespace = 'serp'"), 1).collect()} == {("a", True), ("b", True), ("zz", False)}
    held.put(rows(("serp", "a", "3")), hour)
    assert found(hour)["serp", "a"] == "3" and found(2 * hour)["serp", "a"] == "3" and found(3 * hour)["serp", "a"] is None
    assert held.prune(2 * hour) == 2 and found(2 * hour) == {("serp", "a"): "3", ("serp", "b"): None, ("volume", "a"): "v", ("serp", "zz"): None}
    assert [n for _, n in held._segments()] == ["whole-0000000003"]
    held.put(rows(("serp", "b", "new")), 3 * hour)
    assert found(3 * hour)["serp", "b"] == "new" and found(LIFETIMES["volume"])["volume", "a"] is None
    out = {(r.namespace, r.key): r.outcome for r in held.within_budget(asked.withColumn("n", F.length("key")), 3 * hour, [F.col("n")], 1).collect()}
    assert out == {("serp", "a"): "bought", ("serp", "b"): "hit", ("volume", "a"): "hit", ("serp", "zz"): "over_budget"}
    off = Cache(spark, str(tmp_path / "off"), 0)
    off.put(rows(("serp", "a", "1")), 0)
    assert not off.get(asked, 0).where("hit").count()


def test_cities_are_stemmed_once(spark):
    """As each city beside each word, the stems of the cities worked out before; no pattern of a stem within a pattern of another."""
    cities = [*ideas.CITIES, "web", "lom"]
    words = ["цени софия", "ремонт в софията", "стара загора", "старата загора", "варната", "русета", "уеб", "online web", "lom", "loms", "x", "", None, "добричен", "габровото"]
    stems = {T.stem_word(c) for c in cities if " " not in c}
    for w in words:
        got = spark.range(1).select(ideas.has_local_modifier(F.lit(w).cast("string"), cities).alias("x")).first().x
        assert got == (None if w is None else any(f" {c} " in f" {w} " for c in cities) or any(T.stem_word(x) in stems for x in w.split()))
    plan = spark.range(1).select(ideas.has_local_modifier(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "благоевград" in plan and plan.count("exists(") == 1 and "array_contains" not in plan
