"""Aliases, crawls, suffix rules and the coverage join against plain versions."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lumenrank.operators import answers, domains, sites


def path_key(url):
    rest = url.split("://", 1)[1].split("#")[0]
    host, _, path = rest.partition("/")
    return host.removeprefix("www.") + ("/" + path).rstrip("/")


def test_aliases_name_one_page(spark):
    draw = random.Random(4)
    url = lambda i: f"https://{'www.' if i % 3 == 0 else ''}s{i % 4}.example/p{i}"
    found = [(f"s{i % 4}", n, url(i)) for n, i in enumerate(draw.choices(range(80), k=120))]
    chain = [(i, i + 1) for i in range(0, 12)] + [(20, 21), (21, 22), (22, 20), (30, 31), (32, 31), (40, 40)]
    pairs = [(url(a), url(b)) for a, b in chain + [(draw.randrange(80), draw.randrange(80)) for _ in range(15)]] + [(url(1), None), (None, url(2)), (url(3), "mailto:x"), (url(3), "https://s.example/a.pdf")]
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in pairs:
        if a and b and b.startswith("http") and not b.endswith("pdf"):
            parent[root(path_key(a))] = root(path_key(b))
    groups = collections.defaultdict(set)
    for k in list(parent):
        groups[root(k)].add(k)
    first = {}
    for host, n, u in found:
        first.setdefault(root(path_key(u)), (host, path_key(u), u, n))
    wanted = sorted((*v, len(groups[r]) if len(groups[r]) > 1 else 1) for r, v in first.items())
    got = sites.merge_aliases(spark.createDataFrame(found, "host string, ordinal int, url string").repartition(4), spark.createDataFrame(pairs, "url string, other string"))
    assert sorted(map(tuple, got.collect())) == wanted


def plain_crawl(home, asked, links, fetches, most_pages, most_depth=2):
    """Pages in the order found, one fetch after the other."""
    found, alias, seen = {path_key(home): (home, 0)}, path_key(asked) if asked else None, 1
    frontier, left = [path_key(home)], False
    for level in range(most_depth):
        ahead = []
        for k in frontier:
            if fetches is not None and seen > fetches or level and most_pages is not None and len(found) >= most_pages:
                left = True
                break
            seen += 1
            for to in links.get(k, []):
                t = path_key(to)
                if t not in found and t != alias and to.split("://")[1].split("/")[0].endswith("a.example"):
                    found[t] = (to, level + 1)
                    ahead.append(t)
        frontier = ahead
    order = {k: i for i, k in enumerate(found)}
    listed = sorted(found, key=lambda k: (order[k] > 0, k.count("/"), order[k]))
    truncated = left or most_pages is not None and len(found) > most_pages
    return [(k, *found[k], order[k], n + 1, truncated) for n, k in enumerate(listed[:most_pages])]


@pytest.mark.parametrize("seed,fetches,most_pages,depth", [(1, 60, None, 2), (2, 4, None, 2), (3, 60, 9, 2), (4, 5, 12, 2), (5, None, None, 3), (6, 1, None, 2), (7, 8, 30, 3)])
def test_crawl_as_one_fetch_after_the_other(spark, seed, fetches, most_pages, depth):
    draw = random.Random(seed)
    url = lambda h, i: f"https://{h}/" + "/".join(["d"] * (i % 3) + [f"p{i}"])
    hosts = {f"s{h}.a.example": draw.randint(1, 40) for h in range(6)}
    links, rows = {}, []
    for h, n in hosts.items():
        for i in range(n):
            if draw.random() < 0.8:
                to = [url(h, draw.randrange(n)) for _ in range(draw.randint(0, 7))] + draw.choice([[], ["https://other.example/x"], ["https://b.a.example/y"], [f"https://{h}"]])
                draw.shuffle(to)
                links[path_key(url(h, i))] = to
                rows += [(path_key(url(h, i)), k, x) for k, x in enumerate(to)]
    homes = [(h, f"https://{h}/", url(h, 0)) for h in hosts]
    got = sites.crawl(spark.createDataFrame(homes, "host string, asked string, url string"), spark.createDataFrame(rows, "from_key string, ordinal int, to_url string").repartition(3), depth, fetches, most_pages)
    by_host = collections.defaultdict(list)
    for r in got.orderBy("host", "place").collect():
        by_host[r.host].append((r.key, r.url, r.level, r.found_at, r.place, r.truncated))
    for h, asked, home in homes:
        wanted = plain_crawl(home, asked, links, None if fetches is None else fetches, most_pages, depth)
        assert by_host[h] == wanted, h


#: Rules of the published list, and what its own tests say of hosts under them.
RULES = ["com", "biz", "uk.com", "ac", "jp", "ac.jp", "kyoto.jp", "ide.kyoto.jp", "*.kobe.jp", "!city.kobe.jp", "*.ck", "!www.ck", "us", "ak.us", "k12.ak.us", "cn", "com.cn", "公司.cn"]
VECTORS = [
    ("com", None), ("example.com", "example.com"), ("WwW.Example.COM", "example.com"), ("a.b.example.com", "example.com"), (".com", None), ("example", None), ("example.example", "example.example"), ("a.b.example.example", "example.example"),
    ("biz", None), ("domain.biz", "domain.biz"), ("uk.com", None), ("example.uk.com", "example.uk.com"), ("a.b.example.uk.com", "example.uk.com"), ("test.ac", "test.ac"),
    ("jp", None), ("test.jp", "test.jp"), ("www.test.jp", "test.jp"), ("ac.jp", None), ("test.ac.jp", "test.ac.jp"), ("kyoto.jp", None), ("test.kyoto.jp", "test.kyoto.jp"), ("ide.kyoto.jp", None), ("b.ide.kyoto.jp", "b.ide.kyoto.jp"), ("a.b.ide.kyoto.jp", "b.ide.kyoto.jp"),
    ("c.kobe.jp", None), ("b.c.kobe.jp", "b.c.kobe.jp"), ("a.b.c.kobe.jp", "b.c.kobe.jp"), ("city.kobe.jp", "city.kobe.jp"), ("www.city.kobe.jp", "city.kobe.jp"), ("ck", None), ("test.ck", None), ("b.test.ck", "b.test.ck"), ("www.ck", "www.ck"), ("www.www.ck", "www.ck"),
    ("us", None), ("test.us", "test.us"), ("ak.us", None), ("test.ak.us", "test.ak.us"), ("k12.ak.us", None), ("test.k12.ak.us", "test.k12.ak.us"), ("www.test.k12.ak.us", "test.k12.ak.us"), ("食狮.公司.cn", "食狮.公司.cn"), ("公司.cn", None), ("192.168.0.1", None), ("example.com.", "example.com"), ("", None), (None, None),
]


def test_published_vectors(spark):
    rules = spark.createDataFrame([(r, False) for r in RULES], "rule string, private boolean")
    hosts = spark.createDataFrame([(h, "kept") for h, _ in VECTORS] + [("example.com", "again")], "host string, suffix string")
    got = domains.with_registrable(hosts, rules)
    assert collections.Counter((r.host, r.registrable) for r in got.collect()) == collections.Counter([*VECTORS, ("example.com", "example.com")])


def test_private_rules_and_the_list_as_published(spark):
    text = ["// ===BEGIN ICANN DOMAINS===", "", "com", "// x", "*.ck  // note", "// ===END ICANN DOMAINS===", "// ===BEGIN PRIVATE DOMAINS===", "Blogspot.com", "// ===END PRIVATE DOMAINS===", "net"]
    rules = domains.parse_suffix_list(spark.createDataFrame(list(enumerate(text)), "ordinal int, value string"))
    assert sorted(map(tuple, rules.collect())) == [("*.ck", False), ("blogspot.com", True), ("com", False), ("net", False)]
    hosts = spark.createDataFrame([("a.b.blogspot.com",), ("x.y.ck",)], "host string")
    for private, wanted in ((True, {("b.blogspot.com", "blogspot.com"), ("x.y.ck", "y.ck")}), (False, {("blogspot.com", "com"), ("x.y.ck", "y.ck")})):
        assert {(r.registrable, r.suffix) for r in domains.with_registrable(hosts, rules, private=private).collect()} == wanted


def plain_pairs(questions, pages, least=0.12, k=3):
    out = []
    for scope, q, terms in questions:
        scored = []
        for s, url, head, intro in pages:
            parts = sum(7 * (t in head) + 3 * (t in intro) for t in terms)
            overlap = (parts * 200 + len(terms)) // (2 * len(terms)) / 1000
            if s == scope and overlap >= least:
                scored.append((-overlap, url))
        out += [(q, u, -o, n + 1) for n, (o, u) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_coverage_by_rare_terms(spark):
    draw = random.Random(9)
    words, hot = [f"w{i}" for i in range(400)], ["hot", "warm", "the"]
    pick = lambda n, with_hot: sorted({*draw.sample(words, n), *(hot if with_hot else [])})
    questions = [("ab"[i % 2], i, pick(draw.randint(1, 15), i % 10)) for i in range(60)] + [("a", 100, ["hot"]), ("b", 101, ["warm", "w1"])]
    pages = [("ab"[i % 2], f"u{i}", pick(draw.randint(0, 6), False), pick(draw.randint(0, 20), i % 12)) for i in range(150)] + [("a", "x", ["hot"], [])]
    q = spark.createDataFrame(questions, "scope string, question_id long, terms array<string>")
    p = spark.createDataFrame(pages, "scope string, url string, head array<string>, intro array<string>")
    assert sorted(map(tuple, answers.coverage_pairs(q, p).collect())) == plain_pairs(questions, pages)
    sharing = sum(s == t and bool({*terms} & {*h, *i}) for s, _, terms in questions for t, _, h, i in pages)
    near = answers.coverage_candidates(q, p).count()
    assert near < 0.6 * sharing, (near, sharing)
    found = {(r.question_id, r.url) for r in answers.coverage_candidates(q, p).collect()}
    assert {(a, b) for a, b, _, _ in plain_pairs(questions, pages, k=10**6)} <= found
