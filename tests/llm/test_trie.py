"""The conversation trie against a plain one, on the given tables, odd rows and many ranges; its merge by itself."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from lumenrank.llm import queries, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, turns string, n long, node string, key string, at int"


def key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    groups = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            groups[c].append((turn is not None, turn or 0, key(role or "", text or "")[:16], role or "", text or ""))
    own = {c: [t[3:] for t in sorted(g)] for c, g in groups.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rest = c % 20 if c >= 0 else -(-c % 20)
        rebuilt[c] = own.get(c - rest, [])[:h] + turns[h:]
    nodes = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def checked(spark, tmp_path, rows, sql=True):
    at = str(tmp_path)
    spark.createDataFrame([(*r, "t", 1, "n", "k", 2) for r in rows], SCHEMA).repartition(5).write.parquet(f"{at}/conversations.parquet")
    found = queries.op11_conversation_trie(spark, at)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got, wanted = sorted(map(tuple, found.collect()), key=repr), brute(rows)
    assert got == wanted
    if sql:
        with duckdb.connect() as duck:
            duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{at}/conversations.parquet/*.parquet'")
            assert sorted(duck.execute(queries.ORACLE_SQL["op11_conversation_trie"]).fetchall(), key=repr) == wanted


def conversations(seed, n, alphabet, most):
    draw = random.Random(seed)
    texts = [f"{'w ' * draw.randint(0, 5)}{i}" for i in range(alphabet)]
    return [(c, t, draw.choice(["user", "assistant"]), draw.choice(texts)) for c in draw.sample(range(-n, 3 * n), n) for t in range(draw.randint(1, most))]


@pytest.fixture
def small(monkeypatch):
    """Runs, blocks and id blocks of a few rows, so that all of them are split; tasks get the values with the functions."""
    for name, value in (("RUN_TURNS", 40), ("BLOCK_TURNS", 8), ("ID_BLOCK", 16), ("SAMPLED", 2)):
        monkeypatch.setattr(trie, name, value)


def test_given_table(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    checked(spark, tmp_path, rows)


@pytest.mark.parametrize("alphabet,most", [(1, 9), (2, 6), (5, 4)])
def test_many_ranges_share_paths(spark, tmp_path, small, alphabet, most):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        checked(spark, tmp_path, conversations(alphabet, 500, alphabet, most))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_hot_conversation_and_first_turn(spark, tmp_path, small):
    draw = random.Random(2)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 600, 2) for t in range(4)]
    rows += [(c, t, "user", f"same {t}" if t < 2 else f"own {draw.randint(0, 3)}") for c in range(1, 600, 2) for t in range(draw.randint(1, 6))]
    checked(spark, tmp_path, rows, sql=False)


def test_odd_rows(spark, tmp_path):
    rows = [
        (1, 2, "assistant", "b c"), (1, 1, "user", "a\n b"), (1, None, None, None), (1, None, None, None), (1, 3, "", "x"), (1, 3, "x", ""), (1, 3, "a", "z"), (1, 3, "b", "y"),
        (0, 5, "user", None), (20, 0, "user", "only"), (21, 0, "user", "only"), (22, 0, "user", "x " * 100_000), (22, 0, "user", "x " * 100_000), (41, 0, "a", "b"), (45, 0, "a", "b"), (47, 0, "a", "b"), (48, 0, "a", "b"),
        (None, 0, "user", "lost"), (None, None, None, None), (-3, 0, "user", "é　x"), (-20, 0, "user", "negative"), (-21, 7, "user", "x"), (2**62, 0, "u", "far"), (2**62 + 1, 0, "u", "far"),
    ]
    checked(spark, tmp_path, rows)


def test_a_long_conversation(spark, tmp_path):
    rows = [(c, t, "user", f"turn {t} {c if t == 2500 else ''}") for c in (0, 1, 7) for t in range(3000)]
    at = str(tmp_path)
    spark.createDataFrame([(*r, "t", 1, "n", "k", 2) for r in rows], SCHEMA).write.parquet(f"{at}/conversations.parquet")
    found = queries.op11_conversation_trie(spark, at)
    total = found.selectExpr("count(*) n", "max(depth) d", "max(if(depth = 0, saved_tokens, 0)) s", "max(n_leaves) l").first()
    assert (total.n, total.d, total.l) == (2501 + 3 * 500, 3000, 3) and total.s == 2500 * 2 * 2


def blocks_of(runs, size=3):
    out = []
    for i, run in enumerate(runs):
        items = [trie.Item(list(k), [1] * len(k), 1, 0, "") for k in run]
        out += list(trie.run_blocks(0, i, items))
    return [trie.Block(r[1], *r[4:]) for r in sorted(out, key=lambda r: (r[1], r[2], r[3]))]


@pytest.mark.parametrize("seed", range(30))
def test_merge_orders_and_knows_what_is_common(seed, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK_TURNS", 6)
    draw = random.Random(seed)
    every = {tuple(draw.choices([b"a", b"b", b"ab"], k=draw.randint(0, 7))) for _ in range(draw.randint(0, 200))}
    runs = [[] for _ in range(draw.randint(1, 9))]
    for k in every:
        draw.choice(runs).append(k)
    got = list(trie.merged(blocks_of(runs)))
    wanted = sorted(map(list, every))
    assert [x.keys for x, _ in got] == wanted
    assert [lcp for _, lcp in got] == [trie.common(a, b) for a, b in zip([[], *wanted], wanted)]


def test_shared_turns_are_not_compared_again(monkeypatch):
    looked = 0

    class Turn(bytes):
        def __eq__(self, other):
            nonlocal looked
            looked += 1
            return bytes.__eq__(self, other)

        __hash__ = bytes.__hash__

    shared = [Turn(b"%d" % i) for i in range(200)]
    runs = [[[*shared, Turn(b"%05d" % (8 * i + r))] for i in range(100)] for r in range(8)]
    blocks = blocks_of(runs)
    looked = 0
    assert len(list(trie.merged(blocks))) == 800
    assert looked < 800 * 200 / 10 + 2 * len(blocks) * 201
