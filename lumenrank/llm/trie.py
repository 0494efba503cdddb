"""Prefix trie of conversations by an external mergesort that carries common prefixes.

A turn is 128 bits of the SHA-256 of role and text, and its number of words; texts are read once and never shuffled.
Conversations of equal turns are one sequence, with their number, smallest id and the digest of their ids, which come
as joined blocks of an id range, so that a sequence of very many conversations is a row a block to the task that digests them.

Sequences are dealt to ranges, cut at sequences from a sample. A range's task forms sorted runs of bounded size, each sequence
stored as how many turns it has in common with the one before it (its LCP) and the rest; runs leave the task in blocks. These come
back ordered by their first sequences, so that a block is opened only when the merge has come to it: memory holds one block a
run. A loser tree merges the opened ones: players whose LCPs with the last winner differ need no look at their turns, others are compared from
there on. A block that opens takes part with LCPs got from those in the tree, without comparing again.

The merged stream has an open path on a stack: what the next sequence does not share is finished, adds its sums to its parent and
goes out. All sums of a node are over sequences and over the nodes that a sequence brings in, so a node that goes over ranges comes
out in parts that add up: a task knows the sequence that the next range begins with, and takes back what both count. Only
nodes on such paths are grouped again.

Rows: a null role or text counts as empty; turns of one place (null first) stand by their digests, repeated rows each for
itself; rows of a null conversation belong to none; one conversation's turns are together in a task, as digests; an empty
table has no conversation and so no node, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, listed, materialize, partition_keys, width

WORDS = r"[^\x20\x09-\x0D]+"
#: Conversations of one range of so many ids come as one row to the task that digests a sequence's ids.
ID_BLOCK = 4096
#: Turns of a run, and of a block of a run, at which it ends.
RUN_TURNS, BLOCK_TURNS = 1 << 18, 1 << 12
#: Sequences sampled for each range's bound, of at most so many turns each.
SAMPLED, BOUND_TURNS = 8, 1 << 10
_EMPTY = hashlib.sha256(b"").hexdigest()

Turns = list[bytes]


def turns_of(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (at, key, words)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("at"), key.alias("key"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_shared_heads(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation with its first turns, crc32 of its id modulo ``most``, taken from the first conversation of its ``every``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    named = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return named.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def sequences(convs: DataFrame) -> DataFrame:
    """(seq, keys, words, n, low, ends): the different sequences of turns, how many conversations are just that, the smallest
    of their ids, and the SHA-256 of all of these in order, joined by commas."""
    keys = F.transform("turns", lambda t: t["key"])
    seq = F.unhex(F.substring(F.sha2(F.array_join(F.transform(keys, F.hex), ""), 256), 1, 32))
    named = convs.select("conv_id", seq.alias("seq"), keys.alias("keys"), F.transform("turns", lambda t: t["words"]).alias("words"), (F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(ID_BLOCK))).alias("block"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = named.groupBy("seq", "block").agg(F.first("keys").alias("keys"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seq", "keys", "words", "n", "low", "ends"]

        def out(rows: list[list]) -> pa.RecordBatch:
            kinds = (pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

        now, digest = None, None
        for b in (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256)):
            done = []
            for seq, keys, words, n, low, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is not None and now[0] == seq:
                    digest.update(b"," + ids.encode())
                    now[3] += n
                    now[4] = min(now[4], low)
                    continue
                if now is not None:
                    done.append([*now, digest.hexdigest()])
                now, digest = [seq, keys, words, n, low], hashlib.sha256(ids.encode())
            yield out(done)
        if now is not None:
            yield out([[*now, digest.hexdigest()]])

    dealt = blocks.repartition("seq").sortWithinPartitions("seq", "block").select("seq", "keys", "words", "n", "low", "ids")
    return dealt.mapInArrow(run, "seq binary, keys array<binary>, words array<long>, n long, low long, ends string")


def common(a: Turns, b: Turns, known: int = 0) -> int:
    """How many turns both begin with, given that it is ``known`` or more."""
    most = min(len(a), len(b))
    while known < most and a[known] == b[known]:
        known += 1
    return known


@dataclass
class Item:
    keys: Turns
    words: list[int]
    n: int
    low: int
    ends: str


class Block:
    """A block of a run being read: ``item`` is the sequence it stands at, ``lcp`` what that has in common with the player it
    lost to, or with the last winner."""

    def __init__(self, head: Turns, lcps: list[int], keys: list[Turns], words: list[list[int]], n: list[int], low: list[int], ends: list[str]):
        self._rest = zip(lcps[1:], keys, words[1:], n[1:], low[1:], ends[1:], strict=True)
        self.item: Item | None = Item(head, words[0], n[0], low[0], ends[0])
        self.lcp = 0

    def advance(self) -> None:
        """To the next sequence, whose LCP with the one before it the run carries."""
        for lcp, keys, words, n, low, ends in self._rest:
            self.item, self.lcp = Item(self.item.keys[:lcp] + keys, self.item.words[:lcp] + words, n, low, ends), lcp
            return
        self.item = None


def beats(a: Block, b: Block) -> bool:
    """Whether a comes before b, whose LCPs are with one sequence that is before both; the loser's becomes that with the winner."""
    if a.item is None or b.item is None:
        return b.item is None
    if a.lcp != b.lcp:
        return a.lcp > b.lcp
    at = common(a.item.keys, b.item.keys, a.lcp)
    first = a.item.keys[at:] < b.item.keys[at:]
    (b if first else a).lcp = at
    return first


class LoserTree:
    """Opened blocks by their next sequences. Leaves are nodes k to 2k-1; an inner node keeps who won and who lost there."""

    def __init__(self):
        self._fill([])

    def _fill(self, players: list[Block]) -> None:
        k = self.k = len(players)
        self.won: list[Block | None] = [None] * k + players
        self.lost: list[Block | None] = [None] * k
        for node in range(k - 1, 0, -1):
            self._play(node, self.won[2 * node], self.won[2 * node + 1])
        self.leaf = {id(p): k + i for i, p in enumerate(players)}

    def _play(self, node: int, a: Block, b: Block) -> None:
        self.won[node], self.lost[node] = (a, b) if beats(a, b) else (b, a)

    def top(self) -> Block | None:
        found = self.won[1] if self.k else None
        return None if found is None or found.item is None else found

    def advance(self) -> None:
        """Takes the winner's next sequence; it meets those who lost to it on its way up."""
        top = self.won[1]
        top.advance()
        node = self.leaf[id(top)] // 2
        while node:
            self._play(node, self.won[2 * node], self.won[2 * node + 1])
            node //= 2

    def _with_winner(self) -> list[Block]:
        """Players not at their end, with LCPs with the winner: the least on the way to it."""
        found, todo = [], [(1, self.top())] if self.top() else []
        while todo:
            node, best = todo.pop()
            if node >= self.k:
                if best.item is not None:
                    found.append(best)
                continue
            loser = self.lost[node]
            if best is not self.won[1]:
                loser.lcp = min(loser.lcp, best.lcp)
            todo += [(child, self.won[child]) for child in (2 * node, 2 * node + 1)]
        return found

    def enter(self, block: Block) -> None:
        """A block that comes before all others; the winner's LCP is already that with it, its own that with the last sequence out."""
        own, top = block.lcp, self.top()
        players = self._with_winner()
        for p in players:
            p.lcp = min(p.lcp, top.lcp)
        block.lcp = len(block.item.keys) + 1
        self._fill([*players, block])
        block.lcp = own


def merged(blocks: Iterable[Block]) -> Iterator[tuple[Item, int]]:
    """All sequences in order, with the LCP of each with the one before it, from blocks in order of their first."""
    tree, last, rest = LoserTree(), None, iter(blocks)
    waiting = next(rest, None)
    while waiting is not None or tree.top() is not None:
        top = tree.top()
        if waiting is not None and (top is None or beats(waiting, top)):
            tree.enter(waiting)
            waiting = next(rest, None)
            if waiting is not None and last is not None:
                waiting.lcp = common(waiting.item.keys, last.keys)
            continue
        last, lcp = top.item, top.lcp
        tree.advance()
        yield last, lcp


class Path:
    """The open path of a range's merged stream; ``take`` and ``end`` give what is finished as
    (node, parent, depth, low, n, children, leaves, saved, ends, parts)."""

    #: Places in a frame: node, low, n, children, leaves, saved, ends, words, whether the range begins with it.
    NODE, LOW, N, CHILDREN, LEAVES, SAVED, ENDS, WORDS, FIRST = range(9)

    def __init__(self):
        self.frames: list[list] = []
        self.began = False

    @staticmethod
    def root() -> bytes:
        return hashlib.blake2b(b"", digest_size=16).digest()

    def _row(self, frame: list, depth: int, parts: bool) -> tuple:
        parent = self.frames[depth - 1][self.NODE] if depth else None
        return (frame[self.NODE], parent, depth, *frame[self.LOW : self.ENDS + 1], parts)

    def _close(self, keep: int) -> Iterator[tuple]:
        """Finishes what is deeper than ``keep``."""
        while len(self.frames) > keep + 1:
            depth = len(self.frames) - 1
            yield self._row(self._counted(depth, leaf=True), depth, self.frames[depth][self.FIRST])
            self.frames.pop()

    def _counted(self, depth: int, leaf: bool) -> list:
        """The deepest frame with its own share, which it hands to its parent."""
        f = self.frames[depth]
        f[self.SAVED] += (f[self.N] - 1) * f[self.WORDS]
        if leaf and not f[self.CHILDREN]:
            f[self.LEAVES] = 1
        if depth:
            up = self.frames[depth - 1]
            up[self.LOW] = min(up[self.LOW], f[self.LOW])
            up[self.CHILDREN] += 1
            for at in (self.N, self.LEAVES, self.SAVED):
                up[at] += f[at]
        return f

    def take(self, item: Item, lcp: int) -> Iterator[tuple]:
        yield from self._close(lcp if self.frames else -1)
        for depth in range(len(self.frames), len(item.keys) + 1):
            node = hashlib.blake2b(self.frames[-1][self.NODE] + item.keys[depth - 1], digest_size=16).digest() if depth else self.root()
            self.frames.append([node, item.low, 0, 0, 0, 0, None, item.words[depth - 1] if depth else 0, not self.began])
        self.began = True
        f = self.frames[-1]
        f[self.LOW], f[self.ENDS] = min(f[self.LOW], item.low), item.ends
        f[self.N] += item.n

    def end(self, lcp: int) -> Iterator[tuple]:
        """The range ends; the next begins with a sequence of this LCP (-1: there is none). What both have on their paths both
        count as brought in, so it is taken back here."""
        yield from self._close(lcp)
        twice = 0
        for depth in range(len(self.frames) - 1, -1, -1):
            row = list(self._row(self._counted(depth, leaf=False), depth, True))
            twice += self.frames[depth][self.WORDS]
            row[5] -= depth < lcp
            row[7] += twice
            yield tuple(row)
        self.frames, self.began = [], False


def _block_row(place: tuple[int, int, int], items: list[Item], lcps: list[int]) -> tuple:
    """(range, head, run, at, lcps, keys after the head's, words, n, low, ends), each sequence without what the one before has."""
    rest = [0, *lcps[1:]]
    return (place[0], items[0].keys, place[1], place[2], lcps, [x.keys[k:] for x, k in zip(items[1:], rest[1:], strict=True)], [x.words[k:] for x, k in zip(items, rest, strict=True)], [x.n for x in items], [x.low for x in items], [x.ends for x in items])


def run_blocks(part: int, run: int, items: list[Item]) -> Iterator[tuple]:
    """Rows of the blocks of one sorted run."""
    items.sort(key=lambda x: x.keys)
    at, block, lcps, size, before = 0, [], [], 0, None
    for x in items:
        if block and size + len(x.keys) > BLOCK_TURNS:
            yield _block_row((part, run, at), block, lcps)
            at, block, lcps, size = at + 1, [], [], 0
        lcps.append(common(before, x.keys) if before is not None else 0)
        block.append(x)
        size, before = size + len(x.keys) + 1, x.keys
    if block:
        yield _block_row((part, run, at), block, lcps)


_BLOCKS = "part int, head array<binary>, run long, at int, lcps array<int>, keys array<array<binary>>, words array<array<long>>, n array<long>, low array<long>, ends array<string>"
_BLOCK_KINDS = (pa.int32(), pa.list_(pa.binary()), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.binary())), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
_NODES = "node binary, parent binary, depth long, low long, n long, children long, leaves long, saved long, ends string, parts boolean"
_NODE_KINDS = (pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.string(), pa.bool_())


def _batch(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in schema.split(", ")])


def _gathered(rows: Iterable[tuple], kinds: tuple, schema: str, most: int) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield _batch(held, kinds, schema)
            held = []
    yield _batch(held, kinds, schema)


def _rows(batches: Iterable[pa.RecordBatch], step: int) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield from zip(*(c.to_pylist() for c in b.slice(at, step).columns), strict=True)


def bounds_of(found: DataFrame, ranges: int) -> list[Turns]:
    """At most ranges-1 sequences of the table, ascending: every SAMPLED-th of those with the least digests, which are a sample."""
    sample = found.where(F.size("keys").between(1, BOUND_TURNS)).orderBy("seq").limit(SAMPLED * ranges).select("keys").collect()
    ordered = sorted([bytes(k) for k in r.keys] for r in sample)
    step = max(1, -(-len(ordered) // ranges))
    return ordered[step::step]


def node_parts(found: DataFrame) -> DataFrame:
    """Rows of _NODES of all nodes; those with ``parts`` come out once a range and add up."""
    spark = found.sparkSession
    ranges = width(spark)
    bounds = bounds_of(found, ranges)
    key = F.element_at(listed(partition_keys(spark, ranges)), F.col("part") + 1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (batch.slice(at, 1024) for batch in batches for at in range(0, batch.num_rows, 1024)):
            parts = [bisect_right(bounds, k) for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *b.columns], ["part", "keys", "words", "n", "low", "ends"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            part, run, items, size = None, 0, [], 0
            for p, keys, words, n, low, ends in _rows(batches, 1024):
                if items and (p != part or size > RUN_TURNS):
                    yield from run_blocks(part, run, items)
                    run, items, size = run + 1, [], 0
                part = p
                items.append(Item(keys, words, n, low, ends))
                size += len(keys) + 1
            if items:
                yield from run_blocks(part, run, items)

        yield from _gathered(rows(), _BLOCK_KINDS, _BLOCKS, 16)

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _rows(batches, 1)
        row = next(stream, None)

        def of_range(part: int) -> Iterator[Block]:
            nonlocal row
            while row is not None and row[0] == part:
                yield Block(row[1], *row[4:])
                row = next(stream, None)

        def rows() -> Iterator[tuple]:
            path = Path()
            while row is not None:
                part, last = row[0], []
                for item, lcp in merged(of_range(part)):
                    last = item.keys
                    yield from path.take(item, lcp)
                yield from path.end(common(last, bounds[part]) if part < len(bounds) else -1)

        yield from _gathered(rows(), _NODE_KINDS, _NODES, 4096)

    apart = found.select("keys", "words", "n", "low", "ends").mapInArrow(placed, "part int, keys array<binary>, words array<long>, n long, low long, ends string")
    blocks = apart.repartition(ranges, key).sortWithinPartitions("part").mapInArrow(runs, _BLOCKS)
    return blocks.repartition(ranges, key).sortWithinPartitions("part", "head", "run", "at").mapInArrow(nodes, _NODES)


def prefix_trie(convs: DataFrame) -> DataFrame:
    """A row for each different beginning of the conversations (conv_id, turns): conv_id, the smallest with it; depth; parent_conv_id;
    n_convs; n_children; n_leaves and saved_tokens of its subtree; ends_sha256."""
    found = materialize(sequences(convs), "trie-sequences")
    parts = materialize(node_parts(found), "trie-parts")
    whole = parts.where("parts").groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("low").alias("low"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.max("ends").alias("ends"), F.lit(True).alias("parts"),
    )
    nodes = materialize(parts.where("not parts").unionByName(whole), "trie-nodes")
    for done in (found, parts):
        discard(done)
    above = nodes.where("children > 0").select(F.col("node").alias("parent"), F.col("low").alias("parent_conv_id"))
    return nodes.join(above, "parent", "left").select(
        F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"),
    )
