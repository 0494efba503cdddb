"""Greedy clusterings whose result depends on the order, over scopes of any size.

Headings: one joins the cluster whose union of terms it is most like. A cluster gets its second set of terms by one that is like its first, so sets
like no other never open one of more. Those like another are found by prefixes of their rarest terms, and what they tie together, a part, is taken in order in
one task, in a stream. Then every set is compared with every union that a cluster of another part has been: where they are like, both parts are taken
again as one, until there are none. No set has then met a cluster of another part, at any time, so that all of the scope in order would have given the same.

Questions: one joins the first cluster with a member like it. Its cluster is then that of the least question it reaches over ever
earlier similar ones, so the clusters are a least label on a graph of edges to earlier questions; nothing is taken in order. Questions of so few terms that one
in common makes them similar are chained term by term; the others are paired by prefixes of their rarest terms and verified as sets, and copies
are chained, so that a pair of sets has as many edges as its questions alternate.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import discard, written
from .graph import components, least_reached
from .ranking import top_per

_EPS = 1e-9


def _joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name in which null is a value."""
    named = b.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in b.columns])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    return a.join(named, same, how).drop(*[f"__{c}" for c in on])


class Greedy:
    """The clusters of one component; each heading joins the one whose terms it is most like, the first of equals, or opens one."""

    def __init__(self, least: float):
        self.least, self.unions, self.by_term, self.same, self.grew = least, [], {}, {}, False

    def add(self, terms: frozenset[str]) -> int:
        self.grew, n = False, len(terms)
        # nothing is more like a heading than a union of its very terms
        if equal := self.same.get(terms):
            return min(equal)
        # a union of one term or more that is like enough has this many of the terms, so one of the rarest n - needed + 1
        needed = max(1, -int(-(self.least * (n + 1) / (1 + self.least) - _EPS) // 1))
        rarest = sorted(terms, key=lambda t: len(self.by_term.get(t, ())))[: n - needed + 1]
        best, at = 0.0, -1
        for c in sorted(set().union(*(self.by_term.get(t, ()) for t in rarest))):
            both = len(terms & self.unions[c])
            like = both / (n + len(self.unions[c]) - both)
            if like >= self.least and like > best:
                best, at = like, c
        if at < 0:
            at = len(self.unions)
            self.unions.append(frozenset())
        elif not terms <= self.unions[at]:
            self.grew = True
            self.same[self.unions[at]].discard(at)
        union = self.unions[at]
        if not terms <= union:
            for t in terms - union:
                self.by_term.setdefault(t, set()).add(at)
            self.unions[at] = union | terms
            self.same.setdefault(self.unions[at], set()).add(at)
        return at


def _ranked(sets: DataFrame) -> DataFrame:
    """``sets(scope, id, terms)`` with ``ordered``: the terms, the rarest in the scope first, and ``size``."""
    each = sets.select("scope", "id", F.explode("terms").alias("term"))
    found = each.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))
    ordered = _joined(each, found, ["scope", "term"]).groupBy("scope", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "term"))), lambda x: x["term"]).alias("ordered"))
    return ordered.withColumn("size", F.size("ordered"))


#: Words whose numbers a task holds, and terms whose counts order the others: rarer ones come first, whatever their counts.
KNOWN, COUNTED = 200_000, 1 << 16
_SIG = [f"s{k}" for k in range(4)]


def _with_terms(rows: DataFrame) -> DataFrame:
    """``rows(scope, ordinal, doc, heading)`` with ``terms``: the different ``T.terms`` of the heading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = T.Vocabulary()
        for b in batches:
            found = []
            for text in b.column(3).to_pylist():
                if len(vocabulary) >= KNOWN:
                    vocabulary.forget()
                numbers = [vocabulary[w] for w in T.parts(text or "", False)]
                found.append(list(dict.fromkeys(vocabulary.keys[vocabulary.key[k]] for k in numbers if vocabulary.kind[k] & 3 == 2)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], [*b.schema.names, "terms"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", terms array<string>")


def _ordered(sets: DataFrame, counts: dict[str, int]) -> DataFrame:
    """``sets(scope, id, terms)`` as (scope, id, ordered, size, s0 to s3, a, b): the terms, the rarest first, 256 bits of them, and two hashes
    that sets have the more often the same the more like they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ordered, bits, one, two = [], [], [], []
            for terms in b.column(2).to_pylist():
                hashes, found = [zlib.crc32(t.encode()) for t in terms], 0
                for h in hashes:
                    found |= 1 << (h & 255)
                ordered.append(sorted(terms, key=lambda t: (counts.get(t, 0), t)))
                bits.append(found.to_bytes(32, "little"))
                one.append(min(hashes))
                two.append(min(h * 0x9E3779B1 & 0xFFFFFFFF for h in hashes))
            packed = np.frombuffer(b"".join(bits), "<i8").reshape(-1, 4)
            columns = [b.column(0), b.column(1), pa.array(ordered, pa.list_(pa.string())), pa.array([len(t) for t in ordered], pa.int32())]
            columns += [pa.array(packed[:, k].copy(), pa.int64()) for k in range(4)] + [pa.array(one, pa.int64()), pa.array(two, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["scope", "id", "ordered", "size", *_SIG, "a", "b"])

    kind = sets.schema["scope"].dataType.simpleString()
    return sets.select("scope", "id", "terms").mapInArrow(run, f"scope {kind}, id long, ordered array<string>, size int, s0 long, s1 long, s2 long, s3 long, a long, b long")


def _needed(n: Column, m: Column, least: float) -> Column:
    """How many terms sets of n and m have in common if they are like enough."""
    return F.ceil((n + m) * (least / (1 + least)) - _EPS)


def _postings(ordered: DataFrame, name: str, of: Column) -> DataFrame:
    """One row for each of the rarest terms of a set, all but ``of`` and one more."""
    rarest = F.posexplode(F.slice("ordered", F.lit(1), (F.col("size") - of + 1).cast("int"))).alias(f"{name}_at", "term")
    each = ordered.select("scope", F.col("id").alias(name), F.col("part").alias(f"{name}_part"), F.col("size").alias(f"{name}_size"), *[F.col(k).alias(f"{name}_{k}") for k in _SIG], rarest)
    return each.withColumn("key", F.xxhash64("scope", "term")).drop("scope", "term")


def _candidates(c: DataFrame, d: DataFrame, order: Column | None, least: float) -> DataFrame:
    """(c, d, c_part, d_part) of sets of different parts that may be like enough: at a term of both, enough are left of each and as many bits are the same."""
    n, m = F.col("c_size"), F.col("d_size")
    lacks = lambda x, y: reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{x}_{k}").bitwiseAND(F.bitwise_not(F.col(f"{y}_{k}")))) for k in _SIG])
    left = F.least(n - F.col("c_at"), m - F.col("d_at"))
    may = (F.col("c_part") != F.col("d_part")) & (left >= _needed(n, m, least)) & (n - lacks("c", "d") >= _needed(n, m, least)) & (m - lacks("d", "c") >= _needed(n, m, least))
    on = c["key"] == d["key"]
    return c.join(d, on & may if order is None else on & order & may).select("c", "d", "c_part", "d_part").distinct()


def _like(found: DataFrame, c_sets: DataFrame, d_sets: DataFrame, least: float) -> DataFrame:
    """The rows of ``found(c, d, ...)`` whose sets are like enough."""
    for name, sets in (("c", c_sets), ("d", d_sets)):
        found = found.join(sets.select(F.col("id").alias(name), F.col("ordered").alias(f"{name}_terms")), name)
    both = F.size(F.array_intersect("c_terms", "d_terms"))
    return found.where(both >= (F.size("c_terms") + F.size("d_terms") - both) * F.lit(least) - _EPS).drop("c_terms", "d_terms")


def _pairs_of_parts(found: DataFrame) -> DataFrame:
    return found.select(F.col("c_part").alias("u"), F.col("d_part").alias("v"))


def _placed(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """``sets`` with ``part``, of a set that ``parts`` does not have its own id."""
    return sets.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id"))


def _moved(parts: DataFrame, new: DataFrame) -> DataFrame:
    """``parts(id, part)`` after ``new(node, label)`` of parts; a node that was a part of its own may not have been among them."""
    both = parts.join(new.select(F.col("node").alias("part"), "label"), "part", "left").select("id", F.coalesce("label", "part").alias("part"))
    return both.unionByName(new.select(F.col("node").alias("id"), F.col("label").alias("part"))).groupBy("id").agg(F.min("part").alias("part"))


def first_parts(ordered: DataFrame, least: float) -> DataFrame:
    """(id, part) of all sets that are like another one, or of the id of another one: those that are joined by a chain of such are one part."""
    stars = ordered.select("id", F.explode(F.array(*[F.xxhash64(F.lit(k), "scope", F.col(k)) for k in ("a", "b")])).alias("star"))
    firsts = stars.groupBy("star").agg(F.min("id").alias("c"), F.max("id").alias("last")).where("c < last").drop("last")
    # many copies that differ little are tied to one of them, and not compared with one another
    near = components(_like(stars.join(firsts, "star").where("id <> c").select("c", F.col("id").alias("d")).distinct(), ordered, ordered, least).select(F.col("c").alias("u"), F.col("d").alias("v")))
    near = near.select(F.col("node").alias("id"), F.col("label").alias("part"))
    placed = written(_placed(ordered.select("scope", "id", "ordered", "size", *_SIG), near), "cluster-near")
    few, many = F.ceil(F.col("size") * (2 * least / (1 + least)) - _EPS), F.ceil(F.col("size") * least - _EPS)
    order = (F.col("c_size") < F.col("d_size")) | (F.col("c_size") == F.col("d_size")) & (F.col("c") < F.col("d"))
    found = written(_candidates(_postings(placed, "c", few), _postings(placed, "d", many), order, least), "cluster-candidates")
    joined = components(_pairs_of_parts(_like(found, ordered, ordered, least)))
    twice = ordered.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.col("id").alias("part"))
    out = written(_moved(near.unionByName(twice).groupBy("id").agg(F.min("part").alias("part")), joined), "cluster-parts")
    for done in (placed, found):
        discard(done)
    return out


def set_id() -> Column:
    return F.xxhash64(F.lit("set"), "scope", "terms")


def _taken(rows: DataFrame, least: float) -> DataFrame:
    """``rows(scope, part, ordinal, doc, heading, terms)``, each part in order, with ``cluster`` and, if the heading made its cluster larger, the ``union`` of terms."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, greedy = None, Greedy(least)
        for b in batches:
            place, unions = [], []
            for scope, part, terms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(5).to_pylist(), strict=True):
                if (scope, part) != now:
                    now, greedy = (scope, part), Greedy(least)
                at = greedy.add(frozenset(terms))
                place.append(at)
                unions.append(sorted(greedy.unions[at]) if greedy.grew else None)
            columns = [b.column(0), b.column(1), pa.array(place, pa.int32()), *(b.column(k) for k in (2, 3, 4)), pa.array(unions, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["scope", "part", "cluster", "ordinal", "doc", "heading", "union"])

    dealt = rows.select("scope", "part", "ordinal", "doc", "heading", "terms").repartition("scope", "part").sortWithinPartitions("scope", "part", "ordinal", "doc", "heading")
    return dealt.mapInArrow(run, f"scope {kinds['scope']}, part long, cluster int, ordinal {kinds['ordinal']}, doc string, heading string, union array<string>")


def heading_clusters(headings: DataFrame, least: float = 0.4, ignore: Column | None = None) -> DataFrame:
    """(scope, part, cluster, ordinal, doc, heading): part and cluster name a cluster within the scope. Headings without terms are left out;
    those of one ordinal follow one another by document and text."""
    named = _with_terms(headings.select("scope", "ordinal", F.col("doc").cast("string").alias("doc"), "heading"))
    terms = F.col("terms") if ignore is None else F.array_except("terms", ignore)
    rows = written(named.withColumn("terms", F.array_sort(terms)).where(F.size("terms") > 0).withColumn("id", set_id()), "cluster-headings")
    sets = written(rows.select("scope", "id", "terms").distinct(), "cluster-sets")
    often = sets.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "term").limit(COUNTED)
    counts = {r.term: r.n for r in often.collect()}
    ordered = written(_ordered(sets, counts), "cluster-ordered")
    parts = first_parts(ordered, least)
    many = F.ceil(F.col("size") * least - _EPS)
    found, changed = [], parts
    while True:
        taken = written(_taken(rows.join(changed, "id"), least), "cluster-taken")
        found.append(taken.drop("union"))
        grown = taken.where("union is not null").select("scope", "part", F.col("union").alias("terms")).distinct()
        grown = grown.withColumn("id", F.xxhash64(F.lit("union"), "scope", "part", "terms"))
        unions = written(_ordered(grown, counts).join(grown.select("id", "part").distinct(), "id"), "cluster-unions")
        # a set that is like what a cluster of another part ever was may have joined it: both parts are taken again as one
        met = _candidates(_postings(unions, "c", many), _postings(_placed(ordered, parts), "d", many), None, least)
        new = components(_pairs_of_parts(_like(met, unions, ordered, least)))
        discard(unions)
        if new.isEmpty():
            break
        found = [f.join(new.select(F.col("node").alias("part")), "part", "left_anti") for f in found]
        parts = written(_moved(parts, new), "cluster-parts")
        changed = parts.join(new.select(F.col("label").alias("part")).distinct(), "part", "left_semi")
    for done in (sets, ordered):
        discard(done)
    alone = rows.join(parts, "id", "left_anti").withColumns({"part": F.col("id"), "cluster": F.lit(0)})
    columns = ["scope", "part", "cluster", "ordinal", "doc", "heading"]
    return reduce(DataFrame.unionByName, [f.select(*columns) for f in (*found, alone)])


#: What names a cluster of headings.
OF = ["scope", "part", "cluster"]


def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy(*OF, "heading").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ordinal", "doc")).alias("first"))


def _topics(each: DataFrame) -> DataFrame:
    return each.groupBy(*OF).agg(F.min_by("heading", F.struct(-F.col("n"), F.length("heading"), F.col("heading"))).alias("topic"))


def cluster_pages(found: DataFrame) -> DataFrame:
    return found.groupBy(*OF).agg(F.count_distinct("doc").alias("pages"))


def topics_of(found: DataFrame, kept: DataFrame) -> DataFrame:
    """``kept``, some of the clusters of ``found``, with their ``topic``, as ``cluster_headings`` has it."""
    return _joined(kept, _topics(_counted(_joined(found, kept.select(*OF), OF, "left_semi"))), OF)


def cluster_headings(headings: DataFrame, least: float = 0.4, ignore: Column | None = None) -> DataFrame:
    """(scope, topic, pages, examples) from (scope, ordinal, doc, heading), each scope by itself; the terms of ``ignore``, an array, do not
    count. The topic is the most frequent heading (of equals the shorter, then the lesser), examples the first three different ones."""
    found = written(heading_clusters(headings, least, ignore), "cluster-found")
    each = _counted(found)
    shown = top_per(each, OF, [F.col("first"), F.col("heading")], 3, "place").groupBy(*OF).agg(F.sort_array(F.collect_list(F.struct("place", "heading"))).alias("x"))
    return _joined(_joined(cluster_pages(found), _topics(each), OF), shown, OF).select("scope", "topic", "pages", F.transform("x", lambda e: e["heading"]).alias("examples"))


def _chained(rows: DataFrame, few: Column) -> DataFrame:
    """Edges of questions similar by one term: each to the last of ``few`` terms before it that has the term, and the next of few terms to those in between."""
    each = rows.select("scope", "v", few.alias("few"), F.explode("terms").alias("term"))
    with_few = each.where("few").select("scope", "term").distinct()
    met = _joined(each, with_few, ["scope", "term"], "left_semi")
    before = Window.partitionBy("scope", "term").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda order: F.last(F.when(F.col("few"), F.col("v")), ignorenulls=True).over(before.orderBy(order))
    back = met.select("v", last(F.col("v")).alias("u")).where("u is not null").select(F.col("v").alias("u"), F.col("u").alias("v"))
    ahead = met.select("few", "v", last(F.desc("v")).alias("u")).where("u is not null and not few").select("u", "v")
    return back.unionByName(ahead)


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """(c, d), c < d: sets of ``sets(scope, id, terms)`` that share ``least`` of the smaller one's terms or more. The smaller one's rarest terms,
    all but as many as it must share and one more, find the others; sets of more terms than ``1 / least`` each. Sets are compared where they meet, at the rarest
    term of both, so that no pair but a similar one leaves the join, and that once."""
    ranked = written(_ranked(sets), "question-sets")
    needed = lambda n: F.ceil(n * least - _EPS)
    every = ranked.select("scope", F.col("id").alias("d"), F.col("size").alias("d_size"), F.col("ordered").alias("d_terms"), F.posexplode("ordered").alias("j", "term"))
    asks = ranked.select("scope", F.col("id").alias("c"), F.col("size").alias("c_size"), F.col("ordered").alias("c_terms"), F.posexplode("ordered").alias("i", "term"))
    asks = asks.where(F.col("i") <= F.col("c_size") - needed(F.col("c_size")))
    met = _joined(asks, every, ["scope", "term"]).where("c_size < d_size or c_size = d_size and c < d")
    # nothing is shared before the rarest term of both
    near = met.where(F.least(F.col("c_size") - F.col("i"), F.col("d_size") - F.col("j")) >= needed(F.col("c_size")))
    both = near.withColumn("both", F.array_intersect("c_terms", "d_terms")).where((F.size("both") >= needed(F.col("c_size"))) & (F.get("both", F.lit(0)) == F.col("term")))
    return both.select(F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d"))


def _alternations(rows: DataFrame, least: float) -> DataFrame:
    """Edges of questions of more terms: to the one before of the same set, and between similar sets wherever their questions alternate. A set is
    named by its first question."""
    same = Window.partitionBy("scope", "terms")
    named = written(rows.select("scope", "v", F.array_sort("terms").alias("terms")).withColumns({"id": F.min("v").over(same), "copies": F.count(F.lit(1)).over(same)}), "question-members")
    sets = named.where("id = v").select("scope", "id", "terms", "copies")
    pairs = similar_sets(sets, least)
    for name in ("c", "d"):
        pairs = pairs.join(sets.select(F.col("id").alias(name), F.col("copies").alias(f"{name}_copies")), name)
    pairs = written(pairs, "question-pairs")
    copies = named.select("v", F.lag("v").over(Window.partitionBy("id").orderBy("v")).alias("w")).where("w is not null")
    single = "c_copies = 1 and d_copies = 1"
    once = pairs.where(single).select(F.col("d").alias("u"), F.col("c").alias("v"))
    sides = [pairs.where(f"not ({single})").join(named.select(F.col("id").alias(k), "v"), k).select("c", "d", "v", F.lit(k).alias("side")) for k in ("c", "d")]
    order = Window.partitionBy("c", "d").orderBy("v")
    turns = sides[0].unionByName(sides[1]).select("v", "side", F.lag("v").over(order).alias("w"), F.lag("side").over(order).alias("other")).where("other <> side")
    return copies.unionByName(turns.select("v", "w")).select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(once)


def _numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` with numbers that grow in the order of ``by``, written as a table so that they stay."""
    return written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()), "numbered")


def cluster_questions(questions: DataFrame, least: float = 0.5) -> DataFrame:
    """(scope, ordinal, text, cluster): a question joins the first cluster with a member that shares at least half of the shorter one's
    terms. Texts without terms are left out; questions of one ordinal follow one another by text, and equal rows are one."""
    each = questions.groupBy("scope", "ordinal", "text").agg(F.count(F.lit(1)).alias("times")).withColumn("terms", F.array_distinct(T.terms(F.col("text")))).where(F.size("terms") > 0)
    # edges and labels are numbers in the order of the questions, not their texts
    one = _numbered(each, ["scope", "ordinal", "text"], "v")
    few = F.size("terms") * least <= 1 + _EPS
    labels = least_reached(_chained(one, few).unionByName(_alternations(one.where(~few), least))).select(F.col("node").alias("v"), "label")
    named = written(one.join(labels, "v", "left").select("scope", "ordinal", "text", "times", F.coalesce("label", "v").alias("label")), "question-labels")
    openers = named.select("scope", "label").distinct()
    numbered = openers.select("label", (F.row_number().over(Window.partitionBy("scope").orderBy("label")) - 1).cast("long").alias("cluster"))
    return named.join(numbered, "label").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("scope", "ordinal", "text", "cluster")
