"""Toxicity by weak supervision.

Voters look for words of a lexicon, for stems mined from labelled texts, and for how many and how
dense the finds are; a text's votes are one number of VOTERS bits. A generative label model is fitted
to the table of how often each combination of votes occurs, at most 3 * 2**VOTERS rows whatever the
corpus, counted by Spark over all rows that may be learned from: expectation maximisation estimates
how often each voter fires for either class and, as part of the model, how voters hang together
within the classes, by the tree of dependences that explains most of it (negative ones included).
Who labelled texts is one more voter, silent on most, whose accuracy is estimated like the others'.

Its posterior labels train a linear classifier on the votes and on the text: the words of all texts,
hashed to BUCKETS, are counted by posterior label, each bucket's log odds against the prior are its
weight, and a logistic regression on a bounded sample of CLASSIFIER_ROWS rows, the first in order of
a hash of their ids, balances the votes and the mean weight of a text's words. So a text without any
listed word has a score of its own.

The stems are whole words and word beginnings of four to seven letters that set toxic texts
apart, by a likelihood-ratio test over at most LABELLED_ROWS labelled texts, the first in order
of a hash of their ids; at most STEMS of them are kept, the most telling first.

Rows: null text counts as empty; documents without a label are learned from as well, rows
of a null id not at all; several labels of a document count as toxic if one is; equal texts
have equal scores; without any row to learn from every text has the same low score.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free_name
from ._words import hashed_words, texts_of

LABELLED_ROWS, STEMS = 10_000, 64
CLASSIFIER_ROWS, BUCKETS, PRIOR_ROWS = 10_000, 1 << 15, 100.0
_UNITS = 1000  # posterior labels are counted in thousandths, so that sums do not depend on their order
#: Fixed word lists, one a voter.
LEXICON = [
    ["idiot", "idiots", "idiotic", "imbecile", "moron", "morons", "moronic", "cretin"],
    ["loser", "losers", "clown", "clowns", "buffoon"],
    ["scum", "vermin", "scumbag", "trash", "garbage", "rubbish"],
    ["stupid", "stupidity", "dumb", "dumbass"],
    ["disgusting", "filthy", "repulsive"],
    ["worthless", "useless"],
    ["pathetic", "laughable"],
    ["fuck", "fucking", "shit", "bitch", "bastard", "asshole", "trottel", "arschloch", "dummkopf", "connard", "salaud", "imbécil", "estúpido", "gilipollas"],
]
MINED = len(LEXICON)
SEVERAL, DENSE = (2, 3, 4), (0.003, 0.006, 0.012)
NOTHING = MINED + 1 + len(SEVERAL) + len(DENSE)
VOTERS = NOTHING + 1


def _search(stems: list[str]) -> ahocorasick.Automaton:
    """Words to find as (voter, length, whether the word ends there); a stem ends in ``*`` if it may go on."""
    found = {w: (k, len(w), True) for k, words in enumerate(LEXICON) for w in words}
    for x in stems:
        w = x.rstrip("*")
        if w not in found:
            found[w] = (MINED, len(w), not x.endswith("*"))
    made = ahocorasick.Automaton()
    for w, v in found.items():
        made.add_word(w, v)
    made.make_automaton()
    return made


def votes_of(text: str, search: ahocorasick.Automaton) -> int:
    low, bits, hits, last = text.lower(), 0, 0, -1
    for end, (k, n, whole) in search.iter(low):
        start = end + 1 - n
        if start and low[start - 1].isalpha() or whole and end + 1 < len(low) and low[end + 1].isalpha():
            continue
        bits |= 1 << k
        hits += start != last
        last = start
    if not bits:
        return 1 << NOTHING
    share = hits / (low.count(" ") + 1)
    for k, rule in enumerate([*(hits >= n for n in SEVERAL), *(share > d for d in DENSE)], MINED + 1):
        bits |= rule << k
    return bits


def mine_stems(docs: DataFrame, labels: DataFrame) -> list[str]:
    """From (id, text, held_out): what sets apart the toxic of a bounded sample of labelled texts."""
    marked = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.crc32(F.concat_ws("/", F.lit("stems"), F.col("doc_id").cast("string")).cast("binary"))
    sample = marked.where(~held_out(F.col("doc_id"))).orderBy(order, "doc_id").limit(LABELLED_ROWS)
    # two numbers a row and LABELLED_ROWS rows at most, so the texts need not move
    texts = docs.where(~F.col("held_out")).join(F.broadcast(sample), F.col("id") == F.col("doc_id")).select("text", "toxic")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    kinds = [words, *(_beginnings(words, n) for n in (4, 5, 6, 7))]
    each = texts.select("toxic", F.explode(F.array_distinct(F.flatten(F.array(*kinds)))).alias("x"))
    total = texts.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    n1 = float(total.t or 0)
    n0 = float(total.n - n1)
    if not n1 or not n0:
        return []
    counts = each.groupBy("x").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b")).where("a >= 5 and a >= b")
    part = lambda k, n: F.when(k > 0, k * F.log(k / n)).otherwise(0.0)
    a, b = F.col("a"), F.col("b")
    test = 2 * (part(a, F.lit(n1)) + part(n1 - a, F.lit(n1)) + part(b, F.lit(n0)) + part(n0 - b, F.lit(n0)) - part(a + b, F.lit(n1 + n0)) - part(n1 + n0 - a - b, F.lit(n1 + n0)))
    best = counts.withColumn("test", F.round(test, 6)).where("test >= 25").orderBy(F.desc("test"), F.col("x").endswith("*"), F.desc(F.length("x")), "x").limit(40 * STEMS).collect()
    chosen: list[str] = []
    for x in (r.x for r in best):
        bare = x.rstrip("*")
        if len(chosen) < STEMS and not any(c == x or c.endswith("*") and bare.startswith(c[:-1]) or x.endswith("*") and c.startswith(bare) for c in chosen):
            chosen.append(x)
    return chosen


def _beginnings(words: Column, n: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.left(w, F.lit(n)), F.lit("*")))


def with_votes(docs: DataFrame, stems: list[str], text_col: str = "text", out_col: str = "votes") -> DataFrame:
    """``docs`` with the votes of each text; the other columns stay in the JVM."""

    @F.arrow_udf("int")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = _search(stems)
        for texts in parts:
            yield pa.array([votes_of(t.as_py() or "", search) for t in texts], pa.int32())

    return docs.withColumn(out_col, run(F.col(text_col)))


def _dependences(fires: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """(voter, parent or -1), parents first: the tree of greatest mutual information given the class."""
    v = fires.shape[1]
    total = sum(w.sum() for w in weights) + 4
    info = np.zeros((v, v))
    for w in weights:
        n = w.sum() + 4
        one = (fires.T @ w + 2) / n
        both = ((fires * w[:, None]).T @ fires + 1) / n
        for a in (0, 1):
            for b in (0, 1):
                p = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
                p = np.clip(p, 1e-9, 1)
                alone = (one if a else 1 - one)[:, None] * (one if b else 1 - one)[None, :]
                info += n / total * p * np.log(p / alone)
    order, parent, best = [(0, -1)], np.zeros(v, int), info[0].copy()
    left = list(range(1, v))
    while left:
        i = max(left, key=lambda k: (best[k], -k))
        left.remove(i)
        order.append((i, int(parent[i])))
        for k in left:
            if info[i, k] > best[k]:
                best[k], parent[k] = info[i, k], i
    return order


def label_model(votes: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int = 60, settled: int = 8) -> np.ndarray:
    """Posterior probability of the toxic class for each row of the table of counts.

    votes: rows x voters of 0 and 1; labels: 1, 0 or -1 for none. The tree of dependences is chosen
    anew for ``settled`` rounds.
    """
    n, fires = counts.astype(float), votes.astype(float)
    start = fires[:, :MINED].any(1) | (fires[:, MINED + 1 : NOTHING].sum(1) >= 2)  # a word of the lexicon, or several finds
    said = labels >= 0
    post, tree = np.where(said, 0.02 + 0.96 * labels, np.where(start, 0.9, 0.02)), None
    for r in range(rounds):
        weights = (n * (1 - post), n * post)
        if tree is None or r < settled:
            tree = _dependences(fires, weights)
        logs = []
        for w in weights:
            log = np.full(len(n), np.log(w.sum() + 1))
            for i, parent in tree:
                rate = np.empty(len(n))
                for state in ((0, 1) if parent >= 0 else (None,)):
                    rows = slice(None) if state is None else fires[:, parent] == state
                    part = w[rows]
                    rate[rows] = (part @ fires[rows, i] + 0.5) / (part.sum() + 1)
                log += np.log(np.where(fires[:, i] > 0, rate, 1 - rate))
            yes = (w[said] @ labels[said] + 0.5) / (w[said].sum() + 1)
            log[said] += np.log(np.where(labels[said] > 0, yes, 1 - yes))
            logs.append(log)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30)))
        done = np.abs(new - post).max() < 1e-7
        post = new
        if done and r >= settled:
            break
    return post


def linear_classifier(votes: np.ndarray, target: np.ndarray, counts: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights and, last, the intercept of a logistic regression on soft labels (Newton's method)."""
    x = np.hstack([votes.astype(float), np.ones((len(votes), 1))])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (p - target)) + ridge @ w
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def posteriors(voted: DataFrame, labels: DataFrame) -> dict[int, float]:
    """Posterior by votes, from (id, votes, held_out) and (doc_id, toxic); held-out rows are not looked
    at. Labels meet ids and votes only, so no text moves for them."""
    marked = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = voted.where(~F.col("held_out")).select("id", "votes").join(marked, F.col("id") == F.col("doc_id"), "left")
    counted = known.groupBy("votes", F.coalesce(F.col("toxic").cast("int"), F.lit(-1)).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    table = counted.orderBy("votes", "label").collect()  # at most 3 * 2**VOTERS rows
    if not table:
        return {}
    bits, n = np.array([r.votes for r in table]), np.array([r.n for r in table], float)
    post = label_model(bits[:, None] >> np.arange(VOTERS) & 1, np.array([r.label for r in table]), n)
    return {int(v): float(post[bits == v] @ n[bits == v] / n[bits == v].sum()) for v in np.unique(bits)}


def _buckets(text: bytes) -> np.ndarray:
    """Different buckets of a text's words in lower case."""
    found = [h[0] for _, _, h, _ in hashed_words([text.lower()])]
    return np.unique(found[0] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64) if found else np.zeros(0, np.int64)


def word_weights(docs: DataFrame, stems: list[str], post: dict[int, float]) -> np.ndarray:
    """Log odds of each bucket against the prior, from (text, held_out): what is counted grows
    with the corpus, what comes to the driver has two numbers a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(stems)
        toxic, seen = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for text in texts_of(b.column(0)):
                p = round(post[votes_of(text.decode(), search)] * _UNITS)
                at = np.append(_buckets(text), BUCKETS)  # the last counts texts
                seen[at] += _UNITS
                toxic[at] += p
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(toxic[some]), pa.array(seen[some])], ["bucket", "toxic", "seen"])

    parts = docs.where(~F.col("held_out")).select("text").mapInArrow(count, "bucket int, toxic long, seen long")
    toxic, seen = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for r in parts.groupBy("bucket").agg(F.sum("toxic").alias("t"), F.sum("seen").alias("n")).collect():  # BUCKETS + 1 rows
        toxic[r.bucket], seen[r.bucket] = r.t / _UNITS, r.n / _UNITS
    prior = min(max(toxic[-1] / max(seen[-1], 1), 1e-4), 0.5)
    share = (toxic[:-1] + PRIOR_ROWS * prior) / (seen[:-1] + PRIOR_ROWS)
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return (np.log(share / (1 - share)) - np.log(prior / (1 - prior))).astype(np.float32)


def text_weight(text: bytes, weights: np.ndarray) -> float:
    """Mean weight of a text's different words, scaled by the square root of their number."""
    at = _buckets(text)
    return float(weights[at].sum(dtype=np.float64) / np.sqrt(len(at))) if len(at) else 0.0


def train(docs: DataFrame, stems: list[str], labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the votes, of the text and, last, the intercept; and those of the word buckets."""
    voted = with_votes(docs, stems)
    post = posteriors(voted, labels)
    if not post:
        return np.append(np.zeros(VOTERS + 1), -3.0), np.zeros(BUCKETS, np.float32)
    words = word_weights(docs, stems, post)
    order = F.crc32(F.concat_ws("/", F.lit("train"), F.col("id").cast("string")).cast("binary"))
    first = docs.where(~F.col("held_out")).select("id").orderBy(order, "id").limit(CLASSIFIER_ROWS).distinct()
    # CLASSIFIER_ROWS ids at most, so the texts need not move; of rows repeating an id one is taken
    texts = docs.where(~F.col("held_out")).join(F.broadcast(first), "id").groupBy("id").agg(F.min("text").alias("text"))
    sample = with_features(texts, stems, words, "text", "f").select("f.votes", "f.weight").collect()
    rows = sorted((r.votes, r.weight) for r in sample)
    bits, weight = np.array([v for v, _ in rows]), np.array([w for _, w in rows])
    target = np.array([post.get(v, 0.0) for v, _ in rows])
    return linear_classifier(np.hstack([bits[:, None] >> np.arange(VOTERS) & 1, weight[:, None]]), target, np.ones(len(rows))), words


def with_features(docs: DataFrame, stems: list[str], words: np.ndarray, text_col: str, out_col: str) -> DataFrame:
    """``docs`` with struct(votes, weight) of each text; BUCKETS numbers go to the executors. One pass in
    one worker: two columns of their own would have two read each text."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    kind = pa.struct([("votes", pa.int32()), ("weight", pa.float64())])

    @F.arrow_udf("votes int, weight double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = _search(stems)
        for texts in parts:
            raw = texts_of(texts)
            votes, weight = [votes_of(t.decode(), search) for t in raw], [text_weight(t, shared.value) for t in raw]
            yield pa.StructArray.from_arrays([pa.array(votes, pa.int32()), pa.array(weight, pa.float64())], fields=list(kind))

    return docs.withColumn(out_col, run(F.col(text_col)))


def score_of(votes: Column, weight: Column, weights: np.ndarray) -> Column:
    total = F.lit(float(weights[-1])) + weight * F.lit(float(weights[-2]))
    for k, w in enumerate(weights[:-2]):
        total = total + F.getbit(votes, F.lit(k)).cast("double") * F.lit(float(w))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[list[str], tuple[np.ndarray, np.ndarray], DataFrame]:
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("held_out", held_out(F.col("id")))
    stems = mine_stems(plain, labels)
    return stems, train(plain, stems, labels), plain


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted, votes), one row per input row."""
    stems, (weights, words), plain = _learn(docs, labels, id_col, text_col)
    scored = with_features(plain, stems, words, "text", "f").select("id", "held_out", score_of(F.col("f.votes"), F.col("f.weight"), weights).alias("score"), "f.votes")
    return scored.select("id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "votes")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, scored with a model trained on ``docs``."""
    stems, (weights, words), _ = _learn(docs, labels, id_col, text_col)
    f = free_name(docs, "toxicity_features")
    scored = with_features(docs, stems, words, text_col, f)
    return scored.where(score_of(F.col(f"{f}.votes"), F.col(f"{f}.weight"), weights) < 0.5).select(*docs.columns)
