"""Toxicity: the nearest labelled examples by exact TF-IDF cosine, found in block-max inverted lists.

1. Features of a text are its lower-case words and their beginnings of 3 to 8 letters. Of those in the labelled examples the ones that
   tell the labels apart (chi-square of CHI or more, counted in Spark) make the space; of beginnings that stand in the same
   examples only the longest stays. Words outside the space have no weight, as in any space learnt from examples.
2. One scan reads the whole text of each row and writes its counts of these features to the shared folder, some numbers a row. Document
   frequencies come from all rows. A weight is (1 + ln count) * idf, and vectors have length 1.
3. Examples are sorted by their heaviest features, so that like ones are neighbours, and cut into blocks. A feature's list holds
   its greatest weight in each block. For a query the sums of these bounds are taken block by block from the
   top; blocks that can't reach the k-th best cosine found are never opened, so the k nearest are exact. Ties go to the smaller id.
4. Votes are weighted by cosine, drawn to the share of toxic examples by a prior worth PRIOR votes, and mapped to probabilities
   by an isotonic regression over the examples, each without itself. The neighbours are the evidence.

Examples are at most ``max_train`` labelled rows, those with the smallest hashes of the id; they and the index, whose size they bound,
pass the driver and are broadcast. All else covers all rows.

Null text counts as empty. A text without features has no neighbours; its score is the calibrated share of toxic examples among
such texts. A null id never has a label and isn't held out. Ids with labels that differ take the highest. Repeated rows are
scored each by itself. Without labels every row scores 0. An empty table gives no rows. Texts of any length are read whole. Only the columns named are
read; scored() keeps other columns, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_TRAIN = 6000
#: Chi-square (one degree of freedom) that a feature needs, and how many features there are at most.
CHI, FEATURES = 25.0, 8192
SHORT, LONG = 3, 8
NEIGHBOURS, PRIOR = 15, 0.5
BLOCK = 64
THRESHOLD = 0.5
#: Letters only: marks that are glued to words don't hide them.
WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word, marked by a space, and its beginnings."""
    return [word[:k] for k in range(SHORT, min(LONG, len(word)) + 1)] + [word + " "]


def words(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def counts(text: str | None, known: common.Memo) -> dict[int, int]:
    """How often each feature of the space occurs. known: feature numbers of a word."""
    out: dict[int, int] = {}
    for word, n in words(text).items():
        for f in known[word]:
            out[f] = out.get(f, 0) + n
    return out


def may_learn(id_col: str = "doc_id"):
    return common.bucket_of(id_col, 5) != 0


def examples(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, toxic): at most max_train labelled ids of docs that may be learnt from, those with the smallest hashes."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & may_learn()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    there = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)


def space(docs: DataFrame, chosen: DataFrame) -> list[str]:
    """Features that tell the labels apart, strongest first."""
    texts = docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text")

    def make():
        def each(b):
            seen = Counter()
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen.update((toxic, f) for f in {f for w in words(text) for f in features(w)})
            return {"toxic": [t for t, _ in seen], "feature": [f for _, f in seen], "n": list(seen.values())}

        return each

    total = texts.groupBy("toxic").count().collect()
    pos, neg = (sum(r["count"] for r in total if bool(r["toxic"]) == t) for t in (True, False))
    by = common.arrow_map(texts, make, "toxic int, feature string, n long").groupBy("feature").agg(F.sum(F.when(F.col("toxic") != 0, F.col("n")).otherwise(0)).cast("double").alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).cast("double").alias("b"))
    a, b, all_ = F.col("a"), F.col("b"), float(pos + neg)
    below = (a + b) * (F.lit(all_) - a - b) * float(pos) * float(neg)
    chi = F.when(below > 0, F.lit(all_) * F.pow(a * (F.lit(float(neg)) - b) - b * (F.lit(float(pos)) - a), 2) / below).otherwise(0.0)
    best = by.withColumn("chi", chi).where(F.col("chi") >= CHI).orderBy(F.col("chi").desc(), "feature").limit(FEATURES).collect()
    found = {r["feature"]: (r["a"], r["b"]) for r in best}
    # A beginning that stands where a longer one does says nothing more.
    longer = {f[:-1] for f, n in found.items() if found.get(f[:-1]) == n and len(f) > SHORT}
    return [r["feature"] for r in best if r["feature"] not in longer]


def counted(docs: DataFrame, chosen_features: list[str]) -> DataFrame:
    """(doc_id, ids, ns): each row's counts of the features, as packed numbers, in the shared folder."""
    sent = docs.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(chosen_features)})

    def make():
        number = sent.value
        known = common.Memo(lambda w: tuple(number[f] for f in features(w) if f in number), 200_000)

        def each(b):
            got = [sorted(counts(t, known).items()) for t in b.column("text").to_pylist()]
            return {"doc_id": b.column("doc_id").cast(pa.int64()), "ids": [np.array([k for k, _ in x], "<i4").tobytes() for x in got], "ns": [np.array([n for _, n in x], "<i4").tobytes() for x in got]}

        return each

    return common.materialize(common.arrow_map(docs.select("doc_id", "text"), make, "doc_id long, ids binary, ns binary"), "toxic-counts")


def frequencies(rows: DataFrame, n_features: int) -> np.ndarray:
    """In how many rows each feature stands; tasks send what they have seen."""

    def run(batches):
        seen = np.zeros(n_features, np.int64)
        for b in batches:
            ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), "<i4")
            seen += np.bincount(ids, minlength=n_features)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["feature", "n"])

    out = np.zeros(n_features, np.int64)
    for r in rows.select("ids").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        out[r["feature"]] = r["n"]
    return out


class Index:
    """Block-max inverted lists over unit vectors. rows: (id, features, weights) of the examples."""

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray]], size: int = BLOCK):
        def like(k):
            _, ids, w = rows[k]
            return [int(x) for x in ids[np.lexsort((ids, -w))][:4]]

        order = sorted(range(len(rows)), key=lambda k: (like(k), rows[k][0]))
        self.ids = np.array([rows[k][0] for k in order], np.int64)
        self.size, self.blocks = size, -(-len(rows) // size)
        features = np.concatenate([rows[k][1] for k in order]) if order else np.empty(0, np.int32)
        weights = np.concatenate([rows[k][2] for k in order]) if order else np.empty(0)
        place = np.repeat(np.arange(len(order)), [len(rows[k][1]) for k in order])
        by = np.lexsort((place, features))
        self.place, self.weight, features = place[by], weights[by], features[by]
        # A list is its feature's blocks: number, where its postings begin, greatest weight.
        key = features.astype(np.int64) * max(1, self.blocks) + self.place // size
        self.key, self.begin = np.unique(key, return_index=True)
        self.end = np.append(self.begin[1:], len(key)).astype(np.int64)
        self.most = np.maximum.reduceat(self.weight, self.begin) if len(key) else np.empty(0)
        n = int(features.max()) + 1 if len(features) else 0
        self.first = np.searchsorted(self.key, np.arange(n + 1) * max(1, self.blocks))
        self.opened = 0

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest with a cosine above 0, best first. but: a place that is left out."""
        inside = ids < len(self.first) - 1
        ids, weights = ids[inside], weights[inside]
        if not len(ids):
            return np.empty(0, np.int64), np.empty(0)
        begin, size = self.first[ids], self.first[ids + 1] - self.first[ids]
        entry = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        w = np.repeat(weights, size)
        block = self.key[entry] % self.blocks
        # A hair above, so that no rounding closes a block that holds the k-th best.
        bound = np.bincount(block, w * self.most[entry], minlength=self.blocks) * (1 + 1e-9) + 1e-12
        # A block's part of all the query's lists lies together.
        by = np.argsort(block, kind="stable")
        entry, w, edge = entry[by], w[by], np.searchsorted(block[by], np.arange(self.blocks + 1))
        places, values = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bound, kind="stable"):
            if edge[b] == edge[b + 1] or (len(values) == k and bound[b] < values[-1]):
                break
            e, we = entry[edge[b] : edge[b + 1]], w[edge[b] : edge[b + 1]]
            n = self.end[e] - self.begin[e]
            at = np.repeat(self.begin[e] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            sums = np.bincount(self.place[at] - b * self.size, self.weight[at] * np.repeat(we, n), minlength=self.size)
            hit = np.flatnonzero(sums > 0)
            here = hit + b * self.size
            if but is not None:
                hit, here = hit[here != but], here[here != but]
            places, values = np.concatenate([places, here]), np.round(np.concatenate([values, sums[hit]]), 12)
            top = np.lexsort((self.ids[places], -values))[:k]
            places, values = places[top], values[top]
            self.opened += 1
        return places, values


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the non-decreasing function of x that is nearest to y: pooled neighbours that violate the order."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, weight, first x, last x
    for xi, yi in zip(x[order], y[order], strict=True):
        pools.append([yi, 1.0, xi, xi])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            s, w, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + w, pools[-1][2], last]
    # One vote of each kind keeps the ends away from 0 and 1.
    return np.array([p[k] for p in pools for k in (2, 3)]), np.array([(p[0] + 0.02) / (p[1] + 0.04) for p in pools for _ in range(2)])


class Model:
    """Index, weights and calibration; what workers get."""

    def __init__(self, idf: np.ndarray, rows: list[tuple[int, int, np.ndarray, np.ndarray]], k: int = NEIGHBOURS):
        self.idf, self.k = idf, k
        vectors = [(i, *self.vector(ids, ns)) for i, _, ids, ns in rows]
        label = {i: t for i, t, _, _ in rows}
        bare = [label[i] for i, ids, _ in vectors if not len(ids)]
        self.base = (sum(label.values()) + 0.5) / (len(label) + 1) if rows else 0.0
        self.bare = (sum(bare) + self.base) / (len(bare) + 1) if rows else 0.0
        self.index = Index([v for v in vectors if len(v[1])])
        self.labels = np.array([label[int(i)] for i in self.index.ids], np.float64)
        own = {int(i): p for p, i in enumerate(self.index.ids)}
        votes = np.array([self.vote(*self.index.nearest(ids, w, k, own[i])) for i, ids, w in vectors if len(ids)])
        self.steps = isotonic(votes, np.array([label[i] for i, ids, _ in vectors if len(ids)], float)) if len(votes) else (np.array([0.0]), np.array([self.base]))

    def vector(self, ids: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(ns)) * self.idf[ids] if len(ids) else np.empty(0)
        keep = w > 0
        ids, w = ids[keep], w[keep]
        return ids, w / math.sqrt(float(w @ w)) if len(w) else w

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        return float((cosines @ self.labels[places] + PRIOR * self.base) / (cosines.sum() + PRIOR))

    def score(self, ids: np.ndarray, ns: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Probability, and the places and cosines of the neighbours."""
        ids, w = self.vector(ids, ns)
        if not len(ids):
            return self.bare, np.empty(0, np.int64), np.empty(0)
        places, cosines = self.index.nearest(ids, w, self.k)
        return float(np.interp(self.vote(places, cosines), *self.steps)), places, cosines


def train(chosen: DataFrame, rows: DataFrame, n_features: int) -> Model:
    """Model over the examples chosen, whose counts are in rows."""
    seen, total = frequencies(rows, n_features), max(1, rows.count())
    idf = np.log((1 + total) / (1 + seen)) if n_features else np.zeros(0)
    # Of rows with one id the one with the smallest counts stands for it, so that the choice is always the same.
    got = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("ids", "ns")).alias("x")).collect()
    fitted = sorted((r["doc_id"], int(r["toxic"] != 0), np.frombuffer(bytes(r["x"]["ids"]), "<i4"), np.frombuffer(bytes(r["x"]["ns"]), "<i4")) for r in got)
    return Model(idf, fitted)


def scores(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, score, neighbours, cosines, toxic_neighbours) for each row of docs (doc_id, text)."""
    chosen = common.materialize(examples(docs, labels, max_train), "toxic-examples")
    found = space(docs, chosen)
    rows = counted(docs, found)
    sent = docs.sparkSession.sparkContext.broadcast(train(chosen, rows, len(found)))

    def make():
        model = sent.value

        def each(b):
            got = [model.score(np.frombuffer(i, "<i4"), np.frombuffer(n, "<i4")) for i, n in zip(b.column("ids").to_pylist(), b.column("ns").to_pylist(), strict=True)]
            return {"doc_id": b.column("doc_id"), "score": [s for s, _, _ in got], "neighbours": [model.index.ids[p].tolist() for _, p, _ in got], "cosines": [c.tolist() for _, _, c in got], "toxic_neighbours": [int(model.labels[p].sum()) for _, p, _ in got]}

        return each

    return common.arrow_map(rows, make, "doc_id long, score double, neighbours array<long>, cosines array<double>, toxic_neighbours int")


def op11_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(common.id_text(common.table(spark, sf_dir, "documents")), common.table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.coalesce(common.bucket_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "toxic_neighbours", "neighbours", "cosines")
