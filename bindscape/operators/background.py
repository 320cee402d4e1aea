"""Background of the unselected pool: a k-mer model, fitted on one vector of k-mer counts.

pi(v) = exp(sum of weights of the k-mers in left context + v + right context) / Z. The likelihood depends on the
probes only through the k-mer counts, so the table is read once for each k; the rest is parameter-sized.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindscape.functions import dna

from .params import BASES


def context(left: str, right: str, k: int, flanked: bool = True) -> tuple[str, str]:
    n = k - 1 if flanked else 0
    return (left[-n:] if n else ""), right[:n]


def kmer_counts(probes: DataFrame, k: int, left: str = "", right: str = "", cnt: str = "cnt", flanked: bool = True) -> DataFrame:
    """(kmer, n): count times occurrences over all places. Partial sums before the shuffle; at most 4^k groups."""
    a, b = context(left, right, k, flanked)
    kmers = probes.select(cnt, F.explode(dna.windows(F.concat(F.lit(a), F.col("seq"), F.lit(b)), k)).alias("kmer"))
    return kmers.groupBy("kmer").agg(F.sum(cnt).cast("long").alias("n"))


def kmer_index(kmer: str) -> int:
    out = 0
    for c in kmer:
        out = 4 * out + BASES.index(c)
    return out


def kmer_sums(probes: DataFrame, ks: list[int], left: str = "", right: str = "", cnts: tuple[str, ...] = ("cnt",), flanked: bool = True) -> dict[int, np.ndarray]:
    """For each k the sums of each count by k-mer, (counts, 4^k), all from one scan; at most 4^k rows of each k reach the driver.

    A k of 0 stands for the probe itself: its one sum is the number of reads.
    """
    text = lambda k: F.concat(F.lit(context(left, right, k, flanked)[0]), F.col("seq"), F.lit(context(left, right, k, flanked)[1]))
    words = F.concat(*[dna.windows(text(k), k) if k else F.array(F.lit("")) for k in sorted(set(ks))])
    sums = probes.select(*cnts, F.explode(words).alias("kmer")).groupBy("kmer").agg(*[F.sum(c).cast("long").alias(f"n{i}") for i, c in enumerate(cnts)])
    out = {k: np.zeros((len(cnts), 4**k)) for k in ks}
    for kmer, *n in sums.collect():
        out[len(kmer)][:, kmer_index(kmer)] = [x or 0 for x in n]
    return out


@dataclass(frozen=True)
class Background:
    """beta: (4^k,) weights, k-mers in A, C, G, T order; l: length of the variable region."""

    beta: np.ndarray
    k: int
    length: int
    left: str = ""
    right: str = ""
    flanked: bool = True

    def z(self) -> float:
        return self.z_gradient()[0]

    def z_gradient(self) -> tuple[float, np.ndarray]:
        """(Z, its gradient by beta), by forward and backward messages over the last k - 1 bases."""
        alpha, k = np.exp(self.beta), self.k
        a, b = context(self.left, self.right, k, self.flanked)
        n = 4 ** (k - 1)
        weights = alpha.reshape(n, 4)
        into = (4 * np.arange(n)[:, None] + np.arange(4)[None, :]) % n
        steps, state = [], np.zeros(n)
        if self.flanked:
            state[kmer_index(a) if a else 0] = 1
        else:
            state[:] = 0
        choices: list[list[int]] = [list(range(4))] * self.length + [[BASES.index(c)] for c in b]
        if not self.flanked:
            if self.length < k:
                return float(4**self.length), np.zeros_like(alpha)
            state[:] = 1.0  # the first k - 1 bases carry no k-mer yet
            choices = choices[k - 1 :]
        forward = [state]
        for bases in choices:
            new = np.zeros(n)
            for c in bases:
                np.add.at(new, into[:, c], forward[-1] * weights[:, c])
            forward.append(new)
            steps.append(bases)
        back, gradient = np.ones(n), np.zeros((n, 4))
        for bases, before in zip(reversed(steps), reversed(forward[:-1])):
            new = np.zeros(n)
            for c in bases:
                flow = weights[:, c] * back[into[:, c]]
                gradient[:, c] += before * flow
                new += flow
            back = new
        return float(forward[-1].sum()), gradient.ravel()

    def log_probability(self, seq: Column | str) -> Column:
        """ln pi of a sequence column: an unrolled lookup of its k-mers."""
        return self._log_weight(seq) - F.lit(float(np.log(self.z())))

    def _log_weight(self, seq: Column | str) -> Column:
        a, b = context(self.left, self.right, self.k, self.flanked)
        s = F.concat(F.lit(a), F.col(seq) if isinstance(seq, str) else seq, F.lit(b))
        table = F.array(*[F.lit(float(x)) for x in self.beta])
        out = F.lit(0.0)
        for i in range(self.length + len(a) + len(b) - self.k + 1):
            out = out + F.element_at(table, dna.encode_short(F.substring(s, i + 1, self.k)).cast("int") + 1)
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """ln pi of coded variable regions (n, length)."""
        a, b = context(self.left, self.right, self.k, self.flanked)
        pad = lambda t: np.tile(np.array([BASES.index(c) for c in t], np.uint8), (len(x), 1))
        full = np.concatenate([pad(a), x, pad(b)], axis=1).astype(int) if a or b else x.astype(int)
        out = np.full(len(x), -np.log(self.z()))
        for i in range(full.shape[1] - self.k + 1):
            code = np.zeros(len(x), int)
            for j in range(self.k):
                code = 4 * code + full[:, i + j]
            out += self.beta[code]
        return out


def count_vector(counts: DataFrame, k: int) -> np.ndarray:
    """The k-mer counts as a vector: at most 4^k rows reach the driver."""
    out = np.zeros(4**k)
    for r in counts.collect():
        out[kmer_index(r["kmer"])] = r["n"]
    return out


def likelihood(background: Background, x: np.ndarray, n: float) -> tuple[float, np.ndarray]:
    """(n ln Z - beta X, its gradient)."""
    z, g = background.z_gradient()
    return n * np.log(z) - float(background.beta @ x), n * g / z - x


def fit_background(probes: DataFrame, k: int, length: int, left: str = "", right: str = "", cnt: str = "cnt", tolerance: float = 5e-8, rounds: int = 5000, search: str = "wolfe") -> tuple[Background, float]:
    """(model, likelihood). One Spark job; the optimiser runs on the driver."""
    sums = kmer_sums(probes, [0, k], left, right, (cnt,))
    return fit_counts(sums[k][0], float(sums[0][0, 0]), k, length, left, right, tolerance, rounds, search)


def fit_counts(x: np.ndarray, n: float, k: int, length: int, left: str = "", right: str = "", tolerance: float = 5e-8, rounds: int = 5000, search: str = "wolfe") -> tuple[Background, float]:
    """fit_background from k-mer counts and the number of reads."""
    from .optimize import lbfgs

    def value(v):
        return likelihood(Background(v, k, length, left, right), x, n)

    got = lbfgs(value, np.zeros(4**k), scale=max(n, 1.0), tolerance=tolerance, most=rounds, search=search)
    beta = got.x - got.x.max()
    return Background(beta, k, length, left, right), got.value


def select_background(split: DataFrame, ks: list[int], length: int, left: str = "", right: str = "") -> list[tuple[int, float, float, float]]:
    """For each k: (k, train, test and test-per-read likelihood); split has seq, train and test. The least test likelihood chooses k.

    The counts of all k and of both parts come from one scan.
    """
    out, sums = [], kmer_sums(split, [0, *ks], left, right, ("train", "test"))
    read, n = (float(v) for v in sums[0][:, 0])
    for k in ks:
        model, train = fit_counts(sums[k][0], read, k, length, left, right)
        test = likelihood(model, sums[k][1], n)[0]
        out.append((k, train, test, test / n if n else 0.0))
    return out


def markov_by_division(probes: DataFrame, k: int, cnt: str = "cnt") -> DataFrame:
    """(kmer, p): chance of a k-mer's last base given the bases before it, from the ratio of two counts."""
    long = kmer_counts(probes, k, cnt=cnt)
    w = long.withColumn("head", F.substring("kmer", 1, k - 1))
    total = w.groupBy("head").agg(F.sum("n").alias("t"))
    return w.join(F.broadcast(total), "head").select("kmer", (F.col("n") / F.col("t")).alias("p"))


def enumerated_z(background: Background) -> float:
    """Z by listing all sequences; for tests and small lengths."""
    a, b = context(background.left, background.right, background.k, background.flanked)
    total = 0.0
    for v in product(BASES, repeat=background.length):
        s = a + "".join(v) + b
        total += np.exp(sum(background.beta[kmer_index(s[i : i + background.k])] for i in range(len(s) - background.k + 1)))
    return total


def markov_tables(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, p) of a stored table of chances: CSV with a header where the name says so, else Parquet."""
    rows = spark.read.csv(path, header=True) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    return rows.select(F.col("kmer").cast("string"), F.col("p").cast("double"))


def markov_model(chances: DataFrame, k: int, length: int) -> Background:
    """Chances (kmer, p) as a background without flanks: a sequence's weight is the product of its k-mers' chances.

    At most 4^k rows reach the driver. A k-mer without a chance has 0. Z is then the sum over all sequences, by a transfer matrix.
    """
    p = np.zeros(4**k)
    for r in chances.select("kmer", "p").collect():
        p[kmer_index(r["kmer"])] = r["p"]
    with np.errstate(divide="ignore"):
        return Background(np.log(p), k, length, flanked=False)


def markov_scores(probes: DataFrame, model: Background) -> DataFrame:
    """probes with lp, the log chance of the whole sequence among all of its length; null where a k-mer has none."""
    table = F.lit([float(x) for x in model.beta])
    total = F.lit(0.0)
    for i in range(model.length - model.k + 1):
        total = total + F.element_at(table, dna.encode_short(F.substring("seq", i + 1, model.k)).cast("int") + 1)
    return probes.withColumn("lp", total - F.lit(float(np.log(model.z())))).withColumn("lp", F.when(F.col("lp") > float("-inf"), F.col("lp")))


def markov_likelihood(probes: DataFrame, chances: DataFrame, k: int, length: int, cnt: str = "cnt") -> DataFrame:
    """(value, unseen): -sum c ln p over reads whose k-mers all have a chance, and the number of other reads."""
    scored = markov_scores(probes, markov_model(chances, k, length))
    return scored.agg((-F.sum(F.col(cnt) * F.col("lp"))).alias("value"), F.coalesce(F.sum(F.when(F.col("lp").isNull(), F.col(cnt))), F.lit(0)).cast("long").alias("unseen"))


def markov_fit(train: DataFrame, test: DataFrame, ks: list[int], length: int) -> list[tuple[int, float]]:
    """(k, R^2) of models learnt from one sample: squared correlation of expected with observed counts over the sequences of another.

    One scan of each sample, whatever the number of models.
    """
    sums, scored = kmer_sums(train, ks), test
    for k in ks:
        n = sums[k][0].reshape(-1, 4)
        total = n.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            model = Background(np.log(np.divide(n, total, out=np.zeros_like(n), where=total > 0).ravel()), k, length, flanked=False)
        scored = markov_scores(scored, model).withColumnRenamed("lp", f"lp_{k}")
    r = scored.agg(*[F.corr(F.when(F.col(f"lp_{k}").isNotNull(), F.col("cnt")), F.exp(f"lp_{k}")) for k in ks]).first()
    return [(k, float(x) ** 2 if x is not None else float("nan")) for k, x in zip(ks, r)]
