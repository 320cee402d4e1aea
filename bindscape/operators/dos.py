"""Density of states of a scoring function over all sequences: exact by transfer matrices for scores that add up along a
sequence, at any length; by listing for short sequences; by Wang-Landau chains for scores of any other kind."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindscape.functions import dna

from .background import Background, context, kmer_index
from .params import BASES, Mode


def all_sequences(spark: SparkSession, length: int) -> DataFrame:
    """(seq) for all 4^length sequences, made on the executors."""
    if length > 15:
        raise ValueError("listing is for short sequences; use chains")
    return spark.range(4**length).select(dna.decode("id", length).alias("seq"))


def exact_density(scored: DataFrame, width: float, score: str = "score") -> DataFrame:
    """(score, s): upper edge of each bin of the given width, and ln of the number of sequences in it."""
    edge = F.ceil(F.round(F.col(score) / width, 9)) * F.lit(width)
    return scored.groupBy(edge.cast("double").alias("score")).agg(F.ln(F.count(F.lit(1)).cast("double")).alias("s"))


@dataclass(frozen=True)
class Additive:
    """A score that adds up along a sequence: steps[i][last bases, next base] is what a base adds. Codes of the last bases start at ``start``.

    A step whose bases are fixed (context behind the sequence) allows only those in allowed[i].
    """

    steps: list[np.ndarray]
    start: np.ndarray
    allowed: list[list[int]]

    @staticmethod
    def of_mode(mode: Mode) -> Additive:
        """The weight of a sequence as long as the mode."""
        steps = []
        for p in range(mode.k):
            pair = mode.di[p - 1].reshape(4, 4) if mode.di is not None and p else np.zeros((4, 4))
            steps.append(mode.nuc[p][None, :] + pair)
        if mode.shape is not None:
            raise ValueError("shape values are not on a grid; use chains")
        return Additive(steps, np.array([1, 0, 0, 0]), [[0, 1, 2, 3]] * mode.k)

    @staticmethod
    def of_background(background: Background) -> Additive:
        """The log weight of a variable region, its flanks included."""
        a, b = context(background.left, background.right, background.k, background.flanked)
        n = 4 ** (background.k - 1)
        table, start = background.beta.reshape(n, 4), np.zeros(n, int)
        if background.flanked:
            start[kmer_index(a) if a else 0] = 1
            return Additive([table] * (background.length + len(b)), start, [[0, 1, 2, 3]] * background.length + [[BASES.index(c)] for c in b])
        start[:] = 1  # the first k - 1 bases carry no k-mer yet
        steps = background.length - background.k + 1
        return Additive([table] * steps, start, [[0, 1, 2, 3]] * steps)

    def units(self, grain: float) -> list[np.ndarray]:
        return [np.round(s / grain).astype(np.int64) for s in self.steps]

    def density(self, grain: float) -> tuple[np.ndarray, np.ndarray]:
        """(score in units of grain, number of sequences with it), numbers above 0 only.

        For each code of the last bases a polynomial whose exponents are scores: a base multiplies it by a power and hands it to the next
        code. Exact for steps on the grid of grain, else each step is off by half a grain at most. Numbers are exact up to 2^53.
        """
        states = len(self.start)
        ways, low = self.start.astype(float)[:, None], 0
        for units, bases in zip(self.units(grain), self.allowed):
            least, most = int(units[:, bases].min()), int(units[:, bases].max())
            new = np.zeros((states, ways.shape[1] + most - least))
            for state in np.flatnonzero(ways.any(axis=1)):
                for b in bases:
                    at = units[state, b] - least
                    new[(4 * state + b) % states, at : at + ways.shape[1]] += ways[state]
            ways, low = new, low + least
        total = ways.sum(axis=0)
        hit = np.flatnonzero(total)
        return hit + low, total[hit]

    def with_score(self, df: DataFrame, before: str, behind: str, grain: float, seq: str = "seq", out: str = "q") -> DataFrame:
        """df with the score of a sequence column in units of grain. before: the bases that ``start`` stands for (one A for a mode); behind: fixed ones.

        Up to 32 bases with both are coded once as one number, of which each step looks up a shifted part; longer ones are cut as texts.
        """
        width = 1 + (len(self.start).bit_length() - 1) // 2
        text, n = F.concat(F.lit(before), F.col(seq), F.lit(behind)), len(self.steps) + width - 1
        name = next(x for x in (f"code_{k}" for k in range(1000)) if x not in df.columns)
        coded = df.withColumn(name, dna.encode(text) if n <= 32 else text)
        total = F.lit(0).cast("long")
        for i, units in enumerate(self.units(grain)):
            at = F.shiftrightunsigned(name, 2 * (n - i - width)).bitwiseAND(F.lit(4**width - 1)) if n <= 32 else dna.encode_short(F.substring(name, i + 1, width))
            total = total + F.get(F.lit(units.reshape(-1).tolist()), at.cast("int"))
        return coded.withColumn(out, total).drop(name)


def density_of_probes(probes: DataFrame, score: Additive, grain: float, before: str = "", behind: str = "", cnt: str = "cnt") -> DataFrame:
    """(q, reads, states, ln_ratio): reads by their score, beside all sequences with that score; ln of the share of reads over the share of sequences.

    Probes are scored and summed in one pass with partial sums; the density has one row for each score and is joined to that.
    """
    spark = probes.sparkSession
    q, states = score.density(grain)
    reads = score.with_score(probes.select("seq", F.col(cnt).alias("c")), before, behind, grain).groupBy("q").agg(F.sum("c").cast("long").alias("reads"))
    all_ = spark.createDataFrame(list(zip(q.tolist(), states.tolist(), strict=True)), "q long, states double")
    # A row for each score, so the total is a window over few rows.
    both = all_.join(reads, "q", "left").withColumn("n", F.sum("reads").over(Window.partitionBy()))
    ratio = F.ln(F.col("reads") / F.col("n")) - F.ln(F.col("states") / F.lit(float(states.sum())))
    return both.select("q", F.coalesce("reads", F.lit(0)).alias("reads"), "states", ratio.alias("ln_ratio"))


def chain(score, length: int, low: float, high: float, width: float, tolerance: float = 1e-4, min_count: int = 100, flat: float = 0.9, seed: int = 0, burn: int = 1000, most: int | None = None):
    """One Wang-Landau chain: (edges, s, visited, steps). score maps codes of a sequence to a number.

    A bin counts as visited once the chain has been there. Proposals change one base to one of the others. f is halved
    when all visited bins have more than min_count hits and at least `flat` of the mean, until it is at the tolerance. most: steps
    after which to give up, with an error; by default never.
    """
    rng = np.random.default_rng(seed)
    n = int(np.ceil(round((high - low) / width, 9)))
    s, h, mask = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    place = lambda e: min(n - 1, max(0, int(np.ceil(round((e - low) / width, 9))) - 1))
    x = np.zeros(length, int)
    at = place(score(x))
    f, steps, draws = 1.0, 0, None

    def step(add: float):
        nonlocal at, draws, steps
        if steps % 4096 == 0:
            draws = (rng.integers(0, length, 4096), rng.integers(1, 4, 4096), np.log(rng.random(4096)))
        p, up, u = draws[0][steps % 4096], draws[1][steps % 4096], draws[2][steps % 4096]
        old = x[p]
        x[p] = (old + up) % 4
        to = place(score(x))
        if u < s[at] - s[to]:
            at = to
        else:
            x[p] = old
        s[at] += add
        h[at] += 1
        steps += 1

    for _ in range(burn * 10):
        step(1.0)
    mask |= h > 0
    s[:] = 0
    h[:] = 0
    while f > tolerance:
        if most is not None and steps >= most:
            raise ArithmeticError(f"{steps} steps were not enough: f is {f}, not {tolerance}")
        for _ in range(2000):
            step(f)
        new = (h > 0) & ~mask
        if new.any():
            mask |= new
        if h[mask].min() > min_count and h[mask].min() >= flat * h[mask].mean():
            f /= 2
            h[:] = 0
    return low + width * np.arange(1, n + 1), s, mask, steps


def densities(tasks: DataFrame, score_of, length: int, low: float, high: float, width: float, **kw) -> DataFrame:
    """(task, score, s): a chain for each row of tasks (task, seed), spread over the executors. score_of(task) gives the scoring function."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t, seed in zip(pdf["task"], pdf["seed"]):
            edges, s, mask, _ = chain(score_of(t), length, low, high, width, seed=int(seed), **kw)
            out.append(pd.DataFrame({"task": t, "score": edges[mask], "s": s[mask]}))
        return pd.concat(out) if out else pd.DataFrame({"task": [], "score": [], "s": []})

    kind = tasks.schema["task"].dataType.simpleString()
    return tasks.groupBy("task").applyInPandas(run, f"task {kind}, score double, s double")


def normalized(dos: DataFrame, length: int, by: list[str] | None = None) -> DataFrame:
    """s shifted so that the numbers of states add up to 4^length."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    top = F.max("s").over(w)
    total = F.ln(F.sum(F.exp(F.col("s") - F.col("_top"))).over(w)) + F.col("_top")
    return dos.withColumn("_top", top).withColumn("s", F.col("s") - total + F.lit(float(length * np.log(4)))).drop("_top")


def restart_log(rows: DataFrame, order: str = "i", step: str = "step") -> DataFrame:
    """Steps of restarted chains on one axis: a null step marks a restart, later steps start from the last one before it."""
    from .compare import running_sums

    segment = running_sums(rows.withColumn("_restart", F.col(step).isNull().cast("int")), order, ["_restart"]).withColumnRenamed("_restart_sum", "segment").drop("_restart", "_restart_all")
    # Segments may be as many as rows: their offsets are running sums over ranges too.
    last = segment.groupBy("segment").agg(F.coalesce(F.max(step), F.lit(0)).cast("long").alias("last"))
    before = running_sums(last, "segment", ["last"]).select("segment", (F.col("last_sum") - F.col("last")).alias("offset"))
    return segment.join(before, "segment").where(F.col(step).isNotNull()).select(order, "segment", (F.col(step) + F.col("offset")).alias("total_step"))
