"""Probe tables: (seq, cnt) with distinct sequences, and what is counted on them."""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindscape.functions import dna


def derived_probes(spark: SparkSession, sf_dir: str, length: int, salt: str = "") -> DataFrame:
    """One DNA read for each line item, from its keys; (read columns kept, seq)."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.concat(F.lit(salt), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return items.withColumn("seq", F.substring(F.translate(F.md5(key.cast("binary")), "0123456789abcdef", "AAAAACCCGGGGTTTT"), 1, length))


def count_probes(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """Distinct sequences and how often each was read. One shuffle, partial counts first."""
    return reads.groupBy(F.col(seq).alias("seq")).agg(F.count(F.lit(1)).alias("cnt"))


def top_probes(counted: DataFrame, n: int = 100) -> DataFrame:
    return counted.orderBy(F.desc("cnt"), "seq").limit(n)


def total_count(counted: DataFrame) -> DataFrame:
    return counted.agg(F.sum("cnt").cast("long").alias("n_count"))


def entropy_bound(counted: DataFrame) -> DataFrame:
    """n ln n - sum c ln c: no model's negative log likelihood is lower."""
    n = F.sum("cnt")
    return counted.where("cnt > 0").agg((n * F.ln(n) - F.sum(F.col("cnt") * F.ln("cnt"))).alias("bound"))


def drop_reason(seq: Column, max_count: int | None, max_run: int | None, patterns: list[str]) -> Column:
    repeats = dna.is_repetitive(seq, max_count, max_run) if max_count and max_run else F.lit(False)
    return repeats | dna.matches_any(seq, patterns)


def filter_probes(counted: DataFrame, max_count: int | None = None, max_run: int | None = None, patterns: list[str] | None = None) -> DataFrame:
    return counted.where(~drop_reason(F.col("seq"), max_count, max_run, patterns or []))


def removed_reads(counted: DataFrame, max_count: int | None = None, max_run: int | None = None, patterns: list[str] | None = None) -> DataFrame:
    """(kept, removed) reads, in one pass."""
    dropped = drop_reason(F.col("seq"), max_count, max_run, patterns or [])
    return counted.agg(F.coalesce(F.sum(F.when(~dropped, F.col("cnt"))), F.lit(0)).cast("long").alias("kept"), F.coalesce(F.sum(F.when(dropped, F.col("cnt"))), F.lit(0)).cast("long").alias("removed"))


def merge(*counted: DataFrame) -> DataFrame:
    """All rows of compatible tables; sequences may come twice."""
    return reduce(lambda a, b: a.unionByName(b), [c.select("seq", "cnt") for c in counted])


def combine(*counted: DataFrame) -> DataFrame:
    """(seq, r0, r1, ...): counts of each table side by side, 0 where it lacks the sequence. One shuffle for any number of tables."""
    names = [f"r{k}" for k in range(len(counted))]
    tagged = reduce(lambda a, b: a.unionByName(b), [c.select("seq", *[(F.col("cnt") if j == k else F.lit(0)).cast("long").alias(x) for j, x in enumerate(names)]) for k, c in enumerate(counted)])
    return tagged.groupBy("seq").agg(*[F.sum(x).alias(x) for x in names])


def store_round(counted: DataFrame, table: str, number: int, buckets: int, path: str | None = None) -> None:
    """Add a round's counts to a table that holds each round as a partition, dealt to buckets by sequence and sorted in them.

    The shuffle that this takes is the last one: rounds that are stored meet bucket by bucket. All rounds of a table have the same number of buckets.
    """
    own = counted.select("seq", F.col("cnt").cast("long").alias("cnt"), F.lit(number).alias("round")).repartition(buckets, "seq")
    writer = own.write.mode("append").partitionBy("round").bucketBy(buckets, "seq").sortBy("seq")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def combine_stored(spark: SparkSession, table: str, rounds: list[int]) -> DataFrame:
    """(seq, r<number> for each round): counts of stored rounds side by side, 0 where a round lacks the sequence. No exchange; other rounds aren't read."""
    kept = spark.table(table).where(F.col("round").isin(rounds))
    return kept.groupBy("seq").agg(*[F.sum(F.when(F.col("round") == n, F.col("cnt")).otherwise(0)).alias(f"r{n}") for n in rounds])


def binomial_quantiles(n: int, ratio: float, u: np.ndarray) -> np.ndarray:
    """For each u in [0, 1): the least k with P(X <= k) >= u, X being binomial. Chances beyond 12 deviations, under 1e-30, are left out."""
    if n <= 0 or ratio <= 0:
        return np.zeros(len(u), np.int64)
    if ratio >= 1:
        return np.full(len(u), n, np.int64)
    far = 12 * math.sqrt(n * ratio * (1 - ratio)) + 12
    low, high = max(0, int(n * ratio - far)), min(n, int(n * ratio + far) + 1)
    k = np.arange(low, high, dtype=float)
    steps = np.log((n - k) / (k + 1)) + math.log(ratio / (1 - ratio))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.exp(logs - logs.max())
    total = np.cumsum(chances)
    return low + np.minimum(np.searchsorted(total, u * total[-1]), high - low)


def folds(counted: DataFrame, ratio: float, numbers: list[int]) -> DataFrame:
    """(seq, train_f, test_f for each fold number f): how many of a sequence's reads are test reads, each with the given chance.

    One binomial draw for a sequence, from a number that its letters and the fold give: nothing is made for single reads, nothing is
    shuffled, and the draws are the same wherever and whenever they are made. Counts up to 2^62; null counts as 0.
    """
    own = counted.select("seq", F.coalesce(F.col("cnt").cast("long"), F.lit(0)).alias("cnt"), *[dna.uniform("seq", F.lit(f)).alias(f"u{f}") for f in numbers])

    def run(batches):
        for b in batches:
            cnt, out = b.column("cnt").to_numpy(), [b.column("seq")]
            order = np.argsort(cnt, kind="stable")
            edges = np.flatnonzero(np.diff(cnt[order], prepend=-1, append=-1))
            for f in numbers:
                u, test = b.column(f"u{f}").to_numpy(), np.zeros(len(cnt), np.int64)
                for i, j in itertools.pairwise(edges):
                    at = order[i:j]
                    test[at] = binomial_quantiles(int(cnt[at[0]]), ratio, u[at])
                out += [pa.array(np.maximum(cnt, 0) - test), pa.array(test)]
            yield pa.RecordBatch.from_arrays(out, names=["seq", *[f"{x}_{f}" for f in numbers for x in ("train", "test")]])

    return own.mapInArrow(run, "seq string, " + ", ".join(f"train_{f} long, test_{f} long" for f in numbers))


def split_reads(counted: DataFrame, ratio: float, fold: int = 0) -> DataFrame:
    """(seq, train, test): one fold of ``folds``."""
    return folds(counted, ratio, [fold]).toDF("seq", "train", "test")


def rounds(spark: SparkSession, sf_dir: str, length: int) -> DataFrame:
    """(seq, r0, r1) from line items of two statuses."""
    reads = derived_probes(spark, sf_dir, length)
    return combine(count_probes(reads.where("l_linestatus = 'F'")), count_probes(reads.where("l_linestatus = 'O'")))
