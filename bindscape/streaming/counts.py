"""Probe and k-mer counts over a stream of reads, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindscape.functions import dna
from bindscape.operators.probes import count_probes


def stream_probe_counts(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """Running (seq, cnt); write in update or complete mode. Works on a batch table as well."""
    return count_probes(reads, seq)


def stream_kmer_counts(reads: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Running (kmer, n): at most 4^k groups of state."""
    return reads.select(F.explode(dna.windows(F.col(seq), k)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
