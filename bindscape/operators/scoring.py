"""Sliding-window affinities of probes, as Column expressions and as an Arrow pass; scores, peaks, logos, best sequences.

The Column path explodes strand and frame and looks up each frame by chunks of its bases, so it stays in whole-stage codegen; nested higher-order functions give the same numbers many times slower. The Arrow path is for
fits, where a table is scored again and again.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from bindscape.functions import dna

from .params import BASES, Mode, Model


#: Bases of a chunk whose weights are one lookup (one more where dinucleotides cross its end).
CHUNK = 5
#: Probes whose codes are looked up at once.
BLOCK = 8192


def chunk_tables(mode: Mode) -> list[tuple[int, int, np.ndarray]]:
    """(first position, bases, sum of nucleotide and dinucleotide weights by code) for each chunk of a mode."""
    out = []
    for first in range(0, mode.k, CHUNK):
        last = min(mode.k, first + CHUNK)
        width = last - first + (mode.di is not None and last < mode.k)
        base = np.array([np.arange(4**width) // 4 ** (width - 1 - j) % 4 for j in range(width)])
        table = sum(mode.nuc[first + j][base[j]] for j in range(last - first))
        if mode.di is not None:
            table = table + sum(mode.di[first + j][4 * base[j] + base[j + 1]] for j in range(width - 1))
        out.append((first, width, table))
    return out


def weight_term(mer: Column, mode: Mode) -> Column:
    """Sum of the weights of nucleotides and pairs of a k-mer column: one lookup by code for each chunk, one for each pair further apart. Null for other letters."""
    known = F.when(mer.rlike(f"^[ACGT]{{{mode.k}}}$"), mer)
    terms = [F.element_at(F.lit(t), dna.encode_short(F.substring(known, first + 1, width)).cast("int") + 1) for first, width, t in chunk_tables(mode)]
    pair = lambda i, j: F.concat(F.substring(known, i + 1, 1), F.substring(known, j + 1, 1))
    terms += [F.element_at(F.lit(pairs[j]), dna.encode_short(pair(j, j + d)).cast("int") + 1) for d, pairs in mode.far.items() for j in range(mode.k - d)]
    return reduce(lambda a, b: a + b, terms)


def frames(df: DataFrame, k: int, model_flank: int = 0, left: str = "", right: str = "", seq: str = "seq", margin: int = 0) -> DataFrame:
    """df with a row for each strand and frame: strand, frame (from 0 in the strand's own direction), mer.

    margin: bases of context kept on both sides of the window, for shape.
    """
    text = dna.with_flanks(F.col(seq), left, right, model_flank, margin)
    both = df.withColumn("_t", text).withColumn("_s", F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("_t").alias("t")), F.struct(F.lit("-").alias("strand"), dna.reverse_complement("_t").alias("t")))))
    both = both.withColumn("strand", F.col("_s.strand")).withColumn("_t", F.col("_s.t")).drop("_s")
    last = F.length("_t") - k - 2 * margin
    out = both.where(last >= 0).withColumn("frame", F.explode(F.sequence(F.lit(0), last)))
    return out.withColumn("mer", F.substring("_t", F.col("frame") + 1, F.lit(k + 2 * margin))).drop("_t")


def shape_values(shape: DataFrame, features: int) -> np.ndarray:
    """(1024, features) from a shape table: 1024 rows a feature reach the driver. 5-mers that it lacks have 0."""
    out = np.zeros((1024, features))
    for r in shape.where(F.col("feature_no") < features).groupBy("pentamer", "feature_no").agg(F.sum("value").alias("value")).collect():
        out[int("".join(str(BASES.index(c)) for c in r["pentamer"]), 4), r["feature_no"]] = r["value"]
    return out


def frame_affinities(df: DataFrame, model: Model, left: str = "", right: str = "", seq: str = "seq", shape: DataFrame | None = None) -> DataFrame:
    """Every frame's kappa: mode, strand, frame, mer, kappa. shape: (pentamer, feature_no from 0, value), at most 1024 rows a feature."""
    out = None
    for m, mode in enumerate(model.modes):
        if mode.shape is None:
            one = frames(df, mode.k, model.flank, left, right, seq)
            one = one.withColumn("kappa", F.exp(weight_term(F.col("mer"), mode)))
        else:
            if shape is None:
                raise ValueError("a mode with shape weights needs a shape table")
            one = frames(df, mode.k, model.flank, left, right, seq, margin=2)
            inner, values = F.substring("mer", 3, mode.k), shape_values(shape, mode.shape.shape[1])
            # The shape part of each window comes from k tables of 1024 sums, one lookup for each position.
            parts = [F.element_at(F.lit(values @ mode.shape[j]), dna.encode_short(F.substring("mer", j + 1, 5)).cast("int") + 1) for j in range(mode.k)]
            one = one.withColumn("kappa", F.exp(reduce(lambda a, b: a + b, parts, weight_term(inner, mode)))).withColumn("mer", inner)
        one = one.withColumn("mode", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def with_coded_weight(df: DataFrame, model: Model, left: str, right: str, length: int, seq: str = "seq", out: str = "w") -> DataFrame:
    """df with W of probes of one length in a column named out; null for other lengths and letters.

    A probe becomes one number, two bits a base; a chunk of a frame is a shift and a mask of it, and a lookup of its exp(weights), in NumPy over
    the task's batches: one Column expression of all frames may outgrow what the JVM compiles (not verified).
    The reverse strand is the turned mode on the same number. Nothing is exploded or shuffled.
    """
    n = length + 2 * model.flank
    name = next(x for x in (f"code_{k}" for k in range(1000)) if x not in df.columns)
    coded = df.withColumn(name, F.when(F.col(seq).rlike(f"^[ACGT]{{{length}}}$"), dna.encode(dna.with_flanks(F.col(seq), left, right, model.flank))))
    if out in df.columns:
        coded = coded.drop(out)
    kept = [f for f in coded.schema.fields if f.name != name]
    ns = 0.0 if model.ns is None else float(np.exp(model.ns))
    modes = [(m.k, [(first, width, np.exp(t)) for first, width, t in chunk_tables(m)]) for x in model.modes for m in (x, x.reverse_complement())]

    def weights(code: np.ndarray) -> np.ndarray:
        total = np.full(len(code), ns)
        for k, tables in modes:
            for frame in range(n - k + 1):
                parts = [t[code >> 2 * (n - frame - first - width) & 4**width - 1] for first, width, t in tables]
                total += reduce(np.multiply, parts)
        return total

    def run(batches):
        for b in batches:
            code = b.column(name)
            x = code.fill_null(0).to_numpy()
            w = np.concatenate([np.zeros(0), *(weights(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK))])
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(w, mask=code.is_null().to_numpy(zero_copy_only=False))], names=[*(f.name for f in kept), out])

    return coded.mapInArrow(run, StructType([*(StructField(f.name, f.dataType) for f in kept), StructField(out, DoubleType())]))


def probe_weights(df: DataFrame, model: Model, left: str = "", right: str = "", seq: str = "seq", shape: DataFrame | None = None, length: int | None = None) -> DataFrame:
    """(seq, w): sum of all frames' kappa of both strands and modes, and non-specific binding. seq must be distinct.

    length: of all probes, where they have one; up to 32 bases with their flanks and without shape or pairs further apart, ``with_coded_weight`` does it.
    """
    if length is not None and length + 2 * model.flank <= 32 and all(m.shape is None and not m.far for m in model.modes):
        return with_coded_weight(df.select(seq), model, left, right, length, seq)
    ns = 0.0 if model.ns is None else float(np.exp(model.ns))
    k = frame_affinities(df.select(seq), model, left, right, seq, shape)
    return k.groupBy(seq).agg((F.sum("kappa") + F.lit(ns)).alias("w"))


def codes(seqs: list[str]) -> np.ndarray:
    """(n, length) of 0..3 for A, C, G, T; 4 otherwise. All of one length."""
    table = np.full(256, 4, np.uint8)
    for k, b in enumerate(BASES):
        table[ord(b)] = table[ord(b.lower())] = k
    return table[np.frombuffer("".join(seqs).encode("ascii", "replace"), np.uint8)].reshape(len(seqs), -1) if seqs else np.zeros((0, 0), np.uint8)


def kappas(x: np.ndarray, mode: Mode, shape: np.ndarray | None = None) -> np.ndarray:
    """(n, frames) of one strand. x: codes (n, length), with two bases of context on both sides for shape (1024, features)."""
    margin = 2 if mode.shape is not None else 0
    n = x.shape[1] - 2 * margin - mode.k + 1
    out = np.zeros((len(x), max(0, n)))
    for s in range(max(0, n)):
        for j in range(mode.k):
            p = s + j + margin
            out[:, s] += mode.nuc[j][x[:, p]]
            if mode.di is not None and j < mode.k - 1:
                out[:, s] += mode.di[j][4 * x[:, p].astype(int) + x[:, p + 1]]
            for d, pairs in mode.far.items():
                if j < mode.k - d:
                    out[:, s] += pairs[j][4 * x[:, p].astype(int) + x[:, p + d]]
            if margin:
                five = sum(x[:, p - 2 + i].astype(int) * 4 ** (4 - i) for i in range(5))
                out[:, s] += shape[five] @ mode.shape[j]
    return np.exp(out)


def score_sequences(df: DataFrame, mode: Mode, seq: str = "seq", keys: list[str] | None = None, rescale: float = 1.0, swap: bool = False) -> DataFrame:
    """(keys, pos from 1, strand, window, affinity): affinity relative to the best sequence, both strands of the same window.

    A window that holds an N, or any other letter, has a null affinity on both strands. swap exchanges the strands.
    """
    keys, best = keys or [seq], best_sequence(mode)[1]
    n = F.length(seq) - mode.k
    w = df.where(n >= 0).withColumn("_i", F.explode(F.sequence(F.lit(1), n + 1))).withColumn("window", F.substring(seq, F.col("_i"), F.lit(mode.k)))
    known = F.col("window").rlike("^[ACGT]+$")
    value = lambda c: F.when(known, F.exp(weight_term(c, mode)) / F.lit(best * rescale))
    names = ("-", "+") if swap else ("+", "-")
    both = F.array(F.struct(F.lit(names[0]).alias("strand"), value(F.col("window")).alias("a")), F.struct(F.lit(names[1]).alias("strand"), value(dna.reverse_complement("window")).alias("a")))
    return w.withColumn("_x", F.explode(both)).select(*keys, F.col("_i").alias("pos"), F.col("_x.strand").alias("strand"), "window", F.col("_x.a").alias("affinity"))


def peaks(scored: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The n strongest windows of each sequence; ties by place, forward first. signed_pos is negative on the reverse strand."""
    w = Window.partitionBy(*keys).orderBy(F.desc("affinity"), "pos", "strand")
    out = scored.where("affinity is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return out.withColumn("signed_pos", F.when(F.col("strand") == "-", -F.col("pos")).otherwise(F.col("pos")))


def best_sequence(mode: Mode) -> tuple[str, float]:
    """(sequence, affinity) of the highest sum of nucleotide and dinucleotide weights; the first in A, C, G, T order on ties."""
    score, text = mode.nuc[0].copy(), list(BASES)
    for j in range(1, mode.k):
        step = mode.nuc[j][None, :] + score[:, None] + (mode.di[j - 1].reshape(4, 4) if mode.di is not None else 0)
        first = step.argmax(axis=0)
        score, text = step[first, range(4)], [text[a] + b for a, b in zip(first, BASES)]
    k = int(score.argmax())
    return text[k], float(np.exp(score[k]))


def model_info(model: Model) -> list[tuple[int, int, float, str]]:
    """(mode, k, ln of its top affinity relative to the strongest, best sequence); mode -1 is non-specific binding."""
    best = [best_sequence(m) for m in model.modes]
    top = max(a for _, a in best)
    out = [(i, m.k, float(np.log(a / top)), s) for i, (m, (s, a)) in enumerate(zip(model.modes, best))]
    if model.ns is not None:
        out.append((-1, 0, float(model.ns - np.log(top)), ""))
    return out


def logo(mode: Mode, left: int = 0, right: int = 0) -> np.ndarray:
    """(4, positions) energy logo: log affinities of single-base mutants of the best sequence, less each position's mean.

    left, right: columns added (as NaN) or, if negative, taken away.
    """
    if mode.di is None:
        m = mode.nuc.T.copy()
    else:
        best, top = best_sequence(mode)
        m = np.zeros((4, mode.k))
        for j in range(mode.k):
            for b in range(4):
                x = codes([best[:j] + BASES[b] + best[j + 1 :]])
                m[b, j] = np.log(kappas(x, Mode(mode.nuc, mode.di))[0, 0] / top)
    m -= m.mean(axis=0, keepdims=True)
    m = m[:, max(0, -left) : m.shape[1] - max(0, -right)]
    return np.pad(m, ((0, 0), (max(0, left), max(0, right))), constant_values=np.nan)
