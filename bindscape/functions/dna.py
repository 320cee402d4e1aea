"""DNA scalar functions as Column expressions: no UDF, whole-stage codegen throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGT"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode(seq: Column | str) -> Column:
    """Two bits a base, last base in the low bits; A, C, G, T = 0..3. 32 bases fill a long, whose sign is then the first base's
    high bit; more than 32 bases give null."""
    s = _col(seq)
    digits = F.translate(s, BASES, "0123")
    low = F.conv(F.substring(digits, -16, 16), 4, 10).cast("long")
    head = F.conv(F.substring(digits, 1, F.length(s) - 16), 4, 10).cast("long")
    return F.when(F.length(s) <= 16, low).when(F.length(s) <= 32, F.shiftleft(head, 32).bitwiseOR(low))


def encode_short(seq: Column | str) -> Column:
    """encode for up to 16 bases, in fewer steps."""
    return F.conv(F.translate(_col(seq), BASES, "0123"), 4, 10).cast("long")


def decode(code: Column | str, length: Column | int) -> Column:
    """The sequence of a code; codes of 32 bases may be negative."""
    n = F.lit(length) if isinstance(length, int) else length
    c = _col(code).cast("long")
    half = lambda x: F.lpad(F.conv(x.cast("string"), 10, 4), 16, "0")
    digits = F.concat(half(F.shiftrightunsigned(c, 32)), half(c.bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.translate(F.lpad(F.substring(digits, F.lit(33) - n, n), n, "0"), "0123", BASES)


def reverse(seq: Column | str) -> Column:
    return F.reverse(_col(seq))


def complement(seq: Column | str) -> Column:
    return F.translate(_col(seq), BASES + "acgt", "TGCAtgca")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def base_index(base: Column | str) -> Column:
    """0..3 for A, C, G, T or U in either case, 4 for N, -1 for anything else."""
    b = F.translate(F.upper(_col(base)), "U", "T")
    return F.when(b == "N", 4).when(F.length(b) != 1, -1).otherwise(F.instr(F.lit(BASES), b) - 1).cast("int")


def is_sequence(seq: Column | str) -> Column:
    """At least one base, and only bases or N; null for null."""
    return _col(seq).rlike("^[ACGTUNacgtun]+$")


def checked(seq: Column | str) -> Column:
    """seq, or an error that names it."""
    s = _col(seq)
    return F.when(is_sequence(s), s).otherwise(F.raise_error(F.concat(F.lit("not a sequence: "), F.coalesce(s, F.lit("null")))))


def with_flanks(seq: Column | str, left: str, right: str, flank: int, more: int = 0) -> Column:
    """The variable region with the nearest flank (+ more) bases of both flanks."""
    n = flank + more
    return F.concat(F.lit(left[-n:] if n else ""), _col(seq), F.lit(right[:n]))


def windows(seq: Column | str, k: int) -> Column:
    """Array of the k-mers in order; empty if the sequence is shorter."""
    s = _col(seq)
    n = F.length(s) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(s, i, k))).otherwise(F.array().cast("array<string>"))


def base_count(seq: Column | str, base: str) -> Column:
    s = _col(seq)
    return F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))


def longest_run(seq: Column | str, base: str) -> Column:
    runs = F.transform(F.regexp_extract_all(_col(seq), F.lit(f"({base}+)"), F.lit(1)), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def is_repetitive(seq: Column | str, count: int, run: int) -> Column:
    """Some base comes count times or more and also run times or more in a row.

    One expression that names the sequence once: as a filter it may be moved to where the sequence is still to be worked out.
    """
    return _col(seq).rlike("(?s)^(?:" + "|".join(f"(?=(?:[^{b}]*{b}){{{count}}}).*{b}{{{run}}}" for b in BASES) + ")")


def matches_any(seq: Column | str, patterns: list[str]) -> Column:
    return _col(seq).rlike("|".join(patterns)) if patterns else F.lit(False)


def uniform(*key: Column | str) -> Column:
    """Number in [0, 1) from the md5 of a key; the same in any engine with md5."""
    digest = F.md5(F.concat_ws("-", *[_col(k).cast("string") for k in key]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mutate_one(seq: Column | str, *key: Column | str) -> Column:
    """One position, drawn by the key, gets one of the other three bases."""
    s = _col(seq)
    at = (F.floor(uniform(*key, F.lit("at")) * F.length(s)) + 1).cast("int")
    step = (F.floor(uniform(*key, F.lit("base")) * 3) + 1).cast("int")
    old = F.instr(F.lit(BASES), F.substring(s, at, F.lit(1))) - 1
    return F.concat(F.substring(s, F.lit(1), at - 1), F.substring(F.lit(BASES), (old + step) % 4 + 1, F.lit(1)), F.substring(s, at + 1, F.length(s)))


def mutants(df: DataFrame, seq: str = "seq") -> DataFrame:
    """df with a row for each position and base: pos (from 1), base, mutant."""
    s = _col(seq)
    out = df.withColumn("pos", F.explode(F.sequence(F.lit(1), F.length(s)))).withColumn("base", F.explode(F.array(*map(F.lit, BASES))))
    return out.withColumn("mutant", F.overlay(s, F.col("base"), F.col("pos"), F.lit(1)))


def model_id(text: Column | str) -> Column:
    """(major, minor) of an id like D00102.002; null if it is none."""
    t = _col(text)
    part = lambda k: F.regexp_extract(t, r"^D(\d{5})\.(\d{3})$", k).cast("int")
    return F.when(t.rlike(r"^D\d{5}\.\d{3}$"), F.struct(part(1).alias("major"), part(2).alias("minor")))


def format_model_id(major: Column, minor: Column) -> Column:
    return F.format_string("D%05d.%03d", major, minor)


def consensus(weights: DataFrame, by: list[str] | None = None, pos: str = "pos", base: str = "base", value: str = "beta") -> DataFrame:
    """Best base at each position in order, first of A, C, G, T on ties."""
    by = by or []
    best = weights.groupBy(*by, pos).agg(F.max(F.struct(F.col(value), (-F.instr(F.lit(BASES), F.col(base))).alias("first"), F.col(base).alias("b"))).alias("top"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos), F.col("top.b")))), lambda x: x["b"])
    return best.groupBy(*by).agg(F.concat_ws("", ordered).alias("consensus"))


def shape_profile(df: DataFrame, shape: DataFrame, seq: str = "seq", key: str = "seq") -> DataFrame:
    """(key, pos, feature, value): shape values of the 5-mer centred at each position; shape is a table of 1024 5-mers at most per feature."""
    s = _col(seq)
    mers = df.select(F.col(key), F.explode(F.sequence(F.lit(3), F.length(s) - 2)).alias("pos"), s.alias("_s")).select(key, "pos", F.substring("_s", F.col("pos") - 2, F.lit(5)).alias("pentamer"))
    return mers.join(F.broadcast(shape), "pentamer").select(key, "pos", "feature", "value")
