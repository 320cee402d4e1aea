"""The catalog that query modules fill, and the fixtures that they share with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindscape.functions import dna
from bindscape.operators import probes
from bindscape.operators.background import Background
from bindscape.operators.params import Mode, Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LEFT, RIGHT = "ACGTTGCAGTC", "TGGATCCATGA"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str, length: int, salt: str = "") -> DataFrame:
    return probes.derived_probes(spark, sf_dir, length, salt)


def counted(spark: SparkSession, sf_dir: str, length: int, salt: str = "") -> DataFrame:
    return probes.count_probes(reads(spark, sf_dir, length, salt))


def reads_sql(length: int, salt: str = "", where: str = "") -> str:
    key = f"concat('{salt}', cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar))"
    return f"(select substr(translate(md5({key}), '0123456789abcdef', 'AAAAACCCGGGGTTTT'), 1, {length}) as seq from lineitem {where})"


def counted_sql(length: int, salt: str = "", where: str = "") -> str:
    return f"(select seq, count(*) as cnt from {reads_sql(length, salt, where)} group by seq)"


def rc_sql(s: str) -> str:
    return f"reverse(translate({s}, 'ACGT', 'TGCA'))"


def base_sql(s: str, i: str) -> str:
    return f"(instr('ACGT', substr({s}, {i}, 1)) - 1)"


def code_sql(s: str, start: str, k: int) -> str:
    return "(" + " + ".join(f"{4 ** (k - 1 - j)} * {base_sql(s, f'{start} + {j}')}" for j in range(k)) + ")"


def uniform_sql(*key: str) -> str:
    """dna.uniform: the first eight hex digits of an md5 as a share."""
    joined = f"md5(concat_ws('-', {', '.join(f'cast({k} as varchar)' for k in key)}))"
    digits = " + ".join(f"{16 ** (7 - i)}::bigint * (instr('0123456789abcdef', substr({joined}, {i + 1}, 1)) - 1)" for i in range(8))
    return f"(({digits}) / 4294967296e0)"


def folds_sql(source: str, ratio: float, numbers: list[int]) -> str:
    """probes.folds: for each fold the number of test reads whose cumulated binomial chance is below the sequence's number."""
    ln = f"lgamma(cnt + 1) - lgamma(k + 1) - lgamma(cnt - k + 1) + k * ln({ratio}e0) + (cnt - k) * ln(1 - {ratio}e0)"
    chances = f"(select seq, cnt, k, sum(exp({ln})) over (partition by seq order by k) as f from (select seq, cnt, unnest(range(0, cnt)) as k from {source}))"
    drawn = f"(select seq, {', '.join(f'sum((f < u{n})::int)::bigint as test_{n}' for n in numbers)} from (select *, {', '.join(f'{uniform_sql("seq", str(n))} as u{n}' for n in numbers)} from {chances}) group by seq)"
    return f"(select seq, {', '.join(f'cnt - coalesce(test_{n}, 0) as train_{n}, coalesce(test_{n}, 0) as test_{n}' for n in numbers)} from {source} left join {drawn} using (seq))"


def toy_mode(k: int, di: bool = False, features: int = 0, number: int = 0) -> Mode:
    """Fixed weights by formula, the same in SQL."""
    nuc = np.array([[((7 * j + 5 * b + 3 * number) % 11) / 10 - 0.5 for b in range(4)] for j in range(k)])
    pair = np.array([[((3 * j + 2 * x) % 7) / 20 - 0.15 for x in range(16)] for j in range(k - 1)]) if di else None
    shape = np.array([[((j + 2 * f) % 5) / 50 for f in range(features)] for j in range(k)]) if features else None
    return Mode(nuc, pair, shape)


def toy_model(k: int, di: bool = False, features: int = 0, ns: float | None = None, flank: int = 0, modes: int = 1) -> Model:
    return Model([toy_mode(k, di, features, m) for m in range(modes)], ns, flank)


def toy_background(k: int, length: int) -> Background:
    return Background(np.array([((3 * i) % 13) / 20 - 0.3 for i in range(4**k)]), k, length, LEFT, RIGHT)


def background_weight_sql(s: str, k: int, length: int) -> str:
    """ln of the toy background's weight of a variable region."""
    a, b = (LEFT[-(k - 1) :], RIGHT[: k - 1]) if k > 1 else ("", "")
    text = f"concat('{a}', {s}, '{b}')"
    return "(" + " + ".join(f"(((3 * {code_sql(text, str(i + 1), k)}) % 13) / 2e1 - 3e-1)" for i in range(length + len(a) + len(b) - k + 1)) + ")"


def weight_sql(mer: str, k: int, di: bool = False, number: int = 0) -> str:
    terms = [f"(((7 * {j} + 5 * {base_sql(mer, str(j + 1))} + {3 * number}) % 11) / 1e1 - 5e-1)" for j in range(k)]
    if di:
        terms += [f"(((3 * {j} + 2 * {code_sql(mer, str(j + 1), 2)}) % 7) / 2e1 - 15e-2)" for j in range(k - 1)]
    return "(" + " + ".join(terms) + ")"


def frames_sql(source: str, k: int, flank: int = 0, margin: int = 0, keep: str = "seq, cnt") -> str:
    n = flank + margin
    text = f"concat('{LEFT[-n:] if n else ''}', seq, '{RIGHT[:n]}')"
    both = f"(select {keep}, '+' as strand, {text} as t from {source} union all select {keep}, '-' as strand, {rc_sql(text)} as t from {source})"
    return f"(select {keep}, strand, frame, substr(t, frame + 1, {k + 2 * margin}) as mer from (select {keep}, strand, t, unnest(range(0, length(t) - {k + 2 * margin} + 1)) as frame from {both}))"


def kappa_sql(source: str, k: int, di: bool = False, flank: int = 0, features: int = 0, number: int = 0, keep: str = "seq, cnt") -> str:
    if not features:
        return f"(select {keep}, strand, frame, mer, exp({weight_sql('mer', k, di, number)}) as kappa from {frames_sql(source, k, flank, 0, keep)})"
    inner = f"substr(mer, 3, {k})"
    shape = " + ".join(f"((({j} + {2 * f}) % 5) / 5e1) * {shape_value_sql(f'substr(mer, {j + 1}, 5)', f)}" for j in range(k) for f in range(features))
    return f"(select {keep}, strand, frame, {inner} as mer, exp({weight_sql(inner, k, di, number)} + {shape}) as kappa from {frames_sql(source, k, flank, 2, keep)})"


def shape_table(spark: SparkSession, features: int) -> DataFrame:
    """(pentamer, feature_no, feature, value): made-up shape values by formula."""
    code = F.col("id") % 1024
    f = F.floor(F.col("id") / 1024).cast("int")
    return spark.range(1024 * features).select(dna.decode(code, 5).alias("pentamer"), f.alias("feature_no"), F.concat(F.lit("F"), f.cast("string")).alias("feature"), (((code * 37 + f * 11) % 101) / 100.0).alias("value"))


def shape_value_sql(pentamer: str, feature: int) -> str:
    return f"((({code_sql(pentamer, '1', 5)} * 37 + {feature * 11}) % 101) / 1e2)"


def shape_values(features: int) -> np.ndarray:
    return np.array([[((c * 37 + f * 11) % 101) / 100 for f in range(features)] for c in range(1024)])


def all_sql(length: int) -> str:
    """All sequences of a length."""
    base = "['A', 'C', 'G', 'T']"
    digits = ", ".join(f"({base})[cast(floor(id / {4 ** (length - 1 - i)}) as bigint) % 4 + 1]" for i in range(length))
    return f"(select concat({digits}) as seq from (select unnest(range(0, {4**length})) as id))"
