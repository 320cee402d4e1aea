"""Lookups in order, pairs of scores, Markov likelihoods, shifts, folds, growth, files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bindscape.operators import background, fitting, objective, probes, registry, scoring
from bindscape.sources import reads

from .catalog import all_sql, counted, counted_sql, query, table, toy_background, toy_mode, weight_sql
from .queries_model import _selected


@query("J4_score_pairs", f"select seq, round({weight_sql('seq', 6)}, 9) as first, round({weight_sql('seq', 6, number=1)}, 9) as second from {counted_sql(6)}")
def j4(spark, sf):
    """Two scores of a row in one projection, instead of pasting two files line by line."""
    one, two = (F.round(scoring.weight_term(F.col("seq"), toy_mode(6, number=k)), 9) for k in (0, 1))
    return counted(spark, sf, 6).select("seq", one.alias("first"), two.alias("second"))


@query("M11_info_in_order", "select v.place::bigint as place, v.id::bigint as id, n_name from (values (1, 7), (2, 3), (3, 99), (4, 0)) v(place, id) left join nation on n_nationkey = v.id")
def m11(spark, sf):
    ids = spark.createDataFrame([(1, 7), (2, 3), (3, 99), (4, 0)], "place long, id long")
    return registry.in_order(ids, table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name")).select("place", "id", "n_name")


@query("R2_same_model", "select a.o_orderkey as a, b.o_orderkey as b from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority where a.o_orderstatus = 'F' and b.o_orderstatus = 'O'")
def r2(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    got = registry.same_model(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), ("o_custkey", "o_orderpriority"))
    return got.select(F.col("o_orderkey").alias("a"), F.col("o_orderkey_b").alias("b"))


_P3 = f"(select kmer, n / sum(n) over (partition by substr(kmer, 1, 2)) as p from (select kmer, sum(cnt) as n from (select cnt, substr(seq, i, 3) as kmer from (select cnt, seq, unnest(range(1, 5)) as i from {counted_sql(6)})) group by kmer))"


@query("A21_markov_likelihood", f"with p as {_P3}, z as (select ln(sum(exp(lp))) as z from (select seq, sum(ln(p)) as lp from (select seq, substr(seq, i, 3) as kmer from (select seq, unnest(range(1, 5)) as i from {all_sql(6)})) join p using (kmer) group by seq)) select round((select sum(cnt) from {counted_sql(6)}) * z - v, 3) as value from z cross join (select sum(cnt * ln(p)) as v from (select cnt, substr(seq, i, 3) as kmer from (select cnt, seq, unnest(range(1, 5)) as i from {counted_sql(6)})) join p using (kmer))")
def a21(spark, sf):
    c = counted(spark, sf, 6)
    return background.markov_likelihood(c, background.markov_by_division(c, 3), 3, 6).select(F.round("value", 3).alias("value"))


def _chances_sql(source: str, k: int, length: int) -> str:
    kmers = f"(select cnt, substr(seq, i, {k}) as kmer from (select cnt, seq, unnest(range(1, {length - k + 2})) as i from {source}))"
    return f"(select kmer, n / sum(n) over (partition by substr(kmer, 1, {k - 1})) as p from (select kmer, sum(cnt) as n from {kmers} group by kmer))"


def _walked_sql(k: int, length: int) -> str:
    """ln of the sum over all sequences of the product of chances p: heads of k - 1 bases, step by step."""
    steps = [f"w0 as (select distinct substr(kmer, 1, {k - 1}) as h, 1e0 as w from p)"]
    for i in range(1, length - k + 2):
        steps.append(f"w{i} as (select substr(kmer, 2) as h, sum(w * p) as w from w{i - 1} join p on substr(kmer, 1, {k - 1}) = h group by 1)")
    return f"{', '.join(steps)}, z as (select ln(sum(w)) as z from w{length - k + 1})"


def _log_chance(source: str, k: int, length: int) -> str:
    return f"(select seq, cnt, sum(ln(p)) - any_value(z) as lp, count(p) as known from (select seq, cnt, unnest(range(1, {length - k + 2})) as i from {source}) left join p on kmer = substr(seq, i, {k}) cross join z group by seq, cnt)"


_F16, _O16 = (counted_sql(16, "", f"where l_linestatus = '{x}'") for x in "FO")


@query("A21_markov_order_6", f"with p as {_chances_sql(_F16, 7, 16)}, {_walked_sql(7, 16)} select round(-sum(cnt * lp) filter (where known = 10), 3) as value, coalesce(sum(cnt) filter (where known < 10), 0)::bigint as unseen from {_log_chance(_O16, 7, 16)}")
def a21_16(spark, sf):
    """Sixth order, sixteen bases: chances from one round, stored, loaded, and used for the reads of the other."""
    r, path = probes.derived_probes(spark, sf, 16), _folder(spark, "chances")
    background.markov_by_division(probes.count_probes(r.where("l_linestatus = 'F'")), 7).write.parquet(path)
    got = background.markov_likelihood(probes.count_probes(r.where("l_linestatus = 'O'")), background.markov_tables(spark, path), 7, 16)
    return got.select(F.round("value", 3).alias("value"), "unseen")


def _r2_sql(k: int) -> str:
    f, o = (counted_sql(6, "", f"where l_linestatus = '{x}'") for x in "FO")
    return f"select {k}::bigint as k, round(regr_r2(cnt, exp(lp)), 6) as r2 from (with p as {_chances_sql(f, k, 6)}, {_walked_sql(k, 6)} select * from {_log_chance(o, k, 6)} where known = {6 - k + 1})"


@query("A22_markov_r2", " union all ".join(_r2_sql(k) for k in (2, 3, 4, 5)))
def a22_r2(spark, sf):
    """Models learnt from one round, held against the counts of the other."""
    r = probes.derived_probes(spark, sf, 6)
    f, o = (probes.count_probes(r.where(f"l_linestatus = '{x}'")) for x in "FO")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in background.markov_fit(f, o, [2, 3, 4, 5], 6)], "k long, r2 double")


def _data(spark, sf, penalty=1e-4):
    return objective.Likelihood(_selected(spark, sf), toy_background(1, 6), penalty)


_QUICK = fitting.Settings(tolerance=1e-3, penalty=1e-4)


def _folder(spark, name):
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints/bindscape"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("S2_count_table", f"select seq, cnt from {counted_sql(8)} where not (" + " or ".join(f"(length(seq) - length(replace(seq, '{b}', '')) >= 5 and instr(seq, '{b * 3}') > 0)" for b in "ACGT") + ")")
def s2(spark, sf):
    """Counts written sorted, read back and filtered in the scan."""
    path = _folder(spark, "counts")
    reads.write_counts(counted(spark, sf, 8), path)
    return reads.read_counts(spark, path, 5, 3)


@query("K6_density_file", "select round(floor(o_totalprice / 20000) / 1e1, 6) as score, count(*) * 1e0 as s from orders group by 1")
def k6(spark, sf):
    d = table(spark, sf, "orders").groupBy(F.round(F.floor(F.col("o_totalprice") / 20000) / 10.0, 6).alias("score")).agg((F.count(F.lit(1)) * 1.0).alias("s"))
    path = _folder(spark, "density")
    reads.write_density(d, path)
    return reads.read_tsv(spark, path, "density")


@query("J1_stored_rounds", f"select seq, coalesce(a.cnt, 0)::bigint as r0, coalesce(c.cnt, 0)::bigint as r2 from {counted_sql(6)} a full join {counted_sql(6, 'y')} c using (seq)")
def j1_stored(spark, sf):
    """Three rounds stored in buckets, two of them merged without a shuffle."""
    name = f"rounds_{uuid.uuid4().hex}"
    path = _folder(spark, "rounds")
    for number, salt in enumerate(("", "x", "y")):
        probes.store_round(counted(spark, sf, 6, salt), name, number, 8, path)
    return probes.combine_stored(spark, name, [0, 2])
