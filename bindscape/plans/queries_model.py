"""Scoring, backgrounds, partition functions, likelihoods, fits, networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.operators import objective, probes, scoring
from bindscape.operators.params import BASES, Model

from .catalog import LEFT, RIGHT, all_sql, background_weight_sql, counted, counted_sql, kappa_sql, query, rc_sql, shape_table, toy_background, toy_mode, toy_model, weight_sql

L, K = 16, 8


def _w(name, di=False, features=0, flank=0, ns=None, length=L, k=K):
    extra = 0 if ns is None else f"exp({ns}e0)"
    sql = f"select seq, round(sum(kappa) + {extra}, 6) as w from {kappa_sql(counted_sql(length), k, di, flank, features)} group by seq"

    @query(name, sql)
    def run(spark, sf):
        model = toy_model(k, di, features, ns, flank)
        shape = shape_table(spark, features) if features else None
        return scoring.probe_weights(counted(spark, sf, length), model, LEFT, RIGHT, shape=shape, length=length).select("seq", F.round("w", 6).alias("w"))


_w("W0_nuc_flank", flank=3)
_w("W1_di_flank", di=True, flank=3)
_w("W2_shape_flank", features=2, flank=3, length=8, k=4)
_w("W3_di_shape_flank", di=True, features=2, flank=3, length=8, k=4)
_w("W4_nuc", ns=-1)
_w("W5_di", di=True)
_w("W6_shape", features=2, length=8, k=4)
_w("W7_di_shape", di=True, features=2, length=8, k=4)


@query("W8_batch_modes", f"select seq, round(sum(kappa), 6) as w from (select * from {kappa_sql(counted_sql(8), 4)} union all select * from {kappa_sql(counted_sql(8), 4, number=1)}) group by seq")
def w8(spark, sf):
    return scoring.probe_weights(counted(spark, sf, 8), toy_model(4, modes=2), LEFT, RIGHT, length=8).select("seq", F.round("w", 6).alias("w"))


@query("W9_ranker", f"select seq, strand, frame::bigint as frame, round(kappa, 6) as kappa, round(exp({background_weight_sql('seq', 2, 8)}) * (sum(kappa) over (partition by seq)), 6) as weight from {kappa_sql(counted_sql(8), 5)}")
def w9(spark, sf):
    bg = toy_background(2, 8)
    k = scoring.frame_affinities(counted(spark, sf, 8), toy_model(5), LEFT, RIGHT)
    total = k.groupBy("seq").agg(F.sum("kappa").alias("w"))
    return k.join(total, "seq").select("seq", "strand", F.col("frame").cast("long").alias("frame"), F.round("kappa", 6).alias("kappa"), F.round(F.exp(bg._log_weight("seq")) * F.col("w"), 6).alias("weight"))


@query("W10_background_probability", f"with z as (select ln(sum(exp({background_weight_sql('seq', 2, 6)}))) as z from {all_sql(6)}) select seq, round({background_weight_sql('seq', 2, 6)} - z, 9) as log_p from {counted_sql(6)} cross join z")
def w10(spark, sf):
    bg = toy_background(2, 6)
    return counted(spark, sf, 6).select("seq", F.round(bg.log_probability("seq"), 9).alias("log_p"))


_W6 = f"(select seq, cnt, sum(kappa) + exp(-1e0) as w from {kappa_sql(counted_sql(6), 4)} group by seq, cnt)"
_ZN = f"((select sum(pi * kappa) from {kappa_sql(f'''(select seq, exp({background_weight_sql('seq', 2, 6)}) as pi from {all_sql(6)})''', 4, keep='seq, pi')}) / (select sum(exp({background_weight_sql('seq', 2, 6)})) from {all_sql(6)}) + exp(-1e0))"
_Z0 = f"(select ln(sum(exp({background_weight_sql('seq', 2, 6)}))) from {all_sql(6)})"


@query("A8_likelihood", f"select round(sum(cnt) * ln({_ZN}) - sum(cnt * ({background_weight_sql('seq', 2, 6)} - {_Z0} + ln(w))), 2) as value from {_W6}")
def a8(spark, sf):
    data = objective.Likelihood(counted(spark, sf, 6), toy_background(2, 6), cache=False)
    return spark.createDataFrame([(round(float(data.value_gradient(toy_model(4, ns=-1.0))[0]), 2),)], "value double")


_SHARE = f"(select k.mer, k.strand, k.frame, k.cnt * k.kappa / w.w as share from {kappa_sql(counted_sql(6), 4)} k join {_W6} w on k.seq = w.seq)"


@query("A9_feature_gradient", f"select 0::bigint as mode, p as pos, substr(mer, p, 1) as base, round(sum(share), 4) as g from (select mer, share, unnest(range(1, 5)) as p from {_SHARE}) group by all")
def a9(spark, sf):
    g = objective.feature_gradient(counted(spark, sf, 6), toy_background(2, 6), toy_model(4, ns=-1.0))
    return g.select(F.col("mode").cast("long").alias("mode"), F.col("pos").cast("long").alias("pos"), "base", F.round("g", 4).alias("g"))


@query("A9_gradient_vector", f"select (4 * (p - 1) + instr('ACGT', b) - 1)::bigint as i, round(g, 4) as g from (select p, substr(mer, p, 1) as b, sum(share) as g from (select mer, share, unnest(range(1, 5)) as p from {_SHARE}) group by all)")
def a9v(spark, sf):
    data = objective.Likelihood(counted(spark, sf, 6), toy_background(2, 6), cache=False)
    g = data.sums(toy_model(4, ns=-1.0))[1][:-1]
    return spark.createDataFrame([(i, round(float(x), 4)) for i, x in enumerate(g)], "i long, g double")


@query("A10_feature_pairs", f"select 0::bigint as mode, p as pos1, substr(mer, p, 1) as base1, q as pos2, substr(mer, q, 1) as base2, round(sum(share), 4) as h from (select mer, share, p, unnest(range(p, 5)) as q from (select mer, share, unnest(range(1, 5)) as p from {_SHARE})) group by all")
def a10(spark, sf):
    h = objective.feature_pairs(counted(spark, sf, 6), toy_background(2, 6), toy_model(4, ns=-1.0))
    return h.select(F.col("mode").cast("long").alias("mode"), F.col("pos1").cast("long").alias("pos1"), "base1", F.col("pos2").cast("long").alias("pos2"), "base2", F.round("h", 4).alias("h"))


@query("A11_mode_gradient", f"with k as (select 0::bigint as mode, * from {kappa_sql(counted_sql(6), 4)} union all select 1, * from {kappa_sql(counted_sql(6), 4, number=1)}), w as (select seq, sum(kappa) as w from k group by seq) select mode, round(sum(cnt * kappa / w), 4) as g from k join w using (seq) group by mode")
def a11(spark, sf):
    g = objective.mode_gradient(counted(spark, sf, 6), toy_background(2, 6), toy_model(4, modes=2))
    return g.select(F.col("mode").cast("long").alias("mode"), F.round("g", 4).alias("g"))


_KMERS = f"(select kmer, sum(cnt) as n from (select cnt, substr(t, i, 2) as kmer from (select cnt, t, unnest(range(1, length(t))) as i from (select cnt, concat('{LEFT[-1:]}', seq, '{RIGHT[:1]}') as t from {counted_sql(6)}))) group by kmer)"


@query("A6_background_likelihood", f"select round((select sum(cnt) from {counted_sql(6)}) * {_Z0} - sum(n * (((3 * (4 * (instr('ACGT', substr(kmer, 1, 1)) - 1) + instr('ACGT', substr(kmer, 2, 1)) - 1)) % 13) / 2e1 - 3e-1)), 4) as value from {_KMERS}")
def a6(spark, sf):
    from bindscape.operators import background

    c, bg = counted(spark, sf, 6), toy_background(2, 6)
    x = background.count_vector(background.kmer_counts(c, 2, LEFT, RIGHT), 2)
    n = c.agg(F.sum("cnt")).first()[0]
    return spark.createDataFrame([(round(float(background.likelihood(bg, x, n)[0]), 4),)], "value double")


def _affinity_sql(k, source):
    best = f"(select max(exp({weight_sql('seq', k)})) from {all_sql(k)})"
    win = f"(select seq, i as pos, substr(seq, i, {k}) as w from (select seq, unnest(range(1, length(seq) - {k} + 2)) as i from {source}))"
    value = lambda m: f"case when contains(w, 'N') then null else exp({weight_sql(m, k)}) / {best} end"
    return f"(select seq, pos, '+' as strand, w as \"window\", {value('w')} as affinity from {win} union all select seq, pos, '-', w, {value(rc_sql('w'))} from {win})"


_N = f"(select replace(seq, 'TTT', 'NNN') as seq from {counted_sql(10)})"


def _with_n(spark, sf):
    return counted(spark, sf, 10).select(F.replace("seq", F.lit("TTT"), F.lit("NNN")).alias("seq"))


@query("M1_score_windows", f'select seq, pos, strand, "window", round(affinity, 9) as affinity from {_affinity_sql(5, _N)}')
def m1(spark, sf):
    s = scoring.score_sequences(_with_n(spark, sf), toy_mode(5))
    return s.select("seq", F.col("pos").cast("long").alias("pos"), "strand", "window", F.round("affinity", 9).alias("affinity"))


@query("F8_ambiguous_windows", f'select seq, count(*) as n, sum((affinity is null)::int)::bigint as unknown from {_affinity_sql(5, _N)} group by seq')
def f8(spark, sf):
    s = scoring.score_sequences(_with_n(spark, sf), toy_mode(5))
    return s.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("affinity").isNull().cast("long")).alias("unknown"))


@query("M2_peaks", f'select seq, case when strand = \'-\' then -pos else pos end as signed_pos, "window", n as rank from (select *, row_number() over (partition by seq order by round(affinity, 9) desc, pos, strand) as n from {_affinity_sql(5, counted_sql(10))}) where n <= 3')
def m2(spark, sf):
    s = scoring.score_sequences(counted(spark, sf, 10), toy_mode(5)).withColumn("affinity", F.round("affinity", 9))
    return scoring.peaks(s, 3, ["seq"]).select("seq", F.col("signed_pos").cast("long").alias("signed_pos"), "window", F.col("rank").cast("long").alias("rank"))


@query("M6_turned_model", f"select seq, round({weight_sql(rc_sql('seq'), 6, True)}, 9) as weight from {counted_sql(6)}")
def m6(spark, sf):
    return counted(spark, sf, 6).select("seq", F.round(scoring.weight_term(F.col("seq"), toy_mode(6, True).reverse_complement()), 9).alias("weight"))


@query("J6_feature_join", f"select seq, round(sum(v), 6) as total from (select seq, p, ((7 * (p - 1) + 5 * (instr('ACGT', substr(seq, p, 1)) - 1)) % 11) / 1e1 - 5e-1 as v from (select seq, unnest(range(1, 7)) as p from {counted_sql(6)})) group by seq")
def j6(spark, sf):
    mode = toy_mode(6)
    beta = spark.createDataFrame([(p + 1, BASES[b], float(mode.nuc[p, b])) for p in range(6) for b in range(4)], "pos int, base string, beta double")
    at = counted(spark, sf, 6).select("seq", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("pos")).withColumn("base", F.substring("seq", F.col("pos"), F.lit(1)))
    return at.join(F.broadcast(beta), ["pos", "base"]).groupBy("seq").agg(F.round(F.sum("beta"), 6).alias("total"))


@query("flagship_top_probes", f"select seq, cnt, round(sum(kappa), 6) as w from (select * from {kappa_sql(counted_sql(L), K)} where not ({' or '.join(f'''(length(seq) - length(replace(seq, '{b}', '')) >= 9 and instr(seq, '{b * 5}') > 0)''' for b in BASES)})) group by seq, cnt order by w desc, seq limit 20")
def flagship(spark, sf):
    kept = probes.filter_probes(counted(spark, sf, L), 9, 5)
    w = scoring.with_coded_weight(kept, toy_model(K), LEFT, RIGHT, L).withColumn("w", F.round("w", 6))
    return w.orderBy(F.desc("w"), "seq").limit(20).select("seq", "cnt", "w")


def _selected(spark, sf):
    """Probes that a planted motif favours: a read stays with a chance that rises with its affinity."""
    from bindscape.functions import dna

    c = scoring.with_coded_weight(counted(spark, sf, 6), Model([toy_mode(3)]), LEFT, RIGHT, 6)
    return c.withColumn("cnt", (F.col("cnt") * F.col("w") * (0.5 + dna.uniform("seq"))).cast("long")).where("cnt > 0").select("seq", "cnt")
