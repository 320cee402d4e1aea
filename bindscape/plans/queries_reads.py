"""Models, files and symmetries made of what the tables hold: weights are log shares of bases at each place of the reads."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bindscape.operators import convnet, fitting, optimize, partition, scoring
from bindscape.operators.background import Background, count_vector, kmer_counts
from bindscape.operators.params import BASES, Mode, Model, SiteSymmetry, Symmetry, compress, even_odd, normal_form, normalize_modes
from bindscape.sources import models, reads

from .catalog import LEFT, RIGHT, all_sql, background_weight_sql, counted, counted_sql, kappa_sql, query, reads_sql, shape_table, shape_values, table, toy_background, toy_mode, toy_model
from .catalog import reads as derived_reads
from .queries_files import _lines
from .queries_more import _folder
from .queries_sweeps import _EXACT, _ONE, _data

_STATUS = {None: "", "F": "where l_linestatus = 'F'", "O": "where l_linestatus = 'O'"}


def read_mode(spark, sf, k: int, status: str | None = None) -> Mode:
    """Log shares of the bases at each place of the reads: 4 k numbers, from one job."""
    r = derived_reads(spark, sf, k)
    r = r.where(F.col("l_linestatus") == status) if status else r
    at = r.select(F.posexplode(F.split("seq", "")).alias("p", "b")).where("b != ''").groupBy("p", "b").count().collect()
    n = np.zeros((k, 4))
    for x in at:
        n[x["p"], BASES.index(x["b"])] = x["count"]
    return Mode(np.log(n / n.sum(axis=1, keepdims=True)))


def pwm_sql(k: int, status: str | None = None) -> str:
    """(p, b, w) of read_mode, all from 0."""
    at = f"(select p, instr('ACGT', substr(seq, p + 1, 1)) - 1 as b, count(*)::double as n from (select seq, unnest(range(0, {k})) as p from {reads_sql(k, '', _STATUS[status])}) group by all)"
    return f"(select p, b, ln(n / sum(n) over (partition by p)) as w from {at})"


def _i(v) -> list[tuple[int, float]]:
    return [(i, round(float(x), 9) + 0.0) for i, x in enumerate(v)]


# Expected reads of each probe under a model: its share of the partition function.


def _expected(name, di=False, features=0, flank=0, ns=None, k=3, r0=2, length=5, modes=1):
    def weights(source, keep):
        kappas = " union all ".join(f"select * from {kappa_sql(source, k, di, flank, features, m, keep=keep)}" for m in range(modes))
        return f"(select {keep}, sum(kappa){'' if ns is None else f' + exp({ns}e0)'} as w from ({kappas}) group by {keep})"

    pi = f"exp({background_weight_sql('seq', r0, length)})"
    z = f"(select sum(pi * w) from {weights(f'(select seq, {pi} as pi from {all_sql(length)})', 'seq, pi')})"
    sql = f"select seq, cnt, round({pi} * w / {z} * (select sum(cnt) from {counted_sql(length)}), 6) as expected from {weights(counted_sql(length), 'seq, cnt')}"

    @query(name, sql)
    def run(spark, sf):
        background, model = toy_background(r0, length), toy_model(k, di, features, ns, flank, modes)
        c = counted(spark, sf, length)
        w = scoring.probe_weights(c, model, LEFT, RIGHT, shape=shape_table(spark, features) if features else None, length=length)
        z = partition.model_z(background, model, shape_values(features) if features else None)
        n = c.agg(F.sum("cnt")).first()[0] or 0
        share = F.exp(background.log_probability("seq")) * F.col("w") / F.lit(float(z))
        return c.join(w, "seq").select("seq", "cnt", F.round(share * n, 6).alias("expected"))


_expected("Z1_nuc_flank", flank=2)
_expected("Z2_nuc")
_expected("Z3_di_flank", di=True, flank=2, r0=3)
_expected("Z4_di", di=True)
_expected("Z5_shape_flank", features=2, flank=2, length=4)
_expected("Z6_shape", features=2, length=4)
_expected("Z7_di_shape_flank", di=True, features=2, flank=1, length=4)
_expected("Z8_di_shape", di=True, features=2, length=4)
_expected("Z9_modes", ns=-2, modes=2, flank=1)


for _k in (1, 2, 3):

    @query(f"Z0_background_k{_k}", f"select seq, cnt, round(exp({background_weight_sql('seq', _k, 6)}) / (select sum(exp({background_weight_sql('seq', _k, 6)})) from {all_sql(6)}) * (select sum(cnt) from {counted_sql(6)}), 6) as expected from {counted_sql(6)}")
    def z0(spark, sf, k=_k):
        """Expected reads under the background alone."""
        c, b = counted(spark, sf, 6), toy_background(k, 6)
        n = c.agg(F.sum("cnt")).first()[0] or 0
        return c.select("seq", "cnt", F.round(F.exp(b.log_probability("seq")) * n, 6).alias("expected"))


@query("J5_pi_sum", f"select round((select sum(exp({background_weight_sql('seq', 3, 6)})) from {counted_sql(6)}) / (select sum(exp({background_weight_sql('seq', 3, 6)})) from {all_sql(6)}), 9) as seen, (select count(*) from {counted_sql(6)}) as probes")
def j5(spark, sf):
    """The share of the background that the probes seen make up."""
    return counted(spark, sf, 6).agg(F.round(F.sum(F.exp(toy_background(3, 6).log_probability("seq"))), 9).alias("seen"), F.count(F.lit(1)).alias("probes"))


# Models of the reads: best sequences, information, logos, gauges, symmetries.

_BASE = "substr('ACGT', (b + 1)::bigint, 1)"


def _tops(k: int, status: str | None = None) -> str:
    return f"(select p, max(w) as top, arg_max({_BASE}, w) as base from {pwm_sql(k, status)} group by p)"


@query("M3_best_sequence", f"select string_agg(base, '' order by p) as seq, round(exp(sum(top)), 9) as affinity from {_tops(6)}")
def m3(spark, sf):
    seq, a = scoring.best_sequence(read_mode(spark, sf, 6))
    return spark.createDataFrame([(seq, round(a, 9))], "seq string, affinity double")


_PAIR_TOPS = f"(select 0 as mode, sum(top) as t from {_tops(5, 'F')} union all select 1, sum(top) from {_tops(5, 'O')})"


@query("M4_model_info", f"with b as {_PAIR_TOPS} select mode::bigint as mode, 5::bigint as k, round(t - (select max(t) from b), 6) as ln_affinity from b union all select -1, 0, round(-9 - (select max(t) from b), 6)")
def m4(spark, sf):
    got = scoring.model_info(Model([read_mode(spark, sf, 5, s) for s in "FO"], -9.0))
    return spark.createDataFrame([(m, k, round(a + 0.0, 6)) for m, k, a, _ in got], "mode long, k long, ln_affinity double")


@query("M5_logo", f"select p + 1 as pos, {_BASE} as base, round(w - avg(w) over (partition by p), 6) as energy from {pwm_sql(5)}")
def m5(spark, sf):
    m = scoring.logo(read_mode(spark, sf, 5))
    return spark.createDataFrame([(p + 1, BASES[b], round(float(m[b, p]), 6) + 0.0) for p in range(5) for b in range(4)], "pos long, base string, energy double")


@query("O12_normal_form", f"select (4 * p + b)::bigint as i, round(w - avg(w) over (partition by p), 9) as beta from {pwm_sql(4)}")
def o12(spark, sf):
    """Without non-specific binding every position's mean is free."""
    return spark.createDataFrame(_i(normal_form(read_mode(spark, sf, 4)).vector()), "i long, beta double")


@query("O13_normalized_modes", f"with w as (select 0 as mode, * from {pwm_sql(4, 'F')} union all select 1, * from {pwm_sql(4, 'O')}), m as (select mode, p, max(w) as top from w group by mode, p), t as (select mode, sum(top) as t from m group by mode) select (16 * mode + 4 * p + b)::bigint as i, round(w - top + (t - (select max(t) from t)) / 4, 9) as beta from w join m using (mode, p) join t using (mode) union all select 32, round(-1 - (select max(t) from t), 9)")
def o13(spark, sf):
    return spark.createDataFrame(_i(normalize_modes(Model([read_mode(spark, sf, 4, s) for s in "FO"], -1.0)).vector()), "i long, beta double")


@query("O16_symmetry", f"select (4 * a.p + a.b)::bigint as i, round((a.w + c.w) / 2, 9) as beta from {pwm_sql(5)} a join {pwm_sql(5)} c on c.p = 4 - a.p and c.b = 3 - a.b")
def o16(spark, sf):
    """Weights of the reads made palindromic: each is the mean of those tied to it."""
    mode = read_mode(spark, sf, 5)
    tie = Symmetry(even_odd(5)).tie(mode)
    return spark.createDataFrame(_i(tie @ compress(mode.vector(), tie)), "i long, beta double")


@query("O17_site_symmetry", f"select (4 * a.p + a.b)::bigint as i, case when a.p in (2, 3) then 0 else round((a.w + c.w) / 2, 9) end as beta from {pwm_sql(6)} a join {pwm_sql(6)} c on c.p = 5 - a.p and c.b = 3 - a.b")
def o17(spark, sf):
    """AB|..|ba: two half sites, the second the reverse complement of the first, two positions without weights between."""
    tie = SiteSymmetry("AB|..|ba", 6).tie()
    return spark.createDataFrame(_i(tie @ compress(read_mode(spark, sf, 6).vector(), tie)), "i long, beta double")


def _pairs(d: int) -> str:
    at = lambda i: f"instr('ACGT', substr(seq, {i}, 1)) - 1"
    return f"(select p, {at('p + 1')} as a, {at(f'p + {d} + 1')} as b, count(*) as n from (select seq, unnest(range(0, {5 - d})) as p from {reads_sql(5)}) group by all)"


_TWIN = lambda q: f"coalesce((select n from y where y.p = {q} and y.a = 3 - x.b and y.b = 3 - x.a), 0)"


@query("O17_blocks", f"with x1 as {_pairs(1)}, x2 as {_pairs(2)} select 1::bigint as distance, x.p::bigint as p, x.a::bigint as a, x.b::bigint as b, (x.n + case x.p when 0 then 0 when 1 then null when 2 then {_TWIN('3').replace('from y', 'from x1 y')} else {_TWIN('2').replace('from y', 'from x1 y')} end)::bigint as reads from x1 x where x.p <> 1 union all select 2, x.p, x.a, x.b, x.n + case when x.a = 3 - x.b then 0 else {_TWIN('2').replace('from y', 'from x2 y')} end from x2 x where x.p = 2")
def o17b(spark, sf):
    """2:2:0|1:3:1: two free positions, then three that are their own reverse complement. Reads of pairs one and two apart, added up over what is tied."""
    site, rows = SiteSymmetry("2:2:0|1:3:1", 5), []
    r = derived_reads(spark, sf, 5)
    for d in (1, 2):
        pair = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.concat(F.substring("seq", p + 1, 1), F.substring("seq", p + d + 1, 1)).alias("m")) for p in range(5 - d)])).alias("x")
        n = np.zeros(16 * (5 - d))
        for x in r.select(pair).groupBy("x.p", "x.m").count().collect():  # at most 16 a place
            n[16 * x["p"] + 4 * BASES.index(x["m"][0]) + BASES.index(x["m"][1])] = x["count"]
        tie = site.tie(d)
        tied = tie @ (tie.T @ n)
        rows += [(d, i // 16, i % 16 // 4, i % 4, int(tied[i])) for i in range(len(n)) if tie[i].any() and n[i]]
    return spark.createDataFrame(rows, "distance long, p long, a long, b long, reads long")


@query("O18_palindrome", "select k::bigint as k, parts, concat_ws(',', string_agg(i::varchar, ',' order by i) filter (where i <= k // 2), case when k % 2 = 1 then '*' end, string_agg(concat('-', i), ',' order by i desc) filter (where i <= k // 2)) as symmetry from (select k, parts, unnest(range(1, k // 2 + 1)) as i from (select p_size % 10 + 2 as k, count(*) as parts from part group by 1)) group by k, parts")
def o18(spark, sf):
    """The palindrome of each length that parts ask for."""
    n = table(spark, sf, "part").groupBy((F.col("p_size") % 10 + 2).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("parts"))
    known = spark.createDataFrame([(k, even_odd(k)) for k in range(2, 12)], "k long, symmetry string")
    return n.join(F.broadcast(known), "k")


@query("F9_feasible", "select p_partkey, (k <= l + 2 * f and l + 2 * f + 4 * s <= 32) as ok from (select p_partkey, 4 + 2 * (p_size % 14) as l, p_partkey % 9 as f, 2 + 3 * (p_partkey % 7) as k, p_size % 2 as s from part)")
def f9(spark, sf):
    p = table(spark, sf, "part")
    ok = fitting.feasible_rows(4 + 2 * (F.col("p_size") % 14), F.col("p_partkey") % 9, 2 + 3 * (F.col("p_partkey") % 7), F.col("p_size") % 2 == 1)
    return p.select("p_partkey", ok.alias("ok"))


@query("H1_grid", "select k::bigint as k, f::bigint as flank, n = 1 as ns from (select distinct 4 + p_size % 17 as k from part) cross join (select distinct n_regionkey * 3 as f from nation) cross join (select unnest(range(0, 2)) as n) where k <= 16 + 2 * f and 16 + 2 * f <= 32")
def h1(spark, sf):
    """The points of a sweep over the lengths and flanks that two tables name."""
    ks, flanks = ([r[0] for r in df.distinct().collect()] for df in (table(spark, sf, "part").select((4 + F.col("p_size") % 17).cast("int")), table(spark, sf, "nation").select((3 * F.col("n_regionkey")).cast("int"))))
    return spark.createDataFrame(fitting.grid(16, sorted(ks), sorted(flanks), [False, True]), "k long, flank long, ns boolean")


# Optimisers.


@query("O5_orthogonal_step", f"select (4 * p + b)::bigint as i, round(w - avg(w) over (partition by p), 9) as step from {pwm_sql(2)} union all select 8, -1e0")
def o5(spark, sf):
    """Weights of the reads seen along directions that keep each position's sum."""
    v = Model([read_mode(spark, sf, 2)], -1.0).vector()
    return spark.createDataFrame(_i(optimize.orthogonal_directions([4, 4], ns=True) @ v), "i long, step double")


@query("O6_retries", f"select 4::bigint as tries, round(value, 3) as value from {_ONE}")
def o6(spark, sf):
    """The first three starts fail; the fourth, a thousand times nearer to 0, finds the optimum of the reads."""
    data, seen = _data(spark, sf), []

    def run(x):
        seen.append(np.abs(x).max())
        if len(seen) < 4:
            raise ArithmeticError("no")
        assert seen[-1] <= 0.05 * 1e-3
        return fitting.fit(data, Model([Mode.zeros(1)]).with_vector(x), _EXACT)

    got = optimize.with_retries(run, 4)
    data.release()
    return spark.createDataFrame([(len(seen), round(got.value, 3))], "tries long, value double")


_ABC = "(select avg(l_quantity)::double as a, avg(l_extendedprice)::double / 1e3 as b, avg(l_tax)::double * 1e2 as c from lineitem)"


@query("O7_saddle", f"select round(sqrt(b / (2 * c)), 4) as y, round(-b * b / (4 * c), 4) as value from {_ABC}")
def o7(spark, sf):
    """a x^2 - b y^2 + c y^4 from its saddle at 0, a, b and c being means of line items: the escape and the descent behind it end at a minimum."""
    a, b, c = map(float, table(spark, sf, "lineitem").agg(F.avg("l_quantity"), F.avg("l_extendedprice") / 1e3, F.avg("l_tax") * 1e2).first())
    f = lambda v: (a * v[0] ** 2 - b * v[1] ** 2 + c * v[1] ** 4, np.array([2 * a * v[0], -2 * b * v[1] + 4 * c * v[1] ** 3]))
    at = optimize.lbfgs(f, np.zeros(2)).x
    away = optimize.escape(f, at, np.diag([2 * a, -2 * b + 12 * c * at[1] ** 2]))
    got = optimize.lbfgs(f, away, tolerance=1e-10)
    return spark.createDataFrame([(round(abs(float(got.x[1])), 4), round(float(got.value), 4))], "y double, value double")


# Files of models made of reads.


def _read_fits(spark, sf):
    one = Mode(read_mode(spark, sf, 3).nuc, toy_mode(3, True).di)
    two = [read_mode(spark, sf, 2, s) for s in "FO"]
    return [fitting.Fit(Model([one], -1.0), 10.0, 1.0, 0.5, 3, 4, errors=np.arange(45) / 10, null_vectors=2), fitting.Fit(Model(two), 9.0, 0.9, 0.4, 2, 3, seed=np.zeros(16))]


def _value_rows(train, k, mode, tag, count, value):
    return f"select {train} as train, '{k}' as k, {mode}::bigint as mode, '{tag}' as tag, i::bigint as i, round({value}, 9) as value from (select unnest(range(0, {count})) as i)"


def _read_rows(train, k, mode, pwm):
    return f"select {train}, '{k}', {mode}, 'NB', (4 * p + b)::bigint, round(w, 9) from {pwm}"


_DI = "((3 * (i // 16) + 2 * (i % 16)) % 7) / 2e1 - 15e-2"
_READ_FITS = " union all ".join([_value_rows("1e1", "3", 0, "DB", 32, _DI), _value_rows("1e1", "3", 0, "NSB", 1, "-1e0"), _value_rows("1e1", "3", 0, "NE", 12, "i / 1e1"), _value_rows("1e1", "3", 0, "DE", 32, "(i + 12) / 1e1"), _value_rows("1e1", "3", 0, "NSBE", 1, "44 / 1e1"), *(_value_rows("9e0", "Multi", m, "NS", 8, "0e0") for m in (0, 1)), _read_rows("1e1", "3", 0, pwm_sql(3)), *(_read_rows("9e0", "Multi", m, pwm_sql(2, s)) for m, s in enumerate("FO"))])


@query("S5_K1_model_file", _READ_FITS)
def s5(spark, sf):
    """A fit of one mode with errors and one of two with seeds, written as the exchange file and read back, a row a number."""
    path = _folder(spark, "fits")
    models.write_fits(spark, _read_fits(spark, sf), path)
    rows = models.load_fits(spark, path).select(F.col("TrainL").alias("train"), "k", F.posexplode("values").alias("mode", "v"))
    tags = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col(f"v.{t}").alias("x")) for t in models.TAGS]))
    return rows.select("train", "k", F.col("mode").cast("long").alias("mode"), tags.alias("t")).select("train", "k", "mode", "t.tag", F.posexplode("t.x").alias("i", "value")).select("train", "k", "mode", "tag", F.col("i").cast("long").alias("i"), F.round("value", 9).alias("value"))


_PSAM = f"(select string_agg(base, '' order by p) from {_tops(3)})"


@query("S5_K1_model_columns", f"select '3' as k, 0e0 as flank, true as ns, true as di, false as mg, -1e0 as ns_bind, 3e0 as steps, 4e0 as calls, 2e0 as null_vectors, {_PSAM} as psam, '1.-1' as symmetry, 1e-6 as lambda union all select 'Multi', 0, false, false, false, 0, 2, 3, null, null, '1.-1', 1e-6")
def s5c(spark, sf):
    path = _folder(spark, "fits")
    models.write_fits(spark, _read_fits(spark, sf), path, {"NuSym": "1,-1", "Lambda": 1e-6})
    t = models.load_fits(spark, path)
    return t.select("k", F.col("Flank").alias("flank"), F.col("NS").alias("ns"), F.col("Di").alias("di"), F.col("MG").alias("mg"), F.col("NSBind").alias("ns_bind"), F.col("FitSteps").alias("steps"), F.col("FncCalls").alias("calls"), F.col("NullVectors").alias("null_vectors"), F.col("PSAM").alias("psam"), F.col("NuSym").alias("symmetry"), F.col("Lambda").alias("lambda"))


@query("K2_fit_list", f"select 0::bigint as i, '3' as k, 2::bigint as marks, {_PSAM} as psam union all select 1, '-', 0, '-'")
def k2(spark, sf):
    """The rows of the list for reading: number, length, how many features, consensus."""
    head, *rows = ([c.strip() for c in x.split(" | ")] for x in models.fit_list(_read_fits(spark, sf)))
    at = {c: i for i, c in enumerate(head)}
    return spark.createDataFrame([(int(r[at["no"]]), r[at["k"]], sum(x != "-" for x in r[at["features"]].split("+")), r[at["psam"]]) for r in rows], "i long, k string, marks long, psam string")


@query("K2_report", " union all ".join(f"select {10 * m} + p + 1 as place, round(w, 4) as weight_of_a from {pwm} where b = 0" for m, pwm in enumerate((pwm_sql(3), pwm_sql(2, "F"), pwm_sql(2, "O")))))
def k2r(spark, sf):
    """One line of weights for each position of each mode in the report; of each, what A weighs."""
    out, mode = [], -1
    for line in models.report(_read_fits(spark, sf), run={"folds": 2}).splitlines():
        head, _, rest = line.strip().partition(": ")
        if line.startswith("   ") and head.isdigit():
            mode += head == "1"
            out.append((mode * 10 + int(head), float(rest.split(",")[0].split()[1])))
    return spark.createDataFrame(out, "place long, weight_of_a double")


def _shares_sql(k: int) -> str:
    return f"(select {' + '.join(f'{4 ** (k - 1 - j)} * (instr({chr(39)}ACGT{chr(39)}, substr(m, {j + 1}, 1)) - 1)' for j in range(k))} as i, ln(n / sum(n) over ()) as beta from (select m, count(*)::double as n from (select substr(seq, i, {k}) as m from (select seq, unnest(range(1, {8 - k})) as i from {reads_sql(6)})) group by m))"


@query("S3_K3_background_file", " union all ".join(f"select {k}::double as k, false as flank, {k}::double as train, i::bigint as i, round(beta, 9) as beta, {'i::double' if k == 2 else 'null::double'} as seed from {_shares_sql(k)}" for k in (1, 2)))
def s3(spark, sf):
    """Log shares of k-mers in the reads, written and read as backgrounds."""
    path, rows = _folder(spark, "backgrounds"), []
    for k in (1, 2):
        n = count_vector(kmer_counts(counted(spark, sf, 6), k, flanked=False), k)
        rows.append((Background(np.log(n / n.sum()), k, 6, flanked=False), {"TrainL": float(k), "seed": range(16) if k == 2 else None}))
    models.write_backgrounds(spark, rows, path)
    t = models.load_backgrounds(spark, path).select("k", F.col("isFlank").alias("flank"), F.col("TrainL").alias("train"), F.posexplode("beta").alias("i", "beta"), F.col("seed").alias("s"))
    return t.select("k", "flank", "train", F.col("i").cast("long").alias("i"), F.round("beta", 9).alias("beta"), F.element_at("s", F.col("i") + 1).alias("seed"))


@query("S6_net_file", "select (n_nationkey % 2)::bigint as detector, (n_nationkey // 8)::bigint as place, (n_nationkey % 8 // 2)::bigint as base, (n_nationkey * 5 + n_regionkey) / 4e0 as weight from nation where n_nationkey < 16")
def s6(spark, sf):
    """The detectors of a parameter file, stored with the detector fastest, then the base, then the place; weights are keys of nations."""
    n = table(spark, sf, "nation").where("n_nationkey < 16")
    weights = n.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_regionkey"))), lambda x: ((x["n_nationkey"] * 5 + x["n_regionkey"]) / 4.0).cast("string")), ",").alias("w"))
    head = "# bindscape 0.1\nreverse_complement = 1\nnum_detectors = 2\ndetector_len = 2\nhas_avg_pooling = 0\nnum_hidden = 0\ndetectors = "
    path = _lines(weights.select(F.concat(F.lit(head), "w", F.lit("\nthresholds = 0.5,-0.5\nweights1 = 1,2\nbiases1 = 0.25\nweights2 =\nbiases2 ="))), spark, "net")
    net = convnet.parse(spark.read.text(path, wholetext=True).first()[0])
    return spark.createDataFrame([(int(d), int(j), int(b), float(w)) for (d, j, b), w in np.ndenumerate(net.detectors)], "detector long, place long, base long, weight double")


_OF_FIVE = f"(select seq as pentamer, round(avg(l_quantity)::double, 4) as v0, round(avg(l_tax)::double, 6) as v1 from {reads_sql(5).replace('(select ', '(select l_quantity, l_tax, ', 1)} group by seq)"


def _five_file(spark, sf, features: int) -> str:
    """A shape file: of reads that begin with a 5-mer, the mean quantity (and tax), at every second field, with quotes and a heading."""
    v = derived_reads(spark, sf, 5).groupBy("seq").agg(F.round(F.avg("l_quantity"), 4).alias("v0"), F.round(F.avg("l_tax"), 6).alias("v1"))
    line = F.concat(F.lit('"'), "seq", F.lit('"'), *[x for k in range(features) for x in (F.lit(","), F.col(f"v{k}").cast("string"), F.lit(",0.5"))])
    return _lines(spark.createDataFrame([("kmer" + ",value,sd" * features,)], "value string").union(v.select(line)), spark, "shape")


_FIVE_ROWS = f"select pentamer, 'HelT' as feature, v0 as value from {_OF_FIVE} union all select pentamer, 'HelT_2', v1 from {_OF_FIVE}"


@query("S7_shape_file", _FIVE_ROWS)
def s7(spark, sf):
    return reads.read_shape(spark, _five_file(spark, sf, 2), "HelT").select("pentamer", "feature", "value")


@query("S13_shape_classes", f"select pentamer, 0 as feature_no, 'MGW' as feature, v0 as value from {_OF_FIVE} union all select pentamer, case feature when 'HelT' then 1 else 2 end, feature, value from ({_FIVE_ROWS})")
def s13(spark, sf):
    """Asked for in one order, joined in the fixed one."""
    tables = {n: reads.read_shape(spark, _five_file(spark, sf, w), n) for n, w in (("HelT", 2), ("MGW", 1))}
    return reads.choose_shapes(tables, ["HelT", "MGW"]).select("pentamer", "feature_no", "feature", "value")


@query("S8_config", "select lower(replace(n_name, ' ', '_')) as key, case when n_regionkey = 0 then null else n_regionkey::varchar end as value from nation")
def s8(spark, sf):
    """Keys of all nations, with comments, quotes, an earlier value that a later one replaces, and NA where a key may lack a value."""
    n = table(spark, sf, "nation").select(F.replace("n_name", F.lit(" "), F.lit("_")).alias("key"), "n_regionkey")
    line = F.concat("key", F.lit(" = none\n# "), "key", F.lit(" = no\n"), "key", F.lit("= '"), F.when(F.col("n_regionkey") == 0, "N/A").otherwise(F.col("n_regionkey").cast("string")), F.lit("' ; region"))
    text = "\n".join(r["value"] for r in spark.read.text(_lines(n.select(line), spark, "config")).collect())
    got = reads.parse_config(text, {r["key"] for r in n.collect()})  # a config is a file of some lines
    return spark.createDataFrame(sorted(got.items()), "key string, value string")


@query("S9_template", "select concat('l=', n_nationkey, ' left=', upper(substr(n_name, 1, 2))) as line from nation")
def s9(spark, sf):
    """Longer keys first, so that LEFT does not lose its beginning to L; one expression for all rows."""
    line = reads.filled_template("l=LEN left=LENGTH_LEFT", {"LEN": F.col("n_nationkey"), "LENGTH_LEFT": F.upper(F.substring("n_name", 1, 2))})
    return table(spark, sf, "nation").select(line.alias("line"))
