"""Optimisers, fits, symmetries and networks on problems whose solution SQL can give."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bindscape.functions import arrays
from bindscape.operators import background, convnet, fitting, objective, optimize
from bindscape.operators.params import Mode, Model
from bindscape.sources import models

from .catalog import LEFT, RIGHT, counted, counted_sql, query, rc_sql, table, toy_background, toy_mode, toy_model
from .queries_model import _selected
from .queries_more import _QUICK, _data

_BASES = f"(select b as base, sum(cnt * (length(seq) - length(replace(seq, b, ''))))::double as n from {counted_sql(6)} cross join (values ('A'), ('C'), ('G'), ('T')) v(b) group by b)"
#: Shares of the bases: what a background of single bases has at its maximum likelihood.
_SHARES = f"select base, round(n / sum(n) over (), 5) as share from {_BASES}"


def _single_bases(spark, sf):
    """(likelihood with gradient of a background of single bases, reads); one Spark job, four numbers."""
    c = counted(spark, sf, 6)
    x, n = background.count_vector(background.kmer_counts(c, 1, LEFT, RIGHT), 1), float(c.agg(F.sum("cnt")).first()[0])
    return lambda v: background.likelihood(background.Background(v, 1, 6, LEFT, RIGHT), x, n), n


def _shares(spark, beta):
    p = np.exp(beta - beta.max())
    return spark.createDataFrame([(b, round(float(s), 5)) for b, s in zip("ACGT", p / p.sum())], "base string, share double")


@query("O2_more_thuente", _SHARES)
def o2(spark, sf):
    f, n = _single_bases(spark, sf)
    return _shares(spark, optimize.lbfgs(f, np.zeros(4), n, tolerance=1e-8, search="more_thuente").x)


@query("O3_wolfe", _SHARES)
def o3(spark, sf):
    f, n = _single_bases(spark, sf)
    return _shares(spark, optimize.lbfgs(f, np.zeros(4), n, tolerance=1e-8, search="wolfe").x)


@query("O4_pattern_search", _SHARES.replace(", 5)", ", 3)"))
def o4(spark, sf):
    f, _ = _single_bases(spark, sf)
    got = optimize.pattern_search(lambda v: f(v)[0], np.zeros(4), directions=optimize.orthogonal_directions([4]), least=1e-7)
    return _shares(spark, got.x).select("base", F.round("share", 3).alias("share"))


@query("O10_differences", f"select base, round((select sum(n) from {_BASES}) / 4 - n, 1) as slope from {_BASES}")
def o10(spark, sf):
    f, _ = _single_bases(spark, sf)
    g = optimize.numeric_gradient(lambda v: f(v)[0], np.zeros(4), 1e-4)
    return spark.createDataFrame([(b, round(float(x), 1) + 0.0) for b, x in zip("ACGT", g)], "base string, slope double")


@query("K5_hessian", f"select 0::bigint as fit, i::bigint as i, j::bigint as j, round((select sum(n) from {_BASES}) * ((i = j)::int / 4e0 - 1 / 16e0), 1) as value from (select unnest(range(0, 4)) as i) cross join (select unnest(range(0, 4)) as j)")
def k5h(spark, sf):
    f, _ = _single_bases(spark, sf)
    t = models.hessian_table(spark, [optimize.numeric_hessian(lambda v: f(v)[1], np.zeros(4))])
    return t.select(F.col("fit").cast("long").alias("fit"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("value", 1).alias("value"))


@query("K5_trajectory", _SHARES.replace("select base", "select true as falls, base"))
def k5(spark, sf):
    """The way of a fit: values fall from step to step, and its last step holds the shares."""
    f, n = _single_bases(spark, sf)
    got = optimize.lbfgs(f, np.zeros(4), n, tolerance=1e-8, keep=True)
    t = models.trajectory_table(spark, [fitting.Fit(Model([Mode(got.x.reshape(1, 4))]), got.value, 0.0, 0.0, got.rounds, got.evaluations, trajectory=got.trajectory)])
    steps = {}
    for r in t.orderBy("step", "i").collect():  # four numbers a step
        steps.setdefault(r["step"], []).append(r["beta"])
    values = [f(np.array(x))[0] for x in steps.values()]
    return _shares(spark, np.array(list(steps.values())[-1])).select(F.lit(all(a >= b - 1e-6 for a, b in zip(values, values[1:]))).alias("falls"), "base", "share")


@query("O11_error_bars", f"select base, round(sqrt(3 / (select sum(n) from {_BASES})), 8) as error, 1::bigint as null_directions from {_BASES}")
def o11(spark, sf):
    """Pseudo-inverse of n L (1/4 - 1/16): one direction is free, the others have the multinomial errors."""
    f, _ = _single_bases(spark, sf)
    errors, null = optimize.error_bars(optimize.numeric_hessian(lambda v: f(v)[1], np.zeros(4)), tolerance=1e-5)
    return spark.createDataFrame([(b, round(float(e), 8), null) for b, e in zip("ACGT", errors)], "base string, error double, null_directions long")


@query("A7_background_fit", f"select kmer, n::double as n from (select kmer, sum(cnt) as n from (select cnt, substr(t, i, 2) as kmer from (select cnt, t, unnest(range(1, length(t))) as i from (select cnt, concat('{LEFT[-1:]}', seq, '{RIGHT[:1]}') as t from {counted_sql(6)}))) group by kmer)")
def a7(spark, sf):
    """At the optimum the k-mer counts that the model expects are those observed."""
    c = counted(spark, sf, 6)
    model, _ = background.fit_background(c, 2, 6, LEFT, RIGHT, tolerance=1e-8)
    z, g = model.z_gradient()
    n = float(c.agg(F.sum("cnt")).first()[0])
    return spark.createDataFrame([(a + b, round(float(x)) + 0.0) for (a, b), x in zip(((a, b) for a in "ACGT" for b in "ACGT"), n * g / z)], "kmer string, n double")


@query("H7_background_selection", "select * from (values (1, true), (2, true), (3, true)) v(k, better)")
def h7(spark, sf):
    """More bases never fit the train reads worse."""
    from bindscape.operators import probes

    got = background.select_background(probes.split_reads(counted(spark, sf, 6), 0.5), [1, 2, 3], 6, LEFT, RIGHT)
    train = [np.inf, *(t for _, t, _, _ in got)]
    return spark.createDataFrame([(k, bool(t <= before + 1e-6 * abs(t))) for (k, t, _, _), before in zip(got, train)], "k int, better boolean")


def _flat(data, model, settings):
    """Is the gradient of a fit zero within its tolerance?"""
    value, g = data.value_gradient(model)
    return bool(np.linalg.norm(g) / data.n <= 3 * settings.tolerance * max(1.0, np.linalg.norm(model.vector())))


@query("O1_fit", "select p::bigint as pos, b as base, true as flat, true as has_error from (select unnest(range(0, 3)) as p) cross join (values ('A'), ('C'), ('G'), ('T')) v(b)")
def o1(spark, sf):
    """A single-mode fit to reads that a planted motif favours: its gradient is zero and its errors are there."""
    data, s = objective.Likelihood(_selected(spark, sf), toy_background(1, 6), 1e-4), fitting.Settings(errors=True, tolerance=1e-5)
    got = fitting.fit(data, toy_model(3), s)
    flat = _flat(data, got.model, s)
    data.release()
    return spark.createDataFrame([(p, "ACGT"[b], flat, bool(got.errors[4 * p + b] > 0)) for p in range(3) for b in range(4)], "pos long, base string, flat boolean, has_error boolean")


@query("O8_shifts", "select * from (values (0, true, true), (1, true, true), (-1, true, true)) v(shift, flat, above_best)")
def o8(spark, sf):
    """The motif and its neighbours, each at a point of zero gradient."""
    data = _data(spark, sf)
    fits = fitting.shift_fits(data, fitting.fit(data, Model([Mode.zeros(3)]), _QUICK, seeded=False), 1, _QUICK)
    best, rows = fitting.best(fits), []
    for f in fits:
        rows.append((f.shift, _flat(data, f.model, _QUICK), bool(f.value >= best.value)))
    data.release()
    return spark.createDataFrame(rows, "shift int, flat boolean, above_best boolean")


@query("O9_cross_validation", "select true as finite, true as near")
def o9(spark, sf):
    """Likelihoods a read of held-out halves lie near that of the whole."""
    from bindscape.operators import probes

    split = probes.split_reads(_selected(spark, sf), 0.5).withColumn("cnt", F.col("train") + F.col("test"))
    data = objective.Likelihood(split, toy_background(1, 6), 1e-4, more=("train", "test"))
    start = fitting.fit(data, toy_model(3), _QUICK)
    got = float(np.mean(fitting.cross_validate(data, [(1, 2), (2, 1)], start, _QUICK)))
    data.release()
    return spark.createDataFrame([(bool(np.isfinite(got)), bool(abs(got - start.per_read) < 0.05 * abs(start.per_read)))], "finite boolean, near boolean")


@query("O14_mode_regression", "select true as uniform, true as lower, true as flat")
def o14(spark, sf):
    """Modes move as a whole: one amount for all of a mode's weights, spread over its positions."""
    data, start = _data(spark, sf), toy_model(2, ns=-1.0, modes=2)
    got = fitting.mode_regression(data, start, fitting.Settings(tolerance=1e-6))
    moved = [b.nuc - a.nuc for a, b in zip(start.modes, got.model.modes)]
    free = fitting.replace_penalty(data, 0.0)
    g = free.value_gradient(got.model)[1]
    along = np.array([g[: 8].reshape(2, 4).sum() / 2, g[8:16].reshape(2, 4).sum() / 2, g[16]])
    row = (all(float(np.ptp(m)) < 1e-9 for m in moved), bool(got.value <= free.value_gradient(start)[0]), bool(np.linalg.norm(along) / data.n < 1e-5))
    data.release()
    return spark.createDataFrame([row], "uniform boolean, lower boolean, flat boolean")


@query("O15_active_modes", "select * from (values (0, true), (1, false)) v(mode, frozen)")
def o15(spark, sf):
    data, start = _data(spark, sf), toy_model(2, modes=2)
    active = np.arange(16) >= 8
    got = fitting.fit(data, start, _QUICK, active=active)
    data.release()
    return spark.createDataFrame([(k, bool(np.array_equal(a.nuc, b.nuc))) for k, (a, b) in enumerate(zip(start.modes, got.model.modes))], "mode int, frozen boolean")


@query("O19_linear_algebra", "select round(regr_slope(o_totalprice, (o_custkey % 100)::double), 4) as slope, round(regr_intercept(o_totalprice, (o_custkey % 100)::double), 2) as intercept from orders")
def o19(spark, sf):
    """Normal equations: moments from Spark, solved on the driver."""
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 100).cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    m = o.agg(F.count(F.lit(1)), F.sum("x"), F.sum(F.col("x") * F.col("x")), F.sum("y"), F.sum(F.col("x") * F.col("y"))).first()
    a, b = np.linalg.solve(np.array([[m[0], m[1]], [m[1], m[2]]], float), np.array([m[3], m[4]], float))
    return spark.createDataFrame([(round(float(b), 4), round(float(a), 2))], "slope double, intercept double")


@query("H2_seeded_modes", "select * from (values ('modes', 2e0), ('top', 0e0), ('feasible', 0e0)) v(what, value)")
def h2(spark, sf):
    """Two seeded motifs with non-specific binding: the strongest mode is at 0, and seeds too long give no fit."""
    data = _data(spark, sf)
    got = fitting.seeded_fit(data, [toy_mode(3), toy_mode(2, number=1)], True, 0, _QUICK)
    top = max(float(m.nuc.max(axis=1).sum()) for m in got.model.modes)
    none = fitting.seeded_fit(data, [toy_mode(9)], settings=_QUICK)
    data.release()
    return spark.createDataFrame([("modes", float(len(got.model.modes))), ("top", round(top, 6) + 0.0), ("feasible", float(none is not None))], "what string, value double")


@query("H3_length_sweep", "select k::bigint as k, n = 1 as non_specific, true as flat from (select unnest(range(2, 4)) as k) cross join (select unnest(range(0, 2)) as n)")
def h3(spark, sf):
    """Lengths 2 and 3, with and without non-specific binding."""
    data, s = _data(spark, sf), fitting.Settings(tolerance=1e-4, penalty=1e-4)
    rows = [(f.model.modes[0].k, f.model.ns is not None, _flat(data, f.model, s)) for f in fitting.length_sweep(data, [2, 3, 9], [0], [False, True], settings=s)]
    data.release()
    return spark.createDataFrame(rows, "k long, non_specific boolean, flat boolean")


@query("H4_add_mode", "select * from (values (1, true), (2, true)) v(modes, lower)")
def h4(spark, sf):
    data, s = _data(spark, sf), fitting.Settings(tolerance=1e-4)
    one = fitting.fit(data, toy_model(2), s)
    two = fitting.add_mode(data, one, 2, s)
    first = data.value_gradient(toy_model(2))[0]
    data.release()
    return spark.createDataFrame([(1, bool(one.value <= first)), (2, bool(two.value <= one.value + 1e-4 * abs(one.value)))], "modes int, lower boolean")


@query("H5_growth", "select * from (values (2, 0, true), (4, 1, true)) v(k, flank, lower)")
def h5(spark, sf):
    """Two positions and one flank base more at a time; a longer motif fits no worse."""
    data = _data(spark, sf)
    fits = fitting.grow(data, fitting.fit(data, Model([Mode.zeros(2)]), _QUICK, seeded=False), 4, _QUICK)
    before = [np.inf, *(f.value for f in fits)]
    data.release()
    return spark.createDataFrame([(f.model.modes[0].k, f.model.flank, bool(f.value <= b + 1e-3 * abs(f.value))) for f, b in zip(fits, before)], "k int, flank int, lower boolean")


@query("H6_more_features", "select * from (values ('nucleotides', true), ('dinucleotides', true)) v(features, lower)")
def h6(spark, sf):
    data = _data(spark, sf)
    first = data.value_gradient(toy_model(3))[0]
    one = fitting.fit(data, toy_model(3), _QUICK)
    two = fitting.fit(data, Model([one.model.modes[0].with_features(True, 0)]), _QUICK)
    data.release()
    return spark.createDataFrame([("nucleotides", bool(one.value <= first)), ("dinucleotides", bool(two.value <= one.value + 1e-4 * abs(one.value)))], "features string, lower boolean")


@query("R8_data_swap", f"select sum(cnt)::double as n, true as refused from {counted_sql(6, 'other')}")
def r8(spark, sf):
    """Another table of probes under the same model; one with probes of another length is refused."""
    data = objective.Likelihood(counted(spark, sf, 6), toy_background(1, 6), cache=False)
    try:
        data.swapped(counted(spark, sf, 7))
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(data.swapped(counted(spark, sf, 6, "other")).n, refused)], "n double, refused boolean")


#: Two detectors of four places with weights in eighths, exact in single precision; one hidden layer of two.
_W = np.array([[[((5 * d + 3 * j + 2 * b) % 9 - 4) / 8 for b in range(4)] for j in range(4)] for d in range(2)], np.float32)


def _net(both):
    return convnet.Net(both, False, _W, np.array([0.25, -0.5], np.float32), np.array([1, 0.5, -0.25, 2], np.float32), np.array([0.125, -0.25], np.float32), np.array([1.0, -0.5], np.float32), np.array([0.5], np.float32))


def _net_sql(source: str, width: int) -> str:
    """(seq, score) of windows (seq, w): padded with N, whose weight is the mean of the four."""
    place = "substr(p, i + {j}, 1)"
    weight = lambda d, j: f"(case when {place.format(j=j)} = 'N' then {float(_W[d, j].mean())} else ((5 * {d} + 3 * {j} + 2 * (instr('ACGT', {place.format(j=j)}) - 1)) % 9 - 4) / 8e0 end)"
    maps = ", ".join(f"max(greatest({' + '.join(weight(d, j) for j in range(4))} + {t}, 0)) as m{d}" for d, t in ((0, "25e-2"), (1, "-5e-1")))
    inner = f"(select seq, w, {maps} from (select seq, w, p, unnest(range(1, {width} + 4)) as i from (select seq, w, concat('NNN', w, 'NNN') as p from {source})) group by seq, w)"
    return f"(select seq, greatest(m0 - 25e-2 * m1 + 125e-3, 0) - 5e-1 * greatest(5e-1 * m0 + 2 * m1 - 25e-2, 0) + 5e-1 as score from {inner})"


def _windows(seq: str) -> str:
    return f"(select seq, substr({seq}, k, 6) as w from (select seq, {seq} as t, unnest(range(1, 6)) as k from {counted_sql(10)}))"


@query("M8_net_score", f"select seq, max(score)::double as score from {_net_sql(f'(select seq, seq as w from {counted_sql(6)})', 6)} group by seq")
def m8(spark, sf):
    """Sequences no longer than a window."""
    return convnet.net_score(counted(spark, sf, 6).select("seq"), _net(False))


@query("M9_window_scan", f"select seq, max(score)::double as score from {_net_sql(_windows('seq'), 6)} group by seq")
def m9(spark, sf):
    return convnet.net_score(counted(spark, sf, 10).select("seq"), _net(False))


@query("M10_two_strands", f"select seq, max(score)::double as score from (select * from {_net_sql(_windows('seq'), 6)} union all select * from {_net_sql(_windows(rc_sql('seq')), 6)}) group by seq")
def m10(spark, sf):
    return convnet.net_score(counted(spark, sf, 10).select("seq"), _net(True))


@query(
    "ARR_pairs",
    "select vec_id, round(2 * e[1], 6) as added, round(e[2] - e[63], 6) as taken, round(e[3] * e[62], 6) as multiplied, round(case when e[61] = 0 then null else e[4] / e[61] end, 5) as divided, round(e[5] + 3 * e[60], 6) as scaled, (2 * len(e))::bigint as joined, 64e0 as ones, list_max(e) > 25e-2 as any_large from (select vec_id, [cast(x as double) for x in embedding] as e from embeddings)",
)
def arr_pairs(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    back, r, at = arrays.reversed_("e"), F.round, F.element_at
    e = e.withColumn("b", back)
    return e.select(
        "vec_id", r(at(arrays.add("e", "e"), 1), 6).alias("added"), r(at(arrays.subtract("e", "b"), 2), 6).alias("taken"), r(at(arrays.multiply("e", "b"), 3), 6).alias("multiplied"), r(at(arrays.divide("e", "b"), 4), 5).alias("divided"),
        r(at(arrays.add_scaled("e", "b", 3), 5), 6).alias("scaled"), F.size(arrays.cat("e", "b")).cast("long").alias("joined"), arrays.total(arrays.ones(64)).alias("ones"), arrays.any_true(F.transform("e", lambda x: x > 0.25)).alias("any_large"),
    )
