"""Exact second derivatives, many models in one scan, and fits held against the optimum that SQL finds.

SQL has no optimiser, so the fits here have few effective parameters: a motif of one base scores a probe by its numbers of A or T and of
C or G, whatever its frames and strands. SQL then takes the least value over a grid of one or two numbers, refined some times.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bindscape.operators import fitting, objective, probes
from bindscape.operators.params import Mode, Model

from .catalog import LEFT, RIGHT, SQL, all_sql, background_weight_sql, counted, counted_sql, folds_sql, kappa_sql, query, toy_background, toy_mode, toy_model, uniform_sql
from .queries_model import _selected


def _log_z0(r0: int, length: int) -> str:
    return f"(select ln(sum(exp({background_weight_sql('seq', r0, length)}))) from {all_sql(length)})"


def _z(k: int, flank: int, ns: float | None, r0: int, length: int) -> str:
    every = f"(select seq, exp({background_weight_sql('seq', r0, length)}) as pi from {all_sql(length)})"
    extra = "" if ns is None else f" + exp({ns}e0)"
    return f"((select sum(pi * kappa) from {kappa_sql(every, k, False, flank, keep='seq, pi')}) / exp({_log_z0(r0, length)}){extra})"


def _value(k: int, flank: int, ns: float | None, r0: int = 2, length: int = 6) -> str:
    """The likelihood of the toy model by listing all probes and all frames."""
    extra = "" if ns is None else f" + exp({ns}e0)"
    w = f"(select seq, cnt, sum(kappa){extra} as w from {kappa_sql(counted_sql(length), k, False, flank)} group by seq, cnt)"
    return f"(select sum(cnt) * ln({_z(k, flank, ns, r0, length)}) - sum(cnt * ({background_weight_sql('seq', r0, length)} - {_log_z0(r0, length)} + ln(w))) from {w})"


_POINTS = [(k, flank, ns) for k in (2, 3, 4) for flank in (0, 1) for ns in (None, -1.0)]


@query("H1_grid_values", " union all ".join(f"select {k}::bigint as k, {f}::bigint as flank, {str(n is not None).lower()} as ns, round({_value(k, f, n)}, 3) as value" for k, f, n in _POINTS))
def h1_values(spark, sf):
    """All points of a grid from one scan of the probes."""
    data = objective.Likelihood(counted(spark, sf, 6), toy_background(2, 6), cache=False)
    got = data.values_gradients([toy_model(k, ns=n, flank=f) for k, f, n in _POINTS])
    return spark.createDataFrame([(k, f, n is not None, round(float(v), 3)) for (k, f, n), (v, _) in zip(_POINTS, got, strict=True)], "k long, flank long, ns boolean, value double")


_FRAMES = kappa_sql(f"(select seq, exp({background_weight_sql('seq', 2, 6)} - {_log_z0(2, 6)}) as pi from {all_sql(6)})", 3, False, 1, keep="seq, pi")
_FEATURE, _SECOND = (f"4 * ({p} - 1) + instr('ACGT', substr(mer, {p}, 1)) - 1" for p in "pq")


@query(
    "A10_hessian",
    f"""with e as (select pi * kappa as m, mer from {_FRAMES}),
 ef as (select m, mer, p, {_FEATURE} as i from (select *, unnest(range(1, 4)) as p from e)),
 z1 as (select i, sum(m) as d from ef group by i union all select 12, exp(-1e0)),
 z2 as (select i, {_SECOND} as j, sum(m) as d from (select *, unnest(range(1, 4)) as q from ef) group by all union all select 12, 12, exp(-1e0)),
 z as (select sum(m) + exp(-1e0) as z from e),
 f as (select seq, cnt, kappa, mer from {kappa_sql(counted_sql(6), 3, False, 1)}),
 w as (select seq, cnt, sum(kappa) + exp(-1e0) as w from f group by seq, cnt),
 ff as (select seq, kappa, mer, {_FEATURE} as i from (select *, unnest(range(1, 4)) as p from f)),
 d1 as (select seq, i, sum(kappa) as d from ff group by all union all select seq, 12, exp(-1e0) from w),
 d2 as (select i, j, sum(cnt * d / w) as d from (select seq, i, {_SECOND} as j, sum(kappa) as d from (select *, unnest(range(1, 4)) as q from ff) group by all union all select seq, 12, 12, exp(-1e0) from w) join w using (seq) group by i, j),
 dd as (select a.i, b.i as j, sum(cnt * a.d * b.d / (w * w)) as d from d1 a join d1 b using (seq) join w using (seq) group by all),
 ij as (select i, j from (select unnest(range(0, 13)) as i) cross join (select unnest(range(0, 13)) as j))
 select ij.i::bigint as i, ij.j::bigint as j, round((select sum(cnt) from w) * (coalesce(z2.d, 0) / z - a.d * b.d / (z * z)) - coalesce(d2.d, 0) + coalesce(dd.d, 0), 3) + 0 as h
 from ij cross join z join z1 a on a.i = ij.i join z1 b on b.i = ij.j left join z2 on z2.i = ij.i and z2.j = ij.j left join d2 on d2.i = ij.i and d2.j = ij.j left join dd on dd.i = ij.i and dd.j = ij.j""",
)
def a10_hessian(spark, sf):
    """Second derivatives of the whole likelihood: of counted probes and of the partition function."""
    h = objective.Likelihood(counted(spark, sf, 6), toy_background(2, 6), cache=False).hessian(toy_model(3, ns=-1.0, flank=1))
    return spark.createDataFrame([(i, j, round(float(v), 3) + 0.0) for (i, j), v in np.ndenumerate(h)], "i long, j long, h double")


_H_SQL = SQL["A10_hessian"]


@query("K5_likelihood_hessian", f"select 0::bigint as fit, i, j, h as value from ({_H_SQL})")
def k5_hessian(spark, sf):
    """The second derivatives of a likelihood as the table that a fit leaves."""
    from bindscape.sources import models

    h = objective.Likelihood(counted(spark, sf, 6), toy_background(2, 6), cache=False).hessian(toy_model(3, ns=-1.0, flank=1))
    t = models.hessian_table(spark, [h])
    return t.select(*[F.col(c).cast("long").alias(c) for c in ("fit", "i", "j")], (F.round("value", 3) + 0.0).alias("value"))


_SLOPES = _H_SQL[: _H_SQL.index(" ij as (")] + " g as (select i, sum(cnt * d / w) as d from d1 join w using (seq) group by i)"


@query("O10_likelihood_slopes", f"{_SLOPES} select z1.i::bigint as i, round((select sum(cnt) from w) * z1.d / z - coalesce(g.d, 0), 2) + 0 as slope from z1 cross join z left join g on g.i = z1.i")
def o10(spark, sf):
    """Central differences of a likelihood by all of its parameters, from one scan, against its gradient."""
    data, model, step = objective.Likelihood(counted(spark, sf, 6), toy_background(2, 6), cache=False), toy_model(3, ns=-1.0, flank=1), 1e-4
    e = np.eye(13) * step
    values = [v for v, _ in data.values_gradients([model.with_vector(model.vector() + s * e[i]) for i in range(13) for s in (1, -1)])]
    return spark.createDataFrame([(i, round((values[2 * i] - values[2 * i + 1]) / (2 * step), 2) + 0.0) for i in range(13)], "i long, slope double")


def _kmers(k: int) -> str:
    return f"(select kmer, sum(cnt)::double as n from (select cnt, substr(t, i, {k}) as kmer from (select cnt, t, unnest(range(1, length(t) - {k - 2})) as i from (select cnt, concat('{LEFT[-(k - 1) :]}', seq, '{RIGHT[: k - 1]}') as t from {counted_sql(8)}))) group by kmer)"


def _kmer_fit(name: str, search: str):
    @query(name, f"select kmer, n from {_kmers(4)}")
    def run(spark, sf):
        """256 weights: at the optimum the 4-mer counts that the model expects are those observed."""
        from bindscape.operators import background

        c = counted(spark, sf, 8)
        model, _ = background.fit_background(c, 4, 8, LEFT, RIGHT, tolerance=1e-9, search=search)
        z, g = model.z_gradient()
        n = float(c.agg(F.sum("cnt")).first()[0])
        seen = background.count_vector(background.kmer_counts(c, 4, LEFT, RIGHT), 4) > 0
        names = ["".join("ACGT"[i >> 2 * j & 3] for j in (3, 2, 1, 0)) for i in range(256)]
        return spark.createDataFrame([(m, round(float(x)) + 0.0) for m, x, s in zip(names, n * g / z, seen, strict=True) if s], "kmer string, n double")


_kmer_fit("O2_kmer_fit", "more_thuente")
_kmer_fit("O3_kmer_fit", "wolfe")


def _product(turned: bool) -> str:
    total = "(" + " + ".join(f"exp({((3 * b) % 13) / 20 - 0.3:.2f})" for b in range(4)) + ")"
    each = ["(" + " + ".join(f"exp({((3 * b) % 13) / 20 - 0.3:.2f}) * exp({((7 * j + 5 * (3 - b if turned else b)) % 11) / 10 - 0.5:.1f})" for b in range(4)) + f") / {total}" for j in range(8)]
    return "(" + " * ".join(each) + ")"


_W32 = f"(select seq, cnt, sum(kappa) + exp(-1e0) as w from {kappa_sql(counted_sql(32), 8)} group by seq, cnt)"


@query("A8_32_bases", f"select round(sum(cnt) * ln(25 * ({_product(False)} + {_product(True)}) + exp(-1e0)) - sum(cnt * ({background_weight_sql('seq', 1, 32)} - 32 * ln({' + '.join(f'exp({((3 * b) % 13) / 20 - 0.3:.2f})' for b in range(4))}) + ln(w))), 2) as value from {_W32}")
def a8_32(spark, sf):
    """Probes of 32 bases fill a long. The partition function is a product over positions, as the background has single bases."""
    data = objective.Likelihood(counted(spark, sf, 32), toy_background(1, 32), cache=False)
    return spark.createDataFrame([(round(float(data.value_gradient(toy_model(8, ns=-1.0))[0]), 2),)], "value double")


@query("P1_encode_32", f"select seq, (select sum(case when i = 1 then (b - 4 * (b // 2)::hugeint) else b end * (4::hugeint ** (32 - i)::hugeint)::hugeint) from (select i, instr('ACGT', substr(seq, i, 1)) - 1 as b from (select unnest(range(1, 33)) as i)))::bigint as code, seq as back from {counted_sql(32)}")
def p1_32(spark, sf):
    from bindscape.functions import dna

    return counted(spark, sf, 32).select("seq", dna.encode("seq").alias("code")).withColumn("back", dna.decode("code", 32))


# Fits against a grid of their effective parameters.

_K = f"(sum(kappa) * (5e-1 + {uniform_sql('seq')}))"
#: queries_model._selected.
_SELECTED = f"(select seq, cnt from (select seq, floor(cnt * {_K})::bigint as cnt from {kappa_sql(counted_sql(6), 3)} group by seq, cnt) where cnt > 0)"
_P = [f"exp({((3 * b) % 13) / 20 - 0.3:.2f})" for b in range(4)]
_ALL = f"({' + '.join(_P)})"
#: Shares of A or T and of C or G in the toy background of single bases.
_WEAK, _STRONG = f"(({_P[0]} + {_P[3]}) / {_ALL})", f"(({_P[1]} + {_P[2]}) / {_ALL})"


def _weak(source: str, cnt: str = "cnt") -> str:
    """(m, c, e): reads by their number of A or T, and what the background says of them."""
    return f"(select length(seq) - length(replace(replace(seq, 'A', ''), 'T', '')) as m, sum({cnt})::double as c, sum({cnt} * ({background_weight_sql('seq', 1, 6)} - 6 * ln{_ALL})) as e from {source} group by m)"


def _least(f: str, source: str, numbers: int = 1, wide: float = 4.0, points: int = 401, stages: int = 3, keep: str = "") -> str:
    """A row (value, t[, u]): the least of sum f over rows of source, which may name t and u; each stage looks around the best of the last."""
    names, out = "tu"[:numbers], [f"src as materialized (select * from {source})"]
    step = 2 * wide / (points - 1)
    for k in range(stages):
        grids = " cross join ".join(f"(select {'' if not k else f'(select {x} from s{k - 1}) + '}(i - {points // 2}) * {step:.15e} as {x} from (select unnest(range(0, {points})) as i))" for x in names)
        out.append(f"s{k} as materialized (select {', '.join(names)}, sum({f}) as value from {grids} cross join src group by {', '.join(names)} order by value, {', '.join(names)} limit 1)")
        step = step * 4 / (points - 1)
    return f"(with {', '.join(out)} select value, {', '.join(names)} from s{stages - 1})"


def _one(m: str = "m", c: str = "c", e: str = "e") -> str:
    """Likelihood of a motif of one base without non-specific binding; exp(t) is what A or T is worth against C or G."""
    return f"{c} * ln(6 * ({_WEAK} * exp(t) + {_STRONG})) - {c} * ln({m} * exp(t) + 6 - {m}) - {e}"


def _two(m: str = "m") -> str:
    """With non-specific binding of affinity 1: exp(t) for A or T, exp(u) for C or G."""
    return f"c * ln(6 * ({_WEAK} * exp(t) + {_STRONG} * exp(u)) + 1) - c * ln({m} * exp(t) + (6 - {m}) * exp(u) + 1) - e"


_EXACT = fitting.Settings(penalty=0.0, tolerance=1e-9)
_ONE = _least(_one(), _weak(_SELECTED))
_PAIR = _least(_two(), _weak(_SELECTED), 2, 6.0, 61, 6)


def _data(spark, sf):
    return objective.Likelihood(_selected(spark, sf), toy_background(1, 6))


def _ratio(model: Model, mode: int = 0) -> float:
    a, c, g, t = np.exp(model.modes[mode].nuc[0])
    return float(np.log((a + t) / (c + g)))


@query("O1_closed_form", f"select round(value, 3) as value, round(t, 3) as weak_over_strong from {_ONE}")
def o1(spark, sf):
    data = _data(spark, sf)
    got = fitting.fit(data, Model([Mode.zeros(1)]), _EXACT, seeded=False)
    data.release()
    return spark.createDataFrame([(round(got.value, 3), round(_ratio(got.model), 3))], "value double, weak_over_strong double")


@query("O8_shift_values", f"select unnest([0, 1, -1]) as shift, round(value, 3) as value from {_ONE}")
def o8(spark, sf):
    """Moving a motif of one base leaves nothing of it; the fit finds it anew, on both sides in the same scans."""
    data = _data(spark, sf)
    fits = fitting.shift_fits(data, fitting.fit(data, Model([Mode.zeros(1)]), _EXACT, seeded=False), 1, _EXACT)
    data.release()
    return spark.createDataFrame([(f.shift, round(f.value, 3)) for f in fits], "shift int, value double")


_FOLDED = folds_sql(_SELECTED, 0.4, [0, 1, 2])
_HELD = " union all ".join(f"select {f}::bigint as fold, round((select sum({_one()}) from {_weak(_FOLDED, f'test_{f}')}) / (select sum(test_{f}) from {_FOLDED}), 6) as per_read from {_least(_one(), _weak(_FOLDED, f'train_{f}'))}" for f in range(3))


@query("O9_fold_values", _HELD)
def o9(spark, sf):
    """Three folds as counts of one table: their refits in the same scans, their tests in one."""
    split = probes.folds(_selected(spark, sf), 0.4, [0, 1, 2]).withColumn("cnt", F.col("train_0") + F.col("test_0"))
    data = objective.Likelihood(split, toy_background(1, 6), more=tuple(f"{x}_{f}" for f in range(3) for x in ("train", "test")))
    start = fitting.fit(data, Model([Mode.zeros(1)]), _EXACT, seeded=False)
    got = fitting.cross_validate(data, [(1 + 2 * f, 2 + 2 * f) for f in range(3)], start, _EXACT)
    data.release()
    return spark.createDataFrame([(f, round(v, 6)) for f, v in enumerate(got)], "fold long, per_read double")


_A3 = f"(select cnt::double as c, cnt * ({background_weight_sql('seq', 1, 6)} - 6 * ln{_ALL}) as e, a, za from (select seq, cnt, sum(kappa) as a from {kappa_sql(_SELECTED, 3, number=2)} group by seq, cnt) cross join (select sum(pi * kappa) as za from {kappa_sql(f'''(select seq, exp({background_weight_sql('seq', 1, 6)} - 6 * ln{_ALL}) as pi from {all_sql(6)})''', 3, keep='seq, pi', number=2)}))"


@query("O14_relative_affinity", f"select round(value, 3) as value, round(t, 3) as mode_over_ns from {_least('c * ln(za * exp(t) + 1) - c * ln(a * exp(t) + 1) - e', _A3, 1, 10.0, 201, 4)}")
def o14(spark, sf):
    """A motif of three bases as it is, and non-specific binding: only their ratio moves."""
    data, start = _data(spark, sf), Model([toy_mode(3, number=2)], -1.0)
    got = fitting.mode_regression(data, start, _EXACT)
    data.release()
    moved = float((got.model.modes[0].nuc - start.modes[0].nuc).mean(axis=1).sum())
    return spark.createDataFrame([(round(got.value, 3), round(moved - got.model.ns, 3))], "value double, mode_over_ns double")


_A0 = f"(select cnt::double as c, cnt * ({background_weight_sql('seq', 1, 6)} - 6 * ln{_ALL}) as e, a, za, length(seq) - length(replace(replace(seq, 'A', ''), 'T', '')) as m from (select seq, cnt, sum(kappa) as a from {kappa_sql(_SELECTED, 2)} group by seq, cnt) cross join (select sum(pi * kappa) as za from {kappa_sql(f'''(select seq, exp({background_weight_sql('seq', 1, 6)} - 6 * ln{_ALL}) as pi from {all_sql(6)})''', 2, keep='seq, pi')}))"


@query("O15_one_mode_moves", f"select true as frozen, round(value, 2) as value from {_least(f'c * ln(za + 6 * ({_WEAK} * exp(t) + {_STRONG} * exp(u))) - c * ln(a + m * exp(t) + (6 - m) * exp(u)) - e', _A0, 2, 12.0, 25, 9)}")
def o15(spark, sf):
    """Of two modes one is held fast; the other, of one base, finds its place beside it."""
    data, start = _data(spark, sf), Model([toy_mode(2), Mode.zeros(1)])
    got = fitting.fit(data, start, _EXACT, active=np.arange(12) >= 8)
    data.release()
    return spark.createDataFrame([(bool(np.array_equal(got.model.modes[0].nuc, start.modes[0].nuc)), round(got.value, 2))], "frozen boolean, value double")


@query("H3_sweep_values", f"select 1::bigint as k, false as ns, round(value, 2) as value from {_ONE} union all select 1, true, round(value, 2) from {_PAIR}")
def h3(spark, sf):
    """A length that fits and one that doesn't, with and without non-specific binding, side by side."""
    data = _data(spark, sf)
    fits = fitting.length_sweep(data, [1, 9], [0], [False, True], settings=_EXACT)
    data.release()
    return spark.createDataFrame([(f.model.modes[0].k, f.model.ns is not None, round(f.value, 2)) for f in fits], "k long, ns boolean, value double")


@query("H2_seed_values", f"select 2::bigint as modes, round(value, 2) as value from {_PAIR}")
def h2(spark, sf):
    """Two seeds of one base and non-specific binding: together they are worth one motif of one base."""
    data = _data(spark, sf)
    got = fitting.seeded_fit(data, [toy_mode(1), toy_mode(1, number=1)], True, 0, _EXACT)
    data.release()
    return spark.createDataFrame([(len(got.model.modes), round(got.value, 2))], "modes long, value double")


@query("H4_added_mode_values", f"select unnest([1, 2])::bigint as modes, round(value, 3) as value from {_ONE}")
def h4(spark, sf):
    """A second motif of one base adds nothing to the first."""
    data = _data(spark, sf)
    one = fitting.fit(data, Model([Mode.zeros(1)]), _EXACT, seeded=False)
    two = fitting.add_mode(data, one, 1, _EXACT)
    data.release()
    return spark.createDataFrame([(len(f.model.modes), round(f.value, 3)) for f in (one, two)], "modes long, value double")


def _far_mode(k: int = 5) -> Mode:
    """A motif of single bases and of pairs two and three places apart, weights by formula."""
    return Mode(toy_mode(k).nuc, None, None, {d: np.array([[((3 * j + 2 * x + d) % 7) / 20 - 0.15 for x in range(16)] for j in range(k - d)]) for d in (2, 3)})


def _far_sql(mer: str, k: int = 5) -> str:
    base = lambda i: f"(instr('ACGT', substr({mer}, {i + 1}, 1)) - 1)"
    terms = [f"(((3 * {j} + 2 * (4 * {base(j)} + {base(j + d)}) + {d}) % 7) / 2e1 - 15e-2)" for d in (2, 3) for j in range(k - d)]
    return f"exp(ln(kappa) + {' + '.join(terms)})"


@query("W10_far_pairs", f"select seq, round(sum({_far_sql('mer')}), 6) as w from {kappa_sql(counted_sql(8), 5, False, 1)} group by seq")
def w10_far(spark, sf):
    """Pairs of bases that are no neighbours."""
    from bindscape.operators import scoring

    return scoring.probe_weights(counted(spark, sf, 8), Model([_far_mode()], None, 1), LEFT, RIGHT).select("seq", F.round("w", 6).alias("w"))


_FAR_Z = f"(select ln(sum(exp({background_weight_sql('seq', 2, 6)}) * k) / exp({_log_z0(2, 6)})) from (select seq, sum({_far_sql('mer')}) as k from {kappa_sql(f'(select seq, 1 as cnt from {all_sql(6)})', 5)} group by seq))"


@query("O17_far_likelihood", f"select round((select sum(cnt) from {counted_sql(6)}) * {_FAR_Z} - sum(cnt * ({background_weight_sql('seq', 2, 6)} - {_log_z0(2, 6)} + ln(w))), 3) as value from (select seq, cnt, sum({_far_sql('mer')}) as w from {kappa_sql(counted_sql(6), 5)} group by seq, cnt)")
def o17_far(spark, sf):
    """The likelihood with such pairs, its partition function by states of the last three bases."""
    data = objective.Likelihood(counted(spark, sf, 6), toy_background(2, 6), cache=False)
    return spark.createDataFrame([(round(data.value_gradient(Model([_far_mode()]))[0], 3),)], "value double")

