"""Partition functions, likelihoods, optimisers and fits: enumeration, finite differences, recovery."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindscape.operators import background, fitting, objective, optimize, partition, scoring
from bindscape.operators.params import Mode, Model, Symmetry, compress, even_odd, normal_form, normalize_modes, null_directions
from bindscape.plans.catalog import shape_values, toy_model

LEFT, RIGHT = "GACTTAC", "TGCATGG"


def rand_bg(k, length, seed=0):
    return background.Background(np.random.default_rng(seed).normal(0, 0.4, 4**k), k, length, LEFT, RIGHT)


def rand_mode(k, di=False, features=0, seed=1):
    rng = np.random.default_rng(seed)
    return Mode(rng.normal(0, 0.5, (k, 4)), rng.normal(0, 0.3, (k - 1, 16)) if di else None, rng.normal(0, 0.3, (k, features)) if features else None)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_background(k):
    bg = rand_bg(k, 4)
    assert bg.z() == pytest.approx(background.enumerated_z(bg))
    numeric = optimize.numeric_gradient(lambda v: background.Background(v, k, 4, LEFT, RIGHT).z(), bg.beta)
    assert bg.z_gradient()[1] == pytest.approx(numeric, rel=1e-5, abs=1e-5)


@pytest.mark.parametrize("r0", [1, 2, 3])
@pytest.mark.parametrize("flank", [0, 1, 2])
@pytest.mark.parametrize("kind", [(False, 0), (True, 0), (False, 2), (True, 2)])
def test_partition(r0, flank, kind):
    di, features = kind
    bg, mode, shape = rand_bg(r0, 4), rand_mode(3, di, features), shape_values(2) if features else None
    model = Model([mode, rand_mode(2, seed=5)], -0.7, flank)
    z, g = partition.model_z(bg, model, shape, True)
    assert z == pytest.approx(partition.enumerated(bg, model, shape))
    numeric = optimize.numeric_gradient(lambda v: partition.model_z(bg, model.with_vector(v), shape), model.vector())
    assert g == pytest.approx(numeric, rel=1e-5, abs=1e-6)


@pytest.fixture(scope="module")
def planted(spark):
    """Probes of 5 whose counts follow a known model exactly."""
    bg, truth = rand_bg(2, 5), Model([rand_mode(3, seed=9)], None, 1)
    from itertools import product

    seqs = ["".join(v) for v in product("ACGT", repeat=5)]
    x = scoring.codes(seqs)
    p = np.exp(bg.log_probabilities(x)) * partition.probe_sums(x, bg, truth)
    cnt = np.round(2e5 * p / p.sum()).astype(int)
    df = spark.createDataFrame([(s, int(c)) for s, c in zip(seqs, cnt) if c], "seq string, cnt long").repartition(4).cache()
    return bg, truth, df


def test_likelihood_derivatives(planted):
    bg, truth, df = planted
    data = objective.Likelihood(df, bg, penalty=1e-3)
    model = Model([rand_mode(3, True, seed=4), rand_mode(2, seed=6)], -1.0, 1)
    value, gradient = data.value_gradient(model)
    v = model.vector()
    for i in (0, 5, 13, 20, len(v) - 1):
        e = np.zeros(len(v))
        e[i] = 1e-4
        d = (data.value_gradient(model.with_vector(v + e))[0] - data.value_gradient(model.with_vector(v - e))[0]) / 2e-4
        assert gradient[i] == pytest.approx(d, rel=1e-4, abs=1e-1)
    h = data.hessian(Model([rand_mode(2, seed=4)], -1.0, 1))
    small = Model([rand_mode(2, seed=4)], -1.0, 1)
    u = small.vector()
    e = np.zeros(len(u))
    e[3] = 1e-4
    column = (data.value_gradient(small.with_vector(u + e))[1] - data.value_gradient(small.with_vector(u - e))[1]) / 2e-4
    assert h[3] == pytest.approx(column, rel=1e-3, abs=1.0) and h == pytest.approx(h.T)


def test_recovery(planted):
    bg, truth, df = planted
    data = objective.Likelihood(df, bg)
    got = fitting.fit(data, Model([Mode.zeros(3)], None, 1), fitting.Settings(tolerance=1e-6, errors=True), seeded=False)
    assert got.value <= data.value_gradient(truth)[0] + 1
    a, b = normal_form(got.model.modes[0]).vector(), normal_form(truth.modes[0]).vector()
    turned = normal_form(truth.modes[0].reverse_complement()).vector()
    assert min(abs(a - b).max(), abs(a - turned).max()) < 0.03
    assert got.null_vectors == len(null_directions(Mode.zeros(3))) and (got.errors >= 0).all() and got.adjusted >= -1e-9
    shifted = fitting.shift_fits(data, got, 1, fitting.Settings(tolerance=1e-3))
    assert len(shifted) == 3 and fitting.best(shifted).value <= got.value + 1e-6


def test_symmetric_fit(planted):
    bg, _, df = planted
    data = objective.Likelihood(df, bg)
    got = fitting.fit(data, Model([Mode.zeros(4)], None, 1), fitting.Settings(tolerance=1e-4, symmetry=even_odd(4)))
    m = got.model.modes[0]
    assert m.nuc - m.nuc.mean(axis=1, keepdims=True) == pytest.approx(m.reverse_complement().nuc - m.reverse_complement().nuc.mean(axis=1, keepdims=True), abs=1e-6)


def test_background_fit(planted):
    _, _, df = planted
    bg, value = background.fit_background(df, 2, 5, LEFT, RIGHT)
    n = df.agg({"cnt": "sum"}).first()[0]
    x = background.count_vector(background.kmer_counts(df, 2, LEFT, RIGHT), 2)
    z, g = bg.z_gradient()
    assert n * g / z == pytest.approx(x, abs=0.5)  # expected counts meet the observed ones
    assert value == pytest.approx(background.likelihood(bg, x, n)[0])


def test_optimizers():
    def rosenbrock(v):
        x, y = v
        return (1 - x) ** 2 + 100 * (y - x * x) ** 2, np.array([-2 * (1 - x) - 400 * x * (y - x * x), 200 * (y - x * x)])

    got = optimize.lbfgs(rosenbrock, np.array([-1.2, 1.0]), tolerance=1e-9, keep=True)
    assert got.x == pytest.approx([1, 1]) and len(got.trajectory) == got.rounds + 1
    assert optimize.pattern_search(lambda v: rosenbrock(v)[0], np.array([-1.2, 1.0]), least=1e-7).x == pytest.approx([1, 1], abs=1e-2)
    with pytest.raises(optimize.NotConverged):
        optimize.lbfgs(rosenbrock, np.array([-1.2, 1.0]), most=3)
    saddle = lambda v: (v[0] ** 2 - v[1] ** 2 + v[1] ** 4, np.array([2 * v[0], -2 * v[1] + 4 * v[1] ** 3]))
    out = optimize.escape(saddle, np.zeros(2), np.diag([2.0, -2.0]))
    assert saddle(out)[0] < 0 and optimize.escape(saddle, np.array([0, 0.7]), np.diag([2.0, 4.0])) is None
    assert optimize.numeric_hessian(lambda v: saddle(v)[1], np.zeros(2)) == pytest.approx(np.diag([2.0, -2.0]), abs=1e-6)


def test_symmetry_and_gauge():
    assert even_odd(4) == "1,2,-2,-1" and even_odd(5) == "1,2,*,-2,-1"
    with pytest.raises(ValueError):
        even_odd(1)
    with pytest.raises(ValueError):
        Symmetry("1,x,-1")
    tie = Symmetry(even_odd(3)).tie(Mode.zeros(3, True))
    m = Mode.zeros(3, True).with_vector(tie @ np.random.default_rng(2).normal(size=tie.shape[1]))
    assert m.reverse_complement().vector() == pytest.approx(m.vector())
    assert tie @ compress(m.vector(), tie) == pytest.approx(m.vector())
    mode, bg = rand_mode(3, True), rand_bg(1, 4)
    x = scoring.codes(["ACGT", "TTAG", "CCGA"])
    a, b = (scoring.kappas(x, y) for y in (mode, normal_form(mode, True)))
    assert a == pytest.approx(b)
    c = scoring.kappas(x, normal_form(mode))
    assert a / a[0, 0] == pytest.approx(c / c[0, 0])
    n = normalize_modes(toy_model(4, ns=-1.0, modes=2))
    assert max(m.nuc.max(axis=1).sum() for m in n.modes) == pytest.approx(0)


def test_best_sequence_and_turning():
    from itertools import product

    mode = rand_mode(4, True)
    seqs = ["".join(v) for v in product("ACGT", repeat=4)]
    k = scoring.kappas(scoring.codes(seqs), mode)[:, 0]
    best, top = scoring.best_sequence(mode)
    assert best == seqs[int(k.argmax())] and top == pytest.approx(k.max())
    x = scoring.codes(seqs)
    assert scoring.kappas(3 - x[:, ::-1], mode) == pytest.approx(scoring.kappas(x, mode.reverse_complement()))
    assert mode.shifted(1).nuc[1] == pytest.approx(mode.nuc[0]) and not mode.shifted(1).nuc[0].any() and mode.grown().k == 6
    lo = scoring.logo(Mode(mode.nuc), left=1)
    assert np.isnan(lo[:, 0]).all() and np.nanmean(lo[:, 1:], axis=0) == pytest.approx(0)


def test_feasible_and_sweep(planted):
    assert fitting.feasible(16, 0, 8, False) and not fitting.feasible(16, 9, 8, False) and not fitting.feasible(16, 7, 8, True) and not fitting.feasible(4, 0, 5, False)
    bg, _, df = planted
    fits = fitting.length_sweep(objective.Likelihood(df, bg), [2, 9], [1], [False], settings=fitting.Settings(tolerance=1e-3))
    assert len(fits) == 1
    with pytest.raises(optimize.NotConverged):
        fitting.best([])


def test_more_thuente():
    """Both line searches reach the same minima, from good and bad first steps, and give steps that meet their conditions."""
    rng = np.random.default_rng(3)
    for k in range(60):
        a, b, c = rng.normal(), rng.uniform(0.5, 3), rng.uniform(0, 0.5)
        f = lambda x: (b * (x - a) ** 2 + c * np.sin(5 * x), 2 * b * (x - a) + 5 * c * np.cos(5 * x))  # noqa: B023, E731
        x0 = a + rng.choice([-4.0, 4.0])
        f0, g0 = f(x0)
        way = -np.sign(g0)
        phi = lambda t: (f(x0 + t * way)[0], f(x0 + t * way)[1] * way, None)  # noqa: B023, E731
        for search, c2 in ((optimize.more_thuente, 0.99), (optimize.wolfe, 0.9)):
            for first in (1e-3, 1.0, 50.0):
                t, v, *_ = search(phi, f0, -abs(g0), first)
                assert t > 0 and v <= f0 - 1e-4 * t * abs(g0) and abs(f(x0 + t * way)[1]) <= c2 * abs(g0) + 1e-9, (k, search, first)

    def rosenbrock(v):
        x, y = v
        return (1 - x) ** 2 + 100 * (y - x * x) ** 2, np.array([-2 * (1 - x) - 400 * x * (y - x * x), 200 * (y - x * x)])

    got = optimize.lbfgs(rosenbrock, np.array([-1.2, 1.0]), tolerance=1e-9, search="more_thuente")
    assert got.x == pytest.approx([1, 1])


def test_fit_leaves_a_saddle(planted):
    """Two equal modes stay equal without the escape; with it the fit ends lower, where no eigenvalue is negative."""
    bg, _, df = planted
    data = objective.Likelihood(df, bg, penalty=1e-5)
    start, s = Model([Mode.zeros(2), Mode.zeros(2)]), fitting.Settings(tolerance=1e-6)
    stuck, free = fitting.fit(data, start, s, saddles=False), fitting.fit(data, start, s)
    assert stuck.model.modes[0].nuc == pytest.approx(stuck.model.modes[1].nuc, abs=1e-6)
    assert free.value < stuck.value - 1
    values = np.linalg.eigvalsh(data.hessian(free.model))
    assert values[0] / np.abs(values).max() > -1e-6


def test_chunks_like_features(planted):
    """The lookups of chunks against the sums over all features, for modes longer than a chunk."""
    rng = np.random.default_rng(6)
    bg = rand_bg(2, 12)
    x, cnt = rng.integers(0, 4, (50, 12)).astype(np.uint8), rng.integers(1, 9, 50).astype(float)
    for model in (Model([rand_mode(8, True), rand_mode(7, False, seed=3)], -1.0, 2), Model([rand_mode(13, True)], None, 3), Model([rand_mode(1)])):
        v, g, _ = objective.probe_derivatives(x, cnt, bg, model, None)
        v2, g2 = objective.probe_sums(objective.Block(x, bg), cnt, model)
        assert v2 == pytest.approx(v) and g2 == pytest.approx(g)


def test_swap(planted):
    bg, truth, df = planted
    data = objective.Likelihood(df, bg, penalty=1e-3, cache=False)
    other = data.swapped(df.limit(10))
    assert other.n < data.n and other.penalty == pytest.approx(1e-3 * other.n) and other.value_gradient(truth)[0] > 0
    with pytest.raises(ValueError):
        data.swapped(df.selectExpr("concat(seq, 'A') as seq", "cnt"))
    with pytest.raises(Exception, match="not a probe"):
        objective.Likelihood(df.selectExpr("translate(seq, 'A', 'N') as seq", "cnt"), bg, cache=False)
        objective.Likelihood(df.selectExpr("translate(seq, 'A', 'N') as seq", "cnt"), bg, cache=False).value_gradient(truth)


def test_site_symmetry():
    from bindscape.operators.params import SiteSymmetry

    def classes(text, k, distance=0):
        return [tuple(np.flatnonzero(r)) for r in SiteSymmetry(text, k).tie(distance)]

    assert SiteSymmetry(None, 3).tie().shape == (12, 12) and (SiteSymmetry("null", 3).tie(1) == np.eye(32)).all()
    assert classes("ABCDE|..|edcba", 12) == classes("1:5:0|0:2:0|-1:5:0", 12)
    for d in range(5):
        assert classes("ABCDE|..|edcba", 12, d) == classes("1:5:0|0:2:0|-1:5:0", 12, d)
    own = SiteSymmetry("1:3:1", 3)
    for d, width in ((0, 4), (1, 16), (2, 16)):  # turning the site round exchanges tied features only
        tie, n = own.tie(d), 3 - d
        turned = [(n - 1 - p) * width + ((3 - x) if d == 0 else 4 * (3 - x % 4) + 3 - x // 4) for p in range(n) for x in range(width)]
        assert (tie[turned] == tie).all()
    assert SiteSymmetry("A1", 2).tie().shape == (8, 6)
    for bad, k in (("ABC", 2), ("1:0:0", 0), ("1:2", 2), ("1:2:0|1:3:0", 5), ("A||B", 2)):
        with pytest.raises(ValueError):
            SiteSymmetry(bad, k)


def test_symmetry_of_each_mode(planted):
    bg, _, df = planted
    data = objective.Likelihood(df, bg, penalty=1e-4)
    got = fitting.fit(data, Model([rand_mode(2, seed=2), rand_mode(3, seed=4)], -1.0), fitting.Settings(tolerance=1e-4, symmetry=("1,-1", None), escapes=0))
    a = got.model.modes[0].nuc
    assert a[0] == pytest.approx(a[1, ::-1]) and not np.allclose(got.model.modes[1].nuc[0], got.model.modes[1].nuc[2, ::-1])


@pytest.mark.parametrize("r0", [1, 3])
@pytest.mark.parametrize("flank", [0, 2])
@pytest.mark.parametrize("kind", [(False, 0), (True, 0), (False, 2), (True, 2)])
def test_partition_hessian(r0, flank, kind):
    """Second derivatives of Z against the sum over all probes, frames and strands."""
    from itertools import product

    di, features = kind
    bg, shape = rand_bg(r0, 4), shape_values(2) if features else None
    model = Model([rand_mode(3, di, features), rand_mode(2, di, features, seed=5)], -0.7, flank)
    z, g, h = partition.model_z_hessian(bg, model, shape)
    assert z == pytest.approx(partition.model_z(bg, model, shape)) and g == pytest.approx(partition.model_z(bg, model, shape, True)[1])
    x = np.array(list(product(range(4), repeat=4)), np.uint8)
    pi, want, at = np.exp(bg.log_probabilities(x)), np.zeros(h.shape), 0
    for m in model.modes:
        n = len(m.vector())
        full = partition.padded(x, LEFT, RIGHT, flank + (2 if features else 0))
        for strand in (full, 3 - full[:, ::-1]):
            kappa = scoring.kappas(strand, m, shape)
            for s, f in enumerate(objective.features(strand, m, shape)):
                want[at : at + n, at : at + n] += (f * (pi * kappa[:, s])[:, None]).T @ f
        at += n
    want[-1, -1] = np.exp(-0.7)
    assert np.abs(h - want).max() <= 1e-9 * np.abs(want).max()


def test_many_models_and_counts_in_one_scan(spark, planted, monkeypatch):
    bg, truth, df = planted
    both = df.selectExpr("seq", "cnt", "cnt % 7 as odd", "null as none")
    data = objective.Likelihood(both, bg, penalty=1e-3, more=("odd", "none"))
    models = [truth, Model([rand_mode(2, True)], -1.0, 0), Model([rand_mode(4)], None, 2), Model([rand_mode(3), rand_mode(2)], 0.5, 1)]
    alone = [(data.column(c).value_gradient(m), data.column(c).hessian(m)) for m in models for c in (0, 1)]
    before = data.evaluations
    got = data.values_gradients([m for m in models for _ in (0, 1)], [0, 1] * 4)
    assert data.evaluations == before + 1
    for (v, g), ((w, d), _) in zip(got, alone, strict=True):
        assert v == pytest.approx(w) and g == pytest.approx(d)
    own = objective.Likelihood(df.selectExpr("seq", "cnt % 7 as cnt"), bg, penalty=1e-3)
    assert own.value_gradient(truth)[0] == pytest.approx(got[1][0]) and own.n == data.column(1).n and data.column(2).n == 0
    monkeypatch.setattr(objective, "FAN", 2)  # many levels
    assert data.tasks > 2
    for (v, h), m in zip([(x[0][0], x[1]) for x in alone[::2]], models, strict=True):
        assert data.value_gradient(m)[0] == pytest.approx(v) and data.hessian(m) == pytest.approx(h)
    data.release()


def test_fits_side_by_side_share_scans(planted):
    bg, _, df = planted
    data = objective.Likelihood(df, bg, penalty=1e-3)
    s = fitting.Settings(tolerance=1e-5)
    starts = [Model([rand_mode(k, seed=k)], ns, 1) for k in (1, 2, 3) for ns in (None, -1.0)]
    alone, scans = [], []
    for m in starts:
        before = data.evaluations
        alone.append(fitting.fit(data, m, s).value)
        scans.append(data.evaluations - before)
    asked = []
    plain = data.answer
    data.answer = lambda asks: asked.append(len(asks)) or plain(asks)
    got = fitting.together(data, [lambda view, m=m: fitting.fit(view, m, s) for m in starts])
    assert [f.value for f in got] == pytest.approx(alone)
    assert sum(asked) == sum(scans) and len(asked) == max(scans)

    def fails(view):
        view.value_gradient(starts[0])
        raise ValueError("mine")

    with pytest.raises(ValueError, match="mine"):
        fitting.together(data, [fails, lambda view: fitting.fit(view, starts[1], s)])
    data.release()


def test_32_bases(spark):
    from bindscape.functions import dna

    rng = np.random.default_rng(3)
    seqs = ["T" * 32, "A" * 32, "G" + "C" * 31] + ["".join(rng.choice(list("ACGT"), 32)) for _ in range(40)]
    df = spark.createDataFrame([(s, k % 3 + 1) for k, s in enumerate(seqs)], "seq string, cnt long")
    for r in df.select("seq", dna.encode("seq").alias("c")).withColumn("back", dna.decode("c", 32)).collect():
        assert r["back"] == r["seq"] and r["c"] % 2**64 == sum("ACGT".index(b) * 4 ** (31 - i) for i, b in enumerate(r["seq"]))
    assert [tuple(r) for r in spark.createDataFrame([("",), ("G",), ("ACGT" * 4,), ("A" * 33,), (None,)], "s string").select(dna.encode("s")).collect()] == [(None,), (2,), (int("0123" * 4, 4),), (None,), (None,)]
    bg = rand_bg(2, 32)
    data, model = objective.Likelihood(df, bg, cache=False), Model([rand_mode(8, True)], -1.0)
    x = scoring.codes(seqs)
    w = partition.probe_sums(x, bg, model)
    cnt = np.array([k % 3 + 1 for k in range(len(seqs))])
    assert data.value_gradient(model)[0] == pytest.approx(cnt.sum() * np.log(partition.model_z(bg, model)) - cnt @ (bg.log_probabilities(x) + np.log(w)))


def test_binomial_splits(spark):
    from math import comb

    from bindscape.operators import probes

    for n, p in ((1, 0.5), (7, 0.3), (40, 0.9), (300, 0.01)):
        total = np.cumsum([comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
        u = np.random.default_rng(n).random(200)
        assert probes.binomial_quantiles(n, p, u).tolist() == np.searchsorted(total, u).tolist()
    big = probes.binomial_quantiles(10**9, 0.25, np.random.default_rng(1).random(2000)) - 25e7
    assert abs(big.mean()) < 5 * 13693 / 45 and 0.9 < big.std() / 13693 < 1.1
    assert probes.binomial_quantiles(5, 0.0, np.array([0.5])).tolist() == [0] and probes.binomial_quantiles(5, 1.0, np.array([0.5])).tolist() == [5]
    df = spark.createDataFrame([("ACGT", 10**9), ("AAAA", 0), ("CCCC", None), ("GGGG", 3)], "seq string, cnt long")
    rows = {r["seq"]: r for r in probes.folds(df, 0.5, [0, 1]).collect()}
    assert all(rows["ACGT"][f"train_{f}"] + rows["ACGT"][f"test_{f}"] == 10**9 and abs(rows["ACGT"][f"test_{f}"] - 5e8) < 1e5 for f in (0, 1))
    assert rows["ACGT"]["test_0"] != rows["ACGT"]["test_1"] and tuple(rows["AAAA"])[1:] == tuple(rows["CCCC"])[1:] == (0, 0, 0, 0)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_density_by_transfer_matrix(spark, k):
    """Against the listing of all sequences of 6, scores as Spark sees them."""
    from bindscape.operators import dos
    from bindscape.plans.catalog import toy_background, toy_mode

    listed = dos.all_sequences(spark, 6).withColumn("cnt", F.lit(1))
    bg = toy_background(k, 6)
    for score, before, behind in ((dos.Additive.of_background(bg), bg.left[-(k - 1) :] if k > 1 else "", bg.right[: k - 1]), (dos.Additive.of_mode(toy_mode(6, k > 1)), "A", ""), (dos.Additive.of_background(background.Background(bg.beta, k, 6, flanked=False)), "", "")):
        rows = dos.density_of_probes(listed, score, 0.05, before, behind).collect()
        assert sum(r["states"] for r in rows) == 4**6
        assert all(r["reads"] == r["states"] and abs(r["ln_ratio"]) < 1e-12 for r in rows)
    one = scoring.weight_term(F.col("seq"), toy_mode(6, True))
    want = {round(r["s"] * 20): r["n"] for r in listed.groupBy(F.round(one, 6).alias("s")).agg(F.count("*").alias("n")).collect()}
    q, n = dos.Additive.of_mode(toy_mode(6, True)).density(0.05)
    assert dict(zip(q.tolist(), n.tolist())) == want


def test_density_of_long_sequences():
    from bindscape.operators import dos

    score = dos.Additive.of_background(rand_bg(3, 32))
    q, n = score.density(0.01)
    assert n.sum() == pytest.approx(4.0**32)
    # The mean score over all sequences is the sum of the mean weights, but for context and grain.
    bg = background.Background(np.tile([1.0, 2.0, 3.0, 5.0], 4), 2, 20, flanked=False)
    q, n = dos.Additive.of_background(bg).density(1.0)
    assert (q @ n) / n.sum() == pytest.approx(19 * 2.75) and n.sum() == 4**20


def test_markov(spark):
    from bindscape.operators import dos, probes

    rng = np.random.default_rng(5)
    seqs = ["".join(rng.choice(list("AACGT"), 6)) for _ in range(500)]
    c = probes.count_probes(spark.createDataFrame([(s,) for s in seqs], "seq string"))
    for k in (1, 2, 3):
        chances = background.markov_by_division(c, k)
        model = background.markov_model(chances, k, 6)
        table = {r["kmer"]: r["p"] for r in chances.collect()}
        weight = lambda s: float(np.prod([table.get(s[i : i + k], 0.0) for i in range(7 - k)]))  # noqa: E731, B023
        z = sum(weight(r["seq"]) for r in dos.all_sequences(spark, 6).collect())
        assert model.z() == pytest.approx(z)
        got = background.markov_likelihood(c, chances, k, 6).first()
        assert got["value"] == pytest.approx(-sum(np.log(weight(s) / z) for s in seqs)) and got["unseen"] == 0
    few = chances.where("kmer != 'AAA'")
    assert background.markov_likelihood(c, few, 3, 6).first()["unseen"] == sum("AAA" in s for s in seqs)
    assert 0 <= dict(background.markov_fit(c, c, [2], 6))[2] <= 1


def far_mode(k=5, seed=1):
    rng = np.random.default_rng(seed)
    return Mode(rng.normal(0, 0.4, (k, 4)), rng.normal(0, 0.3, (k - 1, 16)), None, {d: rng.normal(0, 0.3, (k - d, 16)) for d in (2, 3)})


def test_far_pairs(spark):
    """Pairs at distances: scores of both paths, Z with its derivatives, and turning, against plain sums."""
    from itertools import product

    bg, mode = rand_bg(1, 5), far_mode()
    seqs = ["".join(v) for v in product("ACGT", repeat=5)]
    x = scoring.codes(seqs)
    plain = [sum(mode.nuc[j]["ACGT".index(s[j])] for j in range(5)) + sum(w[j]["ACGT".index(s[j]) * 4 + "ACGT".index(s[j + d])] for d, w in {1: mode.di, **mode.far}.items() for j in range(5 - d)) for s in seqs]
    assert np.log(scoring.kappas(x, mode)[:, 0]) == pytest.approx(plain)
    assert mode.with_vector(mode.vector()).vector() == pytest.approx(mode.vector()) and len(Mode.zeros(5, True, 0, (3, 2)).vector()) == len(mode.vector())
    assert scoring.kappas(x, mode.reverse_complement()) == pytest.approx(scoring.kappas(3 - x[:, ::-1], mode))
    rows = spark.createDataFrame([(s,) for s in seqs[::50]], "seq string")
    assert [r["w"] for r in rows.select(scoring.weight_term(F.col("seq"), mode).alias("w")).collect()] == pytest.approx(plain[::50])
    model = Model([Mode(mode.nuc[:4], None, None, {2: mode.far[2][:2], 3: mode.far[3][:1]})], -0.5, 1)
    z, g = partition.model_z(bg, model, None, True)
    assert z == pytest.approx(partition.enumerated(bg, model))
    assert g == pytest.approx(optimize.numeric_gradient(lambda v: partition.model_z(bg, model.with_vector(v)), model.vector()), rel=1e-5, abs=1e-6)
    second = partition.model_z_hessian(bg, model)
    assert second[1] == pytest.approx(g)
    assert second[2] == pytest.approx(optimize.numeric_hessian(lambda v: partition.model_z(bg, model.with_vector(v), None, True)[1], model.vector()), rel=1e-4, abs=1e-5)
    a = scoring.kappas(x[:, :4], model.modes[0])
    assert a == pytest.approx(scoring.kappas(x[:, :4], normal_form(model.modes[0], True)))
    with pytest.raises(ValueError):
        Mode.zeros(4, distances=(4,))


def test_fit_with_far_pairs_and_a_palindrome(planted):
    """Two half sites with pairs two apart: the fit keeps the ties, turns into itself, and no tied step betters it."""
    bg, _, df = planted
    data = objective.Likelihood(df, bg, penalty=1e-4)
    s = fitting.Settings(tolerance=1e-5, symmetry="AB|ba")
    got = fitting.fit(data, Model([Mode.zeros(4, False, 0, (2,))], None, 1), s, seeded=False)
    m = got.model.modes[0]
    tie = fitting.tie_of(got.model, "AB|ba")
    assert m.far[2] == pytest.approx(0, abs=1e-9)  # every pair two apart spans the barrier
    free = fitting.fit(data, Model([Mode.zeros(4, False, 0, (2,))], None, 1), fitting.Settings(tolerance=1e-5, symmetry="ABba"), seeded=False)
    f = free.model.modes[0]
    assert free.value < got.value and np.abs(f.far[2]).max() > 0.01
    assert scoring.kappas(scoring.codes(["ACGT", "TTAG", "CCGA"]), f) == pytest.approx(scoring.kappas(scoring.codes(["ACGT", "CTAA", "TCGG"]), f))
    g = data.value_gradient(got.model)[1]
    assert np.linalg.norm(tie.T @ g) / data.n < 1e-3
    data.release()


def test_coded_weights(spark):
    rng = np.random.default_rng(2)
    seqs = ["".join(rng.choice(list("ACGT"), 9)) for _ in range(50)]
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    for model in (Model([rand_mode(7, True), rand_mode(2, seed=3)], -1.0, 3), Model([rand_mode(9)]), Model([rand_mode(12, True)], None, 2)):
        a = {r["seq"]: r["w"] for r in scoring.probe_weights(df, model, LEFT, RIGHT, length=9).collect()}
        b = {r["seq"]: r["w"] for r in scoring.probe_weights(df, model, LEFT, RIGHT).collect()}
        assert a == pytest.approx(b)
    odd = spark.createDataFrame([("ACGTACGTN",), ("ACGT",), (None,)], "seq string")
    assert [r["w"] for r in scoring.probe_weights(odd, model, LEFT, RIGHT, length=9).collect()] == [None] * 3
    assert "Generate" not in scoring.probe_weights(df, model, LEFT, RIGHT, length=9)._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_features_in_blocks(spark):
    """Sums for pairs of features of a mode of six bases, over two blocks, against plain loops."""
    rng = np.random.default_rng(3)
    mode = Mode(rng.normal(size=(6, 4)) / 3)
    seqs = ["ACGTTGCA", "TTGACCAG", "GGGTACAA"]
    probes = spark.createDataFrame([(s, k + 1) for k, s in enumerate(seqs)], "seq string, cnt int")
    left, right = "ACG", "TGC"
    want = {}
    for n, s in enumerate(seqs):
        turned = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        mers = [t[i : i + 6] for t in (s, turned) for i in range(3)]
        kappa = [np.exp(sum(mode.nuc[j]["ACGT".index(b)] for j, b in enumerate(m))) for m in mers]
        for m, x in zip(mers, kappa):
            for p in range(6):
                for q in range(p, 6):
                    at = (0, p + 1, m[p], q + 1, m[q])
                    want[at] = want.get(at, 0) + (n + 1) * x / (sum(kappa) + np.exp(-1.0))
    got = objective.feature_pairs(probes, background.Background(np.zeros(4), 1, 8, left, right), Model([mode], -1.0))
    assert {tuple(r)[:5]: r["h"] for r in got.collect()} == pytest.approx(want)


def test_search_ends_where_rounding_hides_the_fall():
    """Shares of a pool at which the last step's fall is below rounding: the search of More and Thuente repeated one step for ever."""
    n, x = 165317988.0, np.array([292471427.0, 198754354.0, 260591082.0, 240091065.0])
    for search in ("more_thuente", "wolfe"):
        got = optimize.lbfgs(lambda v: background.likelihood(background.Background(v, 1, 6), x, n), np.zeros(4), n, tolerance=1e-8, most=50, search=search)
        p = np.exp(got.x - got.x.max())
        assert p / p.sum() == pytest.approx(x / x.sum(), abs=1e-8)


def test_steps_from_a_saddle_are_one_scan(planted):
    bg, truth, df = planted
    calls = []

    def saddle(v):
        return v[0] ** 2 - v[1] ** 2 + v[1] ** 4, np.array([2 * v[0], -2 * v[1] + 4 * v[1] ** 3])

    def many(points):
        calls.append(len(points))
        return [saddle(y)[0] for y in points]

    assert saddle(optimize.escape(None, np.zeros(2), np.diag([2.0, -2.0]), many=many))[0] < 0 and len(calls) == 1
    data = objective.Likelihood(df, bg, 1e-4)
    fitting.fit(data, Model([Mode.zeros(2), Mode.zeros(2)]), fitting.Settings(tolerance=1e-3))
    assert data.evaluations <= 100  # 14 values for each halt at a saddle before
    data.release()


def test_few_probes_take_few_tasks(planted):
    bg, truth, df = planted
    data = objective.Likelihood(df.repartition(40), bg)
    assert data.tasks == data.own.rdd.getNumPartitions() == 1
    assert data.value_gradient(truth)[0] == pytest.approx(objective.Likelihood(df, bg, cache=False).value_gradient(truth)[0])
    data.release()


def test_selections_scan_once(spark):
    """Backgrounds and chances of several lengths read their samples once."""
    seen = spark.sparkContext.accumulator(0)
    rows = [("ACGTAC", 4, 3), ("TTGACA", 2, 1), ("GGCATT", 5, 2), ("ACGTTT", 1, 1)]

    def watched(names):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return spark.createDataFrame(rows, "seq string, train long, test long").toDF(*names).mapInArrow(run, ", ".join(f"{c} {'string' if c == 'seq' else 'long'}" for c in names))

    got = background.select_background(watched(["seq", "train", "test"]), [1, 2], 6, LEFT, RIGHT)
    assert seen.value == len(rows) and [k for k, *_ in got] == [1, 2] and got[0][3] == pytest.approx(got[0][2] / 7)
    fits = background.markov_fit(watched(["seq", "cnt", "other"]), watched(["seq", "other", "cnt"]), [2, 3], 6)
    assert seen.value == 3 * len(rows) and all(0 <= r <= 1 for _, r in fits)


def test_coded_weights_leave_the_jvm(spark):
    """Frames are looked up over Arrow batches, not by one expression of all of them."""
    from bindscape.plans.catalog import toy_model as toy

    df = spark.createDataFrame([("ACGTACGTACGTACGT", 1), ("ACG", 2)], "seq string, cnt long")
    got = scoring.with_coded_weight(df, toy(8, True, flank=3), LEFT, RIGHT, 16)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert [r["w"] is None for r in got.orderBy("cnt").collect()] == [False, True] and got.columns == ["seq", "cnt", "w"]


def test_files_of_queries_are_written_by_all_tasks(spark):
    from bindscape.plans import queries_files

    path = queries_files._lines(spark.range(100).repartition(4).selectExpr("cast(id as string)"), spark, "lines")
    assert len(spark.read.text(path).inputFiles()) == 4 and spark.read.text(path).count() == 100
