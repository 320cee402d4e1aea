"""Fits: one model, seeded sweeps over lengths, shifts, flanks and features, modes added one by one.

Fits that don't wait for each other (points of a grid, shifts to both sides, folds) go side by side: each asks for sums at its
own point, and one scan answers all (``together``). A sweep so costs as many scans as its longest fit, not as all fits.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .objective import Ask, Likelihood
from .optimize import Found, NotConverged, error_bars, escape, lbfgs, masked, tied, with_retries
from .params import Mode, Model, mode_tie, normal_form, normalize_modes


@dataclass(frozen=True)
class Settings:
    penalty: float = 1e-6
    tolerance: float = 5e-6
    rounds: int = 2500
    memory: int = 200
    seed: int = 0
    symmetry: str | tuple[str | None, ...] | None = None
    errors: bool = False
    search: str = "wolfe"
    escapes: int = 30


@dataclass
class Fit:
    model: Model
    value: float
    per_read: float
    adjusted: float
    rounds: int
    evaluations: int
    shift: int = 0
    errors: np.ndarray | None = None
    null_vectors: int = 0
    seconds: float = 0.0
    seed: np.ndarray | None = None
    trajectory: list[np.ndarray] = field(default_factory=list)


def feasible(length: int, flank: int, k: int, shape: bool) -> bool:
    """Can windows of k be scored: at least one frame, and at most 32 bases in all (28 with shape)."""
    total = length + 2 * flank
    return k <= total and total + (4 if shape else 0) <= 32


def feasible_rows(length: Column, flank: Column, k: Column, shape: Column) -> Column:
    """feasible for columns."""
    total = length + 2 * flank
    return (k <= total) & (total + F.when(shape, 4).otherwise(0) <= 32)


def tie_of(model: Model, symmetry: str | tuple[str | None, ...] | None) -> np.ndarray | None:
    """(full, free) of a whole model: a symmetry for each mode, or none. One string stands for the only mode."""
    names = (symmetry,) if isinstance(symmetry, str) else symmetry or ()
    if not any(names):
        return None
    if len(names) != len(model.modes):
        raise ValueError("one symmetry for each mode")
    blocks = [mode_tie(m, s) if s else np.eye(len(m.vector())) for s, m in zip(names, model.modes)]
    blocks += [] if model.ns is None else [np.ones((1, 1))]
    out = np.zeros((sum(len(b) for b in blocks), sum(b.shape[1] for b in blocks)))
    i = j = 0
    for b in blocks:
        out[i : i + len(b), j : j + b.shape[1]] = b
        i, j = i + len(b), j + b.shape[1]
    return out


def fit(data: Likelihood, model: Model, settings: Settings = Settings(), seeded: bool = True, active: np.ndarray | None = None, saddles: bool = True) -> Fit:
    """Maximum likelihood from the model given, or from small random starts.

    saddles: where the Hessian of the free parameters has a negative eigenvalue, step along it and fit again with half the
    tolerance of the fit before, until it has none: a fit that stops far from its minimum has saddles at every halt. Left out in cross-validation.
    """
    began = time.time()
    tie = tie_of(model, settings.symmetry)

    def value(v):
        return data.value_gradient(model.with_vector(v))

    # Free parameters: tied ones, the active ones, or all.
    start = model.vector()
    if tie is not None:
        free, whole, narrow = tied(value, tie), lambda y: tie @ y, lambda x: tie.T @ x / tie.sum(axis=0)
        bend = lambda h: tie.T @ h @ tie
    elif active is not None:
        free, narrow, bend = masked(value, start, active), lambda x: x[active], lambda h: h[np.ix_(active, active)]

        def whole(y):
            x = start.copy()
            x[active] = y
            return x

    else:
        free, whole, narrow, bend = value, lambda y: y, lambda x: x, lambda h: h

    def run(x: np.ndarray, share: float = 1.0) -> Found:
        got = lbfgs(free, narrow(x), data.n, settings.memory, settings.tolerance * share, settings.rounds, search=settings.search)
        return replace(got, x=whole(got.x))

    got = run(model.vector()) if seeded else with_retries(run, len(model.vector()), settings.seed)
    def values(points: list[np.ndarray]) -> list[float]:
        return [v for v, _ in data.values_gradients([model.with_vector(whole(y)) for y in points])]

    for k in range(settings.escapes if saddles else 0):
        away = escape(free, narrow(got.x), bend(data.hessian(model.with_vector(got.x))), many=values)
        if away is None:
            break
        again = run(whole(away), 0.5 ** (k + 1))
        got = replace(again, rounds=got.rounds + again.rounds, evaluations=got.evaluations + again.evaluations)
    found = model.with_vector(got.x)
    # A symmetry that leaves features without weights has no say over constants that would move into them.
    if len(found.modes) == 1 and (tie is None or tie.any(axis=1).all()):
        found = replace(found, modes=[normal_form(found.modes[0], found.ns is not None)])
    per_read, adjusted = data.per_read(got.value)
    out = Fit(found, got.value, per_read, adjusted, got.rounds, got.evaluations, seconds=time.time() - began, seed=model.vector() if seeded else None)
    if settings.errors:
        out.errors, out.null_vectors = error_bars(data.hessian(found), data.penalty, tie)
    return out


def best(fits: list[Fit]) -> Fit:
    found = [f for f in fits if f is not None]
    if not found:
        raise NotConverged("no fit succeeded")
    return min(found, key=lambda f: f.value)


class _Table:
    """Where fits side by side leave what they ask for. The last to ask has the scan run for all."""

    def __init__(self, data: Likelihood, n: int):
        self.data, self.live, self.met = data, n, threading.Condition()
        self.asked: dict[int, list[Ask]] = {}
        self.found: dict[int, list | Exception] = {}

    def _run(self) -> None:
        order = sorted(self.asked)
        try:
            got = self.data.answer([a for k in order for a in self.asked[k]])
            for k in order:
                n = len(self.asked[k])
                self.found[k], got = got[:n], got[n:]
        except Exception as e:
            self.found |= dict.fromkeys(order, e)
        self.asked.clear()
        self.met.notify_all()

    def ask(self, k: int, asks: list[Ask]) -> list:
        with self.met:
            self.asked[k] = asks
            if len(self.asked) == self.live:
                self._run()
            self.met.wait_for(lambda: k in self.found)
            got = self.found.pop(k)
        if isinstance(got, Exception):
            raise got
        return got

    def leave(self) -> None:
        with self.met:
            self.live -= 1
            if self.asked and len(self.asked) == self.live:
                self._run()


def together(data: Likelihood, jobs: list[Callable[[Likelihood], object]], columns: list[int] | None = None) -> list:
    """Results of jobs that each fit on a view of data; what they ask for in the same round is answered by one scan.

    columns: the count of each job. A job that fails raises here, after all have ended.
    """
    table, out = _Table(data, len(jobs)), [None] * len(jobs)
    views = [data.column(c) for c in columns or [data.at] * len(jobs)]

    def run(k: int) -> None:
        views[k].answer = lambda asks: table.ask(k, asks)
        try:
            out[k] = jobs[k](views[k])
        except Exception as e:
            out[k] = e
        finally:
            table.leave()

    threads = [threading.Thread(target=run, args=(k,), daemon=True) for k in range(len(jobs))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for x in out:
        if isinstance(x, Exception):
            raise x
    return out


def shift_fits(data: Likelihood, start: Fit, shifts: int, settings: Settings = Settings()) -> list[Fit]:
    """The fit, and fits from its motif moved by up to `shifts` positions each way, each from its neighbour."""
    def walk(sign: int):
        def job(view: Likelihood) -> list[Fit]:
            at, found = start, []
            for k in range(1, shifts + 1):
                moved = replace(at.model, modes=[m.shifted(sign) for m in at.model.modes])
                at = replace(fit(view, moved, settings), shift=sign * k)
                found.append(at)
            return found

        return job

    return [start, *(f for found in together(data, [walk(1), walk(-1)]) for f in found)]


def grid(length: int, ks: list[int], flanks: list[int], ns: list[bool], shape: bool = False) -> list[tuple[int, int, bool]]:
    """The feasible points (k, flank, with non-specific binding) of a sweep, in its order."""
    return [(k, f, n) for k, f, n in product(ks, flanks, ns) if feasible(length, f, k, shape)]


def length_sweep(data: Likelihood, ks: list[int], flanks: list[int], ns: list[bool], di: bool = False, features: int = 0, shifts: int = 0, settings: Settings = Settings()) -> list[Fit]:
    """Single-mode fits over a grid: nucleotides first, then with dinucleotides or shape from that seed. Infeasible points are left out."""

    def point(k: int, flank: int, with_ns: bool):
        def job(view: Likelihood) -> Fit:
            first = fit(view, Model([Mode.zeros(k)], 0.0 if with_ns else None, flank), settings, seeded=False)
            found = [first]
            for sign in (1, -1):
                at = first
                for n in range(1, shifts + 1):
                    at = replace(fit(view, replace(at.model, modes=[m.shifted(sign) for m in at.model.modes]), settings), shift=sign * n)
                    found.append(at)
            top = best(found)
            if di or features:
                top = fit(view, replace(top.model, modes=[top.model.modes[0].with_features(di, features)]), settings)
            return top

        return job

    return together(data, [point(*p) for p in grid(data.background.length, ks, flanks, ns, bool(features))])


def add_mode(data: Likelihood, at: Fit, k: int, settings: Settings = Settings()) -> Fit:
    """One more mode: first it alone, the others frozen, then all together."""
    rng = np.random.default_rng(settings.seed)
    seed = Mode.zeros(k).with_vector(0.05 * rng.random(4 * k) - 2.0 / k)
    grown = replace(at.model, modes=[*at.model.modes, seed])
    before = sum(len(m.vector()) for m in at.model.modes)
    active = np.zeros(len(grown.vector()), bool)
    active[before : before + 4 * k] = True
    alone = fit(data, grown, settings, active=active)
    return fit(data, alone.model, settings)


def mode_regression(data: Likelihood, at: Model, settings: Settings = Settings()) -> Fit:
    """Only the modes' relative affinities (and non-specific binding) move; the penalty is left out."""
    free = replace_penalty(data, 0.0)
    sizes = [len(m.vector()) for m in at.modes]
    basis = np.zeros((sum(sizes) + (at.ns is not None), len(sizes) + (at.ns is not None)))
    row = 0
    for i, m in enumerate(at.modes):
        basis[row : row + 4 * m.k, i] = 1 / m.k
        row += sizes[i]
    if at.ns is not None:
        basis[-1, -1] = 1
    start = at.vector()

    def value(v):
        f, g = free.value_gradient(at.with_vector(start + basis @ v))
        return f, basis.T @ g

    got = lbfgs(value, np.zeros(basis.shape[1]), data.n, settings.memory, settings.tolerance, settings.rounds)
    model = at.with_vector(start + basis @ got.x)
    per_read, adjusted = data.per_read(got.value)
    return Fit(model, got.value, per_read, adjusted, got.rounds, got.evaluations)


def seeded_fit(data: Likelihood, seeds: list[Mode], ns: bool = False, flank: int = 0, settings: Settings = Settings()) -> Fit | None:
    """Several modes from given motifs: first their relative affinities alone, then everything, then normalised modes. None where it is not feasible."""
    k, shape = max(m.k for m in seeds), any(m.shape is not None for m in seeds)
    if not feasible(data.background.length, flank, k, shape):
        return None
    start = Model(list(seeds), 0.0 if ns else None, flank)
    if len(seeds) > 1 or ns:
        start = mode_regression(data, start, settings).model
    got = fit(data, start, settings)
    return replace(got, model=normalize_modes(got.model)) if all(m.di is None and m.shape is None for m in seeds) else got


def replace_penalty(data: Likelihood, penalty: float) -> Likelihood:
    out = object.__new__(Likelihood)
    out.__dict__ |= data.__dict__ | {"share": penalty, "penalty": penalty * data.n}
    return out


def grow(data: Likelihood, at: Fit, most: int, settings: Settings = Settings()) -> list[Fit]:
    """Two positions more and one flank base more at a time, while that is feasible."""
    out = [at]
    while True:
        modes = [m.grown() for m in out[-1].model.modes]
        flank = out[-1].model.flank + 1
        shape = any(m.shape is not None for m in modes)
        room = min(len(data.background.left), len(data.background.right)) - (2 if shape else 0)
        if max(m.k for m in modes) > most or flank > room or not feasible(data.background.length, flank, max(m.k for m in modes), shape):
            return out
        out.append(fit(data, replace(out[-1].model, modes=modes, flank=flank), settings))


def cross_validate(data: Likelihood, folds: list[tuple[int, int]], start: Fit, settings: Settings = Settings()) -> list[float]:
    """The test likelihood per read of each fold, after a refit of the full fit on its train part. folds: the columns (train, test) of data.

    Folds are counts of one table, so their refits go side by side, and the tests are one scan.
    """
    again = together(data, [lambda view: fit(view, start.model, settings, saddles=False)] * len(folds), [train for train, _ in folds])
    tests = [test for _, test in folds]
    held = replace_penalty(data, 0.0).values_gradients([f.model for f in again], tests)
    return [v / data.totals[k][0] for (v, _), k in zip(held, tests, strict=True)]


def done_already(spark: SparkSession, path: str, force: bool = False) -> bool:
    """Skip a step whose result is there, in any store that Spark can open, unless told otherwise."""
    from bindscape.sources.models import exists

    return not force and exists(spark, path)
