"""Optimisers of parameter-sized problems. They run on the driver; a value may cost a Spark job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


class NotConverged(ArithmeticError):
    pass


#: Share of a value within which differences are rounding.
_ROUNDING = 1e-14


@dataclass
class Found:
    x: np.ndarray
    value: float
    gradient: np.ndarray
    rounds: int
    evaluations: int
    trajectory: list[np.ndarray] = field(default_factory=list)


def _cubic(a, fa, ga, b, fb, gb):
    """Least point of the cubic through two points with slopes, inside them; the middle where there is none."""
    if a == b:
        return a
    d1 = ga + gb - 3 * (fa - fb) / (a - b)
    root = d1 * d1 - ga * gb
    if root < 0:
        return (a + b) / 2
    d2 = np.sign(b - a) * np.sqrt(root)
    bottom = gb - ga + 2 * d2
    x = b - (b - a) * (gb + d2 - d1) / bottom if bottom else (a + b) / 2
    low, high = min(a, b), max(a, b)
    return x if low + 0.05 * (high - low) <= x <= high - 0.05 * (high - low) else (a + b) / 2


def wolfe(phi: Callable[[float], tuple[float, float, np.ndarray, float]], f0: float, g0: float, first: float = 1.0, c1: float = 1e-4, c2: float = 0.9, most: int = 20):
    """A step that satisfies the strong Wolfe conditions: bracket by factors of up to 10, then zoom by cubics.

    phi(t) gives (value, slope, gradient, value at x + t d). If rounding stops the search, the best step so far that
    lowered the value is taken.
    """
    before, fb, gb = 0.0, f0, g0
    t, best, bracket = first, None, None
    for _ in range(most):
        f, slope, *rest = phi(t)
        good = np.isfinite(f) and f <= f0 + c1 * t * g0 + _ROUNDING * abs(f0)
        if good and (best is None or f < best[1]):
            best = (t, f, *rest)
        if good and abs(slope) <= -c2 * g0:
            return best if best[0] == t else (t, f, *rest)
        if bracket is None:
            if not good or (before and f >= fb):
                bracket = [(before, fb, gb), (t, f, slope)]
            elif slope >= 0:
                bracket = [(t, f, slope), (before, fb, gb)]
            else:
                before, fb, gb = t, f, slope
                t *= 4
                continue
        else:
            low, high = bracket
            if not good or f >= low[1]:
                bracket = [low, (t, f, slope)]
            else:
                bracket = [(t, f, slope), low if slope * (high[0] - low[0]) >= 0 else high]
        (a, fa, ga), (b, fb_, gb_) = bracket
        t = _cubic(a, fa, ga, b, fb_, gb_) if np.isfinite(fb_) else (a + b) / 2
        if abs(a - b) <= 1e-14 * max(1.0, abs(a)):
            break
    return best


def more_thuente(phi: Callable[[float], tuple[float, float, np.ndarray, float]], f0: float, g0: float, first: float = 1.0, c1: float = 1e-4, c2: float = 0.99, most: int = 20, least: float = 1e-20, largest: float = 1e20):
    """A step by the search of More and Thuente (1994): sufficient decrease and curvature from a shrinking interval.

    Until a step lies below the line of sufficient decrease with a rising slope, the interval is kept for the function
    less that line. phi as for wolfe; if rounding or the number of values stops the search, the best step that lowered the value is taken.
    """
    low, high, bracketed, modified = (0.0, f0, g0), (0.0, f0, g0), False, True
    t, best, width, before = min(max(first, least), largest), None, largest - least, 2 * (largest - least)
    for _ in range(most):
        lower, upper = (min(low[0], high[0]), max(low[0], high[0])) if bracketed else (low[0], t + 4 * (t - low[0]))
        t = min(max(t, least), largest)
        f, slope, *rest = phi(t)
        line = f0 + c1 * t * g0 + _ROUNDING * abs(f0)
        if not np.isfinite(f):
            bracketed, high, t = True, (t, np.inf, np.inf), (low[0] + t) / 2
            continue
        if f <= line and (best is None or f < best[1]):
            best = (t, f, *rest)
        if f <= line and abs(slope) <= -c2 * g0:
            return (t, f, *rest)
        if bracketed and upper - lower <= 1e-14 * upper:
            return best
        modified = modified and not (f <= line and slope >= min(c1, c2) * g0)
        tilt = c1 * g0 if modified and f > line and f <= low[1] else 0.0
        flat = lambda p: (p[0], p[1] - p[0] * tilt, p[2] - tilt)
        low, high, at = flat(low), flat(high), (t, f - t * tilt, slope - tilt)
        t, bracketed, swap = _trial(low, high, at, bracketed, lower, upper)
        if at[1] > low[1]:
            high = at
        else:
            high, low = (low if swap else high), at
        back = lambda p: (p[0], p[1] + p[0] * tilt, p[2] + tilt)
        low, high = back(low), back(high)
        if bracketed:
            if abs(high[0] - low[0]) >= 0.66 * before:
                t = (low[0] + high[0]) / 2
            before, width = width, abs(high[0] - low[0])
    return best


def _trial(low, high, at, bracketed: bool, lower: float, upper: float) -> tuple[float, bool, bool]:
    """(next step, is the minimum now bracketed, do the slopes at the best step and at the last one differ in sign)."""
    (a, fa, ga), (t, f, g) = low, at

    def cubic(p, q):
        """Where the cubic through two points with their slopes has its minimum, None if nowhere."""
        (x, fx, gx), (y, fy, gy) = p, q
        if x == y or not np.isfinite(fx + fy):
            return None
        d = gx + gy - 3 * (fx - fy) / (x - y)
        root = d * d - gx * gy
        if root < 0:
            return None
        e = np.sign(y - x) * np.sqrt(root)
        bottom = gy - gx + 2 * e
        return y - (y - x) * (gy + e - d) / bottom if bottom else None

    secant = t - g * (t - a) / (g - ga) if g != ga else upper
    c = cubic(low, at)
    if f > fa:  # higher: the minimum lies between
        square = a + ga / ((fa - f) / (t - a) + ga) / 2 * (t - a)
        c = square if c is None else c
        return (c if abs(c - a) < abs(square - a) else (c + square) / 2), True, False
    if g * ga < 0:  # lower, and the slope has turned
        c = secant if c is None else c
        return (c if abs(c - t) >= abs(secant - t) else secant), True, True
    if abs(g) <= abs(ga):  # lower and flatter
        if c is None or (c - t) * (t - a) <= 0:
            c = upper if t > a else lower
        step = min((c, secant), key=lambda x: abs(x - t)) if bracketed else max((c, secant), key=lambda x: abs(x - t))
        if bracketed:
            bound = t + 0.66 * (high[0] - t)
            return (min(step, bound) if t > a else max(step, bound)), True, False
        return min(max(step, lower), upper), False, False
    if bracketed:  # lower and steeper
        c = cubic(at, high)
        return ((t + high[0]) / 2 if c is None else c), True, False
    return (upper if t > a else lower), False, False


SEARCHES = {"wolfe": wolfe, "more_thuente": more_thuente}


def lbfgs(f: Objective, x0: np.ndarray, scale: float = 1.0, memory: int = 200, tolerance: float = 5e-6, most: int = 2500, keep: bool = False, search: str = "wolfe") -> Found:
    """Two-loop L-BFGS on f / scale; stops at |g| <= tolerance * max(1, |x|). search: a name of SEARCHES."""
    evaluations = 0

    def at(x):
        nonlocal evaluations
        evaluations += 1
        v, g = f(x)
        return v / scale, g / scale

    x = np.array(x0, float)
    v, g = at(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    trail = [x.copy()] if keep else []
    for k in range(most):
        if np.linalg.norm(g) <= tolerance * max(1.0, np.linalg.norm(x)):
            return Found(x, v * scale, g * scale, k, evaluations, trail)
        q, alphas = g.copy(), []
        for s, y, rho in reversed(pairs):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(pairs, reversed(alphas)):
            q += (a - rho * (y @ q)) * s
        d = -q
        slope = g @ d
        if slope >= 0:
            d, slope, pairs = -g, -(g @ g), []

        def phi(t, d=d):
            vv, gg = at(x + t * d)
            return vv, float(gg @ d), gg

        first = 1.0 if pairs else min(1.0, 1.0 / np.linalg.norm(g))
        got = SEARCHES[search](phi, v, slope, first)
        if got is not None and got[1] >= v - _ROUNDING * abs(v) and np.linalg.norm(got[2]) >= np.linalg.norm(g):
            got = None  # neither a lower value nor a flatter place: the same step would come again
        if got is None:
            if pairs:
                pairs = []
                continue
            if np.linalg.norm(g) <= 1e3 * tolerance * max(1.0, np.linalg.norm(x)):
                return Found(x, v * scale, g * scale, k, evaluations, trail)  # rounding allows no lower value
            raise NotConverged("no step lowers the value")
        t, v2, g2 = got[0], got[1], got[2]
        s, y = t * d, g2 - g
        if s @ y > 1e-14 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs = [*pairs, (s, y, 1 / (s @ y))][-memory:]
        x, v, g = x + s, v2, g2
        if keep:
            trail.append(x.copy())
    raise NotConverged(f"{most} rounds were not enough")


def pattern_search(f: Callable[[np.ndarray], float], x0: np.ndarray, step: float = 0.5, shrink: float = 0.5, least: float = 1e-6, directions: np.ndarray | None = None, seed: int | None = None, most: int = 100_000) -> Found:
    """Tries both ways along each direction; shrinks the step when none helps. seed: random order of directions."""
    rng = np.random.default_rng(seed) if seed is not None else None
    x, axes, n = np.array(x0, float), np.eye(len(x0)) if directions is None else directions, 1
    v, k = f(x), 0
    while step >= least and k < most:
        k += 1
        order, moved = (rng.permutation(len(axes)) if rng is not None else range(len(axes))), False
        for i in order:
            for sign in (1, -1):
                y = x + sign * step * axes[i]
                w = f(y)
                n += 1
                if v - w > 5e-16 * abs(v):
                    x, v, moved = y, w, True
                    break
        if not moved:
            step *= shrink
    return Found(x, v, np.zeros_like(x), k, n)


def orthogonal_directions(blocks: list[int], ns: bool = False) -> np.ndarray:
    """Directions that raise one parameter of a block and lower all of the block by 1 / size."""
    size = sum(blocks) + ns
    out, at = [], 0
    for b in blocks:
        for i in range(b):
            v = np.zeros(size)
            v[at : at + b] = -1 / b
            v[at + i] += 1
            out.append(v)
        at += b
    if ns:
        out.append(np.eye(size)[-1])
    return np.array(out)


def masked(f: Objective, x: np.ndarray, active: np.ndarray) -> Objective:
    """f of the active parameters, the others kept at x."""

    def g(v):
        full = x.copy()
        full[active] = v
        value, gradient = f(full)
        return value, gradient[active]

    return g


def tied(f: Objective, tie: np.ndarray) -> Objective:
    """f of the free parameters of a symmetry."""

    def g(v):
        value, gradient = f(tie @ v)
        return value, tie.T @ gradient

    return g


def with_retries(run: Callable[[np.ndarray], Found], size: int, seed: int = 0, scale: float = 0.05, tries: int = 6) -> Found:
    """Random starts, each try ten times nearer to 0, until one does not fail."""
    rng, last = np.random.default_rng(seed), None
    for k in range(tries):
        try:
            return run(scale * 0.1**k * rng.random(size))
        except ArithmeticError as e:
            last = e
    raise NotConverged(f"{tries} starts failed") from last


def escape(f: Objective, x: np.ndarray, hessian: np.ndarray, limit: float = -1e-8, many: Callable[[list[np.ndarray]], list[float]] | None = None) -> np.ndarray | None:
    """From a saddle: the best of some steps along the most negative direction, or None at a minimum.

    many: values of several points at once, where they cost less than one after the other.
    limit: of the share of the largest eigenvalue; nearer to 0 lies the error of Hessians whose part of Z is a difference.
    """
    values, vectors = np.linalg.eigh(hessian)
    if values[0] / max(abs(values).max(), 1e-300) >= limit:
        return None
    steps = [s * 10.0**-k for s in (1, -1) for k in range(-1, 6)]
    start, *values = (many or (lambda points: [f(y)[0] for y in points]))([x, *(x + t * vectors[:, 0] for t in steps)])
    value, t = min(zip(values, steps))
    return x + t * vectors[:, 0] if value < start - 1e-13 * abs(start) else None


def numeric_gradient(f: Callable[[np.ndarray], float], x: np.ndarray, step: float = 1e-6) -> np.ndarray:
    e = np.eye(len(x)) * step
    return np.array([(f(x + d) - f(x - d)) / (2 * step) for d in e])


def numeric_hessian(g: Callable[[np.ndarray], np.ndarray], x: np.ndarray, step: float = 1e-5) -> np.ndarray:
    e = np.eye(len(x)) * step
    h = np.array([(g(x + d) - g(x - d)) / (2 * step) for d in e])
    return (h + h.T) / 2


def error_bars(hessian: np.ndarray, penalty: float = 0.0, tie: np.ndarray | None = None, tolerance: float = 1e-7, tries: int = 8) -> tuple[np.ndarray, int]:
    """(standard error of each parameter, null directions): square roots of the diagonal of the pseudo-inverse."""
    h = hessian if tie is None else tie.T @ hessian @ tie
    values, vectors = np.linalg.eigh((h + h.T) / 2)
    own = values - 2 * penalty
    for _ in range(tries):
        live = np.abs(own) / np.abs(own).max() >= tolerance
        diagonal = (vectors[:, live] ** 2 / values[live]).sum(axis=1)
        if (diagonal >= 0).all():
            errors = np.sqrt(diagonal)
            return (errors if tie is None else tie @ errors), int((~live).sum())
        tolerance *= 10
    raise NotConverged("the Hessian is not positive on its live directions")
