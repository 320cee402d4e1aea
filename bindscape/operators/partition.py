"""Partition functions: sums over all 4^l probes by a transfer matrix, with derivatives by messages in both directions.

One routine for every feature set. A probe's weight is that of its background k-mers times the affinity of one
frame on one strand; Z sums over probes, frames and strands. The reverse strand is the reverse-complemented mode on
forward coordinates. Frames are one axis of the arrays, the last m bases the other, where m covers the background
k-mer, the base before (dinucleotides) and a 5-mer (shape).
"""

from __future__ import annotations

from itertools import product

import numpy as np

from .background import Background, context
from .params import BASES, Mode, Model


class Walk:
    """The positions that a frame can see, with what each step weighs."""

    def __init__(self, background: Background, flank: int, mode: Mode, shape: np.ndarray | None):
        self.mode, self.shape, self.bg, self.flank = mode, shape, background, flank
        self.margin = 2 if mode.shape is not None else 0
        self.m = max(background.k - 1, 1 if mode.di is not None else 0, 4 if self.margin else 0, *mode.far, 1)
        left, right, l = background.left, background.right, background.length
        tail = max(self.margin, background.k - 1 - flank, 0)
        if len(left) < flank + self.margin or len(right) < flank + self.margin:
            raise ValueError("the flanks are shorter than the scored flank" + (" and the context that shape needs" if self.margin else ""))
        self.first = -flank  # position of the first scored base; 0 is the first variable one
        start = left[: len(left) - flank] if flank else left
        start = ("A" * self.m + start)[-self.m :] if self.m else ""
        self.start = 0
        for c in start:
            self.start = 4 * self.start + BASES.index(c)
        self.choices = [[BASES.index(c)] for c in (left[len(left) - flank :] if flank else "")] + [[0, 1, 2, 3]] * l + [[BASES.index(c)] for c in right[: flank + tail]]
        self.count = l + 2 * flank - mode.k + 1
        self.states = 4**self.m

    def bg_weight(self, p: int) -> np.ndarray:
        """(states, 4): background weight of the k-mer that ends at variable position p."""
        k, n = self.bg.k, 4 ** (self.bg.k - 1)
        last = self.bg.length + k - 2 if self.bg.flanked else self.bg.length - 1
        first = 0 if self.bg.flanked else k - 1
        if not first <= p <= last:
            return np.ones((self.states, 4))
        return np.exp(self.bg.beta).reshape(n, 4)[np.arange(self.states) % n]

    def _back(self, d: int) -> np.ndarray:
        """The base d places before the next one, by state."""
        return np.arange(self.states) >> 2 * (d - 1) & 3

    def frame_weight(self, p: int) -> np.ndarray:
        """(frames, states, 4): log affinity added by the base at position p."""
        out, mode = np.zeros((self.count, self.states, 4)), self.mode
        for s in range(self.count):
            j = p - self.first - s
            if 0 <= j < mode.k:
                out[s] += mode.nuc[j][None, :]
                if mode.di is not None and j >= 1:
                    out[s] += mode.di[j - 1].reshape(4, 4)[np.arange(self.states) % 4]
            for d, pairs in mode.far.items():
                if d <= j < mode.k:
                    out[s] += pairs[j - d].reshape(4, 4)[self._back(d)]
            j -= 2
            if self.margin and 0 <= j < mode.k:
                out[s] += (self.shape @ mode.shape[j]).reshape(256, 4)[np.arange(self.states) % 256]
        return out

    def sums(self, gradient: bool = False):
        """Z of this strand, and its gradient in the mode's vector."""
        into = (4 * np.arange(self.states)[:, None] + np.arange(4)[None, :]) % self.states
        state = np.zeros((self.count, self.states))
        state[:, self.start] = 1
        steps, forward = [], [state]
        for at, bases in enumerate(self.choices):
            p = at + self.first
            w = self.bg_weight(p)[None] * np.exp(self.frame_weight(p))
            new = np.zeros_like(state)
            for c in bases:
                flow = forward[-1] * w[:, :, c]
                np.add.at(new.T, into[:, c], flow.T)
            steps.append((p, bases, w))
            forward.append(new)
        z = float(forward[-1].sum())
        if not gradient:
            return z, None
        mode = self.mode
        g = mode.blank()
        back = np.ones((self.count, self.states))
        low, five = np.arange(self.states) % 4, np.arange(self.states) % 256
        for (p, bases, w), before in zip(reversed(steps), reversed(forward[:-1])):
            new = np.zeros_like(back)
            for c in bases:
                flow = w[:, :, c] * back[:, into[:, c]]
                new += flow
                mass = before * flow
                for s in range(self.count):
                    j = p - self.first - s
                    if 0 <= j < mode.k:
                        g.nuc[j, c] += mass[s].sum()
                        if mode.di is not None and j >= 1:
                            np.add.at(g.di[j - 1], 4 * low + c, mass[s])
                        for d in mode.far:
                            if j >= d:
                                np.add.at(g.far[d][j - d], 4 * self._back(d) + c, mass[s])
                    if self.margin and 0 <= j - 2 < mode.k:
                        g.shape[j - 2] += mass[s] @ self.shape[4 * five + c]
            back = new
        return z, g

    def second(self):
        """(Z of this strand, gradient, Hessian) in the mode's vector, one pass for each frame.

        Besides the forward message a pass carries its derivative by every feature met so far. A step's mass, pulled back from the
        end, meets that derivative in the features which the step adds: one product for each pair of features.
        """
        mode, n = self.mode, self.states
        k, size = mode.k, len(mode.vector())
        n_shape = 0 if mode.shape is None else mode.shape.shape[1]
        di_at, shape_at = 4 * k, 4 * k + (0 if mode.di is None else 16 * (k - 1))
        low, five = np.arange(n) % 4, np.arange(n) % 256
        far_at, end = {}, shape_at + k * n_shape
        for d in sorted(mode.far):
            far_at[d], end = end, end + 16 * (k - d)
        z, g, h = 0.0, np.zeros(size), np.zeros((size, size))
        log_frames = {p: self.frame_weight(p) for p in range(self.first, self.first + len(self.choices))}

        def added(p: int, s: int, c: int) -> tuple[list[int], np.ndarray]:
            """Features that base c at p adds to frame s, and how much of each by state."""
            at, amount, j = [], [], p - self.first - s
            if 0 <= j < k:
                at.append(4 * j + c)
                amount.append(np.ones(n))
                if mode.di is not None and j >= 1:
                    at += [di_at + 16 * (j - 1) + 4 * b + c for b in range(4)]
                    amount += [(low == b).astype(float) for b in range(4)]
                for d, first in far_at.items():
                    if j >= d:
                        at += [first + 16 * (j - d) + 4 * b + c for b in range(4)]
                        amount += [(self._back(d) == b).astype(float) for b in range(4)]
            if n_shape and 0 <= j - 2 < k:
                at += [shape_at + (j - 2) * n_shape + f for f in range(n_shape)]
                amount += list(self.shape[4 * five + c].T)
            return at, np.array(amount).T

        # A step leads from (top base, rest) to (rest, c).
        move = lambda x: x.reshape(4, n // 4, *x.shape[1:]).sum(axis=0)
        for s in range(self.count):
            weights = [self.bg_weight(p) * np.exp(log_frames[p][s]) for p in range(self.first, self.first + len(self.choices))]
            back = [np.ones(n)]
            for bases, w in zip(reversed(self.choices), reversed(weights)):
                back.append(sum(w[:, c] * np.tile(back[-1][c::4], 4) for c in bases))
            back.reverse()
            state, slope = np.zeros(n), np.zeros((n, size))
            state[self.start] = 1
            for at, (bases, w) in enumerate(zip(self.choices, weights)):
                new, new_slope = np.zeros(n), np.zeros((n, size))
                for c in bases:
                    flow = w[:, c] * np.tile(back[at + 1][c::4], 4)
                    where, amount = added(at + self.first, s, c)
                    step = slope * w[:, c : c + 1]
                    if where:
                        mass = amount * flow[:, None]
                        g[where] += state @ mass
                        cross = slope.T @ mass
                        h[:, where] += cross
                        h[where, :] += cross.T
                        h[np.ix_(where, where)] += amount.T @ (mass * state[:, None])
                        step[:, where] += amount * (state * w[:, c])[:, None]
                    new[c::4] = move(state * w[:, c])
                    new_slope[c::4] = move(step)
                state, slope = new, new_slope
            z += float(state.sum())
        return z, g, h


def partition(background: Background, flank: int, mode: Mode, shape: np.ndarray | None = None, gradient: bool = False):
    """Sum over all probes of background weight times the affinities of both strands; with gradient, also its gradient."""
    plus, minus = Walk(background, flank, mode, shape), Walk(background, flank, mode.reverse_complement(), _turned(shape))
    a, ga = plus.sums(gradient)
    b, gb = minus.sums(gradient)
    if not gradient:
        return a + b
    return a + b, ga.vector() + gb.reverse_complement().vector()


def partition_hessian(background: Background, flank: int, mode: Mode, shape: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(Z, gradient, Hessian) of both strands, exact, by the mode's vector."""
    z, g, h = Walk(background, flank, mode, shape).second()
    z2, g2, h2 = Walk(background, flank, mode.reverse_complement(), _turned(shape)).second()
    # Place i of the turned mode's vector holds what stands at place turned[i] of the mode's own, and the other way round.
    turned = mode.with_vector(np.arange(len(g))).reverse_complement().vector().astype(int)
    return z + z2, g + g2[turned], h + h2[np.ix_(turned, turned)]


def _turned(shape: np.ndarray | None) -> np.ndarray | None:
    """Shape values by the reverse complement of the 5-mer."""
    if shape is None:
        return None
    order = [sum((3 - (x >> 2 * i & 3)) << 2 * (4 - i) for i in range(5)) for x in range(1024)]
    return shape[order]


def model_z(background: Background, model: Model, shape: np.ndarray | None = None, gradient: bool = False):
    """Z = sum over modes of Z_mode / Z_background + e^ns, and its gradient in the model's vector."""
    z0 = background.z()
    if not gradient:
        return sum(partition(background, model.flank, m, shape) for m in model.modes) / z0 + (0.0 if model.ns is None else float(np.exp(model.ns)))
    total, parts = 0.0, []
    for m in model.modes:
        z, g = partition(background, model.flank, m, shape, True)
        total += z / z0
        parts.append(g / z0)
    if model.ns is not None:
        total += float(np.exp(model.ns))
        parts.append(np.array([np.exp(model.ns)]))
    return total, np.concatenate(parts)


def model_z_hessian(background: Background, model: Model, shape: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Z of a model, its gradient and its Hessian. Modes add up, so features of two modes have no second derivative."""
    z0, size = background.z(), len(model.vector())
    z, g, h, at = 0.0, np.zeros(size), np.zeros((size, size)), 0
    for m in model.modes:
        a, b, c = partition_hessian(background, model.flank, m, shape)
        n = len(b)
        z, g[at : at + n], h[at : at + n, at : at + n] = z + a / z0, b / z0, c / z0
        at += n
    if model.ns is not None:
        z += float(np.exp(model.ns))
        g[-1] = h[-1, -1] = np.exp(model.ns)
    return z, g, h


def enumerated(background: Background, model: Model, shape: np.ndarray | None = None) -> float:
    """model_z by listing all probes."""
    from .scoring import codes, kappas

    seqs = ["".join(v) for v in product(BASES, repeat=background.length)]
    x = codes(seqs)
    p = np.exp(background.log_probabilities(x))
    w = probe_sums(x, background, model, shape)
    return float(p @ w)


def probe_sums(x: np.ndarray, background: Background, model: Model, shape: np.ndarray | None = None) -> np.ndarray:
    """W of coded variable regions."""
    from .scoring import kappas

    out = np.full(len(x), 0.0 if model.ns is None else np.exp(model.ns))
    for m in model.modes:
        full = padded(x, background.left, background.right, model.flank + (2 if m.shape is not None else 0))
        out += kappas(full, m, shape).sum(axis=1) + kappas(3 - full[:, ::-1], m, shape).sum(axis=1)
    return out


def padded(x: np.ndarray, left: str, right: str, n: int) -> np.ndarray:
    from .scoring import codes

    if not n:
        return x
    a, b = codes([left[-n:]]), codes([right[:n]])
    return np.concatenate([np.repeat(a, len(x), 0), x, np.repeat(b, len(x), 0)], axis=1)
