"""Parameters of binding models: one mode's weights, their vector layout, symmetry and gauge. NumPy; parameter-sized."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

BASES = "ACGT"
PAIRS = [a + b for a in BASES for b in BASES]
#: Shape classes in the order in which their columns are joined, with their number of columns. Fixed values.
SHAPE_COLUMNS = {"MGW": 1, "ProT": 1, "HelT": 2, "Roll": 2}


@dataclass(frozen=True)
class Mode:
    """Weights of one binding mode of k positions. nuc: (k, 4); di: (k - 1, 16) or None; shape: (k, features) or None.

    far: weights (k - d, 16) of pairs of bases d places apart, by d from 2 on.
    """

    nuc: np.ndarray
    di: np.ndarray | None = None
    shape: np.ndarray | None = None
    far: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def k(self) -> int:
        return len(self.nuc)

    @staticmethod
    def zeros(k: int, di: bool = False, features: int = 0, distances: tuple[int, ...] = ()) -> Mode:
        if any(not 2 <= d < k for d in distances):
            raise ValueError("distances of pairs are 2 to k - 1; neighbours are dinucleotides")
        return Mode(np.zeros((k, 4)), np.zeros((k - 1, 16)) if di else None, np.zeros((k, features)) if features else None, {d: np.zeros((k - d, 16)) for d in sorted(distances)})

    def blank(self) -> Mode:
        """Zeros in the layout of this mode."""
        return self.with_vector(np.zeros(len(self.vector())))

    def vector(self) -> np.ndarray:
        return np.concatenate([*(x.ravel() for x in (self.nuc, self.di, self.shape) if x is not None), *(self.far[d].ravel() for d in sorted(self.far))])

    def with_vector(self, v: np.ndarray) -> Mode:
        at, out = 0, {}
        for name in ("nuc", "di", "shape"):
            x = getattr(self, name)
            if x is not None:
                out[name] = np.asarray(v[at : at + x.size], float).reshape(x.shape)
                at += x.size
        far = {}
        for d in sorted(self.far):
            x = self.far[d]
            far[d] = np.asarray(v[at : at + x.size], float).reshape(x.shape)
            at += x.size
        return replace(self, **out, far=far)

    def reverse_complement(self) -> Mode:
        """The mode that scores a window as this one scores its reverse complement. Whole positions turn round, shape included."""
        flip = [PAIRS.index(BASES[3 - BASES.index(p[1])] + BASES[3 - BASES.index(p[0])]) for p in PAIRS]
        return Mode(self.nuc[::-1, ::-1].copy(), None if self.di is None else self.di[::-1][:, flip].copy(), None if self.shape is None else self.shape[::-1].copy(), {d: x[::-1][:, flip].copy() for d, x in self.far.items()})

    def shifted(self, by: int) -> Mode:
        """Moved by `by` positions to the right (left if negative); zeros come in."""

        def move(x):
            if x is None or not by:
                return x
            out = np.zeros_like(x)
            if abs(by) < len(x):
                if by > 0:
                    out[by:] = x[:-by]
                else:
                    out[:by] = x[-by:]
            return out

        return Mode(move(self.nuc), move(self.di), move(self.shape), {d: move(x) for d, x in self.far.items()})

    def grown(self, left: int = 1, right: int = 1) -> Mode:
        pad = lambda x: None if x is None else np.pad(x, ((left, right), (0, 0)))
        return Mode(pad(self.nuc), pad(self.di), pad(self.shape), {d: pad(x) for d, x in self.far.items()})

    def with_features(self, di: bool, features: int, distances: tuple[int, ...] = ()) -> Mode:
        new = Mode.zeros(self.k, di, features, tuple(d for d in distances if d not in self.far))
        return Mode(self.nuc, self.di if self.di is not None else new.di, self.shape if self.shape is not None else new.shape, dict(sorted({**self.far, **new.far}.items())))


@dataclass(frozen=True)
class Model:
    """Binding modes, and the log affinity of non-specific binding (None: there is none)."""

    modes: list[Mode]
    ns: float | None = None
    flank: int = 0

    def vector(self) -> np.ndarray:
        return np.concatenate([*(m.vector() for m in self.modes), [] if self.ns is None else [self.ns]])

    def with_vector(self, v: np.ndarray) -> Model:
        at, modes = 0, []
        for m in self.modes:
            n = len(m.vector())
            modes.append(m.with_vector(v[at : at + n]))
            at += n
        return replace(self, modes=modes, ns=None if self.ns is None else float(v[at]))


def even_odd(k: int) -> str:
    """Palindrome string: 1,2,...,-2,-1, with * in the middle of an odd length."""
    if k < 2:
        raise ValueError("a palindrome needs two positions")
    half = [str(i) for i in range(1, k // 2 + 1)]
    return ",".join(half + (["*"] if k % 2 else []) + ["-" + x for x in reversed(half)])


@dataclass
class Symmetry:
    """Ties between positions. Groups are signed numbers; -g is the reverse complement of g, * its own; | parts blocks
    between which dinucleotides are not tied."""

    text: str
    groups: list[str] = field(init=False)
    barriers: set[int] = field(init=False)

    def __post_init__(self):
        self.groups, self.barriers = [], set()
        for token in self.text.split(","):
            token = token.strip()
            if token == "|":
                self.barriers.add(len(self.groups))
            elif token == "*" or (token.lstrip("-").isdigit() and int(token)):
                self.groups.append(token)
            else:
                raise ValueError(f"not a symmetry group: {token!r}")

    def tie(self, mode: Mode) -> np.ndarray:
        """(full, free) 0/1 matrix: which free parameter each full one takes."""
        k = mode.k
        if len(self.groups) != k:
            raise ValueError("symmetry and mode differ in length")
        seen: dict[tuple, int] = {}
        columns: list[int] = []

        def take(key, twin):
            name = min(key, twin)
            seen.setdefault(name, len(seen))
            columns.append(seen[name])

        group = lambda p: int(self.groups[p]) if self.groups[p] != "*" else 0
        for p in range(k):
            for b in range(4):
                g = group(p)
                if g == 0:
                    take(("n", f"*{p}", b), ("n", f"*{p}", 3 - b))
                else:
                    key = ("n", f"{abs(g)}", b if g > 0 else 3 - b)
                    take(key, key)
        if mode.di is not None:
            for p in range(k - 1):
                for x in range(16):
                    a, b = divmod(x, 4)
                    g, h = group(p), group(p + 1)
                    if p + 1 in self.barriers:
                        key = ("d", f"|{p}", 0, 0, 0, x)
                        take(key, key)
                        continue
                    key = ("d", "", g, h, 0, a * 4 + b)
                    twin = ("d", "", -h, -g, 0, (3 - b) * 4 + 3 - a)
                    take(key, twin)
        if mode.shape is not None:
            for p in range(k):
                for f in range(mode.shape.shape[1]):
                    key = ("s", f"{abs(group(p))}" if group(p) else f"*{p}", f)
                    take(key, key)
        out = np.zeros((len(columns), len(seen)))
        out[np.arange(len(columns)), columns] = 1
        return out


class SiteSymmetry:
    """Ties of a site by blocks or letters, and of its pairs at any distance.

    Letters: "ABCDE|..|edcba". Equal letters are equal positions, the other case is the complement, digits and other signs
    are their own complement, a dot has no weights, | is a barrier that no pair spans.
    Blocks: "1:5:0|0:2:0|-1:5:0", each number:length:own. A negative number is the reverse complement of its block, 0 has
    no weights, own 1 makes a block its own reverse complement. Barriers stand between blocks.
    """

    def __init__(self, text: str | None, k: int):
        self.groups: list[int | None] = []
        self.own: set[int] = set()
        self.barriers: set[int] = set()  # before these positions
        if text is None or text.lower() == "null":
            self.groups = list(range(1, k + 1))
        elif ":" in text:
            self._blocks(text)
        else:
            self._letters(text)
        if len(self.groups) != k:
            raise ValueError("symmetry and mode differ in length")

    def _letters(self, text: str) -> None:
        numbers: dict[str, int] = {}
        for c in text:
            if c == "|":
                if self.groups:
                    if len(self.groups) in self.barriers:
                        raise ValueError("two barriers in one place")
                    self.barriers.add(len(self.groups))
                continue
            if c == ".":
                self.groups.append(None)
                continue
            g = numbers.setdefault(c.upper(), len(numbers) + 1)
            if c.upper() == c.lower():
                self.own.add(g)
            self.groups.append(g if c == c.upper() else -g)

    def _blocks(self, text: str) -> None:
        known: dict[int, tuple[list[int], bool]] = {}
        last = 0
        for part in text.split("|"):
            fields = part.split(":")
            if len(fields) != 3:
                raise ValueError("a block is number:length:own")
            number, length, own = int(fields[0]), int(fields[1]), int(fields[2]) == 1
            if length <= 0:
                raise ValueError("a block has a length")
            if number == 0:
                self.groups += [None] * length
            else:
                if abs(number) not in known:
                    half = -(-length // 2) if own else length
                    first = list(range(last + 1, last + half + 1))
                    last += half
                    if own and length % 2:
                        self.own.add(first[-1])
                    known[abs(number)] = (first + [-g for g in reversed(first[: length // 2])] if own else first, own)
                groups, was_own = known[abs(number)]
                if was_own != own or len(groups) != length:
                    raise ValueError("blocks of one number differ")
                self.groups += groups if number > 0 or own else [g if g in self.own else -g for g in reversed(groups)]
            self.barriers.add(len(self.groups))

    def complement(self, g: int) -> int:
        return g if abs(g) in self.own else -g

    def tie(self, distance: int = 0) -> np.ndarray:
        """(full, free) 0/1 matrix of the features of positions (distance 0) or of pairs so far apart. Features without
        weights, and pairs that span a barrier, are rows of zeros."""
        k, size = len(self.groups), 4 if distance == 0 else 16
        free: dict[tuple, int] = {}
        rows: list[int | None] = []
        for p in range(k - distance):
            q = p + distance
            g, h = self.groups[p], self.groups[q]
            spanned = g is None or h is None or any(p < b <= q for b in self.barriers)
            for x in range(size):
                if spanned:
                    rows.append(None)
                    continue
                a, b = divmod(x, 4) if distance else (x, x)
                key, twin = (g, h, a, b), (self.complement(h), self.complement(g), 3 - b, 3 - a)
                rows.append(free.setdefault(min(key, twin), len(free)))
        out = np.zeros((len(rows), len(free)))
        for i, r in enumerate(rows):
            if r is not None:
                out[i, r] = 1
        return out


def mode_tie(mode: Mode, text: str) -> np.ndarray:
    """(full, free) matrix of a mode: signed numbers (Symmetry), or letters and blocks (SiteSymmetry), which tie pairs at any distance too."""
    if all(t.strip() in ("*", "|") or t.strip().lstrip("-").isdigit() for t in text.split(",")) and not mode.far:
        return Symmetry(text).tie(mode)
    if mode.shape is not None:
        raise ValueError("a site's symmetry has no ties for shape")
    site = SiteSymmetry(text, mode.k)
    blocks = [site.tie(), *([site.tie(1)] if mode.di is not None else []), *(site.tie(d) for d in sorted(mode.far))]
    out, i, j = np.zeros((sum(len(b) for b in blocks), sum(b.shape[1] for b in blocks))), 0, 0
    for b in blocks:
        out[i : i + len(b), j : j + b.shape[1]] = b
        i, j = i + len(b), j + b.shape[1]
    return out


def compress(vector: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Free parameters of a position: the mean over tied ones."""
    return tie.T @ vector / tie.sum(axis=0)


def null_directions(mode: Mode, ns: bool = False) -> np.ndarray:
    """Orthonormal directions along which no probability changes.

    Without non-specific binding a constant may move between any two positions (and scale all affinities); with it
    only moves that keep every affinity.
    """
    k, rows = mode.k, []
    size = len(mode.vector())
    constant = []
    for p in range(k):
        v = np.zeros(size)
        v[4 * p : 4 * p + 4] = 1
        constant.append(v)
    if ns:
        rows += [a - b for a, b in zip(constant, constant[1:])]
    else:
        rows += constant
    if mode.di is not None:
        base = 4 * k
        for p in range(k - 1):
            for b in range(4):
                v = np.zeros(size)
                v[base + 16 * p + 4 * b : base + 16 * p + 4 * b + 4] = 1
                v[4 * p + b] = -1
                rows.append(v)
                v = np.zeros(size)
                v[[base + 16 * p + 4 * a + b for a in range(4)]] = 1
                v[4 * (p + 1) + b] = -1
                rows.append(v)
    base = 4 * k + (0 if mode.di is None else 16 * (k - 1)) + (0 if mode.shape is None else mode.shape.size)
    for d in sorted(mode.far):
        for p in range(k - d):
            for b in range(4):
                for x, at in (([4 * b + a for a in range(4)], p), ([4 * a + b for a in range(4)], p + d)):
                    v = np.zeros(size)
                    v[[base + 16 * p + i for i in x]] = 1
                    v[4 * at + b] = -1
                    rows.append(v)
        base += 16 * (k - d)
    if not rows:
        return np.zeros((0, size))
    u, s, _ = np.linalg.svd(np.array(rows).T, full_matrices=False)
    return u[:, s > 1e-9].T


def normal_form(mode: Mode, ns: bool = False) -> Mode:
    """The equivalent position without any part along null directions."""
    n, v = null_directions(mode, ns), mode.vector()
    return mode.with_vector(v - n.T @ (n @ v))


def normalize_modes(model: Model) -> Model:
    """Best base of each position at 0, what was taken off spread so that the strongest mode has the top affinity 1."""
    tops = [float(m.nuc.max(axis=1).sum()) for m in model.modes]
    best = max(tops)
    modes = []
    for m, t in zip(model.modes, tops):
        modes.append(replace(m, nuc=m.nuc - m.nuc.max(axis=1, keepdims=True) + (t - best) / m.k))
    return replace(model, modes=modes, ns=None if model.ns is None else model.ns - best)
