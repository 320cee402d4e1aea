"""Likelihood of binding models on a probe table: one Spark job an evaluation, of one model or of many.

L = n ln Z - sum c ln(pi W) + lambda |beta|^2. Each task sums value, gradient (and the upper half of the Hessian) over its own
probes in NumPy and gives one row: all sums of all models asked for, packed. Rows are added up in levels of FAN, so what is shuffled is a
vector for each task, and at most FAN vectors reach the driver. Probes are coded once as one number each, two bits a base,
and kept in that form for all evaluations; ``release`` lets go of them. Models of one job share the unpacked probes, the
background and the codes of their windows. A probe may have several counts (folds, rounds), and each model asked for names the one it takes.

Without shape a frame is looked up by chunks of up to CHUNK bases: a table of exp(weights) for each chunk, and the gradient as
weighted counts of chunk codes, which are added up by feature at the end. So a frame costs a few lookups, whatever its features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bindscape.functions import dna

from .background import Background
from .params import Mode, Model
from .partition import model_z, model_z_hessian, padded
from .scoring import kappas

#: Bases of a chunk (one more where dinucleotides cross its end).
CHUNK = 6
#: Vectors that are added up in one place.
FAN = 64
#: Probes that a task unpacks at once.
BLOCK = 4096
#: Probes for which a task is worth its start.
ROWS = 16_384


@dataclass(frozen=True)
class Ask:
    """Sums wanted: of a model, over the count column of that number, with or without second derivatives."""

    model: Model
    column: int = 0
    hessian: bool = False

    @property
    def sizes(self) -> tuple[int, int]:
        n = len(self.model.vector())
        return 1 + n, n * (n + 1) // 2 if self.hessian else 0


class Chunks:
    """Tables of a mode without shape: for each chunk (first position, bases, exp of its weights by code, its features by code)."""

    def __init__(self, mode: Mode):
        self.parts, size = [], len(mode.vector())
        for first in range(0, mode.k, CHUNK):
            last = min(mode.k, first + CHUNK)
            width = last - first + (mode.di is not None and last < mode.k)
            base = np.array([np.arange(4**width) // 4 ** (width - 1 - j) % 4 for j in range(width)])
            parameter = [4 * (first + j) + base[j] for j in range(last - first)]
            if mode.di is not None:
                parameter += [4 * mode.k + 16 * (first + j) + 4 * base[j] + base[j + 1] for j in range(width - 1)]
            parameter = np.array(parameter)
            self.parts.append((first, width, np.exp(mode.vector()[parameter].sum(axis=0)), parameter))
        self.size = size

    def codes(self, rolled: dict[int, np.ndarray], frames: int) -> list[np.ndarray]:
        """Chunk codes (n, frames) of one strand. rolled: codes of all windows by their width, which is added to; 1 is the strand."""
        x, out = rolled[1], []
        for first, width, _, _ in self.parts:
            for w in range(2, width + 1):
                if w not in rolled:
                    rolled[w] = 4 * rolled[w - 1][:, :-1] + x[:, w - 1 :]
            out.append(rolled[width][:, first : first + frames])
        return out

    def kappas(self, codes: list[np.ndarray]) -> np.ndarray:
        out = self.parts[0][2][codes[0]]
        for (_, _, table, _), c in zip(self.parts[1:], codes[1:]):
            out *= table[c]
        return out

    def gradient(self, codes: list[np.ndarray], share: np.ndarray) -> np.ndarray:
        """Sum of share over the frames that hold each feature."""
        out = np.zeros(self.size)
        for (_, width, _, parameter), c in zip(self.parts, codes):
            by_code = np.bincount(c.ravel(), weights=share.ravel(), minlength=4**width)
            for p in parameter:
                out += np.bincount(p, weights=by_code, minlength=self.size)
        return out


class Block:
    """Unpacked probes and what the models asked for share of them."""

    def __init__(self, x: np.ndarray, background: Background):
        self.x, self.background = x, background
        self._strands: dict[int, list[dict[int, np.ndarray]]] = {}
        self._logs: np.ndarray | None = None

    def strands(self, flank: int) -> list[dict[int, np.ndarray]]:
        if flank not in self._strands:
            full = padded(self.x, self.background.left, self.background.right, flank).astype(np.int32)
            self._strands[flank] = [{1: full}, {1: 3 - full[:, ::-1]}]
        return self._strands[flank]

    @property
    def log_probabilities(self) -> np.ndarray:
        if self._logs is None:
            self._logs = self.background.log_probabilities(self.x)
        return self._logs


def probe_sums(block: Block, cnt: np.ndarray, model: Model):
    """(sum c ln(pi W), sum c dW/W) over a block of probes, for models without shape."""
    w, seen = np.full(len(block.x), 0.0 if model.ns is None else np.exp(model.ns)), []
    for m in model.modes:
        chunks = Chunks(m)
        for strand in block.strands(model.flank):
            at = chunks.codes(strand, strand[1].shape[1] - m.k + 1)
            kappa = chunks.kappas(at)
            w += kappa.sum(axis=1)
            seen.append((chunks, at, kappa))
    per = cnt / w
    parts = []
    for i, m in enumerate(model.modes):
        parts.append(sum(chunks.gradient(at, per[:, None] * kappa) for chunks, at, kappa in seen[2 * i : 2 * i + 2]))
    if model.ns is not None:
        parts.append(np.array([np.exp(model.ns) * per.sum()]))
    return float(cnt @ (block.log_probabilities + np.log(w))), np.concatenate(parts)


def features(x: np.ndarray, mode: Mode, shape: np.ndarray | None) -> list[np.ndarray]:
    """For each frame, (n, parameters): how often each parameter of the mode enters; x is coded with context."""
    margin, out = (2 if mode.shape is not None else 0), []
    n, k = len(x), mode.k
    rows = np.arange(n)
    for s in range(x.shape[1] - 2 * margin - k + 1):
        nuc = np.zeros((n, k, 4))
        di = np.zeros((n, k - 1, 16)) if mode.di is not None else None
        sh = np.zeros((n, k, mode.shape.shape[1])) if margin else None
        far = {d: np.zeros((n, k - d, 16)) for d in sorted(mode.far)}
        for j in range(k):
            p = s + j + margin
            nuc[rows, j, x[:, p]] = 1
            if di is not None and j < k - 1:
                di[rows, j, 4 * x[:, p].astype(int) + x[:, p + 1]] = 1
            for d, pairs in far.items():
                if j < k - d:
                    pairs[rows, j, 4 * x[:, p].astype(int) + x[:, p + d]] = 1
            if margin:
                sh[:, j] = shape[sum(x[:, p - 2 + i].astype(int) * 4 ** (4 - i) for i in range(5))]
        out.append(np.concatenate([f.reshape(n, -1) for f in (nuc, di, sh, *far.values()) if f is not None], axis=1))
    return out


def probe_derivatives(x: np.ndarray, cnt: np.ndarray, background: Background, model: Model, shape: np.ndarray | None, hessian: bool = False):
    """(sum c ln(pi W), sum c dW/W, and sum c (d2W/W - dW dW / W^2)) over coded probes."""
    size = len(model.vector())
    w, d = np.full(len(x), 0.0 if model.ns is None else np.exp(model.ns)), np.zeros((len(x), size))
    second = []
    at = 0
    for m in model.modes:
        n = len(m.vector())
        full = padded(x, background.left, background.right, model.flank + (2 if m.shape is not None else 0))
        for strand in (full, 3 - full[:, ::-1]):
            kappa = kappas(strand, m, shape)
            w += kappa.sum(axis=1)
            for s, f in enumerate(features(strand, m, shape)):
                d[:, at : at + n] += kappa[:, s : s + 1] * f
                if hessian:
                    second.append((at, n, kappa[:, s], f))
        at += n
    if model.ns is not None:
        d[:, -1] = np.exp(model.ns)
    value = float(cnt @ (background.log_probabilities(x) + np.log(w)))
    gradient = (cnt / w) @ d
    if not hessian:
        return value, gradient, None
    h = -(d * (cnt / w**2)[:, None]).T @ d
    for at, n, kappa, f in second:
        h[at : at + n, at : at + n] += (f * (cnt * kappa / w)[:, None]).T @ f
    if model.ns is not None:
        h[-1, -1] += np.exp(model.ns) * (cnt / w).sum()
    return value, gradient, h


def task_sums(block: Block, cnt: np.ndarray, ask: Ask, shape: np.ndarray | None) -> np.ndarray:
    """A block's part of what is asked for: value, gradient, upper half of the Hessian."""
    if not ask.hessian and all(m.shape is None and not m.far for m in ask.model.modes):
        v, g = probe_sums(block, cnt, ask.model)
        return np.concatenate([[v], g])
    v, g, h = probe_derivatives(block.x, cnt, block.background, ask.model, shape, ask.hessian)
    return np.concatenate([[v], g, h[np.triu_indices(len(g))] if ask.hessian else []])


def added_up(parts: DataFrame, tasks: int, size: int) -> np.ndarray:
    """The sum of packed vectors (part, v), in levels of FAN. tasks: about how many parts there are."""

    def add(batches):
        total, part = np.zeros(size), None
        for b in batches:
            for k, v in zip(b.column("part").to_pylist(), b.column("v").to_pylist()):
                total += np.frombuffer(v)
                part = k if part is None else min(k, part)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part // FAN]), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

    while tasks > FAN:
        tasks = -(-tasks // FAN)
        parts = parts.repartition(tasks, F.floor(F.col("part") / FAN)).mapInArrow(add, "part long, v binary")
    out = np.zeros(size)
    for r in parts.collect():  # at most some FAN vectors
        out += np.frombuffer(bytes(r["v"]))
    return out


class Likelihood:
    """Value, gradient and Hessian of a model's negative log likelihood over a probe table (seq, cnt).

    more: further count columns, each with its own ``column`` of the likelihood.
    """

    def __init__(self, probes: DataFrame, background: Background, penalty: float = 0.0, shape: np.ndarray | None = None, cnt: str = "cnt", cache: bool = True, more: tuple[str, ...] = ()):
        self.background, self.shape = background, shape
        self.kept = cache
        if not 1 <= background.length <= 32:
            raise ValueError("probes of 1 to 32 bases")
        names = [cnt, *more]
        known = F.col("seq").rlike(f"^[ACGT]{{{background.length}}}$")
        code = F.when(known, dna.encode("seq")).otherwise(F.raise_error(F.concat(F.lit(f"not a probe of {background.length} bases: "), "seq")))
        own = probes.select(code.alias("code"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c{k}") for k, c in enumerate(names)])
        any_left = F.col("c0") > 0
        for k in range(1, len(names)):
            any_left = any_left | (F.col(f"c{k}") > 0)
        self.probes = own.where(any_left)
        if cache:
            self.probes = self.probes.persist()
        each = [x for k in range(len(names)) for x in (F.sum(f"c{k}"), F.sum(F.when(F.col(f"c{k}") > 0, F.col(f"c{k}") * F.ln(f"c{k}"))))]
        found = self.probes.withColumn("part", F.spark_partition_id()).agg(F.max("part"), F.count(F.lit(1)), *each).first()
        self.tasks = 1 + (found[0] or 0)
        self.totals = [(float(found[2 + 2 * k] or 0), float(found[3 + 2 * k] or 0)) for k in range(len(names))]
        # Few probes that come in many partitions are read by few tasks, so that an evaluation costs what its probes do.
        few = max(1, -(-found[1] // ROWS))
        self.own, self.tasks = (self.probes.coalesce(few), few) if few < self.tasks else (self.probes, self.tasks)
        self.share = penalty
        self.evaluations = 0
        self._take(0)

    def _take(self, k: int) -> None:
        self.at = k
        self.n, self.entropy = self.totals[k]
        self.penalty = self.share * self.n

    def column(self, k: int) -> Likelihood:
        """The likelihood of the same probes by another of their counts; nothing is read or kept anew."""
        out = object.__new__(Likelihood)
        out.__dict__ |= self.__dict__
        out._take(k)
        return out

    def release(self) -> None:
        if self.kept:
            self.probes.unpersist()

    def swapped(self, probes: DataFrame, cnt: str = "cnt") -> Likelihood:
        """The same likelihood over another probe table, whose sequences must have the same length."""
        lengths = probes.agg(F.min(F.length("seq")).alias("low"), F.max(F.length("seq")).alias("high")).first()
        if lengths["low"] is not None and {lengths["low"], lengths["high"]} != {self.background.length}:
            raise ValueError(f"probes of {self.background.length} bases are needed, not {lengths['low']} to {lengths['high']}")
        return Likelihood(probes, self.background, self.share, self.shape, cnt, self.kept)

    def answer(self, asks: list[Ask]) -> list[tuple[float, np.ndarray, np.ndarray | None]]:
        """The sums of all that is asked for, from one scan in which each probe is unpacked once."""
        sent = self.probes.sparkSession.sparkContext.broadcast((self.background, asks, self.shape))
        size, length = sum(sum(a.sizes) for a in asks), self.background.length

        def run(batches):
            from pyspark import TaskContext

            background, asks, shape = sent.value
            places = 2 * np.arange(length - 1, -1, -1)
            total, seen = np.zeros(size), False
            for b in batches:
                code, counts = b.column("code").to_numpy(), [b.column(f"c{k}").to_numpy() for k in range(b.num_columns - 1)]
                for k in range(0, b.num_rows, BLOCK):
                    block = Block((code[k : k + BLOCK, None] >> places & 3).astype(np.uint8), background)
                    at, seen = 0, True
                    for ask in asks:
                        n = sum(ask.sizes)
                        total[at : at + n] += task_sums(block, counts[ask.column][k : k + BLOCK], ask, shape)
                        at += n
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

        total = added_up(self.own.mapInArrow(run, "part long, v binary"), self.tasks, size)
        sent.destroy()
        self.evaluations += 1
        out, at = [], 0
        for ask in asks:
            first, second = ask.sizes
            v, g, h = total[at], total[at + 1 : at + first], None
            if ask.hessian:
                h = np.zeros((first - 1, first - 1))
                h[np.triu_indices(first - 1)] = total[at + first : at + first + second]
                h = np.triu(h) + np.triu(h, 1).T
            out.append((float(v), g, h))
            at += first + second
        return out

    def sums(self, model: Model, hessian: bool = False):
        return self.answer([Ask(model, self.at, hessian)])[0]

    def _whole(self, model: Model, v: float, g: np.ndarray) -> tuple[float, np.ndarray]:
        z, dz = model_z(self.background, model, self.shape, True)
        beta = model.vector()
        return float(self.n * np.log(z) - v + self.penalty * (beta @ beta)), self.n * dz / z - g + 2 * self.penalty * beta

    def value_gradient(self, model: Model) -> tuple[float, np.ndarray]:
        return self._whole(model, *self.sums(model)[:2])

    def values_gradients(self, models: list[Model], columns: list[int] | None = None) -> list[tuple[float, np.ndarray]]:
        """value_gradient of many models from one scan. columns: the count that each model takes."""
        columns = columns or [self.at] * len(models)
        got = self.answer([Ask(m, c) for m, c in zip(models, columns, strict=True)])
        return [self.column(c)._whole(m, v, g) for m, c, (v, g, _) in zip(models, columns, got, strict=True)]

    def hessian(self, model: Model) -> np.ndarray:
        """Exact: the part of the probes from Spark, that of Z by second-order messages."""
        _, _, h = self.sums(model, True)
        z, dz, second = model_z_hessian(self.background, model, self.shape)
        return self.n * (second / z - np.outer(dz, dz) / z**2) - h + 2 * self.penalty * np.eye(len(dz))

    def per_read(self, value: float) -> tuple[float, float]:
        """(L / n, (L - entropy bound) / n)."""
        bound = self.n * np.log(self.n) - self.entropy
        return value / self.n, (value - bound) / self.n


def mode_gradient(probes: DataFrame, background: Background, model: Model) -> DataFrame:
    """(mode, g): sum c * (sum of the mode's kappa) / W, as DataFrame operations; at most a row a mode."""
    from .scoring import frame_affinities

    k = frame_affinities(probes.select("seq", "cnt"), model, background.left, background.right)
    by = k.groupBy("seq", "cnt", "mode").agg(F.sum("kappa").alias("s"))
    total = by.groupBy("seq").agg((F.sum("s") + F.lit(0.0 if model.ns is None else float(np.exp(model.ns)))).alias("w"))
    return by.join(total, "seq").groupBy("mode").agg(F.sum(F.col("cnt") * F.col("s") / F.col("w")).alias("g"))


def feature_gradient(probes: DataFrame, background: Background, model: Model) -> DataFrame:
    """(mode, pos, base, g): sum c * kappa / W over the frames in which a base stands at a position; a row a weight, from one scan of coded probes."""
    g, rows, at = Likelihood(probes, background, cache=False).sums(model)[1], [], 0
    for m, mode in enumerate(model.modes):
        rows += [(m, p + 1, b, float(g[at + 4 * p + k])) for p in range(mode.k) for k, b in enumerate("ACGT")]
        at += len(mode.vector())
    return probes.sparkSession.createDataFrame(rows, "mode int, pos int, base string, g double")


def feature_pairs(probes: DataFrame, background: Background, model: Model) -> DataFrame:
    """(mode, pos1, base1, pos2, base2, h): sum c * kappa / W over frames that hold both features, pos1 <= pos2.

    A frame gives a row for each pair of its blocks of four bases; those are added up by their letters, in at most 4^8 sums for a pair
    of blocks, before single positions are named.
    """
    from .scoring import frame_affinities

    k = frame_affinities(probes.select("seq", "cnt"), model, background.left, background.right)
    w = F.sum("kappa").over(Window.partitionBy("seq")) + F.lit(0.0 if model.ns is None else float(np.exp(model.ns)))
    last, part = F.floor((F.length("mer") - 1) / 4).cast("int"), lambda i: F.substring("mer", 4 * F.col(i) + 1, F.lit(4))
    two = k.withColumn("share", F.col("cnt") * F.col("kappa") / w).withColumn("i", F.explode(F.sequence(F.lit(0), last))).withColumn("j", F.explode(F.sequence(F.col("i"), last)))
    sums = two.groupBy("mode", "i", "j", part("i").alias("a"), part("j").alias("b")).agg(F.sum("share").alias("share"))
    one = sums.withColumn("p", F.explode(F.sequence(F.lit(1), F.length("a")))).withColumn("q", F.explode(F.sequence(F.when(F.col("i") == F.col("j"), F.col("p")).otherwise(1), F.length("b"))))
    at = lambda s, p: F.substring(s, F.col(p), F.lit(1))
    return one.groupBy("mode", (4 * F.col("i") + F.col("p")).alias("pos1"), at("a", "p").alias("base1"), (4 * F.col("j") + F.col("q")).alias("pos2"), at("b", "q").alias("base2")).agg(F.sum("share").alias("h"))
