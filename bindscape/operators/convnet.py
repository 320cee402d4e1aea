"""Small convolutional scorers: detectors over a padded sequence, rectified, pooled, one linear or hidden layer. Single precision."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First line of a parameter file: the writer's name and the version of the format.
VERSION = re.compile(r"# \w+ 0\.1")
SIZES = ("reverse_complement", "num_detectors", "detector_len", "has_avg_pooling", "num_hidden")
LISTS = ("detectors", "thresholds", "weights1", "biases1", "weights2", "biases2")


@dataclass(frozen=True)
class Net:
    """detectors: (detectors, length, 4)."""

    reverse_complement: bool
    avg: bool
    detectors: np.ndarray
    thresholds: np.ndarray
    weights1: np.ndarray
    biases1: np.ndarray
    weights2: np.ndarray
    biases2: np.ndarray

    @property
    def window(self) -> int:
        return int(1.5 * self.detectors.shape[1])


def parse(text: str) -> Net:
    """A parameter file: version line, five sizes, six comma lists; the last two may be empty."""
    lines = [x.strip() for x in text.strip().splitlines()]
    if not lines or not VERSION.fullmatch(lines[0]):
        raise ValueError("not a parameter file of the known version")
    got = {}
    for line in lines[1:]:
        name, _, value = line.partition("=")
        got[name.strip()] = value.strip()
    missing = [n for n in (*SIZES, *LISTS) if n not in got]
    if missing:
        raise ValueError(f"missing: {missing}")
    size = {n: int(got[n]) for n in SIZES}
    floats = {n: np.array([float(x) for x in got[n].split(",") if x.strip()], np.float32) for n in LISTS}
    d, m, hidden = size["num_detectors"], size["detector_len"], size["num_hidden"]
    pooled = d * (2 if size["has_avg_pooling"] else 1)
    expect = {"detectors": 4 * d * m, "thresholds": d, "weights1": pooled * max(1, hidden), "biases1": max(1, hidden), "weights2": hidden, "biases2": 1 if hidden else 0}
    for n, e in expect.items():
        if len(floats[n]) != e:
            raise ValueError(f"{n} has {len(floats[n])} numbers, not {e}")
    # Stored with the detector fastest, then the base, then the position.
    det = floats["detectors"].reshape(m, 4, d).transpose(2, 0, 1)
    return Net(bool(size["reverse_complement"]), bool(size["has_avg_pooling"]), det, floats["thresholds"], floats["weights1"], floats["biases1"], floats["weights2"], floats["biases2"])


def _codes(seq: str) -> np.ndarray:
    table = {c: i for i, cs in enumerate(("Aa", "Cc", "Gg", "TtUu", "Nn")) for c in cs}
    try:
        return np.array([table[c] for c in seq], int)
    except KeyError as e:
        raise ValueError(f"not a base: {e}") from None


def score_one(net: Net, x: np.ndarray) -> float:
    """One strand, all of it: outside the sequence stands N, whose weight is the mean of the four."""
    d, m, _ = net.detectors.shape
    full = np.concatenate([net.detectors, net.detectors.mean(axis=2, keepdims=True)], axis=2).astype(np.float32)
    pad = np.concatenate([np.full(m - 1, 4), x, np.full(m - 1, 4)])
    n = len(x) + m - 1
    maps = np.zeros((d, n), np.float32)
    for j in range(m):
        maps += full[:, j, pad[j : j + n]]
    maps = np.maximum(maps + net.thresholds[:, None], 0)
    pooled = maps.max(axis=1)
    if net.avg:
        pooled = np.stack([pooled, maps.mean(axis=1, dtype=np.float32)], axis=1).ravel()
    if len(net.weights2):
        hidden = np.maximum(net.weights1.reshape(len(pooled), -1).T @ pooled + net.biases1, 0)
        return float(net.weights2 @ hidden + net.biases2[0])
    return float(net.weights1 @ pooled + net.biases1[0])


def scan(net: Net, x: np.ndarray, window: int | None = None) -> float:
    """Largest score of all windows; of the whole sequence if it is no longer than one."""
    w = window or net.window
    return score_one(net, x) if len(x) <= w else max(score_one(net, x[i : i + w]) for i in range(len(x) - w + 1))


def score_many(net: Net, x: np.ndarray) -> np.ndarray:
    """score_one of each row of codes (n, length), side by side."""
    d, m, _ = net.detectors.shape
    full = np.concatenate([net.detectors, net.detectors.mean(axis=2, keepdims=True)], axis=2).astype(np.float32).transpose(1, 2, 0)
    n, out = x.shape[1] + m - 1, []
    step = max(1, 2_000_000 // (n * d))
    for k in range(0, len(x), step):
        pad = np.pad(x[k : k + step], ((0, 0), (m - 1, m - 1)), constant_values=4)
        maps = np.zeros((len(pad), n, d), np.float32)
        for j in range(m):
            maps += full[j][pad[:, j : j + n]]
        maps = np.maximum(maps + net.thresholds, 0)
        pooled = maps.max(axis=1)
        if net.avg:
            pooled = np.stack([pooled, maps.mean(axis=1, dtype=np.float32)], axis=2).reshape(len(pad), -1)
        if len(net.weights2):
            out.append(np.maximum(pooled @ net.weights1.reshape(pooled.shape[1], -1) + net.biases1, 0) @ net.weights2 + net.biases2[0])
        else:
            out.append(pooled @ net.weights1 + net.biases1[0])
    return np.concatenate(out).astype(np.float64) if out else np.empty(0)


def scan_many(net: Net, x: np.ndarray, window: int | None = None) -> np.ndarray:
    """scan of each row of codes."""
    w = window or net.window
    if x.shape[1] <= w:
        return score_many(net, x)
    views = np.lib.stride_tricks.sliding_window_view(x, w, axis=1)
    return score_many(net, views.reshape(-1, w)).reshape(views.shape[:2]).max(axis=1)


def score_sequences(net: Net, seqs: list[str], window: int | None = None) -> np.ndarray:
    """score_sequence of each sequence; those of one length are scored together."""
    out, by_length = np.full(len(seqs), np.nan), {}
    for k, s in enumerate(seqs):
        if s:
            by_length.setdefault(len(s), []).append(k)
    for length, at in by_length.items():
        x = _codes("".join(seqs[k] for k in at)).reshape(-1, length)
        got = scan_many(net, x, window)
        if net.reverse_complement:
            got = np.maximum(got, scan_many(net, np.where(x < 4, 3 - x, 4)[:, ::-1], window))
        out[at] = got
    return out


def score_sequence(net: Net, seq: str | None, window: int | None = None) -> float | None:
    """Both strands if the net asks for it. Null for null and for an empty sequence."""
    if not seq:
        return None
    x = _codes(seq)
    out = scan(net, x, window)
    if net.reverse_complement:
        out = max(out, scan(net, np.where(x < 4, 3 - x, 4)[::-1], window))
    return out


def net_score(df: DataFrame, net: Net, seq: str = "seq", out: str = "score", window: int | None = None) -> DataFrame:
    """df with the score of seq; each distinct sequence of an Arrow batch scored once, all of one length side by side."""
    sent = df.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        own = s.dropna().unique()
        return s.map(dict(zip(own, score_sequences(sent.value, list(own), window)))).astype("float64")

    return df.withColumn(out, run(F.col(seq)))


def known_ids(lines: DataFrame) -> DataFrame:
    """(id) of an id list: one each line, # comments and blank lines left out."""
    text = F.trim(F.regexp_replace("value", "#.*", ""))
    return lines.select(text.alias("id")).where("id != ''")


def combined(score: Column, reverse_score: Column) -> Column:
    return F.greatest(score, reverse_score)
