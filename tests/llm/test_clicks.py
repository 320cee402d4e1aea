"""Click windows against a plain walk over all copies."""

import hashlib
import math
import os
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindscape.llm import click_windows as X

SF = "/root/testdata/sf0.001"
START = datetime(1970, 1, 1)


def micros(t):
    return (t - START) // timedelta(microseconds=1)


def brute_copies(rows, n=8):
    out = []
    for click, ts, arrived, client, kind, value, props in rows:
        if click is None or arrived is None:
            continue
        text = lambda x: "" if x is None else str(x)
        head = "|".join([text(client), text(kind), text(None if value is None else math.floor(100 * value + 0.5)), text(None if ts is None else micros(ts)), text(props)])
        for j in range(max(0, int(math.fmod(click, 3))) + 1):
            c = zlib.crc32(f"{click}:{j}".encode())
            hour = micros(arrived) // 3_600_000_000 + 6 * j * (c % 10)
            out.append((click, hour, hour + c // 10 % 200, hashlib.sha256(f"{head}|{c % 3}".encode()).hexdigest()))
    low, high = min(x[2] for x in out), max(x[2] for x in out)
    return [(c, h, (seen - low) * n // (high - low + 1), s) for c, h, seen, s in out]


def brute(events, n=8, window=24, late=96):
    batches = defaultdict(list)
    for click, hour, batch, s in events:
        batches[batch].append((click, hour, s))
    opened, out, most = {}, [], None

    def shut(click, batch):
        w = opened.pop(click)
        out.append((click, w[0], batch, w[2], w[3], w[4], w[1]))

    for b in range(n):
        if most is not None:
            for click in [c for c, w in opened.items() if w[0] + window < most - late]:
                shut(click, b - 1)
        for click, hour, s in sorted(batches[b]):
            if most is not None and hour < most - late:
                continue
            w = opened.get(click)
            if w and hour <= w[0] + window:
                w[2] += 1
                if s != w[1]:
                    w[3] += 1
                    w[4] += zlib.crc32(s.encode())
                continue
            if w:
                shut(click, b)
            opened[click] = [hour, s, 0, 0, 0]
        most = max([h for _, h, _ in batches[b]] + ([] if most is None else [most]), default=None)
    for click in list(opened):
        shut(click, n - 1)
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.withColumn("hash", F.lower(F.hex("hash"))).collect())


def frame(spark, events):
    rows = [(c, h, b, None if s is None else bytes.fromhex(s), 0 if s is None else zlib.crc32(s.encode())) for c, h, b, s in events]
    return spark.createDataFrame(rows, "click_id long, hour long, batch long, hash binary, crc long").repartition(3)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/clicks.parquet").select("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props").collect()]
    out = sorted(tuple(r) for r in X.op12_click_windows(spark, SF).select("click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash").collect())
    assert out == brute(brute_copies(rows))
    assert any(r[4] for r in out)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_copies(spark, zone):
    rng = random.Random(3)
    pick = lambda x: None if rng.random() < 0.1 else x
    rows = [(pick(rng.randint(-5, 40)), pick(datetime(2024, 3, 10, 2, 30, 1, rng.randint(0, 999_999))), pick(datetime(rng.choice([1965, 2024]), 3, 31, rng.randint(0, 23), 59)), pick(rng.randint(0, 9)), pick("a|b"), pick(rng.choice([-1.005, 0.0, 2.675, 1e15])), pick("x" * 100_000)) for _ in range(60)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, hour long, batch long")
    with X.settings(spark, {"spark.sql.session.timeZone": zone}):
        out = sorted((r["click_id"], r["hour"], r["batch"], r["hash"].hex(), r["crc"]) for r in X.copies(df).collect())
    assert out == sorted((c, h, b, s, zlib.crc32(s.encode())) for c, h, b, s in brute_copies(rows))


@pytest.mark.parametrize("per_group", [0, 40])
def test_edges(spark, per_group):
    rng = random.Random(8)
    hashes = [hashlib.sha256(bytes([k])).hexdigest() for k in range(3)] + ["00" * 32, "ab" * 31 + "00"]
    events = [(rng.choice([-7, 0, 2**60 + 1, 2**60, *range(30)]), rng.randint(-700, -650) + 130 * b + rng.choice([0, 0, -90, -97, -200]), b, rng.choice(hashes)) for b in (0, 1, 3) for _ in range(150)]
    events += events[:20]
    assert got(X.windows(frame(spark, events), 4, per_group=per_group)) == brute(events, 4)


def test_a_hot_click_and_limits(spark):
    s = ["11" * 32, "22" * 32]
    events = [(1, 100 + k % 60, k % 2, s[k % 7 > 0]) for k in range(4000)]
    # Exactly at the window's end and at the limit of lateness, and one hour beyond each.
    events += [(2, 100, 0, s[0]), (2, 124, 0, s[1]), (3, 100, 0, s[0]), (3, 125, 0, s[1]), (4, 300, 0, s[0]), (5, 204, 1, s[0]), (6, 203, 1, s[0]), (7, 180, 0, s[0]), (8, 179, 0, s[0]), (7, 204, 1, s[1]), (8, 204, 1, s[1])]
    assert got(X.windows(frame(spark, events), 2)) == brute(events, 2)


def test_empty(spark):
    assert got(X.windows(frame(spark, []), 8)) == []
    assert got(X.windows(frame(spark, [(None, 5, 0, None), (5, None, 0, None)]), 8)) == []
    assert X.op12_click_windows.__module__.endswith("click_windows")
    assert X.copies(spark.read.parquet(f"{SF}/clicks.parquet").limit(0)).collect() == []


def test_fold_equals_walk():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(1, 60))
        click, hour = rng.integers(0, 6, n), rng.integers(0, 150, n)
        hashes = np.array([bytes([k]) * 32 for k in rng.integers(1, 3, n)], "S32")
        closed, still = X.fold(np.empty(0, X.OPEN), click, hour, hashes, np.arange(n))
        events = [(int(c), int(h), 0, s.hex()) for c, h, s in zip(click, hour, hashes.tolist(), strict=True)]
        want = brute(events, 1)
        every = np.concatenate([closed, still])
        assert sorted((int(r["click"]), int(r["start"]), int(r["repeats"]), int(r["conflicts"])) for r in every) == sorted((w[0], w[1], w[3], w[4]) for w in want)


def test_stores_leave_nothing_outside_the_heap(spark, monkeypatch):
    """Spark keeps half a MB for each RocksDB store ever opened, one a partition and start: no start may open any."""
    where = []
    monkeypatch.setattr(X.common, "shared_dir", lambda spark, name, f=X.common.shared_dir: where.append(f(spark, name)) or where[-1])
    s = ["11" * 32, "22" * 32]
    events = [(k % 50, 100 + 40 * (k % 4) + k % 7, k % 4, s[k % 3 > 0]) for k in range(400)]
    with X.settings(spark, {"spark.sql.shuffle.partitions": "40", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}):
        assert got(X.windows(frame(spark, events), 4, per_group=5)) == brute(events, 4)
    files = [f for _, _, names in os.walk(f"{where[0].removeprefix('file:')}/state/state") for f in names]
    assert sum(f.endswith(".delta") for f in files) >= 4 * 40
    assert not [f for f in files if f.endswith((".changelog", ".zip", ".sst"))]
