"""Exact dedup against plain grouping."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from bindscape.llm import extendible_dedup as X

SF = "/root/testdata/sf0.001"


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(map(str, out))


def check(df, rows):
    got = df.collect()
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got) == brute(rows)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({t or "" for _, t in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_edges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["", None, "a", "b", "x" * 50_000, f"only {i}"])) for i in range(300)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, "a"), (None, "lost"), (None, "lost"), (None, None)]
    df = spark.createDataFrame([(*r, 1, "x", b"") for r in rows], "doc_id long, text string, h int, row string, sha binary").repartition(7)
    check(X.exact_classes(df), rows)
    assert X.exact_classes(df.limit(0)).collect() == []


def test_collisions_and_splits(spark):
    rows = [(i, f"t{i % 90}") for i in range(270)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(X.exact_classes(df, hash_of=F.length("text").cast("long")), rows)  # every text collides with many
    check(X.exact_classes(df, capacity=4), rows)


def test_directory():
    rng = random.Random(4)
    cells = {rng.randrange(1 << 8): rng.randrange(1, 30) for _ in range(100)} | {3: 500}
    d = X.Directory(cells, capacity=60, most_bits=8)
    ends = d.first[1:] + [1 << 8]
    assert d.first[0] == 0 and max(b[1] for b in d.buckets) == d.depth
    for (first, depth, n), end in zip(d.buckets, ends):
        assert end - first == 1 << (8 - depth) and n == sum(v for k, v in cells.items() if first <= k < end)
        assert n <= 60 or depth == 8
    assert d.before == [sum(b[2] for b in d.buckets[:k]) for k in range(len(d.buckets) + 1)] and d.most_owners(60) == sum(max(1, -(-n // 60)) for _, _, n in d.buckets)


def test_placed(spark):
    """Each hash once, in one bucket of its own prefix; buckets within capacity, also those that a task splits; owners hold runs of buckets."""
    rng = random.Random(9)
    hashes = {rng.getrandbits(64) for _ in range(900)} | {(0xFFFF << 48) | rng.getrandbits(30) for _ in range(400)} | {0, 1, (1 << 64) - 1}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    twice = spark.createDataFrame([(signed(h),) for h in hashes], "h long").repartition(4)
    cells = defaultdict(int)
    for h in hashes:
        cells[h >> 48] += 1
    d = X.Directory(cells, 20)
    rows = sorted(((r["h"] % (1 << 64), r["bucket"] % (1 << 64), r["owner"]) for r in X.placed(twice, d, 20).collect()))
    assert [r[0] for r in rows] == sorted(hashes)
    held = defaultdict(list)
    for h, bucket, owner in rows:
        held[bucket].append((h, owner))
    firsts = sorted(held)
    assert all(len(v) <= 20 and len({o for _, o in v}) == 1 and min(v)[0] >= b for b, v in held.items())
    assert all(max(held[a])[0] < b for a, b in zip(firsts, firsts[1:]))
    owners = [held[b][0][1] for b in firsts]
    assert owners == sorted(owners) and max(owners) < d.most_owners(20) and len(set(owners)) > 10
    assert X.placed(twice.limit(0), X.Directory({}, 20), 20).collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(X.op7_exact_dedup(spark, SF), [(r["doc_id"], r["text"]) for r in docs.collect()])
