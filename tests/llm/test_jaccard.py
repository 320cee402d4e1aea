"""Jaccard join and components against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import DataFrame

from bindscape.llm import components as K
from bindscape.llm import jaccard_join as J

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Sorted (doc_id, size, smallest id reachable)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(str((d, len(s), least.get(root(i), d) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(df):
    return sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in df.collect())


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    passage = [rng.choice(vocab) for _ in range(70)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(20, 120))]
        texts += [" ".join(edited(rng, base, rng.randrange(0, 4))) for _ in range(rng.randrange(1, 7))]
    base = [rng.choice(vocab) for _ in range(150)]
    texts += [" ".join(edited(rng, base, rng.randrange(0, 5))) for _ in range(60)]
    texts += [" ".join(passage + [rng.choice(vocab) for _ in range(rng.randrange(0, 25))]) for _ in range(40)]
    texts += ["", None, "One", "one", "a b c d", "A\tB\nc\x0bd", "É b", "é b", "x " * 3000, " \n "]
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("sizes", [{}, {"short": 4, "block": 8, "cluster": 2}, {"short": 2, "block": 1000, "cluster": 5}])
def test_components_of_texts(spark, sizes, monkeypatch):
    monkeypatch.setattr(J, "OFTEN", 3 if sizes else J.OFTEN)
    monkeypatch.setattr(J, "HOT", 4 if sizes else J.HOT)
    monkeypatch.setattr(J, "ONE_OF", 1 if sizes else J.ONE_OF)
    rows = corpus(len(sizes) + sum(sizes.values()))
    rows += [(rows[3][0], rows[3][1]), (rows[4][0], "another text under a known id"), (None, "no id"), (None, rows[7][1])]
    df = spark.createDataFrame([(*r, 0, b"", "x") for r in rows], "doc_id long, text string, n int, key binary, root string").repartition(6)
    assert got(J.jaccard_components(df, **sizes)) == brute(rows)


def test_lists_in_parts(spark, monkeypatch):
    """A list dealt to parts has the members and heads of the whole list."""
    rng = random.Random(5)
    rows = sorted({(rng.randrange(3), rng.randrange(40)) for _ in range(90)})
    parts = spark.createDataFrame([(t, g % 7 + 1, g, g // 4, 9, 1, 0, 0, 0) for t, g in rows], "token long, salt int, gid long, grp long, n int, stop long, at int, members long, m long")
    found = {(r["token"], r["gid"]): (r["m"], r["members"], r["at"] == 1) for r in J._whole_lists(parts).collect()}
    groups = {t: {} for t, _ in rows}
    for t, g in rows:
        groups[t].setdefault(g // 4, []).append(g)
    assert found == {(t, g): (len(groups[t]), len(groups[t][g // 4]), g == min(groups[t][g // 4])) for t, g in rows}
    monkeypatch.setattr(J, "HOT", 4)
    monkeypatch.setattr(J, "ONE_OF", 1)
    texts = [(k, " ".join(edited(rng, [f"v{i}" for i in range(80)], k % 3))) for k in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    hot = J._hot(df, {}, {}, 80, "doc_id", "text")
    entries = J._prefixes(df, {}, {}, 80, "text", hot).collect()
    assert hot and {r["token"] for r in entries if r["salt"] > 0} == set(hot)
    assert len({r["salt"] for r in entries if r["token"] == hot[0]}) > 1
    assert got(J.jaccard_components(df)) == brute(texts)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(df).collect() == []


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(J.op3_jaccard_join(spark, SF)) == brute(rows)


def test_blocks():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(60, 80)], rng.integers(0, 1 << 60, rng.integers(0, 15)).astype(np.uint64)])) for _ in range(50)]
    parts = [int(p) for p in rng.integers(0, 30, 50)]
    forest = J.block_links(list(range(50)), sets, parts)

    def classes(links):
        parent = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[root(a)] = root(b)
        return [tuple(j for j in range(50) if root(j) == root(i)) for i in range(50)]

    tied = [(i, j) for i in range(50) for j in range(i) if parts[i] == parts[j]]
    links = [(i, j) for i in range(50) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert classes(forest + tied) == classes(links + tied)


def test_stars(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            if a != b:
                parent[b] = a
    want = sorted((x, root(x)) for x in {y for ab in links for y in ab if y is not None} if root(x) != x)
    df = spark.createDataFrame(links, "a long, b long")
    assert sorted(map(tuple, K.components(df).collect())) == want
    assert K.components(df.limit(0)).collect() == []


def test_signatures():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(rng.permutation(base)[: rng.integers(1, 3000)]) for _ in range(60)] + [np.arange(1, n + 1, dtype=np.uint64) for n in (300, 310, 70_000, 71_000)]
    a, b = zip(*[(i, j) for i in range(len(sets)) for j in range(i)])
    keep = J.may_link([J.signature(sets[i]) for i in a], [J.signature(sets[j]) for j in b])
    link = [100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b)]
    assert all(k for k, x in zip(keep, link) if x) and any(link) and keep.mean() < 0.6


def test_long_words(spark):
    """Words beyond 4096 bytes whose stretches are exchanged are different words, whatever stands beside them."""
    a, b, c = "a" * 4096, "b" * 4096, "c" * 4096
    texts = [a + b, b + a, a + b, a + b + c, a + c + b, c + a + b, "x " + a + b + " y", "x " + b + a + " y", "a" * 20_000, "a" * 20_001]
    rows = [(k, t) for k, t in enumerate(texts)]
    assert got(J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    s = J.Shingles()
    together, alone = s([*texts, "a b c d e f g"]), [s([t])[0] for t in [*texts, "a b c d e f g"]]
    assert all(np.array_equal(x, y) for x, y in zip(together, alone))


def test_shared_numbers(spark):
    """Different sets that share 64 bits of their keys get numbers of their own."""
    rows = [(1, 0, 5, 7, b"k1"), (2, 0, 6, 7, b"k2"), (3, 0, 5, 7, b"k1"), (4, 0, 9, 8, b"k3"), (5, 0, 0, 9, b"")]
    numbered, known, taken = J._numbered(spark.createDataFrame([(*r[:4], bytearray(r[4])) for r in rows], "doc_id long, h long, n long, gid long, key binary"))
    gid = {r["doc_id"]: r["gid"] for r in numbered.collect()}
    assert gid[1] == gid[3] != gid[2] and gid[4] == 8 and gid[5] == 9 and {J.gid_of(k, taken) for k in (b"k1", b"k2")} == {gid[1], gid[2]}
    assert sorted((r["needed"], r["n"]) for r in known.collect()) == [(1, 5), (2, 6), (4, 9)]


def test_commonest(spark, monkeypatch):
    """As many of the most common tokens as may be taken, by count; of those with the last count only a part."""
    rng = random.Random(11)
    counts = {rng.randrange(-(1 << 63), 1 << 63): c for c in [*range(1, 40), *[7] * 300, *[5000, 5001, 10**6, 10**12]]}
    df = spark.createDataFrame(list(counts.items()), "token long, c long").repartition(5)
    for most in (0, 3, 20, 36, 100, 336, 341, 10_000):
        monkeypatch.setattr(J, "MOST_OFTEN", most)
        found = J._commonest(df, 4).tolist()
        assert found == sorted(found, key=lambda t: (counts[t], t)) and len(set(found)) == len(found) <= most
        assert not found or min(counts[t] for t in found) >= max([4, *[counts[t] for t in counts if t not in set(found)]])
        assert len(found) >= min(most, sum(c >= 4 for c in counts.values())) - 2
    assert J._commonest(df.limit(0), 4).tolist() == []


def test_often_seen_on_driver(spark, monkeypatch):
    """Often seen shingles reach the driver as numbers, not row by row, however many they are."""
    kinds, most = {DataFrame, type(spark.range(1))}, []
    for kind in kinds:
        monkeypatch.setattr(kind, "collect", lambda self, was=kind.collect: [most.append(len(rows := was(self))), rows][1])
    monkeypatch.setattr(J, "OFTEN", 2)
    rng = random.Random(12)
    bases = [[f"{k}w{i}" for i in range(1500)] for k in range(12)]
    texts = [(k, " ".join(edited(rng, bases[k % 12], k // 12 * 20))) for k in range(36)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    told = []
    monkeypatch.setattr(J, "_prefixes", lambda docs, last, *a, was=J._prefixes: [told.append(len(last)), was(docs, last, *a)][1])
    found = J.jaccard_components(df)
    assert max(told) > 4000 and sum(most) < max(told)
    assert got(found) == brute(texts)
