"""License scans, decontamination and URL filters against brute force."""

import random

import numpy as np
import pytest

from bindscape.llm import cgk_decontam as C
from bindscape.llm import license_scan as L
from bindscape.llm import link_trust as U

SF = "/root/testdata/sf0.001"


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_distance():
    rng = random.Random(2)
    for _ in range(300):
        item, text = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        assert C.edit_distance_inside(item, text, 99) == slow_distance(item, text)


def test_decontamination(spark):
    items = {r["item_id"]: C.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: C.normal(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in C.op10_cgk_decontam(spark, SF).collect()}
    assert {k for k, d in got.items() if d == 0} == {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    for (d, i), k in got.items():
        assert k <= 0.2 * len(items[i]) and (k == 0 or slow_distance(items[i], docs[d]) <= k)
    chosen = sorted(docs)[:25]  # every pair, by the exact distance alone
    want = {(d, i) for d in chosen for i, x in items.items() if C.edit_distance_inside(x, docs[d], int(0.2 * len(x) + 1e-9)) is not None}
    assert want == {k for k in got if k[0] in chosen}


def test_recall():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(40)) for k in range(60)]
    ready, docs = C.Benchmark(items), []
    for _, x in items * 3:
        x = list(x)
        for _ in range(len(x) // 10):
            p = rng.randrange(len(x))
            x[p : p + rng.randrange(2)] = rng.choice(["", "q", "w"])
        docs.append(C.normal(f"{text(50)} {''.join(x)} {text(30)}"))
    found = ready.search(docs)
    assert np.mean([k % 60 in f for k, f in enumerate(found)]) >= 0.95
    assert all(set(f) <= {k % 60} for k, f in enumerate(found))
    assert ready.search([text(200) for _ in range(50)]) == [{}] * 50


def test_decontamination_edges(spark):
    rows = [(1, None), (2, ""), (3, "a"), (None, "the quick brown fox jumps over the lazy dog and runs far away"), (4, "x " * 100_000), (5, "THE quick\nbrown  fox jumps over the lazy dog and runs far away!"), (5, "nothing here"), (6, "say tiny item now")]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, item_id string, distance int")
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog and runs far away"), (1, "The quick brown fox jumps over the lazy dog and runs far away"), (2, None), (3, "  "), (4, "tiny item")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in C.contaminated(docs, bench).collect())
    assert got == [(0, 1), (5, 1), (6, 4)]
    clean = C.keep_clean(docs, bench)
    assert clean.columns == docs.columns and sorted((r["doc_id"], (r["text"] or "")[:3]) for r in clean.collect()) == [(1, ""), (2, ""), (3, "a"), (4, "x x"), (5, "not")]
    assert C.contaminated(docs.limit(0), bench).collect() == [] and C.contaminated(docs, bench.limit(0)).collect() == []


def every_window(text):
    """Licenses by containment in any window of the template's class, without hashing bands."""
    words, found = [x for x in map(L.bare, (text or "").split()) if x], {}
    s = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    for name, _, t in L.TEMPLATES:
        w = [x for x in map(L.bare, t.split()) if x]
        t = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        c = 1 << (len(t) - 1).bit_length()
        stride = max(1, c // 4)
        for at in range(0, max(1, len(s)), stride):
            share = len(t & set(s[at : at + c + stride - 1])) / len(t)
            if share >= 0.8:
                found[name] = max(share, found.get(name, 0))
    return found


def phrases(text):
    """Short templates as words in a row."""
    words = " ".join(x for x in map(L.bare, (text or "").split()) if x)
    return {name for name, _, t in L.SHORT_TEMPLATES if f" {' '.join(filter(None, map(L.bare, t.split())))} " in f" {words} "}


def test_licenses(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice("alpha beta gamma delta public license the free".split()) for _ in range(n))
    texts = [None, "", "MIT", "x " * 100_000]
    for _, _, t in L.TEMPLATES * 3:
        w = t.upper().split() if rng.random() < 0.3 else t.split()
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = "changed"
        texts.append(f"{filler(rng.randrange(40))} {' '.join(w)}\n{filler(rng.randrange(40))}")
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[4], "x"), (9, texts[9], "x")], "doc_id long, text string, license string")
    got = {}
    for r in L.license_scan(docs).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = r["containment"]
    want = {i: f for i, t in enumerate(texts) if (f := every_window(t))} | {None: every_window(texts[4])}
    assert got == {k: pytest.approx(v) for k, v in want.items() if v}
    assert L.license_scan(docs.limit(0)).collect() == []
    plain = {r["doc_id"]: {*every_window(r["text"]), *phrases(r["text"])} for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {(r["doc_id"], r["license"]) for r in L.op9_license_scan(spark, SF).collect()}
    assert found == {(d, x) for d, f in plain.items() for x in f} and found


def test_band_guarantee():
    """At the lowest similarity that a contained template can have, bands miss at most one time in a thousand."""
    for c in (1, 2, 4, 8, 16, 32, 64, 128):
        window = c + max(1, c // 4) - 1
        for n in range(c // 2 + 1, c + 1):
            assert (1 - 0.8 * n / (window + 0.2 * n)) ** L.BANDS <= 0.001 or c == 1


def slow_rank(edges, seeds):
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    rank = {h: 0.15 for h in seeds}
    for _ in range(U.ROUNDS):
        new = {h: 0.15 for h in seeds}
        for (a, b), n in edges.items():
            if a in rank:
                new[b] = new.get(b, 0) + 0.85 * n / out[a] * rank[a]
        rank = new
    return rank


def test_urls(spark):
    rows = [
        (1, "http://A.Example.COM/en/x?y#z", None), (2, "https://www.example.com/en/", "<a href='http://linked.org/'>"), (3, "ftp://x.net/es/1", ""), (4, "http://net/fr/", None),
        (5, None, '<a href="http://x.org">'), (6, "no host", None), (7, "http://example.com", None), (8, "http://notcom/", None), (9, "http://x.net/en/", '<a HREF = //X.net/a><img src="https://bad.net/es/">'),
        (10, "http://bad.net/es/1", None), (11, "http://bad.net/fr/1", None), (12, "http://bad.net/en/1", None), (13, "http://spam.org/", '<a href="http://bad.net/fr/1">b</a>'),
        (14, "http://linked.org/", None), (15, "http://ÄB.net?q://c/fr/", None), (15, "http://ÄB.net?q://c/fr/", None), (None, "http://www.example.com/en/more", "<a href=http://linked.org/>"), (16, "http://com/\n/en", None),
    ]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(pages).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[3] == ("x.net", "/es/1", "net/es/", "block") and got[4] == ("net", "/fr/", "net/fr/", "block")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7] == ("example.com", "", None, "allow") and got[8] == ("notcom", "/", None, "allow")
    assert got[12][2:] == (None, "block") and got[13][2:] == (None, "block") and got[14][2:] == (None, "allow")
    assert got[15] == ("Äb.net", "", None, "allow") and got[16] == ("com", "/\n/en", "com/", "allow")
    assert len(U.judge(pages).collect()) == len(rows) and U.judge(pages.limit(0)).collect() == []


def test_ranks(spark):
    rng = random.Random(6)
    edges = {}
    for _ in range(60):
        a, b = rng.randrange(15), rng.randrange(15)
        if a != b:
            edges[f"h{a}", f"h{b}"] = rng.randrange(1, 4)
    seeds = ["h1", "h2", "lone"]
    got = {r["host"]: r["rank"] for r in U.propagate(spark.createDataFrame([(*k, v) for k, v in edges.items()], "src string, dst string, links long"), spark.createDataFrame([(h, 1.0) for h in seeds], "host string, seed double")).collect()}
    assert got == pytest.approx(slow_rank(edges, seeds))


def test_no_python_in_url_filter(spark):
    plan = U.op6_link_trust(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_recall_at_the_threshold():
    """Items of each length with random edits in exactly 20 % of their characters, without and with few spaces too."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    for size, recall in ((36, 1.0), (70, 0.95), (90, 0.95), (120, 0.95), (180, 0.95), (300, 0.95)):
        items = [(k, C.normal(" ".join(word() for _ in range(size)))[:size].strip()) for k in range(25)]
        items += [(k, "".join(rng.choice("etaoinshrdlu") for _ in range(size))) for k in range(25, 40)]
        docs = []
        for _, x in items * 3:
            y = list(x)
            for p in rng.sample(range(len(y)), len(y) // 5):
                y[p] = rng.choice(["", rng.choice("etao"), y[p] + rng.choice("etao")])
            docs.append(C.normal(f"{' '.join(word() for _ in range(9))} ({''.join(y)}) {word()}"))
        found = C.Benchmark(items).search(docs)
        near = [C.edit_distance_inside(items[k % 40][1], t, len(items[k % 40][1]) // 5) is not None for k, t in enumerate(docs)]
        assert np.mean([k % 40 in f for k, f in enumerate(found) if near[k]]) >= recall, size


def test_verbatim_anywhere():
    """Quoted, bracketed and inside text without spaces."""
    rng = random.Random(10)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    items = ["what is the capital of south africa?", "https://example.org/a/very/long/path/of/a/page?with=arguments", han(40), han(90), han(400), "x = {k: v for k, v in table.items() if v is not None and k in seen_before_now}", "ab", "a" * 200]
    ready = C.Benchmark(list(enumerate(items)))
    for k, x in enumerate(items):
        docs = [a + x + b for a, b in (("“", "”"), ("see(", ")"), (han(50), han(50)), ("", ""), ("z", "z"))]
        assert [f.get(k) for f in ready.search(docs)] == [0] * 5, x
    assert ready.search(["", "nothing"]) == [{}, {}]


def test_short_licenses(spark):
    """Against a search for the words in a row."""
    words = lambda t: [x for x in map(L.bare, (t or "").split()) if x]
    texts = [None, "", "All rights", "(c) 2020 Acme. All Rights Reserved.", "all rights are reserved", "// SPDX-License-Identifier: MIT", "x SPDX-License-Identifier: (GPL-2.0+) y all\nrights reserved", "SPDX-License-Identifier: nothing", "all rights reserved"]
    want = set()
    for i, t in enumerate(texts):
        for name, _, phrase in L.SHORT_TEMPLATES:
            w, p = words(t), words(phrase)
            if any(w[k : k + len(p)] == p for k in range(len(w))):
                want.add((i, name, 1.0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["doc_id"], r["license"], r["containment"]) for r in L.license_scan(docs).collect()} == want and len(want) == 5


def test_short_and_long_of_one_license():
    scan = L.Scanner((("A", "x", "tiny notice"), ("A", "x", "one two three four five six"))).scan
    assert scan("a one two three four five six")["A"][1] == 1.0 and scan("z tiny notice. tiny notice")["A"] == ("x", 1.0, 1) and scan("tiny") == {}


def test_long_chain(spark):
    """Further than the rounds of the SQL: a host 16 links before a blocked seed, and a loop with its solution in closed form."""
    pages = [(k, f"http://h{k}.org/", f'<a href="http://h{k + 1}.org/">') for k in range(15)] + [(15, "http://h15.org/", '<a href="http://bad.net/es/">'), (16, "http://bad.net/es/", None), (17, "http://far.org/", None)]
    got = {r["page_id"]: (r["verdict"], r["distrust"]) for r in U.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {v for k, (v, _) in got.items() if k < 17} == {"block"} and got[17] == ("allow", 0.0)
    assert all(got[k][1] == pytest.approx(0.15 * 0.85 ** (16 - k), rel=1e-9) for k in range(17))
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "src string, dst string, links long")
    rank = {r["host"]: r["rank"] for r in U.converged(edges, spark.createDataFrame([("a", 1.0)], "host string, seed double"), change=1e-2).collect()}
    assert rank == pytest.approx({"a": 0.15 / (1 - 0.85**2), "b": 0.15 * 0.85 / (1 - 0.85**2)}, rel=0.1) and rank["a"] > 0.15 * (1 - 0.85**24) / (1 - 0.85**2)
