"""Quality and language classifiers: identities, held-out accuracy, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from bindscape.llm import language_id as L
from bindscape.llm import quality_fm as Q

SF = "/root/testdata/sf0.01"
ODD = [(1, None, None, None), (2, "", "en", 0), (None, "words without an id", "en", 5), (3, "x" * 200_000, "en", 7), (4, "1234 !!! 567", None, 3), (5, "漢字 と かな", "ja", 3), (5, "漢字 と かな", "ja", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 3) for r in ODD], "doc_id long, text string, lang string, n_chars long, score string, predicted int")


def test_sum_of_squares_identity():
    m, rng = Q.FactorisationMachine(), np.random.default_rng(1)
    ids, x = rng.choice(Q.FEATURES, 30, replace=False), rng.normal(size=30).astype(np.float32)
    v = m.factors[ids]
    pairs = sum(float(v[i] @ v[j]) * float(x[i] * x[j]) for i in range(30) for j in range(i))
    assert abs(m.raw(ids, x) - pairs) < 1e-4


def test_quality(spark, odd):
    rows = {r["doc_id"]: r for r in Q.op5_quality_fm(spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(rows[i]["predicted"], q) for i, q in labels.items() if rows[i]["held_out"]]
    assert len(held) > 50 and sum(p == q for p, q in held) / len(held) > 0.95
    model = Q.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    got = Q.with_score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got) and got[0].asDict().keys() == {*odd.columns}
    assert Q.keep_good(odd, model).columns == odd.columns
    assert Q.with_score(odd.limit(0), model).collect() == []
    blank = Q.train(odd.limit(0), spark.read.parquet(f"{SF}/labels.parquet").limit(0))
    assert all(0 <= r["score"] <= 1 for r in Q.with_score(odd, blank).collect())


def test_quality_ignores_what_it_must(spark):
    """Held-out labels, lang, source and doc_id do not move a score."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    a = Q.train(docs, labels)
    b = Q.train(docs.withColumn("lang", F.lit("zz")), labels.withColumn("quality", F.when(Q.may_learn(), F.col("quality")).otherwise(1 - F.col("quality"))))
    assert np.array_equal(a.factors, b.factors)


def test_language(spark, odd):
    got = L.op8_language_id(spark, SF).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [(r["lang_pred"], truth[r["doc_id"]]) for r in got if r["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    model = L.train(spark.read.parquet(f"{SF}/documents.parquet"))
    assert 0.2 < (model.weights == 0).mean() < 1  # the L1 penalty leaves a sparse model
    rows = L.predict(odd, model).collect()
    assert [r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 4)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == len(ODD)
    assert L.predict(odd.limit(0), model).collect() == []
    assert {r["lang_pred"] for r in L.predict(odd, L.train(odd.limit(0))).collect()} == {"und"}


def test_grams_by_hand():
    """Every gram of every word, one by one; texts longer than a part, words across its end, letters by Unicode."""
    import regex

    def slow(text):
        out = Counter()
        for word in regex.findall(r"\p{L}+", text.lower()):
            w = f"\0{word}\0"
            out.update(w[i : i + n] for n in range(1, 5) for i in range(len(w) - n + 1) if w[i : i + n] != "\0")
        return out

    rng = random.Random(3)
    texts = ["a", "ab c", "ÜBER naïve 漢字 x", "½ ² ³ 12 _", "", "a" * 70_000 + " b", " ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(20_000))]
    for t in texts:
        want, got = slow(t), L.count_grams(t)
        if not want:
            assert got is None
            continue
        assert got[1].sum() == sum(want.values())
        assert 0.9 * len(want) <= len(got[0]) <= len(want)  # a few grams share a number
    one = {g: L.count_grams(g)[0].tolist() for g in "abc"}
    assert all(len(x) == 4 for x in one.values())  # a, mark a, a mark, mark a mark
    assert set(one["a"]) & set(L.count_grams("xa ab")[0].tolist()) and L.count_grams("a b")[1].sum() == 8


def test_ftrl_by_hand():
    """TF-IDF, the regularised leader and the probabilities against plain loops over dicts."""
    rng, rows, labels = np.random.default_rng(8), [], []
    for k in range(24):
        ids = np.sort(rng.choice(40, 6, replace=False)).astype(np.int32)
        rows.append((ids, rng.integers(1, 4, 6).astype(np.float32)))
        labels.append(int(ids[0] > 3) + (k % 5 == 0))
    model = L.LanguageModel(["x", "y", "z"]).fit(rows, labels, epochs=2)
    df = Counter(int(g) for ids, _ in rows for g in ids)
    idf = {g: math.log((1 + 24) / (1 + n)) + 1 for g, n in df.items()}

    def vector(ids, counts):
        x = {int(g): float(c) * idf[int(g)] for g, c in zip(ids, counts)}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {g: v / norm for g, v in x.items()} | {"bias": 1.0}

    z, g2 = {}, {}

    def weight(g, c):
        a, l1 = z.get((g, c), 0.0), 0.0 if g == "bias" else 0.02
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((1.0 + math.sqrt(g2.get((g, c), 0.0))) / 0.5 + 0.01)

    order = np.random.default_rng(3)
    for _ in range(2):
        for k in order.permutation(np.arange(24)):
            x = vector(*rows[k])
            w = {(g, c): weight(g, c) for g in x for c in range(3)}
            y = [sum(x[g] * w[g, c] for g in x) for c in range(3)]
            p = [math.exp(v - max(y)) for v in y]
            p = [v / sum(p) - (c == labels[k]) for c, v in enumerate(p)]
            for g in x:
                for c in range(3):
                    grad = x[g] * p[c]
                    old = g2.get((g, c), 0.0)
                    z[g, c] = z.get((g, c), 0.0) + grad - (math.sqrt(old + grad * grad) - math.sqrt(old)) / 0.5 * w[g, c]
                    g2[g, c] = old + grad * grad
    for g in df:
        assert [weight(g, c) for c in range(3)] == pytest.approx(model.weights[g].tolist(), abs=1e-4)
    assert [weight("bias", c) for c in range(3)] == pytest.approx(model.bias.tolist(), abs=1e-4)
    y = [sum(v * weight(g, c) for g, v in vector(*rows[0]).items()) for c in range(3)]
    p = [math.exp(v) / sum(map(math.exp, y)) for v in y]
    assert model.predict(rows[0]) == (["x", "y", "z"][int(np.argmax(p))], pytest.approx(max(p), abs=1e-4))


def test_frequencies_of_all_rows(spark):
    """Document frequencies come from every row that may be learnt from, not from the sample alone; no label is left out."""
    rows = [(k, f"word{chr(97 + k % 7)} text", f"l{k % 300:03d}") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = [t for k, t, _ in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    model = L.train(docs, per_lang=1, max_train=310)
    assert model.langs == sorted({x for k, _, x in rows if zlib.crc32(str(k).encode()) % 3 != 1}) and len(model.langs) > 256
    df = Counter(g for t in learnt for g in L.count_grams(t)[0].tolist())
    for g, n in df.items():
        assert model.idf[g] == pytest.approx(math.log((1 + len(learnt)) / (1 + n)) + 1, rel=1e-5)
    with pytest.raises(ValueError):
        L.train(docs, max_train=256)


def test_language_needs_letters(spark):
    model = L.train(spark.read.parquet(f"{SF}/documents.parquet"))
    docs = spark.createDataFrame([(1, "½ ² ³"), (2, "_ ٣ Ⅷ ①"), (3, "½ a")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(docs, model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] != "und"


def test_machine_by_hand():
    """Fit and score of a tiny machine against plain loops over pairs of features."""
    rng, rows, labels = np.random.default_rng(4), [], []
    for k in range(12):
        rows.append((np.sort(rng.choice(9, 4, replace=False)).astype(np.int32), rng.random(4).astype(np.float32)))
        labels.append(int(rows[-1][0][0] < 2))
    model, start = Q.FactorisationMachine(), Q.FactorisationMachine()
    model.fit(rows, labels, epochs=3)
    w0, w, v = 0.0, [0.0] * 9, start.factors[:9].astype(float).tolist()
    g0, gw, gv = 1e-6, [1e-6] * 9, [[1e-6] * Q.RANK for _ in range(9)]

    def raw(ids, x):
        y = w0 + sum(w[i] * a for i, a in zip(ids, x))
        return y + sum(v[i][f] * v[j][f] * x[p] * x[q] for p, i in enumerate(ids) for q, j in enumerate(ids) if p < q for f in range(Q.RANK))

    order = np.random.default_rng(11)
    for _ in range(3):
        for k in order.permutation(12):
            ids, x = rows[k][0].tolist(), rows[k][1].tolist()
            error = 1 / (1 + math.exp(-raw(ids, x))) - labels[k]
            sums = [sum(v[i][f] * a for i, a in zip(ids, x)) for f in range(Q.RANK)]
            g0 += error**2
            w0 -= 0.08 * error / math.sqrt(g0)
            for i, a in zip(ids, x):
                grad = error * a + 1e-4 * w[i]
                gw[i] += grad**2
                w[i] -= 0.08 * grad / math.sqrt(gw[i])
                for f in range(Q.RANK):
                    grad = error * (a * sums[f] - a * a * v[i][f]) + 1e-4 * v[i][f]
                    gv[i][f] += grad**2
                    v[i][f] -= 0.08 * grad / math.sqrt(gv[i][f])
    for ids, x in rows:
        assert model.score(ids, x) == pytest.approx(1 / (1 + math.exp(-raw(ids.tolist(), x.tolist()))), abs=1e-3)


def test_packed_sums_in_levels(spark, monkeypatch):
    from bindscape.llm import common

    rows = np.arange(90 * 5).reshape(90, 5)
    df = spark.createDataFrame([(bytearray(r.astype(np.int64).tobytes()),) for r in rows], "v binary").repartition(9)
    for fan in (4, 64, 1000):
        monkeypatch.setattr(common, "FAN", fan)
        assert common.packed_sum(df, 5).tolist() == rows.sum(axis=0).tolist()
    assert common.packed_sum(df.limit(0), 5).tolist() == [0] * 5


def test_repeated_ids_fit_the_same_model(spark):
    """Which rows are learnt from depends on no order, and an id that comes often counts once."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    twice = docs.union(docs).repartition(7)
    a, b = Q.train(docs, labels, 60), Q.train(twice, labels.repartition(5), 60)
    assert a.bias == b.bias and (a.linear == b.linear).all()
    c, d = L.train(docs, 20, 60), L.train(twice, 20, 60)
    assert c.langs == d.langs
