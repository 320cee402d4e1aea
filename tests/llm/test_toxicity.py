"""Nearest labelled examples against plain cosines, and held-out accuracy."""

import numpy as np
import pytest

from bindscape.llm import toxic_neighbours as X

SF = "/root/testdata/sf0.01"


def vectors(rng, n, features=60, most=8):
    out = []
    for k in range(n):
        ids = np.sort(rng.choice(features, rng.integers(1, most), replace=False)).astype(np.int32)
        w = rng.integers(1, 4, len(ids)).astype(float)
        out.append((int(k) * 7 + 3, ids, w / np.sqrt(w @ w)))
    return out


@pytest.mark.parametrize("size", [1, 8, 64])
def test_nearest_is_exact(size):
    rng = np.random.default_rng(size)
    rows = vectors(rng, 400)
    index = X.Index(rows, size)
    dense = np.zeros((400, 60))
    for p, i in enumerate(index.ids):
        _, ids, w = rows[(int(i) - 3) // 7]
        dense[p, ids] = w
    for _, ids, w in vectors(rng, 150):
        query = np.zeros(60)
        query[ids] = w
        cosines = np.round(dense @ query, 12)
        for but in (None, 17):
            want = sorted((-c, int(i)) for p, (c, i) in enumerate(zip(cosines, index.ids, strict=True)) if c > 0 and p != but)[:10]
            places, values = index.nearest(ids, w, 10, but)
            assert [int(i) for i in index.ids[places]] == [i for _, i in want]
            assert np.allclose(values, [-c for c, _ in want], atol=1e-9)


def test_bounds_skip_blocks():
    rows = [(k, np.array([k // 64], np.int32), np.array([1.0])) for k in range(6400)]
    index = X.Index(rows)
    index.nearest(np.array([5], np.int32), np.array([1.0]), 15)
    assert index.opened == 1


def test_isotonic():
    x, y = X.isotonic(np.array([0.1, 0.2, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 0.0, 1.0]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all()
    assert 0 < y[0] < 0.1 < y[2] < 0.5 < 0.9 < y[-1] < 1


def test_features():
    assert X.features("moron") == ["mor", "moro", "moron", "moron "]
    assert X.features("ab") == ["ab "]
    assert X.words("A a\tb1c_é É") == {"a": 2, "b": 1, "c": 1, "é": 2}


@pytest.fixture(scope="module")
def found(spark):
    return spark.createDataFrame(X.op11_toxic_neighbours(spark, SF).collect())


def test_held_out_accuracy(spark, found):
    rows = found.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.92
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_neighbours_are_examples(spark, found):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found.count() == docs.count()
    chosen = {r["doc_id"]: r["toxic"] for r in X.examples(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    held = {r["doc_id"] for r in found.where("held_out").collect()}
    assert chosen and not held & set(chosen)
    for r in found.collect():
        assert sum(chosen[i] for i in r["neighbours"]) == r["toxic_neighbours"]
        assert list(r["cosines"]) == sorted(r["cosines"], reverse=True)


def test_labels_held_out_are_not_read(spark, found):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted(X.scores(docs, turned).select("doc_id", "score").collect()) == sorted(found.select("doc_id", "score").collect())


def test_edges(spark):
    ids = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 5]
    rows = [(i, ["you awful goblin", "lovely day out"][i % 2] + " word" * (i % 5), "x", i) for i in ids]
    rows += [(None, None, "x", 1), (None, "goblin", "x", 1), (5000, "", "x", 1), (5001, "?!", "x", 1), (5002, "goblin " * 100_000, "x", 1), (5002, "goblin " * 100_000, "x", 1), (5003, "GOBLIN***", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score int").repartition(3).select("doc_id", "text")
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in ids] + [(ids[0], 0), (None, 1), (7777, 1)], "doc_id long, toxic int")
    out = X.scores(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[5002] > 0.9 and by[5003] > 0.9 and by[ids[2 - ids[0] % 2]] is not None
    assert by[5000] == by[5001] < 0.6
    assert {r["score"] > 0.9 for r in out if r["doc_id"] is None} == {True, False}
    assert X.scores(docs.limit(0), labels).collect() == []
    assert {r["score"] for r in X.scores(docs, labels.limit(0)).collect()} == {0.0}
