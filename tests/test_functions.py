"""DNA and array functions against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from bindscape.functions import arrays, dna

RNG = random.Random(1)
SEQS = ["".join(RNG.choice("ACGT") for _ in range(RNG.randrange(1, 30))) for _ in range(200)]


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame([(s,) for s in SEQS], "seq string").cache()


def test_codes(seqs):
    for r in seqs.select("seq", dna.encode("seq").alias("c"), dna.decode(dna.encode("seq"), F.length("seq")).alias("d"), dna.reverse_complement("seq").alias("rc"), dna.reverse_complement(dna.reverse_complement("seq")).alias("again")).collect():
        code = 0
        for c in r["seq"]:
            code = 4 * code + "ACGT".index(c)
        assert r["c"] == code and r["d"] == r["seq"] == r["again"] and r["rc"] == rc(r["seq"])


def test_windows_and_runs(seqs):
    for r in seqs.select("seq", dna.windows("seq", 4).alias("w"), dna.longest_run("seq", "A").alias("run"), dna.base_count("seq", "G").alias("g"), dna.is_repetitive("seq", 6, 3).alias("rep")).collect():
        s = r["seq"]
        assert r["w"] == [s[i : i + 4] for i in range(len(s) - 3)] and r["g"] == s.count("G")
        assert r["run"] == max((n for n in range(len(s) + 1) if "A" * n in s), default=0)
        assert r["rep"] == any(s.count(b) >= 6 and b * 3 in s for b in "ACGT")


def test_documented_example(spark):
    """A model of four bases on ACGTTG has three places."""
    assert spark.createDataFrame([("ACGTTG",)], "s string").select(dna.windows("s", 4).alias("w")).first()["w"] == ["ACGT", "CGTT", "GTTG"]


def test_base_index_and_validation(spark):
    rows = spark.createDataFrame([(c,) for c in ["a", "C", "g", "T", "u", "U", "n", "N", "x", "-", ""]], "c string")
    assert [r["i"] for r in rows.select(dna.base_index("c").alias("i")).collect()] == [0, 1, 2, 3, 3, 3, 4, 4, -1, -1, -1]
    bad = spark.createDataFrame([("ACGT",), ("AXG",)], "s string")
    assert [r["v"] for r in bad.select(dna.is_sequence("s").alias("v")).collect()] == [True, False]
    with pytest.raises(Exception, match="not a sequence"):
        bad.select(dna.checked("s")).collect()


def test_mutation(seqs):
    for r in seqs.select("seq", dna.mutate_one("seq", "seq").alias("m")).collect():
        assert len(r["m"]) == len(r["seq"]) and sum(a != b for a, b in zip(r["m"], r["seq"])) == 1
    m = dna.mutants(seqs.limit(3)).collect()
    assert len(m) == 4 * sum(len(r["seq"]) for r in seqs.limit(3).collect())
    assert all(r["mutant"] == r["seq"][: r["pos"] - 1] + r["base"] + r["seq"][r["pos"] :] for r in m)


def test_ids(spark):
    r = spark.createDataFrame([("D00102.002",), ("D0102.002",), (None,)], "t string").select(dna.model_id("t").alias("m")).collect()
    assert tuple(r[0]["m"]) == (102, 2) and r[1]["m"] is None and r[2]["m"] is None
    assert spark.range(1).select(dna.format_model_id(F.lit(102), F.lit(2)).alias("f")).first()["f"] == "D00102.002"


def test_arrays(spark):
    a, b = [3.0, -1.0, 2.0, 3.0, 0.5, -2.0], [1.0, 2.0, -3.0, 0.0, 4.0, 1.0]
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    one = lambda c: df.select(c.alias("x")).first()["x"]
    assert one(arrays.total("a")) == sum(a) and one(arrays.mean("a")) == sum(a) / 6
    assert one(arrays.which_largest("a")) == 0 and one(arrays.which_smallest("a")) == 5
    assert one(arrays.dot("a", "b")) == sum(x * y for x, y in zip(a, b)) and one(arrays.sq_dist("a", "b")) == sum((x - y) ** 2 for x, y in zip(a, b))
    assert one(arrays.block_reverse("a", 2)) == a[4:] + a[2:4] + a[:2]
    assert one(arrays.shift_left("a", 2)) == a[2:] + [0, 0] and one(arrays.shift_right("a", 9)) == [0] * 6 and one(arrays.shift_right("a", 1)) == [0] + a[:-1]
    assert one(arrays.cat("a", F.lit(None).cast("array<double>"), "b")) == a + b and one(arrays.ones(3)) == [1, 1, 1]
    assert one(arrays.add_scaled("a", "b", 2)) == [x + 2 * y for x, y in zip(a, b)] and one(arrays.over_largest("a")) == [x / 3 for x in a]
    assert one(arrays.norm("a")) == pytest.approx(sum(x * x for x in a) ** 0.5) and one(arrays.any_true(F.array(F.lit(False), F.lit(True))))
    assert one(arrays.frobenius(F.array("a", "b"))) == pytest.approx(sum(x * x for x in a + b) ** 0.5)
