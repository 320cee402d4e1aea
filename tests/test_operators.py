"""Counting, comparison, registries, networks, densities, sources, sinks and streams."""

import gzip
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bindscape.functions import arrays
from bindscape.operators import compare, convnet, dos, fitting, probes, registry, scoring
from bindscape.operators.params import Mode, Model
from bindscape.plans import registry as plans
from bindscape.plans.catalog import toy_mode
from bindscape.sources import models, reads
from bindscape.streaming import counts

RNG = random.Random(3)


def test_counts_and_splits(spark):
    seqs = ["".join(RNG.choice("ACGT") for _ in range(4)) for _ in range(400)]
    c = probes.count_probes(spark.createDataFrame([(s,) for s in seqs], "seq string"))
    assert {r["seq"]: r["cnt"] for r in c.collect()} == {s: seqs.count(s) for s in set(seqs)}
    s = {r["seq"]: (r["train"], r["test"]) for r in probes.split_reads(c, 0.5).collect()}
    assert all(sum(v) == seqs.count(k) for k, v in s.items()) and 0.4 < sum(v[1] for v in s.values()) / 400 < 0.6
    assert s != {r["seq"]: (r["train"], r["test"]) for r in probes.split_reads(c, 0.5, 1).collect()}
    k = probes.removed_reads(c, 3, 3).first()
    assert k["kept"] + k["removed"] == 400
    e = c.limit(0)
    assert probes.removed_reads(e).first()["kept"] == 0 and probes.combine(e, c).count() == c.count()


def test_histogram_edges(spark):
    v = spark.createDataFrame([(0.0, 1), (1.0, 2), (1.5, 1), (2.0, 3), (2.1, 9), (-1.0, 9)], "score double, cnt int")
    assert [r["n"] for r in compare.histogram(v, [0.0, 1.0, 2.0]).orderBy("bin").collect()] == [0.0, 3.0, 4.0]


def test_roc(spark):
    rows = [(float(RNG.randrange(6)), RNG.randrange(2)) for _ in range(60)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert compare.auroc(compare.roc(df)).first()["auroc"] == pytest.approx(want)
    turned = df.withColumn("score", -F.col("score"))
    assert compare.auroc(compare.roc(turned)).first()["auroc"] == pytest.approx(1 - want)


def test_rescaled_density(spark):
    d = {r["s"]: r["density"] for r in compare.rescale_density(spark.createDataFrame([(float(s),) for s in (0, 100, 800, 900)], "s double")).collect()}
    assert d[0.0] == d[100.0] == 0 and 0 < d[800.0] < d[900.0] < float("inf")


def test_registry(spark):
    cols = "k int, run string, stamp int, train double, test double"
    old = spark.createDataFrame([(1, "a", 1, 5.0, 4.0), (2, "a", 1, 3.0, None), (3, "a", 1, None, None)], cols)
    new = spark.createDataFrame([(1, "a", 2, 6.0, None), (2, "b", 2, 2.0, 1.0), (4, "b", 2, 9.0, None)], cols)
    got = {r["k"]: tuple(r) for r in registry.upsert(old, new, key=("k",), merged=("test",)).collect()}
    assert got[1] == (1, "a", 2, 6.0, 4.0) and got[2] == (2, "b", 2, 2.0, 1.0) and set(got) == {1, 2, 3, 4}
    assert registry.best_fit(old).first()["k"] == 2
    merged, other = registry.append_results(old, new, ("run",), key=("k",))
    assert merged.count() == 3 and other.count() == 2
    with pytest.raises(LookupError, match="several"):
        registry.lookup(old, F.col("run") == "a")
    with pytest.raises(LookupError, match="no fit"):
        registry.lookup(old, F.col("k") == 9)


def slow_net(net, seq):
    def strand(x):
        d, m, _ = net.detectors.shape
        out = []
        for k in range(d):
            vals = []
            for i in range(len(x) + m - 1):
                s = net.thresholds[k]
                for j in range(m):
                    p = i - m + 1 + j
                    s += net.detectors[k, j, x[p]] if 0 <= p < len(x) and x[p] < 4 else net.detectors[k, j].mean()
                vals.append(max(0.0, s))
            out += [max(vals)] + ([sum(vals) / len(vals)] if net.avg else [])
        return float(net.biases1[0] + np.dot(net.weights1, out))

    def scan(x):
        w = net.window
        return strand(x) if len(x) <= w else max(strand(x[i : i + w]) for i in range(len(x) - w + 1))

    x = ["ACGTN".index(c) for c in seq]
    return max(scan(x), scan([3 - c if c < 4 else 4 for c in reversed(x)])) if net.reverse_complement else scan(x)


def net_text(rc=1, avg=1, hidden=0):
    rng = np.random.default_rng(1)
    d, m = 2, 3
    pooled = d * (1 + avg)
    nums = lambda n: ",".join(f"{v:.3f}" for v in rng.normal(size=n))
    lines = [f"reverse_complement = {rc}", f"num_detectors = {d}", f"detector_len = {m}", f"has_avg_pooling = {avg}", f"num_hidden = {hidden}", f"detectors = {nums(4 * d * m)}", f"thresholds = {nums(d)}", f"weights1 = {nums(pooled * max(1, hidden))}", f"biases1 = {nums(max(1, hidden))}", f"weights2 = {nums(hidden)}", f"biases2 = {nums(1) if hidden else ''}"]
    return "\n".join(["# net 0.1", *lines])


@pytest.mark.parametrize("rc,avg", [(1, 1), (0, 1), (1, 0)])
def test_net(spark, rc, avg):
    net = convnet.parse(net_text(rc, avg))
    seqs = ["".join(RNG.choice("ACGTN") for _ in range(n)) for n in (1, 3, 4, 9, 12) for _ in range(3)] + [None]
    got = convnet.net_score(spark.createDataFrame([(s,) for s in seqs], "seq string"), net).collect()
    for r in got:
        assert r["score"] is None if r["seq"] is None else r["score"] == pytest.approx(slow_net(net, r["seq"]), abs=1e-4)
    with pytest.raises(ValueError):
        convnet.parse("# net 0.2\n")
    with pytest.raises(ValueError):
        convnet.parse(net_text().replace("thresholds = ", "thresholds = 1,"))
    assert np.isfinite(convnet.score_sequence(convnet.parse(net_text(hidden=2)), "ACGT"))


def test_density_of_states(spark):
    weights = toy_mode(5).nuc
    exact = {round(r["score"], 6): r["s"] for r in dos.exact_density(dos.all_sequences(spark, 5).withColumn("score", scoring.weight_term(F.col("seq"), toy_mode(5))), 0.5).collect()}
    tasks = spark.createDataFrame([("x", 1), ("y", 2)], "task string, seed int")
    got = dos.normalized(dos.densities(tasks, lambda t: lambda x: float(weights[np.arange(5), x].sum()), 5, -3.0, 3.0, 0.5, tolerance=1e-4), 5, ["task"])
    for r in got.collect():
        assert r["s"] == pytest.approx(exact[round(r["score"], 6)], abs=0.2)


def test_fastq(spark, tmp_path):
    regions = ["".join(RNG.choice("ACGT") for _ in range(6)) for _ in range(20)]
    text = "".join(f"@read{i}\nAC{r}GT\n+\nIIIIIIIIII\n" for i, r in enumerate(regions)) + "@bad\nACNNNNNNGT\n+\nIIIIIIIIII\n"
    (tmp_path / "a.fastq").write_text(text)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write(text)
    for name in ("a.fastq", "b.fastq.gz"):
        got = [r["seq"] for r in reads.read_fastq(spark, str(tmp_path / name), 6, "AC", "GT").collect()]
        assert sorted(got) == sorted(regions)


def test_sequence_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one first\nACGT\nAC\n>two\nTTT\n")
    (tmp_path / "y.seq").write_text("ACG\n\nTTTT\n")
    assert sorted(map(tuple, reads.read_sequences(spark, str(tmp_path / "x.fa")).collect())) == [("one first", "ACGTAC"), ("two", "TTT")]
    assert [r["seq"] for r in reads.read_sequences(spark, str(tmp_path / "y.seq")).collect()] == ["ACG", "TTTT"]
    (tmp_path / "z.ids").write_text("# ids\nD00001.001  # first\n\n  D00002.003\n")
    assert [r["id"] for r in reads.read_ids(spark, str(tmp_path / "z.ids")).collect()] == ["D00001.001", "D00002.003"]


def test_tables(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("ProtName\tDesign\tfirst\tsecond\nA\tx\tf0\tf1\nB\tx\tNA\tf1\n")
    t = reads.read_tsv(spark, str(tmp_path / "d.tsv"), "data_sets")
    assert [r["ProtName"] for r in reads.usable_data_sets(t, "R0_File", "R1_File").collect()] == ["A"]
    dens = spark.createDataFrame([(2.0, 1.5), (1.0, 0.5)], "score double, s double")
    reads.write_density(dens, str(tmp_path / "dos"))
    assert list(map(tuple, reads.read_tsv(spark, str(tmp_path / "dos"), "density").collect())) == [(1.0, 0.5), (2.0, 1.5)]
    c = spark.createDataFrame([("ACGT", 2), ("AAAA", 1)], "seq string, cnt long")
    reads.write_counts(c, str(tmp_path / "counts"))
    assert sorted(map(tuple, reads.read_counts(spark, str(tmp_path / "counts"), 4, 4).collect())) == [("ACGT", 2)]


def test_shapes(spark, tmp_path):
    (tmp_path / "HelT.csv").write_text('"","a","b","c"\n"ACGTA",1.5,"x",2.5\n"CCCCC",3,"x",4\n')
    (tmp_path / "MGW.csv").write_text("x,a\nACGTA,9\nCCCCC,8\n")
    tables = {n: reads.read_shape(spark, str(tmp_path / f"{n}.csv"), n) for n in ("HelT", "MGW")}
    got = sorted((r["pentamer"], r["feature_no"], r["value"]) for r in reads.choose_shapes(tables, ["HelT", "MGW"]).collect())
    assert got == [("ACGTA", 0, 9.0), ("ACGTA", 1, 1.5), ("ACGTA", 2, 2.5), ("CCCCC", 0, 8.0), ("CCCCC", 1, 3.0), ("CCCCC", 2, 4.0)]
    assert reads.shape_matrix(reads.choose_shapes(tables, ["MGW"])).shape == (1024, 1)
    for bad in ([], ["MGW", "MGW"], ["Odd"], ["Roll"]):
        with pytest.raises(ValueError):
            reads.choose_shapes(tables, bad)


def test_config():
    text = "a = 1 # one\nB= 'two' ; x\nc = \"3\"\na = 4\n# a = 5\nopt = N/A\n"
    assert reads.parse_config(text, {"opt"}) == {"a": "4", "b": "two", "c": "3", "opt": None}
    assert reads.fill_template("l=LEN lf=LENF", {"LEN": 3, "LENF": "AC"}) == "l=3 lf=AC"


def test_model_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    mode = Mode(rng.normal(size=(3, 4)), rng.normal(size=(2, 16)), rng.normal(size=(3, 2)))
    fits = [fitting.Fit(Model([mode], -1.5), 10.0, 1.0, 0.5, 3, 4), fitting.Fit(Model([Mode(mode.nuc), Mode(mode.nuc * 2)]), 9.0, 0.9, 0.4, 3, 4)]
    models.write_fits(spark, fits, str(tmp_path / "fits"), {"shapes": ("ProT",), "NuSym": "1,-1"})
    rows = models.load_fits(spark, str(tmp_path / "fits")).orderBy("TrainL").collect()
    assert [r["k"] for r in rows] == ["Multi", "3"] and rows[1]["NS"] and not rows[0]["NS"] and rows[0]["TrainL"] == 9.0 and rows[0]["Time"] is None and rows[0]["PT"] and not rows[0]["MG"] and rows[0]["NuSym"] == "1.-1"
    a, b = models.model_of(rows[1]), models.model_of(rows[0])
    assert a.vector() == pytest.approx(fits[0].model.vector()) and b.vector() == pytest.approx(fits[1].model.vector())
    assert "non-specific: -1.5" in models.report(fits) and "folds: 5" in models.report(fits, run={"folds": 5})
    from bindscape.operators.background import Background

    bg = Background(rng.normal(size=16), 2, 5, "ACG", "TTT")
    models.write_backgrounds(spark, [(bg, {"TrainL": 3.0})], str(tmp_path / "bg"))
    r = models.load_backgrounds(spark, str(tmp_path / "bg")).first()
    assert r["k"] == 2 and r["isFlank"] and r["beta"] == pytest.approx(bg.beta.tolist()) and r["TrainL"] == 3.0 and r["seed"] is None


def test_foreign_model_lines(spark, tmp_path):
    """Lines written by hand in the columns' order: one mode with everything, two modes with tags left out, quotes, NA."""
    head = ",".join(models.FIT_COLUMNS)
    one = "0,2016-01-02,12.5,30,44,2,3,TRUE,TRUE,FALSE,TRUE,FALSE,FALSE,1.-1,NA,-1,-2.5,100.5,2.01,0.11,2.02,0.12,1.0E-6,4,AC,NB>,1,2,3,4,5,6,7,8,DB>," + ",".join(map(str, range(16))) + ",SB>,0.1,0.2,NSB>,-2.5,NE>,1,1,1,1,1,1,1,1,NSBE>,0.5,NS>,0,0,0,0,0,0,0,0,NSBS>,-1,<EOL>"
    two = '"1",2016-01-03,1,2,3,NA,0,TRUE,FALSE,FALSE,FALSE,FALSE,FALSE,NA,NA,NA,-1.5,90,1.8,0.1,NA,NA,0,NA,NA,NB>,1,2,3,4,NE>,9,9,9,9,NB>,5,6,7,8,9,10,11,12,NSB>,-1.5,NSBE>,0.25,<EOL>,ignored'
    (tmp_path / "fits.csv").write_text("\n".join([head, one, "", two]) + "\n")
    a, b = models.load_fits(spark, str(tmp_path / "fits.csv")).orderBy(F.desc("TrainL")).collect()
    assert (a["Time"], a["FitTime"], a["FitSteps"], a["FncCalls"], a["k"], a["Flank"], a["NS"], a["Di"], a["MG"], a["PT"]) == ("2016-01-02", 12.5, 30, 44, "2", 3, True, True, False, True)
    assert (a["NuSym"], a["DiSym"], a["Shift"], a["NSBind"], a["TrainL"], a["TrainLPerRead"], a["AdjTrainLPerRead"], a["TestLPerRead"], a["AdjTestLPerRead"], a["Lambda"], a["NullVectors"], a["PSAM"]) == ("1.-1", None, -1, -2.5, 100.5, 2.01, 0.11, 2.02, 0.12, 1e-6, 4, "AC")
    v = a["values"][0]
    assert len(a["values"]) == 1 and v["NB"] == list(range(1, 9)) and v["DB"] == list(range(16)) and v["SB"] == [0.1, 0.2] and v["NSB"] == [-2.5] and v["NE"] == [1] * 8 and v["DE"] == [] and v["NSBE"] == [0.5] and v["NS"] == [0] * 8 and v["NSBS"] == [-1]
    x, y = b["values"]
    assert b["k"] == "Multi" and x["NB"] == [1, 2, 3, 4] and x["NE"] == [9] * 4 and x["NSB"] == [] and y["NB"] == list(range(5, 13)) and y["NSB"] == [-1.5] and y["NSBE"] == [0.25] and y["NE"] == []
    m = models.model_of(b)
    assert [q.k for q in m.modes] == [1, 2] and m.ns == -1.5 and models.model_of(a).flank == 3
    (tmp_path / "bg.csv").write_text(",".join(models.BACKGROUND_COLUMNS) + "\n0,2016,1.5,2,3,1,,TRUE,10,2,1,NA,NA,NA,,B>,1,2,3,4,S>,5,6,7,8,<EOL>\n1,2016,1.5,2,3,1,FALSE,11,2,1,3,4,0.5,B>,1,2,3,4,<EOL>\n")
    a, b = models.load_backgrounds(spark, str(tmp_path / "bg.csv")).orderBy("TrainL").collect()
    assert (a["isFlank"], a["TrainL"], a["TestLPerRead"], a["beta"], a["seed"]) == (True, 10, None, [1, 2, 3, 4], [5, 6, 7, 8])
    assert (b["isFlank"], b["TrainL"], b["TestLPerRead"], b["MarkovModelDiff"], b["beta"], b["seed"]) == (False, 11, 3, 0.5, [1, 2, 3, 4], None)


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([("ACGT",), ("AAAA",)][: 1 + k % 2], "seq string").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = counts.stream_probe_counts(stream).writeStream.format("memory").queryName("probe_counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {r["seq"]: r["cnt"] for r in spark.table("probe_counts").collect()} == {"ACGT": 3, "AAAA": 1}
    assert counts.stream_kmer_counts(spark.read.parquet(str(src)), 2).count() == 4


def test_restart_log(spark):
    rows = spark.createDataFrame([(1, 5), (2, 9), (3, None), (4, 2), (5, None), (6, 1)], "i int, step int")
    assert [r["total_step"] for r in dos.restart_log(rows).orderBy("i").collect()] == [5, 9, 11, 12]


def test_running_sums(spark):
    """Over ranges against plain sums: ties, few values, none, both ways."""
    for n, kinds in ((3000, 10**6), (500, 7), (1, 3), (0, 3)):
        rows = [(float(x), i % 3) for i, x in enumerate(np.random.default_rng(n).integers(0, kinds, n))]
        df = spark.createDataFrame(rows, "x double, v int").groupBy("x").agg(F.sum("v").alias("v"))
        for down in (False, True):
            got = {r["x"]: (r["v_sum"], r["v_all"]) for r in compare.running_sums(df, "x", ["v"], down).collect()}
            want = {x: (sum(v for y, v in rows if (y >= x if down else y <= x)), sum(v for _, v in rows)) for x in {x for x, _ in rows}} if n < 1000 else None
            if want is not None:
                assert got == want
            else:
                order, total = sorted(got, reverse=down), 0
                own = {r["x"]: r["v"] for r in df.collect()}
                for x in order:
                    total += own[x]
                    assert got[x] == (total, sum(own.values()))


def test_stores(spark, tmp_path):
    import datetime

    rows = spark.createDataFrame([(1, "a", "r", 1, 5.0, None), (2, "a", "r", 1, 6.0, 1.0)], "k int, symmetry string, run string, stamp int, train double, test double")
    path, now = f"file://{tmp_path}/store", datetime.datetime(2020, 1, 2, 3, 4)
    how = {"meta": ("run",), "key": ("k", "symmetry"), "merged": ("test",)}
    assert models.store_results(rows, path, **how) == path
    newer = spark.createDataFrame([(2, "a", "r", 2, 4.0, None)], rows.schema)
    assert models.store_results(newer, path, **how) == path
    assert sorted(map(tuple, models.read_results(spark, path).collect())) == [(1, "a", "r", 1, 5.0, None), (2, "a", "r", 2, 4.0, 1.0)]
    assert models.store_results(newer.replace("r", "s"), path, now=now, **how) == f"{path}_2020-01-02-03-04"
    (tmp_path / "store" / "v000009").mkdir()  # a version that was not finished
    assert models.read_results(spark, path).count() == 2
    assert models.store_results(newer, path, append=False, now=datetime.datetime(2020, 1, 2, 3, 5)).endswith("03-05")


def test_store_without_meta_and_with_lost_or_other_writers(spark, tmp_path, monkeypatch):
    schema = "k int, symmetry string, run string, stamp int, train double, test double"
    row = lambda *r: spark.createDataFrame([r], schema)
    path, how = f"file://{tmp_path}/store", {"key": ("k", "symmetry")}
    models.store_results(row(1, "a", "r", 1, 5.0, None), path, **how)
    assert models.store_results(row(1, "a", "s", 2, 4.0, None), path, **how) == path  # all rows are of one run
    lost = tmp_path / "store" / "v000002-lost"
    lost.mkdir()
    for stamp in (3, 4):
        models.store_results(row(1, "a", "r", stamp, float(stamp), None), path, **how)
    assert [tuple(r) for r in models.read_results(spark, path).collect()] == [(1, "a", "r", 4, 4.0, None)]
    # Another writer ends while this one writes: both rows are in the end.
    plain, once = models._write_version, []

    def meanwhile(rows, *rest):
        if not once:
            once.append(1)
            models.store_results(row(2, "b", "r", 1, 1.0, None), path, **how)
        return plain(rows, *rest)

    monkeypatch.setattr(models, "_write_version", meanwhile)
    models.store_results(row(3, "c", "r", 1, 1.0, None), path, **how)
    assert sorted(r["k"] for r in models.read_results(spark, path).collect()) == [1, 2, 3]


def test_fasta_of_several_splits(spark, tmp_path):
    """Records that cross splits are the rows that one split gives; names, Windows line ends and plain files beside them."""
    rng = random.Random(4)
    records = [(f"s{k} of {k % 7}", "".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 4000)))) for k in range(60)]
    (tmp_path / "a b.fa").write_text("\n" + "".join(f">{n}\r\n" + "\r\n".join(s[i : i + 50] for i in range(0, len(s), 50)) + "\r\n" for n, s in records))
    (tmp_path / "c.txt").write_text("ACGT\r\n\n GGTT\n")
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("900", before):
            spark.conf.set(key, size)
            got = reads.read_sequences(spark, f"file://{tmp_path}")
            assert (got.rdd.getNumPartitions() > 20) == (size == "900")
            assert sorted(map(tuple, got.collect()), key=str) == sorted([*records, (None, "ACGT"), (None, "GGTT")], key=str)
    finally:
        spark.conf.set(key, before)


def test_samples_of_a_sheet(spark, tmp_path):
    (tmp_path / "r.fastq").write_text("".join(f"@r\n{x}\n+\n{'@' * len(x)}\n" for x in ("CAACGTGG", "CAGACGTGG", "GGACGTGG", "CAGTTTGG", "cagccctgg")))
    one = lambda n, b, left: f'<Sample name="{n}"><Protein>N/A</Protein><VariableRegionLength>3</VariableRegionLength><LeftFlank>{left}</LeftFlank><RightFlank>TGG</RightFlank><LeftBarcode>{b}</LeftBarcode></Sample>'
    sheet = lambda *s: (tmp_path / "s.xml").write_text(f'<X xmlns:y="http://z"><SequencingRunInfo name="q"><!-- c --><DataFile>{tmp_path}/r.fastq</DataFile>{"".join(s)}</SequencingRunInfo></X>')
    sheet(one("a", "CA", ""), one("b", "CAG", ""), one("c", "", "GG"))
    t = reads.read_sample_sheet(spark, f"file://{tmp_path}/s.xml")
    assert [(r["sample"], r["protein"], r["round"], r["right_barcode"]) for r in t.collect()] == [("a", None, None, ""), ("b", None, None, ""), ("c", None, None, "")]
    assert sorted(map(tuple, reads.read_samples(spark, t).collect())) == [("q", "a", "ACG"), ("q", "a", "GTT"), ("q", "b", "ACG"), ("q", "b", "CCC"), ("q", "c", "ACG")]
    sheet(one("a", "CA", ""), one("b", "CA", ""))
    with pytest.raises(ValueError, match="same barcodes"):
        reads.read_samples(spark, reads.read_sample_sheet(spark, f"file://{tmp_path}/s.xml"))
    assert re.fullmatch(reads.trie_pattern(["CA", "CAG", "CT", ""]), "CAG") and reads.trie_pattern([""]) == "" and not re.fullmatch(reads.trie_pattern(["CA", "CT"]), "C")


def test_stored_rounds_meet_without_a_shuffle(spark, tmp_path):
    rng = random.Random(6)
    rounds = [{"".join(rng.choice("ACGT") for _ in range(3)): rng.randrange(1, 2**40) for _ in range(30)} for _ in range(4)]
    for k, r in enumerate(rounds):
        probes.store_round(spark.createDataFrame(list(r.items()), "seq string, cnt long"), "stored_rounds", k, 4, f"file://{tmp_path}/rounds")
    got = probes.combine_stored(spark, "stored_rounds", [0, 1, 3])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert {r["seq"]: tuple(r)[1:] for r in got.collect()} == {s: tuple(rounds[k].get(s, 0) for k in (0, 1, 3)) for s in {*rounds[0], *rounds[1], *rounds[3]}}
    spark.sql("drop table stored_rounds")


def test_auroc_of_scores(spark, monkeypatch):
    rows = [(float(RNG.randrange(40)), RNG.randrange(2)) for _ in range(300)] + [(None, 1), (1.0, None)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos, neg = ([s for s, y in rows if y == k and s is not None] for k in (1, 0))
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    points = {tuple(r) for r in compare.roc(df).collect()}
    for small in (10**6, 3):  # one window, or ranges
        monkeypatch.setattr(compare, "SMALL", small)
        assert compare.auroc_of(df).first()["auroc"] == pytest.approx(want) == pytest.approx(compare.auroc(compare.roc(df)).first()["auroc"])
        assert {tuple(r) for r in compare.roc(df).collect()} == points and (None, 0.0, 0.0) in points
    assert compare.auroc_of(df.limit(0)).first()["auroc"] is None and compare.roc(df.limit(0)).collect() == []


def test_groups_over_ranges(spark, monkeypatch):
    """Sums, ROC points and areas of groups, one of which holds most rows, are the same by windows and over ranges."""
    rng = np.random.default_rng(8)
    rows = [(None if g > 8 else "hot" if g > 2 else f"g{g}", float(s), int(y)) for g, s, y in zip(rng.integers(0, 10, 1500), rng.integers(0, 400, 1500), rng.integers(0, 2, 1500))]
    rows += [("one", 1.0, 1), ("one", 2.0, 1), ("hot", None, 1), ("hot", 3.0, None)]
    df = spark.createDataFrame(rows, "protein string, score double, label int")
    seen = []
    for small in (compare.SMALL, 10):
        monkeypatch.setattr(compare, "SMALL", small)
        points = sorted(map(str, compare.roc(df, by=["protein"]).collect()))
        areas = {r["protein"]: r["auroc"] for r in compare.auroc_of(df, by=["protein"]).collect()}
        again = {r["protein"]: r["auroc"] for r in compare.auroc(compare.roc(df, by=["protein"]), ["protein"]).collect()}
        for g in {r[0] for r in rows}:
            pos, neg = ([s for h, s, y in rows if h == g and y == k and s is not None] for k in (1, 0))
            want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None
            assert areas[g] == pytest.approx(want) if want is not None else areas[g] is None
            assert again[g] == pytest.approx(want) if want is not None else again[g] is None
        seen.append(points)
    assert seen[0] == seen[1]
    line = df.where("score is not null").groupBy("protein", "score").agg(F.count(F.lit(1)).alias("n"))
    for by in (["protein"], []):
        own = line if by else line.groupBy("score").agg(F.sum("n").alias("n"))
        plain, ranged = ({r.asDict().get("protein"): r["area"] for r in compare.trapezoid(own, "score", "n", by, ranges=x).collect()} for x in (False, True))
        assert plain == pytest.approx(ranged) and len(plain) == (5 + 1 if by else 1)
    assert compare.trapezoid(line.limit(0), "score", "n", ["protein"], True).collect() == [] and compare.roc(df.limit(0), by=["protein"]).collect() == []


def test_order_of_fits(spark):
    """Places of fits against sorted tuples: several modes, shapes, symmetries, nulls, ties, one fit that makes a third of all."""
    rng = random.Random(12)
    pick = rng.choice
    rows = []
    for i in range(400):
        multi = pick([True, False, None])
        ks = [pick([3, 4, 5]) for _ in range(pick([2, 3]) if multi else 1)]
        shapes = pick([None, [], ["MGW"], ["ProT"], ["Roll", "HelT"], ["HelT", "MGW"], ["ProT", "Roll", "MGW", "HelT"]])
        rows.append((i, multi, ks, pick([0, 1, None]), pick([0.0, 1e-3]), pick([True, False, None]), pick([True, False]), shapes, pick([None, "1,2", "1,1"]), pick([None, "a"]), pick([None, -1, 0, 2])))
    rows += [(1000 + i, *rows[7][1:]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, multi boolean, ks array<int>, flank int, penalty double, non_specific boolean, dinucleotide boolean, shapes array<string>, symmetry string, pair_symmetry string, shift int")

    def key(r):
        _, multi, ks, flank, penalty, ns, di, shapes, sym, pair, shift = r
        low = lambda v: (0, "") if v is None else (1, v)
        names = shapes or []
        head = (1, len(ks), sum(ks)) if multi else (0, 0, ks[0])
        tail = ((sym is not None, ""), (False, "")) if multi else (low(sym), low(pair))
        held = tuple(s not in names for s in ("MGW", "ProT", "HelT", "Roll"))
        return (*head, -1 if flank is None else flank, penalty, bool(ns), di, len(names), held, *tail, -99 if shift is None else shift)

    keys = sorted(map(key, rows))
    want = {r[0]: keys.index(key(r)) + 1 for r in rows}
    for ends in (256, 5):
        assert {r["id"]: r["place"] for r in registry.places(df, registry.fit_levels(), ends=ends).collect()} == want
    assert registry.places(df.limit(0), registry.fit_levels()).collect() == []


def test_places_of_their_own(spark):
    """Equal fits and rows equal in all columns have different places, beyond the size of one spread too."""
    rows = [(3, "a"), (1, "b"), (3, "a"), (None, "c"), (3, "b")] + [(2, "x")] * 25_000
    df = spark.createDataFrame(rows, "k int, s string").repartition(7)
    got = sorted(registry.places(df, ["k"], shared=False).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1, len(rows) + 1))
    assert [(r["k"], r["s"]) for r in got] == sorted(rows, key=lambda r: (r[0] or 0, r[1]))
    assert registry.places(df.limit(0), ["k"], shared=False).collect() == []


def test_model_ids_of_wide_keys(spark, tmp_path):
    """Keys of six digits, beside the rows that the SQL gives."""
    spark.createDataFrame([(7, 2), (100001, 12), (123456, 33)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = [tuple(r) for r in plans.queries()["P12_model_id"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(duck.execute(plans.oracle_sql()["P12_model_id"]).fetchall()) and ("D12345.33", -1, -1) in got


def test_matrices(spark):
    a = [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [7.0, 8.0, 9.5]]
    df = spark.createDataFrame([(1, a, sum(a, [])), (2, [], []), (3, None, None)], "id int, m array<array<double>>, v array<double>")
    got = {r["id"]: r for r in df.select("id", arrays.transpose("m").alias("t"), arrays.symmetrize("m").alias("s"), arrays.matrix("v", 3).alias("w"), arrays.printed("v", 1).alias("p"), arrays.random(5, -1, 1, "id").alias("r")).collect()}
    assert np.allclose(got[1]["t"], np.transpose(a)) and np.allclose(got[1]["s"], (np.array(a) + np.transpose(a)) / 2) and got[1]["w"] == a
    assert got[1]["p"] == "[1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.5]" and got[2]["p"] == "[]" and got[3]["p"] is None
    assert got[2]["t"] == got[2]["s"] == got[2]["w"] == [] and not got[3]["s"]
    assert len(set(got[1]["r"]) | set(got[2]["r"])) == 10 and all(-1 <= x < 1 for x in got[1]["r"])
