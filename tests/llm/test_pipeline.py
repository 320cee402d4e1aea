"""The pipeline against a plain version of each stage."""

import hashlib

import corpus_pipeline as P
from bindscape.llm import bpe_automaton, cgk_decontam, quality_fm
from test_jaccard import brute

SF = "/root/testdata/sf0.001"


def odd_rows(spark, docs):
    """documents with more rows: nulls, repeats, near copies, a benchmark item, and columns that clash."""
    from pyspark.sql import functions as F

    base = docs.orderBy("doc_id").limit(60)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    more = base.where("doc_id < 8").unionByName(base.where("doc_id between 10 and 14").withColumn("doc_id", F.col("doc_id") + 5000))
    more = more.unionByName(base.where("doc_id between 20 and 25").withColumns({"doc_id": F.col("doc_id") + 6000, "text": F.concat("text", F.lit(" tail"))}))
    more = more.unionByName(base.where("doc_id in (30, 31)").withColumn("doc_id", F.lit(None).cast("long")))
    more = more.unionByName(base.where("doc_id = 40").withColumns({"doc_id": F.lit(7000).cast("long"), "text": F.concat("text", F.lit(f" {item.upper()} "), "text")}))
    more = more.unionByName(base.where("doc_id in (41, 42)").withColumns({"doc_id": F.col("doc_id") + 8000, "text": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}))
    return base.unionByName(more).withColumns({"score": F.lit("x"), "h": F.lit(1), "root": F.lit(None).cast("string")})


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def key(r):
    return (r[0] is None, r[0] or 0, r[1] or "")


def check(spark, docs):
    model = quality_fm.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    features = quality_fm.Features()
    want = [(r["doc_id"], r["text"]) for r in docs.collect() if model.score(*features(r["text"] or "", r["n_chars"])) >= 0.7]
    at = P.quality(spark, docs, SF).cache()
    assert at.columns == docs.columns and sorted(rows(at), key=key) == sorted(want, key=key)

    best = {}
    for i, t in want:
        if (t or "") not in best or (i is not None and (best[t or ""][0] is None or i > best[t or ""][0])):
            best[t or ""] = (i, t)
    want = list(best.values())
    at = P.exact(spark, at, SF).cache()
    assert at.columns == docs.columns and sorted((i, t or "") for i, t in rows(at) if i is not None) == sorted((i, t or "") for i, t in want if i is not None)
    assert len(rows(at)) == len(want)

    lines = brute(want)
    component = {}
    for i, t in want:
        component.setdefault(next(x for x in lines if x.startswith(f"({i}, ")).rpartition(", ")[2], []).append((i, t))
    want = [min(g, key=key) for g in component.values()]
    at = P.near(spark, at, SF).cache()
    assert at.columns == docs.columns and sorted(rows(at), key=key) == sorted(want, key=key)

    items = [cgk_decontam.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [(i, t) for i, t in want if not any(x in cgk_decontam.normal(t) for x in items)]
    at = P.benchmark(spark, at, SF).cache()
    assert at.columns == docs.columns and sorted(rows(at), key=key) == sorted(want, key=key)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe_automaton.default_path())
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in want}
    got = {r["doc_id"]: r for r in P.tokens(spark, at, SF).collect()}
    assert got.keys() == ids.keys()
    for i, r in got.items():
        assert r["n_tokens"] == len(ids[i]) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids[i])).encode()).hexdigest()
    return got


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = check(spark, docs)
    whole = {r["doc_id"]: r for r in P.run(spark, SF).collect()}
    assert whole == got and 0 < len(got) < docs.count()


def test_odd_rows(spark, tmp_path):
    docs = odd_rows(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    docs.write.parquet(str(tmp_path / "d"))
    check(spark, spark.read.parquet(str(tmp_path / "d")))


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.collect() == [], name
    assert P.tokens(spark, docs, SF).collect() == []
