"""Sources and sinks: each query writes a file in its layout, reads it back and gives the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindscape.operators import fitting
from bindscape.sources import models, reads

from .catalog import query, reads_sql, table
from .catalog import reads as derived_reads
from .queries_compare import _FITS, _fits
from .queries_more import _folder


def _lines(df, spark, name):
    """One column of texts, written as text files, one for each task."""
    path = _folder(spark, name)
    df.toDF("value").write.text(path)
    return path


@query("S1_fastq", f"select seq, count(*) as n from {reads_sql(8)} group by seq")
def s1(spark, sf):
    """Records of four lines with flanks; marks that begin with @ and + are no headers."""
    seq = F.col("seq")
    record = F.concat(F.lit("@read\nACG"), seq, F.lit("TGG\n+\n"), F.when(seq.startswith("A"), "@").when(seq.startswith("C"), "+").otherwise("I"), F.lit("IIIIIIIIIIIII"))
    path = _lines(derived_reads(spark, sf, 8).select(record), spark, "fastq")
    return reads.read_fastq(spark, path, 8, "ACG", "TGG").groupBy("seq").agg(F.count(F.lit(1)).alias("n"))


@query("S1_fastq_gz", f"select seq, count(*) as n from {reads_sql(8)} group by seq")
def s1gz(spark, sf):
    path = _folder(spark, "fastq-gz")
    record = F.concat(F.lit("@read\nACG"), "seq", F.lit("TGG\n+\n@III+IIIIIIIII"))
    derived_reads(spark, sf, 8).select(record.alias("value")).write.option("compression", "gzip").text(path)
    return reads.read_fastq(spark, path, 8, "ACG", "TGG").groupBy("seq").agg(F.count(F.lit(1)).alias("n"))


#: Samples by line status and supplier, told apart by barcodes of which two begin alike, and by design.
_SAMPLE = "case when l_linestatus = 'F' then 'R0' when l_suppkey % 2 = 0 then 'R1' else 'R2' end"
_BARCODES = {"R0": ("CAT", ""), "R1": ("CAG", ""), "R2": ("GT", "AC")}


@query("S1_samples", f"select concat('run', (sample <> 'R0')::int) as run, sample, seq, count(*) as n from (select {_SAMPLE} as sample, {reads_sql(8).removeprefix('(select ').split(' as seq')[0]} as seq from lineitem) group by all")
def s1_samples(spark, sf):
    """Three samples of two runs: an XML sheet says which barcodes and flanks tell them apart; each file is read once."""
    sample = F.expr(_SAMPLE)
    r = derived_reads(spark, sf, 8).withColumn("sample", sample)
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in _BARCODES.items() for x in (k, v[i])]), F.col("sample"))
    read = F.concat(F.lit("@read\nTT"), pick(0), F.when(F.col("sample") == "R0", "ACG").otherwise("TTG"), "seq", F.lit("TGG"), pick(1), F.lit("TT\n+\n@IIIIIIIIIIIIIIIIIIIII"))
    files = {run: _lines(r.where(cond).select(read), spark, f"fastq-{run}") for run, cond in (("run0", "sample = 'R0'"), ("run1", "sample <> 'R0'"))}
    field = lambda name, x: f"<{name}>{x}</{name}>"
    one = lambda s: f'<Sample name="{s}" round="{s[1]}">' + field("Protein", "N/A") + field("VariableRegionLength", 8) + field("LeftFlank", "ACG" if s == "R0" else "TTG") + field("RightFlank", "TGG") + field("LeftBarcode", _BARCODES[s][0]) + field("RightBarcode", _BARCODES[s][1]) + "</Sample>"
    sheet = "<SequencingConfig>\n" + "\n".join(f'<SequencingRunInfo name="{run}">' + field("DataFile", path) + "".join(map(one, samples)) + "</SequencingRunInfo>" for (run, path), samples in zip(files.items(), (["R0"], ["R1", "R2"]), strict=True)) + "\n</SequencingConfig>"
    at = _lines(spark.createDataFrame([(sheet,)], "value string").coalesce(1), spark, "sheet")
    return reads.read_samples(spark, reads.read_sample_sheet(spark, at)).groupBy("run", "sample", "seq").agg(F.count(F.lit(1)).alias("n"))


@query("S11_fasta_orders", "select concat('order ', o_orderkey) as name, repeat(translate(md5(cast(o_orderkey as varchar)), '0123456789abcdef', 'AAAAACCCGGGGTTTT'), 1 + (o_orderkey % 5)::int) as seq from orders")
def s11_orders(spark, sf):
    """A record for each order, of one to five lines."""
    o = table(spark, sf, "orders")
    line = F.translate(F.md5(F.col("o_orderkey").cast("string").cast("binary")), "0123456789abcdef", "AAAAACCCGGGGTTTT")
    record = F.concat(F.lit(">order "), F.col("o_orderkey").cast("string"), F.repeat(F.concat(F.lit("\n"), line), (1 + F.col("o_orderkey") % 5).cast("int")))
    return reads.read_sequences(spark, _lines(o.select(record), spark, "fasta"))


_NAME_SEQ = "translate(md5(n_name), '0123456789abcdef', 'AAAAACCCGGGGTTTT')"


@query("S11_fasta", f"select n_name as name, {_NAME_SEQ} as seq from nation")
def s11(spark, sf):
    seq = F.translate(F.md5(F.col("n_name").cast("binary")), "0123456789abcdef", "AAAAACCCGGGGTTTT")
    path = _lines(table(spark, sf, "nation").select(F.concat(F.lit(">"), "n_name", F.lit("\n"), F.substring(seq, 1, 20), F.lit("\n"), F.substring(seq, 21, 12))), spark, "fasta")
    return reads.read_sequences(spark, path)


@query("S11_plain_sequences", f"select null::varchar as name, {_NAME_SEQ} as seq from nation")
def s11p(spark, sf):
    path = _lines(table(spark, sf, "nation").select(F.translate(F.md5(F.col("n_name").cast("binary")), "0123456789abcdef", "AAAAACCCGGGGTTTT")), spark, "sequences")
    return reads.read_sequences(spark, path)


@query("S12_ids", "select concat('D', lpad(cast(p_partkey as varchar), 5, '0'), '.001') as id from part where p_partkey % 3 <> 0")
def s12(spark, sf):
    p = table(spark, sf, "part")
    line = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("# "), "p_name")).otherwise(F.concat(F.lit("  D"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit(".001  # "), "p_name"))
    return reads.read_ids(spark, _lines(p.select(line), spark, "ids"))


def _tsv(kind, sql):
    schema, header = reads.TSV[kind]
    names = [c.split()[0] for c in schema.split(", ")]

    def register(make):
        @query(f"S10_{kind}", sql)
        def run(spark, sf):
            path = _folder(spark, kind)
            df = make(spark, sf).toDF(*names)
            df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in names]).write.csv(path, sep="\t", header=header)
            return reads.read_tsv(spark, path, kind)

        return run

    return register


@_tsv("joint_counts", "select translate(md5(o_orderpriority), '0123456789abcdef', 'AAAAACCCGGGGTTTT') as \"Sequence\", count(*)::int as \"R0Count\", sum((o_orderstatus = 'F')::int)::int as \"R1Count\" from orders group by o_orderpriority")
def _joint(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("a"), F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("b"))
    return o.select(F.translate(F.md5(F.col("o_orderpriority").cast("binary")), "0123456789abcdef", "AAAAACCCGGGGTTTT"), "a", "b")


@_tsv("scores", "select s_suppkey / 4e0 as net_score, case when s_suppkey % 5 = 0 then null else s_suppkey / 8e0 end as model_score from supplier")
def _scores(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey") / 4.0, F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey") / 8.0))


@_tsv("labels", "select n_name as seq, (n_nationkey % 2)::double as label from nation")
def _label_rows(spark, sf):
    return table(spark, sf, "nation").select("n_name", F.col("n_nationkey") % 2)


@_tsv("poisson_density", "select n_nationkey / 2e0 as rate, n_regionkey::double as probes, (n_nationkey * n_regionkey)::double as counts from nation")
def _poisson_rows(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey") / 2.0, "n_regionkey", F.col("n_nationkey") * F.col("n_regionkey"))


@_tsv("proteins", "select n_name as \"Name\", 16 as \"VarLen\", n_nationkey::int as \"nBases\", 'AC' as \"LFlank\", 'GT' as \"RFlank\", concat('D', n_nationkey) as \"DBID\", case when n_regionkey = 0 then null else 'R1' end as \"FitRound\", 'M' as \"FitModes\", n_regionkey::varchar as \"FitIndex\" from nation")
def _proteins(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_name", F.lit(16), "n_nationkey", F.lit("AC"), F.lit("GT"), F.concat(F.lit("D"), F.col("n_nationkey").cast("string")), F.when(F.col("n_regionkey") != 0, "R1"), F.lit("M"), "n_regionkey")


@_tsv("data_sets", "select n_name as \"ProtName\", 'x' as \"Design\", case when n_nationkey % 4 = 0 then null else concat(n_name, '.r0') end as \"R0_File\", concat(n_name, '.r1') as \"R1_File\" from nation")
def _data_sets(spark, sf):
    return table(spark, sf, "nation").select("n_name", F.lit("x"), F.when(F.col("n_nationkey") % 4 != 0, F.concat("n_name", F.lit(".r0"))), F.concat("n_name", F.lit(".r1")))


_NEW = "(select k, symmetry, run, stamp + 100000000 as stamp, train - 1 as train, null::double as test from " + _FITS + " where run = 'F' and k % 2 = 0)"
_STORED = f"(select * from {_FITS} where run = 'F' union all select * from {_NEW})"
_MERGED = f"select k, symmetry, run, stamp, train, coalesce(test, t) as test from (select *, row_number() over (partition by k, symmetry order by stamp desc) as n, last_value(test ignore nulls) over (partition by k, symmetry, run order by stamp rows between unbounded preceding and unbounded following) as t from {_STORED}) where n = 1"


@query("S4_K4_store", _MERGED)
def k4(spark, sf):
    """A store, rows of its own run merged into it, rows of another run kept out of it; then read."""
    path, f = _folder(spark, "store"), _fits(spark, sf, "F")
    new = f.where("k % 2 = 0").select("k", "symmetry", "run", (F.col("stamp") + 100_000_000).alias("stamp"), (F.col("train") - 1).alias("train"), F.lit(None).cast("double").alias("test"))
    how = {"meta": ("run",), "key": ("k", "symmetry"), "merged": ("test",)}
    models.store_results(f, path, **how)
    models.store_results(new, path, **how)
    models.store_results(_fits(spark, sf, "O"), path, **how)
    return models.read_results(spark, path)


@query("K4_new_name", f"select false as merged, * from {_FITS} where run = 'O'")
def k4n(spark, sf):
    """Rows of another run: their own store, with the time in its name."""
    path = _folder(spark, "store")
    models.store_results(_fits(spark, sf, "F"), path)
    other = models.store_results(_fits(spark, sf, "O"), path, meta=("run",), key=("k", "symmetry"))
    return models.read_results(spark, other).select(F.lit(other == path).alias("merged"), "*")


@query("H8_done_already", "select * from (values ('there', true), ('absent', false), ('forced', false)) v(step, skipped)")
def h8(spark, sf):
    path = _lines(spark.createDataFrame([("x",)], "value string"), spark, "done")
    rows = [("there", fitting.done_already(spark, path)), ("absent", fitting.done_already(spark, path + "-not")), ("forced", fitting.done_already(spark, path, True))]
    return spark.createDataFrame(rows, "step string, skipped boolean")
