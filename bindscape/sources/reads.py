"""Reads: FASTQ (gz or plain), FASTA, plain sequence files, count tables."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Samples of a sheet at most: they are sent to every task.
SHEET = 10_000


def fastq_reads(spark: SparkSession, path: str) -> DataFrame:
    """(read): the letters of each record, in capitals.

    A record is its header, one line of letters, a plus line and one line of marks. Plain files are split by Spark at any
    size, at the line break before a header: a record starts with @ and has a plus line two lines on, which a line of marks
    that begins with @ has not. gz files cannot be split; each is read in order by one task, batch by batch.
    """
    plain = spark.read.option("lineSep", "\n+").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    # Cut at the plus lines, a read is the last line of a piece, behind its header.
    ahead = F.regexp_extract(F.col("value"), r"(?:^|\n)@[^\n]*\n([A-Za-z]+)\r?$", 1)
    reads = plain.where(~F.col("file").endswith(".gz")).select(ahead.alias("read")).where("read != ''")
    reads = reads.union(_gz_reads(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.col("file").endswith(".gz"))))
    return reads.select(F.upper("read").alias("read"))


def read_fastq(spark: SparkSession, path: str, length: int, left: str = "", right: str = "", barcode: str = "") -> DataFrame:
    """(seq): the variable region of each read that has it between its barcode and flanks; reads without it are left out."""
    region = F.regexp_extract("read", f"{barcode}{left}([ACGT]{{{length}}}){right}", 1)
    return fastq_reads(spark, path).select(region.alias("seq")).where("seq != ''")


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(run, file, sample, round, protein, length, left, right, left_barcode, right_barcode) of an XML sheet: a row for each sample of each run.

    Empty fields and N/A are null; barcodes and flanks that are not given are empty.
    """
    sample = "_name string, _round int, Protein string, VariableRegionLength int, LeftFlank string, RightFlank string, LeftBarcode string, RightBarcode string"
    runs = spark.read.option("rowTag", "SequencingRunInfo").schema(f"_name string, DataFile string, Sample array<struct<{sample}>>").xml(path)
    s = runs.select(F.col("_name").alias("run"), F.trim("DataFile").alias("file"), F.explode("Sample").alias("s"))
    given = lambda c: F.when(~F.upper(F.trim(F.col(f"s.{c}"))).isin("", "N/A"), F.trim(F.col(f"s.{c}")))
    letters = lambda c: F.coalesce(F.upper(given(c)), F.lit(""))
    return s.select("run", "file", F.col("s._name").alias("sample"), F.col("s._round").alias("round"), given("Protein").alias("protein"), F.col("s.VariableRegionLength").alias("length"), letters("LeftFlank").alias("left"), letters("RightFlank").alias("right"), letters("LeftBarcode").alias("left_barcode"), letters("RightBarcode").alias("right_barcode"))


def trie_pattern(words: list[str]) -> str:
    """A regular expression for any of the words, the longest first, in which common beginnings are tried once."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        ways = [re.escape(c) + pattern(at[c]) for c in sorted(at) if c]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in at else f"(?:{'|'.join(ways)})"
        return f"{body}?" if "" in at else body

    return pattern(tree)


def read_samples(spark: SparkSession, sheet: DataFrame) -> DataFrame:
    """(run, sample, seq): reads of all files of a sheet, each dealt to its sample by its barcodes, in one scan of each file.

    Samples of a file that share length and flanks are told apart by one expression over the trie of their barcodes. A read that fits several
    designs goes to the one that comes first in the sheet; a read that fits none is left out. Samples that no read could tell apart are an error.
    """
    rows = sheet.limit(SHEET + 1).collect()
    if len(rows) > SHEET:
        raise ValueError(f"more than {SHEET} samples")
    files: dict[str, dict[tuple, list]] = {}
    for r in rows:
        files.setdefault(r["file"], {}).setdefault((r["length"], r["left"], r["right"]), []).append(r)
    out = spark.createDataFrame([], "run string, sample string, seq string")
    for file, designs in files.items():
        keys, found = [], []
        for k, ((length, left, right), samples) in enumerate(designs.items()):
            before, behind = (trie_pattern(sorted({s[c] for s in samples})) for c in ("left_barcode", "right_barcode"))
            whole = f"({before}){left}([ACGT]{{{length}}}){right}({behind})"
            part = lambda i, whole=whole: F.regexp_extract("read", whole, i)
            found.append(F.when(part(2) != "", F.struct(F.lit(k).alias("design"), part(1).alias("left_barcode"), part(2).alias("seq"), part(3).alias("right_barcode"))))
            keys += [(k, s["left_barcode"], s["right_barcode"], s["run"], s["sample"]) for s in samples]
        if len({x[:3] for x in keys}) < len(keys):
            raise ValueError(f"samples of {file} that have the same barcodes and flanks")
        known = spark.createDataFrame(keys, "design int, left_barcode string, right_barcode string, run string, sample string")
        dealt = fastq_reads(spark, file).select(F.coalesce(*found).alias("f")).where("f is not null").select("f.*")
        out = out.union(dealt.join(F.broadcast(known), ["design", "left_barcode", "right_barcode"]).select("run", "sample", "seq"))
    return out


def _gz_reads(lines: DataFrame) -> DataFrame:
    """A gz file is one partition, in order: every fourth line from the second."""

    def run(batches: Iterable[pd.DataFrame]):
        k, at = 0, None
        for b in batches:
            file = b["file"].to_numpy()
            new = np.concatenate([[True], file[1:] != file[:-1]])
            start = np.where(new, np.arange(len(b)), 0)
            place = np.arange(len(b)) - np.maximum.accumulate(start)
            if len(b) and file[0] == at:
                first = len(b) if not new[1:].any() else int(np.argmax(new[1:])) + 1
                place[:first] += k
            if len(b):
                k, at = int(place[-1]) + 1, file[-1]
            yield pd.DataFrame({"read": b["value"].to_numpy()[place % 4 == 1]})

    return lines.select("file", "value").mapInPandas(run, "read string")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): FASTA records of files that have headers (lines that begin with >), else one sequence a line with no name.

    FASTA files are cut at the line breaks before headers, so Spark splits files of any size; a record is one row, by whichever
    task has its header, however many splits it crosses. What stands before a file's first header is not read as a name only if it is blank.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    kinds = lines.groupBy("file").agg(F.bool_or(F.col("value").startswith(">")).alias("fasta")).collect()
    named, plain = ([unquote(r["file"]) for r in kinds if bool(r["fasta"]) == kind] for kind in (True, False))
    out = spark.createDataFrame([], "name string, seq string")
    if named:
        record = F.regexp_replace("value", r"^\s*>", "")
        rows = spark.read.option("lineSep", "\n>").text(named).select(record.alias("r"))
        out = out.union(rows.select(F.trim(F.regexp_extract("r", r"^([^\r\n]*)", 1)).alias("name"), F.regexp_replace(F.regexp_extract("r", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "").alias("seq")))
    if plain:
        out = out.union(spark.read.text(plain).select(F.lit(None).cast("string").alias("name"), F.trim(F.regexp_replace("value", r"\r$", "")).alias("seq")))
    return out.where("seq != ''")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): one each line; # starts a comment."""
    from bindscape.operators.convnet import known_ids

    return known_ids(spark.read.text(path))


def read_counts(spark: SparkSession, path: str, max_count: int | None = None, max_run: int | None = None, patterns: list[str] | None = None) -> DataFrame:
    """(seq, cnt) of a Parquet count table, filtered as it is read."""
    from bindscape.operators.probes import filter_probes

    return filter_probes(spark.read.parquet(path).select("seq", "cnt"), max_count, max_run, patterns)


def write_counts(counted: DataFrame, path: str) -> None:
    """Sorted by sequence within range partitions, so that later merges and range scans prune."""
    counted.select("seq", "cnt").repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").parquet(path)


#: Our names for the columns of the tab-separated inputs, in file order, and whether the file has a header line.
TSV = {
    "joint_counts": ("Sequence string, R0Count int, R1Count int", False),
    "scores": ("net_score double, model_score double", True),
    "labels": ("seq string, label double", False),
    "density": ("score double, s double", False),
    "poisson_density": ("rate double, probes double, counts double", False),
    "proteins": ("Name string, VarLen int, nBases int, LFlank string, RFlank string, DBID string, FitRound string, FitModes string, FitIndex string", True),
    "data_sets": ("ProtName string, Design string, R0_File string, R1_File string", True),
}


def read_tsv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A tab-separated input with its fixed schema; NA is null."""
    schema, header = TSV[kind]
    return spark.read.csv(path, sep="\t", schema=schema, header=header, nullValue="NA")


def usable_data_sets(rows: DataFrame, *files: str) -> DataFrame:
    """Rows all of whose file columns are given."""
    for f in files:
        rows = rows.where(F.col(f).isNotNull() & (F.col(f) != "NA") & (F.col(f) != ""))
    return rows


def write_density(dos: DataFrame, path: str) -> None:
    """Two tab-separated columns by rising score, one file. A density has one row a bin."""
    dos.select("score", "s").coalesce(1).sortWithinPartitions("score").write.mode("overwrite").csv(path, sep="\t")


def read_shape(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(pentamer, feature, value) of a shape CSV: after the 5-mer, values stand at every second field (one or two of them)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    fields = F.transform(F.split(F.regexp_replace("value", "[\"']", ""), ","), lambda x: F.trim(x))
    rows = lines.select(fields.alias("f")).where(F.col("f")[0].rlike("^[ACGT]{5}$"))
    n = F.floor((F.size("f") - 1 + 1) / 2).cast("int")
    out = rows.select(F.col("f")[0].alias("pentamer"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), "f")
    return out.select("pentamer", F.concat(F.lit(name), F.when(F.col("i") > 0, F.concat(F.lit("_"), (F.col("i") + 1).cast("string"))).otherwise("")).alias("feature"), F.element_at("f", 2 * F.col("i") + 2).cast("double").alias("value"))


def choose_shapes(tables: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """Columns of the named classes, always in the fixed order, as (pentamer, feature_no, feature, value)."""
    from functools import reduce

    from bindscape.operators.params import SHAPE_COLUMNS

    if not 1 <= len(names) <= len(SHAPE_COLUMNS) or len(set(names)) != len(names):
        raise ValueError("one to four different shape classes")
    for n in names:
        if n not in SHAPE_COLUMNS:
            raise ValueError(f"unknown shape class: {n}")
        if n not in tables:
            raise ValueError(f"shape class is not loaded: {n}")
    out, at = [], 0
    for n, width in SHAPE_COLUMNS.items():
        if n in names:
            second = F.when(F.col("feature").endswith("_2"), 1).otherwise(0)
            out.append(tables[n].select("pentamer", (second + at).cast("int").alias("feature_no"), "feature", "value"))
            at += width
    return reduce(lambda a, b: a.unionByName(b), out)


def shape_matrix(shape: DataFrame):
    """(1024, features) array for the driver: 1024 rows a feature."""
    import numpy as np

    rows = shape.collect()
    out = np.zeros((1024, 1 + max(r["feature_no"] for r in rows)))
    for r in rows:
        code = 0
        for c in r["pentamer"]:
            code = 4 * code + "ACGT".index(c)
        out[code, r["feature_no"]] = r["value"]
    return out


_NULLS = {"null", "na", "n/a", "false", "no"}


def parse_config(text: str, optional: set[str] = frozenset()) -> dict[str, str | None]:
    """key = value lines: keys in lower case, the last one wins, # and ; start comments, quotes of either kind go.

    optional: keys for which null, NA, n/a, false and no mean None.
    """
    out: dict[str, str | None] = {}
    for line in text.splitlines():
        m = re.match(r"\s*([A-Za-z0-9_.]+)\s*=\s*([^#;]*)", line)
        if m:
            key, value = m[1].lower(), m[2].strip().strip("\"'")
            out[key] = None if key in {o.lower() for o in optional} and value.lower() in _NULLS else value
    return out


def fill_template(template: str, values: dict[str, str]) -> str:
    """Every key of values in the template is replaced; longer keys first."""
    for key in sorted(values, key=len, reverse=True):
        template = template.replace(key, str(values[key]))
    return template


def filled_template(template: str, values: dict[str, Column]) -> Column:
    """fill_template with columns: a text for each row, by one expression."""
    out = F.lit(template)
    for key in sorted(values, key=len, reverse=True):
        out = F.replace(out, F.lit(key), values[key].cast("string"))
    return out
