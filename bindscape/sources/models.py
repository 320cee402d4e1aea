"""Model files: ragged CSV of fits with tagged vectors, background CSV, lists, reports, stores. Parquet for data; the texts are for exchange."""

from __future__ import annotations

import datetime
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindscape.operators.params import BASES, Mode, Model

#: Columns of the file of fits and of the file of backgrounds, in their order. Fixed values.
FIT_COLUMNS = ("Index", "Time", "FitTime", "FitSteps", "FncCalls", "k", "Flank", "NS", "Di", "MG", "PT", "HT", "RO", "NuSym", "DiSym", "Shift", "NSBind", "TrainL", "TrainLPerRead", "AdjTrainLPerRead", "TestLPerRead", "AdjTestLPerRead", "Lambda", "NullVectors", "PSAM")
BACKGROUND_COLUMNS = ("Index", "Time", "FitTime", "FitSteps", "FncCalls", "k", "isFlank", "TrainL", "TrainLPerRead", "AdjTrainLPerRead", "TestLPerRead", "AdjTestLPerRead", "MarkovModelDiff")
#: Tags of weights, errors and seeds: nucleotides, dinucleotides, shape, non-specific binding. Fixed values.
TAGS = ("NB", "DB", "SB", "NSB", "NE", "DE", "SE", "NSBE", "NS", "DS", "SS", "NSBS")
LOGICAL = ("NS", "Di", "MG", "PT", "HT", "RO", "isFlank")
TEXT = ("Time", "NuSym", "DiSym", "PSAM")
#: Column of each shape class.
SHAPE_FLAGS = {"MGW": "MG", "ProT": "PT", "HelT": "HT", "Roll": "RO"}


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value") != "")
    t = F.transform(F.split("value", ","), lambda x: F.trim(F.regexp_replace(x, '"', "")))
    return lines.select(t.alias("t")).where(F.col("t")[0] != "Index")


def _named(columns: tuple[str, ...]) -> list:
    """Typed columns of the leading fields; the Index is left out, NA and nothing are null."""
    out = []
    for i, c in enumerate(columns):
        text = F.when(~F.col("t")[i].isin("", "NA", "null"), F.col("t")[i])
        if c in LOGICAL:
            out.append(F.lower(text).isin("true", "t").alias(c))
        elif c in TEXT:
            out.append(text.alias(c))
        elif c == "k" and columns is FIT_COLUMNS:
            out.append(F.coalesce(text, F.lit("Multi")).alias(c))
        elif c != "Index":
            out.append(text.try_cast("double").alias(c))
    return out


def load_fits(spark: SparkSession, path: str) -> DataFrame:
    """One row a fit: the named columns (k is "Multi" where it is NA) and values, a list with one struct of twelve vectors for each mode.

    Lines are ragged: after the named columns come vectors, each behind its tag (NB>, DB>, ...), up to <EOL>. A new NB>
    starts a new mode; vectors of non-specific binding stand with the last one. Tags that a line lacks are empty lists.
    """
    lines = _tokens(spark, path)
    tail = F.slice("t", len(FIT_COLUMNS) + 1, F.size("t"))
    tail = F.when(F.array_contains(tail, "<EOL>"), F.slice(tail, 1, F.array_position(tail, "<EOL>").cast("int") - 1)).otherwise(tail)
    # Each run of fields behind a tag, as "TAG>,number,number,..."
    modes = F.filter(F.split(F.array_join(tail, ","), r"(?:^|,)NB>,"), lambda m: F.trim(m) != "")

    def vector(mode, tag):
        run = F.regexp_extract(F.concat(F.lit("NB>,"), mode), rf"(?:^|,){tag}>,([^>]*?)(?:,[A-Z]+>|$)", 1)
        return F.transform(F.filter(F.split(run, ","), lambda x: F.trim(x) != ""), lambda x: x.try_cast("double")).alias(tag)

    return lines.select(*_named(FIT_COLUMNS), F.transform(modes, lambda m: F.struct(*[vector(m, t) for t in TAGS])).alias("values"))


def _text(x) -> str:
    if x is None:
        return "NA"
    return ("TRUE" if x else "FALSE") if isinstance(x, bool | np.bool_) else repr(float(x)) if isinstance(x, float) else str(x)


def _tagged(model: Model, vector: np.ndarray | None, suffix: str) -> tuple[list[list[str]], list[str]]:
    """For each mode its tagged fields of a vector laid out like the model, and those of non-specific binding."""
    if vector is None:
        return [[] for _ in model.modes], []
    own = model.with_vector(np.asarray(vector, float))
    per_mode = [[x for kind, part in zip("NDS", (m.nuc, m.di, m.shape)) if part is not None for x in (f"{kind}{suffix}>", *map(_text, part.ravel().tolist()))] for m in own.modes]
    return per_mode, [] if own.ns is None else [f"NSB{'' if suffix == 'B' else suffix}>", _text(float(own.ns))]


def fit_info(fit, info: dict) -> dict:
    """The named values of a fit (see operators.fitting); info adds to them or replaces them."""
    model: Model = fit.model
    one = len(model.modes) == 1
    shapes = set(info.get("shapes", ()))
    return {
        "Time": info.get("Time", ""), "FitTime": float(fit.seconds), "FitSteps": fit.rounds, "FncCalls": fit.evaluations, "k": model.modes[0].k if one else None, "Flank": model.flank, "NS": model.ns is not None,
        "Di": any(m.di is not None for m in model.modes), **{flag: name in shapes for name, flag in SHAPE_FLAGS.items()}, "Shift": fit.shift, "NSBind": 0.0 if model.ns is None else float(model.ns),
        "TrainL": float(fit.value), "TrainLPerRead": float(fit.per_read), "AdjTrainLPerRead": float(fit.adjusted), "NullVectors": fit.null_vectors if fit.errors is not None else None,
        "PSAM": "".join(BASES[b] for b in model.modes[0].nuc.argmax(axis=1)) if one else None,
    } | info


def fit_line(index: int, fit, info: dict) -> str:
    """A fit as a line of the file: named columns, then the weights, and errors and seeds where it has them."""
    own = fit_info(fit, info) | {"Index": index}
    for c in ("NuSym", "DiSym"):
        if own.get(c):
            own[c] = own[c].replace(",", ".")
    out = [_text(own.get(c)) for c in FIT_COLUMNS]
    parts = [_tagged(fit.model, v, s) for v, s in ((fit.model.vector(), "B"), (fit.errors, "E"), (fit.seed, "S"))]
    for k in range(len(fit.model.modes)):
        one = len(fit.model.modes) == 1
        for per_mode, ns in parts:
            out += per_mode[k] + (ns if one else [])
    if len(fit.model.modes) > 1:
        out += [x for _, ns in parts for x in ns]
    return ",".join([*out, "<EOL>"])


def _write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame(list(enumerate(lines)), "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def write_fits(spark: SparkSession, fits: list, path: str, info: dict | None = None) -> None:
    _write_lines(spark, [",".join(FIT_COLUMNS), *(fit_line(i, f, info or {}) for i, f in enumerate(fits))], path)


def model_of(row) -> Model:
    """The model of a row of load_fits."""
    modes, ns = [], None
    for v in row["values"]:
        nuc = np.array(v["NB"]).reshape(-1, 4)
        di = np.array(v["DB"]).reshape(-1, 16) if v["DB"] else None
        shape = np.array(v["SB"]).reshape(len(nuc), -1) if v["SB"] else None
        modes.append(Mode(nuc, di, shape))
        if v["NSB"]:
            ns = float(v["NSB"][0])
    return Model(modes, ns, int(row["Flank"] or 0))


def background_line(index: int, background, info: dict) -> str:
    own = {"Index": index, "k": background.k, "isFlank": bool(background.flanked)} | info
    seed = info.get("seed")
    return ",".join([*(_text(own.get(c)) for c in BACKGROUND_COLUMNS), "B>", *map(_text, background.beta.tolist()), *([] if seed is None else ["S>", *map(_text, list(map(float, seed)))]), "<EOL>"])


def write_backgrounds(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """rows: (background, info) pairs."""
    _write_lines(spark, [",".join(BACKGROUND_COLUMNS), *(background_line(i, b, info) for i, (b, info) in enumerate(rows))], path)


def load_backgrounds(spark: SparkSession, path: str) -> DataFrame:
    """One row a background: the named columns, beta, and seed (null where there is none).

    Older files have an empty field after k, one more than their header names; it is taken out.
    """
    t, at = _tokens(spark, path), BACKGROUND_COLUMNS.index("k") + 1
    extra = (F.array_position("t", "B>") > len(BACKGROUND_COLUMNS) + 1) & (F.col("t")[at] == "")
    t = t.select(F.when(extra, F.concat(F.slice("t", 1, at), F.slice("t", at + 2, F.size("t")))).otherwise(F.col("t")).alias("t"))

    def run(tag):
        start = F.array_position("t", tag).cast("int")
        rest = F.slice("t", start + 1, F.size("t"))
        stop = F.array_min(F.filter(F.array(F.array_position(rest, "S>"), F.array_position(rest, "<EOL>")), lambda p: p > 0)).cast("int")
        return F.when(start > 0, F.transform(F.filter(F.slice(rest, 1, stop - 1), lambda x: x != ""), lambda x: x.try_cast("double")))

    return t.select(*_named(BACKGROUND_COLUMNS), run("B>").alias("beta"), run("S>").alias("seed"))


#: Columns of the list of fits, with where each comes from.
LISTED = {"no": None, "psam": "PSAM", "k": "k", "flank": "Flank", "shift": "Shift", "ns": "NSBind", "L/n train": "AdjTrainLPerRead", "L/n test": "AdjTestLPerRead", "penalty": "Lambda", "null": "NullVectors", "features": ("NS", "Di", "MG", "PT", "HT", "RO", "NuSym", "DiSym")}


def fit_list(fits: list, info: dict | None = None) -> list[str]:
    """The list of fits for reading: a heading and a row for each, with bars between columns as wide as what they hold."""

    def cell(own: dict, number: int, source) -> str:
        if source is None:
            return str(number)
        if isinstance(source, tuple):
            return "+".join(c for c in source if own.get(c)) or "-"
        x = own.get(source)
        return "-" if x is None or x == "" else f"{x:.4f}" if isinstance(x, float) else str(x)

    rows = [list(LISTED), *([cell(fit_info(f, info or {}), i, source) for source in LISTED.values()] for i, f in enumerate(fits))]
    wide = [max(map(len, column)) for column in zip(*rows, strict=True)]
    return [" | ".join(x.ljust(n) for x, n in zip(row, wide, strict=True)).rstrip() for row in rows]


def report(fits: list, title: str = "fits", run: dict | None = None) -> str:
    """The run's settings and every fit for reading, with each position's weights and errors."""
    out = [f"# {title}", *(f"{k}: {v}" for k, v in (run or {}).items())]
    for i, f in enumerate(fits, 1):
        out.append(f"{i}. L/n {f.per_read:.8f}, adjusted {f.adjusted:.8f}, shift {f.shift}, {f.rounds} rounds, {f.evaluations} evaluations")
        at = 0
        for m in f.model.modes:
            for p in range(m.k):
                cells = []
                for b in range(4):
                    e = "" if f.errors is None else f" +- {f.errors[at + 4 * p + b]:.4f}"
                    cells.append(f"{BASES[b]} {m.nuc[p, b]:.4f}{e}")
                out.append(f"   {p + 1}: " + ", ".join(cells))
            at += len(m.vector())
        if f.model.ns is not None:
            out.append(f"   non-specific: {f.model.ns:.4f}")
    return "\n".join(out) + "\n"


def trajectory_table(spark: SparkSession, fits: list) -> DataFrame:
    """(fit, step, i, beta) of fits that kept their way."""
    rows = [(k, s, i, float(v)) for k, f in enumerate(fits) for s, x in enumerate(f.trajectory) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "fit int, step int, i int, beta double")


def hessian_table(spark: SparkSession, hessians: list[np.ndarray]) -> DataFrame:
    """(fit, i, j, value) of the second derivatives at each fit."""
    rows = [(k, i, j, float(v)) for k, h in enumerate(hessians) for i, row in enumerate(h) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "fit int, i int, j int, value double")


def exists(spark: SparkSession, path: str) -> bool:
    """Is there something at a path of any store that Spark can open?"""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def store_results(rows: DataFrame, path: str, append: bool = True, meta: tuple[str, ...] = (), now: datetime.datetime | None = None, **kw) -> str:
    """Write a table of fits as a Parquet store and return its path.

    With append, rows of the store's own run (equal in meta) are merged into it by model key; rows of another run, or any
    rows without append, go to a new store whose name has the time added if the first name is taken. A store is never
    changed in place: each merge is a version folder of its own, numbered after the highest there is, whole or not, so a writer that was lost
    leaves nothing that is in the way. Who finds another's version beside its own after writing merges its rows into that one too:
    of writers at the same time the last to end sees all others, so no rows are lost.
    """
    from bindscape.operators import registry

    spark = rows.sparkSession
    if not append and exists(spark, path):
        return _write_version(rows, _unused(spark, path, now), 0, uuid.uuid4().hex[:12])
    mine, seen, written = uuid.uuid4().hex[:12], set(), False
    while True:
        whole = _versions(spark, path)
        others = [v for v in whole if v not in seen and not v.endswith(mine)]
        if written and not others:
            return path
        part = rows
        if others:
            part, other = registry.append_results(spark.read.parquet(others[-1]), rows, meta, **kw)
            if other.limit(1).count():
                return _write_version(other, _unused(spark, path, now), 0, mine)
        seen |= set(whole)
        _write_version(part, path, 1 + max(map(_number, _folders(spark, path)), default=-1), mine)
        written = True


def _unused(spark: SparkSession, path: str, now: datetime.datetime | None) -> str:
    late = f"{path}_{(now or datetime.datetime.now()):%Y-%m-%d-%H-%M}"
    return next(p for p in (late, *(f"{late}-{k}" for k in range(1, 1_000_000))) if not exists(spark, p))


def _write_version(rows: DataFrame, path: str, number: int, writer: str) -> str:
    rows.write.parquet(f"{path}/v{number:06d}-{writer}")
    return path


def _number(folder: str) -> int:
    return int(re.search(r"/v(\d+)[^/]*$", folder)[1])


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Version folders, by number, then name."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [str(s.getPath()) for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    return sorted((f for f in found if re.search(r"/v\d+[^/]*$", f)), key=lambda f: (_number(f), f))


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Versions that were written to their end, oldest first."""
    return [f for f in _folders(spark, path) if exists(spark, f"{f}/_SUCCESS")]


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The latest whole version of a store."""
    return spark.read.parquet(_versions(spark, path)[-1])
