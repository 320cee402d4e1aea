"""Tables of fits: upsert by model key, total order, best fit, merging of stored results and data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What makes two fits the same model.
KEY = ("shapes", "symmetry", "k", "penalty", "flank", "dinucleotide", "non_specific", "shift")
#: Order of a list of fits.
ORDER = ("n_modes", "shapes", "k", "flank", "dinucleotide", "non_specific", "symmetry", "penalty", "shift", "train")

#: Order of a list of backgrounds.
BACKGROUND_ORDER = ("k", "flank")
#: Shape classes: of fits with equally many, those that hold an earlier one come first. Fixed values.
SHAPES = ("MGW", "ProT", "HelT", "Roll")


def upsert(stored: DataFrame, new: DataFrame, key: tuple[str, ...] = KEY, run: str = "run", stamp: str = "stamp", merged: tuple[str, ...] = ()) -> DataFrame:
    """stored and new by key: of another run the newer row replaces the older; of the same run, columns in merged keep the older value where the newer is null."""
    both = stored.unionByName(new)
    late = Window.partitionBy(*key).orderBy(F.desc(stamp))
    same = Window.partitionBy(*key, run).orderBy(stamp).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c in merged:
        both = both.withColumn(c, F.coalesce(F.col(c), F.last(c, ignorenulls=True).over(same)))
    return both.withColumn("_n", F.row_number().over(late)).where("_n = 1").drop("_n")


def ordered(fits: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    return fits.orderBy(*[F.asc_nulls_first(c) for c in order if c in fits.columns])


def fit_levels() -> list[Column]:
    """The levels of the total order of fits, each ascending with nulls first.

    Columns: multi (of several modes), ks (a length for each mode), flank, penalty, non_specific, dinucleotide, shapes (names), symmetry,
    pair_symmetry, shift (null: none was tried). Fits of one mode come first, then fewer and shorter modes, less flank, less penalty, fewer
    kinds of features, no symmetry, no shift. Of several modes only whether they have a symmetry counts. Null flags count as false.
    """
    multi, ks, shapes = (F.coalesce(F.col(c), d) for c, d in (("multi", F.lit(False)), ("ks", F.array().cast("array<int>")), ("shapes", F.array().cast("array<string>"))))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    one = lambda v: F.when(~multi, v)
    total = F.aggregate(ks, F.lit(0).cast("long"), lambda a, k: a + k)
    levels = [multi, F.when(multi, F.size(ks)), total, F.col("flank"), F.col("penalty"), flag("non_specific"), flag("dinucleotide"), F.size(shapes)]
    levels += [~F.array_contains(shapes, s) for s in SHAPES]
    levels += [F.col("symmetry").isNotNull(), one(F.col("symmetry")), one(F.col("pair_symmetry").isNotNull()), one(F.col("pair_symmetry"))]
    return [*levels, F.col("shift")]


#: Places that one row of equal fits is spread over at once.
_SPREAD = 10_000


def places(fits: DataFrame, levels: list[Column | str], out: str = "place", ends: int = 256, shared: bool = True) -> DataFrame:
    """fits with their place, from 1, in the order of levels (ascending, nulls first); fits equal in all of them share the least place of theirs.

    shared=False: each has a place of its own; fits equal in all levels go by their columns, and rows equal in all columns are counted as one
    and spread over their places at the end.

    Equal fits are counted first. What differs is dealt to ranges, whose ends are the keys of smallest hash, at most `ends` of them:
    numbers inside a range meet the sums of the ranges before it, so that no task orders all fits.
    """
    keyed = fits.withColumn("_key", F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(levels)], *([] if shared else [F.struct(*fits.columns).alias("row")])))
    groups = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    cuts = groups.orderBy(F.xxhash64("_key"), "_key").limit(ends).agg(F.collect_list("_key").alias("_ends"))
    at = groups.crossJoin(F.broadcast(cuts)).select("_key", "_n", F.size(F.filter("_ends", lambda e: e < F.col("_key"))).alias("_range"))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = at.groupBy("_range").agg(F.sum("_n").alias("_n"))
    sums = sums.select("_range", earlier(Window.partitionBy(F.lit(0)).orderBy("_range")).alias("_before"))
    inside = at.select("_key", "_range", "_n", earlier(Window.partitionBy("_range").orderBy("_key")).alias("_inside"))
    own = inside.join(F.broadcast(sums), "_range").select(F.col("_key").alias("_at"), "_n", (F.col("_before") + F.col("_inside") + 1).alias(out))
    if not shared:
        part = own.select("_at", F.col(out).alias("_first"), (F.col(out) + F.col("_n") - 1).alias("_last"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / _SPREAD))).alias("_part"))
        start = F.col("_first") + _SPREAD * F.col("_part")
        return part.select("_at.row.*", F.explode(F.sequence(start, F.least(start + (_SPREAD - 1), F.col("_last")))).alias(out))
    return keyed.join(own, F.col("_key") == F.col("_at")).select(*fits.columns, out)


def best_fit(fits: DataFrame, by: list[str] | None = None, value: str = "test", other: str = "train") -> DataFrame:
    """The row of least value, of equal ones the least in the order of its columns; fits without one are compared by the other. Rows with neither are passed over."""
    v = F.coalesce(F.col(value), F.col(other)) if other in fits.columns else F.col(value)
    rows = fits.where(v.isNotNull() & ~F.isnan(v))
    return rows.groupBy(*(by or [])).agg(F.min(F.struct(v.alias("_v"), F.struct(*fits.columns).alias("b"))).alias("m")).select("m.b.*")


def append_results(stored: DataFrame, new: DataFrame, meta: tuple[str, ...], **kw) -> tuple[DataFrame, DataFrame]:
    """(rows merged into the store, rows of other runs that need a store of their own); runs are one if all of meta agree.

    Without meta all rows are of one run.
    """
    if not meta:
        return upsert(stored, new, **kw), new.where(F.lit(False))
    known = stored.select(*meta).distinct()
    same = [new[c].eqNullSafe(known[c]) for c in meta]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    mine, other = new.join(known, cond, "left_semi"), new.join(known, cond, "left_anti")
    return upsert(stored, mine, **kw), other


def lookup(fits: DataFrame, condition: Column) -> DataFrame:
    """The one fit that meets the condition; an error for none or several."""
    rows = fits.where(condition)
    n = rows.limit(2).count()
    if n != 1:
        raise LookupError("no fit matches" if not n else "several fits match")
    return rows


def protein_lookup(names: DataFrame, table: DataFrame, key: str = "Name") -> DataFrame:
    """Rows of the lookup table by equality of names; rows with NA in the file column are left out."""
    return names.join(table, key)


def in_order(ids: DataFrame, table: DataFrame, key: str = "id", order: str = "place") -> DataFrame:
    """Rows of the table for the ids asked for (key, order), in that order; unknown ids give nulls."""
    return ids.join(table, key, "left").orderBy(order)


def same_model(a: DataFrame, b: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Pairs of fits of one model, by null-safe equality of its key; columns of b get the suffix _b."""
    right = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns])
    cond = None
    for c in key:
        one = a[c].eqNullSafe(right[f"{c}_b"])
        cond = one if cond is None else cond & one
    return a.join(right, cond)
