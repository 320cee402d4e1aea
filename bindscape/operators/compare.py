"""Comparing models with counts: histograms, enrichment, Poisson means, ROC, densities of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest exponent of a double: ln of the largest finite value.
LOG_MAX = 709.78
#: Rows, one for each different score, that one task may order.
SMALL = 200_000


def finite(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose columns are all there and finite."""
    for c in cols:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")))
    return df


def histogram(values: DataFrame, breaks: list[float], value: str = "score", weight: str = "cnt") -> DataFrame:
    """(bin, edge, n) for each break: weight in (previous, edge], the least break included in the first bin; the first break has 0.

    Values outside all breaks are not counted. The bin is found by one expression, so a single partial aggregate does it.
    """
    spark, b = values.sparkSession, sorted(breaks)
    edges = F.array(*[F.lit(float(x)) for x in b])
    v = F.col(value).cast("double")
    at = F.when((v >= b[0]) & (v <= b[-1]), F.greatest(F.size(F.filter(edges, lambda e: e < v)), F.lit(1)))
    counted = values.select(at.alias("bin"), F.col(weight).cast("double").alias("w")).where("bin is not null").groupBy("bin").agg(F.sum("w").alias("n"))
    every = spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "bin int, edge double")
    return every.join(counted, "bin", "left").select("bin", "edge", F.coalesce("n", F.lit(0.0)).alias("n"))


def trapezoid(points: DataFrame, x: str = "x", y: str = "y", by: list[str] | None = None, ranges: bool = False) -> DataFrame:
    """(by, area) under y over rising x; the x of a group differ.

    ranges: a group may have more points than one task should order. They are dealt to ranges of x, which meet at their first and
    last points.
    """
    by = by or []
    if ranges:
        line = points.where(F.col(x).isNotNull())
        line = line.select(*by, F.col(x).alias("_x"), F.col(y).alias("_low"), F.col(y).alias("_high"), bucket_of(line, x).alias("_range"))
        return _area(line, by).groupBy(*by).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("area"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(x)
    steps = points.select(*by, ((F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))).alias("a"))
    return steps.groupBy(*by).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("area"))


def _area(line: DataFrame, by: list[str]) -> DataFrame:
    """(by, a): parts of the area under a line (by, _x, _low, _high, _range) that comes to each _x at _low and leaves it at _high."""
    area = lambda low, high, x, w: (F.col(low) + F.lag(high).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))
    inside = line.select(*by, area("_low", "_high", "_x", Window.partitionBy(*by, "_range").orderBy("_x")).alias("a"))
    ends = line.groupBy(*by, "_range").agg(F.min_by(F.struct("_x", "_low"), "_x").alias("first"), F.max_by(F.struct("_x", "_high"), "_x").alias("last"))
    w = Window.partitionBy(*by).orderBy("_range")
    across = ends.select(*by, ((F.col("first._low") + F.lag("last._high").over(w)) / 2 * (F.col("first._x") - F.lag("last._x").over(w))).alias("a"))
    return inside.union(across)


def enrichment(bins: DataFrame, r0: str = "r0", r1: str = "r1", predicted: str = "edge") -> DataFrame:
    """Observed log enrichment against a prediction: offset, rmse, rmse50 (bins with more than 50 in both), low, high.

    The offset that minimises the squared error is the mean difference, kept inside [-40, 40].
    """
    e = bins.withColumn("e", F.when((F.col(r0) > 0) & (F.col(r1) > 0), F.ln(F.col(r1) / F.col(r0))))
    e = finite(e, "e", predicted).withColumn("least", F.least(r0, r1)).withColumn("d", F.col("e") - F.col(predicted))
    offset = e.agg(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.avg("d"))).alias("offset"))
    d = F.col("d") - F.col("offset")
    return e.crossJoin(F.broadcast(offset)).groupBy("offset").agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.sqrt(F.avg(F.when(F.col("least") > 50, d * d))).alias("rmse50"), F.floor(F.min("e")).cast("double").alias("low"), F.ceil(F.max("e")).cast("double").alias("high"))


def log_enrichment(bins: DataFrame, r0: str = "r0", r1: str = "r1") -> DataFrame:
    return bins.where((F.col(r0) > 0) & (F.col(r1) > 0)).withColumn("log_enrichment", F.ln(F.col(r1) / F.col(r0)))


def poisson_means(bins: DataFrame, x: str = "x", s: str = "s", density: str = "density", n: str = "n") -> DataFrame:
    """(x, observed, predicted): log10 of counts per probe per read, and of the mean of exp(s) between edges over its sum Z."""
    w = Window.partitionBy(F.lit(0)).orderBy(x)
    area = (F.col(density) + F.lag(density).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))
    pair = (F.exp(s) + F.lag(F.exp(s)).over(w)) / 2
    rows = bins.select(x, n, area.alias("area"), pair.alias("pair")).where("area is not null")
    total = rows.agg(F.sum(n).alias("all"), F.sum(F.col("pair") * F.col("area")).alias("z"))
    out = rows.crossJoin(F.broadcast(total)).select(x, n, F.log10(F.col(n) / F.col("area") / F.col("all")).alias("observed"), F.log10(F.col("pair") / F.col("z")).alias("predicted"))
    return finite(out, "observed", "predicted")


def rmse(rows: DataFrame, a: str, b: str, n: str, least: float = 50) -> DataFrame:
    d = (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    return rows.agg(F.sqrt(F.avg(d)).alias("rmse"), F.sqrt(F.avg(F.when(F.col(n) > least, d))).alias("rmse50"))


def bucket_of(df: DataFrame, column: str, each: int = 32) -> Column:
    """A bucket number that rises with a numeric column: up to each * each ranges of about equal size.

    The driver sees the ranges' ends alone. They are looked up in two steps of `each` comparisons.
    """
    n = each * each
    ends = sorted(set(df.select(F.col(column).cast("double").alias("v")).approxQuantile("v", [k / n for k in range(1, n)], 1 / (2 * n))))
    if not ends:
        return F.lit(0)
    rows = [ends[k : k + each] for k in range(0, len(ends), each)]
    v = F.col(column).cast("double")
    over = F.lit([float(r[-1]) for r in rows])
    row = F.size(F.filter(over, lambda e: e < v))
    inner = F.element_at(F.array(*[F.lit([float(x) for x in r]) for r in rows]), F.least(row + 1, F.lit(len(rows))))
    return row * (each + 1) + F.size(F.filter(inner, lambda e: e < v))


def running_sums(df: DataFrame, column: str, values: list[str], descending: bool = False, by: list[str] | None = None) -> DataFrame:
    """df (one row for each value of column in a group) with <value>_sum, summed up to and with the row in the order of column, and <value>_all.

    Rows are dealt to ranges of the column; sums inside a range meet sums of its group's ranges before it, of which there are about a
    thousand. No task sees more than one range of a group.
    """
    by = by or []
    at = df.withColumn("_bucket", bucket_of(df, column))
    order = F.desc if descending else F.asc
    sums = at.groupBy(*by, "_bucket").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    keys = [F.col(c).alias(f"_by_{c}") for c in by]
    sums = sums.select(*keys, F.col("_bucket").alias("_at"), *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}_before") for v in values], *[F.sum(f"_{v}").over(every).alias(f"{v}_all") for v in values])
    inside = Window.partitionBy(*by, "_bucket").orderBy(order(column)).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_bucket") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    at = at.select("*", *[F.sum(v).over(inside).alias(f"_{v}_in") for v in values]).join(sums if by else F.broadcast(sums), same)
    return at.select(*df.columns, *[(F.col(f"_{v}_before") + F.col(f"_{v}_in")).alias(f"{v}_sum") for v in values], *[f"{v}_all" for v in values])


def _sums_down(scored: DataFrame, score: str, label: str, by: list[str] | None = None) -> tuple[DataFrame, int]:
    """((by, score, p, q, p_sum, q_sum, p_all, q_all), n): positives and others at each score, and from the top down to it; n scores.

    Scores are counted first. Up to SMALL of them, one row each, are windows of the groups; more go over ranges.
    """
    by = by or []
    pos = F.when(F.col(label) > 0, 1).otherwise(0)
    at = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("q"))
    n = at.count()
    if n > SMALL:
        return running_sums(at, "score", ["p", "q"], True, by), n
    every = Window.partitionBy(*by)
    down = every.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return at.select("*", *[F.sum(c).over(down).alias(f"{c}_sum") for c in "pq"], *[F.sum(c).over(every).alias(f"{c}_all") for c in "pq"]), n


def labelled(scores: DataFrame, labels: DataFrame, key: str, score: str = "score", label: str = "label") -> DataFrame:
    """Scores with their labels by key, not by the order of two files; rows that lack either are left out."""
    return scores.where(F.col(score).isNotNull()).join(labels.where(F.col(label).isNotNull()), key)


def roc(scored: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """(by, score, fpr, tpr) at each different score as a threshold, and the point (0, 0).

    Labels above 0 are positive. Rows are summed by score first, so the running sum sees one row for each score; tied
    rows share a point. Many scores go over ranges, so that no task sees all of them, nor all of one group.
    """
    by = by or []
    at, n = _sums_down(scored, score, label, by)
    share = lambda c: F.try_divide(F.col(f"{c}_sum"), F.col(f"{c}_all"))
    points = at.select(*by, "score", share("q").alias("fpr"), share("p").alias("tpr"))
    if not by:
        return points.union(scored.sparkSession.createDataFrame([(None, 0.0, 0.0)] if n else [], points.schema))
    zero = at.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(zero)


def auroc_of(scored: DataFrame, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """(by, auroc): the chance that a positive scores above another, ties counting half; the area under the points of roc, straight from the sums by score."""
    at, _ = _sums_down(scored, score, label, by)
    won = F.sum(F.col("q") * (F.col("p_sum") - F.col("p") / 2))
    return at.groupBy(*(by or [])).agg(F.try_divide(won, F.max("p_all") * F.max("q_all").cast("double")).alias("auroc"))


def auroc(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, auroc): area under the points of roc."""
    by = by or []
    # Points of one fpr are a vertical line without area.
    line = points.where("fpr is not null and tpr is not null").groupBy(*by, F.col("fpr").alias("_x")).agg(F.min("tpr").alias("_low"), F.max("tpr").alias("_high"))
    parts = _area(line.withColumn("_range", F.floor(F.col("_x") * 1024)), by)
    if by:  # groups of one label alone stay, without an area
        parts = parts.union(points.select(*by, F.lit(None).cast("double").alias("a")))
    return parts.groupBy(*by).agg(F.sum("a").alias("auroc"))


def masked_mean_min(df: DataFrame, value: str, mask: Column, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg(F.when(mask, F.col(value))).alias("mean"), F.min(F.when(mask, F.col(value))).alias("least"))


def rescale_density(dos: DataFrame, s: str = "s", by: list[str] | None = None) -> DataFrame:
    """Log density to density without overflow: values below the lowest cutoff that keeps exp finite become 0."""
    by = by or []
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    top = F.max(s).over(w)
    cutoff = F.min(F.when(top - F.col(s) + 0.01 <= LOG_MAX, F.col(s))).over(w)
    return dos.withColumn("_cut", cutoff).withColumn("density", F.when(F.col(s) >= F.col("_cut"), F.exp(F.col(s) - F.col("_cut") + 0.01)).otherwise(0.0)).drop("_cut")


def density_in_probes(dos: DataFrame, length: int, score: str = "score", s: str = "s") -> DataFrame:
    """(score, density): scaled so that its integral is 4^length, the score relative to the largest one with any density."""
    d = rescale_density(dos, s)
    area = trapezoid(d, score, "density").select("area")
    top = d.where("density > 0").agg(F.max(score).alias("top"))
    return d.crossJoin(F.broadcast(area)).crossJoin(F.broadcast(top)).select((F.col(score) - F.col("top")).alias("score"), (F.col("density") * F.lit(float(4**length)) / F.col("area")).alias("density"))


def density_table(named: dict[str, DataFrame]) -> DataFrame:
    """Long table (type, score, density), each normalised to its sum."""
    out = None
    for name, df in named.items():
        total = df.agg(F.sum("density").alias("t"))
        one = df.crossJoin(F.broadcast(total)).select(F.lit(name).alias("type"), F.col("score").cast("double").alias("score"), (F.col("density") / F.col("t")).alias("density"))
        out = one if out is None else out.unionByName(one)
    return out


def per_protein(scored: DataFrame, protein: str = "protein") -> DataFrame:
    """(protein, n, auroc): one plan grouped by protein instead of a loop."""
    area = auroc_of(scored, by=[protein])
    return scored.groupBy(protein).agg(F.count(F.lit(1)).alias("n")).join(area, protein)
