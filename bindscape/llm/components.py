"""Connected components of a link table, in Spark.

Links stay in the shared folder between rounds. A round reads them, and each reading task first contracts what it
holds to stars, at most CHUNK nodes at a time. Then, over all tasks, a node's ends meet at the smallest of them, and
every link moves on from its end to that end's own end. A node's rows are as many as tasks that hold it, and a node with very many
links only meets its one end in a join, which Spark may split. When no link moves, every node points at its root. The driver
sees one row a round.

Null ends and loops link nothing; repeated links do no harm; no links give no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Nodes that a task holds at once.
CHUNK = 500_000


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) as stars of each task: b is the smallest node that the task's links tie to a."""

    def run(batches):
        up: dict[int, int] = {}

        def root(x):
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        def stars():
            ends = [(x, r) for x in up if (r := root(x)) != x]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in ends], pa.int64()), pa.array([r for _, r in ends], pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > CHUNK:
                yield stars()
        if up:
            yield stars()

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), nodes that are their own root left out. root: the smallest node reachable."""
    at = common.materialize(contracted(links.where("a is not null and b is not null and a != b").select(F.col("a").cast("long"), F.col("b").cast("long"))), "links")
    while True:
        met = at.select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m"))
        own = F.struct("a", F.col("m").alias("b"), F.lit(False).alias("moved"))
        other = F.struct(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
        star = met.select(F.explode(F.when(F.col("b") == F.col("m"), F.array(own)).otherwise(F.array(own, other))).alias("x")).select("x.*")
        ends = at.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("end"))
        moved = star.join(ends, "b", "left").select("a", F.coalesce("end", "b").alias("b"), (F.col("moved") | F.col("end").isNotNull()).alias("moved"))
        now = common.materialize(moved, "stars")
        if not now.where("moved").limit(1).count():
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        at = common.materialize(contracted(now), "links")
