"""Every query of the engine by inventory id, with its SQL. Data: reads derived from line items, and the driver's own tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries_basic, queries_compare, queries_files, queries_fits, queries_model, queries_more, queries_reads, queries_sweeps  # noqa: F401  each registers its queries
from .catalog import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark, sf_dir):
    """Reads, counted and filtered, scored on both strands: the 20 probes of highest affinity."""
    return QUERIES["flagship_top_probes"](spark, sf_dir).select("seq", "cnt", F.col("w"))
