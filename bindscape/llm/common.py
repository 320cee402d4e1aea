"""What the operators of this subpackage share: tables, the shared folder, Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and driver and executors are one process, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints/bindscape"
#: Entries that a worker's word memo may hold.
MEMO_WORDS = 600_000
#: Rows of an Arrow batch between Spark and a worker.
BATCH_ROWS = 500
#: Rows that a worker turns into Python objects at once.
PIECE = 250
#: Rows of two numbers that are broadcast at most.
DROPPED = 1_000_000
#: Words longer than this are worked out each time instead of being kept.
MEMO_WORD_LEN = 64


def small_batches(spark: SparkSession) -> None:
    """Texts are long: at the default of 10,000 rows a batch, one on its way to a worker can hold hundreds of MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SHARED
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation, and later steps see one fixed set of rows.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more.

    It learns of them only from a garbage collection on the driver, which may otherwise come after the disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucket_of(id_col: str, mod: int):
    """crc32 of the id's text, modulo mod; null where the id is null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that per-document operators read, as (doc_id, text); other columns don't matter."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of PIECE rows: a worker holds the Python objects of one piece at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, PIECE):
            yield batch.slice(k, PIECE)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """mapInArrow with state per task: make() runs once in each task, its result once for each piece of a batch.

    The result maps names to lists or Arrow arrays, in the order of schema.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = None
        for batch in pieces(batches):
            each = each or make()
            got = each(batch)
            yield pa.RecordBatch.from_arrays([x if isinstance(x := got[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


#: Vectors that are added up in one task.
FAN = 64


def packed_sum(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of a written table of packed vectors (v: 64-bit numbers), added up in levels of FAN; at most FAN of them reach the driver."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for v in b.column(0):
                total += np.frombuffer(v.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    n = parts.count()
    while n > FAN:
        n = -(-n // FAN)
        parts = parts.repartition(n).mapInArrow(add, "v binary")
    out = np.zeros(size, np.int64)
    for r in parts.collect():
        out += np.frombuffer(bytes(r["v"]), np.int64)
    return out


_held: dict = {}


def give_back() -> None:
    """Return freed memory to the system, where its C library can; else it stays with this process for the next operator."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def held(key, make: Callable):
    """make(), kept in this process for the tasks to come. One thing is kept at a time, so workers that serve one operator after another don't add up."""
    if key not in _held:
        if _held:
            _held.clear()
            give_back()
        _held[key] = make()
    return _held[key]


def text_key(text_col: str):
    """64-bit hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def without(docs: DataFrame, dropped: DataFrame, n: int, tied: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with its columns, less the rows whose (id, text_key) is in dropped (doc_id, h).

    n: rows of dropped; up to DROPPED of them are sent to the scan, so that no text moves. tied: some rows are equal in id
    and text, of which one is to stay.
    """
    h = next(x for x in (f"h_{k}" for k in range(1000)) if x not in docs.columns)
    own = docs.withColumn(h, text_key(text_col))
    side = dropped.select(F.col("doc_id").alias("dropped_id"), F.col("h").alias("dropped_h"))
    kept = own.join(F.broadcast(side) if n <= DROPPED else side, F.col(f"`{id_col}`").eqNullSafe(F.col("dropped_id")) & (F.col(h) == F.col("dropped_h")), "left_anti")
    if tied:
        kept = kept.dropDuplicates([id_col, h])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


class Memo(dict):
    """A dict that works out what it lacks, in bounded memory.

    When full, its entries become the old generation, from which those still asked for are taken back.
    """

    __slots__ = ("find", "most", "old")

    def __init__(self, find: Callable, most: int = MEMO_WORDS):
        super().__init__()
        self.find, self.most, self.old = find, most // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
        if len(key) <= MEMO_WORD_LEN:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
