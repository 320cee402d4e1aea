"""Exact dedup: an extendible-hash index on shared files.

1. Keys. One scan writes (row, id, 64-bit hash, length, SHA-256) of every text to the shared folder. No text moves.
2. Directory. Counts of hashes seen twice by their top 16 bits go to the driver: 2^16 numbers, however many hashes there are.
   The directory starts with one bucket; a bucket over capacity is split, and where it is as deep as the
   directory, the directory doubles. Buckets that are overfull at 16 bits are split on by the task that holds their hashes, by a
   directory of their own. Each hash gets its bucket and its owner; owners hold runs of buckets, which are key ranges, and are more
   the more hashes there are.
3. Entries. Only a hash that occurs twice can mean a copy, so only such texts are read again (by a broadcast of these hashes
   while Spark holds them for small, beyond that by a shuffle of texts by hash). Each scan task folds
   its own equal texts into one entry (hash, text, best row, count): a text that a third of all rows share leaves a
   task once, not once for each row. Entries are written as index files in the shared folder, by owner.
4. Owners read their files in order of hash, chain the entries of a hash, compare bytes, and give each
   different text of a chain its class. A hash collision so makes two classes.
5. Every row looks up its class by (hash, SHA-256). Classes are few; rows of a huge class are spread by Spark's
   skew join, which splits them freely since they meet one class row.

Null text counts as empty; all such rows are one class. Of equal texts the largest id stays, a null id is below
all others; of rows that are equal in both, exactly one stays (the one that the key table holds last).
Ids are integers. An empty table gives no rows. Texts of any length are compared whole. Only the two columns named are read;
keep_one returns all columns, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Top bits by which hashes are counted for the driver.
DIRECTORY_BITS = 16
#: Distinct hashes that a bucket holds before it is split.
CAPACITY = 2_000
#: Owner tasks: as many as buckets up to OWNERS, beyond that one for each OWNED hashes.
OWNERS, OWNED = 4096, 250_000


class Directory:
    """Bucket of a hash by its top bits. cells: distinct hashes for each value of the top DIRECTORY_BITS bits."""

    def __init__(self, cells: dict[int, int], capacity: int = CAPACITY, most_bits: int = DIRECTORY_BITS):
        self.depth, self.most = 0, most_bits
        at, total = sorted(cells), [0]
        for cell in at:
            total.append(total[-1] + cells[cell])
        held = lambda first, last: total[bisect_left(at, last)] - total[bisect_left(at, first)]
        buckets, todo = [], [(0, 0)]  # (prefix, depth)
        while todo:
            prefix, depth = todo.pop()
            first, last = prefix << (most_bits - depth), (prefix + 1) << (most_bits - depth)
            n = held(first, last)
            if n <= capacity or depth == most_bits:
                buckets.append((first, depth, n))
                continue
            if depth == self.depth:
                self.depth += 1  # the directory doubles: twice the pointers, the buckets stay
            todo += [(2 * prefix + 1, depth + 1), (2 * prefix, depth + 1)]
        self.buckets = sorted(buckets)
        self.first = [b[0] for b in self.buckets]
        self.before = [0]
        for _, _, n in self.buckets:
            self.before.append(self.before[-1] + n)

    def most_owners(self, capacity: int) -> int:
        """Owners for these hashes: no more than buckets, those to be split on counted as what they need at least."""
        return min(sum(max(1, -(-n // capacity)) for _, _, n in self.buckets), max(OWNERS, self.before[-1] // OWNED))


def split(hashes: np.ndarray, prefix: int, depth: int, capacity: int) -> list[tuple[int, int, int]]:
    """(first hash of its range, depth, place of its first hash) for the buckets of sorted unsigned hashes that share `depth` bits, split by their further bits."""
    done, todo = [], [(prefix, depth)]
    while todo:
        prefix, depth = todo.pop()
        first, last = prefix << (64 - depth), ((prefix + 1) << (64 - depth)) - 1
        low, high = np.searchsorted(hashes, np.uint64(first), "left"), np.searchsorted(hashes, np.uint64(last), "right")
        if high - low <= capacity or depth == 64:
            done.append((first, depth, int(low)))
        else:
            todo += [(2 * prefix + 1, depth + 1), (2 * prefix, depth + 1)]
    return sorted(done)


def placed(twice: DataFrame, directory: Directory, capacity: int) -> DataFrame:
    """(h, owner, bucket) for each of the different hashes of twice; a bucket is named by the first hash of its range. One task holds the hashes of one overfull bucket at a time."""
    total, owners, bits = max(1, directory.before[-1]), directory.most_owners(capacity), directory.most
    first, before = np.array(directory.first, np.int64), np.array(directory.before[:-1], np.int64)
    overfull = np.array([n > capacity for _, _, n in directory.buckets])
    owner_at = lambda place: min(owners - 1, int(place) * owners // total)
    owner_of = np.array([owner_at(p) for p in before], np.int32)

    def give(h, owner, bucket):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(owner, pa.int32()), pa.array(bucket.view(np.int64))], names=["h", "owner", "bucket"])

    def divided(b: int, hashes: np.ndarray):
        parts = split(hashes, int(first[b]), bits, capacity)
        at = np.searchsorted(np.array([p[0] for p in parts], np.uint64), hashes, "right") - 1
        return give(hashes, np.array([owner_at(before[b] + p[2]) for p in parts], np.int32)[at], np.array([p[0] for p in parts], np.uint64)[at])

    def run(batches):
        gathered, at = [], None
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            b = np.searchsorted(first, (h >> np.uint64(64 - bits)).astype(np.int64), "right") - 1
            whole = ~overfull[b]
            yield give(h[whole], owner_of[b[whole]], first[b[whole]].astype(np.uint64) << np.uint64(64 - bits))
            for k in np.unique(b[~whole]):
                if at is not None and k != at:
                    yield divided(at, np.concatenate(gathered))
                    gathered = []
                at = k
                gathered.append(h[b == k])
        if gathered:
            yield divided(at, np.concatenate(gathered))

    cell = F.shiftrightunsigned("h", 64 - bits)
    together = twice.select("h", cell.alias("cell")).repartition("cell").sortWithinPartitions("cell", "h")
    return together.select("h").mapInArrow(run, "h long, owner int, bucket long")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _best(a: tuple, b: tuple) -> tuple:
    """Of two (id or None, rows with that id): the larger id; for equal ids, the rows added up."""
    if a[0] == b[0]:
        return a[0], a[1] + b[1]
    return b if a[0] is None or (b[0] is not None and b[0] > a[0]) else a


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Column | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each row of docs: row, h, doc_id, keep_id, group_size, kept, text_sha256.

    hash_of: another 64-bit hash of column text, for tests of collisions.
    """
    spark = docs.sparkSession
    h = (hash_of if hash_of is not None else common.text_key("text")).alias("h")
    keys = common.materialize(_rows(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", h, F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")), "dedup-keys")

    per_hash = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    twice = common.materialize(per_hash.where("n > 1").select("h"), "dedup-twice")
    cells = twice.groupBy(F.shiftrightunsigned("h", 64 - DIRECTORY_BITS).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
    buckets = common.materialize(placed(twice, Directory({r["cell"]: r["n"] for r in cells}, capacity), capacity), "dedup-buckets")

    entry = "owner int, bucket long, h long, sha binary, text binary, doc_id long, tied long, n long"

    def fold(batches):
        """One entry for each text of this task; given out whenever the texts held grow large."""

        def give():
            cols = {k: [] for k in ("owner", "bucket", "h", "sha", "text", "doc_id", "tied", "n")}
            for hash_, (owner, bucket, chain) in held.items():
                for sha, text, best, n in chain:
                    for name, value in zip(cols, (owner, bucket, hash_, sha, text, best[0], best[1], n), strict=True):
                        cols[name].append(value)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), types, strict=True)], names=list(cols))

        held, size = {}, 0
        for b in batches:
            for hash_, sha, text, doc_id, owner, bucket in zip(*(b.column(k).to_pylist() for k in ("h", "sha", "text", "doc_id", "owner", "bucket")), strict=True):
                chain = held.setdefault(hash_, (owner, bucket, []))[2]
                for k, (_, known, best, n) in enumerate(chain):
                    if known == text:
                        chain[k] = (sha, text, _best(best, (doc_id, 1)), n + 1)
                        break
                else:
                    chain.append((sha, text, (doc_id, 1), 1))
                    size += len(text) + 200
            if size > 64_000_000:
                yield give()
                held, size = {}, 0
        if held:
            yield give()

    texts = _rows(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", h)
    texts = texts.join(buckets, "h").select("h", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), F.col("text").cast("binary").alias("text"), "doc_id", "owner", "bucket")
    entries = texts.mapInArrow(fold, entry).repartition("owner").sortWithinPartitions("owner", "bucket", "h")
    index = common.materialize(entries, "dedup-index", ["owner"])

    def chains(batches):
        """Texts of each hash compared byte by byte; a class for each different one."""
        at, chain = None, []

        def give(done):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["h", "sha", "keep_id", "tied", "group_size"])

        for b in batches:
            done = []
            for hash_, sha, text, doc_id, tied, n in zip(*(b.column(k).to_pylist() for k in ("h", "sha", "text", "doc_id", "tied", "n")), strict=True):
                if hash_ != at:
                    done += [(at, s, *best, m) for s, _, best, m in chain]
                    at, chain = hash_, []
                for k, (s, known, best, m) in enumerate(chain):
                    if known == text:
                        chain[k] = (s, known, _best(best, (doc_id, tied)), m + n)
                        break
                    if s == sha:
                        raise ValueError("two different texts have the same hash and SHA-256")
                else:
                    chain.append((sha, text, (doc_id, tied), n))
            if done:
                yield give(done)
        if chain:
            yield give([(at, s, *best, m) for s, _, best, m in chain])

    owned = index.repartition("owner").sortWithinPartitions("owner", "h")
    classes = common.materialize(owned.mapInArrow(chains, "h long, sha binary, keep_id long, tied long, group_size long"), "dedup-classes")

    id_type = docs.schema[id_col].dataType
    tied = classes.where("tied > 1").select("h", "sha", "keep_id")
    if tied.limit(1).count():  # rows with equal ids: the last one in the key table stays
        equal = keys.join(tied, ["h", "sha"]).where(F.col("doc_id").cast("long").eqNullSafe(F.col("keep_id")))
        classes = classes.join(equal.groupBy("h", "sha").agg(F.max("row").alias("keep_row")), ["h", "sha"], "left")
    else:
        classes = classes.withColumn("keep_row", F.lit(None).cast("long"))
    found = keys.join(classes, ["h", "sha"], "left")
    alone = F.col("group_size").isNull()
    kept = alone | (F.col("doc_id").cast("long").eqNullSafe(F.col("keep_id")) & F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)))
    return found.select(
        "row",
        "h",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id").cast(id_type)).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        kept.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each different text, with docs' columns: the row with the largest id."""
    classes = common.materialize(exact_classes(docs, id_col, text_col), "exact-classes")
    dropped = classes.where("not kept and not (doc_id <=> keep_id)").select("doc_id", "h")
    tied = classes.where("not kept and doc_id <=> keep_id").limit(1).count() > 0
    return common.without(docs, dropped, dropped.count(), tied, id_col, text_col)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(common.table(spark, sf_dir, "documents")).drop("row", "h")


OP7_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size, sha256(t) as text_sha256 from d group by t)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, g.text_sha256 from d join g using (t)
"""
