"""N-gram Jaccard join: grouped prefix join on sets of 5-word shingles, exact at a similarity of 0.8.

Texts are cut into words at ASCII white space, A-Z in lower case; a set holds the distinct shingles of a text
as 64-bit hashes (two different shingles of one pair of texts meet with a chance below 1e-10). Two sets link when
100 * |intersection| >= 80 * |union|.

1. Sets. One scan gives each row its set's size and 128-bit key, and tells which shingles near the front of the
   order come up in several texts of a task. Equal sets are one member from here on.
2. Prefixes. Shingles are ordered: often seen ones last, by rising count, the rest by hash. Any fixed order is
   right, since linked sets of size n share one of their first n - ceil(0.8 n) + 1 shingles; this one keeps
   common passages out of prefixes. Members with the same prefix and size are collapsed into one group.
3. Candidates. Groups that share a prefix shingle are paired if their sizes and the number of shingles that both
   prefixes hold still allow the threshold. A list of many groups is never paired off: see 5. The list of a very
   common shingle is dealt to many tasks by member, so that no task holds it whole.
4. Members. Group pairs are expanded to their members, and pairs dropped whose sets cannot link by how their shingles
   fall into 1024 cells. Members of a long list (or large group) are tied to leaders of it, unfiltered.
   What these pairs tie together is a cluster, and all links lie inside clusters. The sets of a cluster go to one
   task, each once, if they fit its bound; it compares all of them, by shared shingles and 0/1 matrix products, and
   gives out a forest of the links, not the pairs.
5. Clusters over the bound. Their pairs, and a few of each member's with leaders, are verified one by one on whole sets, dealt to pairs of blocks so that a set
   travels a few times, and components formed. Of the members of long lists only what lies outside the cluster's
   largest component is then compared with all of them, in blocks of bounded size as in 4.
6. Components of the links; each row gets the smallest id of its component.

No cap, no sampling: a list is split, never cut. A text without words, or null, has an empty set and links with
nothing. With 1 to 4 words the whole sequence is the one shingle. A null id never becomes a component's id unless
all its rows have null ids. Repeated rows are equal sets. An empty table gives no rows. Texts and words of any length count
whole. Only the columns named are read, whatever else the table holds.
"""

from __future__ import annotations

from collections.abc import Collection
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components

SIZE = 5
PERCENT = 80
#: Groups in a list up to which its pairs are formed one by one.
SHORT = 64
#: Members in a block of a long list.
BLOCK = 1024
#: Leaders of a long list, and those that a member is compared with at first.
PARTS, LEADERS = 2, 4
#: Sets, and shingles in them, of a cluster that one task compares as a whole.
CLUSTER, CLUSTER_SHINGLES = 2048, 4_000_000
#: Rows (three numbers each) that are sent to all executors at most; more are joined by a shuffle.
BROADCAST = 1_000_000
#: A task counts the first REACH of each set's shingles, CHUNK of them at a time, and tells those that come twice or more;
#: told OFTEN times in all, a shingle is ordered last. What is missed only makes a list longer.
REACH, CHUNK, OFTEN = 0.3, 2_000_000, 16
#: Often seen shingles that are ordered last: the most common ones up to this number, which also bounds what the driver sees of
#: them (two numbers each) and what is broadcast. CELLS: parts that shingles of the last count taken are told apart by.
MOST_OFTEN, CELLS = 500_000, 4096
#: Lists of HOT entries or more, as one row of ONE_OF tells, are gathered in SALTS parts by member, which partial aggregates
#: then bring together. This says where entries go, never what is linked: a list that is missed only stays whole.
HOT, ONE_OF, SALTS = 50_000, 16, 256

#: Sets that may share the first 64 bits of their 128-bit keys with another; among 10^12 sets some 54,000 pairs do.
CLASHES = 1_000_000

LAST = (1 << 63) - 1
MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Sorted distinct shingle hashes of texts, worked out for many texts at once.

    A word's hash is the sum of a random number for each byte times an odd power of its place; shingles mix the hashes of
    their words in order. All in 64-bit arithmetic.
    """

    def __init__(self, size: int = SIZE):
        self.size = size
        rng = np.random.default_rng(20)
        self.bytes = rng.integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 256).astype(np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.bytes[self.space] = 0
        self.powers = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, np.uint64))

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, hash) of each word."""
        gap = self.space[data]
        first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        if not len(first):
            return first, np.empty(0, np.uint64)
        place = np.arange(len(data))
        place[first[0] :] -= np.repeat(first, np.diff(np.append(first, len(data))))
        h = self.bytes[data] * self.powers[place & 4095]
        if len(data) > 4096 and (stretch := place >> 12).any():  # in a word beyond 4096 bytes
            h = np.where(stretch > 0, (h ^ (h >> np.uint64(31))) * self.odd_factors(stretch), h)
        return first, np.add.reduceat(h, first)

    @staticmethod
    def odd_factors(k: np.ndarray) -> np.ndarray:
        """An odd number for each."""
        x = k.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x * np.uint64(0x94D049BB133111EA) | np.uint64(1)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        k = 0
        while k < len(texts):
            part, size = [], 0
            while k < len(texts) and (not part or size < 1 << 20):
                part.append((texts[k] or "").encode("utf-8", "replace").lower())
                size += len(part[-1]) + 1
                k += 1
            out += self._sets(part)
        return out

    def _sets(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        first, w = self.words(data) if len(data) else (np.empty(0, int), np.empty(0, np.uint64))
        bounds = np.searchsorted(first, np.concatenate([[0], ends]))
        k = self.size
        full = self.mixed(w, k)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= k:
                s = np.sort(full[a : b - k + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            else:
                out.append(self.mixed(w[a:b], b - a) if b > a else np.empty(0, np.uint64))
        return out

    @staticmethod
    def mixed(w: np.ndarray, k: int) -> np.ndarray:
        """Hash of each run of k words."""
        if len(w) < k or not k:
            return np.empty(0, np.uint64)
        h = w[: len(w) - k + 1] * MIX
        for j in range(1, k):
            h ^= h >> np.uint64(32)
            h += w[j : len(w) - k + 1 + j]
            h *= MIX
        h ^= h >> np.uint64(29)
        return h + np.uint64(k)


def worker_shingles(size: int = SIZE) -> Shingles:
    return common.held(("shingles", size), lambda: Shingles(size))


def key_of(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def gid_of(key: bytes, taken: dict[bytes, int]) -> int:
    """Number of a set: the first 8 bytes of its key, but for sets that would share one."""
    return taken.get(key, int.from_bytes(key[:8], "little", signed=True)) if taken else int.from_bytes(key[:8], "little", signed=True)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def least_common(n: int, m: int, percent: int = PERCENT) -> int:
    """Smallest intersection at which sets of n and m link."""
    return -(-percent * (n + m) // (100 + percent))


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        shingles, held, size = worker_shingles(), [], 0

        def often():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts > 1
            return values[many].view(np.int64), counts[many]

        def rows(ids, hashes, sizes, keys, told):
            n = len(keys)
            lists = [([], [])] * (n - 1) + [told] if n else []
            return pa.RecordBatch.from_arrays([ids, hashes, pa.array(sizes, pa.int64()), pa.array([gid_of(k, {}) for k in keys], pa.int64()), pa.array(keys, pa.binary()), pa.array([a for a, _ in lists], pa.list_(pa.int64())), pa.array([b for _, b in lists], pa.list_(pa.int64()))], names=["doc_id", "h", "n", "gid", "key", "often", "counts"])

        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                sets = shingles(part.column(1).to_pylist())
                held += [s[: int(REACH * len(s)) + 1].copy() for s in sets if len(s)]
                size += sum(map(len, held[-len(sets) :]))
                told = ([], [])
                if size > CHUNK:
                    told, held, size = often(), [], 0
                yield rows(part.column(0), part.column(2), [len(s) for s in sets], [key_of(s) for s in sets], told)
        if held:
            yield rows(pa.array([None], pa.int64()), pa.array([0], pa.int64()), [-1], [b""], often())
        held = []
        common.give_back()

    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), common.text_key(text_col).alias("h"))
    return df.mapInArrow(run, "doc_id long, h long, n long, gid long, key binary, often array<long>, counts array<long>")


def _commonest(counts: DataFrame, least: int) -> np.ndarray:
    """Tokens of counts (token, c) that have a count of least or more, by count and token: the most common ones, MOST_OFTEN at most.

    Some 2000 ranges of counts, and CELLS parts of the range that doesn't fit as a whole, say which to take. So the driver sees
    these numbers and the tokens taken, as two columns, and not the most common ones of every task.
    """
    c = F.col("c")
    level = F.when(c < 1024, c).otherwise(1024 + F.floor(16 * F.log2(c / 1024))).cast("long")
    cell = F.pmod(F.xxhash64("token"), F.lit(CELLS)).cast("long")
    told = common.materialize(counts.where(c >= least).select("token", "c", level.alias("level"), cell.alias("cell")), "often")

    def fitting(kind: str, rows: DataFrame, room: int, down: bool) -> tuple[int | None, int]:
        """The first number of a kind whose rows don't fit into room any more, and the room left before it."""
        for k, n in sorted(map(tuple, rows.groupBy(kind).count().collect()), reverse=down):
            if n > room:
                return k, room
            room -= n
        return None, room

    top, room = fitting("level", told, MOST_OFTEN, True)
    if top is not None:
        part, _ = fitting("cell", told.where(F.col("level") == top), room, False)
        told = told.where((F.col("level") > top) | ((F.col("level") == top) & (F.col("cell") < (CELLS if part is None else part))))
    got = told.select("token", "c").toArrow()
    token, n = (got.column(k).to_numpy() for k in ("token", "c"))
    return token[np.lexsort((token, n))]


def _prefixes(docs: DataFrame, last: Collection[int], taken: dict[bytes, int], percent: int, text_col: str, hot: list[int]) -> DataFrame:
    """(token, salt, gid, grp, n, stop): a row for each prefix shingle of a set that this task has not given out yet.

    stop: place of the prefix's last shingle in the order, the largest long for an often seen one. salt: part of the
    shingle's list that the set is in, from 1 on if the list is one of hot, else 0. last: often seen shingles in their order.
    """
    spark = docs.sparkSession
    order = np.fromiter(last, np.int64, len(last)).view(np.uint64)
    rank = np.argsort(order).astype(np.int32)
    late = spark.sparkContext.broadcast((order[rank], rank))
    sent = spark.sparkContext.broadcast(taken)
    parted = spark.sparkContext.broadcast(np.array(hot, np.int64).view(np.uint64))

    def run(batches):
        shingles, seen = worker_shingles(), set()
        often, rank = late.value
        taken, hot = sent.value, parted.value
        for b in batches:
            for k in range(0, b.num_rows, 512):
                cols = [[], [], [], [], [], []]
                for s in shingles(b.slice(k, 512).column(0).to_pylist()):
                    n = len(s)
                    if not n:
                        continue
                    key = key_of(s)
                    if key in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(key)
                    p = prefix_length(n, percent)
                    late_last = False
                    if len(often):
                        at = np.searchsorted(often, s)
                        at[at == len(often)] = 0
                        is_late = often[at] == s
                        first = s[~is_late][:p]
                        late_last = len(first) < p
                        if late_last:
                            rest = np.argsort(rank[at[is_late]])[: p - len(first)]
                            first = np.concatenate([first, s[is_late][rest]])
                    else:
                        first = s[:p]
                    group = int.from_bytes(blake2b(first.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)
                    gid = gid_of(key, taken)
                    salt = np.where(np.isin(first, hot), 1 + gid % SALTS, 0).astype(np.int32) if len(hot) else np.zeros(p, np.int32)
                    for c, v in zip(cols, (first.view(np.int64), salt, np.full(p, gid), np.full(p, group), np.full(p, n, np.int32), np.full(p, LAST if late_last else int(first[-1] >> np.uint64(1)))), strict=True):
                        c.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["token", "salt", "gid", "grp", "n", "stop"])
        seen.clear()
        common.give_back()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "token long, salt int, gid long, grp long, n int, stop long")


def _hot(docs: DataFrame, last: Collection[int], taken: dict[bytes, int], percent: int, id_col: str, text_col: str) -> list[int]:
    """Shingles whose lists are gathered in parts: the longest lists, MOST_OFTEN at most."""
    some = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(ONE_OF)) == 0)
    counts = _prefixes(some, last, taken, percent, text_col, []).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    return _commonest(counts, max(1, HOT // ONE_OF)).tolist()


def _whole_lists(parts: DataFrame) -> DataFrame:
    """Hot lists from their parts: at, members and m as they are over all parts of a list."""
    per = parts.groupBy("token", "grp").agg(F.count(F.lit(1)).alias("members"), F.min("gid").alias("head"))
    m = per.groupBy("token").agg(F.count(F.lit(1)).cast("long").alias("m"))
    at = F.when(F.col("gid") == F.col("head"), 1).otherwise(2).alias("at")
    return parts.select("token", "gid", "grp", "n", "stop").join(per.join(m, "token"), ["token", "grp"]).select("token", "gid", "grp", "n", "stop", "m", at, "members")


def signature(s: np.ndarray) -> bytes:
    """How many shingles of a set fall in each of 1024 cells; empty if that takes more than two bytes a cell."""
    cells = np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=1024)
    most = cells.max()
    return cells.astype(np.uint8).tobytes() if most < 256 else cells.astype(np.uint16).tobytes() if most < 65536 else b""


def may_link(a: list[bytes], b: list[bytes], percent: int = PERCENT) -> np.ndarray:
    """False where two sets share too few shingles even if those in one cell were all the same. Never False for a link."""
    out = np.ones(len(a), bool)
    for k in range(0, len(a), 4096):
        part = range(k, min(k + 4096, len(a)))
        at = [i for i in part if a[i] and b[i]]
        if at:
            x, y = (np.stack([np.frombuffer(z[i], np.uint8 if len(z[i]) == 1024 else np.uint16).astype(np.uint16) for i in at]) for z in (a, b))
            met = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            out[at] = 100 * met >= percent * (x.sum(axis=1, dtype=np.int64) + y.sum(axis=1, dtype=np.int64) - met)
    return out


def _filtered(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may link by their signatures (gid, set)."""
    one, two = (signatures.select(F.col("gid").alias(c), F.col("set").alias(f"s{c}")) for c in ("a", "b"))

    def run(batches):
        for b in batches:
            keep = may_link(b.column("sa").to_pylist(), b.column("sb").to_pylist(), percent)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _needed_sets(docs: DataFrame, wanted: DataFrame, n: int, taken: dict[bytes, int], id_col: str, text_col: str, brief: bool = False) -> DataFrame:
    """(cluster, gid, set) for wanted (needed, gid, cluster): the set of a row is made again where the row is named.

    brief: its signature in place of the set.

    n: rows of wanted. Up to BROADCAST of them are sent to the scan; more are joined by a shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(taken)

    def run(batches):
        shingles, taken = worker_shingles(), sent.value
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part, out = b.slice(k, 256), []
                for s, gid, cluster in zip(shingles(part.column(0).to_pylist()), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if len(s) and gid_of(key_of(s), taken) == gid:  # another row of that id may have another text
                        out.append((cluster, gid, signature(s) if brief else s.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in out], pa.int64()), pa.array([g for _, g, _ in out], pa.int64()), pa.array([s for _, _, s in out], pa.binary())], names=["cluster", "gid", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    side = F.broadcast(wanted) if n <= BROADCAST else wanted
    texts = texts.join(side, texts["doc_id"].eqNullSafe(side["needed"])).select("text", "gid", "cluster")
    return texts.mapInArrow(run, "cluster long, gid long, set binary")


def _cluster_links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): a forest of the links inside each cluster. Every set travels once; clusters are small."""

    def run(batches):
        at, held = None, {}

        def give():
            got = block_links(list(held), list(held.values()), range(len(held)), percent) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=["a", "b"])

        for b in batches:
            for cluster, gid, s in zip(b.column("cluster").to_pylist(), b.column("gid").to_pylist(), b.column("set").to_pylist(), strict=True):
                if cluster != at:
                    if len(held) > 1:
                        yield give()
                    at, held = cluster, {}
                held[gid] = np.frombuffer(s, np.uint64)
        if len(held) > 1:
            yield give()

    return sets.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int, block: int) -> DataFrame:
    """The pairs (cluster, a, b) that link, in large clusters: members are dealt to blocks, pairs to pairs of blocks.

    A set travels once to each pair of blocks in which it has a pair, not once for each pair.
    """
    blocks = sizes.select("cluster", F.ceil(F.greatest(F.col("members") / block, F.col("shingles") / CLUSTER_SHINGLES)).cast("int").alias("blocks"))
    own = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    dealt = pairs.join(blocks, "cluster").withColumn("i", F.least(own("a"), own("b"))).withColumn("j", F.greatest(own("a"), own("b"))).select("cluster", "i", "j", "a", "b")
    members = dealt.select("cluster", "i", "j", F.col("a").alias("gid")).union(dealt.select("cluster", "i", "j", F.col("b").alias("gid"))).distinct()
    rows = members.join(sets.select("gid", "set"), "gid").select("cluster", "i", "j", F.lit(0).alias("kind"), F.col("gid").alias("a"), F.lit(None).cast("long").alias("b"), "set")
    rows = rows.union(dealt.select("cluster", "i", "j", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("set")))

    def run(batches):
        at, held = None, {}
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("cluster", "i", "j", "kind", "a", "b", "set")]
            for cluster, i, j, kind, x, y, s in zip(*cols, strict=True):
                if (cluster, i, j) != at:
                    at, held = (cluster, i, j), {}
                if not kind:
                    held[x] = np.frombuffer(s, np.uint64)
                else:
                    n, m = len(held[x]), len(held[y])
                    met = len(np.intersect1d(held[x], held[y], assume_unique=True))
                    if 100 * met >= percent * (n + m - met):
                        out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "kind").mapInArrow(run, "a long, b long")


def block_links(gids: list[int], sets: list[np.ndarray], parts, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A forest of the links among sets, whose components are those of all links (with those that parts gives already).

    parts: numbers that say which sets are known to be in one component.
    """
    n = len(gids)
    sizes = np.array([len(s) for s in sets])
    met = np.zeros((n, n), np.float32)
    if n == 2:
        met[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(n), sizes)
        order = np.argsort(inverse, kind="stable")
        rows, per = rows[order], counts
        start = np.cumsum(per) - per
        for d in np.unique(per[per > 1]).tolist():
            if d > max(8, n // 32):
                break
            block = rows[start[per == d][:, None] + np.arange(d)]  # shingles that d sets hold: their pairs, one by one
            for i in range(d):
                for j in range(i):
                    np.add.at(met, (block[:, i], block[:, j]), 1)
        many = np.flatnonzero(per > max(8, n // 32))  # the rest by matrix products
        for low in range(0, len(many), 4096):
            x = np.zeros((n, min(4096, len(many) - low)), np.float32)
            for c, k in enumerate(many[low : low + 4096]):
                x[rows[start[k] : start[k] + per[k]], c] = 1
            met += np.tril(x @ x.T, -1)
    link = 100 * met >= percent * (sizes[:, None] + sizes[None, :] - met)
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out, parts = [], np.asarray(parts)
    label = [("part", int(p)) for p in parts]
    for i in range(n):
        for j in np.flatnonzero(link[i, :i] & (parts[:i] != parts[i])):
            a, b = root(label[i]), root(label[j])
            if a != b:
                parent[a] = b
                out.append((gids[i], gids[j]))
    return out


def set_components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", short: int = SHORT, block: int = BLOCK, cluster: int = CLUSTER) -> DataFrame:
    """(doc_id, h, n_shingles, gid, root): one row for each row of docs; rows of one component have one root, sets without words none."""
    told = common.materialize(_sets(docs, id_col, text_col), "shingle-sets")
    rows = told.where("n >= 0").select("doc_id", "h", "n", "gid", "key")
    often = told.where("size(often) > 0").select(F.explode(F.arrays_zip("often", "counts")).alias("x")).groupBy(F.col("x.often").alias("token")).agg(F.sum("x.counts").alias("c"))
    last = _commonest(often, OFTEN)
    rows, known, taken = _numbered(rows)

    # Lists of the sets that share a prefix shingle. m: groups in the list; at: place of a member in its group.
    hot = _hot(docs, last, taken, percent, id_col, text_col)
    tokens = _prefixes(docs, last, taken, percent, text_col, hot)
    by, of = Window.partitionBy("token", "salt"), Window.partitionBy("token", "salt", "grp")
    lists = tokens.withColumn("m", F.count(F.lit(1)).over(by)).where("m > 1 or salt > 0").drop("m").dropDuplicates(["token", "salt", "gid"])
    lists = lists.withColumn("at", F.row_number().over(of.orderBy("gid"))).withColumn("members", F.count(F.lit(1)).over(of))
    lists = lists.withColumn("m", F.sum((F.col("at") == 1).cast("int")).over(by)).where("m > 1 or members > 1 or salt > 0")
    lists = common.materialize(lists, "shingle-lists")
    if hot:
        cold = lists.where("salt = 0").drop("salt")
        whole = _whole_lists(lists.where("salt > 0")).where("m > 1 or members > 1")
        lists = common.materialize(cold.unionByName(whole), "whole-lists")
    else:
        lists = lists.drop("salt")
    common.release(docs.sparkSession)
    groups = common.materialize(lists.select("grp", "gid", "members").distinct(), "groups")

    # Group pairs from short lists, with the number of prefix shingles they share.
    entries = lists.where("at = 1").select("token", "grp", "n", "stop", "members", "m")
    kept, sides = entries.where(f"m > 1 and m <= {short}").drop("m"), ("grp", "n", "stop", "members")
    x, y = (kept.select("token", *[F.col(c).alias(f"{c}{k}") for c in sides]) for k in (1, 2))
    met = x.join(y, "token").where("n1 < n2 or (n1 = n2 and grp1 < grp2)").where(f"100 * n1 >= {percent} * n2")
    met = met.groupBy(*[f"{c}{k}" for c in sides for k in (1, 2)]).agg(F.count(F.lit(1)).alias("met"))
    # Shared shingles in long lists are not counted: as many as the group has there may be shared as well.
    more = common.materialize(entries.where(f"m > {short}").groupBy("grp").agg(F.count(F.lit(1)).alias("more")), "long-entries")
    hint = F.broadcast if more.count() <= BROADCAST else lambda d: d
    for k in (1, 2):
        met = met.join(hint(more.select(F.col("grp").alias(f"grp{k}"), F.col("more").alias(f"more{k}"))), f"grp{k}", "left")
    met = met.na.fill(0, ["more1", "more2"])
    # Of two prefixes, all shared shingles up to the end of the one that stops first are counted; beyond it lie that
    # set's other shingles at most.
    rest1, rest2 = F.ceil(F.col("n1") * percent / 100) - 1, F.ceil(F.col("n2") * percent / 100) - 1
    rest = F.when(F.col("stop1") < F.col("stop2"), rest1).when(F.col("stop2") < F.col("stop1"), rest2).otherwise(F.greatest(rest1, rest2))
    least = F.ceil(F.lit(percent) * (F.col("n1") + F.col("n2")) / (100 + percent))
    met = met.where(F.col("met") + F.least("more1", "more2") + rest >= least)
    group_pairs = common.materialize(met.select("grp1", "grp2", "members1", "members2"), "group-pairs")
    common.release(docs.sparkSession)

    # Members: large products of groups, large groups and long lists become lists to be split.
    whole = groups.where(f"members <= {short * short}").groupBy("grp").agg(F.collect_list("gid").alias("gids"))
    few = group_pairs.where(f"members1 * members2 <= {short * short}")
    one, two = (whole.select(F.col("grp").alias(f"grp{k}"), F.col("gids").alias(f"gids{k}")) for k in (1, 2))
    plain = few.join(one, "grp1").join(two, "grp2").select(F.explode("gids1").alias("a"), "gids2").select("a", F.explode("gids2").alias("b"))
    inner = whole.where(f"size(gids) > 1 and size(gids) <= {short}").select(F.explode("gids").alias("a"), "gids").select("a", F.explode("gids").alias("b")).where("a < b")
    plain = plain.union(inner).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    plain = common.materialize(plain, "plain-pairs")
    long_lists = lists.where(f"m > {short}").select(F.col("token").alias("list"), "gid")
    long_lists = long_lists.union(groups.where(f"members > {short}").select(F.xxhash64(F.lit("group"), "grp").alias("list"), "gid"))
    many = group_pairs.where(f"members1 * members2 > {short * short}")
    if many.limit(1).count():
        pair_list = F.xxhash64(F.lit("pair"), "grp1", "grp2").alias("list")
        long_lists = long_lists.union(many.select(pair_list, F.col("grp1").alias("grp")).union(many.select(pair_list, F.col("grp2").alias("grp"))).join(groups, "grp").select("list", "gid"))
        long_lists = common.materialize(long_lists, "long-lists")

    # Leaders of long lists: the first members of a few parts. All members are tied to them; those that a member meets
    # in most of its lists are the first that it is compared with.
    part = F.pmod(F.xxhash64("gid"), F.lit(PARTS))
    leaders = common.materialize(long_lists.groupBy("list", part.alias("p")).agg(F.min("gid").alias("leader")), "leaders")
    hint = F.broadcast if leaders.count() <= BROADCAST else lambda d: d
    stars = long_lists.join(hint(leaders), "list").where("gid != leader").groupBy("gid", "leader").agg(F.count(F.lit(1)).alias("c"))
    first = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("c"), "leader")) <= LEADERS
    stars = stars.select(F.least("gid", "leader").alias("a"), F.greatest("gid", "leader").alias("b"), first.alias("first"))
    wanted = plain.select(F.explode(F.array("a", "b")).alias("gid")).distinct().join(known, "gid").select("needed", "gid", F.lit(0).cast("long").alias("cluster"))
    wanted = common.materialize(wanted, "wanted")
    signatures = common.materialize(_needed_sets(docs, wanted, wanted.count(), taken, id_col, text_col, True), "signatures")
    plain = _filtered(plain, signatures.dropDuplicates(["gid"]), percent)
    pairs = common.materialize(plain.withColumn("first", F.lit(True)).union(stars), "pairs")
    common.release(docs.sparkSession)

    # Clusters: what candidate pairs tie together. All links lie inside one; most clusters are a handful of sets.
    tied = components(pairs)
    at = tied.select(F.explode(F.array("node", "root")).alias("gid"), F.col("root").alias("cluster")).distinct().join(known, "gid").select("gid", "needed", "n", "cluster")
    at = common.materialize(at, "clusters")
    size = at.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    part = common.materialize(at.join(size, "cluster").select("needed", "gid", "cluster", "members", "shingles"), "clusters-by-size")
    fits = f"members <= {cluster} and shingles <= {CLUSTER_SHINGLES}"
    few = part.where(fits).select("needed", "gid", "cluster")
    sets = _needed_sets(docs, few, few.count(), taken, id_col, text_col)
    links = common.materialize(_cluster_links(sets, percent), "links")
    common.release(docs.sparkSession)

    large = part.where(f"not ({fits})").select("needed", "gid", "cluster")
    if n_large := large.count():
        sets = common.materialize(_needed_sets(docs, large, n_large, taken, id_col, text_col), "candidate-sets")
        own = large.select(F.col("gid").alias("a"), "cluster")
        size = part.where(f"not ({fits})").select("cluster", "members", "shingles").distinct()
        verified = common.materialize(_verified(pairs.where("first").join(own, "a"), sets, size, percent, block), "verified")
        common.release(docs.sparkSession)
        links = links.union(verified)
        listed = common.materialize(long_lists.select("gid").distinct().join(large.select("gid", "cluster"), "gid"), "listed")
        if listed.limit(1).count():
            links = links.union(_long_links(listed, components(verified), sets, percent, block))
    roots = components(links).select(F.col("node").alias("gid"), "root")
    return rows.join(roots, "gid", "left").select("doc_id", "h", F.col("n").alias("n_shingles"), "gid", F.when(F.col("n") > 0, F.coalesce("root", "gid")).alias("root"))


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame, dict[bytes, int]]:
    """rows (doc_id, h, n, gid) in which different sets have different gids, (gid, needed, n) for each set with words, and the gids that were dealt anew by key."""
    known = rows.where("n > 0").groupBy("gid").agg(F.min("doc_id").alias("needed"), F.max("n").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    known, taken = common.materialize(known, "gids"), {}
    # Different sets whose numbers would be equal: none in practice, a few among many billions of sets.
    clash = known.where("low != high").select("gid")
    if clash.limit(1).count():
        clashing = rows.where("n > 0").join(clash, "gid", "left_semi").select("key").distinct().limit(CLASHES + 1).collect()
        if len(clashing) > CLASHES:
            raise RuntimeError("the keys of sets are not random: too many share 64 bits")
        taken = {bytes(r["key"]): -(1 << 62) + k for k, r in enumerate(sorted(clashing))}
        anew = rows.sparkSession.createDataFrame([(bytearray(k), v) for k, v in taken.items()], "key binary, anew long")
        rows = common.materialize(rows.join(F.broadcast(anew), "key", "left").select("doc_id", "h", "n", F.coalesce("anew", "gid").alias("gid")), "rows")
        known = common.materialize(rows.where("n > 0").groupBy("gid").agg(F.min("doc_id").alias("needed"), F.max("n").alias("n")), "gids")
    return rows.select("doc_id", "h", "n", "gid"), known.select("gid", "needed", "n"), taken


def _long_links(listed: DataFrame, known: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between members of long lists (gid, cluster) that are not known to be in one component, block by block."""
    part = F.coalesce("root", "gid").alias("part")
    at = listed.join(known.select(F.col("node").alias("gid"), "root"), "gid", "left").select("cluster", "gid", part)
    core = at.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster").agg(F.max_by("part", "c").alias("core"), F.count(F.lit(1)).alias("parts"))
    at = at.join(core.where("parts > 1"), "cluster").withColumn("rest", (F.col("part") != F.col("core")).cast("int"))
    sizes = at.groupBy("cluster").agg(F.sum("rest").alias("r"), F.sum(1 - F.col("rest")).alias("c"))
    sizes = sizes.select("cluster", F.ceil(F.col("r") / block).cast("int").alias("rb"), F.ceil(F.col("c") / block).cast("int").alias("cb"))
    at = at.join(sizes, "cluster").drop("core", "parts")
    # Blocks 0..rb-1 hold the rest, rb..rb+cb-1 the core; every pair of blocks but two of the core is compared.
    own = F.when(F.col("rest") == 1, F.pmod(F.xxhash64("gid"), F.col("rb"))).otherwise(F.col("rb") + F.pmod(F.xxhash64("gid"), F.greatest(F.col("cb"), F.lit(1)))).cast("int")
    at = at.withColumn("own", own)
    others = F.when(F.col("rest") == 1, F.sequence(F.lit(0), F.col("rb") + F.col("cb") - 1)).otherwise(F.sequence(F.lit(0), F.col("rb") - 1))
    spread = at.withColumn("other", F.explode(others)).select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "gid", "part")

    def compare(t: pa.Table) -> pa.Table:
        s = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")]
        got = block_links(t.column("gid").to_pylist(), s, t.column("part").to_pylist(), percent) if len(s) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in got], pa.int64()), "b": pa.array([b for _, b in got], pa.int64())})

    return spread.join(sets.select("gid", "set"), "gid").groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id that links lead to."""
    found = common.materialize(set_components(docs, percent, id_col, text_col, **sizes), "set-components")
    least = found.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "root", "left").select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, with docs' columns: the row with the smallest id (of equal ids, the smallest hash of its text). Texts without words all stay."""
    found = common.materialize(set_components(docs, percent, id_col, text_col), "set-components").where("root is not null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    best = found.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("rows"))
    of = common.materialize(found.join(best.where("rows > 1"), "root").select("doc_id", "h", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h"))).alias("first"), "root"), "near-copies")
    tied = of.where("first").groupBy("root").count().where("count > 1").limit(1).count() > 0
    dropped = of.where("not first").select("doc_id", "h")
    return common.without(docs, dropped, dropped.count(), tied, id_col, text_col)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents"))


OP3_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') as l from documents),
s as (select distinct doc_id, array_to_string(l[i : i + 4], ' ') as x
      from (select doc_id, l, unnest(range(1, greatest(2, len(l) - 3))) as i from w where len(l) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
both_ways as (select a, b from e union select b, a from e),
reach(a, b) as (select a, b from both_ways union select r.a, t.b from reach r join both_ways t on r.b = t.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) as component_id
from documents d left join n using (doc_id) left join (select a, min(b) as m from reach group by a) r on r.a = d.doc_id
"""
