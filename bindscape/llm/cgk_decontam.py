"""Benchmark decontamination: CGK walks, bit sampling, exact edit verification.

A CGK walk copies a text to a longer one: at step j it emits the character under the pointer and moves on if a
random bit, fixed by (j, character), says so. Two texts at a small edit distance fall into step again after an
edit, so their walks agree in far more places than those of strangers: edit distance has become Hamming distance, and
sampling places of the walks is locality-sensitive hashing for it.

Texts are compared in lower case with white space runs as one space. A window opens at every character of a document
and has the size of the item that it may hold. Walks of all windows to their ends would take hundreds of steps for each
character, so windows are bucketed first by a stretch that edits have spared (a seed): one at which document and item
agree lays the window over the item. A seed's length is the largest of LENGTHS for which, with an edit in each character
with a chance of 1 - similarity, some seed of the item is left with a chance of RECALL.

From both ends of the seed window and item are walked in step to the ends of the item and compared on sampled places:
after LOOKS steps each way, then over the whole item. A window whose walks agree in less than AGREE of the places leaves.
Each look is repeated with other random bits and places for the windows that left, REPEATS times in all; one
repetition that keeps a window is enough. A copy is lost only if all of its seeds' windows leave.

Where no length will do, as for short items, the exact distance is searched at every character instead: bit-parallel, lanes
of the text side by side up to 64 characters, beyond that text by text. ``exact`` does so for all items.

A candidate passes a 3-gram count that no pair within the allowed distance fails, then the exact edit distance between
the item and its best place in the window must be at most (1 - similarity) of the item's length.
Verbatim copies are never missed, with or without spaces: their walks agree in all places. Recall of altered copies is RECALL or a
little below it at the allowed distance with edits at random places, and higher with fewer; edits placed evenly on purpose
can leave no seed, for which there is ``exact``.

Null and empty texts, and items without a character, match nothing; so does an empty table. Very long texts are searched
whole. Rows with equal ids are each judged; a row comes once for each item it holds, so repeated rows repeat their
answers. Of equal items under different ids each is reported. Only the two columns named are read, whatever else the
tables hold. Items go to the tasks in blocks of bounded size, one pass over the documents a block.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIMILARITY = 0.8
#: Chance that a seed is left at the allowed distance, and the lengths of seeds.
RECALL, LENGTHS = 0.97, (5, 6, 8, 10, 12, 16, 24)
#: Walks: repetitions, steps each way after which windows are looked at, share of places sampled, share of these that must agree.
REPEATS, LOOKS, SAMPLED, AGREE = 3, (32, 128), 0.6, 0.3
#: Steps after which random bits and sampled places come round again.
PERIOD = 64
#: Items of one pass, and their characters together: what is broadcast.
BLOCK_ITEMS, BLOCK_CHARS = 50_000, 32_000_000
#: Characters that are searched together, whose seeds are hashed at once, and windows that are walked at once.
TOGETHER, HASHED, AT_ONCE = 1 << 20, 1 << 14, 1 << 12
SYMBOLS = 256
#: Characters of a lane of the exact search.
LANE = 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def symbol(c: np.ndarray) -> np.ndarray:
    """Characters folded to 1..255; 0 is the end of an item. Two that fall together only let more windows stay."""
    out = c.astype(np.uint8)
    out ^= (c >> 8).astype(np.uint8)
    return np.maximum(out, 1, out=out)


def edit_distance_inside(item: str, text: str, most: int) -> int | None:
    """Smallest edit distance between item and any part of text, None if above most. Bit-parallel (Myers)."""
    if item in text:
        return 0
    m = len(item)
    peq: dict[str, int] = {}
    for k, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << k
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
    return best if best <= most else None


def three_grams(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k in range(len(text) - 2):
        g = text[k : k + 3]
        out[g] = out.get(g, 0) + 1
    return out


class Walks:
    """CGK walks of candidate windows and of the items they may hold, compared on sampled places."""

    def __init__(self, r: int):
        rng = np.random.default_rng(1000 + r)
        self.moves = rng.integers(0, 2, (PERIOD, SYMBOLS)).astype(np.int64)
        self.moves[:, 0] = 0  # the end of an item holds its walk
        self.sampled = rng.random(PERIOD) < SAMPLED

    def agree(self, text: np.ndarray, at: np.ndarray, items: np.ndarray, inside: np.ndarray, way: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """(sampled places that agree, sampled places before the item's end) of the walks from at and from inside."""
        same, seen = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        at, inside = at.copy(), inside.copy()
        for j in range(steps):
            x, y = text[at], items[inside]
            if self.sampled[j % PERIOD]:
                live = y != 0
                if not live.any():
                    break
                same += (x == y) & live
                seen += live
            move = self.moves[j % PERIOD]
            at += way * move[x]
            inside += way * move[y]
        return same, seen


def seed_chance(size: int, length: int, edits: float) -> float:
    """Chance that a stretch of that length without an edit is left in an item of that size."""
    none = [1.0] * (length + 1)  # none[n]: no such stretch in the first n characters
    none[length] -= (1 - edits) ** length
    for n in range(length + 1, size + 1):
        none.append(none[n - 1] - edits * (1 - edits) ** length * none[n - length - 1])
    return 1 - none[size] if size >= length else 0.0


def seed_length(size: int, similarity: float) -> int:
    """0: no length will do."""
    return max((n for n in LENGTHS if seed_chance(size, n, 1 - similarity) >= RECALL), default=0)


def stretch_hash(made: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Hash of the n characters from each place on, from those of its two parts; made holds what is known, 1 at least."""
    if n not in made:
        a = 1 << (n.bit_length() - 1)
        a = a // 2 if a == n else a
        left, right = stretch_hash(made, a), stretch_hash(made, n - a)
        size = max(0, len(made[1]) - n + 1)
        h = left[:size] * np.uint64(0xD6E8FEB86659FD93)
        h += right[a : a + size]
        h ^= h >> np.uint64(29)
        h *= _MIX
        made[n] = h
    return made[n]


def stretch_hashes(chars: np.ndarray, lengths: list[int]):
    """(n, hash of the n characters from each place on) for each of lengths, in rising order; lengths are of LENGTHS."""
    made = {1: (chars.astype(np.uint64) + np.uint64(1)) * _MIX}
    for n in lengths:
        yield n, stretch_hash(made, n)


class Seeds:
    """Windows of documents that agree with an item in a seed, as (place, item, place in the item, length of the seed)."""

    def __init__(self, items: list[str], lengths: list[int]):
        self.lengths = sorted({n for n in lengths if n})
        self.tables = {}
        found: dict[int, list] = {n: [] for n in self.lengths}
        for k, n in enumerate(lengths):
            if n:
                *_, (_, h) = stretch_hashes(codes(items[k]), [n])
                found[n].append((h, np.full(len(h), k), np.arange(len(h))))
        for n, parts in found.items():
            h, owner, offset = (np.concatenate(x) for x in zip(*parts))
            order, known = np.argsort(h, kind="stable"), np.zeros(1 << 20, bool)
            known[h >> np.uint64(44)] = True
            self.tables[n] = known, h[order], owner[order], offset[order]

    def windows(self, chars: np.ndarray):
        """Up to AT_ONCE windows at a time; one of the windows of an item that start at one place and meet in 64 characters stands for all."""
        met: dict[int, list] = {n: [] for n in self.lengths}
        for first in range(0, len(chars), HASHED):  # what fits a processor's cache
            for n, h in stretch_hashes(chars[first : first + HASHED + self.lengths[-1] - 1], self.lengths):
                known, keys = self.tables[n][:2]
                at = np.flatnonzero(known[(h[:HASHED] >> np.uint64(44)).view(np.int64)])
                h = h[at]
                low = np.searchsorted(keys, h)
                low[low == len(keys)] = 0
                there = keys[low] == h
                at, h, low = at[there], h[there], low[there]
                met[n].append((at + first, low, np.searchsorted(keys, h, side="right") - low))
        for n, parts in met.items():
            at, low, many = (np.concatenate(x) for x in zip(*parts))
            owner, offset = self.tables[n][2:]
            ends, begin = np.cumsum(many), 0
            while begin < len(at):  # a bounded number at a time: one place may meet many items
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + 16 * AT_ONCE, side="right")))
                count = many[begin:end]
                p = np.repeat(low[begin:end] - np.cumsum(count) + count, count) + np.arange(count.sum())
                where, item, inside = np.repeat(at[begin:end], count), owner[p], offset[p]
                one = np.unique((item << 42) + ((where - inside + (1 << 30)) << 10) + (where // 64 & 1023), return_index=True)[1]
                one.sort()
                for k in range(0, len(one), AT_ONCE):
                    part = one[k : k + AT_ONCE]
                    yield where[part], item[part], inside[part], n
                begin = end


class Benchmark:
    """The items of one block, ready to be met."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, exact: bool = False):
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.most = [int((1 - similarity) * len(t) + 1e-9) for t in self.texts]
        self.grams = [three_grams(t) for t in self.texts]
        lengths = {n: 0 if exact else seed_length(n, similarity) for n in {len(t) for t in self.texts}}
        self.searched = [k for k, t in enumerate(self.texts) if not lengths[len(t)]]
        self.seeds = Seeds(self.texts, [lengths[len(t)] for t in self.texts]) if any(lengths.values()) else None
        self.repetitions = [Walks(r) for r in range(REPEATS)]
        self.base = np.cumsum([1, *(len(t) + 1 for t in self.texts)])
        self.symbols = np.concatenate([np.zeros(1, np.uint8), *(np.append(symbol(codes(t)), np.uint8(0)) for t in self.texts)])
        self.full = 2 * max((len(t) for t in self.texts), default=0) + PERIOD

    def stay(self, symbols: np.ndarray, windows: np.ndarray, steps: int) -> np.ndarray:
        """The windows (place, item, place in it, length of the seed) whose walks agree in some repetition."""
        left, kept = windows, []
        for walks in self.repetitions:
            at, item, inside, n = left
            inside = self.base[item] + inside
            same, seen = walks.agree(symbols, at + n, self.symbols, inside + n, 1, steps)
            s, m = walks.agree(symbols, at - 1, self.symbols, inside - 1, -1, steps)
            ok = same + s >= AGREE * (seen + m)
            kept.append(left[:, ok])
            left = left[:, ~ok]
            if not left.shape[1]:
                break
        return np.concatenate(kept, axis=1)

    def verified(self, k: int, text: str, begin: int) -> int | None:
        """Distance of item k to the text around begin, where it should start."""
        item, most = self.texts[k], self.most[k]
        window = text[max(0, begin - most) : max(0, begin + len(item) + most)]
        if item in window:
            return 0
        # An edit spoils at most three 3-grams; those of the window may be used as often as they come.
        have, met = three_grams(window), 0
        for g, n in self.grams[k].items():
            met += min(n, have.get(g, 0))
        if met < len(item) - 2 - 3 * most:
            return None
        return edit_distance_inside(item, window, most)

    def search(self, texts: list[str]) -> list[dict[int, int]]:
        """For each normal text: item numbers and distances."""
        found: list[dict[int, int]] = [{} for _ in texts]
        k = 0
        while k < len(texts):
            size, last = 0, k
            while last < len(texts) and (last == k or size + len(texts[last]) < TOGETHER):
                size += len(texts[last]) + 1
                last += 1
            self._search(texts[k:last], found[k:last])
            k = last
        return found

    def _search(self, texts: list[str], found: list[dict[int, int]]) -> None:
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        if self.seeds and bounds[-1] > len(texts):
            margin = self.full + PERIOD
            chars = codes(" ".join(texts))
            symbols = np.concatenate([np.full(margin, 1, np.uint8), symbol(chars), np.full(margin, 1, np.uint8)])
            done: set[tuple[int, int, int]] = set()

            def finish(windows: np.ndarray) -> None:
                for steps in (*LOOKS[1:], self.full):
                    windows = self.stay(symbols, windows, steps)
                at, item, offset, _ = windows
                docs = np.searchsorted(bounds, at - margin, side="right") - 1
                for doc, k, begin in zip(docs.tolist(), item.tolist(), (at - margin - bounds[docs] - offset).tolist()):
                    if k in found[doc] or (doc, k, begin) in done:
                        continue
                    done.add((doc, k, begin))
                    if (d := self.verified(k, texts[doc], begin)) is not None:
                        found[doc][k] = 0 if self.texts[k] in texts[doc] else d

            kept, many = [], 0
            for at, item, offset, n in self.seeds.windows(chars):
                kept.append(self.stay(symbols, np.stack([at + margin, item, offset, np.full(len(at), n)]), LOOKS[0]))
                many += kept[-1].shape[1]
                if many > AT_ONCE:
                    finish(np.concatenate(kept, axis=1))
                    kept, many = [], 0
            if many:
                finish(np.concatenate(kept, axis=1))
        if self.searched:
            self.search_exactly(texts, found, bounds)

    def search_exactly(self, texts: list[str], found: list[dict[int, int]], bounds: np.ndarray) -> None:
        joined = " ".join(texts)
        chars = codes(joined)
        for k in self.searched:
            item, most = self.texts[k], self.most[k]
            if not most:
                maybe = {int(np.searchsorted(bounds, p, side="right")) - 1 for p in places_of(item, joined)}
            elif len(item) <= 64:
                maybe = set((np.searchsorted(bounds, ends_near(codes(item), chars, most), side="right") - 1).tolist())
            else:
                maybe = range(len(texts))
            for doc in maybe:
                if texts[doc] and k not in found[doc] and (d := edit_distance_inside(item, texts[doc], most)) is not None:
                    found[doc][k] = d


def places_of(item: str, text: str):
    at = text.find(item)
    while at >= 0:
        yield at
        at = text.find(item, at + 1)


def ends_near(item: np.ndarray, text: np.ndarray, most: int) -> np.ndarray:
    """Places of text at which a part ends that is within most edits of item (64 characters at most). Lanes side by side (Myers)."""
    m = len(item)
    letters, which = np.unique(item, return_inverse=True)
    table = np.zeros(len(letters) + 1, np.uint64)
    np.bitwise_or.at(table, which, np.uint64(1) << np.arange(m, dtype=np.uint64))
    own = np.searchsorted(letters, text)
    own[own == len(letters)] = 0
    own = np.where(letters[own] == text, own, len(letters))
    lead = m + most
    lanes = -(-len(text) // LANE)
    padded = np.full(lead + lanes * LANE, len(letters))
    padded[lead : lead + len(text)] = own
    starts = np.arange(lanes) * LANE
    pv, mv, score = np.full(lanes, ~np.uint64(0)), np.zeros(lanes, np.uint64), np.full(lanes, m)
    one, top, out = np.uint64(1), np.uint64(m - 1), []
    for j in range(lead + LANE):
        eq = table[padded[starts + j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
        if j >= lead and (score <= most).any():
            out.append(starts[score <= most] + j - lead)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
    ends = np.concatenate(out) if out else np.empty(0, np.int64)
    return ends[ends < len(text)]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[list[tuple[int, str]]]:
    """The items in blocks; a benchmark is small next to a corpus, and each block has a size bound."""
    out, size = [[]], 0
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).distinct()
    for r in rows.orderBy("i", "t").toLocalIterator():
        t = normal(r["t"])
        if t:
            if len(out[-1]) >= BLOCK_ITEMS or size + len(t) > BLOCK_CHARS and out[-1]:
                out.append([])
                size = 0
            out[-1].append((r["i"], t))
            size += len(t)
    return [b for b in out if b]


def _ready(items: tuple[tuple[int, str], ...], similarity: float, exact: bool) -> Benchmark:
    return common.held(("benchmark", items, similarity, exact), lambda: Benchmark(list(items), similarity, exact))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """(doc_id, item_id, distance): the items that each row holds at that similarity or more."""
    df, spark = common.id_text(docs, id_col, text_col), docs.sparkSession
    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, item_id long, distance int"
    out = spark.createDataFrame([], schema)
    for items in blocks(benchmark):
        sent = spark.sparkContext.broadcast(tuple(items))

        def run(batches, sent=sent):
            ready = _ready(sent.value, similarity, exact)
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    part = b.slice(k, 256)
                    found = ready.search([normal(t) for t in part.column(1).to_pylist()])
                    rows = [k for k, f in enumerate(found) for _ in f]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array([ready.ids[i] for f in found for i in f], pa.int64()), pa.array([d for f in found for d in f.values()], pa.int32())], names=["doc_id", "item_id", "distance"])

        out = out.union(df.mapInArrow(run, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text", exact: bool = False) -> DataFrame:
    """The rows of docs that hold no item, with docs' columns."""
    spark, schema, at = docs.sparkSession, docs.schema, docs.columns.index(text_col)
    for items in blocks(benchmark):
        sent = spark.sparkContext.broadcast(tuple(items))

        def run(batches, sent=sent):
            ready = _ready(sent.value, similarity, exact)
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    part = b.slice(k, 256)
                    found = ready.search([normal(t) for t in part.column(at).to_pylist()])
                    yield part.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs


def op10_cgk_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "distance")
