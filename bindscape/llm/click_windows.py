"""Expiring click deduplication: a stateful stream that keeps one open window for each click.

Events (click_id, hour, batch, hash) are written once, by batch, to the shared folder. An applyInPandasWithState query
is started anew for each batch on one checkpoint; each start sees the folders up to its batch and reads what is
new. The first event of a click opens a window; events up to ``window`` hours later are repeats; a later one
closes it and opens another. The watermark is the largest hour so far less ``late`` hours: Spark drops what is older, and
timeouts close windows that nothing can meet any more. A sentinel event far ahead comes with the last batch, so that timeouts
close all that is left; only that start is followed by a batch without data.

Hours are shifted so that the first is 1 (Spark drops all up to watermark 0, and old hours may be negative). The delay is a
millisecond longer than ``late`` hours: Spark drops event times equal to the watermark, which here are still to be kept. Windows
that fall due after batch b are closed by the start of batch b + 1, before its events are folded.

State is kept for groups of clicks (a hash of click_id; as many groups as make some ``per_group`` events each), not for one
click each: a call, a pandas frame and a timer for every click cost some 7 ms of CPU a window (measured with transformWithStateInPandas, see
the README), and the tables have five million clicks. Within a group every click has its own row of opener, counters and crc sum, held as one
binary value; with ``per_group=0`` the key is click_id itself. Results are the same. All clicks of a group are folded at once, by
sorted arrays. Nothing goes through one task or the driver but minima, maxima, and the count of events.

The state's files are in the checkpoint; a task holds the state of its partition while it runs, and gives it up when it commits. RocksDB, and so
transformWithState, would keep about half a MB outside the heap for each store that an executor has ever opened (one a partition and start): Spark 4.1.2 does not
close the statistics it makes for each.

Events of a click arrive as rows of 48 bytes; one click's events of a batch are sorted in one task, which is the one
thing that grows with a hot click. Events without click_id or hour have no batch and open nothing. A null hash counts as 32 zero bytes.
Repeated events are repeats. Empty tables give no rows. Batches without events are passed over. Executors may be lost: state, events and results
are in the shared folder, and the file sink keeps each batch's rows once. Only the columns named are read, whatever else there is.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import TimestampNTZType

from . import common

WINDOW, LATE, BATCHES = 24, 96, 8
#: Events of a group of clicks over all batches, on average.
PER_GROUP = 16_384
HOUR_MS = 3_600_000
#: What the state of a group holds of each click.
OPEN = np.dtype([("click", "<i8"), ("start", "<i8"), ("repeats", "<i8"), ("conflicts", "<i8"), ("crc", "<i8"), ("hash", "S32")])
RESULT = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash binary"
EVENT = "click_id long, hour long, hash binary, crc long"

SETTINGS = {
    # Not RocksDB: Spark 4.1 never frees the statistics of a store that it closes, see above.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    # A start runs one batch: its stores are of no use to the next, and would stay in memory.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # One watermark for late events and timers: the one that the batches before this one have left.
    "spark.sql.streaming.statefulOperator.allowMultiple": "false",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def fold(held: np.ndarray, click: np.ndarray, hour: np.ndarray, hashes: np.ndarray, crc: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows that events close, and those that are open after them. held: open windows, by click; events in any order."""
    order = np.lexsort((hashes, hour, click))
    click, hour, hashes, crc = click[order], hour[order], hashes[order], crc[order]
    ids, first = np.unique(click, return_index=True)
    ends = np.append(first[1:], len(click))
    low = int(hour.min())
    span = int(hour.max()) - low + 2
    place = np.repeat(np.arange(len(ids)) * span, ends - first) + (hour - low + 1)

    at = np.minimum(np.searchsorted(held["click"], ids), max(0, len(held) - 1))
    known = held["click"][at] == ids if len(held) else np.zeros(len(ids), bool)
    windows = [held[at[known]]]
    current = np.full(len(ids), -1)  # the open window of each click
    current[known] = np.arange(known.sum())
    start = np.zeros(len(ids), np.int64)
    start[known] = windows[0]["start"]
    n, pos, live = int(known.sum()), first.copy(), np.arange(len(ids))
    reach: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # events [from, to) repeat a window
    while len(live):
        new = live[current[live] < 0]
        if len(new):
            made = np.zeros(len(new), OPEN)
            made["click"], made["start"], made["hash"] = ids[new], hour[pos[new]], hashes[pos[new]]
            windows.append(made)
            start[new], current[new] = made["start"], n + np.arange(len(new))
            n += len(new)
            pos[new] += 1
        last = np.clip(start[live] + window - low + 1, 0, span - 1)
        to = np.maximum(pos[live], np.searchsorted(place, live * span + last, side="right"))
        reach.append((pos[live].copy(), to, current[live].copy()))
        pos[live] = to
        live = live[to < ends[live]]
        current[live] = -1
    every = np.concatenate(windows)
    begin, end, of = (np.concatenate(x) for x in zip(*reach, strict=True))
    size = end - begin
    of = np.repeat(of, size)
    rows = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    odd = hashes[rows] != every["hash"][of]
    np.add.at(every["repeats"], of, 1)
    np.add.at(every["conflicts"], of, odd)
    np.add.at(every["crc"], of, np.where(odd, crc[rows], 0))
    stay = np.zeros(n, bool)
    stay[current] = True
    rest = held if not len(held) else held[~np.isin(held["click"], ids)]
    still = np.concatenate([rest, every[stay]])
    return every[~stay], still[np.argsort(still["click"], kind="stable")]


def walker(batch: int, before: int, end: int, base: int, window: int, final: int) -> Callable:
    """What a start does with a group of clicks: its open windows are the state, its timeout is when the first of them falls due.

    What falls due at the watermark that this start finds closes after the batch before. final: the watermark that the last batch
    leaves; beyond it, the sentinel has closed what falls due at it after this batch, and the rest at the end.
    """

    def due(held: np.ndarray) -> np.ndarray:
        return held["start"] + window - base

    def expire(held: np.ndarray, watermark: int) -> tuple[np.ndarray, np.ndarray]:
        over = due(held) * HOUR_MS < watermark + 1
        return held[over], held[~over]

    def walk(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [(p["click_id"].to_numpy(np.int64), p["hour"].to_numpy(np.int64), np.array(p["hash"].tolist(), "S32"), p["crc"].to_numpy(np.int64)) for p in (p[p["hash"].notna()] for p in rows) if len(p)]
        watermark = state.getCurrentWatermarkMs()
        held = np.frombuffer(bytes(state.get[0]), OPEN) if state.exists else np.empty(0, OPEN)
        over, held = expire(held, watermark)
        closed = np.empty(0, OPEN)
        if parts:
            closed, held = fold(held, *(np.concatenate(x) for x in zip(*parts, strict=True)), window=window)
        if len(held):
            state.update((held.tobytes(),))
            state.setTimeoutTimestamp(int(due(held).min()) * HOUR_MS)
        elif state.exists:
            state.remove()
        if watermark > final:
            last, rest = expire(over, final)
            found = ((last, batch), (rest, end))
        else:
            found = ((over, before), (closed, batch))
        closed, at = np.concatenate([x for x, _ in found]), np.concatenate([np.full(len(x), b) for x, b in found])
        if len(closed):
            raw = closed["hash"].tobytes()
            yield pd.DataFrame({"click_id": closed["click"], "start_hour": closed["start"], "closed_batch": at, "n_repeats": closed["repeats"], "n_conflicts": closed["conflicts"], "conflict_crc": closed["crc"], "hash": [raw[k : k + 32] for k in range(0, len(raw), 32)]})

    return walk


def windows(events: DataFrame, n_batches: int, window: int = WINDOW, late: int = LATE, per_group: int = PER_GROUP) -> DataFrame:
    """Windows of events (click_id long, hour long, batch long, hash binary, crc long), which are fed batch by batch.

    The result's columns are those of RESULT. closed_batch is the batch in which, or after which, a window has closed.
    """
    spark = events.sparkSession
    where = common.shared_dir(spark, "click-windows")
    events.where("click_id is not null and hour is not null").select("batch", "click_id", "hour", F.coalesce("hash", F.lit(bytes(32))).alias("hash"), "crc").write.partitionBy("batch").parquet(f"{where}/events")
    written = spark.read.schema(f"{EVENT}, batch long").parquet(f"{where}/events")
    fed = sorted(written.groupBy("batch").agg(F.min("hour").alias("low"), F.max("hour").alias("high"), F.count("*").alias("n")).collect())
    if not fed:
        return spark.createDataFrame([], RESULT)
    low, high, n = min(r["low"] for r in fed), max(r["high"] for r in fed), sum(r["n"] for r in fed)
    # The sentinel: no hash, so no event, and so far ahead that all windows fall due.
    spark.createDataFrame([(0, high + late + window + 2, None, 0)], EVENT).write.parquet(f"{where}/events/batch={n_batches}")
    base = low - 1
    groups = -(-n // per_group) if per_group else 0
    key = F.pmod(F.xxhash64("click_id"), F.lit(groups)) if groups else F.col("click_id")
    order = [r["batch"] for r in fed]
    for k, batch in enumerate(order):
        last = k == len(order) - 1
        seen = ",".join(map(str, [*order[: k + 1], *[n_batches] * last]))
        with settings(spark, SETTINGS | {"spark.sql.streaming.noDataMicroBatches.enabled": str(last).lower()}):
            stream = spark.readStream.schema(EVENT).parquet(f"{where}/events/batch={{{seen}}}")
            timed = stream.select(key.alias("grp"), "click_id", "hour", "hash", "crc", F.timestamp_millis((F.col("hour") - base) * HOUR_MS).alias("at")).withWatermark("at", f"{late * HOUR_MS + 1} milliseconds")
            walk = walker(batch, order[k - 1] if k else batch, n_batches - 1, base, window, (high - base - late) * HOUR_MS - 1)
            found = timed.groupBy("grp").applyInPandasWithState(walk, RESULT, "open binary", "append", "EventTimeTimeout")
            query = found.writeStream.format("parquet").option("path", f"{where}/windows").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    return spark.read.schema(RESULT).parquet(f"{where}/windows")


def _micros(col: str, df: DataFrame) -> Column:
    """Microseconds since 1970 of a UTC time, whatever the session's zone: a time without a zone is UTC."""
    if not isinstance(df.schema[col].dataType, TimestampNTZType):
        return F.unix_micros(F.col(col))
    seconds = F.date_part(F.lit("SECOND"), F.col(col)) * 1_000_000
    return F.unix_date(F.to_date(col)).cast("long") * 86_400_000_000 + (F.hour(col).cast("long") * 60 + F.minute(col)) * 60_000_000 + seconds.cast("long")


def copies(clicks: DataFrame, n_batches: int = BATCHES) -> DataFrame:
    """The copies of clicks in which they arrive: (click_id, hour, batch, hash, crc)."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    arrived = _micros("arrived_at", clicks)
    own = clicks.where("click_id is not null and arrived_at is not null").select(
        "click_id",
        ((arrived - F.pmod(arrived, F.lit(3_600_000_000))) / 3_600_000_000).cast("long").alias("arrived"),
        F.concat_ws("|", text(F.col("client_id")), text(F.col("kind")), text(F.floor(100 * F.col("value") + 0.5)), text(_micros("ts", clicks)), text(F.col("props")), F.lit("")).alias("shown"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("click_id") % 3).cast("int"))).alias("j"),
    )
    c = F.crc32(F.concat_ws(":", "click_id", "j").cast("binary"))
    own = own.withColumn("c", c).withColumn("hour", F.col("arrived") + 6 * F.col("j") * (F.col("c") % 10))
    own = own.withColumn("seen", F.col("hour") + F.floor(F.col("c") / 10) % 200)
    low, high = own.agg(F.min("seen"), F.max("seen")).first()
    hashed = F.sha2(F.concat("shown", (F.col("c") % 3).cast("string")).cast("binary"), 256)
    batch = F.floor((F.col("seen") - F.lit(low)) * n_batches / (F.lit(high) - F.lit(low) + 1)) if low is not None else F.lit(0).cast("long")
    return own.select("click_id", "hour", batch.alias("batch"), F.unhex(hashed).alias("hash"), F.crc32(hashed.cast("binary")).alias("crc"))


def op12_click_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows(copies(common.table(spark, sf_dir, "clicks")), BATCHES)
    return found.withColumn("hash", F.lower(F.hex("hash")))
