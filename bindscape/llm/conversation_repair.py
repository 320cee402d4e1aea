"""Conversation structure repair: the cheapest edits that give role initials ``(s?(ua)+)?``.

A conversation's rows, in order of turn, pass a forward Viterbi search over four grammar states: nothing yet, after
system, after user, after assistant. A row is kept (0), made user or assistant (1) or deleted (2); an undeleted
truncated row costs 5 more, blank and duplicate rows must go. After each row, and before the first, up to two empty user or
assistant turns can be inserted (5 each): two lead from any state to any other that inserts can reach, so more never
pay. Every state carries its least (cost, audit string); the string of initials decides all costs, so equal costs never
have one string as the start of another, and the least prefix stays least.

Scale. Blank and truncated rows are found by expressions, duplicates by a window for each different text of a
conversation. Then rows are dealt out by conversation and sorted in each partition, and a task reads them as a stream. It holds
no conversation: a state that costs 10 more than the best can't win (any state can do what another does for 10 at most), and
what all remaining audit strings begin with is final, so its turns leave at once. A conversation of any length so needs memory for
the turns whose fate is open, and its audit string. Hashing a conversation in order is one task's work by definition.

Null text, role, or part of the crc's text counts as one space; null turns come first and don't count in gaps; a null conv_id is
one conversation. Rows of the same turn are ordered by role, then text. Of rows that are equal in all of that the first is no duplicate. An
unknown role can be kept only if its initial is s, u or a. Very long texts are handled whole. An empty table gives no
rows. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Two states' best completions differ by two inserts at most.
SPREAD = 2 * INSERT
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: State after a role's initial, by state.
NEXT = {EMPTY: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The one of user and assistant that may follow a state; inserts and new roles are these.
MADE = {EMPTY: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
ENDS = (EMPTY, ASSISTANT)
LEGAL = {"su", "ua", "au"}
#: Characters that are not spaces, as the contract has them, and ends of sentences.
INK, LAST = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: Turns that a task holds before it looks for what is final.
LAG = 64


class Search:
    """Rows of one conversation in, edits in final order out: add() and close() give (edit, role, text) of what has become final."""

    def __init__(self):
        self.best: dict[int, tuple[int, str]] = {EMPTY: (0, "")}
        self.turns: list[tuple[str, str]] = []
        self.state, self.cost, self.parts = EMPTY, 0, []
        self._insert()

    def _insert(self) -> None:
        for _ in range(2):
            for state, (cost, audit) in list(self.best.items()):
                self._offer(self.best, NEXT[state][MADE[state][0]], cost + INSERT, audit + "I")

    @staticmethod
    def _offer(best: dict, state: int, cost: int, audit: str) -> None:
        if state not in best or (cost, audit) < best[state]:
            best[state] = (cost, audit)

    def add(self, role: str, text: str, must_go: bool, truncated: bool) -> list[tuple[str, str, str]]:
        self.turns.append((role, text))
        layer: dict[int, tuple[int, str]] = {}
        more = TRUNCATED if truncated else 0
        for state, (cost, audit) in self.best.items():
            self._offer(layer, state, cost + DELETE, audit + "D")
            if not must_go:
                if (to := NEXT[state].get(role[:1])) is not None:
                    self._offer(layer, to, cost + KEEP + more, audit + "K")
                self._offer(layer, NEXT[state][MADE[state][0]], cost + REROLE + more, audit + "R")
        self.best = layer
        self._insert()
        least = min(cost for cost, _ in self.best.values())
        self.best = {s: x for s, x in self.best.items() if x[0] <= least + SPREAD}
        return self._final(commonprefix([a for _, a in self.best.values()])) if len(self.turns) >= LAG else []

    def close(self) -> list[tuple[str, str, str]]:
        self.cost, audit = min(self.best[s] for s in ENDS if s in self.best)
        self.best = {EMPTY: (self.cost, audit)}
        return self._final(audit)

    def _final(self, audit: str) -> list[tuple[str, str, str]]:
        """Walk the edits that no later row can change, and forget their turns."""
        out, at = [], 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else self.turns[at]
            at += edit != "I"
            if edit != "D":
                role = role if edit == "K" else MADE[self.state]
                self.state = NEXT[self.state][role[:1]]
            out.append((edit, role, text))
        del self.turns[:at]
        self.parts.append(audit)
        self.best = {s: (cost, a[len(audit) :]) for s, (cost, a) in self.best.items()}
        return out

    @property
    def audit(self) -> str:
        return "".join(self.parts)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows after damage; a dropped row stays, with gone set, so that its conversation does."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.concat(*[x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))][:-1])
    own = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("d"))
    hurt = F.when(F.col("d").isin(0, 1), "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    who = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    return own.select("conv_id", "turn", who.alias("role"), hurt.alias("text"), (F.col("d") == 0).alias("gone"), F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """rows of (conv_id, turn, role, text, gone) with each row's first fault: blank, duplicate, truncated or null."""
    marked = rows.withColumn("blank", ~F.col("text").rlike(INK))
    # Blank and dropped rows are no one's duplicates: they are dealt by turn, so that many of them don't meet.
    apart = F.when(F.col("blank") | F.col("gone"), F.struct(F.lit(True).alias("x"), F.col("turn")))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", apart, "gone").orderBy(F.col("turn").asc_nulls_first()))
    fault: Column = F.when(F.col("blank"), "blank").when(seen > 1, "duplicate").when(~F.col("text").rlike(LAST), "truncated")
    return marked.withColumn("fault", F.when(~F.col("gone"), fault)).drop("blank")


def _in_order(rows: DataFrame) -> DataFrame:
    cols = rows.select("conv_id", "turn", "role", "text", "gone", "fault")
    again = F.coalesce(F.col("fault") == "duplicate", F.lit(False))
    return cols.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "gone", F.col("turn").asc_nulls_first(), "role", "text", again)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, turn, role, text, gone, fault, first row of its conversation) in order."""
    last = object()
    for batch in common.pieces(batches):
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            yield (*row, row[0] != last)
            last = row[0]


def _schema(rows: DataFrame, ddl: str) -> str:
    return ddl.format(id=rows.schema["conv_id"].dataType.simpleString(), turn=rows.schema["turn"].dataType.simpleString())


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _sink(out: pa.Schema, rows: Iterable[tuple], size: int = 200) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, edit, role, text): the repaired conversations, turn by turn, deleted rows included with a null pos."""
    schema = _schema(rows, "conv_id {id}, pos long, edit string, role string, text string")
    arrow = _arrow(schema)

    def run(batches):
        def turns():
            conv, search, pos = None, None, 0

            def numbered(edits):
                nonlocal pos
                for edit, role, text in edits:
                    yield (conv, None if edit == "D" else pos, edit, role, text)
                    pos += edit != "D"

            for conv_id, _, role, text, gone, fault, first in _runs(batches):
                if first:
                    if search:
                        yield from numbered(search.close())
                    conv, search, pos = conv_id, Search(), 0
                if not gone:
                    yield from numbered(search.add(role, text, fault in ("blank", "duplicate"), fault == "truncated"))
            if search:
                yield from numbered(search.close())

        yield from _sink(arrow, turns())

    return _in_order(rows).mapInArrow(run, schema)


def report(rows: DataFrame) -> DataFrame:
    """A row for each conversation: gaps, faults, illegal pairs of roles, cost, audit, and the hash of the repaired turns."""
    schema = _schema(rows, "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    arrow = _arrow(schema)

    class Tally:
        def __init__(self, conv_id):
            self.conv_id, self.search, self.hash, self.empty = conv_id, Search(), hashlib.sha256(), True
            self.faults, self.illegal, self.initial = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None
            self.first = self.last = None
            self.turns = 0

        def write(self, edits):
            for edit, role, text in edits:
                if edit != "D":
                    self.hash.update((f"{role}:{text}" if self.empty else f"\n{role}:{text}").encode("utf-8", "replace"))
                    self.empty = False

        def add(self, turn, role, text, fault):
            if fault:
                self.faults[fault] += 1
            if self.initial is not None:
                self.illegal += self.initial + role[:1] not in LEGAL
            self.initial = role[:1]
            if turn is not None:
                self.turns += turn != self.last
                self.first, self.last = turn if self.first is None else self.first, turn
            self.write(self.search.add(role, text, fault in ("blank", "duplicate"), fault == "truncated"))

        def row(self):
            self.write(self.search.close())
            gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
            return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.search.cost, self.search.audit, self.hash.hexdigest())

    def run(batches):
        def conversations():
            tally = None
            for conv_id, turn, role, text, gone, fault, first in _runs(batches):
                if first:
                    if tally:
                        yield tally.row()
                    tally = Tally(conv_id)
                if not gone:
                    tally.add(turn, role, text, fault)
            if tally:
                yield tally.row()

        yield from _sink(arrow, conversations())

    return _in_order(rows).mapInArrow(run, schema)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(faults(damaged(common.table(spark, sf_dir, "conversations"))))
