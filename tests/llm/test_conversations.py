"""Conversation repair against a search over all edit scripts."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from bindscape.llm import conversation_repair as X

SF = "/root/testdata/sf0.001"
GRAMMAR = re.compile(r"(s?(ua)+)?")
INK = re.compile(r"[^\x20\x09-\x0d]")


def scripts(rows):
    """Every (cost, audit, repaired) with up to two inserts at a place."""
    if not rows:
        tails = [(0, "", [])]
    else:
        (role, text, must, cut), tails = rows[0], []
        ways = [(2, "D", None)]
        if not must:
            ways += [(5 * cut, "K", (role, text)), *((1 + 5 * cut, "R", (r, text)) for r in ("user", "assistant"))]
        for c, a, out in scripts(rows[1:]):
            tails += [(w + c, e + a, ([t] if t else []) + out) for w, e, t in ways]
    found = [(5 * k + c, "I" * k + a, [(r, "") for r in made] + out) for k in range(3) for made in itertools.product(("user", "assistant"), repeat=k) for c, a, out in tails]
    return found


def legal(out):
    return GRAMMAR.fullmatch("".join(r[:1] or "-" for r, _ in out))


def faulty(rows):
    seen, out = set(), []
    for _, role, text in rows:
        ink = INK.findall(text)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else None if ink[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def brute(table):
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        groups[conv]
        n = lambda x: " " if x is None else str(x)
        d = zlib.crc32(f"{n(conv)}:{n(turn)}".encode()) % 20
        role, text = n(role), n(text)
        if d:
            row = (turn, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)
            groups[conv] += [row] * (2 if d == 3 else 1)
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marks = faulty(rows)
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, fixed = min((c, a, o) for c, a, o in best_scripts([(r[1], r[2], m in ("blank", "duplicate"), m == "truncated") for r, m in zip(rows, marks, strict=True)]))
        text = "\n".join(f"{r}:{t}" for r, t in fixed)
        out.append((conv, gaps, *(marks.count(k) for k in ("blank", "duplicate", "truncated")), pairs, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def best_scripts(rows):
    """All scripts where they are few, else a search backwards from the end that takes the least letters."""
    if len(rows) <= 2:
        return [x for x in scripts(rows) if legal(x[2])]
    made = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    after = lambda s, i: {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, i))
    todo = [[None] * 4 for _ in range(len(rows) + 1)]
    for at in range(len(rows), -1, -1):
        cost = [0 if at == len(rows) and s in (0, 3) else 10**9 for s in range(4)]
        if at < len(rows):
            role, _, must, cut = rows[at]
            for s in range(4):
                ways = [2 + todo[at + 1][s]]
                if not must:
                    ways.append(1 + 5 * cut + todo[at + 1][after(s, made[s][0])])
                    if after(s, role[:1]) is not None:
                        ways.append(5 * cut + todo[at + 1][after(s, role[:1])])
                cost[s] = min(ways)
        for _ in range(3):
            cost = [min(cost[s], 5 + cost[after(s, made[s][0])]) for s in range(4)]
        todo[at] = cost
    s, at, audit, out, paid = 0, 0, "", [], 0
    while at < len(rows) or todo[at][s] > 0:
        left = todo[at][s]
        if at < len(rows) and 2 + todo[at + 1][s] == left:
            audit, at, paid = audit + "D", at + 1, paid + 2
            continue
        if 5 + todo[at][after(s, made[s][0])] == left:
            audit, out, paid, s = audit + "I", [*out, (made[s], "")], paid + 5, after(s, made[s][0])
            continue
        role, text, must, cut = rows[at]
        to = after(s, role[:1])
        if not must and to is not None and 5 * cut + todo[at + 1][to] == left:
            audit, out, paid, s, at = audit + "K", [*out, (role, text)], paid + 5 * cut, to, at + 1
        else:
            audit, out, paid, s, at = audit + "R", [*out, (made[s], text)], paid + 1 + 5 * cut, after(s, made[s][0]), at + 1
    return [(paid, audit, out)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_search_equals_all_scripts():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice("xyz"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 2))]
        search = X.Search()
        out = [e for r in rows for e in search.add(*r)] + search.close()
        cost, audit, fixed = min(x for x in scripts(rows) if legal(x[2]))
        assert (search.cost, search.audit, [e[1:] for e in out if e[0] != "D"]) == (cost, audit, fixed)
        assert best_scripts([*rows, *rows, ("user", "q", False, False)])


def test_long_search_forgets_turns():
    rng = random.Random(5)
    rows = [(rng.choice(["user", "assistant", "system"]), f"t{k}", rng.random() < 0.2, rng.random() < 0.2) for k in range(20_000)]
    search, most, out = X.Search(), 0, []
    for r in rows:
        out += search.add(*r)
        most = max(most, len(search.turns))
    out += search.close()
    assert most < 400
    [(cost, audit, fixed)] = best_scripts(rows)
    assert (search.cost, search.audit) == (cost, audit)
    assert [e[1:] for e in out if e[0] != "D"] == fixed


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(X.op13_conversation_repair(spark, SF)) == brute(rows)


def test_random_tables(spark):
    rng = random.Random(6)
    texts = ["", None, " \t", "Yes.", "Yes.", "no end", "Why?!", "x" * 200_000, "a.\n", " ", "é", "a. \x0b"]
    rows = [(rng.choice([*range(300), None]), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", None, "", "User"]), rng.choice(texts)) for _ in range(1500)]
    rows += rows[:40]
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "conv_id long, turn long, role string, text string, fault int, pos string, gone boolean").repartition(5)
    assert got(X.report(X.faults(X.damaged(df)))) == brute(rows)


def test_repaired_turns_are_what_is_hashed(spark):
    rows = X.faults(X.damaged(spark.read.parquet(f"{SF}/conversations.parquet")))
    turns, audits = defaultdict(list), defaultdict(str)
    for r in sorted(X.repaired(rows).collect(), key=lambda r: (r["conv_id"], r["pos"] is None, r["pos"])):
        if r["pos"] is not None:
            turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
            assert r["pos"] == len(turns[r["conv_id"]]) - 1
        audits[r["conv_id"]] += r["edit"]
    for r in X.report(rows).collect():
        assert hashlib.sha256("\n".join(turns[r["conv_id"]]).encode()).hexdigest() == r["repaired_sha256"]
        assert sorted(audits[r["conv_id"]]) == sorted(r["audit"])


@pytest.mark.parametrize("drop", [True, False])
def test_empty_and_all_dropped(spark, drop):
    ids = [i for i in range(500) if zlib.crc32(f"{i}:0".encode()) % 20 == 0] if drop else []
    df = spark.createDataFrame([(i, 0, "user", "Hi.") for i in ids], "conv_id long, turn long, role string, text string")
    out = X.report(X.faults(X.damaged(df))).collect()
    assert len(out) == len(ids)
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in out)
