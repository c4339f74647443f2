"""Conversation repair against an exhaustive search, and the agenda."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from barloom.llm import conversations as cv

COLUMNS = "conv_id long, turn long, role string, text string, conv string, task int"
WS = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def every_repair(rows):
    """The least (cost, audit) and the lines over all edits with at most two inserts a gap; rows: role, text, fault."""
    best = None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    choices = [["D"] + (["K", "user", "assistant"] if f in ("", "truncated") else []) for *_, f in rows]
    for edits in product(*choices):
        cost = sum({"D": 4, "K": 0}.get(e, 3) + (3 if e != "D" and r[2] == "truncated" else 0) for e, r in zip(edits, rows, strict=True))
        for gaps in product(inserts, repeat=len(rows) + 1):
            total = cost + 3 * sum(map(len, gaps))
            if best and total > best[0]:
                continue
            audit, lines = "", []
            for k, gap in enumerate(gaps):
                audit += "I" * len(gap)
                lines += [(g, "") for g in gap]
                if k < len(rows):
                    audit += edits[k] if edits[k] in "DK" else "R"
                    if edits[k] != "D":
                        lines.append((rows[k][0] if edits[k] == "K" else edits[k], rows[k][1]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "." for r, _ in lines)) and (best is None or (total, audit) < best[:2]):
                best = (total, audit, lines)
    return best


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        faults, seen = [], set()
        for _, _, role, text in mine:
            bare = text.strip(WS)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, lines = every_repair([(r[2], r[3], f) for r, f in zip(mine, faults, strict=True)])
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest))
    return out


def repaired(spark, rows, segment=cv.SEGMENT):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS)
    return [tuple(r) for r in cv.repair(cv.damaged(df), segment).collect()]


@pytest.mark.parametrize("segment", [1, 256])
def test_repair_against_every_edit(spark, segment):
    rng = random.Random(4)
    roles, texts = ["user", "assistant", "system", "User", "tool", "", None], ["Hello.", "Why?", "no end", "Hello. ", "é!", "", " \n", " ", None]
    rows = []
    for conv in range(60):
        turns = sorted(rng.sample(range(9), rng.randint(1, 4)))
        rows += [(conv, t + conv, rng.choice(roles[:3] if conv % 2 else roles), rng.choice(texts[:4] if conv % 3 else texts)) for t in turns]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (70, None, "user", "A."), (71, 0, None, None)]
    rng.shuffle(rows)
    assert sorted(map(str, repaired(spark, rows, segment))) == sorted(map(str, brute(rows)))


def test_hot_conversation_meets_no_task_whole(spark):
    rng = random.Random(6)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", "?", ""]) + f" {k}." * rng.randint(0, 1)) for k in range(3000)]
    rows += [(2, 0, "user", "Q?"), (2, 1, "assistant", "A.")]
    one, many = (sorted(repaired(spark, rows, s)) for s in (10_000, 7))
    assert one == many and {r[0] for r in one} == {1, 2}
    kept = damaged([r for r in rows if r[0] == 1])
    got = next(r for r in one if r[0] == 1)
    assert len(got[7].replace("I", "")) == len(kept)
    parts = cv._segments(cv._sorted_rows(cv.damaged(spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS))), 10_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows stay in one task
    try:
        assert parts.filter("conv = 1").select("task").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_edges(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert cv.repair(cv.damaged(empty)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    sound = next(t for t in range(1000) if zlib.crc32(f"6:{t}".encode()) % 20 > 4)
    got = {r[0]: r for r in repaired(spark, [(5, gone, "user", "Hi."), (6, sound, "user", "x" * 3_000_000)])}
    assert got[5] == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[6][4:8] == (1, 0, 4, "D")  # a long truncated text costs less to delete than to keep and answer
    assert cv.damaged(empty.withColumn("copy", F.lit(1))).columns == ["conv", "turn", "role", "text"]


def test_agenda_finalises_by_value_and_stops_at_the_goal():
    edges = {"a": [("b", 2), ("c", 5)], "b": [("c", 1), ("d", 9)], "c": [("d", 1)], "d": [("e", 0)]}
    popped = []

    def deductions(item, final):
        popped.append(item)
        for to, cost in edges.get(item, []):
            yield to, (final[item][0] + cost, final[item][1] + to)

    final = cv.lightest({"a": (0, "")}, deductions, {"d"})
    assert final == {"a": (0, ""), "b": (2, "b"), "c": (3, "bc"), "d": (4, "bcd")} and "e" not in popped


def test_segments_compose_to_the_whole():
    rng = random.Random(9)
    for _ in range(200):
        rows = [(rng.choice("suax"), rng.randrange(4)) for _ in range(rng.randint(0, 9))]
        cut = rng.randint(0, len(rows))
        left = cv.derive(rows[:cut], cv.START)
        right = {p: cv.derive(rows[cut:], p) for p in range(4)}
        whole = cv.derive(rows, cv.START)
        assert {q: v for q, (v, _) in cv.compose(left, right).items()} == whole
        goal = min((whole[q] for q in cv.GOALS if q in whole), default=None)
        assert list(cv.derive(rows, cv.START, cv.GOALS).values()) == [goal]
