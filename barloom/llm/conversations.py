"""Repair of conversation structure by Knuth's lightest derivations.

A row's role initial is a letter; a conversation is sound if its letters are an optional s and then ua, once or more (or
nothing at all). An item [p -> q] of some rows says that they can be repaired so that the grammar goes from state p to
state q; its value is (cost, audit), the edits' initials in order. Deductions extend an item by one edit, or compose an
item of rows with one of the rows after them. Their value functions only add: cost never falls and the audit grows to the
right, so a consequent never precedes its antecedents. Hence an agenda popped by least (cost, audit) finalises an item
when it is popped first, and stops at its goals. Two audits of one item with the same cost never differ only in their
length, since a longer one would have paid for its inserts; so extending both keeps their order.

Edits: Keep costs 0; Rerole, to user or assistant, 3; Delete 4, which blank and duplicate rows must get; Insert, an empty
user or assistant row anywhere, 3. Truncated rows that stay add 3. Ties go to the least audit.

Rows are sorted over ranges of (conversation, turn, role, text hash), so a conversation of any size spreads over tasks.
Each task derives items of segments of at most `segment` rows, from every state where the conversation began elsewhere.
A second, cheap pass walks a conversation's segments in order, composes their items from the start state and feeds the
repaired lines to one running SHA-256 per state; that hash is sequential by its nature, but the pass holds no more than a
segment, and the audit so far.

Null roles and texts count as one space (an unlawful role, a blank text); null turns come first. Rows of equal turn are
ordered by role and then by a hash of the text. A null conv_id is a conversation of its own. A conversation without rows
gives zeros, an empty audit and the hash of the empty text. An empty table gives an empty result; very long texts are only
hashed and joined; other columns are ignored."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Costs of the edits.
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 3, 3, 4, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a letter in a state; user and assistant rows may be inserted or made.
MOVES = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
GOALS = (START, ASSISTANT)
#: Rows and characters of a segment from which on a new one begins.
SEGMENT, SEGMENT_CHARS = 256, 1 << 18
#: Faults of a row.
SOUND, BLANK, DUPLICATE, CUT = range(4)

Value = tuple[int, str]


def lightest(axioms: dict[Hashable, Value], deductions: Callable[[Hashable, dict], Iterable[tuple[Hashable, Value]]], goals: set | None = None) -> dict[Hashable, Value]:
    """Final values of the items, in the order of their values, until every goal (None: every item) is final.

    deductions(item, final) yields the consequents, with their values, of all hyperedges whose last antecedent to become
    final is the item; final holds the values of the others."""
    final: dict[Hashable, Value] = {}
    agenda = [(value, item) for item, value in axioms.items()]
    best = dict(axioms)
    heapq.heapify(agenda)
    left = None if goals is None else set(goals)
    while agenda and left != set():
        value, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        if left is not None:
            left.discard(item)
        for consequent, at in deductions(item, final):
            if consequent not in final and (consequent not in best or at < best[consequent]):
                best[consequent] = at
                heapq.heappush(agenda, (at, consequent))
    return final


def edits_of(letter: str, fault: int, state: int) -> list[tuple[int, int, str]]:
    """Next state, cost and initial of the edits that use up a row in a state."""
    out = [(state, DELETE, "D")]
    if fault in (SOUND, CUT):
        more = TRUNCATED if fault == CUT else 0
        if letter in MOVES[state]:
            out.append((MOVES[state][letter], KEEP + more, "K"))
        for to in MOVES[state].values():
            if to in NAMES:
                out.append((to, REROLE + more, "R"))
    return out


def derive(rows: list[tuple[str, int]], start: int, goals: Iterable[int] | None = None) -> dict[int, Value]:
    """Lightest (cost, audit) of the items [start -> q] of whole rows (letter, fault), for the q that can be reached; or,
    given goals, of the first of them that becomes final."""
    n, goal = len(rows), (len(rows) + 1, 0)
    edits = {(k, q): edits_of(*row, q) for k, row in enumerate(rows) for q in range(4)}

    def deductions(item, final):
        k, q = item
        cost, audit = final[item]
        for to in MOVES[q].values():
            if to in NAMES:
                yield (k, to), (cost + INSERT, audit + "I")
        if k < n:
            for to, more, initial in edits[item]:
                yield (k + 1, to), (cost + more, audit + initial)
        elif goals is not None and q in goals:
            yield goal, final[item]

    final = lightest({(0, start): (0, "")}, deductions, {(n, q) for q in range(4)} if goals is None else {goal})
    found = {q: final[n, q] for q in range(4) if (n, q) in final}
    return found if goals is None else {q: v for q, v in found.items() if q in goals and v == final[goal]}


def compose(left: dict[int, Value], right: dict[int, dict[int, Value]]) -> dict[int, tuple[Value, int]]:
    """Items [p -> q] from items [p -> r] and [r -> q]: value and r. Both antecedents are final, so a consequent's best
    value is the least over its hyperedges."""
    out: dict[int, tuple[Value, int]] = {}
    for r, (cost, audit) in left.items():
        for q, (more, rest) in right.get(r, {}).items():
            value = (cost + more, audit + rest)
            if q not in out or value < out[q][0]:
                out[q] = (value, r)
    return out


def repaired(rows: list[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """Role and text of the rows after the edits, from a state."""
    left = iter(rows)
    for edit in audit:
        if edit == "D":
            next(left)
        elif edit == "K":
            role, text = next(left)
            state = MOVES[state][role[:1]]
            yield role, text
        else:
            state = next(to for to in MOVES[state].values() if to in NAMES)
            yield NAMES[state], next(left)[1] if edit == "R" else ""


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows conv, turn, role, text (one with a null role marks a conversation without more) with fault, dealt by ranges in
    their order."""
    fine = rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit("second"), "text"))
    # a text is a duplicate after its first turn; of equal rows in that turn, which the order puts side by side, all but one are
    first = fine.filter("role is not null").groupBy("conv", "role", "h1", "h2").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select(*[F.col(c).alias(f"of_{c}") for c in ("conv", "role", "h1", "h2")], F.col("first.turn").alias("first_turn"), F.lit(True).alias("often"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in ("conv", "role", "h1", "h2")]
    fine = fine.join(first, same[0] & same[1] & same[2] & same[3], "left")
    fine = fine.withColumn("later", F.col("often").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))).select("conv", "turn", "role", "text", "h1", "h2", "later")
    return fine.repartitionByRange("conv", "turn", "role", "h1", "h2").sortWithinPartitions("conv", "turn", "role", "h1", "h2")


SEGMENTS = "conv long, task int, number int, roles array<string>, texts array<string>, items array<struct<p:int,q:int,cost:long,audit:string>>, turns long, low long, high long, first long, last long, blank long, duplicate long, truncated long, illegal long, n long"


def _segments(rows: DataFrame, segment: int) -> DataFrame:
    """Items and counts of each segment of a conversation's rows."""
    marked = rows.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("cut", ~F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1).isin(".", "!", "?")).withColumn("task", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, number, begun, group, size = [], 0, None, [], 0  # begun: (conv,) of the open segment
        inner = False  # whether the open conversation is known to begin in this task
        before = None

        def close(whole: bool) -> None:
            letters = [(r["role"][:1], r["fault"]) for r in group]
            starts = (START,) if inner and number == 0 else range(4)
            turns = [r["turn"] for r in group if r["turn"] is not None]
            pairs = zip(letters, letters[1:], strict=False)
            items = [{"p": p, "q": q, "cost": c, "audit": a} for p in starts for q, (c, a) in derive(letters, p, GOALS if whole else None).items()]
            count = lambda f: sum(r["fault"] == f for r in group)
            out.append((begun[0], task, number, [r["role"] for r in group], [r["text"] for r in group], items, len(set(turns)), min(turns, default=None), max(turns, default=None),
                        turns[0] if turns else None, turns[-1] if turns else None, count(BLANK), count(DUPLICATE), count(CUT), sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in pairs), len(group)))

        task = 0
        for batch in batches:
            for conv, turn, role, text, h1, h2, later, blank, cut, task in zip(*[batch.column(c).to_pylist() for c in range(10)], strict=True):
                if begun != (conv,):
                    if begun is not None:
                        close(inner and number == 0)
                    inner, begun, number, group, size, before = begun is not None, (conv,), 0, [], 0, None
                elif len(group) >= segment or size > SEGMENT_CHARS:
                    close(False)
                    number, group, size = number + 1, [], 0
                if role is None:
                    continue
                again = (turn, role, h1, h2)
                fault = BLANK if blank else DUPLICATE if later or again == before else CUT if cut else SOUND
                before, size = again, size + len(text)
                group.append({"turn": turn, "role": role, "text": text, "fault": fault})
                if len(out) >= 256:
                    yield _batch(out)
                    out = []
        if begun is not None:
            close(False)
        if out:
            yield _batch(out)

    return marked.select("conv", "turn", "role", "text", "h1", "h2", "later", "blank", "cut", "task").mapInArrow(run, SEGMENTS)


_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])), *[pa.int64()] * 10]
_NAMES = [c.split()[0] for c in SEGMENTS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


class Walk:
    """A conversation's segments, fed in order: for each state that can be reached, the lightest repair so far."""

    def __init__(self):
        self.states: dict[int, Value] = {START: (0, "")}
        self.hashes = {START: (hashlib.sha256(), False)}  # and whether a line has been fed
        self.audit: list[str] = []  # the beginning that all states' audits share
        self.turns, self.low, self.high, self.last_turn = 0, None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.letter = None

    def feed(self, s: dict) -> None:
        rows = list(zip(s["roles"], s["texts"], strict=True))
        if not rows:
            return
        items: dict[int, dict[int, Value]] = {}
        for x in s["items"]:
            items.setdefault(x["p"], {})[x["q"]] = (x["cost"], x["audit"])
        met, hashes = compose(self.states, items), {}
        for q, (_, r) in met.items():
            h, fed = self.hashes[r]
            h = h.copy()
            for role, text in repaired(rows, items[r][q][1], r):
                h.update((("\n" if fed else "") + f"{role}:{text}").encode())
                fed = True
            hashes[q] = (h, fed)
        shared = len(commonprefix([v[1] for v, _ in met.values()]))
        self.audit.append(next(iter(met.values()))[0][1][:shared])
        self.states, self.hashes = {q: (cost, audit[shared:]) for q, ((cost, audit), _) in met.items()}, hashes
        if s["low"] is not None:
            self.turns += s["turns"] - (s["first"] == self.last_turn)
            self.low, self.high, self.last_turn = min(x for x in (self.low, s["low"]) if x is not None), s["high"], s["last"]
        for c in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, c, getattr(self, c) + s[c])
        if self.letter is not None and self.letter + rows[0][0][:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.letter = rows[-1][0][:1]

    def result(self) -> tuple:
        q = min((q for q in GOALS if q in self.states), key=lambda q: self.states[q])
        cost, audit = self.states[q]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit) + audit, self.hashes[q][0].hexdigest()


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation of the rows conv, turn, role, text. A row with a null role only says that there is such a
    conversation."""
    segments = common.cut(_segments(_sorted_rows(common.ship(rows)), segment))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, walk = None, None
        names = [c.split()[0] for c in RESULT.split(", ")]
        types = [*[pa.int64()] * 7, pa.string(), pa.string()]
        for batch in batches:
            out = []
            for s in batch.to_pylist():
                if of != (s["conv"],):
                    if of is not None:
                        out.append((of[0], *walk.result()))
                    of, walk = (s["conv"],), Walk()
                walk.feed(s)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if of is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((of[0], *walk.result()), types, strict=True)], names)

    return segments.repartition("conv").sortWithinPartitions("conv", "task", "number").mapInArrow(run, RESULT)


def damaged(df: DataFrame) -> DataFrame:
    """conv, turn, role, text of the contract's damaged rows, dropped ones with a null role."""
    nothing = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat(nothing("conv_id"), F.lit(":"), nothing("turn")).cast("binary")), F.lit(20))
    text = F.when(k == 1, F.lit("")).when(k == 2, F.regexp_replace(nothing("text"), "[.!?]", "")).otherwise(nothing("text"))
    role = F.when(k == 4, F.lit("user")).when(k != 0, nothing("role"))
    copies = F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return df.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(common.table(spark, sf_dir, "conversations")))


# The twin walks all conversations row by row in one recursion; {state, cost, audit} of a step are the least per state. Two
# inserts lead back to where they began in the grammar's cycle, so no gap needs more than two.
_TABLE = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
OP13_SQL = f"""
WITH RECURSIVE o AS (SELECT row_number() OVER () AS no, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
t AS (SELECT {_TABLE} AS t),
h AS (SELECT o.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM o, t),
d AS (SELECT conv_id, turn, no, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
r AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS conv, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, no, copy) AS seen,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, no, copy)),
f AS (SELECT *, CASE WHEN last = '' THEN 1 WHEN seen > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, substr(role, 1, 1) AS letter,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS lead FROM r),
m(p, letter, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(p, q, cost, audit) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (2, 3, 3, 'I'), (3, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')),
e AS (SELECT conv, i, p, p AS q, 4 AS cost, 'D' AS audit FROM f, (VALUES (0), (1), (2), (3)) x(p)
  UNION ALL SELECT conv, i, p, q, CASE fault WHEN 3 THEN 3 ELSE 0 END, 'K' FROM f JOIN m USING (letter) WHERE fault IN (0, 3)
  UNION ALL SELECT conv, i, p, q, CASE fault WHEN 3 THEN 6 ELSE 3 END, 'R' FROM f, m WHERE fault IN (0, 3) AND m.letter <> 's'),
step AS (SELECT conv, i, ins.p, e.q, min(row(ins.cost + e.cost, ins.audit || e.audit)) AS v FROM e JOIN ins ON ins.q = e.p GROUP BY ALL),
walk(conv, i, q, cost, audit) AS (SELECT DISTINCT conv, 0::BIGINT, 0, 0, '' FROM f
  UNION ALL SELECT conv, i, q, v[1], v[2] FROM (SELECT w.conv, s.i, s.q, min(row(w.cost + s.v[1], w.audit || s.v[2])) AS v FROM walk w JOIN step s ON s.conv = w.conv AND s.i = w.i + 1 AND s.p = w.q GROUP BY ALL)),
n AS (SELECT conv, any_value(conv_id) AS conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (i > 1 AND lead || letter NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv),
g AS (SELECT conv, min(row(w.cost + ins.cost, w.audit || ins.audit)) AS v FROM walk w JOIN n USING (conv) JOIN ins ON ins.p = w.q AND ins.q IN (0, 3) WHERE w.i = n.n GROUP BY conv),
a AS (SELECT conv, j, v[2][j] AS edit, CASE WHEN v[2][j] <> 'I' THEN length(replace(v[2][1:j], 'I', '')) END AS i FROM (SELECT conv, v, unnest(range(1, length(v[2]) + 1)) AS j FROM g)),
b AS (SELECT a.conv, j, edit, role, text, row_number() OVER (PARTITION BY a.conv ORDER BY j) AS line, max(CASE WHEN edit = 'K' AND letter = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY a.conv) AS system FROM a LEFT JOIN f ON a.conv = f.conv AND a.i = f.i WHERE edit <> 'D'),
c AS (SELECT conv, sha256(string_agg(CASE WHEN edit = 'K' THEN role ELSE CASE WHEN (line - system) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS hash FROM b GROUP BY conv)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v[1], 0)::BIGINT AS cost, coalesce(v[2], '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN n ON i.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN g USING (conv) LEFT JOIN c USING (conv)"""
