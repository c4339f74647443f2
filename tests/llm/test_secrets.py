"""The secret scan against a brute-force version."""

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from barloom.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", re.ASCII)
PLAIN = (("access", re.compile("AKIA[A-Z0-9]+"), 18), ("hex", re.compile("[0-9a-f]+"), 16), ("token", re.compile("[A-Za-z0-9+/_=-]+"), 20))
ORDER = ["assign", "access", "hex", "token"]


def live(v):
    return bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v) and len(set(v)) >= secrets.DISTINCT and not re.search(secrets.PLACEHOLDER, v))


def brute(rows):
    """rows: id, text, owner. Results in the order of the rows."""
    found = []
    for _, text, _ in rows:
        spans = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 12]
        for kind, pattern, least in PLAIN[:2]:
            spans += [(kind, m.start(), m.end(), m[0]) for m in pattern.finditer(text or "") if len(m[0]) >= least]
        base = list(spans)
        for m in PLAIN[2][1].finditer(text or ""):
            if len(m[0]) >= 20 and live(m[0]) and all(b[2] <= m.start() or b[1] >= m.end() for b in base):
                spans.append(("token", m.start(), m.end(), m[0]))
        found.append(spans)
    owners = defaultdict(set)
    for (_, _, owner), spans in zip(rows, found, strict=True):
        for s in spans:
            owners[s[3]].add(owner)
    out = []
    for (i, _, _), spans in zip(rows, found, strict=True):
        alive = [live(s[3]) and len(owners[s[3]]) < secrets.WIDE for s in spans]
        both = sorted([(s[1], ORDER.index(s[0]), s, a) for s, a in zip(spans, alive, strict=True) if s[0] != "token" or a], key=lambda x: x[:2])
        name = lambda s: f"{s[0]}:{s[1]}:{s[2]}"
        base = ",".join(name(s) for _, _, s, _ in both if s[0] != "token")
        n = lambda k: sum(s[0] == k for _, _, s, _ in both)
        copied = sum(len(owners[s[3]]) >= secrets.WIDE for _, _, s, _ in both)
        out.append((i, n("assign"), n("access"), n("hex"), hashlib.sha256(base.encode()).hexdigest(), ",".join(name(s) for _, _, s, _ in both), n("token"), copied, sum(a for *_, a in both)))
    return out


def scanned(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, kind string, row int")
    return [tuple(r) for r in secrets.scan_secrets(df).collect()]


def test_secrets_against_brute_force(spark):
    rng = random.Random(5)
    hexes = ["".join(rng.choices("0123456789abcdef", k=rng.choice([15, 16, 40]))) for _ in range(12)]
    keys = ["AKIA" + "".join(rng.choices("ABCDEFGHIJ0123456789", k=rng.choice([13, 14, 16]))) for _ in range(6)]
    tokens = ["".join(rng.choices("abcdefXYZ0123456789_-", k=rng.choice([19, 20, 33]))) for _ in range(12)]
    values = hexes + keys + tokens + ["correct.horse=battery", "short", "example1234567890abcdeXYZ", "x" * 30]
    names = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "apikey'", 'token"', "word"]
    marks = ["=", ": ", " = ", ' : "', "='", " ", ":secret:", "\n"]
    rows = []
    for k in range(400):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts += [rng.choice(["plain", "é", "𝒳𝒴", "-", ""]), rng.choice([" ", ".", ""]), rng.choice(names) + rng.choice(marks) if rng.random() < 0.6 else "", rng.choice(values), rng.choice([" ", "", '"'])]
        rows.append((rng.choice([k, 7]), "".join(parts), rng.choice(["a", "b", "b", "c", None])))
    rows += [(500, None, "a"), (501, "", None), (None, f"token={tokens[1]}", "a"), (502, "token=" * 5000, "a"), (503, "password: hunter2hunter2 " * 3000, "a"), (504, "token=secret:abcdefghijklmnop", "z")]
    assert sorted(map(str, scanned(spark, rows))) == sorted(map(str, brute(rows)))


def test_widely_copied_values_are_no_live_secrets(spark):
    shared, own = "Zq8-" + "mN4_" * 5 + "k7T", "Rt5_" + "bV9-" * 5 + "w2Y"
    got = {r[0]: r for r in scanned(spark, [(k, f"see {shared} here", f"s{k % 4}") for k in range(40)] + [(90 + k, f"see {own} here", "s1") for k in range(5)] + [(99, f"token={shared}", "s1")])}
    assert all(got[k][5] == "" for k in range(40))  # a token of four owners is an example
    assert all(got[90 + k][5] == f"token:4:{4 + len(own)}" and got[90 + k][8] == 1 for k in range(5))  # copies within one owner stay live
    assert got[99][1] == 1 and got[99][7] == 1 and got[99][8] == 0  # a base span stays, marked as copied


def test_secrets_empty_table_and_plan(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert secrets.scan_secrets(df).count() == 0
    plan = secrets.scan_secrets(spark.createDataFrame([(1, "token=abcdefghijkl1", "a")], df.schema))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert secrets.ownership(secrets.candidates(df, "doc_id", "text", "source", "doc_id")).filter(F.col("owners") > 0).count() == 0
