"""Run registered queries at a small scale next to their SQL twins and compare the values.

usage: python tools/check.py [name-prefix ...] [--sf 0.01] [--plan]
"""

import os
import sys
import time
import warnings

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
os.environ.setdefault("PYTHONWARNINGS", "ignore")
warnings.filterwarnings("ignore")

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spark_session(cpus: int = 8) -> SparkSession:
    s = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def norm(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if v != v else repr(v)
    if hasattr(v, "item"):
        return norm(v.item())
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if v.isoformat().endswith("T00:00:00") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(norm(r[i])) for i in order) for r in data)


def main():
    from barloom.plans import all_queries
    args = sys.argv[1:]
    sf = args[args.index("--sf") + 1] if "--sf" in args else "0.01"
    names = [a for a in args if not a.startswith("--") and a != sf]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '/root/testdata/sf{sf}/{t}.parquet'")
    spark = spark_session()
    bad = []
    for name, q in all_queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            t0 = time.time()
            df = q.run(spark, f"/root/testdata/sf{sf}")
            if "--plan" in args:
                df.explain("formatted")
            got = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if q.sql is None:
                print(f"ROWS {name} {len(got)} rows spark {t1 - t0:.1f}s", flush=True)
                continue
            cur = con.execute(q.oracle())
            cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            t2 = time.time()
            a, b = rows(df.columns, got), rows(cols, want)
            same = a == b and sorted(df.columns) == sorted(cols)
            print(f"{'ok  ' if same else 'DIFF'} {name} {len(a)}/{len(b)} rows spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s"
                  + ("" if a else "  EMPTY"), flush=True)
            if not same:
                bad.append(name)
                if sorted(df.columns) != sorted(cols):
                    print("   columns", sorted(df.columns), sorted(cols))
                sa, sb = set(a) - set(b), set(b) - set(a)
                print("   cols ", sorted(df.columns), len(sa), len(sb))
                for x, y in list(zip(sorted(sa), sorted(sb)))[:3] or []:
                    print("   spark", x, "\n   sql  ", y)
                for x in sorted(sa)[:2] if not sb else []:
                    print("   only spark", x)
                for x in sorted(sb)[:2] if not sa else []:
                    print("   only sql", x)
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL {name}: {str(e)[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
