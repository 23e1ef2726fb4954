"""Run registered queries against their SQL twins: python tools_check.py [sf] [name-prefix ...]"""

from __future__ import annotations

import sys
import time

import duckdb

import catalog
from glyphmill import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def cell(v):
        if v is None or v != v:
            return "∅"
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        return f"{type(v).__name__}:{v}"
    return [names[i] for i in order], sorted("\x1f".join(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    d = f"/root/testdata/sf{sf}"
    catalog.load_all()
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, d)
            got = canon([tuple(r) for r in df.collect()], df.columns)
        except Exception as e:  # report and go on with the next query
            print(f"FAIL {name}: spark {type(e).__name__} {str(e)[:600]}", flush=True)
            bad += 1
            continue
        sec = time.time() - t0
        if name not in catalog.ORACLES:
            print(f"rows {name}: {len(got[1])} rows {sec:.2f}s {[x[:100] for x in got[1][:1]]}", flush=True)
            continue
        t1 = time.time()
        try:
            cur = con.execute(catalog.ORACLES[name])
            names = [c[0] for c in cur.description]
            want = canon(cur.fetchall(), names)
        except Exception as e:
            print(f"FAIL {name}: duckdb {str(e)[:900]}", flush=True)
            bad += 1
            continue
        if got == want:
            flag = "" if got[1] else "  EMPTY"
            print(f"ok   {name}: {len(got[1])} rows {sec:.2f}s duck {time.time() - t1:.2f}s{flag}", flush=True)
        else:
            bad += 1
            a, b = set(got[1]), set(want[1])
            print(f"DIFF {name}: cols {got[0]} vs {want[0]}; rows {len(got[1])} vs {len(want[1])}", flush=True)
            for r in sorted(a - b)[:3]:
                print("   spark only:", r[:300])
            for r in sorted(b - a)[:3]:
                print("   duck only: ", r[:300])
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
