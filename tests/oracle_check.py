"""Compare registered queries with their SQL on one scale factor: oracle_check.py [sf] [name ...]."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from quirefold.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in records:
        vals = []
        for i in order:
            v = r[i]
            if isinstance(v, float):
                v = 0.0 if v == 0 else v
                v = int(v) if v == int(v) else v
            elif isinstance(v, bool):
                v = str(v)
            vals.append(v)
        out.append(tuple(vals))
    return sorted(out, key=repr), [names[i] for i in order]


def check(spark, name, sf_dir, con):
    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got, got_names = rows([tuple(r) for r in df.collect()], df.columns)
    took = time.time() - t0
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "ROWS", f"{len(got)} rows, {took:.1f}s"
    t0 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want, want_names = rows(cur.fetchall(), names)
    note = f"{len(got)} rows, spark {took:.1f}s, sql {time.time() - t0:.1f}s"
    if got_names != want_names:
        return "FAIL", f"{note}: columns {got_names} != {want_names}"
    if got == want:
        return ("OK" if got else "EMPTY"), note
    a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
    return "FAIL", f"{note}, sql rows {len(want)}\n   spark {str(a)[:700]}\n   sql   {str(b)[:700]}"


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    picks = sys.argv[2:]
    bad = 0
    for name in entry.queries():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        try:
            status, note = check(spark, name, sf_dir, con)
        except Exception as e:  # noqa: BLE001
            status, note = "ERROR", str(e)[:1500]
        bad += status in ("FAIL", "ERROR")
        print(f"{status:6}{name}: {note}", flush=True)
    print("bad:", bad)
