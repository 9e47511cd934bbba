"""Run named queries next to their SQL twins and print what differs.

Usage: python tests/oracle_check.py [--sf DIR] [name-prefix ...]
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def key(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (1, f"{v:+.9e}")
    return (2, str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(r[k] for k in order) for r in rows), key=lambda r: [key(v) for v in r])


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    exp_names, exp = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != exp_names:
        return f"columns {got_names} vs {exp_names}", len(got)
    if len(got) != len(exp):
        return f"rows {len(got)} vs {len(exp)}", len(got)
    bad = [(g, e) for g, e in zip(got, exp) if [key(v) for v in g] != [key(v) for v in e]]
    if bad:
        g, e = bad[0]
        cells = [(n, a, b) for n, a, b in zip(got_names, g, e) if key(a) != key(b)]
        return f"{len(bad)} of {len(got)} rows differ; first: {cells[:6]} in {g}", len(got)
    kinds = [type(v) for v in got[0]] if got else []
    twin = [type(v) for v in exp[0]] if exp else []
    if kinds != twin:
        return f"types {kinds} vs {twin}", len(got)
    return None, len(got)


def session(cpus="8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        k = args.index("--sf")
        sf = args[k + 1]
        del args[k : k + 2]
    from __spark_entry__ import oracle_sql, queries

    spark, con = session(), connect(sf)
    spark.range(10).count()
    q, o = queries(), oracle_sql()
    failed = []
    for name, fn in q.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            if name in o:
                why, n = compare(spark, con, sf, fn, o[name])
            else:
                why, n = None, fn(spark, sf).count()
        except Exception as e:
            why, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        tag = "OK  " if why is None else "FAIL"
        if why:
            failed.append(name)
        print(f"{tag} {name} rows={n} {'sql' if name in o else 'rows-only'} {time.time() - t:.1f}s {why or ''}", flush=True)
    print("failed:", failed)
