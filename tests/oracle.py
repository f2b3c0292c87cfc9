"""Compare queries with their SQL: python -m tests.oracle [sf_dir] [name...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
import traceback

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) else round(v, 6))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, query, sql):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    got = con.sql(sql)
    theirs = rows_of([d[0] for d in got.description], got.fetchall())
    if ours == theirs:
        return None
    a, b = set(map(repr, ours[1])), set(map(repr, theirs[1]))
    return f"{name}: columns {ours[0]} / {theirs[0]}; rows {len(ours[1])} / {len(theirs[1])}; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def main(args):
    from tests.session import session

    import __spark_entry__ as entry

    spark, sf_dir = session(), args[0] if args else "/root/testdata/sf0.01"
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if args[1:] and name not in args[1:] or not args[1:] and name not in sqls:
            continue
        began = time.time()
        try:
            said = compare(spark, con, sf_dir, name, query, sqls[name]) if name in sqls else f"{query(spark, sf_dir).count()} rows, no SQL"
        except Exception:
            said = f"{name}: " + traceback.format_exc().strip()[-700:]
        bad += bool(said) and name in sqls
        print(f"{name} {time.time() - began:.1f} s {said or 'equal'}", flush=True)
    print(bad, "differ")


if __name__ == "__main__":
    main(sys.argv[1:])
