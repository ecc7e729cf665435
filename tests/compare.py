"""Run a query and its SQL over the same tables and compare the rows as sorted text."""

import datetime
import decimal
import glob
import os

DATA = os.environ.get("PHRASEGRID_TESTDATA", "/root/testdata/sf0.001")


def canon(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "%.9g" % float(v)
    if isinstance(v, dict):
        return str(sorted((canon(a), canon(b)) for a, b in v.items()))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def connect():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def check_plan(df):
    """No join of all with all, anywhere."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, plan


def same(spark, con, query, sql):
    df = query(spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(canon, r)) for r in df.select(*cols).collect())
    check_plan(df)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(canon(r[i]) for i in at) for r in found.fetchall())
    assert got == want
