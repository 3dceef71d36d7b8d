"""Run queries and their DuckDB statements on the same tables and compare all values."""

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
              "DATE": "date", "TIMESTAMP": "timestamp"}


def compare(spark, con, name, fn, sql, sf_dir):
    """Empty string when equal, else what differs."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    types = {d[0]: DUCK_TYPES.get(str(d[1]), str(d[1])) for d in cur.description}
    spark_types = {k: v.replace("timestamp_ntz", "timestamp") for k, v in df.dtypes}
    bad = [(c, spark_types[c], types[c]) for c in cols if spark_types[c] != types[c]]
    if bad:
        return f"types {bad}"
    a, b = sorted_rows(df.columns, got), sorted_rows(cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"first difference ({sorted(cols)}):\n   spark {str(x)[:600]}\n   duck  {str(y)[:600]}"
    if not a:
        return "EMPTY"
    return ""


def main():
    from tests.session import make_session
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    only = sys.argv[1:]
    spark = make_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t0 = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, fn, oracles[name], sf_dir)
            else:
                problem = f"no oracle, {fn(spark, sf_dir).count()} rows"
        except Exception as e:  # report and go on
            problem = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        ok = not problem or problem.startswith("no oracle")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.2f}s {problem}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
