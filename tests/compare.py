"""Compare a registered query with its SQL twin: columns by name, rows in any order, values exactly."""

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if x is None:
        return None
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    if isinstance(x, bool):
        return f"bool:{x}"
    return x


def _key(row):
    return tuple("" if c is None else f"{type(c).__name__}:{c}" for c in row)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_cell(r[c]) for c in cols) for r in df.collect()), key=_key)


def rows_of_sql(con, text):
    res = con.execute(text)
    names = [d[0] for d in res.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(_cell(r[i]) for i in at) for r in res.fetchall()), key=_key)


def difference(df, con, text):
    """None if equal, else a short description."""
    cols_a, a = rows_of_spark(df)
    cols_b, b = rows_of_sql(con, text)
    if cols_a != cols_b:
        return f"columns {cols_a} != {cols_b}", len(a)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; spark {a[:2]} sql {b[:2]}", len(a)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} rows differ, first {cols_a} {bad[0]}", len(a)
    return None, len(a)


def main(names, sf_dir):
    import __spark_entry__ as E
    from accesslens.session import build_session
    # HOT_ROWS=100 sends entities above 100 events through the segmented plans.
    extra = {"accesslens.hotRows": os.environ["HOT_ROWS"]} if "HOT_ROWS" in os.environ else {}
    spark = build_session(master="local[8]", **extra)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, bad = E.oracle_sql(), 0
    for name, fn in E.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            if name in sqls:
                problem, n = difference(fn(spark, sf_dir), con, sqls[name])
            else:
                problem, n = None, len(fn(spark, sf_dir).collect())
        except Exception as e:  # report and go on with the next query
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        bad += problem is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{'BAD ' if problem else 'ok  '} {kind} {name} rows={n} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[2:], sys.argv[1])
