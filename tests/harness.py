"""Compare a registered query with its SQL on the same files."""

import math
import time

import duckdb

TIMES: list[float] = []
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return (v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v).isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(spark, con, sf_dir, query, sql):
    """Empty text when equal, else a description of the first difference."""
    start = time.time()
    df = query(spark, sf_dir)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    TIMES.append(time.time() - start)
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        extra = [r for r in got if r not in want][:3] if len(got) < 5000 else got[:2]
        lost = [r for r in want if r not in got][:3] if len(got) < 5000 else want[:2]
        return f"{len(got)} rows, expected {len(want)}; extra {extra}; lost {lost}"
    for g, w in zip(got, want):
        if g != w:
            return f"{names}: got {g}, expected {w}"
    return ""
