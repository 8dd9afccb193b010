"""Run a query and its check SQL on the same tables and compare rows as multisets."""

from __future__ import annotations

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "as_tuple"):
        return round(float(value), 6) if value != int(value) else int(value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(name, run, sql, spark, con, sf_dir) -> str:
    """Empty text if equal, else what differs."""
    df = run(spark, sf_dir)
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    theirs = _rows(names, found.fetchall())
    if ours == theirs:
        return "" if ours else "no rows on either side"
    more, less = ours - theirs, theirs - ours
    sample = lambda c: [k for k, _ in list(c.items())[:2]]
    return (
        f"rows {sum(ours.values())}/{sum(theirs.values())} [{', '.join(sorted(names))}]\n"
        f"   only ours ({sum(more.values())}): {sample(more)}\n   only SQL ({sum(less.values())}): {sample(less)}"
    )


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import time

    import __spark_entry__ as e
    from prospectry.session import build_session

    sf = sys.argv[1]
    spark = build_session(master="local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con, sql = connect(sf), e.oracle_sql()
    wanted = sys.argv[2:]
    for name, run in e.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                result = compare(name, run, sql[name], spark, con, sf)
            else:
                result = "" if run(spark, sf).count() else "no rows"
        except Exception as error:
            result = f"{type(error).__name__}: {str(error)[:700]}"
        kind = "" if name in sql else " (no SQL)"
        print(f"{'ok  ' if not result else 'FAIL'} {name}{kind} {time.time() - start:.1f}s {result}", flush=True)
