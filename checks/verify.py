"""Run registered queries against their SQL: ``python -m checks.verify [sf_dir] [name-part ...]``."""

from __future__ import annotations

import math
import sys
import tempfile
import time
from collections import Counter
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"f:{value + 0.0:.10g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, Decimal):
        return f"decimal:{value}"
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, name, queries, sql, sf):
    started = time.time()
    frame = queries[name](spark, sf)
    left = frame.collect()
    took = time.time() - started
    if name not in sql:
        return "no-sql", len(left), took, ""
    cursor = con.execute(sql[name])
    columns = [d[0] for d in cursor.description]
    right = cursor.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return "columns", len(left), took, f"{sorted(frame.columns)} != {sorted(columns)}"
    a, b = rows_of(frame.columns, left), rows_of(columns, right)
    if a == b:
        return "ok", len(left), took, ""
    return "DIFF", len(left), took, f"rows {len(left)}/{len(right)} only-spark {list((a - b))[:3]} only-sql {list((b - a))[:3]}"


def main(argv):
    import duckdb
    from checks import QUERIES, SQL
    from plumbline import build_session
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="plumbline-verify-"), "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name in QUERIES:
        if len(argv) > 1 and not any(part in name for part in argv[1:]):
            continue
        try:
            verdict, n, took, note = compare(spark, con, name, QUERIES, SQL, sf)
        except Exception as problem:
            verdict, n, took, note = "ERROR", 0, 0.0, str(problem)[:700].replace("\n", " ")
        bad += verdict not in ("ok", "no-sql")
        print(f"{verdict:8} {name:36} rows={n:<7} {took:6.2f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
