"""Run registered queries next to their SQL twins and compare all rows."""

from __future__ import annotations

import math
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(d: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4)
    if hasattr(x, "as_tuple"):
        return round(float(x), 4)
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def difference(spark, con, d: str, name: str, f, sql: str) -> str | None:
    df = f(spark, d)
    got = df.collect()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got), key=repr)
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    if a != b:
        odd = [x for x in a if x not in b][:2] if len(a) < 20000 else []
        missing = [x for x in b if x not in a][:2] if len(a) < 20000 else []
        return f"{name}: {len(a)} and {len(b)} rows; only ours {odd}; only SQL {missing}"
    return None if a else f"{name}: no rows"


if __name__ == "__main__":
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    d = sys.argv[1]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, q, sql = connect(d), e.queries(), e.oracle_sql()
    for name in q:
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        t = time.time()
        try:
            bad = difference(spark, con, d, name, q[name], sql[name]) if name in sql else (None if q[name](spark, d).count() else f"{name}: no rows")
        except Exception as x:
            bad = f"{name}: {type(x).__name__} {str(x)[:600]}"
        print("ok " + name if bad is None else "BAD " + bad, round(time.time() - t, 1), flush=True)
