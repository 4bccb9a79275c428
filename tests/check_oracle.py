"""Compare every registered query with its SQL at one scale.

    python tests/check_oracle.py [sf_dir] [name ...]

Rows are compared as a multiset, columns by name.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 9)
    return value


def _bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, str | None]:
    """Number of rows, and what differs (None if nothing does)."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = _bag(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return 0, f"columns {sorted(df.columns)} instead of {sorted(names)}"
    actual = _bag(df.columns, df.collect())
    size = sum(actual.values())
    if actual == expected:
        return size, None
    more, less = list((actual - expected).elements()), list((expected - actual).elements())
    return size, f"{len(more)} rows too many, {len(less)} missing: {more[:1]} against {less[:1]}"


def main() -> int:
    import __spark_entry__ as entry
    from stagetrace.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]", shuffle_partitions=8, extra={"spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    wrong = 0
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        started = time.time()
        if name in sql:
            rows, problem = differences(query(spark, sf_dir), con, sql[name])
        else:
            rows, problem = query(spark, sf_dir).count(), None
        wrong += problem is not None
        mark = "ok  " if problem is None else "DIFF"
        print(f"{mark} {name:32} {rows:8} rows {time.time() - started:6.2f}s {problem or ''}"[:600])
    print("all equal" if not wrong else f"{wrong} queries differ")
    return wrong


if __name__ == "__main__":
    sys.exit(main())
