"""Compare a Spark result with the same SQL run by DuckDB: columns by name, rows in any order. python tests/parity.py SF_DIR [NAME...]"""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def _plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    return round(x, 6) + 0.0 if isinstance(x, float) else x


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in data), key=repr)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both have the same rows."""
    rel = con.sql(sql)
    ours, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if ours == theirs:
        return ""
    a, b = set(ours) - set(theirs), set(theirs) - set(ours)
    return f"{len(ours)} and {len(theirs)} rows; only ours {len(a)}: {sorted(a, key=repr)[:2]}; only SQL {len(b)}: {sorted(b, key=repr)[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tidemark.session import local_session

    spark, con = local_session(8), connect(sys.argv[1])
    sql = entry.oracle_sql()
    for name, f in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        if not sys.argv[2:] and (name.startswith("op") or name == "pipeline"):
            continue
        began = time.time()
        try:
            said = compare(f(spark, sys.argv[1]), con, sql[name]) if name in sql else f"(no SQL) {f(spark, sys.argv[1]).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
