"""Run registered queries beside their SQL in DuckDB and report differences.

Usage: python tests/oracle_check.py SF [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, bool):
        return int(value)
    return value


def _rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = _rows(cols, rel.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    if got == want:
        return "" if got else "both sides are empty"
    have, need = set(got), set(want)
    only, lack = list(have - need)[:3], list(need - have)[:3]
    return f"{len(got)} vs {len(want)} rows; columns {sorted(cols)}; spark only {only}; sql only {lack}"


def main() -> int:
    from dyadscope.plans.catalog import ORACLES, QUERIES
    from dyadscope.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                verdict = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
            else:
                n = len(QUERIES[name](spark, sf_dir).collect())
                verdict = "" if n else "no rows"
        except Exception as exc:  # report and go on
            verdict = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(verdict)
        print(f"{'FAIL' if verdict else 'ok':4} {name:32} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
