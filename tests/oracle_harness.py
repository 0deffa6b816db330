"""Run a registered Spark query and its DuckDB oracle on the same parquet tables and compare
row count, column names and an order-insensitive hash of the values (like the driver does)."""

from __future__ import annotations

import hashlib
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "\0null"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9))
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def rows_digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x01".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def compare(spark_df, con, sql):
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    s_hash, s_lines = rows_digest(s_cols, s_rows)
    d_hash, d_lines = rows_digest(d_cols, d_rows)
    return {
        "rows": (len(s_rows), len(d_rows)),
        "cols_match": sorted(s_cols) == sorted(d_cols),
        "cols": (sorted(s_cols), sorted(d_cols)),
        "hash_match": s_hash == d_hash,
        "first_diff": next(((a, b) for a, b in zip(s_lines, d_lines) if a != b), None),
    }


def main(argv: list[str]) -> int:
    """``python tests/oracle_harness.py SF_DIR [QUERY ...]``: run registered queries against their
    oracles and print one line per query; exit status 1 if any differs."""
    import os
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry_mod
    from chatsift.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracles = entry_mod.queries(), entry_mod.oracle_sql()
    names = argv[1:] or sorted(queries)
    spark = local_session(8)
    con = duck(sf_dir)
    failed = 0
    for name in names:
        res = compare(queries[name](spark, sf_dir), con, oracles[name])
        ok = res["cols_match"] and res["hash_match"] and res["rows"][0] == res["rows"][1]
        failed += not ok
        print(f"{'OK  ' if ok else 'DIFF'} {name} rows={res['rows']}", flush=True)
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    import sys

    raise SystemExit(main(sys.argv[1:]))
