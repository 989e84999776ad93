"""Local stand-in for the driver's correctness gate: run a Spark query and its
DuckDB oracle on the same parquet tables and compare row count, column names
and an order-insensitive hash of the (rounded) values."""

from __future__ import annotations

import hashlib
import math
import sys

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return str(v)


def frame_hash(df: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in df.to_dict("records"))
    return len(rows), cols, hashlib.sha256("\n".join(rows).encode()).hexdigest()


def compare(spark, name: str, query, sql: str, sf_dir: str, con=None) -> dict:
    con = con or duck_connection(sf_dir)
    s_df = query(spark, sf_dir).toPandas()
    d_df = con.sql(sql).df()
    s = frame_hash(s_df)
    d = frame_hash(d_df)
    out = {"name": name, "rows": (s[0], d[0]), "cols_match": s[1] == d[1], "hash_match": s[2] == d[2]}
    if not (out["cols_match"] and out["hash_match"]):
        out["spark_cols"], out["duck_cols"] = s[1], d[1]
        out["spark_head"] = s_df.sort_values(s[1]).head(3).to_dict("records")
        out["duck_head"] = d_df.sort_values(d[1]).head(3).to_dict("records")
    return out


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from segstate.session import get_spark

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or sorted(E.queries())
    spark = get_spark(8)
    con = duck_connection(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for n in names:
        if n not in sqls:
            rows = qs[n](spark, sf_dir).count()
            print(f"{n:32s} rows-only {rows}")
            continue
        try:
            r = compare(spark, n, qs[n], sqls[n], sf_dir, con)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{n:32s} ERROR {type(e).__name__}: {str(e)[:400]}")
            continue
        ok = r["cols_match"] and r["hash_match"] and r["rows"][0] == r["rows"][1]
        bad += not ok
        print(f"{n:32s} {'OK ' if ok else 'BAD'} rows={r['rows']}" + ("" if ok else f" {r}"))
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
