"""Run catalogue queries against their DuckDB SQL: python tests/compare.py SF_DIR [name ...]."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def multiset(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> str | None:
    """None when columns, types and values agree, else what differs."""
    got = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(spark_df.columns) != sorted(rel.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(rel.columns)}"
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    types = {n: kinds.get(t, t) for n, t in spark_df.dtypes}
    other = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    notes = [f"type of {n}: {types[n]} vs {other[n]}" for n in types if types[n] != other[n]]
    a, b = multiset(spark_df.columns, got), multiset(rel.columns, want)
    if a != b:
        notes.append(f"{len(got)} vs {len(want)} rows; only spark {list((a - b).items())[:3]}; only sql {list((b - a).items())[:3]}")
    elif not got:
        notes.append("no rows")
    return "; ".join(notes) or None


def main() -> None:
    import __spark_entry__ as entry
    from credence.session import get_spark
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con, sqls = connect(sf_dir), entry.oracle_sql()
    for name, f in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = f(spark, sf_dir)
            if name in sqls:
                result = differences(df, con, sqls[name]) or "ok"
            else:
                result = f"rows only: {len(df.collect())}"
        except Exception as e:  # report and go on with the next query
            result = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(f"{name:28s} {time.time() - start:6.1f}s {result[:900]}", flush=True)


if __name__ == "__main__":
    main()
