"""Compare registered queries with their SQL twins: python tests/check.py <sf_dir> [name ...]."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if os.path.exists(f"{sf}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows_of(pdf):
    import pandas as pd

    pdf = pdf[sorted(pdf.columns)]
    rows = [tuple(None if v is None or v is pd.NA or v != v else v for v in r) for r in pdf.itertuples(index=False, name=None)]
    return list(pdf.columns), sorted(rows, key=repr)


def compare(spark, con, sf: str, function, oracle: str | None) -> str:
    got = function(spark, sf).toPandas()
    if oracle is None:
        return f"rows only ({len(got)})"
    want = con.execute(oracle).fetchdf()
    left_names, left = rows_of(got)
    right_names, right = rows_of(want)
    if left_names != right_names:
        return f"FAIL columns {left_names} != {right_names}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in left_names if got[c].dtype.kind != want[c].dtype.kind and got[c].notna().any() and want[c].notna().all()}
    if kinds:
        return f"FAIL dtypes {kinds}"
    if len(left) != len(right):
        return f"FAIL rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"FAIL value {left_names}\n   {str(a)[:900]}\n   {str(b)[:900]}"
    return f"ok ({len(left)})" if left else "EMPTY"


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from citesieve.session import get_spark

    spark = get_spark("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                              "spark.driver.memory": "8g", "spark.sql.warehouse.dir": "/tmp/spark-warehouse"})
    spark.sparkContext.setLogLevel("OFF")
    con, failed = connect(sf), 0
    oracles = entry.oracle_sql()
    for name, function in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            message = compare(spark, con, sf, function, oracles.get(name))
        except Exception as error:
            message = f"FAIL {type(error).__name__}: {str(error)[:500]}"
        failed += not message.startswith(("ok", "rows"))
        print(f"{time.time() - start:6.1f}s {name}: {message}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
