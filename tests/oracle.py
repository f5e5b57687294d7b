"""Run registered queries beside their SQL and compare the results."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession

from lexalia.plans import registry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _normal(table: pa.Table) -> pd.DataFrame:
    df = table.select(sorted(table.column_names)).to_pandas()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: repr(list(v)) if hasattr(v, "__len__")
                              and not isinstance(v, str) else v)
    return df.sort_values(list(df.columns), kind="stable", na_position="first",
                          key=lambda s: s.astype(str)).reset_index(drop=True)


def _type(t: pa.DataType) -> str:
    return str(t).replace("large_", "").replace(" not null", "")


def differences(left: pa.Table, right: pa.Table) -> list[str]:
    """What differs between a Spark and a DuckDB result; empty when they agree."""
    found = []
    a = {f.name: _type(f.type) for f in left.schema}
    b = {f.name: _type(f.type) for f in right.schema}
    if a != b:
        found.append(f"schema {sorted(set(a.items()) ^ set(b.items()))}")
    if left.num_rows != right.num_rows:
        found.append(f"rows {left.num_rows} / {right.num_rows}")
    if found:
        return found
    x, y = _normal(left), _normal(right)
    for c in x.columns:
        same = (x[c] == y[c]) | (x[c].isna() & y[c].isna())
        if not same.all():
            i = int((~same).idxmax())
            found.append(f"{c}: {int((~same).sum())} differ, row {i}: "
                         f"{x[c][i]!r} / {y[c][i]!r}; row {x.loc[i].to_dict()}")
    return found


def check(spark, con, folder: str, name: str) -> tuple[list[str], int, float, float]:
    start = time.time()
    left = registry.QUERIES[name](spark, folder).toArrow()
    mid = time.time()
    if name not in registry.SQL:
        return [], left.num_rows, mid - start, 0.0
    right = con.execute(registry.SQL[name]).to_arrow_table()
    return differences(left, right), left.num_rows, mid - start, time.time() - mid


def main(argv: list[str]) -> int:
    from lexalia import build_session

    folder = argv[0]
    registry.load_all()
    names = argv[1:] or list(registry.QUERIES)
    if names == ["sql"]:
        names = list(registry.SQL)
    if os.environ.get("ORACLE_PLAIN"):  # a session without our settings
        spark = SparkSession.builder.master("local[8]").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = build_session(cores="8")
    con = duck(folder)
    bad = 0
    for name in names:
        try:
            found, rows, t1, t2 = check(spark, con, folder, name)
        except Exception as error:  # keep going: this is a report
            found, rows, t1, t2 = [f"{type(error).__name__}: {str(error)[:1500]}"], 0, 0, 0
        bad += bool(found)
        kind = "sql" if name in registry.SQL else "rows"
        print(f"{'BAD' if found else 'ok '} {name:28s} {kind:4s} rows={rows} "
              f"spark={t1:.1f}s duckdb={t2:.1f}s", *[f"\n     {f}" for f in found], flush=True)
    print("failed:", bad, "of", len(names))
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
