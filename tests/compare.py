"""Run registered queries next to their SQL on DuckDB and compare whole results.

python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: int = 8, partitions: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, int):
        return repr(value)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def difference(spark, con, name: str, query, sql: str, sf: str) -> str | None:
    """None when both sides agree, else what differs first."""
    df = query(spark, sf)
    got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        extra = sorted(set(got) - set(want))[:3]
        missing = sorted(set(want) - set(got))[:3]
        return f"rows {len(got)} != {len(want)}; only spark {extra}; only sql {missing}"
    for g, w in zip(got, want):
        if g != w:
            extra = sorted(set(got) - set(want))[:3]
            missing = sorted(set(want) - set(got))[:3]
            return f"{sum(a != b for a, b in zip(got, want))} rows differ; only spark {extra}; only sql {missing}"
    return None


def main() -> None:
    import __spark_entry__ as entry

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf)
    oracles, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = difference(spark, con, name, query, oracles[name], sf)
                state = "ok" if problem is None else f"DIFF {problem}"
            else:
                state = f"rows only: {len(query(spark, sf).collect())}"
        except Exception as exc:
            state = "ERROR " + str(exc)[:1500]
        failed += not state.startswith(("ok", "rows"))
        print(f"{name:24s} {time.time() - start:6.1f}s {state[:2500]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
