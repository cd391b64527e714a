"""Compare registered queries with their SQL, row by row, types included."""

from __future__ import annotations

import datetime as dt
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def spark_rows(df) -> list[tuple]:
    columns = sorted(df.columns)
    return [tuple(_plain(r[c]) for c in columns) for r in df.collect()]


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple], list[str]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = [str(d[1]) for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()]
    return [names[i] for i in order], rows, [types[i] for i in order]


def _key(row):
    return tuple((v is None, type(v).__name__, str(v)) for v in row)


def differences(df, con, sql: str) -> str | None:
    """None if equal as bags of rows, else what differs."""
    names, expected, _ = sql_rows(con, sql)
    if names != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {names}"
    got = spark_rows(df)
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}"
    for a, b in zip(sorted(got, key=_key), sorted(expected, key=_key)):
        if _key(a) != _key(b):
            return f"{a} != {b}"
    return None


def main(sf_dir: str, *only: str) -> int:
    import __spark_entry__ as entry
    from tidegraph.session import build_session

    spark = build_session(
        "check", "local[8]", 8, {"spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = differences(df, con, oracles[name])
            else:
                problem = f"no SQL, {df.count()} rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        if problem:
            bad += 1
        print(f"{'BAD' if problem else 'ok '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
