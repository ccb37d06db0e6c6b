"""Results of a query and of its SQL on the same tables, compared as the driver does."""

from __future__ import annotations

import decimal
import math
from pathlib import Path


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows_of(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def same(spark, con, folder, query, sql) -> tuple[bool, str]:
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    answer = con.sql(sql)
    want = rows_of(answer.columns, answer.fetchall())
    if sorted(df.columns) != sorted(answer.columns):
        return False, f"columns {df.columns} and {answer.columns}"
    return got == want, f"{len(got)} and {len(want)} rows"
