"""Comparing a query with its SQL in DuckDB on the same Parquet files."""

import math
from pathlib import Path

import duckdb


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return x


def rows(table):
    names = sorted(table.column_names)
    return sorted((tuple(value(x) for x in r) for r in zip(*[table[n].to_pylist() for n in names])), key=repr)


def kind(t) -> str:
    return str(t).replace("large_", "").replace("[us]", "").replace("[us, tz=UTC]", "")


def compare(df, sql, folder):
    got = df.toArrow()
    want = duck(folder).sql(sql).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert sorted(got.column_names) == sorted(want.column_names)
    kinds = {n: (kind(got.schema.field(n).type), kind(want.schema.field(n).type)) for n in got.column_names}
    assert all(a == b or "null" in b for a, b in kinds.values()), {n: k for n, k in kinds.items() if k[0] != k[1]}
    assert rows(got) == rows(want)
