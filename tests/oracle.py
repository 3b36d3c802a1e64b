"""Comparing a DataFrame with DuckDB SQL over the same Parquet files."""

from pathlib import Path

import duckdb


def same_rows(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(r[names.index(c)] for c in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(r) for r in df.select(*order).collect()), key=repr)
    assert len(got) == len(want)
    assert got == want
