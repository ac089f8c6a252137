"""Holds a query's rows against SQL run by DuckDB on the same tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return _sorted(names, got.fetchall())


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return tuple(map(_plain, v)) if isinstance(v, list | tuple) else v


def _sorted(names: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def same_rows(df, sql: str, sf_dir: str) -> None:
    names, rows = _sorted(df.columns, [tuple(r) for r in df.collect()])
    wanted, expected = oracle_rows(sql, sf_dir)
    assert names == wanted
    missing, extra = expected - rows, rows - expected
    assert not missing and not extra, f"missing {list(missing.items())[:3]}, extra {list(extra.items())[:3]} of {sum(expected.values())}"
