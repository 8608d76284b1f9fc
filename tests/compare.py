"""Runs a query beside its SQL in DuckDB over the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def views(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def assert_same(frame, sql: str, sf_dir: str = SF) -> int:
    """The rows of both, in any order; their number."""
    got = rows_of(frame.columns, frame.collect())
    found = views(sf_dir).sql(sql)
    want = rows_of(found.columns, found.fetchall())
    assert sorted(frame.columns) == sorted(found.columns)
    assert len(got) == len(want), (len(got), len(want), [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3])
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not wrong, wrong[:3]
    return len(got)
