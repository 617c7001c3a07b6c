"""Run a registered query and its oracle SQL and compare them as the driver does."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short account of the first differences."""
    names = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
    rel = con.sql(sql)
    theirs = sorted(rel.columns)
    if names != theirs:
        return f"columns {names} vs {theirs}"
    order = [rel.columns.index(c) for c in names]
    want = sorted(tuple(_plain(r[i]) for i in order) for r in rel.fetchall())
    if got == want:
        return None
    extra = [x for x in got if x not in set(want)][:2]
    missing = [x for x in want if x not in set(got)][:2]
    return f"rows {len(got)} vs {len(want)}\n  spark: {extra}\n  duck:  {missing}\n  {names}"


def types(df, con, sql: str) -> tuple[dict, dict]:
    rel = con.sql(sql)
    return {f.name: f.dataType.simpleString() for f in df.schema}, dict(zip(rel.columns, map(str, rel.types), strict=True))
