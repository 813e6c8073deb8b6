"""Comparison with the oracle, and dirty variants of the tables."""

import datetime
import decimal
import math
import os
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

#: Column names that operators use inside; tables may have them, too.
CLASHING = ["k", "id", "row", "n", "_salt", "fp", "tag", "span", "g", "bucket", "line", "s", "x", "up", "ptr", "done", "seg", "root", "src", "h", "lines", "words", "own", "band", "unit", "moment", "since", "until"]


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{folder}/{f}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([plain(v) for v in r]) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def oracle_rows(con, sql, cols):
    con.execute(sql)
    names = [d[0] for d in con.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    return sorted(repr([plain(r[i]) for i in at]) for r in con.fetchall())


def write_variants(folder, out: Path):
    """empty: no rows; dirty: rows of nulls, every row twice, and further columns with names that operators use."""
    for kind in ("empty", "dirty"):
        (out / kind).mkdir()
    for f in os.listdir(folder):
        t = pq.read_table(f"{folder}/{f}")
        pq.write_table(t.slice(0, 0), out / "empty" / f)
        if f.split(".")[0] in ("subjects", "mix_targets", "company_metrics"):
            both = pa.concat_tables([t, t])
        else:
            nulls = pa.table({c.name: pa.nulls(3, c.type) for c in t.schema}, schema=pa.schema([c.with_nullable(True) for c in t.schema]))
            both = pa.concat_tables([t.cast(nulls.schema), nulls, t.cast(nulls.schema)])
        for c in CLASHING:
            if c not in both.column_names:
                both = both.append_column(c, pa.array(["clash"] * both.num_rows))
        pq.write_table(both, out / "dirty" / f)
    return {k: str(out / k) for k in ("empty", "dirty")}
