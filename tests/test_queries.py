"""Every core query with SQL against its oracle, every other one against stored rows."""

import hashlib
import json
import sys
from importlib import import_module
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from helpers import oracle_rows, rows

import __spark_entry__ as entry

CORE = [m for m in entry.MODULES if ".llm." not in m]
QUERIES = {k: f for m in CORE for k, f in import_module(m).QUERIES.items()}
ORACLES = {k: q for m in CORE for k, q in import_module(m).ORACLES.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, data, name):
    cols, got = rows(QUERIES[name](spark, data))
    assert got == oracle_rows(duck, ORACLES[name], cols)


#: Rows and a digest of all of them for each query without SQL. They pin today's results, which other tests hold against brute
#: force or planted cases; a change must be meant. Written by `python tests/test_queries.py`.
PINS = json.loads((Path(__file__).parent / "pins.json").read_text())


def pin(df):
    cols, got = rows(df)
    return [cols, len(got), hashlib.md5("\n".join(got).encode()).hexdigest()]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_pinned(spark, data, name):
    assert pin(QUERIES[name](spark, data)) == PINS[name]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


if __name__ == "__main__":
    from conftest import DATA

    from tideline.session import get_session

    spark_ = get_session("pins", cores=8, shuffle_partitions=4)
    found = {n: pin(QUERIES[n](spark_, DATA)) for n in sorted(set(QUERIES) - set(ORACLES))}
    (Path(__file__).parent / "pins.json").write_text(json.dumps(found, indent=1) + "\n")
