"""Every query with an oracle against DuckDB on the smallest tables; the others run."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
#: Model fits and text operators have tests of their own.
SLOW = {"gbt_forecast", "weather_ablation", "gbt_availability", "score_availability", "model_selection_boosted", "gbt_importance"}
NAMES = [n for n in QUERIES if n not in SLOW and n != "pipeline" and not (n.startswith("op") and n[2].isdigit())]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def told(value):
    """Numbers as floats, everything else as text."""
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return float(value)
    return value.strftime("%Y-%m-%d %H:%M:%S") if hasattr(value, "hour") else str(value)


def in_order(rows):
    """Rows sorted so that numbers a rounding apart don't change their place."""
    return sorted(rows, key=lambda r: ([x for x in r if isinstance(x, str)], [round(x, 3) for x in r if not isinstance(x, str)]))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = in_order(tuple(told(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        return
    r = duck.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = in_order(tuple(told(row[names.index(c)]) for c in columns) for row in r.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y if isinstance(x, str) or isinstance(y, str) else abs(x - y) <= 2e-5 for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_library_does_not_need_the_text_operators():
    import re
    from pathlib import Path

    root = Path(entry.__file__).parent / "gridlake"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
