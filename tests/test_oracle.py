"""Every core query with an oracle gives the oracle's rows; the others run."""

import pytest

from nearfold.queries import ORACLES, QUERIES


def _rows(values):
    return sorted(str([repr(v) if isinstance(v, float) else str(v) for v in row]) for row in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    assert cols == sorted(duck.sql(ORACLES[name]).columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    expected = duck.sql(f"SELECT {quoted} FROM ({ORACLES[name]}) x").fetchall()
    assert _rows(df.select(*cols).collect()) == _rows(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).columns
    QUERIES[name](spark, data).collect()
