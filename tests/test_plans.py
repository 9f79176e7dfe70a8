"""Every registered query of the core against its SQL on the smallest tables."""

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from quirelake.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, str(DATA))
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [list(want.columns).index(c) for c in columns]
    left = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    right = Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert left == right


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, str(DATA)).count() > 0
