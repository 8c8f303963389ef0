"""Every registered query against its SQL statement, over the smallest data set."""

from collections import Counter

import pytest
from conftest import SF

from sourcesift.plans.queries import ORACLES, QUERIES


def _plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = Counter(tuple(_plain(v) for v in r) for r in df.select(*columns).collect())
    if name not in ORACLES:
        assert rows
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = Counter(tuple(_plain(r[i]) for i in order) for r in cursor.fetchall())
    assert rows == expected
