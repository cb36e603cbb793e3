"""Row-by-row comparison of a Spark query and its DuckDB equivalent, order aside."""

from __future__ import annotations

import math


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if hasattr(value, "isoformat"):
        return str(value)[:26]
    return value


def rows(columns, data):
    return sorted((tuple(plain(r[c]) for c in columns) for r in data), key=str)


def assert_same(query, sql, spark, duck, sf_dir):
    found = query(spark, sf_dir)
    columns = sorted(found.columns)
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [dict(zip(names, r, strict=True)) for r in result.fetchall()]
    got, want = rows(columns, found.collect()), rows(columns, expected)
    assert len(got) == len(want)
    assert got == want
