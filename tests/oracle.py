"""Comparing a query with its SQL on the same tables."""

from __future__ import annotations

import os


def assert_same(spark, sf_dir, name, query, sql):
    import duckdb

    db = duckdb.connect()
    for t in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf_dir}/{t}'")
    want = db.execute(sql).df()
    got = query(spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    assert len(got) == len(want), name
    assert bool(((got == want) | (got.isna() & want.isna())).all().all()), f"{name}\n{got.head()}\n{want.head()}"
