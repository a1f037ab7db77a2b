"""Every query against DuckDB on the smallest scale; those without SQL run and keep their schema."""

import os

import duckdb
import pytest

from docloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    columns = sorted(frame.columns)
    said = lambda v: "NA" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return columns, sorted(tuple(said(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    found = catalog.QUERIES[name](spark, DIR).toPandas()
    assert len(found.columns)
    if name in catalog.SQL:
        db = duckdb.connect()
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
        assert rows(found) == rows(db.execute(catalog.SQL[name]).df())
