"""The registered queries: names, SQL, and reruns."""

import duckdb
import pytest

import corpus_pipeline
from checks.compare import TABLES, normal
from nightwarden.llm import registry


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    result = db.execute(registry.ORACLES[name])
    assert normal(df.columns, df.collect()) == normal([d[0] for d in result.description], result.fetchall())
