"""The registered queries and their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks import registry
from checks.compare import TABLES, normal

SOME = ("event_xml_normalise", "rule_net_portscan", "ioc_address_join", "flow_features_84", "network_alerts",
        "status_rollup", "federated_round", "flow_window_join")


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert set(registry.queries()) <= set(queries)
    assert set(registry.queries()) == set(registry.oracles())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    result = db.execute(entry.oracle_sql()[name])
    assert normal(df.columns, df.collect()) == normal([d[0] for d in result.description], result.fetchall())
