import duckdb

import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["route", "id", "rule_score", "rank", "text"] and df.count() > 0


def test_every_oracle_has_a_query_and_parses():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    con = duckdb.connect()
    for name in ("documents", "events", "orders", "customer", "nation", "embeddings", "region"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    for name, sql in entry.oracle_sql().items():
        con.execute(f"EXPLAIN {sql}")
