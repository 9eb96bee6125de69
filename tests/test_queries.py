"""Every query with SQL gives the rows of that SQL; the others run."""

import duckdb
import pytest

from tessella import views
from tessella.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df)]
    value = lambda x: "~" if x is None or x != x else x.item() if hasattr(x, "item") else x
    return list(df), sorted((tuple(value(x) for x in r) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck.sql(ORACLE_SQL[name]).df())
    else:
        assert len(got)


def same_as_sql(spark, name, table, df, folder):
    df.write.parquet(f"{folder}/{table}.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = rows(c.sql(ORACLE_SQL[name]).df())
    assert rows(QUERIES[name](spark, str(folder)).toPandas()) == want
    return want[1]


def test_interval_diff_keeps_what_rounds_to_zero(spark, tmp_path):
    """Two orders with a label of which the sums of durations leave less than 0.00005."""
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").where("l_orderkey in (33601, 42964)")
    assert any(0.0 in r for r in same_as_sql(spark, "q_interval_diff", "lineitem", lines, tmp_path))


def test_multiscale_without_a_row_outside_cuts(spark, tmp_path):
    events = spark.sql("SELECT id AS event_id, timestamp_seconds(1704067200 + 3600 * (id div 2)) AS ts, 0L AS user_id, if(id % 2 = 0, 'view', 'error') AS event_type, double(id) AS value, '{}' AS props FROM range(100)")
    assert same_as_sql(spark, "q_multiscale", "events", events, tmp_path) == []


@pytest.mark.parametrize("name", ["q_sp_insert", "q_gap_repair", "q_tier_convert"])
def test_labels_are_sorted_once_in_parts_by_rows(spark, duck, monkeypatch, name):
    """A task's memory is its sort of a part: one sort, and parts that hold no more rows when the table grows."""
    monkeypatch.setattr(views, "PART_ROWS", 200)
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Scan parquet") == plan.count("REPARTITION_BY_NUM") == 1
    assert df.rdd.getNumPartitions() == -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 200)
    assert rows(df.toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())
