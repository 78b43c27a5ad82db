import duckdb
import pytest

from daqframe.plans.queries import QUERIES, SQL, entry
from tests.oracle import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    frame = QUERIES[name](spark, SF)
    if name in SQL:
        compare(frame, SQL[name], SF)
    else:
        assert frame.count() > 0


def test_entry(spark):
    assert entry(spark, SF).count() == 2


@pytest.mark.parametrize("rows", [20_000, 0])
def test_index_and_end_of_events_in_any_order(spark, tmp_path, rows):
    """Events that don't lie in the order of their times, copies of them, and none at all."""
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    copies = f"SELECT e.* REPLACE (event_id + 1000 * k AS event_id) FROM '{SF}/events.parquet' e, range(20) t(k) ORDER BY hash(event_id + 1000 * k) LIMIT {rows}"
    connection.execute(f"COPY ({copies}) TO '{tmp_path}/events.parquet'")
    compare(QUERIES["q_index_and_end"](spark, str(tmp_path)), SQL["q_index_and_end"], str(tmp_path))
