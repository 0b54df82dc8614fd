"""Queries against DuckDB over values that the small tables don't hold."""

import pytest

from ledgerloom.plans.registry import oracle_sql, queries


@pytest.fixture
def agree(spark, tmp_path):
    """Whether a query gives its SQL's rows exactly over events of the given (event_id, value)."""
    import duckdb

    def run(name, *values):
        c = duckdb.connect()
        rows = ", ".join(f"({i}::BIGINT, TIMESTAMP '2024-01-05 10:00:00' + INTERVAL ({i}) SECOND, {i % 7}::BIGINT, 'purchase', {v}::DOUBLE, '{{\"k\": {i % 100}}}')" for i, v in values)
        c.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {rows}) AS t(event_id, ts, user_id, event_type, value, props)")
        c.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        df = queries()[name](spark, str(tmp_path))
        want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({oracle_sql()[name]})").fetchall()
        return sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)

    return run


def test_a_quote_of_zero_is_published_with_a_price_of_zero(agree):
    assert agree("a11_publish_messages", (1, 0), (2, 3.5), (10, 0))


def test_a_price_of_zero_is_read(agree):
    assert agree("b04_b05_b06_coercion", (1, 0), (2, 0), (4, 1.5), (5, -2.5), (7, 0))


def test_a_copy_that_just_fits_has_no_note(agree):
    # 2 % of these is a number of twentieths, the room of an event_id that ends in that number
    assert agree("b17_copy_size", *[(1000 + 10 * i + k, 2.5 * k) for i in range(3) for k in range(10)], (2001, 0.05))
