"""Trained operators by their properties: held-out metrics, cluster names, and snapshots and back-tests by hand."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import decisions as dc
from ledgerloom.operators import snapshots as sn
from ledgerloom.operators import strategy as st
from ledgerloom.plans import jobs, judgement
from ledgerloom.sources.bindings import DAY, HOUR

SF = "/root/testdata/sf0.01"


def test_walk_forward_measures_rows_that_it_did_not_see(spark):
    rows = judgement.i12_i14_walk_forward(spark, SF).collect()
    data = judgement.profit_data(spark, SF).select("event_id", "us", "label").collect()
    assert 0 < len(rows) < len(data) / 4 and all(r.refused is None for r in rows)
    us = {r.event_id: r.us for r in data}
    first = min(us[r.event_id] for r in rows)
    assert {e for e, t in us.items() if t >= first} == {r.event_id for r in rows}
    assert all(0 <= r.p_profit <= 1 for r in rows)
    pos, neg = [r.p_profit for r in rows if r.label], [r.p_profit for r in rows if not r.label]
    wins = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
    assert rows[0].auc == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-6)
    assert rows[0].brier == pytest.approx(sum((r.p_profit - r.label) ** 2 for r in rows) / len(rows), abs=1e-5)
    assert rows[0].base_rate == pytest.approx(len(pos) / len(rows))


def test_walk_forward_says_why_it_refuses(spark):
    rows = judgement.i12_i14_walk_forward(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 1 and rows[0].event_id is None and "rows" in rows[0].refused


def test_clusters_take_the_rule_name_of_their_mean(spark):
    f = jobs.features(spark, SF)
    got = st.cluster_styles(f)
    rows = got.collect()
    n = f.count()
    assert len({r.wallet for r in rows}) == len(rows) == n
    assert len({r.cluster for r in rows}) <= min(max(2, min(5, n // 10)), n)
    assert all(0 < r.style_confidence <= 1 for r in rows)
    means = got.join(f, "wallet").groupBy("cluster").agg(F.first("style").alias("style"), F.count_distinct("style").alias("names"), *[F.avg(c).alias(c) for c in st.FEATURES])
    named = means.withColumn("want", st.style_rule(F.expm1("f_hold"), F.expm1("f_delay"), F.col("f_partial"))).collect()
    assert len({r.style for r in named}) == len(named)
    for r in named:
        assert r.names == 1 and (r.style == r.want or r.style.rpartition("-")[0] == r.want)


def test_snapshot_of_one_token(spark):
    now, m = 100 * DAY, 60_000_000
    rows = [  # token, wallet, us, event_id, side, amount, quote, quote_kind
        (1, 1, now - m, 1, "buy", 200.0, 1.0, "wsol"), (1, 2, now - 2 * m, 2, "buy", 600.0, 1.0, "wsol"), (1, 3, now - 3 * m, 3, "sell", 800.0, 2.0, "wsol"),
        (1, 1, now - 4 * m, 4, "buy", 100.0, 75.0, "stable"), (1, 4, now - 30 * m, 5, "buy", 100.0, 1.0, "wsol"), (1, 5, now - 5 * HOUR, 6, "buy", 50.0, 0.25, "wsol"),
        (2, 3, now - 2 * DAY, 7, "buy", 10.0, 0.5, "wsol"),
    ]
    t = spark.createDataFrame(rows, "token long, wallet long, us long, event_id long, side string, amount double, quote double, quote_kind string")
    supply = spark.createDataFrame([(1, 1e6), (2, 1e6)], "token long, supply double")
    pools = spark.createDataFrame([(1, 7, 85.0), (1, 8, 3.0)], "token long, pool long, sol double")
    held = spark.createDataFrame([(1, 321)], "token long, holders long")
    (s,) = sn.token_snapshot(t, supply, now, 150.0, pools=pools, holders=held).collect()  # the second token has no trade of the day
    assert (s.token, s.trades_5m, s.trades_1h, s.buyers_5m, s.holders, s.liquidity) == (1, 4, 5, 2, 321, 85.0)
    assert (s.price, s.price_usd, s.vwap_5m, s.volume_5m, s.volume_1h, s.volume_24h) == pytest.approx((0.005, 0.75, 4 / 1600, 4.0, 5.0, 5.25))
    assert s.market_cap_usd == pytest.approx(750_000)
    (bare,) = sn.token_snapshot(t, supply, now, 150.0).collect()
    assert bare.liquidity is None and bare.holders is None


def test_one_copy_a_token_until_its_leader_sells(spark):
    rows = [  # token, us, event_id, wallet, side, decided, price
        (1, 1, 1, 5, "buy", False, 1.0), (1, 2, 2, 6, "buy", True, 2.0), (1, 3, 3, 5, "buy", True, 9.0), (1, 4, 4, 5, "sell", False, 9.0), (1, 5, 5, 6, "sell", False, 3.0),
        (1, 6, 6, 6, "sell", False, 4.0), (1, 7, 7, 5, "buy", True, 4.0), (2, 1, 8, 6, "sell", False, 1.0), (2, 2, 9, 6, "buy", True, None), (2, 3, 10, 6, "sell", False, 2.0),
    ]
    t = spark.createDataFrame(rows, "token long, us long, event_id long, wallet long, side string, decided boolean, price double")
    got = [(r.token, r.buy_event, r.sell_event, r.roi) for r in dc.backtest(t).collect()]
    assert got == [(1, 2, 5, pytest.approx(0.5))]
