"""Wallet metrics, scores, patterns, styles, snapshots and regimes over the trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patterns as pt
from ..operators import regime as rg
from ..operators import snapshots as sn
from ..operators import strategy as st
from ..operators import timeops as tm
from ..operators import wallets as wl
from ..sources.bindings import DAY, HOUR, NOW, POSITIONS, PRELUDE, SOL_PRICE, failed_transactions, read, tokens, trades, wallets
from .base import book
from .catalog import Catalog, r6

C = Catalog()
START = NOW - 30 * DAY
MIN_EVIDENCE = 30


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = book(spark, sf_dir).filter("status = 'closed'")
    by = closed.groupBy("wallet").agg(F.count(F.lit(1)).alias("closed"), F.count_if(F.col("pnl") > 0).alias("wins"), F.round(F.sum("pnl"), 6).alias("total_pnl"))
    return by.withColumn("win_rate", F.round(F.col("wins") / F.col("closed"), 6)).orderBy(F.desc("total_pnl"), "wallet").limit(20)


C.add(POSITIONS + " SELECT wallet, count(*) AS closed, count(*) FILTER (pnl > 0) AS wins, round(sum(pnl), 6) AS total_pnl, round(count(*) FILTER (pnl > 0) / count(*), 6) AS win_rate FROM positions WHERE status = 'closed' GROUP BY wallet ORDER BY total_pnl DESC, wallet LIMIT 20")(flagship)


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    return wl.wallet_metrics(t, book(spark, sf_dir), tokens(t), NOW)


METRICS = (
    POSITIONS + f""",
ts AS (SELECT wallet, count(*) AS trade_count, count(*) FILTER (side = 'buy') AS buy_count, count(*) FILTER (side = 'sell') AS sell_count,
  sum(quote) FILTER (quote_kind = 'wsol') AS total_volume_sol, min(us) AS first_us, max(us) AS last_us FROM trades GROUP BY wallet),
ps AS (SELECT p.wallet, count(*) AS position_count, count(*) FILTER (status = 'closed') AS closed_position_count, count(*) FILTER (status = 'closed' AND pnl > 0) AS win_count,
  count(*) FILTER (status = 'closed' AND pnl > 0) / nullif(count(*) FILTER (status = 'closed'), 0) AS win_rate, sum(pnl) FILTER (status = 'closed') AS total_pnl_sol,
  avg(roi) FILTER (status = 'closed') AS avg_roi, median(roi) FILTER (status = 'closed') AS median_roi,
  CASE WHEN count(roi) FILTER (status = 'closed') >= 2 THEN stddev_pop(roi) FILTER (status = 'closed') END AS roi_std,
  CASE WHEN sum(-pnl) FILTER (status = 'closed' AND pnl < 0) > 0 THEN coalesce(sum(pnl) FILTER (status = 'closed' AND pnl > 0), 0) / sum(-pnl) FILTER (status = 'closed' AND pnl < 0) END AS profit_factor,
  CAST(round_even(avg(hold_s) FILTER (status = 'closed'), 0) AS BIGINT) AS avg_hold_seconds, CAST(round_even(median(hold_s) FILTER (status = 'closed'), 0) AS BIGINT) AS median_hold_seconds,
  avg(bought_sol) AS avg_position_sol, max(bought_sol) AS max_position_sol, CAST(round_even(avg(greatest((opened_us - k.first_seen) / 1e6, 0)), 0) AS BIGINT) AS avg_entry_delay_seconds,
  CASE WHEN count(*) FILTER (status = 'closed') > 0 THEN coalesce(sum(pnl) FILTER (status = 'closed' AND closed_us >= {NOW - 7 * DAY}), 0) END AS pnl_7d_sol,
  CASE WHEN count(*) FILTER (status = 'closed') > 0 THEN coalesce(sum(pnl) FILTER (status = 'closed' AND closed_us >= {NOW - 30 * DAY}), 0) END AS pnl_30d_sol
  FROM positions p LEFT JOIN tokens k USING (token) GROUP BY p.wallet),
cv AS (SELECT wallet, closed_us, token, episode, sum(pnl) OVER (PARTITION BY wallet ORDER BY closed_us, token, episode) AS curve FROM positions WHERE status = 'closed'),
pk AS (SELECT *, greatest(0, max(curve) OVER (PARTITION BY wallet ORDER BY closed_us, token, episode)) AS peak FROM cv),
dd AS (SELECT wallet, max(peak - curve) AS max_drawdown_sol, max(CASE WHEN peak > 0 THEN (peak - curve) / peak END) AS max_drawdown_pct FROM pk GROUP BY wallet),
sl AS (SELECT wallet, token, episode, count(*) AS n_sells FROM (
  SELECT s.event_id, p.wallet, p.token, p.episode, row_number() OVER (PARTITION BY s.event_id ORDER BY p.opened_us, p.episode) AS n
  FROM trades s JOIN positions p ON p.wallet = s.wallet AND p.token = s.token AND p.status = 'closed' AND s.us BETWEEN p.opened_us AND p.closed_us WHERE s.side = 'sell') WHERE n = 1 GROUP BY 1, 2, 3),
pe AS (SELECT wallet, count(*) FILTER (n_sells > 1) / count(*) AS partial_exit_ratio FROM (SELECT * FROM positions WHERE status = 'closed') LEFT JOIN sl USING (wallet, token, episode) GROUP BY wallet),
stats AS (SELECT *, round_even(trade_count / greatest((last_us - first_us) / 86400e6, 1), 4) AS trades_per_day FROM ts LEFT JOIN ps USING (wallet) LEFT JOIN dd USING (wallet) LEFT JOIN pe USING (wallet)),
sv AS (SELECT *, greatest(coalesce(closed_position_count, 0), 0) AS n, least(greatest(coalesce(win_count, 0), 0), greatest(coalesce(closed_position_count, 0), 0)) AS w FROM stats),
cf AS (SELECT *, round(least(greatest((w + 3.5) / (n + 10) / 0.7, 0), 1), 4) AS c_win,
  round(CASE WHEN profit_factor IS NOT NULL THEN profit_factor / (profit_factor + 1) WHEN w > 0 THEN 0.9 ELSE 0.5 END, 4) AS c_profit,
  round(CASE WHEN roi_std IS NOT NULL AND n >= 3 THEN 1 / (1 + roi_std) ELSE 0.5 END, 4) AS c_steady,
  round(coalesce(0.5 * (1 + pnl_30d_sol / (abs(pnl_30d_sol) + 1)), 0.5), 4) AS c_recent, round(n / (n + 20), 4) AS c_known FROM sv),
scored AS (SELECT *, round(least(greatest(30 + (35 * c_win + 30 * c_profit + 15 * c_steady + 10 * c_recent + 10 * c_known - 30) * n / (n + 10), 0), 100), 2) AS confidence_score FROM cf)"""
)

_COUNTS = ["trade_count", "buy_count", "sell_count", "position_count", "closed_position_count", "win_count", "avg_hold_seconds", "median_hold_seconds", "avg_entry_delay_seconds", "first_us", "last_us"]
_RATIOS = ["total_volume_sol", "win_rate", "total_pnl_sol", "avg_roi", "median_roi", "roi_std", "profit_factor", "max_drawdown_sol", "max_drawdown_pct", "avg_position_sol", "max_position_sol", "pnl_7d_sol", "pnl_30d_sol", "partial_exit_ratio", "trades_per_day"]
_rounded = lambda cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@C.add(METRICS + " SELECT wallet, " + ", ".join(_COUNTS) + ", " + _rounded(_RATIOS) + " FROM stats")
def i01_wallet_metrics(spark, sf_dir):
    return stats(spark, sf_dir).select("wallet", *_COUNTS, *r6(*_RATIOS))


@C.add(METRICS + " SELECT wallet, confidence_score, c_win, c_profit, c_steady, c_recent, c_known FROM scored")
def i02_confidence_score(spark, sf_dir):
    s = wl.confidence(stats(spark, sf_dir))
    names = ["c_win", "c_profit", "c_steady", "c_recent", "c_known"]
    return s.select("wallet", "confidence_score", *[F.get("components", F.lit(i))["value"].alias(n) for i, n in enumerate(names)])


@C.add(METRICS + " SELECT wallet, tracked, confidence_score FROM wallets LEFT JOIN scored USING (wallet) WHERE tracked OR confidence_score >= 35 ORDER BY tracked DESC, confidence_score DESC NULLS LAST, wallet DESC LIMIT 40")
def g07_followed_lane(spark, sf_dir):
    return wl.followed(wl.confidence(stats(spark, sf_dir)), wallets(trades(spark, sf_dir)), 35, 40).select("wallet", "tracked", "confidence_score")


_RANKED = " UNION ALL ".join(f"(SELECT '{m}' AS metric, wallet, round({m}, 6) AS value, CASE WHEN wallet % 5 = 0 THEN 'suspicious' ELSE 'clear' END AS verdict FROM scored WHERE {m} IS NOT NULL AND closed_position_count >= 10 ORDER BY round({m}, 6) DESC, wallet LIMIT 25)" for m in wl.RANKED_BY)


@C.add(METRICS + f" SELECT * FROM ({_RANKED})")
def g03_top_wallets(spark, sf_dir):
    """The best wallets by each of the four metrics, with their latest verdict."""
    s = stats(spark, sf_dir)
    both = s.join(wl.confidence(s).select("wallet", "confidence_score"), "wallet")
    verdicts = trades(spark, sf_dir).select("wallet", "us", "event_id", F.when(F.col("wallet") % 5 == 0, "suspicious").otherwise("clear").alias("verdict"))
    latest = tm.latest_per_key(verdicts, ["wallet"], [F.desc("us"), F.desc("event_id")]).select("wallet", "verdict")
    parts = [wl.ranked(both, m, 10, 25).select("metric", "wallet", "value") for m in wl.RANKED_BY]
    return pt.all_findings(parts).join(latest, "wallet", "left").select("metric", "wallet", "value", "verdict")


# --- patterns --------------------------------------------------------------

_CLOSED = POSITIONS + f", closed AS (SELECT p.*, CASE WHEN roi IS NOT NULL THEN roi > 0 ELSE coalesce(pnl, 0) > 0 END AS win FROM positions p WHERE status = 'closed' AND closed_us >= {START})"


def _pattern_sql(kind: str, key: str, source: str = "closed") -> str:
    return f"SELECT '{kind}' AS kind, {key} AS key, count(*) AS n, round(avg(CAST(win AS DOUBLE)), 6) AS win_rate, round(avg(roi), 6) AS avg_roi, (SELECT round(avg(CAST(win AS DOUBLE)), 6) FROM {source}) AS overall_win_rate FROM {source} GROUP BY 2 HAVING count(*) >= {MIN_EVIDENCE}"


_DELAY = "CASE WHEN d < 60 THEN '<1m' WHEN d < 600 THEN '1-10m' WHEN d < 3600 THEN '10-60m' WHEN d < 21600 THEN '1-6h' WHEN d < 86400 THEN '6-24h' ELSE '>24h' END"
_HOLD = "CASE WHEN hold_s < 300 THEN '<5m' WHEN hold_s < 1800 THEN '5-30m' WHEN hold_s < 14400 THEN '30m-4h' WHEN hold_s < 86400 THEN '4-24h' ELSE '>24h' END"
_ALL_PATTERNS = (
    _CLOSED + ", delayed AS (SELECT c.*, greatest((opened_us - first_seen) / 1e6, 0) AS d FROM closed c JOIN tokens USING (token)), edges AS (SELECT " + ", ".join(f"quantile_cont(bought_sol, {p / 5}) AS e{p}" for p in range(6)) + " FROM closed), "
    "sized AS (SELECT c.*, CASE WHEN bought_sol < e1 THEN 'q1' WHEN bought_sol < e2 THEN 'q2' WHEN bought_sol < e3 THEN 'q3' WHEN bought_sol < e4 THEN 'q4' ELSE 'q5' END AS q FROM closed c, edges) "
    + " UNION ALL ".join([_pattern_sql("hour_of_day", f"lpad(CAST(opened_us % {DAY} // {HOUR} AS VARCHAR), 2, '0')"), _pattern_sql("entry_delay", _DELAY, "delayed"), _pattern_sql("hold_time", _HOLD), _pattern_sql("position_size", "q", "sized")])
)


def _closed(spark, sf_dir):
    return pt.closed_in_window(book(spark, sf_dir), START)


@C.add(_ALL_PATTERNS)
def i03_h01_patterns(spark, sf_dir):
    closed = _closed(spark, sf_dir)
    parts = [pt.hour_of_day(closed, MIN_EVIDENCE), pt.entry_delay(closed, tokens(trades(spark, sf_dir)), MIN_EVIDENCE), pt.hold_time(closed, MIN_EVIDENCE), pt.position_size(closed, MIN_EVIDENCE)]
    return pt.all_findings(parts).select("kind", "key", "n", *r6("win_rate", "avg_roi", "overall_win_rate"))


_SENTENCES = _ALL_PATTERNS.replace("round(avg(CAST(win AS DOUBLE)), 6)", "avg(CAST(win AS DOUBLE))").replace("SELECT 'hour_of_day' AS kind", "SELECT kind, key, printf('%s %s: won %.1f%% over %d positions (overall %.1f%%)', CASE kind WHEN 'hour_of_day' THEN 'hour' WHEN 'entry_delay' THEN 'entry delay' WHEN 'hold_time' THEN 'hold time' ELSE 'size quintile' END, key, round(win_rate * 100, 1), n, round(overall_win_rate * 100, 1)) AS description FROM (SELECT 'hour_of_day' AS kind") + ")"


@C.add(_SENTENCES)
def b16_finding_sentences(spark, sf_dir):
    closed = _closed(spark, sf_dir)
    parts = [pt.hour_of_day(closed, MIN_EVIDENCE), pt.entry_delay(closed, tokens(trades(spark, sf_dir)), MIN_EVIDENCE), pt.hold_time(closed, MIN_EVIDENCE), pt.position_size(closed, MIN_EVIDENCE)]
    return pt.all_findings(parts).select("kind", "key", "description")


@C.add(_CLOSED + f", m AS (SELECT wallet, avg(coalesce(bought_sol, 0)) AS a FROM closed GROUP BY wallet), wh AS (SELECT wallet FROM m WHERE a >= (SELECT quantile_cont(a, 0.9) FROM m) AND (SELECT count(*) FROM m) >= 10), f AS (SELECT token, CAST(sum(CAST(CASE WHEN side = 'buy' THEN quote ELSE -quote END AS DECIMAL(18,2))) AS DOUBLE) AS net_flow, count(*) AS n FROM trades WHERE quote_kind = 'wsol' AND us >= {NOW - 72 * HOUR} AND wallet IN (SELECT wallet FROM wh) GROUP BY token) SELECT token, net_flow, n FROM (SELECT * FROM f ORDER BY abs(net_flow) DESC, token LIMIT 10) WHERE n >= 5")
def i03e_whale_flow(spark, sf_dir):
    return pt.whale_flow(_closed(spark, sf_dir), trades(spark, sf_dir), NOW, hours=72, min_evidence=5).select("token", "net_flow", "n")


_GRID = "grid AS (SELECT token, (us // {w} + 1) * {w} AS ts, arg_max(quote / amount, (us, event_id)) AS price, coalesce(sum(quote) FILTER (quote_kind = 'wsol'), 0) AS volume_1h, count(*) AS trades_1h, coalesce(sum(quote) FILTER (quote_kind = 'wsol'), 0) AS liquidity FROM trades GROUP BY 1, 2)"


@C.add(POSITIONS + ", " + _GRID.format(w=6 * HOUR) + f", r AS (SELECT token, ts, volume_1h, row_number() OVER (PARTITION BY token ORDER BY ts DESC) AS n FROM grid WHERE ts >= {START}), p AS (SELECT token, max(volume_1h) FILTER (n = 3) AS a, max(volume_1h) FILTER (n = 2) AS b, max(volume_1h) FILTER (n = 1) AS c FROM r GROUP BY token) SELECT token, round(a, 6) AS v1, round(b, 6) AS v2, round(c, 6) AS v3 FROM p WHERE a < b AND b < c")
def i03f_f03_volume_trend(spark, sf_dir):
    got = pt.volume_trend(sn.hourly_grid(trades(spark, sf_dir), 6 * HOUR), START)
    return got.select("token", *[F.round(F.get("path", F.lit(i)), 6).alias(f"v{i + 1}") for i in range(3)])


# --- styles ----------------------------------------------------------------

_STYLE = (
    METRICS + ", raw AS (SELECT wallet, ln(1 + median_hold_seconds) AS f_hold, ln(1 + avg_entry_delay_seconds) AS f_delay, ln(1 + avg_position_sol) AS f_size, ln(1 + trades_per_day) AS f_per_day, partial_exit_ratio AS f_partial, avg_roi AS f_roi FROM stats WHERE closed_position_count >= 3), "
    "med AS (SELECT " + ", ".join(f"coalesce(median({f}), 0) AS m_{f}" for f in st.FEATURES) + " FROM raw), imp AS (SELECT wallet, " + ", ".join(f"coalesce({f}, m_{f}) AS {f}" for f in st.FEATURES) + ", f_hold IS NULL AND f_delay IS NULL AS heavy FROM raw, med), "
    "styled AS (SELECT wallet, heavy, CASE WHEN exp(f_delay) - 1 < 120 THEN 'sniper' WHEN exp(f_hold) - 1 < 900 THEN 'scalper' WHEN exp(f_hold) - 1 < 14400 AND exp(f_delay) - 1 < 3600 THEN 'momentum' WHEN exp(f_hold) - 1 < 604800 AND f_partial > 0.5 THEN 'accumulator' WHEN exp(f_hold) - 1 < 604800 THEN 'swing' WHEN f_partial > 0.5 THEN 'accumulator' ELSE 'holder' END AS style FROM imp)"
)


def features(spark, sf_dir):
    return st.impute(st.raw_features(stats(spark, sf_dir)))


@C.add(_STYLE + " SELECT wallet, heavy, " + _rounded(st.FEATURES) + " FROM imp")
def i04_style_features(spark, sf_dir):
    return features(spark, sf_dir).select("wallet", "heavy", *r6(*st.FEATURES))


@C.add()
def i04b_style_clusters(spark, sf_dir):
    return st.cluster_styles(features(spark, sf_dir)).select("wallet", "cluster", "style", F.round("style_confidence", 6).alias("style_confidence"))


@C.add(_STYLE + " SELECT wallet, style, CAST(CASE WHEN heavy THEN 0.3 ELSE 1.0 END AS DOUBLE) AS style_confidence FROM styled")
def i04c_rule_styles(spark, sf_dir):
    return st.rule_styles(features(spark, sf_dir))


@C.add(_STYLE + f" SELECT style, count(DISTINCT s.wallet) AS wallets, count(p.pnl) AS positions, round(count(*) FILTER (p.pnl > 0) / nullif(count(p.pnl), 0), 6) AS win_rate, round(avg(p.roi), 6) AS avg_roi, round(coalesce(sum(p.pnl), 0), 6) AS total_pnl, round(CASE WHEN sum(-p.pnl) FILTER (p.pnl < 0) > 0 THEN coalesce(sum(p.pnl) FILTER (p.pnl > 0), 0) / sum(-p.pnl) FILTER (p.pnl < 0) END, 6) AS profit_factor, CAST(floor(avg(p.hold_s)) AS BIGINT) AS avg_hold_s FROM styled s LEFT JOIN (SELECT * FROM positions WHERE status = 'closed' AND closed_us >= {START}) p ON p.wallet = s.wallet GROUP BY style")
def i04d_style_stats(spark, sf_dir):
    got = st.style_stats(st.rule_styles(features(spark, sf_dir)), book(spark, sf_dir), START)
    return got.select("style", "wallets", "positions", "avg_hold_s", *r6("win_rate", "avg_roi", "total_pnl", "profit_factor"))


# --- snapshots -------------------------------------------------------------


@C.add(POSITIONS + f", s AS (SELECT token, arg_max(quote / amount, (us, event_id)) FILTER (quote_kind = 'wsol') AS price, sum(quote) FILTER (quote_kind = 'wsol' AND us >= {NOW - HOUR // 12}) / nullif(sum(amount) FILTER (quote_kind = 'wsol' AND us >= {NOW - HOUR // 12}), 0) AS vwap_5m, coalesce(sum(quote) FILTER (quote_kind = 'wsol' AND us >= {NOW - HOUR}), 0) AS volume_1h, coalesce(sum(quote) FILTER (quote_kind = 'wsol'), 0) AS volume_24h, count(*) FILTER (us >= {NOW - HOUR}) AS trades_1h, count(DISTINCT wallet) FILTER (side = 'buy' AND us >= {NOW - HOUR // 12}) AS buyers_5m FROM trades WHERE us >= {NOW - DAY} GROUP BY token), pl AS (SELECT s_nationkey AS token, max(abs(s_acctbal)) AS liquidity FROM supplier GROUP BY 1), ho AS (SELECT c_nationkey AS token, count(*) AS holders FROM customer WHERE c_acctbal > 0 GROUP BY 1) SELECT token, round(price, 6) AS price, round(price * 150, 6) AS price_usd, round(vwap_5m, 6) AS vwap_5m, round(volume_1h, 6) AS volume_1h, round(volume_24h, 6) AS volume_24h, trades_1h, buyers_5m, round(price * 150 * supply, 2) AS market_cap_usd, liquidity, holders FROM s LEFT JOIN tokens USING (token) LEFT JOIN pl USING (token) LEFT JOIN ho USING (token)")
def i19_token_snapshot(spark, sf_dir):
    t = trades(spark, sf_dir)
    pools = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("token"), F.col("s_suppkey").alias("pool"), F.abs("s_acctbal").alias("sol"))
    held = read(spark, sf_dir, "customer").filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("token")).agg(F.count(F.lit(1)).alias("holders"))
    s = sn.token_snapshot(t, tokens(t), NOW, SOL_PRICE, pools=pools, holders=held)
    return s.select("token", *r6("price", "price_usd", "vwap_5m", "volume_1h", "volume_24h"), "trades_1h", "buyers_5m", F.round("market_cap_usd", 2).alias("market_cap_usd"), "liquidity", "holders")


@C.add(POSITIONS + f" SELECT (SELECT count(*) FROM trades WHERE us >= {NOW - 3 * HOUR} AND us <= {NOW - 2 * HOUR}) AS trades_1h, (SELECT round(coalesce(sum(quote), 0), 6) FROM trades WHERE quote_kind = 'wsol' AND us >= {NOW - 3 * HOUR} AND us <= {NOW - 2 * HOUR}) AS volume_1h, (SELECT count(DISTINCT wallet) FROM trades WHERE us >= {NOW - 3 * HOUR} AND us <= {NOW - 2 * HOUR}) AS wallets_1h, (SELECT count(*) FROM tokens WHERE first_seen BETWEEN {NOW - 3 * HOUR} AND {NOW - 2 * HOUR}) AS launched_1h, (SELECT count(*) FROM failed WHERE us BETWEEN {NOW - 3 * HOUR} AND {NOW - 2 * HOUR}) AS failed_1h")
def i19b_e11_market_snapshot(spark, sf_dir):
    t = trades(spark, sf_dir)
    return sn.market_snapshot(t, tokens(t), failed_transactions(spark, sf_dir), NOW - 2 * HOUR).withColumn("volume_1h", F.round("volume_1h", 6))


@C.add(POSITIONS + f" SELECT w.wallet, CASE WHEN w.wallet % 4 = 0 THEN 0 ELSE coalesce(c_acctbal, 0) END AS balance, coalesce(o.n, 0) AS open_positions FROM wallets w LEFT JOIN customer ON c_custkey = w.wallet LEFT JOIN (SELECT wallet, count(*) AS n FROM positions WHERE status = 'open' GROUP BY wallet) o ON o.wallet = w.wallet WHERE last_seen >= {NOW - 2 * DAY}")
def i19c_wallet_snapshot(spark, sf_dir):
    balances = read(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("wallet"), F.col("c_acctbal").alias("balance"))
    return sn.wallet_snapshot(wallets(trades(spark, sf_dir)), balances, book(spark, sf_dir), NOW - 2 * DAY)


@C.add("WITH a AS (SELECT c_nationkey AS mint, c_custkey AS owner, c_acctbal AS amount FROM customer WHERE c_acctbal > 0 AND c_custkey % 10 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY mint ORDER BY amount DESC, owner) AS n FROM a), s AS (SELECT c_nationkey AS mint, sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END) AS supply FROM customer GROUP BY 1) SELECT mint, count(*) AS holders, round(sum(amount) FILTER (n <= 10) / max(supply), 6) AS top_share FROM r JOIN s USING (mint) GROUP BY mint")
def i20_holder_concentration(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("mint"), F.col("c_custkey").alias("owner"), F.col("c_acctbal").alias("amount"))
    supply = c.groupBy("mint").agg(F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0.0)).alias("supply"))
    return sn.holder_concentration(c, c.filter("owner % 10 = 0"), supply).withColumn("top_share", F.round("top_share", 6))


@C.add("SELECT s_nationkey AS mint, round(sum(CASE WHEN s_suppkey % 7 = 0 THEN abs(s_acctbal) ELSE 0 END) / sum(abs(s_acctbal)), 6) AS burned_share, round(coalesce(max(CASE WHEN s_suppkey % 7 <> 0 THEN abs(s_acctbal) END), 0) / sum(abs(s_acctbal)), 6) AS top_share, max(abs(s_acctbal)) AS liquidity, arg_max(s_suppkey, abs(s_acctbal)) AS pool FROM supplier GROUP BY 1")
def i20b_i20c_lp_and_pools(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("mint"), F.when(F.col("s_suppkey") % 7 == 0, "burn").otherwise(F.col("s_suppkey").cast("string")).alias("owner"), F.abs("s_acctbal").alias("amount"), F.col("s_suppkey").alias("pool"))
    lp = sn.lp_burned(s, ["burn"]).select("mint", *r6("burned_share", "top_share"))
    return lp.join(sn.deepest_pool(s.select(F.col("mint").alias("token"), "pool", F.col("amount").alias("sol"))).withColumnRenamed("token", "mint"), "mint")


@C.add(POSITIONS + ", " + _GRID.format(w=DAY) + ", d AS (SELECT token, ts, trades_1h - lag(trades_1h) OVER (PARTITION BY token ORDER BY ts) AS growth, row_number() OVER (PARTITION BY token ORDER BY ts DESC) AS n FROM grid) SELECT token, growth FROM d WHERE n = 1")
def f13_latest_two_delta(spark, sf_dir):
    g = sn.hourly_grid(trades(spark, sf_dir), DAY)
    return sn.holder_growth(g.select("token", "ts", F.col("trades_1h").alias("holders")))


# --- regimes ---------------------------------------------------------------


def _regime_sql(now: int) -> str:
    return POSITIONS + f""", h AS (SELECT us // {HOUR} AS ts_h, avg(quote) AS price, coalesce(sum(quote) FILTER (quote_kind = 'wsol'), 0) AS volume, count(*) AS n FROM trades GROUP BY 1),
w AS (SELECT (ts_h + 1) * {HOUR} AS ts, price, volume, n, ((ts_h + 1) * {HOUR} - {now - 24 * HOUR}) // {HOUR} AS i FROM h WHERE (ts_h + 1) * {HOUR} BETWEEN {now - 24 * HOUR} AND {now}),
s AS (SELECT *, lag(price) OVER (ORDER BY i) AS before, row_number() OVER (ORDER BY i DESC) AS back, (SELECT count(*) FROM tokens WHERE (first_seen // {HOUR} + 1) * {HOUR} = w.ts) AS launched FROM w),
one AS (SELECT count(*) AS points, CASE WHEN count(*) FILTER (ts >= {now - HOUR}) >= 2 THEN (arg_max(price, i) / arg_min(price, i) FILTER (ts >= {now - HOUR}) - 1) * 100 WHEN count(*) FILTER (ts >= {now - HOUR}) = 1 THEN (arg_max(price, i) / arg_max(before, i) - 1) * 100 END AS last_pct, median(launched) AS usual, arg_max(launched, i) AS launches, (arg_max(price, i) - arg_min(price, i)) / abs(arg_min(price, i)) * 100 AS pct, stddev_pop((price - before) / abs(before) * 100) AS sd, median(volume) AS mv, arg_max(volume, i) AS lv,
  (arg_max(price, i) FILTER (back <= 3) - arg_min(price, i) FILTER (back <= 3)) / abs(arg_min(price, i) FILTER (back <= 3)) * 100 AS tp, (arg_max(volume, i) FILTER (back <= 3) - arg_min(volume, i) FILTER (back <= 3)) / abs(arg_min(volume, i) FILTER (back <= 3)) * 100 AS tm FROM s),
lq AS (SELECT median(l) AS ml FROM (SELECT token, arg_max(v, ts) AS l FROM (SELECT token, (us // {HOUR} + 1) * {HOUR} AS ts, coalesce(sum(quote) FILTER (quote_kind = 'wsol'), 0) AS v FROM trades GROUP BY 1, 2) WHERE ts >= {now - 24 * HOUR} AND ts <= {now} GROUP BY token)),
lw AS (SELECT * FROM trades WHERE quote_kind = 'wsol' AND us >= {now - HOUR} AND us <= {now}),
wp AS (SELECT wallet, sum(quote) AS v, sum(CASE WHEN side = 'buy' THEN quote ELSE -quote END) AS net FROM lw GROUP BY wallet)
SELECT CASE WHEN pct > 3 THEN 'bull' WHEN pct < -3 THEN 'bear' ELSE 'sideways' END AS regime, sd > 5 AS high_volatility, ml < 25 OR lv < 0.5 * mv AS low_liquidity,
  abs(tp) >= 1 AND abs(tm) >= 1 AND (tp > 0) <> (tm > 0) AS trend_exhaustion, launches >= {rg.WAVE_MIN} AND launches >= {rg.WAVE_MULT} * greatest(usual, 1e-9) AS launch_wave,
  coalesce((SELECT count(*) >= {rg.PANIC_MIN} AND count(*) FILTER (side = 'sell') > {rg.PANIC_RATIO} * greatest(count(*) FILTER (side = 'buy'), 1) FROM lw) AND last_pct < 0, FALSE) AS panic_selling, coalesce((SELECT count(*) FROM wp) >= {rg.WHALE_MIN} AND (SELECT sum(net) FROM wp WHERE v >= (SELECT quantile_cont(v, 0.9) FROM wp)) > {rg.WHALE_FLOW}, FALSE) AS whale_accumulation, round(last_pct, 6) AS last_pct, CAST(points AS INT) AS price_points, round(pct, 6) AS pct_change, round(sd, 6) AS return_stdev, round(ml, 6) AS median_liquidity,
  (SELECT count(*) FROM lw WHERE side = 'buy') AS buys, (SELECT count(*) FROM lw WHERE side = 'sell') AS sells FROM one, lq"""


@C.add(_regime_sql(NOW))
def i17_market_regime(spark, sf_dir):
    t = trades(spark, sf_dir)
    market = sn.market_grid(t, tokens(t), failed_transactions(spark, sf_dir))
    return _regime(t, market, NOW)


def _regime(t, market, now: int):
    got = rg.detect(market, sn.hourly_grid(t).select("token", "ts", "liquidity"), t.filter("quote_kind = 'wsol'"), now)
    return got.select("regime", "high_volatility", "low_liquidity", "trend_exhaustion", "launch_wave", "panic_selling", "whale_accumulation", "price_points", *r6("pct_change", "return_stdev", "last_pct", "median_liquidity"), "buys", "sells")


_DAYS = [NOW - k * DAY for k in (3, 12, 21)] + [NOW - 30 * DAY + 8 * HOUR]


@C.add(" UNION ALL ".join(f"SELECT {at} AS ts, * FROM ({_regime_sql(at)})" for at in _DAYS))
def i17_regime_over_days(spark, sf_dir):
    """The regime as several days saw it, the first one among them, when tokens were new."""
    t = trades(spark, sf_dir)
    market = sn.market_grid(t, tokens(t), failed_transactions(spark, sf_dir))
    return pt.all_findings([_regime(t, market, at).withColumn("ts", F.lit(at)) for at in _DAYS])


@C.add(POSITIONS + f", b AS (SELECT * FROM trades WHERE quote_kind = 'wsol' AND us >= {NOW - 24 * HOUR}), p AS (SELECT wallet, sum(quote) AS v, sum(CASE WHEN side = 'buy' THEN quote ELSE -quote END) AS net FROM b GROUP BY wallet) SELECT (SELECT count(*) FROM p) AS whale_population, round((SELECT sum(net) FROM p WHERE v >= (SELECT quantile_cont(v, 0.9) FROM p)), 6) AS whale_net, (SELECT count(*) FROM b WHERE side = 'buy') AS buys, (SELECT count(*) FROM b WHERE side = 'sell') AS sells, (SELECT count(*) FROM b) >= 10 AND (SELECT count(*) FROM b WHERE side = 'sell') > 1.5 * greatest((SELECT count(*) FROM b WHERE side = 'buy'), 1) AS sell_dominated")
def i17c_i17d_flow_flags(spark, sf_dir):
    b = trades(spark, sf_dir).filter((F.col("quote_kind") == "wsol") & (F.col("us") >= NOW - 24 * HOUR))
    n = b.agg(F.count_if(F.col("side") == "buy").alias("buys"), F.count_if(F.col("side") == "sell").alias("sells"))
    both = rg.whale_accumulation(b).crossJoin(n)
    dominated = (F.col("buys") + F.col("sells") >= rg.PANIC_MIN) & (F.col("sells") > rg.PANIC_RATIO * F.greatest(F.col("buys"), F.lit(1)))
    return both.select("whale_population", F.round("whale_net", 6).alias("whale_net"), "buys", "sells", dominated.alias("sell_dominated"))


@C.add(PRELUDE + f""", w AS (SELECT us // {DAY} AS day, wallet, side, quote FROM trades WHERE quote_kind = 'wsol'),
p AS (SELECT us // {DAY} AS day, avg(quote) AS price FROM trades GROUP BY 1),
m AS (SELECT day, (price - lag(price) OVER (ORDER BY day)) / abs(lag(price) OVER (ORDER BY day)) * 100 AS pct FROM p)
SELECT day, count(*) FILTER (side = 'buy') AS buys, count(*) FILTER (side = 'sell') AS sells, round(any_value(pct), 6) AS pct,
  coalesce(count(*) >= {rg.PANIC_MIN} AND count(*) FILTER (side = 'sell') > {rg.PANIC_RATIO / 1.5} * greatest(count(*) FILTER (side = 'buy'), 1) AND any_value(pct) < 0, FALSE) AS panic_selling FROM w JOIN m USING (day) GROUP BY day""")
def i17d_panic_days(spark, sf_dir):
    """Panic selling by day: sells outweigh buys, at two thirds of the usual ratio, while the price falls."""
    t = trades(spark, sf_dir).withColumn("window_index", F.floor(F.col("us") / DAY))
    pct = rg.window_returns(t.groupBy("window_index").agg(F.avg("quote").alias("price"))).select("window_index", "pct")
    n = t.filter("quote_kind = 'wsol'").groupBy("window_index").agg(F.count_if(F.col("side") == "buy").alias("buys"), F.count_if(F.col("side") == "sell").alias("sells"))
    j = n.join(pct, "window_index")
    flag = F.coalesce(rg.panic(F.col("buys"), F.col("sells"), F.col("pct"), rg.PANIC_RATIO / 1.5), F.lit(False))
    return j.select(F.col("window_index").alias("day"), "buys", "sells", F.round("pct", 6).alias("pct"), flag.alias("panic_selling"))


_LABELS = f"""d AS (SELECT us // {DAY} AS window_index, avg(quote) AS price FROM trades GROUP BY 1),
c AS (SELECT window_index, (price - lag(price) OVER (ORDER BY window_index)) / abs(lag(price) OVER (ORDER BY window_index)) * 100 AS pct, row_number() OVER (ORDER BY window_index) AS rn FROM d),
l AS (SELECT rn, window_index, pct, 'sideways' AS label FROM c WHERE rn = 1 UNION ALL
  SELECT c.rn, c.window_index, c.pct, CASE WHEN c.pct IS NULL THEN 'sideways' WHEN c.pct > 3 THEN 'bull' WHEN c.pct < -3 THEN 'bear' WHEN l.label = 'bull' AND c.pct > 2 THEN 'bull' WHEN l.label = 'bear' AND c.pct < -2 THEN 'bear' ELSE 'sideways' END FROM l JOIN c ON c.rn = l.rn + 1)"""


def daily_labels(spark, sf_dir):
    d = trades(spark, sf_dir).groupBy(F.floor(F.col("us") / DAY).alias("window_index")).agg(F.avg("quote").alias("price"))
    return rg.label_timeline(rg.window_returns(d))


@C.add(POSITIONS + ", " + _LABELS + " SELECT window_index, round(pct, 6) AS pct, label FROM l")
def f10_hysteresis_labels(spark, sf_dir):
    return daily_labels(spark, sf_dir).select("window_index", F.round("pct", 6).alias("pct"), "label")


@C.add(_STYLE + ", " + _LABELS + f", tl AS (SELECT window_index * {DAY} + {HOUR} AS ts, label AS regime FROM l) SELECT coalesce(tl.regime, 'unknown') AS regime, coalesce(s.style, 'unknown') AS style, count(*) AS positions, round(avg(CAST(coalesce(p.pnl, 0) > 0 AS DOUBLE)), 6) AS win_rate, round(avg(p.roi), 6) AS avg_roi, round(sum(coalesce(p.pnl, 0)), 6) AS total_pnl FROM (SELECT * FROM positions WHERE status = 'closed') p ASOF LEFT JOIN tl ON p.opened_us >= tl.ts LEFT JOIN styled s ON s.wallet = p.wallet GROUP BY 1, 2")
def i18_regime_by_style(spark, sf_dir):
    line = daily_labels(spark, sf_dir).select((F.col("window_index") * DAY + HOUR).alias("ts"), F.col("label").alias("regime"))
    got = rg.regime_style(book(spark, sf_dir).filter("status = 'closed'"), line, st.rule_styles(features(spark, sf_dir)))
    return got.select("regime", "style", "positions", *r6("win_rate", "avg_roi", "total_pnl"))
