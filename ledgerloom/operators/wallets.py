"""Wallet metrics and the evidence-shrunk confidence score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.bindings import DAY
from .positions import max_drawdown

# Weights of the score's components, and its prior.
WEIGHTS = {"win_rate": 35, "profitability": 30, "consistency": 15, "recency": 10, "experience": 10}
PRIOR = 30.0


def trade_stats(trades: DataFrame) -> DataFrame:
    """Counts by side, WSOL volume and time bounds of each wallet."""
    return trades.groupBy("wallet").agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.count_if(F.col("side") == "buy").alias("buy_count"),
        F.count_if(F.col("side") == "sell").alias("sell_count"),
        F.sum(F.when(F.col("quote_kind") == "wsol", F.col("quote"))).alias("total_volume_sol"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
    )


def position_stats(positions: DataFrame, tokens: DataFrame, now: int) -> DataFrame:
    closed = F.col("status") == "closed"
    pnl = F.coalesce("pnl", F.lit(0.0))
    gain, loss = F.sum(F.when(closed & (pnl > 0), pnl)), F.sum(F.when(closed & (pnl < 0), -pnl))
    delay = F.greatest((F.col("opened_us") - F.col("first_seen")) / 1e6, F.lit(0.0))
    have = F.count_if(closed) > 0
    since = lambda days: F.when(have, F.sum(F.when(closed & (F.col("closed_us") >= now - days * DAY), pnl).otherwise(0.0)))
    rois = F.when(closed, F.col("roi"))
    return positions.join(tokens.select("token", "first_seen"), "token", "left").groupBy("wallet").agg(
        F.count(F.lit(1)).alias("position_count"),
        F.count_if(closed).alias("closed_position_count"),
        F.count_if(closed & (pnl > 0)).alias("win_count"),
        F.try_divide(F.count_if(closed & (pnl > 0)), F.count_if(closed)).alias("win_rate"),
        F.sum(F.when(closed, pnl)).alias("total_pnl_sol"),
        F.avg(rois).alias("avg_roi"),
        F.median(rois).alias("median_roi"),
        F.when(F.count(rois) >= 2, F.stddev_pop(rois)).alias("roi_std"),
        F.when(loss > 0, F.coalesce(gain, F.lit(0.0)) / loss).alias("profit_factor"),
        F.bround(F.avg(F.when(closed, F.col("hold_s")))).cast("long").alias("avg_hold_seconds"),
        F.bround(F.median(F.when(closed, F.col("hold_s")))).cast("long").alias("median_hold_seconds"),
        F.avg("bought_sol").alias("avg_position_sol"),
        F.max("bought_sol").alias("max_position_sol"),
        F.bround(F.avg(delay)).cast("long").alias("avg_entry_delay_seconds"),
        since(7).alias("pnl_7d_sol"),
        since(30).alias("pnl_30d_sol"),
    )


def sells_by_episode(positions: DataFrame, trades: DataFrame) -> DataFrame:
    """Sells of each closed episode; a sell on a shared border counts to the earliest episode that holds it."""
    from .timeops import asof_forward

    closed = positions.filter("status = 'closed'").select("wallet", "token", "episode", "opened_us", "closed_us")
    sells = trades.filter("side = 'sell'").select("wallet", "token", "us", "event_id", (F.col("us") - 1).alias("probe"))
    # episodes of a pair follow one another, so the first that closes at or after the sell is the only one that may hold it
    first = asof_forward(sells, closed, ["wallet", "token"], "probe", "closed_us", ["episode", "opened_us", "closed_us"], tie=["episode"])
    return first.filter("opened_us <= us").groupBy("wallet", "token", "episode").agg(F.count(F.lit(1)).alias("n_sells"))


def partial_exits(positions: DataFrame, trades: DataFrame) -> DataFrame:
    """``partial_exit_ratio``: closed positions with more than one sell."""
    closed = positions.filter("status = 'closed'").select("wallet", "token", "episode")
    n = closed.join(sells_by_episode(positions, trades), ["wallet", "token", "episode"], "left")
    return n.groupBy("wallet").agg((F.count_if(F.col("n_sells") > 1) / F.count(F.lit(1))).alias("partial_exit_ratio"))


def wallet_metrics(trades: DataFrame, positions: DataFrame, tokens: DataFrame, now: int) -> DataFrame:
    """All wallets' metrics in one plan: one aggregate an input, joined on the wallet."""
    t = trade_stats(trades)
    out = t.join(position_stats(positions, tokens, now), "wallet", "left")
    out = out.join(max_drawdown(positions.filter("status = 'closed'")), "wallet", "left").join(partial_exits(positions, trades), "wallet", "left")
    days = F.greatest((F.col("last_us") - F.col("first_us")) / 86400e6, F.lit(1.0))
    return out.withColumn("trades_per_day", F.bround(F.col("trade_count") / days, 4))


def confidence(stats: DataFrame) -> DataFrame:
    """``stats`` with ``confidence_score`` (0 to 100) and its ``components``, shrunk to the prior by the number of closed positions."""
    n = F.greatest(F.coalesce("closed_position_count", F.lit(0)), F.lit(0)).cast("double")
    w = F.least(F.greatest(F.coalesce("win_count", F.lit(0)).cast("double"), F.lit(0.0)), n)
    x = F.col("pnl_30d_sol")
    values = {
        "win_rate": F.least(F.greatest((w + 3.5) / (n + 10) / 0.7, F.lit(0.0)), F.lit(1.0)),
        "profitability": F.when(F.col("profit_factor").isNotNull(), F.col("profit_factor") / (F.col("profit_factor") + 1)).when(w > 0, 0.9).otherwise(0.5),
        "consistency": F.when(F.col("roi_std").isNotNull() & (n >= 3), 1 / (1 + F.col("roi_std"))).otherwise(0.5),
        "recency": F.coalesce(0.5 * (1 + x / (F.abs(x) + 1)), F.lit(0.5)),
        "experience": n / (n + 20),
    }
    parts = [F.struct(F.lit(k).alias("component"), F.round(v, 4).alias("value"), F.lit(WEIGHTS[k]).alias("weight"), F.round(F.round(v, 4) * WEIGHTS[k], 6).alias("contribution")) for k, v in values.items()]
    raw = sum((F.round(v, 4) * WEIGHTS[k] for k, v in values.items()), F.lit(0.0))
    score = F.least(F.greatest(PRIOR + (raw - PRIOR) * n / (n + 10), F.lit(0.0)), F.lit(100.0))
    return stats.withColumn("confidence_score", F.round(score, 2)).withColumn("components", F.array(*parts))


def followed(stats: DataFrame, wallets: DataFrame, bar: float = 65.0, most: int = 50) -> DataFrame:
    """All tracked wallets first, then the highest scores at or above the bar, within the budget."""
    joined = wallets.join(stats.select("wallet", "confidence_score"), "wallet", "left").filter(F.col("tracked") | (F.col("confidence_score") >= bar))
    return joined.orderBy(F.desc("tracked"), F.desc_nulls_last("confidence_score"), F.desc("wallet")).limit(most)


#: Metrics that wallets are ranked by.
RANKED_BY = ("confidence_score", "total_pnl_sol", "win_rate", "pnl_30d_sol")


def ranked(wallets: DataFrame, metric: str, least_closed: int = 0, top: int = 50) -> DataFrame:
    """The ``top`` wallets by a metric, those without it left out: ``wallets`` with ``metric`` and ``value``."""
    if metric not in RANKED_BY:
        raise ValueError(f"metric must be one of {', '.join(RANKED_BY)}")
    known = wallets.filter(F.col(metric).isNotNull() & (F.coalesce("closed_position_count", F.lit(0)) >= least_closed))
    return known.withColumn("metric", F.lit(metric)).withColumn("value", F.round(metric, 6)).orderBy(F.desc("value"), "wallet").limit(top)
