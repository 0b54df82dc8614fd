"""Point-in-time snapshots of tokens, the market and wallets, and holder tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bindings import HOUR
from .timeops import latest_per_key


def token_snapshot(trades: DataFrame, tokens: DataFrame, now: int, sol_price: float, active: int | None = None, pools: DataFrame | None = None, holders: DataFrame | None = None) -> DataFrame:
    """Prices, VWAP, volumes, trades, buyers, market cap, liquidity and holders of tokens with trades in the last day; counts take all quotes, volumes only WSOL.

    Liquidity is the deepest of ``pools`` (token, pool, sol) and the count comes from ``holders`` (token, holders); null where neither knows the token.
    """
    m5, h1, h24 = (F.col("us") >= now - w for w in (HOUR // 12, HOUR, 24 * HOUR))
    wsol = F.col("quote_kind") == "wsol"
    vol = lambda inside: F.coalesce(F.sum(F.when(inside & wsol, F.col("quote"))), F.lit(0.0))
    recent = trades.filter((F.col("us") >= now - 24 * HOUR) & (F.col("us") <= now))
    s = recent.groupBy("token").agg(
        F.max_by(F.when(wsol, F.col("quote") / F.col("amount")), F.when(wsol, F.struct("us", "event_id"))).alias("price"),
        F.try_divide(F.sum(F.when(m5 & wsol, F.col("quote"))), F.sum(F.when(m5 & wsol, F.col("amount")))).alias("vwap_5m"),
        vol(m5).alias("volume_5m"), vol(h1).alias("volume_1h"), vol(h24).alias("volume_24h"),
        F.count_if(m5).alias("trades_5m"), F.count_if(h1).alias("trades_1h"),
        F.count_distinct(F.when(m5 & (F.col("side") == "buy"), F.col("wallet"))).alias("buyers_5m"),
        F.count(F.lit(1)).alias("trades_24h"),
    )
    if active:
        s = s.orderBy(F.desc("trades_24h"), "token").limit(active)
    out = s.join(tokens.select("token", "supply"), "token", "left").withColumn("price_usd", F.col("price") * sol_price)
    out = out.withColumn("market_cap_usd", F.col("price_usd") * F.col("supply")).drop("supply")
    out = out.join(deepest_pool(pools).select("token", "liquidity"), "token", "left") if pools is not None else out.withColumn("liquidity", F.lit(None).cast("double"))
    return out.join(holders.select("token", "holders"), "token", "left") if holders is not None else out.withColumn("holders", F.lit(None).cast("long"))


def hourly_grid(trades: DataFrame, width: int = HOUR) -> DataFrame:
    """Snapshots on a fixed grid: a row for each token and window with trades, stamped with the window's end."""
    wsol = F.when(F.col("quote_kind") == "wsol", F.col("quote"))
    g = trades.groupBy("token", ((F.floor(F.col("us") / width) + 1) * width).alias("ts")).agg(
        F.max_by(F.col("quote") / F.col("amount"), F.struct("us", "event_id")).alias("price"),
        F.coalesce(F.sum(wsol), F.lit(0.0)).alias("volume_1h"), F.count(F.lit(1)).alias("trades_1h"), F.count_distinct("wallet").alias("wallets_1h"),
    )
    return g.withColumn("liquidity", F.col("volume_1h"))


def market_grid(trades: DataFrame, tokens: DataFrame, failed: DataFrame, width: int = HOUR) -> DataFrame:
    """Market rows on the same grid: mean price, volume, trades, active wallets, launches, failures."""
    stamp = lambda c: ((F.floor(F.col(c) / width) + 1) * width).alias("ts")
    t = trades.groupBy(stamp("us")).agg(
        F.avg("quote").alias("price"), F.coalesce(F.sum(F.when(F.col("quote_kind") == "wsol", F.col("quote"))), F.lit(0.0)).alias("volume_1h"),
        F.count(F.lit(1)).alias("trades_1h"), F.count_distinct("wallet").alias("wallets_1h"),
    )
    launched = tokens.groupBy(stamp("first_seen")).agg(F.count(F.lit(1)).alias("launched_1h"))
    lost = failed.groupBy(stamp("us")).agg(F.count(F.lit(1)).alias("failed_1h"))
    out = t.join(launched, "ts", "full").join(lost, "ts", "full")
    return out.fillna(0, ["trades_1h", "launched_1h", "failed_1h", "wallets_1h"])


def market_snapshot(trades: DataFrame, tokens: DataFrame, failed: DataFrame, now: int) -> DataFrame:
    """One row of the last hour's totals."""
    inside = lambda df, c: df.filter((F.col(c) >= now - HOUR) & (F.col(c) <= now))
    t = inside(trades, "us").agg(F.count(F.lit(1)).alias("trades_1h"), F.coalesce(F.sum(F.when(F.col("quote_kind") == "wsol", F.col("quote"))), F.lit(0.0)).alias("volume_1h"), F.count_distinct("wallet").alias("wallets_1h"))
    return t.crossJoin(inside(tokens, "first_seen").agg(F.count(F.lit(1)).alias("launched_1h"))).crossJoin(inside(failed, "us").agg(F.count(F.lit(1)).alias("failed_1h")))


def wallet_snapshot(wallets: DataFrame, balances: DataFrame, positions: DataFrame, since: int, most: int | None = None) -> DataFrame:
    """Balance (0 without an account) and open positions of wallets seen since the watermark."""
    seen = wallets.filter(F.col("last_seen") >= since)
    if most:
        seen = seen.orderBy(F.desc("last_seen"), "wallet").limit(most)
    n = positions.filter("status = 'open'").groupBy("wallet").agg(F.count(F.lit(1)).alias("open_positions"))
    return seen.join(balances, "wallet", "left").join(n, "wallet", "left").select("wallet", F.coalesce("balance", F.lit(0.0)).alias("balance"), F.coalesce("open_positions", F.lit(0)).alias("open_positions"))


def holder_concentration(accounts: DataFrame, vaults: DataFrame, supply: DataFrame, top: int = 10) -> DataFrame:
    """Share of supply that the ``top`` accounts hold, pool vaults left out, and the number of holders. ``accounts``: (mint, owner, amount)."""
    held = accounts.join(vaults.select("owner"), "owner", "left_anti").filter("amount > 0")
    n = held.groupBy("mint").agg(F.count(F.lit(1)).alias("holders"))
    best = latest_per_key(held, ["mint"], [F.desc("amount"), F.col("owner")], top).groupBy("mint").agg(F.sum("amount").alias("top_amount"))
    return n.join(best, "mint").join(supply, "mint", "left").select("mint", "holders", F.try_divide("top_amount", "supply").alias("top_share"))


def lp_burned(accounts: DataFrame, burn_owners: list) -> DataFrame:
    """Share of LP supply sent to burn owners and the largest other holder's share."""
    burnt = F.col("owner").isin(*burn_owners)
    s = accounts.groupBy("mint").agg(F.sum("amount").alias("all"), F.sum(F.when(burnt, F.col("amount")).otherwise(0)).alias("burnt"), F.max(F.when(~burnt, F.col("amount"))).alias("top"))
    return s.select("mint", F.try_divide("burnt", "all").alias("burned_share"), F.try_divide(F.coalesce("top", F.lit(0)), "all").alias("top_share"))


def deepest_pool(pools: DataFrame) -> DataFrame:
    return pools.groupBy("token").agg(F.max("sol").alias("liquidity"), F.max_by("pool", "sol").alias("pool"))


def holder_growth(counts: DataFrame) -> DataFrame:
    """Change of the last two counts of each token."""
    w = Window.partitionBy("token").orderBy("ts")
    d = counts.withColumn("growth", F.col("holders") - F.lag("holders").over(w))
    return latest_per_key(d, ["token"], [F.desc("ts")]).select("token", "growth")
