"""Wallet vetting: repeated casts, shared funders, insider share, verdicts, and the funding trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sharing import cast
from .timeops import latest_per_key

#: Wallets of a funder in one list, in the mean.
PEERS = 1000


def recent_tokens(trades: DataFrame, rows: int = 20) -> DataFrame:
    """The wallet's most recently traded tokens: (wallet, token)."""
    last = trades.groupBy("wallet", "token").agg(F.max("us").alias("last_us"))
    return latest_per_key(last, ["wallet"], [F.desc("last_us"), F.col("token")], rows).select("wallet", "token")


def counterparty_signal(trades: DataFrame, least: int = 4, ratio: float = 0.6, rows: int = 20) -> DataFrame:
    """Tokens on which at least two recurring co-wallets stand, and their share; mean co-traders of a token.

    A recurring co-wallet trades on ``least`` or more of the wallet's recent tokens.
    """
    mine = recent_tokens(trades, rows)
    on = trades.select("wallet", "token").distinct()
    by = cast(mine, on, least).groupBy("wallet").agg(F.count_if(F.col("token").isNotNull() & (F.col("n") >= 2)).alias("repeat_tokens"), F.max(F.when(F.col("token").isNull(), F.col("n"))).alias("recurring"))
    traders = on.groupBy("token").agg((F.count(F.lit(1)) - 1).alias("others"))
    n = mine.join(traders, "token").groupBy("wallet").agg(F.count(F.lit(1)).alias("tokens"), F.avg("others").alias("avg_co_traders"))
    out = n.join(by, "wallet", "left").fillna(0, ["repeat_tokens", "recurring"])
    out = out.withColumn("cast_ratio", F.col("repeat_tokens") / F.col("tokens"))
    return out.withColumn("ring", (F.col("tokens") >= least) & (F.col("cast_ratio") >= ratio))


def shared_funder(vettings: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates whose latest vetting names a funder that isn't an exchange: (wallet, funder, peers: how many other candidates share it), and the peers themselves.

    The peers come as (funder, part, wallets): a funder's candidates once, in sorted lists of ``PEERS`` at most, not once a
    wallet, so what is named grows with the candidates and no list with a funder.
    """
    latest = latest_per_key(vettings, ["wallet"], [F.desc("ts"), F.desc("id")]).filter("funder is not null and funder_kind <> 'cex'")
    known = latest.join(candidates.select("wallet"), "wallet", "left_semi").select("wallet", "funder")
    size = known.groupBy("funder").agg(F.count(F.lit(1)).alias("n"))
    sized = known.join(size, "funder")
    part = F.pmod(F.xxhash64("wallet"), F.ceil(F.col("n") / PEERS)).cast("int").alias("part")
    named = sized.groupBy("funder", part).agg(F.array_sort(F.collect_list("wallet")).alias("wallets"))
    return sized.select("wallet", "funder", (F.col("n") - 1).alias("peers")), named


def insider_share(positions: DataFrame, tokens: DataFrame, funders: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """Profitable closed positions on tokens that the wallet or its funder created."""
    won = positions.filter("status = 'closed' and pnl > 0").select("wallet", "token")
    j = won.join(tokens.select("token", "creator"), "token").join(funders.select("wallet", "funder"), "wallet", "left")
    own = F.coalesce((F.col("creator") == F.col("wallet")) | (F.col("creator") == F.col("funder")), F.col("creator") == F.col("wallet"), F.lit(False))
    s = j.groupBy("wallet").agg(F.count(F.lit(1)).alias("won"), F.count_if(own).alias("inside"))
    return s.withColumn("insider_share", F.col("inside") / F.col("won")).withColumn("insider", (F.col("inside") >= least) & (F.col("insider_share") >= share))


def verdicts(signals: DataFrame) -> DataFrame:
    """Any reason: suspicious; no conclusive funding and few tokens: inconclusive; else clear. Columns: ring, peers, insider, funder, tokens."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reasons = F.array_compact(F.array(F.when(yes("ring"), "repeat_cast"), F.when(F.coalesce("peers", F.lit(0)) > 0, "shared_funder"), F.when(yes("insider"), "insider")))
    out = signals.withColumn("reasons", reasons)
    thin = F.col("funder").isNull() & (F.coalesce("tokens", F.lit(0)) < 4)
    return out.withColumn("verdict", F.when(F.size("reasons") > 0, "suspicious").when(thin, "inconclusive").otherwise("clear"))


def candidates(wallets: DataFrame, scores: DataFrame, vettings: DataFrame, bar: float, stale_us: int, most: int) -> DataFrame:
    """Tracked wallets and those near the bar, without a recent vetting; tracked first, then by score, unknown scores last."""
    c = wallets.join(scores, "wallet", "left").filter(F.col("tracked") | (F.col("confidence_score") >= bar - 15))
    c = c.join(vettings.filter(F.col("ts") >= stale_us).select("wallet"), "wallet", "left_anti")
    return c.orderBy(F.desc("tracked"), F.desc_nulls_last("confidence_score"), "wallet").limit(most)


def trace_funders(transfers: DataFrame, exchanges: DataFrame, depth: int = 3) -> DataFrame:
    """The payer of the first incoming native transfer within a wallet's ``depth`` earliest transactions.

    ``transfers``: (wallet, slot, signature, funder or null, history_complete).
    """
    w = Window.partitionBy("wallet").orderBy("slot", "signature")
    first = transfers.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= depth)
    f = first.groupBy("wallet").agg(F.min_by("funder", F.when(F.col("funder").isNotNull(), F.struct("slot", "signature"))).alias("funder"), F.min("history_complete").alias("complete"))
    f = f.withColumn("funder", F.when(F.col("complete"), F.col("funder")))
    kind = f.join(F.broadcast(exchanges.select(F.col("address").alias("funder"), F.lit(True).alias("_cex"))), "funder", "left")
    return kind.select("wallet", "funder", F.when(F.col("_cex"), "cex").when(F.col("funder").isNotNull(), "wallet").otherwise("inconclusive").alias("funder_kind"))
