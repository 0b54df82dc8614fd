"""Pattern findings over closed positions: hours, delays, sizes, holding times, whale flow, volume trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import ENTRY_DELAY, HOLD_TIME, bucket_label
from ..sources.bindings import HOUR
from .quantiles import percentiles

FINDING = ["kind", "key", "n", "win_rate", "avg_roi", "overall_win_rate", "description"]


def win() -> Column:
    return F.when(F.col("roi").isNotNull(), F.col("roi") > 0).otherwise(F.coalesce("pnl", F.lit(0.0)) > 0)


def group_stats() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.avg(win().cast("double")).alias("win_rate"), F.avg("roi").alias("avg_roi")]


def closed_in_window(positions: DataFrame, start: int) -> DataFrame:
    return positions.filter((F.col("status") == "closed") & (F.col("closed_us") >= start))


def _findings(closed: DataFrame, label: Column, kind: str, min_evidence: int, text: str) -> DataFrame:
    overall = closed.agg(F.avg(win().cast("double")).alias("overall_win_rate"))
    groups = closed.withColumn("key", label).groupBy("key").agg(*group_stats()).filter((F.col("n") >= min_evidence) & F.col("key").isNotNull())
    out = groups.crossJoin(F.broadcast(overall)).withColumn("kind", F.lit(kind))
    note = F.format_string(text + " %s: won %.1f%% over %d positions (overall %.1f%%)", F.col("key"), F.col("win_rate") * 100, F.col("n"), F.col("overall_win_rate") * 100)
    return out.withColumn("description", note).select(*FINDING)


def hour_of_day(closed: DataFrame, min_evidence: int = 30) -> DataFrame:
    hour = F.floor(F.pmod(F.col("opened_us"), F.lit(24 * HOUR)) / HOUR)
    return _findings(closed, F.lpad(hour.cast("string"), 2, "0"), "hour_of_day", min_evidence, "hour")


def entry_delay(closed: DataFrame, tokens: DataFrame, min_evidence: int = 30) -> DataFrame:
    seen = closed.join(tokens.select("token", "first_seen"), "token")
    delay = F.greatest((F.col("opened_us") - F.col("first_seen")) / 1e6, F.lit(0.0))
    return _findings(seen, bucket_label(delay, ENTRY_DELAY), "entry_delay", min_evidence, "entry delay")


def hold_time(closed: DataFrame, min_evidence: int = 30) -> DataFrame:
    return _findings(closed.filter("hold_s is not null"), bucket_label(F.col("hold_s"), HOLD_TIME), "hold_time", min_evidence, "hold time")


def size_edges(closed: DataFrame) -> DataFrame:
    return percentiles(closed, "bought_sol", [p / 5 for p in range(6)]).select(F.col("percentiles").alias("edges"))


def position_size(closed: DataFrame, min_evidence: int = 30) -> DataFrame:
    """Quintiles of the size by interpolated edges: each holds its lower edge, the last its upper one too."""
    sized = closed.filter("bought_sol is not null").crossJoin(F.broadcast(size_edges(closed)))
    e = lambda i: F.get("edges", F.lit(i))
    x = F.col("bought_sol")
    label = F.when(x < e(1), "q1").when(x < e(2), "q2").when(x < e(3), "q3").when(x < e(4), "q4").otherwise("q5")
    return _findings(sized, label, "position_size", min_evidence, "size quintile")


def whales(closed: DataFrame, decile: float = 0.9, min_wallets: int = 10) -> DataFrame:
    """Wallets whose mean position reaches the population's upper decile."""
    mean = closed.groupBy("wallet").agg(F.avg(F.coalesce("bought_sol", F.lit(0.0))).alias("avg_size"))
    bar = percentiles(mean, "avg_size", [decile]).select(F.get("percentiles", F.lit(0)).alias("threshold"), "population")
    return mean.crossJoin(F.broadcast(bar)).filter((F.col("population") >= min_wallets) & (F.col("avg_size") >= F.col("threshold"))).select("wallet", "avg_size", "threshold")


def net_flow(trades: DataFrame, keys: list[str]) -> DataFrame:
    signed = F.when(F.col("side") == "buy", F.col("quote")).otherwise(-F.col("quote")).cast("decimal(18,2)")
    return trades.groupBy(*keys).agg(F.sum(signed).cast("double").alias("net_flow"), F.count(F.lit(1)).alias("n"))


def whale_flow(closed: DataFrame, trades: DataFrame, now: int, hours: int = 24, top: int = 10, min_evidence: int = 30) -> DataFrame:
    """Net flow of whales into each token; the cut to the largest comes before the evidence filter."""
    recent = trades.filter((F.col("quote_kind") == "wsol") & (F.col("us") >= now - hours * HOUR))
    flow = net_flow(recent.join(whales(closed).select("wallet"), "wallet", "left_semi"), ["token"])
    return flow.orderBy(F.desc(F.abs("net_flow")), "token").limit(top).filter(F.col("n") >= min_evidence)


def volume_trend(snapshots: DataFrame, start: int, last: int = 3) -> DataFrame:
    """Tokens whose last ``last`` snapshots' volumes are known and strictly rise."""
    w = Window.partitionBy("token").orderBy(F.desc("ts"))
    tail = snapshots.filter(F.col("ts") >= start).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last)
    path = F.transform(F.array_sort(F.collect_list(F.struct("ts", "volume_1h"))), lambda s: s["volume_1h"])
    grouped = tail.groupBy("token").agg(path.alias("path"), F.count("volume_1h").alias("known"))
    rising = F.forall(F.sequence(F.lit(1), F.lit(last - 1)), lambda i: F.get("path", i - 1) < F.get("path", i))
    return grouped.filter((F.col("known") == last) & rising).select("token", "path")


def all_findings(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
