"""Reports: ten sections of small top lists, one row an item, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = ["section", "place", "item", "value"]


def section(name: str, df: DataFrame, item: Column, value: Column, order: list[Column], top: int = 10) -> DataFrame:
    """The first ``top`` rows as a section's items."""
    best = df.orderBy(*order).limit(top)
    place = F.row_number().over(Window.orderBy(*order))  # over the rows already cut
    return best.select(F.lit(name).alias("section"), place.alias("place"), item.cast("string").alias("item"), value.cast("double").alias("value"))


def build(stats: DataFrame, risk: DataFrame, styles: DataFrame, models: DataFrame, mistakes: DataFrame, market: DataFrame, top: int = 10) -> DataFrame:
    """All items: ``stats`` (wallet, total_pnl_sol, roi_std, closed_position_count), ``risk`` (token, score), ``styles`` (style, delta), ``models`` (model, auc, brier, gain), ``mistakes`` (id, brier), ``market`` (one row: regime, pct_change)."""
    known = stats.filter("total_pnl_sol is not null")
    steady = stats.filter("roi_std is not null and closed_position_count >= 5")
    parts = [
        section("best_wallets", known, F.col("wallet"), F.col("total_pnl_sol"), [F.desc("total_pnl_sol"), F.col("wallet")], top),
        section("worst_wallets", known, F.col("wallet"), F.col("total_pnl_sol"), [F.col("total_pnl_sol"), F.col("wallet")], top),
        section("highest_risk", risk, F.col("token"), F.col("score"), [F.desc("score"), F.col("token")], top),
        section("most_consistent", steady, F.col("wallet"), F.col("roi_std"), [F.col("roi_std"), F.col("wallet")], top),
        section("rising_styles", styles.filter("delta > 0"), F.col("style"), F.col("delta"), [F.desc("delta"), F.col("style")], top),
        section("declining_styles", styles.filter("delta < 0"), F.col("style"), F.col("delta"), [F.col("delta"), F.col("style")], top),
        section("accuracy", models, F.col("model"), F.col("auc"), [F.desc("auc"), F.col("model")], top),
        section("mistakes", mistakes, F.col("id"), F.col("brier"), [F.desc("brier"), F.col("id")], top),
        section("improvements", models.filter("gain > 0"), F.col("model"), F.col("gain"), [F.desc("gain"), F.col("model")], top),
        section("market", market, F.col("regime"), F.col("pct_change"), [F.col("regime")], top),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def conclusions(items: DataFrame, names: list[str]) -> DataFrame:
    """A row for each section: its items in order and a sentence; a section without items says so."""
    every = items.sparkSession.createDataFrame([(n,) for n in names], "section string")
    got = items.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("place", "item", "value"))).alias("items"))
    j = every.join(got, "section", "left")
    first = F.get("items", F.lit(0))
    text = F.when(F.col("items").isNull(), "insufficient data").otherwise(F.format_string("%s leads %s with %.4f", first["item"], F.col("section"), first["value"]))
    return j.select("section", text.alias("conclusion"), F.coalesce(F.size("items"), F.lit(0)).alias("evidence"), "items")


def markdown(sections: DataFrame) -> DataFrame:
    line = F.transform(F.coalesce("items", F.expr("cast(array() as array<struct<place:int,item:string,value:double>>)")), lambda x: F.format_string("- %s: %.4f", x["item"], x["value"]))
    return sections.select("section", F.concat_ws("\n", F.concat(F.lit("## "), "section"), F.col("conclusion"), F.array_join(line, "\n")).alias("body"))


def style_trends(history: DataFrame) -> DataFrame:
    """Latest value of a style less the mean of all before it: (style, delta); ``history``: (style, ts, value)."""
    n = F.row_number().over(Window.partitionBy("style").orderBy(F.desc("ts")))
    r = history.withColumn("_n", n).groupBy("style").agg(F.max(F.when(F.col("_n") == 1, F.col("value"))).alias("latest"), F.avg(F.when(F.col("_n") > 1, F.col("value"))).alias("mean"))
    return r.filter("mean is not null").select("style", (F.col("latest") - F.col("mean")).alias("delta"))


def improvements(history: DataFrame) -> DataFrame:
    """Latest AUC of a model less the one before: (model, auc, gain)."""
    w = Window.partitionBy("model").orderBy("ts")
    d = history.withColumn("gain", F.col("auc") - F.lag("auc").over(w)).withColumn("_n", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("ts"))))
    return d.filter("_n = 1").select("model", "auc", "gain")


def due(reports: DataFrame, now: int, kind: str, unit: str) -> Column:
    """Is there no report of this kind in the current UTC day or ISO week?"""
    at = F.date_trunc(unit, F.timestamp_micros(F.lit(now)))
    return reports.filter((F.col("kind") == kind) & (F.date_trunc(unit, F.timestamp_micros("ts")) == at)).agg((F.count(F.lit(1)) == 0).alias("due"))
