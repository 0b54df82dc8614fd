"""Prediction outcomes and model performance: calibration, AUC, Brier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bindings import DAY
from .timeops import asof_forward


def resolve_predictions(predictions: DataFrame, resolved: DataFrame, closed: DataFrame, horizon: int = DAY, most: int | None = None) -> DataFrame:
    """Outcomes of unresolved predictions (id, us, wallet, token, prob, predicted_roi) by the earliest close after them within the horizon."""
    due = predictions.join(resolved.select("id"), "id", "left_anti")
    if most:
        due = due.orderBy("us", "id").limit(most)
    got = asof_forward(due, closed, ["wallet", "token"], "us", "closed_us", ["closed_us", "roi", "pnl"], horizon=horizon, tie=["episode"], prefix="real_")
    label = F.when(F.col("real_roi").isNotNull(), F.col("real_roi") > 0).otherwise(F.coalesce("real_pnl", F.lit(0.0)) > 0).cast("int")
    return got.filter("real_closed_us is not null").select(
        "id", "model", "prob", label.alias("label"), F.pow(F.col("prob") - label, 2).alias("brier"), (F.col("predicted_roi") - F.col("real_roi")).alias("roi_error"), F.floor((F.col("real_closed_us") - F.col("us")) / 1_000_000).alias("hold_s")
    )


def bin_of(p: Column, bins: int) -> Column:
    """Equal bins, closed on the right; 0 is in the first."""
    return F.least(F.greatest(F.ceil(p * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")


def calibration(outcomes: DataFrame, bins: int = 10) -> DataFrame:
    """A row for each model and bin, empty bins included."""
    got = outcomes.groupBy("model", bin_of(F.col("prob"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_p"), F.avg("label").alias("mean_label"))
    every = outcomes.select("model").distinct().select("model", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(got, ["model", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def auc(outcomes: DataFrame, key: str = "model") -> DataFrame:
    """Rank-sum AUC with averaged ties, null with one class only. Rows meet by (key, probability), so the window runs over distinct probabilities."""
    by = outcomes.groupBy(key, "prob").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    mid = F.coalesce(F.sum("n").over(w), F.lit(0)) + (F.col("n") + 1) / 2.0
    s = by.withColumn("rank_sum", mid * F.col("pos")).groupBy(key).agg(F.sum("rank_sum").alias("r"), F.sum("pos").alias("p"), (F.sum("n") - F.sum("pos")).alias("q"))
    value = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / F.nullif(F.col("p") * F.col("q"), F.lit(0))
    return s.select(key, value.alias("auc"))


def performance(outcomes: DataFrame, least: int = 20) -> DataFrame:
    """AUC, Brier, accuracy, base rate and mean absolute return error of models with enough outcomes."""
    s = outcomes.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("brier").alias("brier"), F.avg(((F.col("prob") >= 0.5).cast("int") == F.col("label")).cast("double")).alias("accuracy"),
        F.avg("label").alias("base_rate"), F.avg(F.abs("roi_error")).alias("roi_error"),
    )
    return s.filter(F.col("n") >= least).join(auc(outcomes), "model")
