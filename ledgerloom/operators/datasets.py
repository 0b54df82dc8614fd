"""Leak-free training sets, walk-forward training, champion promotion and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import VENUES, cyclic_hour, one_hot, venue_name
from ..sources.bindings import DAY, HOUR
from .timeops import asof_backward, asof_forward

TRADE_FEATURES = ["size", "age_s", "wallet_trades", "wallet_win_rate", "hour_sin", "hour_cos", *[f"is_{v}" for v in VENUES]]


def trade_profit(trades: DataFrame, closed: DataFrame, history: DataFrame, tokens: DataFrame, now: int, window: int = 90 * DAY, horizon: int = DAY) -> DataFrame:
    """WSOL buys with the sign of their earliest close within the horizon, and features from snapshots at or before them.

    ``history``: (wallet, ts, wallet_trades, wallet_win_rate), one row a snapshot.
    """
    buys = trades.filter((F.col("side") == "buy") & (F.col("quote_kind") == "wsol") & (F.col("us") >= now - window)).select("event_id", "us", "wallet", "token", "quote", "venue")
    labelled = asof_forward(buys, closed, ["wallet", "token"], "us", "closed_us", ["closed_us", "pnl"], horizon=horizon, tie=["episode"], prefix="real_").filter("real_closed_us is not null")
    seen = asof_backward(labelled, history, ["wallet"], "us", "ts", ["wallet_trades", "wallet_win_rate"])
    aged = seen.join(tokens.select("token", "first_seen"), "token", "left")
    minute = F.floor(F.pmod(F.col("us"), F.lit(DAY)) / (HOUR // 60))
    s, c = cyclic_hour(F.floor(minute / 60), minute % 60)
    return aged.select(
        "event_id", "us", (F.coalesce("real_pnl", F.lit(0.0)) > 0).cast("int").alias("label"), F.col("quote").alias("size"), ((F.col("us") - F.col("first_seen")) / 1e6).alias("age_s"),
        "wallet_trades", "wallet_win_rate", s.alias("hour_sin"), c.alias("hour_cos"), *one_hot(venue_name(F.col("venue")), VENUES),
    )


def wallet_persistence(history: DataFrame, gap: int = 25 * DAY) -> DataFrame:
    """Pairs of a snapshot and the first at least ``gap`` later; a pair whose later PnL is unknown is dropped, not replaced."""
    left = history.withColumn("probe", F.col("ts") + gap - 1)
    got = asof_forward(left, history, ["wallet"], "probe", "ts", ["ts", "pnl"], prefix="later_")
    return got.filter("later_pnl is not null").withColumn("label", (F.col("later_pnl") > 0).cast("int")).drop("probe")


def stats_history(trades: DataFrame, width: int = DAY) -> DataFrame:
    """Daily snapshots of each wallet, stamped with the day's end: trades so far, and the share of buys so far as a stand-in for its record."""
    daily = trades.groupBy("wallet", ((F.floor(F.col("us") / width) + 1) * width).alias("ts")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == "buy").alias("b"), F.sum(F.when(F.col("side") == "sell", F.col("quote")).otherwise(-F.col("quote")).cast("decimal(18,2)")).cast("double").alias("pnl"))
    w = Window.partitionBy("wallet").orderBy("ts")
    return daily.select("wallet", "ts", "pnl", F.sum("n").over(w).alias("wallet_trades"), (F.sum("b").over(w) / F.sum("n").over(w)).alias("wallet_win_rate"))


def time_slices(data: DataFrame, order: str = "us", shares: tuple[float, float] = (0.70, 0.85)) -> DataFrame:
    """``slice`` 0, 1, 2 by time cut-points, found as approximate quantiles of the time, so no global sort numbers the rows."""
    cuts = data.agg(F.percentile_approx(order, F.array(*[F.lit(s) for s in shares]), 100_000).alias("cuts"))
    t = F.col(order)
    return data.crossJoin(F.broadcast(cuts)).withColumn("slice", F.when(t <= F.get("cuts", F.lit(0)), 0).when(t <= F.get("cuts", F.lit(1)), 1).otherwise(2)).drop("cuts")


def walk_forward(data: DataFrame, features: list[str], least: int = 500, seed: int = 42, rounds: int = 20) -> dict:
    """Train on the oldest slice, calibrate on the middle one, measure on the newest. Returns model, calibrator, metrics and the time that training and calibration reach to; ``refused`` with a reason if it can't."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    from .evaluation import auc

    parts = time_slices(data).cache()
    classes = parts.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("k"), F.max("us").alias("until")).collect()
    total = sum(r.n for r in classes)
    if total < least or len(classes) < 3 or any(r.k < 2 for r in classes):
        parts.unpersist()
        return {"refused": f"{total} rows, classes by slice {sorted((r.slice, r.k) for r in classes)}"}
    used = [f for f in features if f in data.columns]
    stages = [Imputer(inputCols=used, outputCols=[f"{f}_i" for f in used]), VectorAssembler(inputCols=[f"{f}_i" for f in used], outputCol="v"), GBTClassifier(labelCol="label", featuresCol="v", maxIter=rounds, maxDepth=3, seed=seed)]
    model = Pipeline(stages=stages).fit(parts.filter("slice = 0"))
    raw = lambda k: model.transform(parts.filter(F.col("slice") == k)).withColumn("raw", F.get(vector_to_array("probability"), F.lit(1)))
    iso = IsotonicRegression(labelCol="label", featuresCol="raw", predictionCol="prob").fit(raw(1))
    tested = iso.transform(raw(2)).select(F.lit("m").alias("model"), "label", F.least(F.greatest("prob", F.lit(0.0)), F.lit(1.0)).alias("prob"))
    m = tested.agg(F.avg(F.pow(F.col("prob") - F.col("label"), 2)).alias("brier"), F.avg("label").alias("base_rate"), F.count(F.lit(1)).alias("n")).first()
    score = auc(tested).first().auc
    parts.unpersist()
    return {"model": model, "calibrator": iso, "features": used, "auc": score, "brier": m.brier, "base_rate": m.base_rate, "n": m.n, "until": max(r.until for r in classes if r.slice < 2)}


def promote(registry: DataFrame) -> DataFrame:
    """Registry rows (version, auc) in order: a version becomes active if none is, or its AUC is strictly better than the active one's, or the active one has none; a missing metric never replaces one."""
    w = Window.orderBy("version").rowsBetween(Window.unboundedPreceding, -1)  # a row a trained model
    best = F.max("auc").over(w)
    first = F.row_number().over(Window.orderBy("version")) == 1
    # the active one's metric is the best so far: a better one was always promoted, one without a metric never
    took = first | (F.col("auc").isNotNull() & (best.isNull() | (F.col("auc") > best)))
    marked = registry.withColumn("promoted", took)
    last = marked.agg(F.max(F.when(F.col("promoted"), F.col("version"))).alias("active"))
    return marked.crossJoin(last).withColumn("is_active", F.col("version") == F.col("active")).drop("active")


def score(rows: DataFrame, trained: dict) -> DataFrame:
    """Probabilities of the active model, with each row's features kept as JSON."""
    from pyspark.ml.functions import vector_to_array

    missing = [f for f in trained["features"] if f not in rows.columns]
    if missing:
        raise ValueError(f"features missing: {missing}")
    raw = trained["model"].transform(rows).withColumn("raw", F.get(vector_to_array("probability"), F.lit(1)))
    out = trained["calibrator"].transform(raw)
    return out.select(*rows.columns, F.least(F.greatest("prob", F.lit(0.0)), F.lit(1.0)).alias("p_profit"), F.to_json(F.struct(*trained["features"])).alias("context"))
