"""Trading styles: features, rule labels, clusters, and how styles perform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import log_feature
from ..sources.tables import written
from .quantiles import percentiles

FEATURES = ["f_hold", "f_delay", "f_size", "f_per_day", "f_partial", "f_roi"]


def raw_features(stats: DataFrame, min_closed: int = 3) -> DataFrame:
    eligible = stats.filter(F.col("closed_position_count") >= min_closed)
    return eligible.select(
        "wallet",
        log_feature(F.col("median_hold_seconds").cast("double")).alias("f_hold"),
        log_feature(F.col("avg_entry_delay_seconds").cast("double")).alias("f_delay"),
        log_feature(F.col("avg_position_sol")).alias("f_size"),
        log_feature(F.col("trades_per_day")).alias("f_per_day"),
        F.col("partial_exit_ratio").alias("f_partial"),
        F.col("avg_roi").alias("f_roi"),
    )


def impute(features: DataFrame) -> DataFrame:
    """Nulls become the column's median (0 if all are null); ``heavy`` where both holding time and delay were unknown."""
    features = written(features, "features")  # both uses read it; what it comes from is worked out once
    values = features.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])).alias("f")).select("f.*")
    half = percentiles(values, "value", [0.5], ["feature"]).select("feature", F.get("percentiles", F.lit(0)).alias("m"))
    medians = half.agg(*[F.coalesce(F.max(F.when(F.col("feature") == f, F.col("m"))), F.lit(0.0)).alias(f"m_{f}") for f in FEATURES])
    joined = features.crossJoin(F.broadcast(medians))
    heavy = F.col("f_hold").isNull() & F.col("f_delay").isNull()
    return joined.select("wallet", *[F.coalesce(f, f"m_{f}").alias(f) for f in FEATURES], heavy.alias("heavy"))


def style_rule(hold: Column, delay: Column, partial: Column) -> Column:
    """First matching rule; arguments in seconds and as a share."""
    return (
        F.when(delay < 120, "sniper")
        .when(hold < 900, "scalper")
        .when((hold < 4 * 3600) & (delay < 3600), "momentum")
        .when((hold < 7 * 86400) & (partial > 0.5), "accumulator")
        .when(hold < 7 * 86400, "swing")
        .when(partial > 0.5, "accumulator")
        .otherwise("holder")
    )


def rule_styles(features: DataFrame) -> DataFrame:
    style = style_rule(F.expm1("f_hold"), F.expm1("f_delay"), F.col("f_partial"))
    return features.select("wallet", style.alias("style"), F.when(F.col("heavy"), 0.3).otherwise(1.0).alias("style_confidence"))


def cluster_styles(features: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """KMeans over standardised features; clusters take the rule name of their centre."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    features = written(features, "styles")  # each of the fits below passes over it several times
    n = features.count()
    k = min(max(2, min(k, n // 10)), n)
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="v"), StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=True), KMeans(k=k, seed=seed, featuresCol="z", predictionCol="cluster")]).fit(features)
    scaler, means = model.stages[1], model.stages[2]
    spark = features.sparkSession
    centres = [[float(c[i] * scaler.std[i] + scaler.mean[i]) for i in range(len(FEATURES))] for c in means.clusterCenters()]
    rows = [(j, [float(x) for x in z], *c) for j, (z, c) in enumerate(zip(means.clusterCenters(), centres))]
    table = spark.createDataFrame(rows, "cluster int, centre array<double>, " + ", ".join(f"c_{f} double" for f in FEATURES))
    named = table.withColumn("style", style_rule(F.expm1("c_f_hold"), F.expm1("c_f_delay"), F.col("c_f_partial")))
    from ..functions.money import dedupe_names

    named = dedupe_names(named, "style", "cluster")
    put = model.transform(features).withColumn("z", vector_to_array("z"))
    gap = F.sqrt(F.aggregate(F.zip_with("z", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    return put.join(F.broadcast(named.select("cluster", "centre", "style")), "cluster").select("wallet", "cluster", "style", (1 / (1 + gap)).alias("style_confidence"))


def style_stats(styles: DataFrame, positions: DataFrame, start: int) -> DataFrame:
    """Performance of each style over closed positions since ``start``; a style without any still has its row."""
    closed = positions.filter((F.col("status") == "closed") & (F.col("closed_us") >= start)).select("wallet", "pnl", "roi", "hold_s")
    joined = styles.select("wallet", "style").join(closed, "wallet", "left")
    gain, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")))
    return joined.groupBy("style").agg(
        F.count_distinct("wallet").alias("wallets"),
        F.count("pnl").alias("positions"),
        F.try_divide(F.count_if(F.col("pnl") > 0), F.count("pnl")).alias("win_rate"),
        F.avg("roi").alias("avg_roi"),
        F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_pnl"),
        F.when(loss > 0, F.coalesce(gain, F.lit(0.0)) / loss).alias("profit_factor"),
        F.floor(F.avg("hold_s")).alias("avg_hold_s"),
    )
