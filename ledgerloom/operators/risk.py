"""Token risk: six components, hard filters, reuse of fresh results, outcomes, and weight tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import clamp, scale
from ..sources.bindings import HOUR
from .timeops import asof_backward, latest_per_key

# The components' base weights.
WEIGHTS = {"authority": 0.20, "holders": 0.20, "lp": 0.15, "deployer": 0.15, "volume": 0.15, "liquidity_age": 0.15}
COMPONENTS = list(WEIGHTS)


def authority(mint: Column, freeze: Column) -> Column:
    """Null is unknown, an empty string is renounced."""
    return F.when(mint != "", 100.0).when(freeze != "", 80.0).when(mint.isNull() | freeze.isNull(), 60.0).otherwise(0.0)


def holders(share: Column) -> Column:
    return F.when(share.isNull(), 50.0).otherwise(100 * scale(share, 0.2, 0.7))


def lp(on_curve: Column, has_lp: Column, burned: Column, top: Column) -> Column:
    return (
        F.when(on_curve, 40.0).when(~has_lp | burned.isNull(), 50.0).when(burned >= 0.9, 0.0)
        .when((top > 0.5) & (burned < 0.5), 90.0).otherwise(100 * (1 - burned))
    )


def deployer(dead: Column, prior: Column) -> Column:
    return F.when(F.coalesce(prior, F.lit(0)) == 0, 30.0).otherwise(100.0 * dead / F.when(prior != 0, prior))


def volume(buyers: Column, buys: Column) -> Column:
    return F.when(F.coalesce(buys, F.lit(0)) < 10, 50.0).otherwise(clamp(140 * (1 - buyers / F.when(buys != 0, buys))))


def liquidity_age(liquidity: Column, age_s: Column) -> Column:
    return 100 * (1 - scale(F.coalesce(liquidity, F.lit(0.0)), 0, 200)) * (1 - scale(age_s, 0, 86400))


def dead_tokens(snapshots: DataFrame) -> DataFrame:
    """(token, dead): latest liquidity of 1 SOL or less, or a price 90 % below its own highest."""
    s = snapshots.groupBy("token").agg(F.max_by("liquidity", "ts").alias("l"), F.max_by("price", "ts").alias("p"), F.max("price").alias("top"))
    return s.select("token", F.coalesce((F.col("l") <= 1) | (F.col("p") <= 0.1 * F.col("top")), F.lit(False)).alias("dead"))


def creator_history(tokens: DataFrame, dead: DataFrame, rows: int = 20) -> DataFrame:
    """(token, prior, dead_prior): the creator's most recent other tokens, at most ``rows``, and how many are dead."""
    t = tokens.join(dead, "token", "left").select("token", "creator", "first_seen", F.coalesce("dead", F.lit(False)).cast("int").alias("dead"))
    w = Window.partitionBy("creator").orderBy(F.desc("first_seen"), F.desc("token"))
    ranked = t.withColumn("_n", F.row_number().over(w))
    # the first rows + 1 of a creator hold the rows others of any of its tokens
    top = ranked.filter(F.col("_n") <= rows + 1)
    sums = top.groupBy("creator").agg(F.count(F.lit(1)).alias("n"), F.sum("dead").alias("d"), F.max(F.when(F.col("_n") == rows + 1, F.col("dead"))).alias("extra"))
    j = ranked.join(sums, "creator")
    inside = F.col("_n") <= rows
    n = F.when(inside, F.col("n") - 1).otherwise(F.least(F.col("n"), F.lit(rows)))
    d = F.when(inside, F.col("d") - F.col("dead")).otherwise(F.col("d") - F.coalesce("extra", F.lit(0)))
    return j.select("token", n.alias("prior"), d.alias("dead_prior"))


def hard_filters(b: DataFrame, block_share: float = 0.70) -> Column:
    """Reasons that block a token outright; an unknown authority does, too."""
    set_ = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return F.array_compact(F.array(
        F.when(set_("mint_authority") & ~F.col("on_curve"), "mint_authority"), F.when(set_("freeze_authority"), "freeze_authority"),
        F.when(F.col("top_share") > block_share, "concentrated"), F.when(F.col("mint_authority").isNull() | F.col("freeze_authority").isNull(), "authority_unknown"),
    ))


def assess(facts: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """``token``, six components, ``score``, ``reasons``. ``facts``: a row a token with what the components need."""
    parts = {
        "authority": authority(F.col("mint_authority"), F.col("freeze_authority")), "holders": holders(F.col("top_share")),
        "lp": lp(F.col("on_curve"), F.col("has_lp"), F.col("burned_share"), F.col("lp_top_share")), "deployer": deployer(F.col("dead_prior"), F.col("prior")),
        "volume": volume(F.col("buyers_6h"), F.col("buys_6h")), "liquidity_age": liquidity_age(F.col("liquidity"), F.col("age_s")),
    }
    score = clamp(sum((v * weights[k] for k, v in parts.items()), F.lit(0.0)))
    return facts.select("token", *[v.alias(k) for k, v in parts.items()], score.alias("score"), hard_filters(facts).alias("reasons"))


def load_weights(learned: DataFrame) -> DataFrame:
    """Learned weights (name, weight) clamped to half and twice their base and normalised; the base where any is missing or no number."""
    base = learned.sparkSession.createDataFrame(list(WEIGHTS.items()), "name string, base double")
    j = base.join(learned, "name", "left")
    good = j.agg((F.count_if(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") <= 0)) == 0).alias("good"))
    w = F.least(F.greatest(F.col("weight"), 0.5 * F.col("base")), 2.0 * F.col("base"))
    j = j.crossJoin(F.broadcast(good)).withColumn("w", F.when(F.col("good"), w).otherwise(F.col("base")))
    total = j.agg(F.sum("w").alias("total"))
    return j.crossJoin(F.broadcast(total)).select("name", (F.col("w") / F.col("total")).alias("weight"))


def fresh_assessments(done: DataFrame, now: int, version: int, ttl_us: int = 600_000_000) -> DataFrame:
    latest = latest_per_key(done.filter(F.col("version") == version), ["token"], [F.desc("ts")])
    return latest.filter(F.col("ts") >= now - ttl_us)


def resolve(assessed: DataFrame, snapshots: DataFrame, now: int, least_age: int = 12 * HOUR, give_up: int = 72 * HOUR, most: int | None = None) -> DataFrame:
    """Outcome of assessments (token, ts) at least 12 hours old: rug if liquidity or price fell by 90 %, else the sign of the return; without evidence a retry, after 72 hours unknown."""
    due = assessed.filter(F.col("ts") <= now - least_age)
    if most:
        due = due.orderBy("ts", "token").limit(most)
    base = asof_backward(due, snapshots, ["token"], "ts", "ts", ["price", "liquidity"], prefix="base_")
    last = snapshots.groupBy("token").agg(F.max_by(F.struct("price", "liquidity", "ts"), "ts").alias("last"))
    j = base.join(last, "token", "left")
    fell = lambda a, b: F.coalesce((F.col(a) > 0) & (F.col(b) <= 0.1 * F.col(a)), F.lit(False))
    roi = F.when((F.col("base_price") > 0) & F.col("last.price").isNotNull(), F.col("last.price") / F.col("base_price") - 1)
    later = F.col("last.ts") > F.col("ts")
    outcome = (
        F.when(later & (fell("base_liquidity", "last.liquidity") | fell("base_price", "last.price")), "rug")
        .when(later & (roi > 0), "profit").when(later & roi.isNotNull(), "loss")
        .when(F.col("ts") <= now - give_up, "unknown").otherwise("retry")
    )
    return j.select(*assessed.columns, outcome.alias("outcome"), F.when(later, roi).alias("outcome_roi"))


def tune(resolved: DataFrame, least: int = 50, least_rugs: int = 10, churn: float = 0.01) -> DataFrame:
    """New weights from components' means over rugs and others: (name, weight, changed); the base unless there is enough evidence."""
    long = resolved.select((F.col("outcome") == "rug").alias("rug"), F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in COMPONENTS])).alias("c")).select("rug", "c.*")
    mean = long.groupBy("name").agg(F.avg(F.when(F.col("rug"), F.col("value"))).alias("hot"), F.avg(F.when(~F.col("rug"), F.col("value"))).alias("cool"), F.count(F.lit(1)).alias("n"), F.count_if("rug").alias("rugs"))
    base = resolved.sparkSession.createDataFrame(list(WEIGHTS.items()), "name string, base double")
    factor = F.least(F.greatest(1 + (F.coalesce("hot", F.lit(0.0)) - F.coalesce("cool", F.lit(0.0))) / 100, F.lit(0.5)), F.lit(2.0))
    j = base.join(mean, "name", "left").withColumn("w", F.col("base") * factor)
    j = j.crossJoin(F.broadcast(j.agg(F.sum("w").alias("total"))))
    j = j.withColumn("new", F.col("w") / F.col("total"))
    guard = j.agg((F.min("n") >= least).alias("enough"), (F.min("rugs") >= least_rugs).alias("rugs_enough"), (F.max(F.abs(F.col("new") - F.col("base"))) >= churn).alias("moved"))
    on = F.coalesce(F.col("enough") & F.col("rugs_enough") & F.col("moved"), F.lit(False))
    return j.crossJoin(F.broadcast(guard)).select("name", F.when(on, F.col("new")).otherwise(F.col("base")).alias("weight"), on.alias("changed"))
