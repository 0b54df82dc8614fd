"""Copy decisions with named gates, risk rails, leader ranking, alerts and the copy back-test."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import copy_size, scale
from ..sources.bindings import DAY, HOUR

# Thresholds of alerts.
STALL_MIN, FAILED_RATIO, LOSS_SHARE, AUC_FLOOR, REGIME_MIN = 15.0, 0.5, 0.8, 0.55, 120.0


def ew_ranking(outcomes: DataFrame, key: str, order: list[str], roi: str, alpha: float = 0.25, least: int = 5) -> DataFrame:
    """Exponentially weighted outcome of each key, and the factor it gives; the recurrence in its closed form."""
    w = Window.partitionBy(key)
    n, i = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*order))
    weighed = outcomes.select(key, roi, n.alias("n"), (n - i).alias("age"))
    s = weighed.groupBy(key).agg(F.max("n").alias("n"), F.sum(alpha * F.pow(F.lit(1 - alpha), F.col("age")) * F.col(roi)).alias("ew"))
    factor = F.when(F.col("n") < least, 1.0).when(F.col("ew") < 0, F.greatest(F.lit(0.5), 1 + F.col("ew"))).otherwise(F.least(F.lit(1.2), 1 + 0.4 * F.col("ew")))
    return s.withColumn("factor", factor)


def failure_streak(attempts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Failures since the last success of each key: gaps and islands."""
    success = F.when(F.col("failed"), 0).otherwise(1)
    running = attempts.withColumn("island", F.sum(success).over(Window.partitionBy(key).orderBy(*order)))
    by = running.groupBy(key, "island").agg(F.count_if("failed").alias("failures"))
    return by.groupBy(key).agg(F.max_by("failures", "island").alias("streak"))


def daily_loss(rows: DataFrame, time: str, pnl: str, order: list[str], limit: float) -> DataFrame:
    """PnL of each UTC day, and when its running sum first reached the loss limit."""
    day = rows.withColumn("day", F.floor(F.col(time) / DAY)).withColumn("hour", F.floor(F.col(time) / HOUR))
    # hours first, so that no task orders a whole day
    before = Window.partitionBy("day").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = day.groupBy("day", "hour").agg(F.sum(pnl).alias("_h")).select("day", "hour", F.coalesce(F.sum("_h").over(before), F.lit(0)).alias("_before"))
    inside = F.sum(pnl).over(Window.partitionBy("day", "hour").orderBy(*order))
    running = day.withColumn("_inside", inside).join(hours, ["day", "hour"]).withColumn("running", F.col("_before") + F.col("_inside"))
    return running.groupBy("day").agg(F.sum(pnl).cast("double").alias("pnl"), F.min(F.when(F.col("running") <= -limit, F.col(time))).alias("tripped_us"))


def market_moves(returns: DataFrame, least: float = 5.0) -> DataFrame:
    """Alerts of windows whose price moved by ``least`` percent or more, up or down."""
    return returns.filter(F.abs("pct") >= least).withColumn("name", F.lit("large_market_move"))


def cooldown(buys: DataFrame, key: str, seconds: int, order: list[str]) -> DataFrame:
    """``allowed`` for each buy: none within ``seconds`` of the last allowed one. A suppressed buy doesn't restart the clock, so the state runs along the sorted rows of a key; a task holds one number."""
    wait = seconds * 1_000_000

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, 0
        for frame in frames:
            allowed = []
            for k, us in zip(frame[key].tolist(), frame["us"].tolist()):
                ok = k != at or us - last >= wait
                if ok:
                    at, last = k, us
                allowed.append(ok)
            yield frame.assign(allowed=allowed)

    slim = buys.select(key, "us", *order)
    dealt = slim.repartition(key).sortWithinPartitions(key, "us", *order)
    return dealt.mapInPandas(run, slim.schema.add("allowed", "boolean"))


def rails(ledger: DataFrame, streaks: DataFrame, daily: DataFrame, cooling: DataFrame | None = None, stopped: bool = False, max_open: int = 10, max_exposure: float = 2.0, max_failures: int = 5, daily_limit: float = 1.0) -> DataFrame:
    """Blocking reasons of each wallet's ledger: (wallet, reasons). ``cooling``: wallets in cooldown; ``stopped``: the emergency stop. State that can't be read (a null streak or daily PnL) blocks."""
    j = ledger.join(streaks.withColumn("_s", F.lit(True)), "wallet", "left").join(daily.withColumn("_d", F.lit(True)), "wallet", "left")
    cool = cooling.select("wallet").distinct().withColumn("_cool", F.lit(True)) if cooling is not None else ledger.select("wallet", F.lit(False).alias("_cool"))
    j = j.join(cool, "wallet", "left")
    unread = (F.col("_s").isNotNull() & F.col("streak").isNull()) | (F.col("_d").isNotNull() & F.col("daily_pnl").isNull())
    reasons = F.array_compact(F.array(
        F.when(F.lit(stopped), "emergency_stop"),
        F.when(F.col("_cool"), "cooldown"),
        F.when(F.col("streak") >= max_failures, "failures"),
        F.when(F.col("daily_pnl") <= -daily_limit, "daily_loss"),
        F.when(unread, "unreadable"),
        F.when(F.col("open_n") >= max_open, "max_open"),
        F.when(F.col("exposure") >= max_exposure, "max_exposure"),
    ))
    return j.select("wallet", reasons.alias("reasons"))


def confidence_and_risk(b: DataFrame) -> DataFrame:
    """Confidence and risk, 0 to 100, of buys joined to their wallet's and token's state."""
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    ml = F.when(F.col("p_profit").isNotNull(), 0.25).otherwise(0.0)
    adjust = F.coalesce("factor", F.lit(1.0))
    wallet = F.least(F.coalesce("confidence_score", F.lit(30.0)) * adjust, F.lit(100.0))
    quality = 0.4 * scale(known("liquidity"), 0, 500) + 0.3 * scale(known("volume_1h"), 0, 1000) + 0.3 * scale(known("holder_growth"), 0, 50)
    confidence = (0.45 + (0.25 - ml)) * wallet + ml * 100 * known("p_profit") + 0.20 * 100 * quality + 0.10 * 50
    apart = F.coalesce(F.abs(F.col("price") - F.col("vwap")) / F.when(F.col("vwap") != 0, F.col("vwap")), F.lit(0.15))
    risk = 40 * (1 - scale(known("liquidity"), 0, 200)) + 25 * (1 - scale(known("age_s"), 0, 86400)) + 20 * scale(apart, 0, 0.5) + 15 * scale(F.coalesce("roi_std", F.lit(1.0)), 0, 3)
    roi = F.col("avg_roi")
    return b.select("*", wallet.alias("wallet_conf"), confidence.alias("confidence"), risk.alias("risk"), F.when(roi >= 0, roi * adjust).otherwise(roi).alias("expected_reward"))


def decide(
    buys: DataFrame, min_confidence: float = 60, max_risk: float = 70, min_liquidity: float = 25, follow_bar: float = 65, max_rug: float = 60, cap_band: tuple[float, float] = (1e4, 5e7),
    need_cap: bool = False, enabled: bool = True, mode: str = "fixed", wallet_blacklist: tuple = (), token_blacklist: tuple = (), max_exposure: float = 2.0,
) -> DataFrame:
    """Decision table: a row for each buy, with 13 named gates; copied exactly if all pass. Buys of unknown wallets or tokens are skipped with risk 100."""
    b = confidence_and_risk(buys)
    size = copy_size(mode, F.col("leader_size"), F.lit(max_exposure) - F.coalesce("exposure", F.lit(0.0)))
    tracked = F.coalesce("tracked", F.lit(False))
    suspicious = F.coalesce(F.col("verdict") == "suspicious", F.lit(False))
    b = b.withColumn("size_sol", size["size_sol"])
    checks: list[tuple[str, Column]] = [
        ("copy_enabled", F.lit(enabled)),
        ("followed_leader", tracked | (F.col("wallet_conf") >= follow_bar)),
        ("wallet_not_blacklisted", ~F.col("wallet").isin(*wallet_blacklist) if wallet_blacklist else F.lit(True)),
        ("token_not_blacklisted", ~F.col("token").isin(*token_blacklist) if token_blacklist else F.lit(True)),
        ("token_rug_risk", F.col("rug_score").isNull() | (~F.coalesce("hard_blocked", F.lit(False)) & (F.col("rug_score") <= max_rug))),
        ("leader_vetting", tracked | ~suspicious),
        ("confidence_threshold", F.col("confidence") >= min_confidence),
        ("risk_threshold", F.col("risk") <= max_risk),
        ("liquidity_floor", F.coalesce(F.col("liquidity") >= min_liquidity, F.lit(False))),
        ("market_cap_band", F.coalesce(F.col("market_cap").between(*cap_band), F.lit(not need_cap))),
        ("position_size", F.col("size_sol") > 0),
        ("safety_rails", F.coalesce(F.size("rail_reasons"), F.lit(0)) == 0),
        ("no_duplicate_position", ~F.coalesce("has_open", F.lit(False))),
    ]
    gates = F.array(*[F.struct(F.lit(k).alias("gate"), v.alias("passed")) for k, v in checks])
    unknown = F.col("confidence_score").isNull() & F.col("first_seen").isNull()
    out = b.withColumn("gates", gates).withColumn("unknown", unknown)
    decision = F.when(F.col("unknown"), "skip").when(F.forall("gates", lambda g: g["passed"]), "copy").otherwise("skip")
    return out.withColumn("decision", decision).withColumn("risk", F.when(F.col("unknown"), 100.0).otherwise(F.col("risk")))


def blocked_only_by(decisions: DataFrame, gate: str) -> DataFrame:
    """Decisions that this gate alone stopped."""
    failed = F.filter("gates", lambda g: ~g["passed"])
    return decisions.filter((F.size(failed) == 1) & (F.get(failed, F.lit(0))["gate"] == gate))


def backtest(trades: DataFrame) -> DataFrame:
    """Copies of decided buys: one open position a token; the same leader's next sell closes it. Columns: token, us, event_id, wallet, side, decided, price; rows without a price above 0 neither open nor close."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token, held = None, None
        for frame in frames:
            out = []
            for t, us, event, wallet, side, decided, price in zip(*(frame[c].tolist() for c in ("token", "us", "event_id", "wallet", "side", "decided", "price"))):
                if t != token:
                    token, held = t, None
                if held is None:
                    if side == "buy" and decided and price > 0:
                        held = (event, us, wallet, price)
                elif side == "sell" and wallet == held[2] and price > 0:
                    out.append((t, held[0], event, wallet, held[1], us, held[3], price, price / held[3] - 1))
                    held = None
            yield pd.DataFrame(out, columns=["token", "buy_event", "sell_event", "wallet", "opened_us", "closed_us", "entry", "leave", "roi"])

    slim = trades.select("token", "us", "event_id", "wallet", "side", "decided", F.coalesce("price", F.lit(0.0)).alias("price"))
    dealt = slim.repartition("token").sortWithinPartitions("token", "us", "event_id")
    return dealt.mapInPandas(run, "token long, buy_event long, sell_event long, wallet long, opened_us long, closed_us long, entry double, leave double, roi double")


def alerts(context: DataFrame) -> DataFrame:
    """Rules that fire for a one-row context."""
    ratio = F.coalesce("failed_1h", F.lit(0.0)) / F.greatest(F.coalesce("trades_1h", F.lit(0.0)), F.lit(1.0))
    near = -LOSS_SHARE * F.col("daily_limit")
    rule = lambda on, name, severity, value: F.when(on, F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), value.cast("double").alias("value")))
    fired = F.array_compact(F.array(
        rule(F.col("minutes_since_trade") > STALL_MIN, "ingestion_stalled", "critical", F.col("minutes_since_trade")),
        rule(ratio > FAILED_RATIO, "high_failed_tx_ratio", "warning", ratio),
        rule(F.coalesce("emergency_stop", F.lit(False)), "copy_emergency_stop_active", "critical", F.lit(None)),
        rule((F.col("daily_limit") > 0) & (F.coalesce("daily_pnl", F.lit(0.0)) <= near), "daily_loss_near_limit", "warning", F.col("daily_pnl")),
        rule(F.col("latest_auc") < AUC_FLOOR, "model_accuracy_degraded", "warning", F.col("latest_auc")),
        rule(F.col("minutes_since_regime") > REGIME_MIN, "no_recent_regime", "info", F.col("minutes_since_regime")),
    ))
    return context.select(F.explode(fired).alias("a")).select("a.*")
