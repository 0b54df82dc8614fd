"""Market regimes: window series, trend with hysteresis, modifier flags, and styles by regime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bindings import HOUR
from .quantiles import percentiles
from .timeops import asof_timeline, last_per_window

# Thresholds of labels and flags.
BULL, BEAR, STICKY = 3.0, -3.0, 1.0
HIGH_VOL, THIN, COLLAPSE = 5.0, 25.0, 0.5
WHALE_MIN, WHALE_FLOW = 10, 5.0
PANIC_RATIO, PANIC_MIN = 1.5, 10
WAVE_MULT, WAVE_MIN = 2.0, 5
EXHAUST_MIN, EXHAUST_WINDOWS = 1.0, 3


def pct_change(first: Column, last: Column) -> Column:
    return F.when(first != 0, (last - first) / F.abs(first) * 100)


def window_returns(series: DataFrame, price: str = "price", order: str = "window_index") -> DataFrame:
    """Percent return of each window on the one before; the series is a row a window of the lookback."""
    before = F.lag(price).over(Window.orderBy(order))
    return series.withColumn("pct", pct_change(before, F.col(price)))


def trend_label(pct: Column, previous: Column) -> Column:
    return (
        F.when(pct.isNull(), "sideways").when(pct > BULL, "bull").when(pct < BEAR, "bear")
        .when((previous == "bull") & (pct > BULL - STICKY), "bull").when((previous == "bear") & (pct < BEAR + STICKY), "bear").otherwise("sideways")
    )


def label_timeline(changes: DataFrame, time: str = "window_index", pct: str = "pct") -> DataFrame:
    """Labels along a timeline (a row a window), each with hysteresis against the one before.

    Only a change between the sticky and the full threshold looks back. Such rows keep the last label set without looking
    back as long as all since then lie in its zone; one outside it makes the rest sideways. So windows express the fold.
    """
    p = F.col(pct)
    zone = F.when((p <= BULL) & (p > BULL - STICKY), 1).when((p >= BEAR) & (p < BEAR + STICKY), -1).otherwise(0)
    w = Window.orderBy(time)
    rows = changes.select(time, pct, zone.alias("_zone")).withColumn("_set", F.when(F.col("_zone") == 0, trend_label(p, F.lit(None).cast("string"))))
    rows = rows.withColumn("_held", F.last("_set", ignorenulls=True).over(w)).withColumn("_run", F.count("_set").over(w))
    since = Window.partitionBy("_run").orderBy(time)
    rows = rows.withColumn("_low", F.min("_zone").over(since)).withColumn("_high", F.max("_zone").over(since))
    keeps = ((F.col("_held") == "bull") & (F.col("_low") >= 0)) | ((F.col("_held") == "bear") & (F.col("_high") <= 0))
    return rows.select(time, pct, F.coalesce("_set", F.when(keeps, F.col("_held")), F.lit("sideways")).alias("label"))


def _series(market: DataFrame, now: int, width: int, lookback: int) -> DataFrame:
    """(one row) the windows' last market rows in order, and the lists that the rules need."""
    last = last_per_window(market.filter(F.col("ts") <= now), now - width * lookback, width, "ts")
    row = F.array_sort(F.collect_list(F.struct("window_index", "ts", "price", "volume_1h", "trades_1h", "launched_1h")))
    known = lambda c: F.transform(F.filter("s", lambda x: x[c].isNotNull()), lambda x: x[c].cast("double"))
    return last.agg(row.alias("s")).select("s", known("price").alias("prices"), known("volume_1h").alias("volumes"), known("launched_1h").alias("launches"))


def _ends(a: Column) -> tuple[Column, Column]:
    return F.try_element_at(a, F.lit(1)), F.try_element_at(a, F.lit(-1))


def _median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def _pstdev(a: Column) -> Column:
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.when(n > 0, n)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda x, y: x + (y - mean) * (y - mean)) / F.when(n > 0, n))


def panic(buys: Column, sells: Column, pct: Column, ratio: float = PANIC_RATIO) -> Column:
    """Many trades, far more sells than buys, and a falling price."""
    return (buys + sells >= PANIC_MIN) & (sells > ratio * F.greatest(buys, F.lit(1))) & (pct < 0)


def detect(market: DataFrame, liquidity: DataFrame, trades: DataFrame, now: int, previous: str | None = None, width: int = HOUR, lookback: int = 24) -> DataFrame:
    """One row: regime, six flags and the numbers behind them. ``liquidity``: (token, ts, liquidity); ``trades``: WSOL-quoted (wallet, us, side, quote)."""
    start = now - width * lookback
    base = _series(market, now, width, lookback)
    first, last = _ends(F.col("prices"))
    n = F.size("prices")
    pct = F.when(n >= 2, pct_change(first, last))
    steps = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.when(i < n, pct_change(F.get("prices", i - 1), F.get("prices", i)))), lambda x: x.isNotNull())
    inside = F.filter("s", lambda x: x["price"].isNotNull() & (x["ts"] >= now - width))
    prior = F.when(F.size(inside) >= 2, F.get(inside, F.lit(0))["price"]).when(F.size(inside) == 1, F.get("prices", n - 2))
    tail = F.slice("s", F.greatest(F.size("s") - EXHAUST_WINDOWS + 1, F.lit(1)), F.lit(EXHAUST_WINDOWS))
    known = lambda c: F.transform(F.filter(tail, lambda x: x[c].isNotNull()), lambda x: x[c].cast("double"))
    tp, tv, tt = known("price"), known("volume_1h"), known("trades_1h")
    momentum = F.when(F.size(tv) >= 2, pct_change(*_ends(tv))).when(F.size(tt) >= 2, pct_change(*_ends(tt)))
    tail_price = F.when(F.size(tp) >= 2, pct_change(*_ends(tp)))
    one = base.select(
        "volumes", "launches", n.alias("price_points"), pct.alias("pct_change"), F.when(n >= 3, F.coalesce(_pstdev(steps), F.lit(0.0))).alias("return_stdev"),
        F.when((n >= 2) & (F.size(inside) > 0), pct_change(prior, last)).alias("last_pct"), tail_price.alias("tail_price"), momentum.alias("momentum"),
    )

    fresh = liquidity.filter((F.col("ts") >= start) & (F.col("ts") <= now)).groupBy("token").agg(F.max_by("liquidity", "ts").alias("l"))
    thin = fresh.agg(F.median("l").alias("median_liquidity"))
    window = trades.filter((F.col("us") >= now - width) & (F.col("us") <= now))
    buy = F.col("side") == "buy"
    sides = window.agg(F.count_if(buy).alias("buys"), F.count_if(~buy).alias("sells"))
    whale = whale_accumulation(window)
    j = one.crossJoin(thin).crossJoin(sides).crossJoin(whale)

    enough = F.col("price_points") >= 2
    volume, launch = _ends(F.col("volumes"))[1], _ends(F.col("launches"))[1]
    flags = {
        "high_volatility": F.col("return_stdev") > HIGH_VOL,
        "low_liquidity": F.coalesce(F.col("median_liquidity") < THIN, F.lit(False)) | F.coalesce((_median(F.col("volumes")) > 0) & (volume < COLLAPSE * _median(F.col("volumes"))), F.lit(False)),
        "whale_accumulation": (F.col("whale_population") >= WHALE_MIN) & (F.col("whale_net") > WHALE_FLOW),
        "panic_selling": panic(F.col("buys"), F.col("sells"), F.col("last_pct")),
        "launch_wave": (launch >= WAVE_MIN) & (launch >= WAVE_MULT * F.greatest(_median(F.col("launches")), F.lit(1e-9))),
        "trend_exhaustion": (F.abs("tail_price") >= EXHAUST_MIN) & (F.abs("momentum") >= EXHAUST_MIN) & ((F.col("tail_price") > 0) != (F.col("momentum") > 0)),
    }
    regime = F.when(enough, trend_label(F.col("pct_change"), F.lit(previous))).otherwise("sideways")
    return j.select(
        F.lit(now).alias("ts"), regime.alias("regime"), *[F.coalesce(enough & v, F.lit(False)).alias(k) for k, v in flags.items()],
        "price_points", "pct_change", "return_stdev", "last_pct", "median_liquidity", "buys", "sells", "whale_net",
    )


def whale_accumulation(window: DataFrame) -> DataFrame:
    """(one row) wallets in the window and the net inflow of the upper decile by notional."""
    per = window.groupBy("wallet").agg(F.sum("quote").alias("notional"), F.sum(F.when(F.col("side") == "buy", F.col("quote")).otherwise(-F.col("quote"))).alias("net"))
    bar = percentiles(per, "notional", [0.9]).select(F.get("percentiles", F.lit(0)).alias("bar"), F.col("population").alias("whale_population"))
    net = per.crossJoin(F.broadcast(bar)).filter(F.col("notional") >= F.col("bar")).agg(F.sum("net").alias("whale_net"))
    return bar.select("whale_population").crossJoin(net)


def regime_style(closed: DataFrame, timeline: DataFrame, styles: DataFrame) -> DataFrame:
    """Positions by the regime at their opening and their wallet's style; ``timeline``: (ts, regime)."""
    at = asof_timeline(closed, timeline, "opened_us", "ts", ["regime"], {"regime": "unknown"})
    j = at.join(styles.select("wallet", "style"), "wallet", "left").withColumn("style", F.coalesce("style", F.lit("unknown")))
    return j.groupBy("regime", "style").agg(F.count(F.lit(1)).alias("positions"), F.avg((F.coalesce("pnl", F.lit(0.0)) > 0).cast("double")).alias("win_rate"), F.avg("roi").alias("avg_roi"), F.sum(F.coalesce("pnl", F.lit(0.0))).alias("total_pnl"))
