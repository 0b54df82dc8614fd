"""Cooldowns and back-tests of hot keys over many tasks: each row's successor as a pointer, followed by doubling.

``decisions.cooldown`` and ``decisions.backtest`` run along a key's sorted rows in one task. Here no task needs a key's rows
together. The cooldown:

* Only the distinct times of a key matter; of rows at one time the first may be allowed.
* Time is cut into buckets as wide as the wait. From an allowed time t the next one is the first at or after t + wait in
  the next bucket, and without one the first time of the bucket with times after that. So pointers come from one window
  a bucket, and from a table of the buckets' first times.
* The allowed times are those on the path from a key's first time. Each round adds the ends of the pointers of what is
  known and doubles the pointers' length, so a path of n allowed times takes log2 n rounds of joins.

The back-test: a decided buy points to the first decided buy after the sell that would close it. Both lookups are windows
over slices of time, cut at quantiles of all rows, with what comes first in later slices carried over a row a slice.
The copies that are opened are again a path, from a token's first decided buy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def next_allowed(times: DataFrame, key: str, wait: int) -> DataFrame:
    """(key, us, next): for each distinct time of a key the one that is allowed next after it; null at the end."""
    at = times.withColumn("_bucket", F.floor(F.col("us") / wait))
    first = at.groupBy(key, "_bucket").agg(F.min("us").alias("_head"))
    line = Window.partitionBy(key).orderBy("_bucket")  # a row a wait
    heads = first.select(key, "_bucket", F.lead("_bucket").over(line).alias("_b1"), F.lead("_head").over(line).alias("_h1"), F.lead("_head", 2).over(line).alias("_h2"))
    asks = at.select(key, (F.col("_bucket") + 1).alias("_bucket"), (F.col("us") + wait).alias("_at"), F.col("us").alias("_from"))
    there = at.select(key, "_bucket", F.col("us").alias("_at"), F.col("us").alias("_to"))
    # backwards in time, times before questions at one place, so that the frame only grows
    seen = Window.partitionBy(key, "_bucket").orderBy(F.desc("_at"), F.col("_to").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = asks.unionByName(there, allowMissingColumns=True).withColumn("_hit", F.min("_to").over(seen)).filter("_from is not null")
    found = met.select(key, (F.col("_bucket") - 1).alias("_bucket"), F.col("_from").alias("us"), "_hit").join(heads, [key, "_bucket"])
    beyond = F.when(F.col("_b1") == F.col("_bucket") + 1, F.coalesce("_hit", "_h2")).otherwise(F.col("_h1"))
    return found.select(key, "us", beyond.alias("next"))


def path(heads: DataFrame, step: DataFrame, key: str, node: str) -> DataFrame:
    """(key, node): all nodes on the paths from ``heads`` along the pointers ``step`` (key, node, next); a null ``next`` ends a path."""
    step = written(step.filter("next is not null").select(key, node, "next"), "pointers")
    known = written(heads.select(key, node), "path")
    while True:
        more = written(known.join(step, [key, node]).select(key, F.col("next").alias(node)), "path")
        if more.isEmpty():
            return known
        known = written(known.unionByName(more), "path")
        twice = step.alias("a").join(step.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.next") == F.col(f"b.{node}")))
        step = written(twice.select(F.col(f"a.{key}").alias(key), F.col(f"a.{node}").alias(node), F.col("b.next").alias("next")), "pointers")


def following(rows: DataFrame, keys: list[str], order: list[str], wanted: Column, payload: Column, name: str) -> DataFrame:
    """``rows`` (cut by ``_slice``, which rises with ``order``) with the ``payload`` of the first wanted row of their keys after them, as ``name``."""
    back = Window.partitionBy(*keys, "_slice").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("_near", F.last(F.when(wanted, payload), ignorenulls=True).over(back))
    firsts = rows.groupBy(*keys, "_slice").agg(F.min_by(F.when(wanted, payload), F.when(wanted, F.struct(*order))).alias("_first"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    beyond = firsts.select(*keys, "_slice", F.last("_first", ignorenulls=True).over(later).alias("_beyond"))
    return near.join(beyond, [*keys, "_slice"]).withColumn(name, F.coalesce("_near", "_beyond")).drop("_near", "_beyond")


def backtest(trades: DataFrame, slices: int = 64) -> DataFrame:
    """The rows of ``decisions.backtest`` without a task that runs along a token's rows. Rows without a token, wallet, time or ``event_id`` neither open nor close."""
    slim = trades.select("token", "us", "event_id", "wallet", "side", "decided", "price").dropna(subset=["token", "us", "event_id", "wallet"])
    kept = written(slim.filter("price > 0 and not isnan(price)"), "trades")
    at = F.array(*[F.lit(k / slices) for k in range(1, slices)])
    borders = F.broadcast(kept.agg(F.array_distinct(F.percentile_approx("us", at, 40 * slices)).alias("_borders")))  # one row
    cut = F.size(F.filter(F.coalesce("_borders", F.array().cast("array<long>")), lambda b: b <= F.col("us")))
    rows = kept.crossJoin(borders).withColumn("_slice", cut).drop("_borders")
    order, opens = ["us", "event_id"], (F.col("side") == "buy") & F.col("decided")
    after = written(following(rows, ["token"], order, opens, F.col("event_id"), "_then"), "successors")
    sale = F.struct(F.col("event_id").alias("sell_event"), F.col("us").alias("closed_us"), F.col("price").alias("leave"), "_then")
    closed = following(after, ["token", "wallet"], order, F.col("side") == "sell", sale, "_sale").filter(opens)
    buys = written(closed.select("token", "event_id", "wallet", F.col("us").alias("opened_us"), F.col("price").alias("entry"), "_sale"), "buys")
    heads = buys.groupBy("token").agg(F.min_by("event_id", F.struct("opened_us", "event_id")).alias("event_id"))
    taken = path(heads, buys.select("token", "event_id", F.col("_sale._then").alias("next")), "token", "event_id")
    done = buys.filter("_sale is not null").join(taken, ["token", "event_id"])
    roi = (F.col("_sale.leave") / F.col("entry") - 1).alias("roi")
    return done.select("token", F.col("event_id").alias("buy_event"), "_sale.sell_event", "wallet", "opened_us", "_sale.closed_us", "entry", "_sale.leave", roi)


def cooldown(buys: DataFrame, key: str, seconds: int, order: list[str]) -> DataFrame:
    """``key``, ``us``, ``order`` and ``allowed`` of each buy, as ``decisions.cooldown`` gives them; rows with a null key or time are never allowed."""
    slim = buys.select(key, "us", *order)
    times = written(slim.select(key, "us").filter(F.col(key).isNotNull() & F.col("us").isNotNull()).distinct(), "times")
    step = next_allowed(times, key, seconds * 1_000_000)
    known = path(times.groupBy(key).agg(F.min("us").alias("us")), step, key, "us")
    first = slim.groupBy(key, "us").agg(F.min(F.struct(*order)).alias("_first"))
    allowed = known.join(first, [key, "us"]).select(key, "us", "_first.*", F.lit(True).alias("allowed"))
    return slim.join(allowed, [key, "us", *order], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
