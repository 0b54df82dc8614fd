"""Position episodes as windows: the result of ``positions.fold_positions`` without a fold.

Let a pair's level be the running sum of 0.995 times what is bought minus what is sold. An episode that began after a
row of level v ends at the first later sell whose level is at most v: then no more than 0.5 % of what it bought is left.
So each episode ends at a sell that is as low as every row before it (the start, level 0, included), and every such sell ends one:
between two ends in a row no sell reaches the first one's level, and buys only rise. Ends are thus the running
minima of a running sum, two windows of one sort, and the number of ends before a row is its episode.

* Levels are exact: amounts are taken to 9 decimal places as decimals, so they don't drift along a pair's rows. Where
  what is left is 0.5 % to the last bit, a fold in doubles may decide otherwise by its rounding; sums and PnL are doubles.
* Sums and minima of slices combine, so a hot pair's rows needn't stand in one task: ``sliced`` cuts the pairs of more
  than ``hot_rows`` rows at quantiles of their own times, and carries each slice's sum, minimum, ends and open episode
  over a table of a row a slice. Other pairs stay whole, in the same job.

Defined results: trades without a SOL value or an amount are skipped; an amount of 0 ends no episode; rows
without a wallet or token are a pair of their own; equal rows count as often as they occur; no rows give none.
Amounts must not be negative, and stay below 10^19.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .positions import COLUMNS

PAIR = ["wallet", "token"]
FIRST = Window.unboundedPreceding
SMALL = 100_000  # rows of three small columns that may be broadcast; beyond it the join shuffles


def _rows(trades: DataFrame, order: list[str]) -> DataFrame:
    buy, exact = F.col("side") == "buy", F.col("amount").cast("decimal(28,9)")
    kept = trades.filter("sol is not null and amount is not null").select(*PAIR, "us", "side", "amount", "sol", *order)
    return kept.withColumn("_step", F.when(buy, exact * 995).otherwise(exact * -1000))


def _end(level: Column, lowest: Column) -> Column:
    """Whether a row ends an episode; ``lowest`` is the least level before it, null where there's none."""
    return (F.col("_step") < 0) & (level <= F.least(F.lit(0), lowest))


def _profits(rows: DataFrame, key: list[str], order: list[str], bought: Column, cost: Column) -> DataFrame:
    """The PnL of each sell at the average entry so far; ``bought`` and ``cost`` are what earlier slices carry."""
    buy = F.col("side") == "buy"
    run = Window.partitionBy(*key).orderBy("us", *order).rowsBetween(FIRST, 0)
    tokens = bought + F.sum(F.when(buy, F.col("amount")).otherwise(0.0)).over(run)
    sol = cost + F.sum(F.when(buy, F.col("sol")).otherwise(0.0)).over(run)
    entry = F.when(tokens > 0, sol / tokens).otherwise(0.0)
    return rows.withColumn("_pnl", F.when(buy, 0.0).otherwise(F.col("sol") - entry * F.col("amount")))


def _episodes(rows: DataFrame) -> DataFrame:
    total = lambda side, c: F.sum(F.when(F.col("side") == "buy" if side == "buy" else F.col("side") != "buy", F.col(c)).otherwise(0.0))
    e = rows.groupBy(*PAIR, "episode").agg(
        F.max("_end").alias("_done"), F.min("us").alias("opened_us"), F.max("us").alias("last_us"),
        total("buy", "amount").alias("bought_tokens"), total("sell", "amount").alias("sold_tokens"), total("buy", "sol").alias("bought_sol"), total("sell", "sol").alias("sold_sol"),
        F.sum("_pnl").alias("pnl"), F.count("*").alias("trades"), F.count_if(F.col("side") != "buy").alias("sells"),
    )
    done, held = F.col("_done"), F.col("bought_tokens") > 0
    e = e.withColumns({
        "status": F.when(done, "closed").otherwise("open"),
        "closed_us": F.when(done, F.col("last_us")),
        "remaining": F.col("bought_tokens") - F.col("sold_tokens"),
        "avg_entry": F.when(held, F.col("bought_sol") / F.col("bought_tokens")),
        "avg_exit": F.when(F.col("sold_tokens") > 0, F.col("sold_sol") / F.col("sold_tokens")),
        "roi": F.when(done & held & (F.col("bought_sol") > 0), F.col("pnl") / F.col("bought_sol")),
        "hold_s": F.when(done, F.when(held, F.floor((F.col("last_us") - F.col("opened_us")) / 1_000_000)).otherwise(0).cast("long")),
    })
    return e.select(COLUMNS)


def windowed(trades: DataFrame, order: list[str]) -> DataFrame:
    """Episodes of all (wallet, token) pairs, with the columns of ``fold_positions``: one shuffle, no Python. ``order`` makes rows of one ``us`` unique."""
    pair = Window.partitionBy(*PAIR).orderBy("us", *order)
    before = pair.rowsBetween(FIRST, -1)
    level = _rows(trades, order).withColumn("_level", F.sum("_step").over(pair.rowsBetween(FIRST, 0)))
    ends = level.withColumn("_end", _end(F.col("_level"), F.min("_level").over(before)))
    numbered = ends.withColumn("episode", 1 + F.coalesce(F.count_if("_end").over(before), F.lit(0)))
    return _episodes(_profits(numbered, [*PAIR, "episode"], order, F.lit(0.0), F.lit(0.0)))


def sliced(trades: DataFrame, order: list[str], hot_rows: int = 1_000_000, slices: int = 64) -> DataFrame:
    """The same where pairs of more than ``hot_rows`` rows are dealt over up to ``slices`` slices of their times. Equal times stay in one slice."""
    place = [*PAIR, "_slice"]
    kept = written(_rows(trades, order), "trades")
    hot = kept.groupBy(*PAIR).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).select(*PAIR, F.lit(True).alias("_hot"))
    hot = written(hot, "hot")  # at most a row for hot_rows trades
    marked = kept.join(F.broadcast(hot) if hot.count() <= SMALL else hot, PAIR, "left")
    at = F.array(*[F.lit(k / slices) for k in range(1, slices)])
    borders = F.broadcast(marked.filter("_hot").agg(F.array_distinct(F.percentile_approx("us", at, 40 * slices)).alias("_borders")))  # one row
    cut = F.when(F.col("_hot"), F.size(F.filter("_borders", lambda b: b <= F.col("us")))).otherwise(0)
    rows = marked.crossJoin(borders).withColumn("_slice", cut).drop("_borders")

    inside = Window.partitionBy(*place).orderBy("us", *order)
    before = inside.rowsBetween(FIRST, -1)
    earlier = Window.partitionBy(*PAIR).orderBy("_slice").rowsBetween(FIRST, -1)  # a row a slice
    local = rows.withColumn("_in", F.sum("_step").over(inside.rowsBetween(FIRST, 0))).withColumn("_least", F.min("_in").over(before))
    local = local.withColumn("_row", F.row_number().over(inside)).drop(*order)  # a place in the slice does for all that order rows
    local, order = written(local, "levels"), ["_row"]
    before = Window.partitionBy(*place).orderBy("_row").rowsBetween(FIRST, -1)
    parts = local.filter("_hot").groupBy(*place).agg(F.sum("_step").alias("_sum"), F.min("_in").alias("_min"))
    parts = parts.withColumn("_from", F.sum("_sum").over(earlier)).withColumn("_floor", F.min(F.coalesce("_from", F.lit(0)) + F.col("_min")).over(earlier))
    start = F.coalesce("_from", F.lit(0))
    levels = local.join(parts.select(*place, "_from", "_floor"), place, "left")
    ends = levels.withColumn("_end", _end(start + F.col("_in"), F.least("_floor", start + F.col("_least"))))
    turns = ends.withColumn("_turn", F.coalesce(F.count_if("_end").over(before), F.lit(0)))
    turns = written(turns.select(*place, "_hot", "_turn", "_end", "us", "side", "amount", "sol", *order), "turns")

    done = turns.filter("_hot").groupBy(*place).agg(F.count_if("_end").alias("_n")).select(*place, F.sum("_n").over(earlier).alias("_ended"))
    buy = F.col("side") == "buy"
    open_ = turns.filter("_hot").groupBy(*place, "_turn").agg(F.sum(F.when(buy, F.col("amount")).otherwise(0.0)).alias("_b"), F.sum(F.when(buy, F.col("sol")).otherwise(0.0)).alias("_c"))
    open_ = open_.join(done, place).withColumn("episode", 1 + F.coalesce("_ended", F.lit(0)) + F.col("_turn"))
    carry = Window.partitionBy(*PAIR, "episode").orderBy("_slice").rowsBetween(FIRST, -1)  # at most a row a slice
    carried = open_.select(*place, "_turn", "episode", F.sum("_b").over(carry).alias("_bought"), F.sum("_c").over(carry).alias("_cost"))
    numbered = turns.join(carried, [*place, "_turn"], "left").withColumn("episode", F.coalesce("episode", 1 + F.col("_turn")))
    return _episodes(_profits(numbered, [*place, "_turn"], order, F.coalesce("_bought", F.lit(0.0)), F.coalesce("_cost", F.lit(0.0))))
