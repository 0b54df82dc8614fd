"""Ordered lookups: as-of joins, latest rows, top rows of groups, windows of time.

As-of joins are a union of both sides and one window per key: one shuffle on
the key, no range join. At equal times a right row stands before a left row,
so a backward join includes it and a forward join leaves it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _both(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str], tie: list[str]) -> DataFrame:
    l_part = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    r_part = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*[F.col(c) for c in payload]).alias("_r"), F.struct(*[F.col(c) for c in (tie or [right_time])]).alias("_tie"))
    return l_part.unionByName(r_part, allowMissingColumns=True)


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str], tie: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``left`` with the ``payload`` of the last right row of its key at or before it (null without one); ``tie`` orders right rows of one time."""
    both = _both(left, right, keys, left_time, right_time, payload, tie or [])
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    return got.select("_l.*", *[F.col(f"_r.{c}").alias(prefix + c) for c in payload])


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, payload: list[str], horizon: int | None = None, tie: list[str] | None = None, prefix: str = "") -> DataFrame:
    """``left`` with the first right row of its key after it, and no later than ``horizon`` after it."""
    if right_time not in payload:
        payload = [*payload, right_time]
    both = _both(left, right, keys, left_time, right_time, payload, tie or [])
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy(F.desc("_t"), F.desc("_side"), F.desc("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    # backwards in time, so that the frame only grows
    got = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    if horizon is not None:
        got = got.withColumn("_r", F.when(F.col(f"_r.{right_time}") <= F.col("_t") + horizon, F.col("_r")))
    return got.select("_l.*", *[F.col(f"_r.{c}").alias(prefix + c) for c in payload])


def asof_timeline(left: DataFrame, timeline: DataFrame, left_time: str, time: str, payload: list[str], default: dict[str, object] | None = None, slices: int = 256, salts: int = 4) -> DataFrame:
    """As-of join without a key to a timeline (rows with a null time on either side match nothing).

    Quantiles of the timeline itself cut it into ``slices`` of about equal numbers of rows, however it clusters; the last row
    before a slice is carried into it, so each slice stands alone. Rows of ``left`` go to their slice, dealt over ``salts``
    copies of it, and take the last row at or before them.
    """
    line = timeline.filter(F.col(time).isNotNull())
    at = F.array(*[F.lit(k / slices) for k in range(1, slices)])
    borders = F.broadcast(line.agg(F.array_distinct(F.percentile_approx(time, at, 40 * slices)).alias("_borders")))  # one row
    slice_of = F.size(F.filter(F.coalesce("_borders", F.array().cast("array<long>")), lambda b: b <= F.col("_t"))).alias("_slice")
    rows = line.select(F.col(time).cast("long").alias("_t"), F.struct(*payload).alias("_r")).crossJoin(borders).select("_t", "_r", slice_of)
    ends = rows.groupBy("_slice").agg(F.max_by("_r", "_t").alias("_r"))
    every = left.sparkSession.range(slices).select(F.col("id").cast("int").alias("_slice")).join(ends, "_slice", "left")
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    carried = every.select(F.lit(None).cast("long").alias("_t"), F.last("_r", ignorenulls=True).over(before).alias("_r"), "_slice")
    theirs = rows.unionByName(carried.filter("_r is not null")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    mine = left.select(F.col(left_time).cast("long").alias("_t"), F.struct(*left.columns).alias("_l")).crossJoin(borders)
    mine = mine.filter("_t is not null").select("_t", "_l", slice_of, F.pmod(F.xxhash64("_t", F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("_salt"))
    both = theirs.unionByName(mine, allowMissingColumns=True)
    w = Window.partitionBy("_slice", "_salt").orderBy(F.col("_t").asc_nulls_first(), F.col("_l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_l is not null").select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in payload])
    out = got.unionByName(left.filter(F.col(left_time).isNull()), allowMissingColumns=True)
    for c, v in (default or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], rows: int = 1) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).filter(F.col("_n") <= rows).drop("_n")


def all_at_latest(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """All rows of a key that stand at its greatest time."""
    return df.withColumn("_n", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(time)))).filter("_n = 1").drop("_n")


def last_per_window(df: DataFrame, start: int, width: int, time: str, keys: list[str] | None = None) -> DataFrame:
    """The last row of every tumbling window counted from ``start``."""
    keys = keys or []
    w = df.filter(F.col(time) >= start).withColumn("window_index", F.floor((F.col(time) - start) / width))
    top = w.groupBy(*keys, "window_index").agg(F.max_by(F.struct(*[c for c in w.columns if c not in (*keys, "window_index")]), time).alias("_r"))
    return top.select(*keys, "window_index", "_r.*")


def recent(df: DataFrame, order: list[Column], filters: Column | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the newest rows."""
    if filters is not None:
        df = df.filter(filters)
    return df.orderBy(*order).offset(offset).limit(limit)
