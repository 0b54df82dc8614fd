"""Exact percentiles of a population too large for one buffer: selection by rank, in a few aggregates.

A sketch of bounded size brackets each wanted rank, one aggregate counts what lies below and inside the bracket, and the
rows inside are bracketed again until few are left. Each pass leaves about a sixty-fourth, so three passes do for 10^9
values; only what is left is ordered. The result equals ``percentile``, interpolation included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..sources.tables import written

ACCURACY = 10_000
#: Distinct values inside a bracket that one task may order.
FEW = 200_000


def percentiles(df: DataFrame, value: str, shares: list[float], keys: list[str] | None = None, few: int = FEW, accuracy: int = ACCURACY) -> DataFrame:
    """``keys``, ``population`` (values that aren't null) and ``percentiles``, an array in the order of ``shares``.

    Null values don't count. Without keys there is one row, with null percentiles for an empty table.
    """
    if few < 4:
        raise ValueError("few must be 4 or more: a bracket holds both neighbours of a place")
    keys = keys or []
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.persist(StorageLevel.DISK_ONLY)  # values with their counts; passes read it again
    total = rows.groupBy(*keys).agg(F.sum("_n").alias("population"))
    # both neighbours of a share's place are wanted
    place = F.col("share") * (F.col("population") - 1)
    every = total.withColumn("i", F.explode(F.lit(list(range(len(shares)))))).withColumn("share", F.get(F.lit([float(p) for p in shares]), F.col("i")))
    every = every.select(*keys, "i", place.alias("place"), F.floor(place).alias("first"), F.ceil(place).alias("last"))
    span = [*keys, "i"]
    held = _joined(rows, every, keys).withColumn("below", F.lit(0).cast("long"))  # rows inside each bracket, and how many values lie below it
    while held.groupBy(*span).count().filter(F.col("count") > few).limit(1).count():
        held = written(_narrowed(held, span, accuracy), "ranks")  # each pass starts from a table, not from all passes before it
    running = F.sum("_n").over(Window.partitionBy(*span).orderBy("_v"))
    ordered = held.withColumn("upto", F.col("below") + running)
    got = ordered.groupBy(*span).agg(F.first("place").alias("place"), F.first("first").alias("first"), F.first("last").alias("last"), F.min(F.when(F.col("upto") > F.col("first"), F.col("_v"))).alias("a"), F.min(F.when(F.col("upto") > F.col("last"), F.col("_v"))).alias("b"))
    exact = F.when((F.col("first") == F.col("last")) | (F.col("a") == F.col("b")), F.col("a")).otherwise((F.col("last") - F.col("place")) * F.col("a") + (F.col("place") - F.col("first")) * F.col("b"))
    lists = got.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", exact.alias("x")))), lambda s: s["x"]).alias("percentiles"))
    if keys:
        return total.join(lists, keys)
    lists = lists.select(F.when(F.size("percentiles") > 0, F.col("percentiles")).otherwise(F.lit([None] * len(shares)).cast("array<double>")).alias("percentiles"))
    return total.select(F.coalesce("population", F.lit(0)).alias("population")).crossJoin(lists)


def _joined(rows: DataFrame, every: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(every, keys) if keys else rows.crossJoin(F.broadcast(every))  # without keys, a row a share


def _narrowed(held: DataFrame, span: list[str], accuracy: int) -> DataFrame:
    """The rows of narrower brackets: a sketch gives 65 marks, and the counts between them tell exactly where the wanted ranks lie."""
    marks = held.groupBy(*span).agg(F.array_distinct(F.percentile_approx("_v", F.array(*[F.lit(k / 64) for k in range(65)]), accuracy)).alias("_marks"))
    rows = held.join(marks, span).withColumn("_part", F.size(F.filter("_marks", lambda m: m <= F.col("_v")))).drop("_marks")
    parts = rows.groupBy(*span, "_part").agg(F.sum("_n").alias("n"), *[F.first(c).alias(c) for c in ("first", "last", "below")])
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*span).orderBy("_part"))  # 66 rows a bracket
    parts = parts.withColumn("_upto", upto)
    low = F.max(F.when(F.col("_upto") - F.col("n") <= F.col("first"), F.struct("_part", (F.col("_upto") - F.col("n")).alias("below")))).alias("_low")
    high = F.min(F.when(F.col("_upto") > F.col("last"), F.col("_part"))).alias("_high")
    bracket = parts.groupBy(*span).agg(low, high)
    kept = rows.drop("below").join(bracket, span).filter("_part between _low._part and _high")
    return kept.select(*[c for c in held.columns if c != "below"], F.col("_low.below").alias("below"))
