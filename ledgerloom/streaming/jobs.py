"""Structured Streaming forms of the trade operators: sources, runs, and the stateless and windowed ones.

Each takes a streaming DataFrame of trades (``ts`` timestamp, ``us``,
``event_id``, ``wallet``, ``token``, ``side``, ``amount``, ``sol``, ``quote``)
and returns another one. Folds that need their rows in order of event time are
in ``ordered`` and ``folds``; tables that a stream keeps batch by batch are in
``ledger``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import file_system, scratch

LATE = "10 minutes"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None, glob: str = "events.parquet") -> DataFrame:
    """The ``events`` table of a folder as a stream of trades."""
    source = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    return as_trades(source.parquet(folder))


def as_trades(e: DataFrame) -> DataFrame:
    from ..sources.bindings import SOL_PRICE, micros

    k = F.from_json("props", "k long")["k"]
    stable = F.col("event_id") % 10 == 0
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), micros(F.col("ts")).alias("us"), "event_id", F.col("user_id").alias("wallet"), (k % 10).alias("token"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type").isin("purchase", "signup"), "buy").otherwise("sell").alias("side"),
        (1 + F.col("event_id") % 7).cast("double").alias("amount"), F.col("value").alias("quote"), F.when(stable, "stable").otherwise("wsol").alias("quote_kind"), F.when(stable, F.col("value") / SOL_PRICE).otherwise(F.col("value")).alias("sol"),
    )


def dealt_files(spark: SparkSession, sf_dir: str, slices: Column) -> str:
    """The ``events`` of a folder dealt into files of a new one by a number that ``slices`` computes from ``us`` and ``event_id``; a stream takes the files in order of that number."""
    from ..sources.bindings import micros

    e = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet").withColumn("us", micros(F.col("ts")))
    folder = f"{scratch(spark)}/events-{uuid.uuid4().hex}"
    e.withColumn("slice", slices).drop("us").repartition("slice").write.partitionBy("slice").parquet(folder)
    fs, p = file_system(spark, folder)
    for part in [x.getPath() for x in fs.listStatus(p) if x.isDirectory()]:
        n = int(part.getName().removeprefix("slice="))
        for f in fs.listStatus(part):  # the source goes by the files' times
            fs.setTimes(f.getPath(), 1_700_000_000_000 + 1000 * n, -1)
    return folder


class Run:
    """A stream's checkpoint and what it wrote, under one folder: started again on it, a stream goes on where it stopped.

    ``append`` and ``update`` batches are written under their number, so
    that a repeated batch replaces itself; ``complete`` ones replace the table.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
        self.schema = None

    def ticks(self, stream: DataFrame) -> DataFrame:
        """``stream`` and the ticks of this run: rows of a time only, which move the clock on though no more events come."""
        folder = f"{self.base}/ticks"
        self.spark.createDataFrame([], "ts timestamp").write.mode("append").parquet(folder)
        return stream.unionByName(self.spark.readStream.schema("ts timestamp").parquet(folder), allowMissingColumns=True)

    def tick(self, us: int) -> None:
        self.spark.range(1).select(F.timestamp_micros(F.lit(us)).alias("ts")).write.mode("append").parquet(f"{self.base}/ticks")

    def go(self, stream: DataFrame, mode: str = "append", batch: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
        """Run a stream to the end of what is there now and return all that this run wrote so far."""

        def put(df: DataFrame, n: int) -> None:
            out = batch(df, n) if batch else df
            self.schema = out.schema
            out.write.mode("overwrite").parquet(f"{self.base}/out/batch={0 if mode == 'complete' else n}")

        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{self.base}/check").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
        if self.schema is None:
            return self.spark.createDataFrame([], "batch int").drop("batch")
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/out").select(*[f.name for f in self.schema.fields])


def finish(stream: DataFrame, mode: str = "append", batch: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Run a stream to the end of what is there now and return what it wrote."""
    return Run(stream.sparkSession).go(stream, mode, batch)


def to_the_end(spark: SparkSession, made: Callable[[Run], DataFrame], until_us: int) -> DataFrame:
    """Run a stream to its end, then start it again on its checkpoint with a tick at ``until_us``, so that all that waits comes out."""
    run = Run(spark)
    run.go(made(run))
    run.tick(until_us)
    return run.go(made(run))


def dedup(stream: DataFrame, keys: list[str], ttl: str = "1 hour") -> DataFrame:
    """A key is taken once within the time to live."""
    return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def priority_lane(stream: DataFrame, followed: DataFrame) -> DataFrame:
    """Marks rows of followed wallets, which are never sampled away."""
    return stream.join(followed.select("wallet", F.lit(True).alias("is_priority")), "wallet", "left").withColumn("is_priority", F.coalesce("is_priority", F.lit(False)))


def sliding(stream: DataFrame, width: str, step: str, keys: list[str]) -> DataFrame:
    w = stream.filter("side <> 'failed'").withWatermark("ts", LATE).groupBy(F.window("ts", width, step).alias("w"), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("quote").cast("decimal(18,2)")).cast("double").alias("volume"))


def cooldown(stream: DataFrame, seconds: int) -> DataFrame:
    """Buys of a token within ``seconds`` of the last allowed one are suppressed; state: the last allowed time.

    A token's state goes when the watermark has passed its cooldown: a later buy is allowed with or without it.
    """
    wait = seconds * 1_000_000

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["us", "event_id"])
        allowed = []
        for us in rows["us"].tolist():
            ok = last is None or us - last >= wait
            last = us if ok else last
            allowed.append(ok)
        state.update((last,))
        state.setTimeoutTimestamp(max((last + wait) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"].tolist(), "allowed": allowed})

    buys = stream.filter("side = 'buy'").withWatermark("ts", LATE)
    return buys.groupBy("token").applyInPandasWithState(judge, "event_id long, allowed boolean", "last long", "update", GroupStateTimeout.EventTimeTimeout)
