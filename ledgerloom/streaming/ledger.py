"""Tables that a stream keeps batch by batch: attempts, aggregates and snapshots, each version under its batch's number.

A batch that is run again after a failure reads what its predecessor left and writes over its own version, so nothing
counts twice. Nothing is held in the driver between batches: a restart finds its place in the folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import file_system


class Versions:
    """Numbered versions of one table in a folder; a version counts once its write has been committed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def write(self, df: DataFrame, n: int) -> DataFrame:
        path = f"{self.folder}/version={n}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def numbers(self) -> list[int]:
        fs, p = file_system(self.spark, self.folder)
        if not fs.exists(p):
            return []
        found = [s.getPath() for s in fs.listStatus(p)]
        done = [x for x in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return sorted(int(x.getName().removeprefix("version=")) for x in done)

    def last_before(self, n: int) -> int | None:
        return max((k for k in self.numbers() if k < n), default=None)

    def read(self, n: int | None) -> DataFrame | None:
        return None if n is None else self.spark.read.parquet(f"{self.folder}/version={n}")

    def drop(self, numbers: list[int]) -> None:
        for n in numbers:
            fs, p = file_system(self.spark, f"{self.folder}/version={n}")
            fs.delete(p, True)


class Aggregate:
    """A table of aggregates that grows with a stream: each batch's part is a version of its own, and every ``every`` batches they are merged.

    ``keys`` and, by name, how two values merge (such as ``F.sum`` or ``F.max`` of that name). ``apply`` takes a batch's
    part; ``current`` is the aggregate over all rows up to a batch, from the last merged base and the parts since.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], merge: dict[str, Callable[[str], Column]], every: int = 8):
        self.parts, self.base = Versions(spark, f"{folder}/parts"), Versions(spark, f"{folder}/base")
        self.keys, self.merge, self.every = keys, merge, every

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[how(c).alias(c) for c, how in self.merge.items()])

    def apply(self, part: DataFrame, n: int) -> None:
        self.parts.write(self._merged(part.select(*self.keys, *self.merge)), n)
        if (n + 1) % self.every == 0:
            self.base.write(self.current(n), n)
            old = self.base.last_before(n)  # one base before the last stays, as do the parts since, for a batch that is run again
            self.base.drop([k for k in self.base.numbers() if old is not None and k < old])
            self.parts.drop([k for k in self.parts.numbers() if old is not None and k <= old])

    def current(self, n: int) -> DataFrame:
        """The aggregate over the rows of all batches up to ``n``."""
        at = self.base.last_before(n)
        rows = [self.base.read(at), *[self.parts.read(k) for k in self.parts.numbers() if (at is None or k > at) and k <= n]]
        rows = [r for r in rows if r is not None]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return self._merged(out)


class Retries:
    """At-least-once work with bounded attempts: a failed row waits in a table and is tried again by a later batch.

    ``work`` adds ``ok`` to rows with their ``attempt`` (from 0). A batch tries its own rows and those that are due, once;
    what failed is due ``wait`` batches later, or dead after ``attempts``.
    """

    def __init__(self, spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame], attempts: int = 5, wait: int = 1):
        self.tried, self.waiting = Versions(spark, f"{folder}/tried"), Versions(spark, f"{folder}/waiting")
        self.work, self.attempts, self.wait = work, attempts, wait

    def batch(self, fresh: DataFrame | None, n: int) -> None:
        """One batch; ``fresh`` None: only what waits."""
        held = self.waiting.read(self.waiting.last_before(n))
        rows = None if fresh is None else fresh.withColumn("attempt", F.lit(0)).withColumn("due", F.lit(n))
        rows = rows if held is None else held if rows is None else rows.unionByName(held)
        now = self.work(rows.filter(F.col("due") <= n).drop("due")).withColumn("attempt", F.col("attempt") + 1)
        tried = self.tried.write(now, n)  # from here on each attempt is read, not made again
        again = tried.filter(~F.col("ok") & (F.col("attempt") < self.attempts)).drop("ok").withColumn("due", F.lit(n + self.wait))
        later = rows.filter(F.col("due") > n)
        self.waiting.write(again.unionByName(later.select(again.columns)), n)
        old = self.waiting.last_before(n)
        self.waiting.drop([k for k in self.waiting.numbers() if old is not None and k < old])

    def drain(self) -> None:
        """Batches without fresh rows until nothing waits: what a schedule does after the stream has stopped."""
        while (n := max(self.waiting.numbers(), default=None)) is not None and not self.waiting.read(n).isEmpty():
            self.batch(None, n + 1)

    def attempts_made(self) -> DataFrame:
        """Every attempt, with the batch that made it (``version``)."""
        return self.tried.spark.read.option("basePath", self.tried.folder).parquet(self.tried.folder)

    def outcomes(self) -> DataFrame:
        """Rows that are done (``done`` true) or dead, with their attempts and the batch."""
        made = self.attempts_made().filter(F.col("ok") | (F.col("attempt") >= self.attempts))
        return made.withColumnRenamed("ok", "done").withColumnRenamed("version", "batch")


class Snapshots:
    """Tables made after each batch and read by later ones: a batch sees the last version finished before it, and none of its own rows or later ones."""

    def __init__(self, spark: SparkSession, folder: str, make: Callable[[DataFrame], dict[str, DataFrame]]):
        self.spark, self.folder, self.make = spark, folder, make
        self.rows, self.ready = Versions(spark, f"{folder}/rows"), Versions(spark, f"{folder}/ready")

    def before(self, n: int) -> dict[str, DataFrame] | None:
        """The tables of the last snapshot finished before batch ``n``; None if there is none."""
        at = self.ready.last_before(n)
        if at is None:
            return None
        return {r.table: self.spark.read.parquet(f"{self.folder}/{r.table}/version={at}") for r in self.ready.read(at).collect()}  # a name a table

    def take(self, batch: DataFrame, n: int) -> None:
        """Add a batch's rows and make the snapshot of all rows so far."""
        self.rows.write(batch, n)
        have = [self.rows.read(k) for k in self.rows.numbers() if k <= n]
        known = have[0]
        for r in have[1:]:
            known = known.unionByName(r)
        tables = self.make(known)
        for name, df in tables.items():
            Versions(self.spark, f"{self.folder}/{name}").write(df, n)
        self.ready.write(self.spark.createDataFrame([(name,) for name in tables], "table string"), n)
