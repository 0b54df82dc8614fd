"""Sources and sinks: messages, appends without conflicts, converging upserts, daily folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MESSAGE = "id long, wallet string, mint string, side string, quote string, quote_amount string, _corrupt string"
_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and executors share; a local one only on a single machine, where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own in the shared folder: cuts lineage, survives executors."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def parse_messages(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON trade messages of a ``value`` column: accepted rows, and rejects with their reason."""
    m = df.select("value", F.from_json("value", MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("m")).select("value", "m.*")
    amount = F.col("quote_amount").try_cast("decimal(38,18)")
    reason = (
        F.when(F.col("_corrupt").isNotNull(), "malformed").when(~F.coalesce(F.col("quote") == "WSOL", F.lit(False)), "quote")
        .when(~F.coalesce(F.col("side").isin("buy", "sell"), F.lit(False)), "side").when(F.col("wallet").isNull() | F.col("mint").isNull(), "entity")
        .when(amount.isNull(), "amount")
    )
    tagged = m.withColumn("reason", reason).withColumn("quote_amount", amount)
    return tagged.filter("reason is null").drop("value", "reason", "_corrupt"), tagged.filter("reason is not null").select("value", "reason")


def as_messages(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def dedup(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def new_rows(new: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in the target yet, each key once."""
    return new.dropDuplicates(keys).join(there.select(*keys), keys, "left_anti")


def append(new: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Append to a Parquet table; with ``keys`` only keys that it doesn't hold."""
    spark = new.sparkSession
    if keys:
        try:
            new = new_rows(new, spark.read.parquet(path), keys)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            new = new.dropDuplicates(keys)
    new.write.mode("append").parquet(path)


def converge(old: DataFrame, new: DataFrame, keys: list[str], earliest: list[str] = (), latest: list[str] = ()) -> DataFrame:
    """Upsert whose result doesn't depend on order: minima and maxima of both sides."""
    return old.unionByName(new).groupBy(*keys).agg(*[F.min(c).alias(c) for c in earliest], *[F.max(c).alias(c) for c in latest])


def first_writer(old: DataFrame, new: DataFrame, key: str, attribute: str, value: str, order: str) -> DataFrame:
    """An attribute that only its first writer sets."""
    first = new.groupBy(key).agg(F.min_by(value, order).alias("_new"))
    return old.join(first, key, "left").withColumn(attribute, F.coalesce(attribute, "_new")).drop("_new")


def write_daily(df: DataFrame, path: str, time: str, day_us: int = 86_400_000_000) -> None:
    """One folder a day, so that a bound on the day skips whole folders."""
    df.withColumn("block_day", F.floor(F.col(time) / day_us)).write.mode("append").partitionBy("block_day").parquet(path)
