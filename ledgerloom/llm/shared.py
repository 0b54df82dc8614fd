"""Small helpers that several operators of this subpackage use.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir`` (shared by the driver and all executors), so a lost
executor never takes the only copy of a stage with it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a local one only on a single machine, where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-ckpt-")
    return _own[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_shared_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def n_words(text):
    """Words of a text (null: none), counted inside the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered_positions(df: DataFrame, order: list, group: list[str] | None = None) -> DataFrame:
    """Adds ``position`` (from 0, gapless) in the total order ``order``, counted per ``group`` if given.

    A range exchange on the whole order key deals rows evenly even when one
    group holds a third of them, or when a third are equal in the whole key: a
    salt is its last column, so which of them comes first is left open. Each
    task numbers its own slice, and the slices' offsets come from one small
    (slice, group) count table. No window ever spans a whole group. The sliced
    table is written once, so that both readers see the same slices.
    """
    group = group or []
    keyed = df.select("*", *[c.alias(f"_o{i}") for i, c in enumerate([*order, F.xxhash64(F.monotonically_increasing_id())])])
    names = [f"_o{i}" for i in range(len(order) + 1)]
    sliced = keyed.repartitionByRange(*names).withColumn("_slice", F.spark_partition_id())
    sliced = materialize(sliced, "slices")
    counts = sliced.groupBy("_slice", *group).agg(F.count(F.lit(1)).alias("_n"))
    # a row for each slice and group: as many as there are tasks, times groups in a slice
    before = Window.partitionBy(*[F.col(g) for g in group]).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = sliced.withColumn("_rn", F.row_number().over(Window.partitionBy("_slice", *group).orderBy(*names)))
    cond = [F.col("l._slice") == F.col("b._slice")] + [F.col(f"l.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    on = cond[0]
    for c in cond[1:]:
        on = on & c
    out = local.alias("l").join(base.alias("b"), on, "left")
    keep = [F.col(f"l.`{c}`") for c in df.columns]
    return out.select(*keep, (F.col("b._base") + F.col("l._rn") - 1).cast("long").alias("position"))
