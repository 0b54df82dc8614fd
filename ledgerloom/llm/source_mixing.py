"""Mixing sources to target weights by capped water-filling (operator 8), in DataFrame operations only.

Every source is to get a share of the words in proportion to its weight. A
source is clamped at ``max_epochs`` times its size; what it can't use is
shared among the others by weight, again and again, until none is above its
cap. With ``level`` words a unit of weight, targets are
``min(level * weight, cap)``; each round of the loop is one small aggregate
that raises the level, so the number of sources isn't bounded by the driver.

A source's documents then repeat ``floor(target / size)`` whole times, and a
seeded sample of them once more for the fraction. Each document has a place
on a circle of ``BINS`` bins by a seeded hash of its id and text (and its
number among equal rows, so that rows without an id or repeated ones don't
move together). An arc from one of ``STARTS`` places draws the sample: the
start and end are those whose documents' words come nearest to what the source
lacks. So the miss is at most half the words of one bin, which in a source of
up to some hundreds of documents is half of one document. Words a bin are one
partial aggregate. No row is moved but repeated ones: only the sources' small
table is joined to the documents.

Defined results: null and empty texts have size 0 and take 0 words (their
rows repeat like others of their source); a null source is a source of its
own, ordered last; a source without words has target 0 and isn't repeated;
repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .shared import discard, materialize, n_words, ordered_positions, read_table

MAX_EPOCHS = 3
SEED = 17
BINS = 1024
STARTS = 16


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights by the sources' code-point order, null last."""
    placed = ordered_positions(sources.select("source"), [F.col("source").isNull(), F.col("source")])
    weights = F.array(*[F.lit(w).cast("double") for w in cycle])
    return placed.select("source", F.element_at(weights, (F.col("position") % len(cycle) + 1).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source``, ``source_size``, ``target`` for sources with ``source_size`` and ``weight``."""
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()
    level, cap = (total.t / total.w if total.w else 0.0), F.col("source_size") * max_epochs
    while True:
        above = F.col("weight") * F.lit(level) > cap
        got = sources.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("used"), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("w")).first()
        raised = (total.t - got.used) / got.w if got.w else level
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("weight") * F.lit(level), cap.cast("double"))
    return sources.select("source", "source_size", target.alias("target"))


def _same(a: str, b: str):
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as ``_row``, with ``_nr``: 0, or for rows of one id and text their numbers from 0, by source and the other columns.

    Only repeated rows are moved, and a group of any size is dealt over many tasks. Which of wholly equal rows has which
    number is open, and makes no difference.
    """
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, MapType)])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "source", "doc_id", F.coalesce("text", F.lit("")).alias("text"), whole.alias("_whole"))
    rows = rows.withColumn("_key", F.xxhash64("doc_id", F.isnull("doc_id"), "text"))
    again = materialize(rows.groupBy("_key").count().filter("count > 1").select("_key"), "repeated")
    if again.isEmpty():
        discard(again)
        return rows.withColumn("_nr", F.lit(0).cast("long"))
    once = rows.join(again, "_key", "left_anti").withColumn("_nr", F.lit(0).cast("long"))
    more = rows.join(again, "_key", "left_semi")
    more = ordered_positions(more, [F.col("_key"), F.isnull("source"), F.col("source"), F.col("_whole")], ["_key"]).withColumnRenamed("position", "_nr")
    return once.unionByName(more.select(*once.columns))


def repetitions(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` as ``_row`` with ``size``, ``source_size``, ``target`` and ``copies``, the times that the mix takes the row."""
    own = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("_nr"), F.md5("text"))
    place = (F.conv(F.substring(F.md5(own), 1, 13), 16, 10).cast("long") % BINS).cast("int")
    rows = _numbered(docs).select("_row", "source", n_words(F.col("text")).alias("size"), place.alias("place"))
    words = materialize(rows.groupBy("source", "place").agg(F.sum("size").alias("words")), "words")
    sources = materialize(words.groupBy("source").agg(F.sum("words").alias("source_size")), "sources")
    weights = materialize(weights if weights is not None else cycled_weights(sources), "weights")
    weighed = sources.alias("s").join(weights.alias("w"), _same("s", "w")).select("s.source", "source_size", "weight")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = water_fill(weighed, max_epochs).select("source", "source_size", "target", F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("part"))
    plan = materialize(plan, "plan")

    # the words of each arc: from a start, bin by bin; or none at all
    step = F.pmod(F.col("place") - F.col("start"), F.lit(BINS))
    arcs = words.withColumn("start", F.explode(F.lit([k * BINS // STARTS for k in range(STARTS)]))).withColumn("step", step)
    run = Window.partitionBy("source", "start").orderBy("step")
    arcs = arcs.select("source", "start", "step", F.sum("words").over(run).alias("words")).unionByName(sources.select("source", F.lit(0).alias("start"), F.lit(-1).alias("step"), F.lit(0).cast("long").alias("words")))
    gap = F.abs(F.col("words") - F.col("part") * F.col("source_size"))
    tried = arcs.alias("a").join(plan.alias("s"), _same("a", "s")).select(F.col("a.source").alias("source"), F.struct(gap.alias("gap"), "start", "step").alias("arc"))
    best = tried.groupBy("source").agg(F.min("arc").alias("arc"))
    drawn = materialize(plan.alias("s").join(best.alias("b"), _same("s", "b")).select("s.*", F.col("arc.start").alias("start"), F.col("arc.step").alias("last")), "plan")
    discard(words, sources, weights, plan)

    out = rows.alias("d").join(drawn.alias("s"), _same("d", "s"), "left")
    copies = F.coalesce(F.col("whole") + (step <= F.col("last")).cast("long"), F.lit(0)).cast("long")
    return out.select("_row", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed rows themselves: each document's row as often as the mix takes it."""
    planned = repetitions(docs, weights, max_epochs, seed).filter("copies > 0")
    return planned.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("_row.*")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repetitions(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select("_row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op8_source_mixing": op8_source_mixing}
SQL = {
    "op8_source_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || (row_number() OVER (PARTITION BY doc_id, coalesce(text, '') ORDER BY source IS NULL, source) - 1) || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) % 1024 AS place FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s AS (SELECT source, source_size, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s0),
fill AS (
  SELECT 0 AS step, CAST(-1 AS DOUBLE) AS before, CAST(sum(source_size) AS DOUBLE) / sum(weight) AS level FROM s
  UNION ALL
  SELECT step + 1, level, coalesce((SELECT (sum(source_size) - sum(CASE WHEN weight * level > source_size * 3 THEN source_size * 3 ELSE 0 END)) / nullif(sum(CASE WHEN weight * level > source_size * 3 THEN 0 ELSE weight END), 0) FROM s), level)
  FROM fill WHERE level > before AND step < 10000),
p AS (
  SELECT source, source_size, least(weight * (SELECT max(level) FROM fill), CAST(source_size * 3 AS DOUBLE)) AS target,
    CASE WHEN source_size > 0 THEN least(weight * (SELECT max(level) FROM fill), CAST(source_size * 3 AS DOUBLE)) / source_size ELSE 0 END AS r FROM s),
q AS (
  SELECT d.doc_id, d.source, d.size, d.place, p.source_size, p.target, floor(p.r) AS whole, p.r - floor(p.r) AS part
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
k AS (SELECT unnest(range(0, 1024, 64)) AS start),
b AS (SELECT source, place, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source, place),
t AS (
  SELECT source, start, (place - start + 1024) % 1024 AS step, CAST(sum(words) OVER (PARTITION BY source, start ORDER BY (place - start + 1024) % 1024) AS BIGINT) AS words FROM b, k
  UNION ALL SELECT source, 0, -1, 0 FROM s),
best AS (
  SELECT source, start, step FROM (
    SELECT t.source, start, step, row_number() OVER (PARTITION BY t.source ORDER BY abs(words - (p.r - floor(p.r)) * source_size), start, step) AS rn FROM t JOIN p ON t.source IS NOT DISTINCT FROM p.source) WHERE rn = 1)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target,
  CAST(q.size * (whole + CASE WHEN (place - start + 1024) % 1024 <= step THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM q JOIN best ON q.source IS NOT DISTINCT FROM best.source
"""
}
