"""Sharding along a Hilbert curve (operator 9), in DataFrame operations only.

Rows are placed on a grid of metadata (source, language, size), each axis cut
into ``2 ** BITS`` steps that keep its order; the Hilbert index of the cell
orders all rows, and the order is cut into runs. Neighbours on the curve are
neighbours on every axis, so a run spans a narrow range of each column, and
readers prune shards by any of them.

Law ``rows``: runs differ by one row at most. Places in the order come from
ranges over the whole sort key, numbered by many tasks, never by one window
over everything. Within a cell equal texts stand together (by checksum and
size); copies that differ in source or language lie in other cells, so a group
of equal texts may be spread over shards.

The size axis has ten steps for each power of two, from integers alone.

The curve is a state machine over one bit of each axis a step; its table
(states x cells) is built from the Gray-code rule below.

Defined results: a null text has no bytes (size 8, CRC of an empty text);
null sources and languages take the step after all others; repeated rows get
places of their own; with fewer rows than shards the first shards hold one
row each; an empty table gives no rows; extra columns pass through ``place``,
but one named like a column that it adds is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .shared import materialize, ordered_positions, read_table

SHARDS = 24
BITS = 8
ADDED = ("size", "text_crc32", "curve", "shard", "slot")


def curve_table(dims: int) -> list[list[tuple[int, int]]]:
    """For each state, and each cell (a bit of every axis): (digit of the index, next state). A state is an entry corner and a direction."""
    n, mask = dims, (1 << dims) - 1
    gray = lambda i: i ^ (i >> 1)
    turn = lambda x, k: ((x >> (k % n)) | (x << (n - k % n))) & mask
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing ones
    entry = lambda w: 0 if w == 0 else gray(2 * ((w - 1) // 2))
    way = lambda w: 0 if w == 0 else ones(w - 1) % n if w % 2 == 0 else ones(w) % n
    table = []
    for state in range(n << n):
        e, d = state // n, state % n
        row = []
        for cell in range(1 << n):
            t = turn(cell ^ e, d + 1)
            w = next(i for i in range(1 << n) if gray(i) == t)
            row.append((w, (e ^ turn(entry(w), -(d + 1))) * n + (d + way(w) + 1) % n))
        table.append(row)
    return table


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Index along the curve of a cell with the coordinates ``axes`` (each 0 to 2 ** bits - 1)."""
    n = len(axes)
    if n * bits > 62:
        raise ValueError("axes * bits must be at most 62")
    flat = [digit + (state << n) for row in curve_table(n) for digit, state in row]
    table = F.lit(flat)

    def step(acc: Column, bit: Column) -> Column:
        cell = F.lit(0)
        for k, axis in enumerate(axes):
            cell = cell + F.call_function("getbit", axis.cast("long"), bit).cast("int") * (1 << k)
        got = F.get(table, acc["state"] * (1 << n) + cell)
        return F.struct((got.bitwiseAND(F.lit((1 << n) - 1)).cast("long") + acc["index"] * (1 << n)).alias("index"), F.shiftright(got, n).cast("int").alias("state"))

    order = F.lit(list(range(bits - 1, -1, -1)))
    return F.aggregate(order, F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state")), step)["index"]


def rank_steps(df: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(column, step): distinct values in order, dealt evenly over the axis; null last."""
    values = materialize(df.select(F.col(column).alias("_v")).distinct(), "values")
    n = max(1, values.count())
    placed = ordered_positions(values, [F.col("_v").isNull(), F.col("_v")])
    return placed.select(F.col("_v").alias(f"_{column}"), F.floor(F.col("position") * (1 << bits) / F.lit(n)).cast("int").alias(f"_{column}_step"))


def size_step(size: Column) -> Column:
    """Ten steps for each power of two, up to the axis' last."""
    power = F.length(F.bin(size)) - 1
    base = F.call_function("shiftleft", F.lit(1).cast("long"), power)
    return F.least(power * 10 + F.floor((size - base) * 10 / base), F.lit((1 << BITS) - 1)).cast("int")


def _crc(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).cast("long")


def place(docs: DataFrame, shards: int = SHARDS, keep_rows: bool = True) -> DataFrame:
    """``docs`` (without ``keep_rows`` only ``doc_id``) with ``size``, ``text_crc32``, ``curve``, ``shard`` and ``slot``."""
    names = [c for c in docs.columns if c.lower() not in ADDED] if keep_rows else ["doc_id"]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "source", "lang", size.alias("size"), _crc(F.col("text")).alias("text_crc32"))
    for c in ("source", "lang"):
        steps = rank_steps(docs, c)
        rows = rows.join(steps, rows[c].eqNullSafe(steps[f"_{c}"]), "left").drop(f"_{c}")
    rows = rows.withColumn("curve", hilbert_index([F.col("_source_step"), F.col("_lang_step"), size_step(F.col("size"))]))
    whole = F.xxhash64(*[F.col(f"_row.`{c}`") for c in names if not isinstance(docs.schema[c].dataType, MapType)])  # rows equal but for other columns keep their order
    rows = rows.select("_row", "doc_id", "size", "text_crc32", "curve", whole.alias("_whole"))
    n = docs.count()
    placed = ordered_positions(rows, [F.col("curve"), F.col("text_crc32"), F.col("size"), F.col("doc_id"), F.col("_whole")])
    q, r = divmod(n, shards)
    pos, head = F.col("position"), r * (q + 1)
    low, high = F.floor(pos / F.lit(q + 1)), r + F.floor((pos - head) / F.lit(max(q, 1)))
    shard = F.when(pos < head, low).otherwise(high).cast("int")
    start = F.when(F.col("shard") <= r, F.col("shard") * (q + 1)).otherwise(head + (F.col("shard") - r) * q)
    out = placed.withColumn("shard", shard).withColumn("slot", (pos - start).cast("long"))
    return out.select("_row.*", "size", "text_crc32", "curve", "shard", "slot")


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = place(read_table(spark, sf_dir, "documents"), keep_rows=False)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def _curve_sql() -> str:
    """The state machine's table as a SQL list; an entry is digit + 8 * next state."""
    return "[" + ", ".join(str(digit + 8 * state) for row in curve_table(3) for digit, state in row) + "]"


QUERIES = {"op9_hilbert_shards": op9_hilbert_shards}
SQL = {
    "op9_hilbert_shards": f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (
  SELECT doc_id, source, lang, strlen(coalesce(text, '')) + 8 AS size,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS text_crc32
  FROM documents, crc),
s AS (SELECT source, floor((row_number() OVER (ORDER BY source IS NULL, source) - 1) * {1 << BITS} / count(*) OVER ()) AS step FROM (SELECT DISTINCT source FROM documents)),
l AS (SELECT lang, floor((row_number() OVER (ORDER BY lang IS NULL, lang) - 1) * {1 << BITS} / count(*) OVER ()) AS step FROM (SELECT DISTINCT lang FROM documents)),
c AS (
  SELECT d.*, CAST(s.step AS BIGINT) AS x, CAST(l.step AS BIGINT) AS y, least((length(bin(size)) - 1) * 10 + (size - (1 << (length(bin(size)) - 1))) * 10 // (1 << (length(bin(size)) - 1)), {(1 << BITS) - 1}) AS z
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN l ON d.lang IS NOT DISTINCT FROM l.lang),
m AS (SELECT {_curve_sql()} AS t),
h AS (
  SELECT c.*, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range({BITS} - 1, -1, -1), lambda b: (x >> b) % 2 + 2 * ((y >> b) % 2) + 4 * ((z >> b) % 2))),
    lambda a, cell: (a // 32 * 8 + t[a % 32 * 8 + cell + 1] % 8) * 32 + t[a % 32 * 8 + cell + 1] // 8) // 32 AS curve FROM c, m),
p AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, size, doc_id NULLS FIRST) - 1 AS pos, count(*) OVER () // {SHARDS} AS q, count(*) OVER () % {SHARDS} AS r FROM h),
g AS (SELECT *, CASE WHEN pos < r * (q + 1) THEN pos // (q + 1) ELSE r + (pos - r * (q + 1)) // greatest(q, 1) END AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard,
  CAST(pos - CASE WHEN shard <= r THEN shard * (q + 1) ELSE r * (q + 1) + (shard - r) * q END AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, curve FROM g
"""
}
