"""Canonical trade tables derived from the driver's tables.

Times are microseconds since 1970 (``us``), taken from the wall-clock fields of
the timestamp, so no session time zone enters. ``PRELUDE`` holds the same
derivations as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR
#: 2024-01-31 00:00:00, just after the last event.
NOW = 1_706_659_200 * SECOND
SOL_PRICE = 150.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    seconds = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * SECOND + (F.extract(F.lit("SECOND"), ts) * SECOND).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return read(spark, sf_dir, "events").select("event_id", micros(F.col("ts")).alias("us"), F.col("user_id").alias("wallet"), k.alias("k"), "event_type", "value")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event stream as trades: purchases and signups buy, views and clicks sell."""
    e = events(spark, sf_dir).filter("event_type <> 'error'")
    stable = F.col("event_id") % 10 == 0
    return e.select(
        "event_id", "us", "wallet", (F.col("k") % 10).alias("token"), F.col("k").alias("token100"),
        F.when(F.col("event_type").isin("purchase", "signup"), "buy").otherwise("sell").alias("side"),
        (1 + F.col("event_id") % 7).cast("double").alias("amount"), F.col("value").alias("quote"),
        F.when(stable, "stable").otherwise("wsol").alias("quote_kind"),
        F.get(F.array(F.lit("raydium"), F.lit("pumpfun"), F.lit("orca")), (F.col("event_id") % 3).cast("int")).alias("venue"),
        F.when(stable, F.col("value") / SOL_PRICE).otherwise(F.col("value")).alias("sol"),
    )


def failed_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type = 'error'").select("event_id", "us", "wallet")


def tokens(trade: DataFrame) -> DataFrame:
    """Token dimension: first sighting, creator, supply."""
    t = trade.groupBy("token").agg(F.min("us").alias("first_seen"))
    return t.withColumn("creator", F.col("token") * 13 % 150).withColumn("supply", (F.col("token") + 1) * 1e6)


def wallets(trade: DataFrame) -> DataFrame:
    w = trade.groupBy("wallet").agg(F.min("us").alias("first_seen"), F.max("us").alias("last_seen"))
    return w.withColumn("tracked", F.col("wallet") % 17 == 0)


def line_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades: the volume binding. Its order columns make every row's place unique."""
    items, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    return joined.select(
        (F.col("o_custkey") % 200).alias("wallet"), (F.col("l_partkey") % 20).alias("token"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("amount"), F.col("l_extendedprice").alias("sol"), micros(F.col("l_shipdate")).alias("us"),
        *LINE_ORDER,
    )


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]

_FOLD = """
{name}_ord AS (SELECT *, row_number() OVER (PARTITION BY wallet, token ORDER BY us, {order}) AS rn FROM {source}),
{name}_fold AS (
  SELECT wallet, token, rn, 1 AS episode, us AS opened_us, us AS last_us,
    CASE WHEN side = 'buy' THEN amount ELSE 0 END AS bt, CASE WHEN side = 'buy' THEN 0 ELSE amount END AS st,
    CASE WHEN side = 'buy' THEN sol ELSE 0 END AS bq, CASE WHEN side = 'buy' THEN 0 ELSE sol END AS sq,
    CASE WHEN side = 'buy' THEN CAST(0 AS DOUBLE) ELSE sol END AS pnl, CAST(side = 'sell' AS INT) AS sells, 1 AS trades, side = 'sell' AS closed
  FROM {name}_ord WHERE rn = 1
  UNION ALL
  SELECT wallet, token, rn, episode, opened_us, last_us, bt, st, bq, sq, pnl, sells, trades,
    (bt > 0 AND bt - st <= 0.005 * bt) OR (bt = 0 AND st > 0) AS closed
  FROM (
    SELECT o.wallet, o.token, o.rn, CASE WHEN f.closed THEN f.episode + 1 ELSE f.episode END AS episode,
      CASE WHEN f.closed THEN o.us ELSE f.opened_us END AS opened_us, o.us AS last_us,
      CASE WHEN f.closed THEN 0 ELSE f.bt END + CASE WHEN o.side = 'buy' THEN o.amount ELSE 0 END AS bt,
      CASE WHEN f.closed THEN 0 ELSE f.st END + CASE WHEN o.side = 'buy' THEN 0 ELSE o.amount END AS st,
      CASE WHEN f.closed THEN 0 ELSE f.bq END + CASE WHEN o.side = 'buy' THEN o.sol ELSE 0 END AS bq,
      CASE WHEN f.closed THEN 0 ELSE f.sq END + CASE WHEN o.side = 'buy' THEN 0 ELSE o.sol END AS sq,
      CASE WHEN f.closed THEN 0 ELSE f.pnl END + CASE WHEN o.side = 'buy' THEN 0 ELSE o.sol - CASE WHEN f.closed OR f.bt = 0 THEN 0 ELSE f.bq / f.bt END * o.amount END AS pnl,
      CASE WHEN f.closed THEN 0 ELSE f.sells END + CAST(o.side = 'sell' AS INT) AS sells,
      CASE WHEN f.closed THEN 0 ELSE f.trades END + 1 AS trades
    FROM {name}_fold f JOIN {name}_ord o ON o.wallet = f.wallet AND o.token = f.token AND o.rn = f.rn + 1)),
{name} AS (
  SELECT wallet, token, CAST(episode AS BIGINT) AS episode, CASE WHEN closed THEN 'closed' ELSE 'open' END AS status, opened_us,
    CASE WHEN closed THEN last_us END AS closed_us, last_us, bt AS bought_tokens, st AS sold_tokens, bq AS bought_sol, sq AS sold_sol, bt - st AS remaining,
    CASE WHEN bt > 0 THEN bq / bt END AS avg_entry, CASE WHEN st > 0 THEN sq / st END AS avg_exit, pnl,
    CASE WHEN closed AND bt > 0 AND bq > 0 THEN pnl / bq END AS roi,
    CASE WHEN closed THEN CASE WHEN bt > 0 THEN (last_us - opened_us) // 1000000 ELSE 0 END END AS hold_s,
    CAST(trades AS BIGINT) AS trades, CAST(sells AS BIGINT) AS sells
  FROM (SELECT *, row_number() OVER (PARTITION BY wallet, token, episode ORDER BY rn DESC) AS newest FROM {name}_fold) WHERE newest = 1)"""

TRADE_ROWS = """
  SELECT event_id, us, wallet, k % 10 AS token, k AS token100, CASE WHEN event_type IN ('purchase', 'signup') THEN 'buy' ELSE 'sell' END AS side,
    CAST(1 + event_id % 7 AS DOUBLE) AS amount, value AS quote, CASE WHEN event_id % 10 = 0 THEN 'stable' ELSE 'wsol' END AS quote_kind,
    CASE event_id % 3 WHEN 0 THEN 'raydium' WHEN 1 THEN 'pumpfun' ELSE 'orca' END AS venue,
    CASE WHEN event_id % 10 = 0 THEN value / 150.0 ELSE value END AS sol
  FROM (SELECT event_id, epoch_us(ts) AS us, user_id AS wallet, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, event_type, value FROM events)
  WHERE event_type <> 'error'"""

TRADES_CTE = f"""
trades AS ({TRADE_ROWS}),
failed AS (SELECT event_id, epoch_us(ts) AS us, user_id AS wallet FROM events WHERE event_type = 'error'),
tokens AS (SELECT token, min(us) AS first_seen, token * 13 % 150 AS creator, (token + 1) * 1e6 AS supply FROM trades GROUP BY token),
wallets AS (SELECT wallet, min(us) AS first_seen, max(us) AS last_seen, wallet % 17 = 0 AS tracked FROM trades GROUP BY wallet)"""

PRELUDE = "WITH RECURSIVE " + TRADES_CTE.strip()
POSITIONS = PRELUDE + "," + _FOLD.format(name="positions", source="trades", order="event_id")
LINE_POSITIONS = (
    "WITH RECURSIVE line_trades AS (SELECT o_custkey % 200 AS wallet, l_partkey % 20 AS token, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, "
    "l_quantity AS amount, l_extendedprice AS sol, epoch_us(l_shipdate) AS us, " + ", ".join(LINE_ORDER) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey),"
    + _FOLD.format(name="positions", source="line_trades", order=", ".join(LINE_ORDER))
)
