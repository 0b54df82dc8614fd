"""Streaming queries, each run to the end of the events at hand and compared with SQL over the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.decisions import decide
from ..sources.bindings import DAY, HOUR, NOW, POSITIONS, PRELUDE, trades, wallets
from ..sources.tables import scratch
from ..streaming import folds as fd
from ..streaming import jobs as st
from ..streaming import ledger as lg
from ..streaming import ordered as od
from .base import _POSITION, _POSITION_R, _POSITION_SQL, book
from .catalog import Catalog, r6
from .jobs import START
from .judgement import DECISION, POLICY, decision_sql, decision_state, with_state

C = Catalog()
LATE_MS = 600_000
#: When all that waits has come out: the last day has ended, and the clock has passed it.
END = NOW + HOUR


def _folder(spark, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _trades(spark, folder: str, files: int | None = None, glob: str = "events.parquet"):
    return st.event_stream(spark, folder, files, glob).filter("side <> 'failed'")


@C.add("SELECT user_id AS wallet, count(*) AS n FROM events GROUP BY 1")
def j01_ttl_dedup(spark, sf_dir):
    s = st.event_stream(spark, sf_dir)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return st.finish(st.dedup(twice, ["event_id"])).groupBy("wallet").agg(F.count(F.lit(1)).alias("n"))


@C.add(PRELUDE + " SELECT event_id, wallet % 17 = 0 AS is_priority FROM trades")
def j02_priority_lane(spark, sf_dir):
    followed = wallets(trades(spark, sf_dir)).filter("tracked")
    s = st.priority_lane(st.event_stream(spark, sf_dir).filter("side <> 'failed'"), followed)
    return st.finish(s.select("event_id", "is_priority"))


@C.add(PRELUDE + f" SELECT event_id, event_id % 9 < 5 AS done, CAST(least(event_id % 9 + 1, 5) AS INT) AS attempt, CAST(least(floor((us - {START}) / {10 * DAY}), 2) + least(event_id % 9, 4) AS INT) AS batch FROM trades")
def j03_bounded_attempts(spark, sf_dir):
    """A trade succeeds at its (event_id % 9 + 1)-th attempt; five are made, each by the batch after the one before."""
    lane = lg.Retries(spark, _folder(spark, "retries"), lambda r: r.withColumn("ok", F.col("attempt") >= F.col("event_id") % 9))
    folder = st.dealt_files(spark, sf_dir, F.least(F.floor((F.col("us") - START) / (10 * DAY)), F.lit(2)))
    s = _trades(spark, folder, 1, "*.parquet").select("event_id")
    st.Run(spark).go(s, batch=lambda df, n: lane.batch(df, n) or df.limit(0))
    lane.drain()
    return lane.outcomes().select("event_id", "done", "attempt", F.col("batch").cast("int").alias("batch"))


def positions_of(spark, stream, late_ms: int = LATE_MS):
    """Positions of a stream, run to its end and started again on its checkpoint; and its late rows."""
    columns = ["event_id", "side", "amount", "sol"]
    made = st.to_the_end(spark, lambda run: od.in_order(run.ticks(stream().filter("sol is not null")), ["wallet", "token"], columns, fd.POSITIONS, late_ms), END + late_ms * 1000)
    return fd.latest_positions(od.on_time(made)), od.late_rows(made, ["wallet", "token"])


@C.add(POSITIONS + _POSITION_SQL)
def j04_stateful_positions(spark, sf_dir):
    p, _ = positions_of(spark, lambda: _trades(spark, sf_dir))
    return p.select(*_POSITION, *r6(*_POSITION_R))


_SLIDES = [("5 minutes", "1 minute", 60_000_000, 5), ("1 hour", "10 minutes", 600_000_000, 6), ("24 hours", "6 hours", 21_600_000_000, 4)]


@C.add(PRELUDE + " " + " UNION ALL ".join(f"SELECT '{w}' AS width, token, (us // {k} - i) * {k} AS start_us, count(*) AS n, CAST(sum(CAST(quote AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM trades, range({n}) AS r(i) GROUP BY ALL" for w, _, k, n in _SLIDES))
def j05_sliding_token_windows(spark, sf_dir):
    out = None
    for width, step, _, _ in _SLIDES:
        got = st.finish(st.sliding(st.event_stream(spark, sf_dir), width, step, ["token"]), "complete")
        got = got.select(F.lit(width).alias("width"), "token", F.unix_micros("w.start").alias("start_us"), "n", "volume")
        out = got if out is None else out.unionByName(got)
    return out


@C.add(PRELUDE + ", w AS (SELECT (us // 60000000 - i) * 60000000 AS start_us, quote, wallet FROM trades, range(60) AS r(i)) SELECT start_us, count(*) AS n, CAST(sum(CAST(quote AS DECIMAL(18,2))) AS DOUBLE) AS volume, count(DISTINCT wallet) AS wallets FROM w GROUP BY 1")
def j06_market_series(spark, sf_dir):
    """The last hour's totals at every minute; each trade makes a rise and a fall, none is copied into its windows."""
    cents = (F.col("quote").cast("decimal(18,2)") * 100).cast("long").alias("cents")

    def made(run):
        s = run.ticks(_trades(spark, sf_dir).select("ts", "us", "event_id", "wallet", cents))
        return od.in_order(s, ["wallet"], ["event_id", "cents"], fd.hour_steps(), LATE_MS, idle_ms=3_600_000)

    return fd.hour_series(od.on_time(st.to_the_end(spark, made, END)))


@C.add(PRELUDE + f""", d AS (SELECT us // {6 * HOUR} AS window_index, avg(quote) AS price FROM trades GROUP BY 1),
c AS (SELECT window_index, (price - lag(price) OVER (ORDER BY window_index)) / abs(lag(price) OVER (ORDER BY window_index)) * 100 AS pct, row_number() OVER (ORDER BY window_index) AS rn FROM d),
l AS (SELECT rn, window_index, 'sideways' AS label FROM c WHERE rn = 1 UNION ALL
  SELECT c.rn, c.window_index, CASE WHEN c.pct IS NULL THEN 'sideways' WHEN c.pct > 3 THEN 'bull' WHEN c.pct < -3 THEN 'bear' WHEN l.label = 'bull' AND c.pct > 2 THEN 'bull' WHEN l.label = 'bear' AND c.pct < -2 THEN 'bear' ELSE 'sideways' END FROM l JOIN c ON c.rn = l.rn + 1)
SELECT window_index, label FROM l""")
def j07_regime_windows(spark, sf_dir):
    """Each finished window gets its label from kept state, which goes after a month without trades."""

    def made(run):
        s = run.ticks(_trades(spark, sf_dir)).withWatermark("ts", st.LATE)
        w = s.groupBy(F.window("ts", "6 hours").alias("w")).agg(F.avg("quote").alias("price")).filter("price is not null")
        return od.in_turn(w.withColumn("us", F.unix_micros("w.start")).withColumn("market", F.lit("all")), ["market"], ["price"], fd.LABELS, 30 * 86_400_000)

    got = st.to_the_end(spark, made, END + 12 * HOUR)
    return got.select(F.floor(F.col("us") / (6 * HOUR)).alias("window_index"), "label")


@C.add(PRELUDE + ", o AS (SELECT token, us, event_id, row_number() OVER (PARTITION BY token ORDER BY us, event_id) AS rn FROM trades WHERE side = 'buy'), f AS (SELECT token, us, event_id, rn, us AS last_us, TRUE AS allowed FROM o WHERE rn = 1 UNION ALL SELECT o.token, o.us, o.event_id, o.rn, CASE WHEN o.us - f.last_us >= 3600000000 THEN o.us ELSE f.last_us END, o.us - f.last_us >= 3600000000 FROM f JOIN o ON o.token = f.token AND o.rn = f.rn + 1) SELECT event_id, allowed FROM f")
def j08_cooldown_state(spark, sf_dir):
    return st.finish(st.cooldown(st.event_stream(spark, sf_dir), 3600), "update")


@C.add(PRELUDE + f", v AS (SELECT us // {DAY} AS day, us, event_id, sum(CAST(CASE WHEN side = 'sell' THEN quote ELSE -quote END AS DECIMAL(18,2))) OVER (PARTITION BY us // {DAY} ORDER BY us, event_id) AS running FROM trades) SELECT day, CAST(arg_max(running, (us, event_id)) AS DOUBLE) AS pnl, min(CASE WHEN running <= -500 THEN us END) AS tripped_us FROM v GROUP BY day")
def j09_daily_loss_counter(spark, sf_dir):
    """A trip comes out with the row that makes it, a day's total when midnight has passed."""
    signed = F.when(F.col("side") == "sell", F.col("quote")).otherwise(-F.col("quote")).cast("decimal(18,2)")

    def made(run):
        s = _trades(spark, sf_dir).select("ts", "us", "event_id", F.floor(F.col("us") / DAY).alias("day"), (signed * 100).cast("long").alias("cents"))
        return od.in_order(run.ticks(s), ["day"], ["event_id", "cents"], fd.daily_loss(50_000), LATE_MS)

    days = od.on_time(st.to_the_end(spark, made, END)).filter("ended")
    return days.select("day", (F.col("cents") / 100).alias("pnl"), "tripped_us")


@C.add(PRELUDE + ", e AS (SELECT wallet, row_number() OVER (PARTITION BY wallet ORDER BY us, event_id) AS i, count(*) OVER (PARTITION BY wallet) AS n, quote / 100 - 0.5 AS roi FROM trades WHERE side = 'sell') SELECT wallet, max(n) AS n, round(sum(0.25 * power(0.75, n - i) * roi), 6) AS ew FROM e GROUP BY wallet")
def j10_leader_ranking(spark, sf_dir):
    """Outcomes in order of time, whatever order they come in; a wallet idle for a quarter of a year is forgotten."""

    def made(run):
        s = _trades(spark, sf_dir).filter("side = 'sell'").withColumn("roi", F.col("quote") / 100 - 0.5)
        return od.in_order(run.ticks(s), ["wallet"], ["event_id", "roi"], fd.ew_rank(), LATE_MS, idle_ms=90 * 86_400_000)

    got = od.on_time(st.to_the_end(spark, made, END))
    return got.groupBy("wallet").agg(F.max("n").alias("n"), F.round(F.max_by("ew", "n"), 6).alias("ew"))


@C.add(" UNION ALL ".join(f"SELECT * FROM ({decision_sql(START + k * 10 * DAY, START + (k + 1) * 10 * DAY if k < 2 else None)} SELECT event_id, {DECISION}, {k} AS batch FROM de)" for k in range(3)))
def j11_stream_decisions(spark, sf_dir):
    """Each batch of buys is judged by the batch function and all of its gates, on the snapshot finished before the batch."""
    known = lg.Snapshots(spark, _folder(spark, "snapshots"), decision_state)
    folder = st.dealt_files(spark, sf_dir, F.least(F.floor((F.col("us") - START) / (10 * DAY)), F.lit(2)))

    def batch(df, n):
        rows = lg.Versions(spark, f"{known.folder}/batches").write(df, n)
        state = known.before(n) or decision_state(rows.limit(0))
        d = decide(with_state(rows.filter("side = 'buy'"), state), **POLICY)
        out = d.select("event_id", "decision", F.size(F.filter("gates", lambda g: ~g["passed"])).alias("failed"), F.lit(n).alias("batch"))
        out = lg.Versions(spark, f"{known.folder}/judged").write(out, n)
        known.take(rows, n)  # only now, so that no batch sees its own rows
        return out

    return st.Run(spark).go(_trades(spark, folder, 1, "*.parquet"), batch=batch)


@C.add(PRELUDE + " SELECT wallet, max(us) AS watermark_us, count(*) AS n FROM trades GROUP BY wallet")
def j12_incremental_watermark(spark, sf_dir):
    """A kept table that equals the batch aggregate after every batch."""
    kept = lg.Aggregate(spark, _folder(spark, "watermarks"), ["wallet"], {"watermark_us": F.max, "n": F.sum}, every=2)
    folder = st.dealt_files(spark, sf_dir, F.col("event_id") % 4)
    at = {"n": 0}

    def batch(df, n):
        kept.apply(df.select("wallet", F.col("us").alias("watermark_us"), F.lit(1).cast("long").alias("n")), n)
        at["n"] = n
        return df.limit(0)

    st.Run(spark).go(_trades(spark, folder, 1, "*.parquet"), batch=batch)
    return kept.current(at["n"])


@C.add(POSITIONS + " SELECT count(*) AS episodes, count(*) FILTER (status = 'closed') AS closed, TRUE AS same FROM positions")
def j04_batch_equals_stream(spark, sf_dir):
    a, (b, _) = book(spark, sf_dir), positions_of(spark, lambda: _trades(spark, sf_dir))
    cols = [*_POSITION, *_POSITION_R]
    apart = a.select(cols).exceptAll(b.select(cols)).agg((F.count(F.lit(1)) == 0).alias("same"))
    return b.agg(F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("status") == "closed").alias("closed")).crossJoin(apart)


@C.add(POSITIONS + _POSITION_SQL)
def j04_positions_of_shuffled_files(spark, sf_dir):
    """Events up to two days out of order over seven files, a batch each, folded by event time."""
    apart = F.pmod(F.xxhash64("event_id"), F.lit(2 * DAY))
    folder = st.dealt_files(spark, sf_dir, F.floor((F.col("us") + apart - START) / (5 * DAY)))
    p, late = positions_of(spark, lambda: _trades(spark, folder, 1, "*.parquet"), late_ms=7 * 86_400_000)
    return p.select(*_POSITION, *r6(*_POSITION_R))
