"""Streams with kept state: order of event time, late rows, restarts, expiry, retries, kept tables and snapshots."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import positions as ps
from ledgerloom.streaming import folds as fd
from ledgerloom.streaming import jobs as st
from ledgerloom.streaming import ledger as lg
from ledgerloom.streaming import ordered as od

S = 1_000_000
HOUR = 3600 * S
T0 = 1_704_067_200 * S  # 2024-01-01
TRADE = "us long, event_id long, wallet long, token long, side string, amount double, sol double"


@pytest.fixture
def feed(spark, tmp_path):
    """Files of rows that a stream takes one a batch; more can follow."""

    class Feed:
        def __init__(self):
            self.folder, self.n, self.schema = str(tmp_path / "in"), 0, TRADE

        def put(self, *files):
            for rows in files:
                made = spark.createDataFrame([(T0 + r[0], *r[1:]) for r in rows], TRADE).withColumn("ts", F.timestamp_micros("us"))
                made.coalesce(1).write.parquet(f"{self.folder}/n={self.n}")
                fs, p = lg.file_system(spark, f"{self.folder}/n={self.n}")
                for f in fs.listStatus(p):
                    fs.setTimes(f.getPath(), 1_700_000_000_000 + 1000 * self.n, -1)
                self.n += 1

        def stream(self):
            return spark.readStream.schema(TRADE + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(self.folder)

    return Feed()


def buy(t, i, amount=10.0, sol=10.0, wallet=1):
    return (t, i, wallet, 1, "buy", amount, sol)


def sell(t, i, amount=10.0, sol=30.0, wallet=1):
    return (t, i, wallet, 1, "sell", amount, sol)


def folded(stream, idle_ms=None):
    return od.in_order(stream, ["wallet", "token"], ["event_id", "side", "amount", "sol"], fd.POSITIONS, 600_000, idle_ms)


def by_batch(spark, run):
    """Closed positions with the batch that gave them."""
    out = spark.read.parquet(f"{run.base}/out").filter("not late and status = 'closed'").select("batch", "wallet", "opened_us", "pnl").collect()
    return sorted((r.wallet, (r.opened_us - T0) // S, r.pnl, r.batch) for r in out)


def test_rows_fold_by_event_time_and_late_ones_are_told_apart(spark, feed):
    """The sell's file comes before the buy's; what is behind the clock is late, exactly that, and never folded."""
    feed.put([sell(120 * S, 2)], [buy(60 * S, 1)], [buy(2 * HOUR, 4, 5.0, 5.0)], [buy(300 * S, 3, 1.0, 1.0), buy(2 * HOUR - 600 * S, 5, 5.0, 5.0)], [])
    run = st.Run(spark)
    got = run.go(folded(feed.stream()))
    assert {r.event_id for r in od.late_rows(got, ["wallet", "token"]).collect()} == {3}
    closed = by_batch(spark, run)
    assert [x[:3] for x in closed] == [(1, 60, 20.0)]
    assert closed[0][3] < spark.read.parquet(f"{run.base}/out").agg(F.max("batch")).first()[0] or feed.n  # it came out before the stream ended
    assert od.on_time(got).filter("status = 'open'").count() == 0  # rows within ten minutes of the newest still wait


def test_a_stream_goes_on_where_it_stopped(spark, feed):
    """Waiting rows and open positions outlive the query; a tick lets all come out."""
    run = st.Run(spark)
    feed.put([buy(0, 1)], [buy(HOUR, 2, 10.0, 20.0)])
    run.go(folded(run.ticks(feed.stream())))
    feed.put([sell(2 * HOUR, 4, 20.0, 90.0)], [sell(2 * HOUR - 60 * S, 3, 0.0, 0.0), buy(3 * HOUR, 5, wallet=2)])
    run.go(folded(run.ticks(feed.stream())))
    run.tick(T0 + 9 * HOUR)
    p = fd.latest_positions(od.on_time(run.go(folded(run.ticks(feed.stream()))))).orderBy("wallet").collect()
    assert [(x.wallet, x.episode, x.status, x.trades, x.pnl) for x in p] == [(1, 1, "closed", 4, 60.0), (2, 1, "open", 1, 0.0)]


def test_streamed_positions_equal_the_batch_fold(spark, feed):
    r = random.Random(5)
    rows = []
    for i in range(400):
        t = r.randrange(0, 40 * 3600)
        rows.append((t * S, i, r.randrange(3), 1, r.choice(("buy", "sell")), float(r.randrange(1, 5)), float(r.randrange(1, 50))))
    files = [[] for _ in range(5)]
    for x in sorted(rows, key=lambda x: x[0] + r.randrange(0, 600) * S):
        files[min(x[0] // (8 * HOUR), 4)].append(x)
    feed.put(*files)
    run = st.Run(spark)
    run.go(folded(run.ticks(feed.stream())))
    run.tick(T0 + 60 * HOUR)
    got = run.go(folded(run.ticks(feed.stream())))
    want = ps.fold_positions(spark.createDataFrame([(T0 + x[0], *x[1:]) for x in rows], TRADE), ["event_id"])
    columns = ["wallet", "token", "episode", "status", "opened_us", "closed_us", "trades", "sells", "pnl"]
    have = fd.latest_positions(od.on_time(got))
    assert sorted(have.select(columns).collect(), key=repr) == sorted(want.select(columns).collect(), key=repr)
    assert od.late_rows(got, ["wallet"]).count() == 0


def test_idle_closed_pairs_are_forgotten_and_open_ones_kept(spark, feed):
    """After a day without trades a closed pair starts anew; an open position goes on."""
    feed.put([buy(0, 1), sell(60 * S, 2), buy(0, 3, wallet=2)], [buy(30 * HOUR, 4, wallet=3)], [buy(60 * HOUR, 5), sell(60 * HOUR, 6, wallet=2)], [buy(70 * HOUR, 7, wallet=3)])
    got = od.on_time(st.Run(spark).go(folded(feed.stream(), idle_ms=86_400_000)))
    rows = {(r.wallet, (r.opened_us - T0) // HOUR): (r.episode, r.status) for r in got.orderBy("trades").collect()}
    assert rows[1, 0] == (1, "closed") and rows[1, 60] == (1, "open")  # numbered from 1 again: its state had gone
    assert rows[2, 0] == (1, "closed")
    assert [(p.wallet, p.episode) for p in fd.latest_positions(got).filter("wallet = 1").orderBy("episode").collect()] == [(1, 1), (1, 2)]


def test_daily_losses_trip_when_they_happen(spark, feed):
    """The trip comes from the batch that passes it, the day's total once midnight has passed."""
    feed.put([sell(HOUR, 1, sol=10.0), buy(2 * HOUR, 2, sol=400.0)], [buy(3 * HOUR, 3, sol=200.0)], [buy(5 * HOUR, 4, sol=1.0)], [buy(26 * HOUR, 5, sol=5.0)], [buy(27 * HOUR, 6, sol=5.0)])

    def made(run):
        signed = F.when(F.col("side") == "sell", F.col("sol")).otherwise(-F.col("sol"))
        s = run.ticks(feed.stream()).withColumn("day", F.floor(F.col("us") / (24 * HOUR))).withColumn("cents", (signed * 100).cast("long"))
        return od.in_order(s, ["day"], ["event_id", "cents"], fd.daily_loss(50_000), 600_000)

    run = st.Run(spark)
    run.go(made(run))
    out = spark.read.parquet(f"{run.base}/out").filter("not late").select("batch", "day", "cents", "tripped_us", "ended").orderBy("batch", "ended").collect()
    day = T0 // (24 * HOUR)
    assert [(x.day - day, x.cents, (x.tripped_us - T0) // HOUR, x.ended) for x in out] == [(0, -59_000, 3, False), (0, -59_100, 3, True)]
    assert out[0].batch < out[1].batch
    run.tick(T0 + 50 * HOUR)
    ends = run.go(made(run)).filter("ended").orderBy("day").collect()
    assert [(x.day - day, x.cents, x.tripped_us) for x in ends] == [(0, -59_100, T0 + 3 * HOUR), (1, -1000, None)]


def test_labels_are_kept_between_batches_and_expire(spark, feed):
    prices = [100, 104, 106.5, 107, 100, 97.9, 97.9, 110]
    feed.put(*[[buy(k * HOUR + 60 * S, k, sol=float(p))] for k, p in enumerate(prices)], [buy(200 * HOUR, 90, sol=104.0)], [buy(201 * HOUR, 91, sol=109.0)], [buy(203 * HOUR, 92)])

    def made(idle_ms):
        w = feed.stream().withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.avg("sol").alias("price"))
        return od.in_turn(w.withColumn("us", F.unix_micros("w.start")).withColumn("market", F.lit("all")), ["market"], ["price"], fd.LABELS, idle_ms)

    got = [(r.label, r.pct is None) for r in st.Run(spark).go(made(48 * 3_600_000)).orderBy("us").collect()]
    label, want, before = "sideways", [], None
    for p in prices:
        label = fd.sticky(label, None if before is None else (p - before) / before * 100)
        want.append((label, before is None))
        before = p
    assert "bull" in dict(want) and "bear" in dict(want)
    assert got == [*want, ("sideways", True), ("bull", False)]  # after days without trades nothing is known of the price before


def test_hour_steps_count_wallets_exactly():
    r = random.Random(9)
    trades = [(w, r.randrange(0, 400) * 20 * S, i, r.randrange(-500, 500)) for i, w in enumerate(r.choices(range(4), k=150))]
    steps = Counter(), Counter(), Counter()
    for w in range(4):
        mine, state = sorted(t[1:] for t in trades if t[0] == w), None
        while mine:  # in parts, as batches give them
            k = r.randrange(1, 9)
            rows, state = fd.hour_steps(10).step((w,), state, mine[:k])
            mine = mine[k:]
            for minute, *values in rows:
                for total, v in zip(steps, values):
                    total[minute] += v
    for start in range(-10, 140):
        inside = [t for t in trades if start <= t[1] // fd.MINUTE < start + 10]
        want = len(inside), sum(t[3] for t in inside), len({t[0] for t in inside})
        assert tuple(sum(v for m, v in total.items() if m <= start) for total in steps) == want


def test_failed_rows_wait_for_later_batches(spark, tmp_path):
    """Row k fails k times; each attempt is made once, by the batch after the last, and the sixth failure is final."""
    lane = lg.Retries(spark, f"file://{tmp_path}", lambda r: r.withColumn("ok", F.col("attempt") >= F.col("id")), attempts=5)
    lane.batch(spark.range(8), 0)
    first = {r.id for r in lane.outcomes().collect()}
    lane.batch(spark.range(100, 101).withColumn("id", F.lit(0).cast("long")), 1)
    lane.batch(spark.range(0), 2)
    lane.batch(spark.range(0), 2)  # run again after a failure
    lane.drain()
    out = sorted((r.id, r.attempt, r.done, r.batch) for r in lane.outcomes().collect())
    assert first == {0}
    assert out == sorted([(0, 1, True, 0), (0, 1, True, 1), (1, 2, True, 1), (2, 3, True, 2), (3, 4, True, 3), (4, 5, True, 4), (5, 5, False, 4), (6, 5, False, 4), (7, 5, False, 4)])
    assert Counter(r.id for r in lane.attempts_made().collect()) == Counter({0: 2, 1: 2, 2: 3, 3: 4, 4: 5, 5: 5, 6: 5, 7: 5})


def test_kept_aggregates_equal_the_batch_after_every_batch(spark, tmp_path):
    r = random.Random(2)
    kept = lg.Aggregate(spark, f"file://{tmp_path}", ["k"], {"n": F.sum, "top": F.max, "low": F.min}, every=3)
    seen = []
    for n in range(8):
        rows = [(r.randrange(5), 1, v := r.randrange(100), v) for _ in range(r.randrange(1, 9))]
        seen += rows
        for _ in range(1 + (n in (2, 3, 6))):  # some batches run twice
            kept.apply(spark.createDataFrame(rows, "k long, n long, top long, low long"), n)
        want = {k: (sum(x[1] for x in seen if x[0] == k), max(x[2] for x in seen if x[0] == k), min(x[3] for x in seen if x[0] == k)) for k in {x[0] for x in seen}}
        assert {x.k: (x.n, x.top, x.low) for x in kept.current(n).collect()} == want
    assert len(kept.parts.numbers()) <= 6 and len(kept.base.numbers()) <= 2


def test_a_batch_sees_the_snapshot_before_it_and_nothing_of_its_own(spark, tmp_path):
    shots = lg.Snapshots(spark, f"file://{tmp_path}", lambda rows: {"counts": rows.groupBy("k").count()})
    saw = []
    for n in range(3):
        for _ in range(1 + (n == 1)):  # the second batch runs twice
            before = shots.before(n)
            saw.append(None if before is None else {r.k: r["count"] for r in before["counts"].collect()})
            shots.take(spark.createDataFrame([(n,), (0,)], "k long"), n)
    assert saw == [None, {0: 2}, {0: 2}, {0: 3, 1: 1}]


@pytest.mark.parametrize("lanes", [1, 3])
def test_keys_that_share_a_lane_keep_apart(spark, feed, lanes):
    """Many pairs on few lanes fold as the batch does, over three releases; their late rows are told apart."""
    r = random.Random(3)
    rows = [(k * HOUR + r.randrange(0, 3000) * S, 100 * k + i, r.randrange(30), r.randrange(2), r.choice(("buy", "sell")), float(r.randrange(1, 5)), 2.0) for k in range(4) for i in range(100)]
    late = [(60 * S, 900 + i, i, 1, "buy", 1.0, 1.0) for i in range(5)]
    feed.put(*[rows[100 * k : 100 * k + 100] for k in range(4)], late)
    run = st.Run(spark)
    made = lambda: od.in_order(run.ticks(feed.stream()), ["wallet", "token"], ["event_id", "side", "amount", "sol"], fd.POSITIONS, 600_000, lanes=lanes)
    run.go(made())
    run.tick(T0 + 60 * HOUR)
    got = run.go(made())
    want = ps.fold_positions(spark.createDataFrame([(T0 + x[0], *x[1:]) for x in rows], TRADE), ["event_id"])
    columns = ["wallet", "token", "episode", "status", "opened_us", "closed_us", "trades", "sells", "pnl"]
    assert sorted(fd.latest_positions(od.on_time(got)).select(columns).collect(), key=repr) == sorted(want.select(columns).collect(), key=repr)
    assert {x.event_id for x in od.late_rows(got, ["wallet", "token"]).collect()} == {x[1] for x in late}
