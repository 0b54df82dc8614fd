"""Hand-computed cases of single operators."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.operators import decisions as dc
from ledgerloom.operators import episodes, pointers
from ledgerloom.operators import evaluation as ev
from ledgerloom.operators import patterns as pt
from ledgerloom.operators import positions as ps
from ledgerloom.operators import regime as rg
from ledgerloom.operators import risk as rk
from ledgerloom.operators import sharing as sh
from ledgerloom.operators import timeops as tm
from ledgerloom.operators import vetting as vt
from ledgerloom.operators import wallets as wl
from ledgerloom.sources import rawtx as rx
from ledgerloom.sources import tables as tb
from ledgerloom.sources.bindings import HOUR

S = 1_000_000
TRADE = "wallet long, token long, us long, event_id long, side string, amount double, sol double"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def fold(spark, *trades):
    rows = [(1, 1, t * S, i, side, float(a), None if q is None else float(q)) for i, (t, side, a, q) in enumerate(trades)]
    return ps.fold_positions(spark.createDataFrame(rows, TRADE), ["event_id"]).orderBy("episode").collect()


def test_position_cases(spark):
    p = fold(spark, (0, "buy", 1000, 2))[0]
    assert (p.status, p.avg_entry, p.remaining) == ("open", 0.002, 1000)
    p = fold(spark, (0, "buy", 1000, 2), (1800, "sell", 1000, 3))[0]
    assert (p.status, p.pnl, p.roi, p.hold_s) == ("closed", 1, 0.5, 1800)
    p = fold(spark, (0, "buy", 1000, 2), (9, "sell", 400, 1.6))[0]
    assert p.status == "open" and p.pnl == pytest.approx(0.8)
    assert [x.status for x in fold(spark, (0, "buy", 100, 1), (1, "sell", 100, 2), (2, "buy", 50, 1))] == ["closed", "open"]
    p = fold(spark, (0, "sell", 10, 4))[0]
    assert (p.status, p.hold_s, p.roi, p.pnl) == ("closed", 0, None, 4)
    assert fold(spark, (0, "buy", 1, None)) == []


def test_drawdown(spark):
    rows = [(1, k, 1, k * S, float(x)) for k, x in enumerate((2, -1, 3, -2, 1, -3))]
    d = ps.max_drawdown(spark.createDataFrame(rows, "wallet long, token long, episode long, closed_us long, pnl double")).first()
    assert (d.max_drawdown_sol, d.max_drawdown_pct) == (4, pytest.approx(4 / 4))


def test_confidence_prior_and_range(spark):
    schema = "wallet long, closed_position_count long, win_count long, profit_factor double, roi_std double, pnl_30d_sol double"
    rows = [(1, 0, 0, None, None, None), (2, 80, 52, 2.5, 0.4, 25.0), (3, 60, 10, 0.3, 2.5, -15.0)]
    s = {r.wallet: r.confidence_score for r in wl.confidence(spark.createDataFrame(rows, schema)).collect()}
    assert s[1] == 30 and s[2] > 60 and s[3] < 30


def test_scalars(spark):
    assert one(spark, money.bucket_label(F.lit(60), money.ENTRY_DELAY)) == "1-10m"
    assert one(spark, money.scale(F.lit(5.0), 5, 5, 1.0)) == 1
    assert one(spark, money.finite(F.lit("inf"))) is None and one(spark, money.finite(F.lit("x"), F.lit(2.0))) == 2
    assert one(spark, money.quantize_sol(F.lit(0.0000000025))) == pytest.approx(2e-9)
    assert one(spark, money.price_quote(F.lit(0.0), F.lit(1.0))) is None
    size = lambda mode, leader, room, **k: one(spark, money.copy_size(mode, F.lit(leader), F.lit(room), **k)).size_sol
    assert size("fixed", 1.0, 9.0, fixed=0.3, most=0.2) == 0.2
    assert size("percent", 4.0, 0.1, percent=10) == 0.1 and size("fixed", 1.0, 0.0) == 0


def test_component_tables(spark):
    cases = [("", "", 0), ("P", "", 100), ("", "P", 80), (None, None, 60), ("", None, 60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    assert [r.x for r in df.select("i", rk.authority(F.col("a"), F.col("b")).alias("x")).orderBy("i").collect()] == [c[2] for c in cases]
    shares = [(None, 50), (0.10, 0), (0.20, 0), (0.45, 50), (0.70, 100), (0.95, 100)]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(shares)], "i int, s double")
    assert [r.x for r in df.select("i", rk.holders(F.col("s")).alias("x")).orderBy("i").collect()] == pytest.approx([s[1] for s in shares])
    lp = [(True, True, 0.5, 0.1, 40), (False, True, 0.95, 0.1, 0), (False, True, 0.90, 0.1, 0), (False, True, 0.6, 0.1, 40), (False, True, 0.2, 0.6, 90), (False, True, 0.6, 0.6, 40), (False, False, None, None, 50), (False, True, None, 0.1, 50)]
    df = spark.createDataFrame([(i, *x[:4]) for i, x in enumerate(lp)], "i int, c boolean, h boolean, b double, t double")
    assert [r.x for r in df.select("i", rk.lp(F.col("c"), F.col("h"), F.col("b"), F.col("t")).alias("x")).orderBy("i").collect()] == pytest.approx([x[4] for x in lp])


def test_trend_hysteresis(spark):
    cases = [(2.5, "bull", "bull"), (2.0, "bull", "sideways"), (-2.5, "bear", "bear"), (-2.0, "bear", "sideways"), (2.5, "sideways", "sideways"), (None, "bull", "sideways"), (3.1, None, "bull")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, p double, b string")
    assert [r.x for r in df.select("i", rg.trend_label(F.col("p"), F.col("b")).alias("x")).orderBy("i").collect()] == [c[2] for c in cases]


def test_ew_ranking(spark):
    def factor(rois):
        df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(rois)], "w long, i long, r double")
        return dc.ew_ranking(df, "w", ["i"], "r").first().factor

    assert factor([-0.5] * 4) == 1 and factor([-0.5] * 5) < 1 and 1 < factor([-0.5] * 5 + [0.6] * 20) <= 1.2 and factor([-1] * 10) == 0.5


def test_quintiles_and_whales(spark):
    rows = [(k, 1, 1, "closed", 0, 0, float(k), 1.0, 0.1) for k in range(1, 11)]
    schema = "wallet long, token long, episode long, status string, opened_us long, closed_us long, bought_sol double, pnl double, roi double"
    got = pt.position_size(spark.createDataFrame(rows, schema), 1).collect()
    assert sorted((r.key, r.n) for r in got) == [(f"q{i}", 2) for i in range(1, 6)]
    rows = [(k, 1, 1, "closed", 0, 0, 100.0 if k == 9 else 1.0, 1.0, 0.1) for k in range(10)]
    closed = spark.createDataFrame(rows, schema)
    now = 100 * HOUR
    t = [(9, 5, now - HOUR, "buy", 10.0, "wsol")] * 3 + [(9, 5, now - HOUR, "sell", 4.0, "wsol"), (9, 5, now - 30 * HOUR, "buy", 500.0, "wsol")]
    flow = pt.whale_flow(closed, spark.createDataFrame(t, "wallet long, token long, us long, side string, quote double, quote_kind string"), now, min_evidence=1).first()
    assert (flow.net_flow, flow.n) == (26, 4)


def test_asof_ties_and_horizon(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "k long, t long")
    right = spark.createDataFrame([(1, 10, "a"), (1, 10, "b"), (1, 15, "c"), (1, 40, "d")], "k long, rt long, v string")
    back = tm.asof_backward(left, right, ["k"], "t", "rt", ["v"], tie=["v"]).collect()
    assert sorted((r.k, r.t, r.v) for r in back if r.v) == [(1, 10, "b"), (1, 20, "c")] and sum(r.v is None for r in back) == 1
    ahead = {(r.k, r.t): r.v for r in tm.asof_forward(left, right, ["k"], "t", "rt", ["v"], horizon=10, tie=["v"]).collect()}
    assert ahead == {(1, 10): "c", (1, 20): None, (2, 5): None}


def test_calibration_and_auc(spark):
    rows = [("m", p, y) for p, y in ((0.0, 0), (0.1, 0), (0.1000001, 1), (0.5, 1), (0.9, 1), (0.9, 0), (1.0, 1))]
    df = spark.createDataFrame(rows, "model string, prob double, label int")
    bins = {r.bin: r.n for r in ev.calibration(df).collect()}
    assert len(bins) == 10 and sum(bins.values()) == 7 and bins[0] == 2 and bins[1] == 1 and bins[8] == 2 and bins[9] == 1
    pairs = [(a, b) for _, a, y in rows if y for _, b, z in rows if not z]
    assert ev.auc(df).first().auc == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))
    assert ev.auc(df.filter("label = 1")).first().auc is None


def test_ring_is_suspicious(spark):
    t = [(w, k, k) for w in range(1, 6) for k in range(4)] + [(9, 50 + k, k) for k in range(4)]
    got = {r.wallet: r for r in vt.counterparty_signal(spark.createDataFrame(t, "wallet long, token long, us long")).collect()}
    assert got[1].ring and got[1].cast_ratio == 1 and not got[9].ring
    v = vt.verdicts(spark.createDataFrame([(1, True, 0, False, "f", 4), (2, False, 0, False, None, 3), (3, False, 0, False, "f", 4)], "wallet long, ring boolean, peers long, insider boolean, funder string, tokens long"))
    assert {r.wallet: r.verdict for r in v.collect()} == {1: "suspicious", 2: "inconclusive", 3: "clear"}


def test_weight_tuning_and_loading(spark):
    rows = [("rug" if k < 20 else "profit", *((90, 50, 30, 50, 50, 50) if k < 20 else (40, 50, 60, 50, 50, 50))) for k in range(60)]
    df = spark.createDataFrame(rows, "outcome string, " + ", ".join(f"{c} long" for c in rk.COMPONENTS))
    w = {r.name: r.weight for r in rk.tune(df).collect()}
    assert sum(w.values()) == pytest.approx(1) and w["authority"] > rk.WEIGHTS["authority"] and w["lp"] < rk.WEIGHTS["lp"]
    assert {r.name: r.weight for r in rk.tune(df.limit(40)).collect()} == rk.WEIGHTS
    bad = spark.createDataFrame([("authority", float("nan"))], "name string, weight double")
    assert {r.name: round(r.weight, 9) for r in rk.load_weights(bad).collect()} == rk.WEIGHTS


def test_alert_boundaries(spark):
    schema = "minutes_since_trade double, failed_1h double, trades_1h double, emergency_stop boolean, daily_pnl double, daily_limit double, latest_auc double, minutes_since_regime double"
    fired = lambda *row: {r.name for r in dc.alerts(spark.createDataFrame([row], schema)).collect()}
    assert fired(None, None, None, None, None, None, None, None) == set()
    assert fired(15.0, 5.0, 10.0, False, -0.79, 1.0, 0.55, 120.0) == set()
    assert len(fired(15.1, 5.1, 10.0, True, -0.8, 1.0, 0.54, 120.1)) == 6


def test_messages_and_upserts(spark):
    rows = ['{"id":1,"wallet":"w","mint":"m","side":"buy","quote":"WSOL","quote_amount":"1.5"}', "{broken", '{"id":2,"wallet":"w","mint":"m","side":"hold","quote":"WSOL","quote_amount":"1"}', '{"id":3,"mint":"m","side":"buy","quote":"WSOL","quote_amount":"1"}', '{"id":4,"wallet":"w","mint":"m","side":"buy","quote":"USDC","quote_amount":"1"}', '{"id":5,"wallet":"w","mint":"m","side":"sell","quote":"WSOL","quote_amount":"?"}']
    good, bad = tb.parse_messages(spark.createDataFrame([(r,) for r in rows], "value string"))
    assert [r.id for r in good.collect()] == [1] and sorted(r.reason for r in bad.collect()) == ["amount", "entity", "malformed", "quote", "side"]


def test_append_skips_known_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *k: spark.createDataFrame([(x, x) for x in k], "id long, v long")
    for part in (df(1, 2, 2), df(2, 3)):
        tb.append(part, path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_raw_documents(spark, tmp_path):
    import json

    owner, mint = "W" * 40, "M" * 40
    bal = lambda m, amount, dec=9: {"accountIndex": 1, "mint": m, "owner": owner, "uiTokenAmount": {"amount": str(amount), "decimals": dec}}

    def doc(sig, pre, post, native=(10**9, 10**9 - 5000), err=None):
        return {"slot": 1, "blockTime": 2, "transaction": {"signatures": [sig], "message": {"accountKeys": [{"pubkey": owner, "signer": True}], "instructions": [{"programId": "p", "accounts": ["a"]}]}}, "meta": {"err": err, "fee": 5000, "preBalances": [native[0]], "postBalances": [native[1]], "preTokenBalances": pre, "postTokenBalances": post, "logMessages": [], "innerInstructions": []}}

    docs = [
        doc("wsol", [bal(rx.WSOL, 2 * 10**9)], [bal(rx.WSOL, 5 * 10**8), bal(mint, 3000, 0)]),
        doc("native", [bal(mint, 5000, 0)], [], (10**9, 10**9 + 2 * 10**8 - 5000)),
        doc("stable", [bal(rx.USDC, 9 * 10**6, 6)], [bal(mint, 7, 0)]),
        doc("swap", [bal(mint, 4, 0)], [bal("N" * 40, 6, 0)]),
        doc("alone", [], [bal(mint, 4, 0)]),
        doc("failed", [bal(rx.WSOL, 10**9)], [bal(mint, 4, 0)], err={"x": 1}),
    ]
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(d))
    got = {(r.signature, r.mint[0], r.side, round(r.token_amount, 6), r.quote_mint[:4], round(r.quote_amount, 6)) for r in rx.infer_swaps(rx.read_documents(spark, str(tmp_path))).collect()}
    assert got == {("wsol", "M", "buy", 3000, "So11", 1.5), ("native", "M", "sell", 5000, "So11", 0.2), ("stable", "M", "buy", 7, "EPjF", 9), ("swap", "M", "sell", 4, "NNNN", 6), ("swap", "N", "buy", 6, "MMMM", 4)}


def test_promotion_of_a_metric_over_none(spark):
    from ledgerloom.operators import datasets as ds

    rows = [(1, None), (2, 0.6), (3, None), (4, 0.55), (5, 0.6), (6, 0.61)]
    got = {r.version: (r.promoted, r.is_active) for r in ds.promote(spark.createDataFrame(rows, "version long, auc double")).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, False), 4: (False, False), 5: (False, False), 6: (True, True)}


def test_rails_block_and_fail_closed(spark):
    ledger = spark.createDataFrame([(k, 0, 0.0) for k in range(6)] + [(6, 10, 2.0)], "wallet long, open_n long, exposure double")
    streaks = spark.createDataFrame([(0, 0), (1, 5), (2, None)], "wallet long, streak long")
    daily = spark.createDataFrame([(0, 0.0), (3, -1.0), (4, None)], "wallet long, daily_pnl double")
    cooling = spark.createDataFrame([(5,)], "wallet long")
    got = {r.wallet: r.reasons for r in dc.rails(ledger, streaks, daily, cooling).collect()}
    assert got == {0: [], 1: ["failures"], 2: ["unreadable"], 3: ["daily_loss"], 4: ["unreadable"], 5: ["cooldown"], 6: ["max_open", "max_exposure"]}
    assert all(r.reasons[0] == "emergency_stop" for r in dc.rails(ledger, streaks, daily, stopped=True).collect())


def test_labels_equal_the_fold(spark):
    import random

    r = random.Random(4)
    pct = [None] + [r.choice([None, 4.0, 3.5, 2.5, 2.1, 2.0, 1.0, 0.0, -2.0, -2.5, -3.0, -3.5, 3.0]) for _ in range(400)]
    want, label = [], "sideways"
    for p in pct:
        label = "sideways" if p is None else "bull" if p > 3 or (label == "bull" and p > 2) else "bear" if p < -3 or (label == "bear" and p < -2) else "sideways"
        want.append(label)
    got = rg.label_timeline(spark.createDataFrame(list(enumerate(pct)), "window_index long, pct double")).orderBy("window_index").collect()
    assert [x.label for x in got] == want


def test_timeline_join_equals_brute_force(spark):
    import random

    r = random.Random(5)
    line = sorted(r.sample(range(1000), 30)) + [50_000]
    left = [r.randrange(-50, 60_000) for _ in range(200)] + line
    want = [max((t for t in line if t <= x), default=-1) for x in left]
    spans = spark.createDataFrame([(t, t) for t in line], "at long, label long")
    got = tm.asof_timeline(spark.createDataFrame(list(enumerate(left)), "id long, t long"), spans, "t", "at", ["label"], {"label": -1}).orderBy("id").collect()
    assert [x.label for x in got] == want
    assert tm.asof_timeline(spark.range(3).withColumn("t", F.col("id")), spans.limit(0), "t", "at", ["label"]).count() == 3


@pytest.mark.parametrize("heavy,block", [(64, 512), (5, 7), (0, 16)])
def test_pairs_that_share_tokens_equal_brute_force(spark, monkeypatch, heavy, block):
    import random
    from collections import Counter

    monkeypatch.setattr(sh, "HEAVY", heavy)
    monkeypatch.setattr(sh, "BLOCK", block)

    r = random.Random(6)
    held = {w: {0} | set(r.sample(range(25), r.randrange(1, 12))) for w in range(40)}  # everybody holds token 0
    rows = spark.createDataFrame([(w, t) for w, ts in held.items() for t in ts], "wallet long, token long")
    for least in (1, 2, 4):
        want = {(a, b, len(held[a] & held[b])) for a in held for b in held if a != b and len(held[a] & held[b]) >= least}
        assert {tuple(x) for x in sh.sharing(rows, rows, least).collect()} == want
    few = rows.filter("token % 2 = 0")
    half = {w: {t for t in ts if t % 2 == 0} for w, ts in held.items()}
    again = {a: [b for b in held if b != a and len(half[a] & held[b]) >= 3] for a in held}
    want = {(a, None): len(bs) for a, bs in again.items() if bs}
    want |= Counter((a, t) for a, bs in again.items() for b in bs for t in half[a] & held[b])
    assert {(x.wallet, x.token): x.n for x in sh.cast(few, rows, 3).collect()} == want
    assert sh.sharing(rows.limit(0), rows, 1).count() == sh.sharing(rows, rows.limit(0), 1).count() == 0


@pytest.mark.parametrize("few", [10**6, 20, 4])
def test_percentiles_equal_the_builtin(spark, few):
    import random

    from ledgerloom.operators.quantiles import percentiles

    r = random.Random(12)
    rows = [(k % 3, r.choice([None, 0.0, -5.5, 1e300, r.random(), r.expovariate(1) ** 9, float(r.randrange(4))])) for k in range(900)] + [(7, 2.5), (8, None), (9, 1.0), (9, 2.0)]
    df = spark.createDataFrame(rows, "k long, x double")
    shares = [0.0, 0.2, 1 / 3, 0.5, 0.9, 1.0]
    want = df.groupBy("k").agg(F.percentile("x", F.array(*[F.lit(p) for p in shares])).alias("p"), F.count("x").alias("n")).filter("n > 0").collect()
    got = {x.k: (x.population, x.percentiles) for x in percentiles(df, "x", shares, ["k"], few=few).collect()}
    assert got == {x.k: (x.n, x.p) for x in want}
    one = percentiles(df, "x", shares, few=few).first()
    assert one.percentiles == df.agg(F.percentile("x", F.array(*[F.lit(p) for p in shares])).alias("p")).first().p
    none = percentiles(df.limit(0), "x", [0.5]).first()
    assert (none.population, none.percentiles) == (0, [None])


def test_names_are_numbered_over_slices(spark, monkeypatch):
    monkeypatch.setattr(money, "SLICE", 3)
    rows = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(20)], "k long, name string")
    got = [x.name for x in money.dedupe_names(rows, "name", "k").orderBy("k").collect()]
    assert got == [f"{'ab'[k % 2]}" + (f"-{k // 2 + 1}" if k > 1 else "") for k in range(20)]


@pytest.mark.parametrize("span,wait", [(60, 7), (400, 5), (3000, 10), (30, 40)])
def test_cooldown_by_pointers_equals_the_fold(spark, span, wait):
    import random

    r = random.Random(span)
    rows = [(r.choice((1, 1, 1, 2, 3)), r.choice((r.randrange(span), wait * r.randrange(span // 7 + 1))) * S, i) for i in range(250)] + [(9, 5 * S, 900)]
    want, last = {}, {}
    for k, us, i in sorted(rows):
        want[i] = k not in last or us - last[k] >= wait * S
        if want[i]:
            last[k] = us
    buys = spark.createDataFrame(rows, "token long, us long, event_id long")
    for how in (pointers.cooldown, dc.cooldown):
        assert {x.event_id: x.allowed for x in how(buys, "token", wait, ["event_id"]).collect()} == want
    assert pointers.cooldown(buys.limit(0), "token", wait, ["event_id"]).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_backtest_by_pointers_equals_the_fold(spark, seed):
    """A hot token, rows at one time, rows without a price, wallet or token."""
    import random

    r = random.Random(seed)
    rows = [(r.choice((1, 1, 1, 2, 3)), r.randrange(150), i, r.choice((5, 6, 7)), r.choice(("buy", "sell")), r.random() < 0.6, r.choice((1.0, 2.0, 4.0, None, 0.0))) for i in range(400)]
    schema = "token long, us long, event_id long, wallet long, side string, decided boolean, price double"
    t = spark.createDataFrame(rows, schema)
    want = sorted(tuple(x) for x in dc.backtest(t).collect())
    odd = [(None, 1, 900, 5, "buy", True, 1.0), (1, None, 901, 5, "buy", True, 1.0), (1, 1, 902, None, "buy", True, 1.0), (1, 1, 903, 5, "sell", None, float("nan"))]
    assert len(want) > 20
    for slices in (1, 9):
        assert sorted(tuple(x) for x in pointers.backtest(t.unionByName(spark.createDataFrame(odd, schema)), slices).collect()) == want
    assert pointers.backtest(t.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_episodes_by_windows_equal_the_fold(spark, seed):
    """A hot pair, rows at one time, sales down to 0.5 % exactly, amounts of 0, repeated rows, trades without a SOL value."""
    import random

    r = random.Random(seed)
    rows = []
    for i in range(700):
        wallet, side = r.choice((1, 1, 1, 1, 2, None)), r.choice(("buy", "sell"))
        rows.append((wallet, r.choice((1, 1, 2)), r.randrange(200) * S, i, side, float(r.choice((0, 1, 2, 10, 199, 200, 398, 400))), r.choice((None, 0.0, 1.5, 3.0))))
    rows += [(3, 1, k * S, k, side, a, 1.0) for k, (side, a) in enumerate((("buy", 200.0), ("sell", 199.0), ("sell", 0.0), ("buy", 0.0), ("sell", 5.0), ("buy", 7.0)))]
    rows += [(4, 1, S, 1, "buy", 2.0, 1.0)] * 3 + [(4, 1, 2 * S, 2, "sell", 6.0, 9.0)]
    t = spark.createDataFrame(rows, TRADE).withColumn("note", F.lit("x"))

    def plain(df):
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in df.collect()), key=repr)

    got = plain(episodes.windowed(t, ["event_id"]))
    known = lambda found: [x for x in found if x[0] is not None]
    assert known(got) == plain(ps.fold_positions(t.filter("wallet is not null"), ["event_id"])) and len(known(got)) < len(got)
    for hot, slices in ((0, 5), (50, 16), (10**6, 4)):
        assert plain(episodes.sliced(t, ["event_id"], hot, slices)) == got
    assert episodes.windowed(t.limit(0), ["event_id"]).count() == 0 and episodes.sliced(t.limit(0), ["event_id"]).count() == 0


def test_timeline_slices_carry_the_last_row_on(spark):
    """A clustered timeline, rows at its borders, before and after it, and without a time."""
    import random

    r = random.Random(15)
    line = sorted({r.randrange(10**6, 10**6 + 500) for _ in range(120)} | {5, 10**12})
    left = [r.choice((*line, r.randrange(0, 2 * 10**6), r.randrange(10**6, 10**6 + 500), 2 * 10**12, 1)) for _ in range(400)] + [None]
    want = [None if x is None else max((t for t in line if t <= x), default=None) for x in left]
    spans = spark.createDataFrame([(t, t) for t in line] + [(None, 7)], "at long, label long")
    for slices in (1, 4, 64):
        got = tm.asof_timeline(spark.createDataFrame(list(enumerate(left)), "id long, t long"), spans, "t", "at", ["label"], slices=slices).orderBy("id").collect()
        assert [x.label for x in got] == want
