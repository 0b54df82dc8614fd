"""What a task holds doesn't grow with the tables."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import raw
from ledgerloom.plans.registry import queries

SF = "/root/testdata/sf0.001"


def exchanges(df):
    """How often a plan shuffles or sends rows, and how often it joins."""
    plan = df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
    return plan[1].count("Exchange "), plan[0].count("Join ")


@pytest.mark.parametrize("name", ["c02_token_deltas", "c03_native_delta", "c05_c07_swap_inference", "c06_matching_adapters", "a08_creators_of_mints", "c10_side_audit"])
def test_documents_are_dealt_over_tasks_of_so_many_items(spark, name, monkeypatch):
    monkeypatch.setattr(raw, "ROWS", 100)
    items = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert raw.documents(spark, SF).rdd.getNumPartitions() == -(-items // 100)
    if not name.startswith(("a08", "c10")):
        assert exchanges(queries()[name](spark, SF).select("*"))[1] <= (2 if name.startswith("c06") else 1)  # orders and items, and the venues


def test_pairs_that_share_over_several_blocks(spark, monkeypatch):
    """A block goes to each other one as one row, and both forms give the pairs that a join gives."""
    from ledgerloom.operators import sharing as sh

    for name, n in (("BLOCK", 16), ("HEAVY", 6)):
        monkeypatch.setattr(sh, name, n)
    h = spark.range(600).select((F.col("id") % 60 * 7).alias("wallet"), F.pmod(F.xxhash64("id"), F.when(F.col("id") % 3 == 0, 5).otherwise(200)).alias("token")).distinct()
    a, b = h.alias("a"), h.alias("b")
    want = a.join(b, F.expr("a.token = b.token and a.wallet < b.wallet")).groupBy("a.wallet", F.col("b.wallet").alias("other")).count().filter("count >= 2")
    want = sorted(map(tuple, want.collect()))
    assert len(want) > 100 and sorted(map(tuple, sh.pairs_sharing(h, 2).collect())) == want
    assert sorted(map(tuple, sh.sharing(h, h, 2).filter("wallet < other").collect())) == want


def test_blocks_move_so_many_times_and_leave_in_tiles(spark, monkeypatch):
    """With twice as many wallets, blocks get larger and not more: what is shuffled at most doubles, and every pair is there."""
    from ledgerloom.operators import sharing as sh

    for name, n in (("BLOCK", 1), ("HEAVY", 6), ("TASKS", 4), ("GRID", 3)):
        monkeypatch.setattr(sh, name, n, raising=False)

    def met(wallets):
        h = spark.range(wallets * 8).select((F.col("id") % wallets * 7).alias("wallet"), F.pmod(F.xxhash64("id"), F.when(F.col("id") % 3 == 0, 5).otherwise(200)).alias("token")).distinct()
        a, b = h.alias("a"), h.alias("b")
        want = a.join(b, F.expr("a.token = b.token and a.wallet < b.wallet")).groupBy("a.wallet", F.col("b.wallet").alias("other")).count().filter("count >= 2")
        want = sorted(map(tuple, want.collect()))
        held = {(r.wallet, r.token) for r in h.collect()}
        sums = {}
        for x, y, _ in want:
            for w, o in ((x, y), (y, x)):
                for t in [None, *(t for v, t in held if v == w and (o, t) in held)]:
                    sums[w, t] = sums.get((w, t), 0) + 1
        sc = spark.sparkContext
        sc.setJobGroup(f"met-{wallets}", "")
        assert len(want) > 50 and sorted(map(tuple, sh.pairs_sharing(h, 2).collect())) == want
        sc.setJobGroup("", "")
        status = sc.statusTracker()
        stages = {k for j in status.getJobIdsForGroup(f"met-{wallets}") for k in status.getJobInfo(j).stageIds}
        assert sorted(map(tuple, sh.sharing(h, h, 2).filter("wallet < other").collect())) == want
        assert {(r.wallet, r.token): r.n for r in sh.cast(h, h, 2).collect()} == sums
        return sum(sc._jsc.sc().statusStore().lastStageAttempt(k).shuffleWriteRecords() for k in stages)

    assert met(64) <= 2.2 * met(32)


def test_style_features_are_worked_out_once(spark):
    """Neither the medians nor the fits go back to what the features come from."""
    from ledgerloom.operators import strategy as sg

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(x):
        seen.add(1)
        return float(x % 7)

    f = spark.range(60).select(F.col("id").alias("wallet"), *[noted("id").alias(c) if c == "f_hold" else (F.col("id") % (k + 3)).cast("double").alias(c) for k, c in enumerate(sg.FEATURES)])
    f = f.withColumn("f_roi", F.when(F.col("wallet") % 3 > 0, F.col("f_roi"))).withColumn("f_delay", F.lit(None).cast("double"))
    got = sg.impute(f)
    assert got.filter("f_delay = 0").count() == 60
    want = f.agg(F.median("f_roi")).first()[0]
    assert {r.f_roi for r in got.filter("wallet % 3 = 0").collect()} == {want}
    seen.value = 0
    assert sg.cluster_styles(sg.impute(f)).count() == 60
    assert seen.value == 60


def test_slices_carry_a_place_in_place_of_what_orders_rows(spark, monkeypatch):
    """Only the first of the tables that slices write holds the columns of the order."""
    from ledgerloom.operators import episodes
    from ledgerloom.sources.bindings import LINE_ORDER, line_trades

    wide, write = [], episodes.written
    monkeypatch.setattr(episodes, "written", lambda df, name: wide.append((name, set(LINE_ORDER) & set(df.columns))) or write(df, name))
    episodes.sliced(line_trades(spark, SF), LINE_ORDER, 20, 8)
    assert [name for name, held in wide if held] == ["trades"]


def test_decisions_fold_their_positions_once(spark):
    """Rails and scores read the positions of a snapshot, and fold none again."""
    from ledgerloom.plans import judgement
    from ledgerloom.sources.bindings import trades

    state = judgement.decision_state(trades(spark, SF))
    for name in ("rails", "scores"):
        assert "MapInPandas" not in state[name]._jdf.queryExecution().optimizedPlan().toString()
