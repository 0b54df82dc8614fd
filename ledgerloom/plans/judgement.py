"""Vetting, token risk, data sets, evaluation, decisions, rails, alerts and reports over the trade tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets as ds
from ..operators import decisions as dc
from ..operators import evaluation as ev
from ..operators import pointers
from ..operators import positions as ps
from ..operators import reports as rp
from ..operators import risk as rk
from ..operators import snapshots as sn
from ..operators import timeops as tm
from ..operators import vetting as vt
from ..operators import wallets as wl
from ..sources.bindings import DAY, HOUR, NOW, POSITIONS, PRELUDE, TRADE_ROWS, tokens, trades, wallets
from ..sources.tables import written
from .base import book
from .catalog import Catalog, r6
from .jobs import METRICS, _GRID, _LABELS, daily_labels, stats

C = Catalog()


def wide(spark, sf_dir):
    """Trades over all 100 tokens, where co-occurrence means something."""
    return trades(spark, sf_dir).drop("token").withColumnRenamed("token100", "token")


_CIRCLE = "CASE WHEN wallet % 11 = 5 THEN 100000 + 10 * wallet + token100 % 3 WHEN wallet % 3 = 0 OR (wallet % 3 = 1 AND token100 >= 50) THEN 1000 + 100 * wallet + token100 ELSE token100 + 100 * (wallet % 4) END"


def circles(spark, sf_dir):
    """Trades in which a third of the wallets share all tokens with their circle, a third some, a third none, and a few hold three tokens."""
    return trades(spark, sf_dir).withColumn("token", F.expr(_CIRCLE.lower()))


# --- vetting ---------------------------------------------------------------

_RING = f""", lt AS (SELECT wallet, {_CIRCLE} AS token, max(us) AS last_us FROM trades GROUP BY 1, 2),
mine AS (SELECT wallet, token FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY last_us DESC, token) AS n FROM lt) WHERE n <= 20),
met AS (SELECT m.wallet, l.wallet AS other, m.token FROM mine m JOIN lt l ON l.token = m.token AND l.wallet <> m.wallet),
rec AS (SELECT wallet, other FROM met GROUP BY 1, 2 HAVING count(*) >= 4),
rep AS (SELECT wallet, count(*) AS repeat_tokens FROM (SELECT wallet, token FROM met JOIN rec USING (wallet, other) GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1),
crowd AS (SELECT wallet, avg(n) AS avg_co_traders FROM (SELECT m.wallet, count(l.wallet) AS n FROM mine m LEFT JOIN lt l ON l.token = m.token AND l.wallet <> m.wallet GROUP BY m.wallet, m.token) GROUP BY 1),
nrec AS (SELECT wallet, count(*) AS recurring FROM rec GROUP BY 1),
ring AS (SELECT wallet, avg_co_traders, coalesce(recurring, 0) AS recurring, n AS tokens, coalesce(repeat_tokens, 0) AS repeat_tokens, coalesce(repeat_tokens, 0) / n AS cast_ratio, n >= 4 AND coalesce(repeat_tokens, 0) / n >= 0.6 AS ring FROM (SELECT wallet, count(*) AS n FROM mine GROUP BY 1) LEFT JOIN rep USING (wallet) LEFT JOIN crowd USING (wallet) LEFT JOIN nrec USING (wallet))"""


@C.add(POSITIONS + _RING + " SELECT wallet, tokens, round(avg_co_traders, 6) AS avg_co_traders, recurring, repeat_tokens, round(cast_ratio, 6) AS cast_ratio, ring FROM ring")
def i05_counterparty_signal(spark, sf_dir):
    got = vt.counterparty_signal(circles(spark, sf_dir))
    return got.select("wallet", "tokens", F.round("avg_co_traders", 6).alias("avg_co_traders"), "recurring", "repeat_tokens", F.round("cast_ratio", 6).alias("cast_ratio"), "ring")


_VETTINGS = ", vettings AS (SELECT wallet, event_id AS id, us AS ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE wallet % 40 END AS funder, CASE WHEN wallet % 40 < 5 THEN 'cex' ELSE 'wallet' END AS funder_kind FROM trades), lv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY ts DESC, id DESC) AS n FROM vettings) WHERE n = 1), fk AS (SELECT lv.wallet, funder FROM lv JOIN wallets w ON w.wallet = lv.wallet WHERE funder IS NOT NULL AND funder_kind <> 'cex' AND w.wallet % 2 = 0), peers AS (SELECT wallet, funder, count(*) OVER (PARTITION BY funder) - 1 AS peers FROM fk)"


def vettings(spark, sf_dir):
    t = trades(spark, sf_dir)
    return t.select("wallet", F.col("event_id").alias("id"), F.col("us").alias("ts"), F.when(F.col("event_id") % 3 != 0, F.col("wallet") % 40).alias("funder"), F.when(F.col("wallet") % 40 < 5, "cex").otherwise("wallet").alias("funder_kind"))


@C.add(POSITIONS + _VETTINGS + " SELECT p.wallet, p.peers, array_to_string(list(q.wallet ORDER BY q.wallet), ',') AS names FROM peers p LEFT JOIN peers q ON q.funder = p.funder AND q.wallet <> p.wallet GROUP BY ALL")
def i05b_shared_funder(spark, sf_dir):
    """Every candidate with all of its peers by name."""
    shared, named = vt.shared_funder(vettings(spark, sf_dir), wallets(trades(spark, sf_dir)).filter("wallet % 2 = 0"))
    peers = named.select("funder", F.explode("wallets").alias("peer"))
    listed = shared.join(peers, "funder", "left").filter("peer != wallet").groupBy("wallet").agg(F.array_join(F.transform(F.array_sort(F.collect_list("peer")), lambda w: w.cast("string")), ",").alias("names"))
    return shared.join(listed, "wallet", "left").select("wallet", "peers", "names")


_INSIDER = ", own AS (SELECT p.wallet, k.creator = p.wallet OR k.creator = p.wallet % 40 AS mine FROM positions p JOIN tokens k USING (token) WHERE status = 'closed' AND pnl > 0), ins AS (SELECT wallet, count(*) AS won, count(*) FILTER (mine) AS inside, count(*) FILTER (mine) / count(*) AS insider_share, count(*) FILTER (mine) >= 1 AND count(*) FILTER (mine) / count(*) >= 0.1 AS insider FROM own GROUP BY wallet)"


def insiders(spark, sf_dir):
    t = trades(spark, sf_dir)
    funders = wallets(t).select("wallet", (F.col("wallet") % 40).alias("funder"))
    return vt.insider_share(book(spark, sf_dir), tokens(t), funders, 1, 0.1)


@C.add(POSITIONS + _INSIDER + " SELECT wallet, won, inside, round(insider_share, 6) AS insider_share, insider FROM ins")
def i05c_insider_share(spark, sf_dir):
    return insiders(spark, sf_dir).withColumn("insider_share", F.round("insider_share", 6))


@C.add(POSITIONS + _RING + _VETTINGS + _INSIDER + " SELECT r.wallet, CASE WHEN ring OR coalesce(peers, 0) > 0 OR coalesce(insider, FALSE) THEN 'suspicious' WHEN f.funder IS NULL AND r.tokens < 4 THEN 'inconclusive' ELSE 'clear' END AS verdict, CAST(CAST(ring AS INT) + CAST(coalesce(peers, 0) > 0 AS INT) + CAST(coalesce(insider, FALSE) AS INT) AS INT) AS n_reasons FROM ring r LEFT JOIN peers USING (wallet) LEFT JOIN ins USING (wallet) LEFT JOIN (SELECT wallet, funder FROM lv) f USING (wallet)")
def i05d_vetting_verdict(spark, sf_dir):
    ring = vt.counterparty_signal(circles(spark, sf_dir))
    peers, _ = vt.shared_funder(vettings(spark, sf_dir), wallets(trades(spark, sf_dir)).filter("wallet % 2 = 0"))
    latest = tm.latest_per_key(vettings(spark, sf_dir), ["wallet"], [F.desc("ts"), F.desc("id")]).select("wallet", "funder")
    signals = ring.join(peers.drop("funder"), "wallet", "left").join(insiders(spark, sf_dir).select("wallet", "insider"), "wallet", "left").join(latest, "wallet", "left")
    return vt.verdicts(signals).select("wallet", "verdict", F.size("reasons").alias("n_reasons"))


@C.add(METRICS + f" SELECT wallet, tracked, confidence_score FROM wallets LEFT JOIN scored USING (wallet) WHERE (tracked OR confidence_score >= 35) AND wallet NOT IN (SELECT wallet FROM trades WHERE us >= {NOW - DAY} AND token = 3) ORDER BY tracked DESC, confidence_score DESC NULLS LAST, wallet LIMIT 30")
def i05d_vetting_candidates(spark, sf_dir):
    t = trades(spark, sf_dir)
    scores = wl.confidence(stats(spark, sf_dir)).select("wallet", "confidence_score")
    done = t.filter("token = 3").select("wallet", F.col("us").alias("ts"))
    return vt.candidates(wallets(t), scores, done, 50, NOW - DAY, 30).select("wallet", "tracked", "confidence_score")


@C.add(PRELUDE + ", tr AS (SELECT wallet, us AS slot, event_id AS signature, CASE WHEN side = 'buy' AND quote_kind = 'wsol' THEN event_id % 60 END AS funder, wallet % 9 <> 0 AS complete FROM trades), f AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY slot, signature) AS n FROM tr), g AS (SELECT wallet, CASE WHEN bool_and(complete) THEN arg_min(funder, (slot, signature)) FILTER (funder IS NOT NULL) END AS funder FROM f WHERE n <= 3 GROUP BY wallet) SELECT wallet, funder, CASE WHEN funder < 10 THEN 'cex' WHEN funder IS NOT NULL THEN 'wallet' ELSE 'inconclusive' END AS funder_kind FROM g")
def i06_funding_trace(spark, sf_dir):
    t = trades(spark, sf_dir)
    tr = t.select("wallet", F.col("us").alias("slot"), F.col("event_id").alias("signature"), F.when((F.col("side") == "buy") & (F.col("quote_kind") == "wsol"), F.col("event_id") % 60).alias("funder"), (F.col("wallet") % 9 != 0).alias("history_complete"))
    return vt.trace_funders(tr, spark.range(10).select(F.col("id").alias("address")))


# --- token risk ------------------------------------------------------------

_FACTS = f""", {_GRID.format(w=HOUR)},
wtok AS (SELECT token100 AS token, min(us) AS first_seen, token100 % 7 AS creator FROM trades GROUP BY token100),
wgrid AS (SELECT token100 AS token, (us // {HOUR} + 1) * {HOUR} AS ts, arg_max(quote / amount, (us, event_id)) AS price, coalesce(sum(quote) FILTER (quote_kind = 'wsol'), 0) AS liquidity FROM trades GROUP BY 1, 2),
dead AS (SELECT token, coalesce(arg_max(liquidity, ts) <= 1 OR arg_max(price, ts) <= 0.1 * max(price), FALSE) AS dead FROM wgrid GROUP BY token),
td AS (SELECT t.*, d.dead, row_number() OVER (PARTITION BY creator ORDER BY first_seen DESC, t.token DESC) AS k FROM wtok t LEFT JOIN dead d USING (token)),
hist AS (SELECT a.token, count(b.token) AS prior, coalesce(sum(CAST(b.dead AS INT)), 0) AS dead_prior FROM td a LEFT JOIN td b ON b.creator = a.creator AND b.token <> a.token AND b.k <= CASE WHEN a.k <= 5 THEN 6 ELSE 5 END GROUP BY a.token),
act AS (SELECT token100 AS token, count(*) FILTER (side = 'buy') AS buys_6h, count(DISTINCT wallet) FILTER (side = 'buy') AS buyers_6h FROM trades WHERE us >= {NOW - 72 * HOUR} GROUP BY 1),
liq AS (SELECT token, arg_max(liquidity, ts) AS liquidity FROM wgrid GROUP BY token),
facts AS (SELECT t.token, CASE t.token % 5 WHEN 0 THEN '' WHEN 1 THEN 'K' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE '' END AS mint_authority, CASE t.token % 5 WHEN 2 THEN 'K' WHEN 4 THEN NULL WHEN 3 THEN NULL ELSE '' END AS freeze_authority,
  CASE WHEN t.token % 6 <> 0 THEN (t.token % 11) / 10.0 END AS top_share, t.token % 8 = 0 AS on_curve, t.token % 9 <> 0 AS has_lp, CASE WHEN t.token % 7 <> 0 THEN (t.token % 20) / 20.0 END AS burned_share, (t.token % 13) / 13.0 AS lp_top_share,
  prior, dead_prior, buys_6h, buyers_6h, liquidity, ({NOW} - first_seen) / 1e6 / 20 AS age_s
  FROM wtok t LEFT JOIN hist USING (token) LEFT JOIN act USING (token) LEFT JOIN liq USING (token)),
comp AS (SELECT *, CAST(CASE WHEN mint_authority <> '' THEN 100.0 WHEN freeze_authority <> '' THEN 80 WHEN mint_authority IS NULL OR freeze_authority IS NULL THEN 60 ELSE 0 END AS DOUBLE) AS authority,
  CASE WHEN top_share IS NULL THEN 50 ELSE 100 * least(greatest((top_share - 0.2) / 0.5, 0), 1) END AS holders,
  CASE WHEN on_curve THEN 40 WHEN NOT has_lp OR burned_share IS NULL THEN 50 WHEN burned_share >= 0.9 THEN 0 WHEN lp_top_share > 0.5 AND burned_share < 0.5 THEN 90 ELSE 100 * (1 - burned_share) END AS lp,
  CASE WHEN coalesce(prior, 0) = 0 THEN 30 ELSE 100.0 * dead_prior / prior END AS deployer,
  CASE WHEN coalesce(buys_6h, 0) < 10 THEN 50 ELSE least(greatest(140 * (1 - buyers_6h / buys_6h), 0), 100) END AS volume,
  100 * (1 - least(greatest(coalesce(liquidity, 0) / 200, 0), 1)) * (1 - least(greatest(age_s / 86400, 0), 1)) AS liquidity_age FROM facts),
risk AS (SELECT *, least(greatest(0.2 * authority + 0.2 * holders + 0.15 * lp + 0.15 * deployer + 0.15 * volume + 0.15 * liquidity_age, 0), 100) AS score FROM comp)"""


def risk_facts(spark, sf_dir):
    t = wide(spark, sf_dir)
    tok = t.groupBy("token").agg(F.min("us").alias("first_seen")).withColumn("creator", F.col("token") % 7)
    grid = sn.hourly_grid(t)
    hist = rk.creator_history(tok, rk.dead_tokens(grid), 5)
    inside = t.filter(F.col("us") >= NOW - 72 * HOUR).groupBy("token").agg(F.count_if(F.col("side") == "buy").alias("buys_6h"), F.count_distinct(F.when(F.col("side") == "buy", F.col("wallet"))).alias("buyers_6h"))
    liq = grid.groupBy("token").agg(F.max_by("liquidity", "ts").alias("liquidity"))
    k = F.col("token")
    five = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), (k % 5).cast("int"))
    base = tok.select(
        "token", five("", "K", "", None, "").alias("mint_authority"), five("", "", "K", None, None).alias("freeze_authority"), F.when(k % 6 != 0, (k % 11) / 10.0).alias("top_share"),
        (k % 8 == 0).alias("on_curve"), (k % 9 != 0).alias("has_lp"), F.when(k % 7 != 0, (k % 20) / 20.0).alias("burned_share"), ((k % 13) / 13.0).alias("lp_top_share"), ((NOW - F.col("first_seen")) / 1e6 / 20).alias("age_s"),
    )
    return base.join(hist, "token", "left").join(inside, "token", "left").join(liq, "token", "left")


@C.add(POSITIONS + _FACTS + " SELECT token, " + ", ".join(f"round({c}, 6) AS {c}" for c in [*rk.COMPONENTS, "score"]) + ", len(list_filter([CASE WHEN mint_authority <> '' AND NOT on_curve THEN 1 END, CASE WHEN freeze_authority <> '' THEN 1 END, CASE WHEN top_share > 0.7 THEN 1 END, CASE WHEN mint_authority IS NULL OR freeze_authority IS NULL THEN 1 END], lambda x: x IS NOT NULL)) AS n_reasons FROM risk")
def i07_token_risk(spark, sf_dir):
    return rk.assess(risk_facts(spark, sf_dir)).select("token", *r6(*rk.COMPONENTS, "score"), F.size("reasons").cast("long").alias("n_reasons"))


@C.add(POSITIONS + _FACTS + " SELECT token, dead FROM dead")
def i07b_dead_tokens(spark, sf_dir):
    return rk.dead_tokens(sn.hourly_grid(wide(spark, sf_dir)))


@C.add(PRELUDE + f" SELECT token100 AS token, event_id, us AS ts FROM (SELECT *, row_number() OVER (PARTITION BY token100 ORDER BY us DESC) AS n FROM trades WHERE event_id % 2 = 1) WHERE n = 1 AND us >= {NOW - 12 * HOUR}")
def i07e_fresh_assessments(spark, sf_dir):
    done = wide(spark, sf_dir).select("token", "event_id", F.col("us").alias("ts"), (F.col("event_id") % 2).alias("version"))
    return rk.fresh_assessments(done, NOW, 1, 12 * HOUR).select("token", "event_id", "ts")


_OUT = f""", {_GRID.format(w=6 * HOUR)}, ass AS (SELECT event_id, token, us AS ts, event_id % 101 AS authority, event_id % 97 AS holders, event_id % 89 AS lp, event_id % 83 AS deployer, event_id % 79 AS volume, event_id % 73 AS liquidity_age FROM trades WHERE us <= {NOW - 12 * HOUR}),
lst AS (SELECT token, arg_max(price, ts) AS lp_, arg_max(liquidity, ts) AS ll, max(ts) AS lts FROM grid GROUP BY token),
rs AS (SELECT a.*, g.price AS bp, g.liquidity AS bl, lp_, ll, lts FROM ass a ASOF LEFT JOIN grid g ON a.token = g.token AND a.ts >= g.ts LEFT JOIN lst ON lst.token = a.token),
outc AS (SELECT *, CASE WHEN lts > ts AND (coalesce(bl > 0 AND ll <= 0.1 * bl, FALSE) OR coalesce(bp > 0 AND lp_ <= 0.1 * bp, FALSE)) THEN 'rug' WHEN lts > ts AND bp > 0 AND lp_ / bp - 1 > 0 THEN 'profit' WHEN lts > ts AND bp > 0 THEN 'loss' WHEN ts <= {NOW - 72 * HOUR} THEN 'unknown' ELSE 'retry' END AS outcome, CASE WHEN lts > ts AND bp > 0 THEN lp_ / bp - 1 END AS roi FROM rs)"""


def outcomes(spark, sf_dir):
    t = trades(spark, sf_dir)
    mods = dict(zip(rk.COMPONENTS, (101, 97, 89, 83, 79, 73)))
    assessed = t.select("event_id", "token", F.col("us").alias("ts"), *[(F.col("event_id") % m).alias(c) for c, m in mods.items()])
    return rk.resolve(assessed, sn.hourly_grid(t, 6 * HOUR).select("token", "ts", "price", "liquidity"), NOW)


@C.add(POSITIONS + _OUT + " SELECT event_id, outcome, round(roi, 6) AS outcome_roi FROM outc")
def i08_risk_outcomes(spark, sf_dir):
    return outcomes(spark, sf_dir).select("event_id", "outcome", F.round("outcome_roi", 6).alias("outcome_roi"))


_BASE_W = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in rk.WEIGHTS.items()) + ") AS b(name, base)"


@C.add(POSITIONS + _OUT + ", lg AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, outcome = 'rug' AS rug, {c} AS v FROM outc" for c in rk.COMPONENTS) + f"), mn AS (SELECT name, avg(v) FILTER (rug) AS hot, avg(v) FILTER (NOT rug) AS cool, count(*) AS n, count(*) FILTER (rug) AS rugs FROM lg GROUP BY name), w AS (SELECT b.name, base, n, rugs, base * least(greatest(1 + (coalesce(hot, 0) - coalesce(cool, 0)) / 100, 0.5), 2) AS w FROM {_BASE_W} LEFT JOIN mn USING (name)), nw AS (SELECT *, w / sum(w) OVER () AS new FROM w), g AS (SELECT min(n) >= 50 AND min(rugs) >= 10 AND max(abs(new - base)) >= 0.01 AS ok FROM nw) SELECT name, round(CASE WHEN ok THEN new ELSE base END, 6) AS weight, ok AS changed FROM nw, g")
def i09_e17_weight_tuning(spark, sf_dir):
    return rk.tune(outcomes(spark, sf_dir)).select("name", F.round("weight", 6).alias("weight"), "changed")


@C.add(PRELUDE + ", " + f"lw AS (SELECT name, base, least(greatest((SELECT count(*) FROM trades WHERE token = length(name) % 10) / 4000.0, 0.5 * base), 2 * base) AS w FROM {_BASE_W}) SELECT name, round(w / sum(w) OVER (), 6) AS weight FROM lw")
def i07d_learned_weights(spark, sf_dir):
    n = trades(spark, sf_dir).groupBy("token").agg((F.count(F.lit(1)) / 4000.0).alias("weight"))
    names = spark.createDataFrame([(k,) for k in rk.COMPONENTS], "name string").withColumn("token", (F.length("name") % 10).cast("long"))
    return rk.load_weights(names.join(n, "token").select("name", "weight")).select("name", F.round("weight", 6).alias("weight"))


# --- data sets and evaluation ----------------------------------------------

_HIST = f", dly AS (SELECT wallet, (us // {DAY} + 1) * {DAY} AS ts, count(*) AS n, count(*) FILTER (side = 'buy') AS b, CAST(sum(CAST(CASE WHEN side = 'sell' THEN quote ELSE -quote END AS DECIMAL(18,2))) AS DOUBLE) AS pnl FROM trades GROUP BY 1, 2), hist AS (SELECT wallet, ts, pnl, sum(n) OVER (PARTITION BY wallet ORDER BY ts) AS wallet_trades, sum(b) OVER (PARTITION BY wallet ORDER BY ts) / sum(n) OVER (PARTITION BY wallet ORDER BY ts) AS wallet_win_rate FROM dly)"


def profit_data(spark, sf_dir):
    t = trades(spark, sf_dir)
    return ds.trade_profit(t, book(spark, sf_dir).filter("status = 'closed'"), ds.stats_history(t), tokens(t), NOW)


@C.add(POSITIONS + _HIST + f", fc AS (SELECT t.event_id, arg_min(p.pnl, (p.closed_us, p.episode)) AS pnl FROM trades t JOIN positions p ON p.wallet = t.wallet AND p.token = t.token AND p.status = 'closed' AND p.closed_us > t.us AND p.closed_us <= t.us + {DAY} WHERE t.side = 'buy' AND t.quote_kind = 'wsol' GROUP BY 1), jn AS (SELECT t.*, fc.pnl FROM trades t JOIN fc USING (event_id)) SELECT j.event_id, CAST(coalesce(j.pnl, 0) > 0 AS INT) AS label, j.quote AS size, round((j.us - k.first_seen) / 1e6, 6) AS age_s, CAST(h.wallet_trades AS BIGINT) AS wallet_trades, round(h.wallet_win_rate, 6) AS wallet_win_rate, CAST(j.venue = 'orca' AS DOUBLE) AS is_orca_whirlpool FROM jn j ASOF LEFT JOIN hist h ON j.wallet = h.wallet AND j.us >= h.ts LEFT JOIN tokens k ON k.token = j.token")
def i10_trade_profit_data(spark, sf_dir):
    return profit_data(spark, sf_dir).select("event_id", "label", "size", *r6("age_s", "wallet_win_rate"), "wallet_trades", "is_orca_whirlpool")


@C.add(POSITIONS + _HIST + f", pr AS (SELECT a.wallet, a.ts, min(b.ts) AS later FROM hist a JOIN hist b ON a.wallet = b.wallet AND b.ts >= a.ts + {25 * DAY} GROUP BY 1, 2) SELECT pr.wallet, pr.ts, pr.later AS later_ts, CAST(h.pnl > 0 AS INT) AS label FROM pr JOIN hist h ON h.wallet = pr.wallet AND h.ts = pr.later")
def i11_wallet_persistence_data(spark, sf_dir):
    return ds.wallet_persistence(ds.stats_history(trades(spark, sf_dir))).select("wallet", "ts", "later_ts", "label")


@C.add()
def i12_i14_walk_forward(spark, sf_dir):
    """Rows of the newest slice, which the model hasn't seen, with its metrics on them; one row with the reason if training is refused. The guard is 60 rows, as sf0.01 has 110 in all."""
    data = profit_data(spark, sf_dir)
    trained = ds.walk_forward(data, ds.TRADE_FEATURES, least=60)
    if "refused" in trained:
        return spark.range(1).select(F.expr("cast(null as bigint)").alias("event_id"), F.expr("cast(null as int)").alias("label"), *[F.lit(None).cast("double").alias(c) for c in ("p_profit", "auc", "brier", "base_rate")], F.lit(trained["refused"]).alias("refused"))
    rows = ds.score(data.filter(F.col("us") > trained["until"]), trained)
    metrics = [F.lit(trained[c]).cast("double").alias(c) for c in ("auc", "brier", "base_rate")]
    return rows.select("event_id", "label", F.round("p_profit", 6).alias("p_profit"), *metrics, F.lit(None).cast("string").alias("refused"))


@C.add(PRELUDE + f", m AS (SELECT us // {DAY} AS version, CASE WHEN us // {DAY} % 6 = 1 THEN NULL ELSE round(avg(quote), 3) END AS auc FROM trades GROUP BY 1), p AS (SELECT version, auc, row_number() OVER (ORDER BY version) = 1 OR (auc IS NOT NULL AND (max(auc) OVER before IS NULL OR auc > max(auc) OVER before)) AS promoted FROM m WINDOW before AS (ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT version, promoted, version = (SELECT max(version) FROM p WHERE promoted) AS is_active FROM p")
def i13_champion_promotion(spark, sf_dir):
    m = trades(spark, sf_dir).groupBy(F.floor(F.col("us") / DAY).alias("version")).agg(F.round(F.avg("quote"), 3).alias("auc"))
    return ds.promote(m.withColumn("auc", F.when(F.col("version") % 6 != 1, F.col("auc")))).select("version", "promoted", "is_active")


_PRED = f", pred AS (SELECT event_id AS id, us, wallet, token, event_id % 3 AS model, (event_id * 37 % 100) / 100.0 AS prob, (event_id % 50) / 100.0 AS predicted_roi FROM trades WHERE side = 'buy' AND event_id % 11 <> 0), rslv AS (SELECT q.id, q.model, q.prob, q.us, q.predicted_roi, arg_min(p.roi, (p.closed_us, p.episode)) FILTER (p.roi IS NOT NULL OR TRUE) AS r0, min((p.closed_us, p.episode)) AS k, any_value(q.wallet) AS wallet, any_value(q.token) AS token FROM pred q JOIN positions p ON p.wallet = q.wallet AND p.token = q.token AND p.status = 'closed' AND p.closed_us > q.us AND p.closed_us <= q.us + {DAY} GROUP BY 1, 2, 3, 4, 5), oc AS (SELECT r.id, r.model, r.prob, CAST(CASE WHEN p.roi IS NOT NULL THEN p.roi > 0 ELSE coalesce(p.pnl, 0) > 0 END AS INT) AS label, r.predicted_roi - p.roi AS roi_error, (p.closed_us - r.us) // 1000000 AS hold_s FROM rslv r JOIN positions p ON p.wallet = r.wallet AND p.token = r.token AND p.closed_us = k[1] AND p.episode = k[2]), o AS (SELECT *, power(prob - label, 2) AS brier FROM oc)"


def resolved(spark, sf_dir):
    t = trades(spark, sf_dir).filter("side = 'buy'")
    p = t.select(F.col("event_id").alias("id"), "us", "wallet", "token", (F.col("event_id") % 3).alias("model"), ((F.col("event_id") * 37 % 100) / 100.0).alias("prob"), ((F.col("event_id") % 50) / 100.0).alias("predicted_roi"))
    done = p.filter("id % 11 = 0").select("id")
    return ev.resolve_predictions(p, done, book(spark, sf_dir).filter("status = 'closed'"))


@C.add(POSITIONS + _PRED + " SELECT id, model, label, hold_s, round(brier, 6) AS brier, round(roi_error, 6) AS roi_error FROM o")
def i15_prediction_outcomes(spark, sf_dir):
    return resolved(spark, sf_dir).select("id", "model", "label", "hold_s", *r6("brier", "roi_error"))


@C.add(POSITIONS + _PRED + ", b AS (SELECT model, CAST(least(greatest(ceil(prob * 10) - 1, 0), 9) AS INT) AS bin, prob, label FROM o) SELECT m.model, g.bin, count(b.prob) AS n, round(avg(b.prob), 6) AS mean_p, round(avg(b.label), 6) AS mean_label FROM (SELECT DISTINCT model FROM o) m CROSS JOIN (SELECT CAST(unnest(range(10)) AS INT) AS bin) g LEFT JOIN b ON b.model = m.model AND b.bin = g.bin GROUP BY 1, 2")
def e13_calibration(spark, sf_dir):
    return ev.calibration(resolved(spark, sf_dir)).select("model", "bin", "n", *r6("mean_p", "mean_label"))


@C.add(POSITIONS + _PRED + ", rk AS (SELECT model, label, prob, rank() OVER (PARTITION BY model ORDER BY prob) + (count(*) OVER (PARTITION BY model, prob) - 1) / 2.0 AS r FROM o), a AS (SELECT model, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0) AS auc FROM rk GROUP BY model) SELECT o.model, count(*) AS n, round(avg(brier), 6) AS brier, round(avg(CAST((prob >= 0.5) = (label = 1) AS DOUBLE)), 6) AS accuracy, round(avg(label), 6) AS base_rate, round(avg(abs(roi_error)), 6) AS roi_error, round(any_value(auc), 6) AS auc FROM o JOIN a USING (model) GROUP BY o.model HAVING count(*) >= 20")
def i16_e14_e15_model_performance(spark, sf_dir):
    return ev.performance(resolved(spark, sf_dir)).select("model", "n", *r6("brier", "accuracy", "base_rate", "roi_error", "auc"))


# --- decisions -------------------------------------------------------------

#: Who and what is not copied, and the bounds of the rails, so that every gate but the switch opens and shuts somewhere.
POLICY = {"min_confidence": 30, "wallet_blacklist": (7, 21), "token_blacklist": (8,)}
MAX_OPEN, MAX_EXPOSURE = 8, 400

_DECIDE = f""", {_GRID.format(w=HOUR)}, led AS (SELECT wallet, count(*) FILTER (status = 'open') AS open_n, greatest(coalesce(sum(bought_sol - sold_sol) FILTER (status = 'open'), 0), 0) AS exposed FROM positions GROUP BY wallet),
jb AS (SELECT t.event_id, t.wallet, t.token, t.us, t.quote AS leader_size, w.tracked, s.confidence_score, s.roi_std, s.avg_roi, k.first_seen, k.supply, open_n, exposed, CASE WHEN t.event_id % 4 <> 0 THEN (t.event_id * 37 % 100) / 100.0 END AS p_profit, CASE WHEN t.wallet % 13 = 0 THEN 'suspicious' ELSE 'clear' END AS verdict, CAST(t.token * 9 AS DOUBLE) AS rug_score, t.token = 4 AS hard_blocked, (t.event_id % 23) / 10.0 AS exposure, t.event_id % 29 = 0 AS has_open
  FROM trades t LEFT JOIN wallets w ON w.wallet = t.wallet LEFT JOIN scored s ON s.wallet = t.wallet LEFT JOIN tokens k ON k.token = t.token LEFT JOIN led ON led.wallet = t.wallet WHERE t.side = 'buy'),
ja AS (SELECT j.*, g.price, g.price * 1.1 AS vwap, g.liquidity * 3 AS liquidity, g.volume_1h, CAST(g.trades_1h AS DOUBLE) AS holder_growth, g.price * supply / 10 AS market_cap FROM jb j ASOF LEFT JOIN grid g ON j.token = g.token AND j.us >= g.ts),
cr AS (SELECT *, least(coalesce(confidence_score, 30), 100) AS wc, CASE WHEN p_profit IS NULL THEN 0 ELSE 0.25 END AS ml, 0.4 * least(greatest(coalesce(liquidity, 0) / 500, 0), 1) + 0.3 * least(greatest(coalesce(volume_1h, 0) / 1000, 0), 1) + 0.3 * least(greatest(coalesce(holder_growth, 0) / 50, 0), 1) AS q,
  40 * (1 - least(greatest(coalesce(liquidity, 0) / 200, 0), 1)) + 25 * (1 - least(greatest(coalesce((us - first_seen) / 1e6 / 86400, 0), 0), 1)) + 20 * least(greatest(coalesce(abs(price - vwap) / nullif(vwap, 0), 0.15) / 0.5, 0), 1) + 15 * least(greatest(coalesce(roi_std, 1) / 3, 0), 1) AS risk FROM ja),
dd2 AS (SELECT *, (0.45 + (0.25 - ml)) * wc + ml * 100 * coalesce(p_profit, 0) + 20 * q + 5 AS confidence FROM cr),
de AS (SELECT *, [TRUE, coalesce(tracked, FALSE) OR wc >= 65, wallet NOT IN (7, 21), token NOT IN (8), rug_score <= 60 AND NOT hard_blocked, coalesce(tracked, FALSE) OR verdict <> 'suspicious', confidence >= 30, risk <= 70, coalesce(liquidity >= 25, FALSE), coalesce(market_cap BETWEEN 1e4 AND 5e7, TRUE),
  greatest(least(0.05, 2.0 - exposure), 0) >= 0.001, NOT (coalesce(open_n >= {MAX_OPEN}, FALSE) OR coalesce(exposed >= {MAX_EXPOSURE}, FALSE)), NOT has_open] AS gates, confidence_score IS NULL AND first_seen IS NULL AS unknown FROM dd2)"""
DECISION = "CASE WHEN list_bool_and(gates) AND NOT unknown THEN 'copy' ELSE 'skip' END AS decision, CAST(len(list_filter(gates, lambda x: NOT x)) AS INT) AS failed"


def decision_sql(low: int, high: int | None) -> str:
    """The decision tables over the buys from ``low`` on and before ``high``, judged by what events before ``low`` tell."""
    known = METRICS.replace("FROM events", f"FROM (SELECT * FROM events WHERE epoch_us(ts) < {low})")
    mine = TRADE_ROWS.replace("FROM events", f"FROM (SELECT * FROM events WHERE epoch_us(ts) >= {low}" + (f" AND epoch_us(ts) < {high})" if high else ")"))
    return f"{known}, own AS ({mine})" + _DECIDE.replace("FROM trades t LEFT JOIN wallets", "FROM own t LEFT JOIN wallets")


def decision_state(t) -> dict:
    """What trades tell about wallets, tokens and the market, for the gates."""
    positions = written(ps.fold_positions(t, ["event_id"]), "positions")  # rails and scores read it, several times
    is_open = F.col("status") == "open"
    ledger = positions.groupBy("wallet").agg(F.count_if(is_open).alias("open_n"), F.greatest(F.coalesce(F.sum(F.when(is_open, F.col("bought_sol") - F.col("sold_sol"))), F.lit(0.0)), F.lit(0.0)).alias("exposure"))
    none = ledger.limit(0)
    reasons = dc.rails(ledger, none.select("wallet", F.lit(0).alias("streak")), none.select("wallet", F.lit(0.0).alias("daily_pnl")), max_open=MAX_OPEN, max_exposure=MAX_EXPOSURE)
    grid = sn.hourly_grid(t).select("token", "ts", "price", (F.col("price") * 1.1).alias("vwap"), (F.col("liquidity") * 3).alias("liquidity"), "volume_1h", F.col("trades_1h").cast("double").alias("holder_growth"))
    return {
        "wallets": wallets(t).select("wallet", "tracked"),
        "scores": wl.confidence(wl.wallet_metrics(t, positions, tokens(t), NOW)).select("wallet", "confidence_score", "roi_std", "avg_roi"),
        "tokens": tokens(t).select("token", "first_seen", "supply"),
        "rails": reasons.withColumnRenamed("reasons", "rail_reasons"),
        "grid": grid,
    }


def with_state(buys, state: dict):
    """Buys with the state of their wallet, token and market that the gates need."""
    e = F.col("event_id")
    b = buys.select("event_id", "wallet", "token", "us", F.col("quote").alias("leader_size"))
    for name, key in (("wallets", "wallet"), ("scores", "wallet"), ("tokens", "token"), ("rails", "wallet")):
        b = b.join(state[name], key, "left")
    b = tm.asof_backward(b, state["grid"], ["token"], "us", "ts", ["price", "vwap", "liquidity", "volume_1h", "holder_growth"])
    return b.select(
        "*", ((F.col("us") - F.col("first_seen")) / 1e6).alias("age_s"), F.when(e % 4 != 0, (e * 37 % 100) / 100.0).alias("p_profit"), F.when(F.col("wallet") % 13 == 0, "suspicious").otherwise("clear").alias("verdict"),
        (F.col("token") * 9).cast("double").alias("rug_score"), (F.col("token") == 4).alias("hard_blocked"), ((e % 23) / 10.0).alias("exposure"), (e % 29 == 0).alias("has_open"),
        (F.col("price") * F.col("supply") / 10).alias("market_cap"), F.lit(None).cast("double").alias("factor"),
    )


def decided(spark, sf_dir):
    t = trades(spark, sf_dir)
    return dc.decide(with_state(t.filter("side = 'buy'"), decision_state(t)), **POLICY)


@C.add(METRICS + _DECIDE + f" SELECT event_id, round(confidence, 4) AS confidence, round(risk, 4) AS risk, {DECISION}, list_transform(gates, lambda x: CAST(x AS INT)) AS gates FROM de")
def i21_copy_decisions(spark, sf_dir):
    d = decided(spark, sf_dir)
    return d.select("event_id", F.round("confidence", 4).alias("confidence"), F.round("risk", 4).alias("risk"), "decision", F.size(F.filter("gates", lambda g: ~g["passed"])).alias("failed"), F.transform("gates", lambda g: g["passed"].cast("int")).alias("gates"))


@C.add(METRICS + _DECIDE + " SELECT event_id FROM de WHERE len(list_filter(gates, lambda x: NOT x)) = 1 AND NOT gates[2]")
def i22c_blocked_only_by(spark, sf_dir):
    return dc.blocked_only_by(decided(spark, sf_dir), "followed_leader").select("event_id")


_BACK = METRICS + _DECIDE + """, cp AS (SELECT event_id, TRUE AS decided FROM de WHERE list_bool_and(gates) AND NOT unknown), sp AS (SELECT t.event_id, g.price AS seen FROM trades t ASOF JOIN grid g ON t.token = g.token AND t.us >= g.ts),
so AS (SELECT token, us, event_id, wallet, side, coalesce(decided, FALSE) AS decided, coalesce(seen, quote / amount) AS price, row_number() OVER (PARTITION BY token ORDER BY us, event_id) AS rn FROM trades LEFT JOIN cp USING (event_id) LEFT JOIN sp USING (event_id)),
bt AS (SELECT token, rn, CASE WHEN side = 'buy' AND decided THEN event_id END AS buy_event, CASE WHEN side = 'buy' AND decided THEN wallet END AS leader, CASE WHEN side = 'buy' AND decided THEN price END AS entry, CAST(NULL AS BIGINT) AS done_buy, CAST(NULL AS BIGINT) AS sell_event, CAST(NULL AS DOUBLE) AS roi FROM so WHERE rn = 1
  UNION ALL SELECT o.token, o.rn,
    CASE WHEN b.buy_event IS NULL THEN CASE WHEN o.side = 'buy' AND o.decided THEN o.event_id END WHEN o.side = 'sell' AND o.wallet = b.leader THEN NULL ELSE b.buy_event END,
    CASE WHEN b.buy_event IS NULL THEN CASE WHEN o.side = 'buy' AND o.decided THEN o.wallet END WHEN o.side = 'sell' AND o.wallet = b.leader THEN NULL ELSE b.leader END,
    CASE WHEN b.buy_event IS NULL THEN CASE WHEN o.side = 'buy' AND o.decided THEN o.price END WHEN o.side = 'sell' AND o.wallet = b.leader THEN NULL ELSE b.entry END,
    CASE WHEN b.buy_event IS NOT NULL AND o.side = 'sell' AND o.wallet = b.leader THEN b.buy_event END, CASE WHEN b.buy_event IS NOT NULL AND o.side = 'sell' AND o.wallet = b.leader THEN o.event_id END,
    CASE WHEN b.buy_event IS NOT NULL AND o.side = 'sell' AND o.wallet = b.leader THEN o.price / b.entry - 1 END
  FROM bt b JOIN so o ON o.token = b.token AND o.rn = b.rn + 1)"""


_COPIES = _BACK + " SELECT token, done_buy AS buy_event, sell_event, round(roi, 6) AS roi FROM bt WHERE done_buy IS NOT NULL"


def copied(spark, sf_dir):
    """Trades with their price at the last snapshot and whether a copy of them is decided."""
    t = trades(spark, sf_dir)
    taken = decided(spark, sf_dir).filter("decision = 'copy'").select("event_id", F.lit(True).alias("decided"))
    grid = sn.hourly_grid(t).select("token", "ts", F.col("price").alias("seen"))
    priced = tm.asof_backward(t, grid, ["token"], "us", "ts", ["seen"])  # without a snapshot so far, the trade's own price
    return priced.join(taken, "event_id", "left").select("token", "us", "event_id", "wallet", "side", F.coalesce("decided", F.lit(False)).alias("decided"), F.coalesce("seen", F.try_divide("quote", "amount")).alias("price"))


@C.add(_COPIES)
def i22_copy_backtest(spark, sf_dir):
    return dc.backtest(copied(spark, sf_dir)).select("token", "buy_event", "sell_event", F.round("roi", 6).alias("roi"))


@C.add(_COPIES)
def i22_copy_backtest_of_hot_tokens(spark, sf_dir):
    """The same by pointers, so that no task runs along a token's rows."""
    return pointers.backtest(copied(spark, sf_dir)).select("token", "buy_event", "sell_event", F.round("roi", 6).alias("roi"))


_WAIT, _LIMIT = 3 * HOUR, 150
_RAILS = f""", led AS (SELECT wallet, count(*) FILTER (status = 'open') AS open_n, greatest(coalesce(sum(bought_sol - sold_sol) FILTER (status = 'open'), 0), 0) AS exposure FROM positions GROUP BY wallet),
tried AS (SELECT *, max(island) OVER (PARTITION BY wallet) AS last_island FROM (SELECT user_id AS wallet, event_type = 'error' AS failed, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)),
streaks AS (SELECT wallet, count(*) FILTER (failed AND island = last_island) AS streak FROM tried GROUP BY wallet),
daily AS (SELECT wallet, sum(CAST(CASE WHEN side = 'sell' THEN quote ELSE -quote END AS DECIMAL(18,2))) AS pnl FROM trades WHERE us >= {NOW - DAY} GROUP BY wallet),
buys AS (SELECT wallet, us, row_number() OVER (PARTITION BY wallet ORDER BY us, event_id) AS rn FROM trades WHERE side = 'buy'),
clock AS (SELECT wallet, rn, us AS last_us FROM buys WHERE rn = 1 UNION ALL SELECT b.wallet, b.rn, CASE WHEN b.us - c.last_us >= {_WAIT} THEN b.us ELSE c.last_us END FROM clock c JOIN buys b ON b.wallet = c.wallet AND b.rn = c.rn + 1),
cool AS (SELECT wallet FROM clock GROUP BY wallet HAVING max(last_us) > {NOW - _WAIT}),
blocked AS (SELECT led.wallet, array_to_string(list_filter([CASE WHEN cool.wallet IS NOT NULL THEN 'cooldown' END, CASE WHEN streak >= 2 THEN 'failures' END, CASE WHEN pnl <= -{_LIMIT} THEN 'daily_loss' END, CASE WHEN open_n >= 8 THEN 'max_open' END, CASE WHEN exposure >= 100 THEN 'max_exposure' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM led LEFT JOIN streaks USING (wallet) LEFT JOIN daily USING (wallet) LEFT JOIN cool ON cool.wallet = led.wallet)"""


@C.add(POSITIONS + _RAILS + " SELECT wallet, reasons, FALSE AS stopped FROM blocked UNION ALL SELECT wallet, CASE WHEN reasons = '' THEN 'emergency_stop' ELSE 'emergency_stop,' || reasons END, TRUE FROM blocked")
def i22b_risk_rails(spark, sf_dir):
    """The rails fed by open positions, failures in a row, the day's PnL and the running cooldown; with and without the emergency stop."""
    from ..sources.bindings import events

    t = trades(spark, sf_dir)
    is_open = F.col("status") == "open"
    led = book(spark, sf_dir).groupBy("wallet").agg(F.count_if(is_open).alias("open_n"), F.greatest(F.coalesce(F.sum(F.when(is_open, F.col("bought_sol") - F.col("sold_sol"))), F.lit(0.0)), F.lit(0.0)).alias("exposure"))
    streak = dc.failure_streak(events(spark, sf_dir).withColumn("failed", F.col("event_type") == "error"), "wallet", ["us", "event_id"])
    signed = F.when(F.col("side") == "sell", F.col("quote")).otherwise(-F.col("quote")).cast("decimal(18,2)")
    daily = t.filter(F.col("us") >= NOW - DAY).groupBy("wallet").agg(F.sum(signed).alias("daily_pnl"))
    cooling = dc.cooldown(t.filter("side = 'buy'"), "wallet", _WAIT // 1_000_000, ["event_id"]).filter("allowed").filter(F.col("us") > NOW - _WAIT)
    got = [dc.rails(led, streak, daily, cooling, stopped, max_open=8, max_exposure=100, max_failures=2, daily_limit=_LIMIT).select("wallet", F.array_join("reasons", ",").alias("reasons"), F.lit(stopped).alias("stopped")) for stopped in (False, True)]
    return got[0].unionByName(got[1])


# --- reports ---------------------------------------------------------------

_SECTIONS = ["best_wallets", "worst_wallets", "highest_risk", "most_consistent", "rising_styles", "declining_styles", "accuracy", "mistakes", "improvements", "market"]


def report_items(spark, sf_dir):
    t = trades(spark, sf_dir)
    venue = t.groupBy(F.col("venue").alias("style"), F.floor(F.col("us") / DAY).alias("ts")).agg(F.avg("quote").alias("value"))
    models = ev.performance(resolved(spark, sf_dir)).select("model", "auc", "brier", (F.col("auc") - 0.5).alias("gain"))
    market = daily_labels(spark, sf_dir).orderBy(F.desc("window_index")).limit(1).select(F.col("label").alias("regime"), F.col("pct").alias("pct_change"))
    s = stats(spark, sf_dir).withColumn("total_pnl_sol", F.round("total_pnl_sol", 6)).withColumn("roi_std", F.round("roi_std", 6))
    risk = rk.assess(risk_facts(spark, sf_dir)).select("token", F.round("score", 6).alias("score"))
    return rp.build(s, risk, rp.style_trends(venue), models, resolved(spark, sf_dir).select("id", "brier"), market)


def _top(name: str, item: str, value: str, source: str, order: str) -> str:
    return f"SELECT '{name}' AS section, CAST(row_number() OVER (ORDER BY {order}) AS INT) AS place, CAST({item} AS VARCHAR) AS item, round({value}, 6) AS value FROM (SELECT * FROM ({source}) ORDER BY {order} LIMIT 10)"


_REPORT = [
    _top("best_wallets", "wallet", "v", "SELECT wallet, round(total_pnl_sol, 6) AS v FROM stats WHERE total_pnl_sol IS NOT NULL", "v DESC, wallet"),
    _top("worst_wallets", "wallet", "v", "SELECT wallet, round(total_pnl_sol, 6) AS v FROM stats WHERE total_pnl_sol IS NOT NULL", "v, wallet"),
    _top("highest_risk", "token", "v", "SELECT token, round(score, 6) AS v FROM risk", "v DESC, token"),
    _top("most_consistent", "wallet", "v", "SELECT wallet, round(roi_std, 6) AS v FROM stats WHERE roi_std IS NOT NULL AND closed_position_count >= 5", "v, wallet"),
    _top("mistakes", "id", "v", "SELECT id, brier AS v FROM o", "v DESC, id"),
    _top("rising_styles", "style", "v", "SELECT style, v FROM trend WHERE v > 0", "v DESC, style"),
    _top("declining_styles", "style", "v", "SELECT style, v FROM trend WHERE v < 0", "v, style"),
    _top("accuracy", "model", "v", "SELECT model, auc AS v FROM judged", "v DESC, model"),
    _top("improvements", "model", "v", "SELECT model, auc - 0.5 AS v FROM judged WHERE auc > 0.5", "v DESC, model"),
    "SELECT 'market' AS section, 1 AS place, label AS item, round(pct, 6) AS value FROM l ORDER BY window_index DESC LIMIT 1",
]
_SECTION_SQL = (
    f", byday AS (SELECT venue AS style, us // {DAY} AS ts, avg(quote) AS v FROM trades GROUP BY 1, 2), lastday AS (SELECT *, row_number() OVER (PARTITION BY style ORDER BY ts DESC) AS k FROM byday), trend AS (SELECT style, max(v) FILTER (k = 1) - avg(v) FILTER (k > 1) AS v FROM lastday GROUP BY style HAVING count(*) > 1)"
    ", places AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY prob) + (count(*) OVER (PARTITION BY model, prob) - 1) / 2.0 AS r FROM o)"
    ", judged AS (SELECT model, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0) AS auc FROM places GROUP BY model HAVING count(*) >= 20), "
    + _LABELS
)


@C.add(METRICS + _FACTS + _PRED + _SECTION_SQL + " " + " UNION ALL ".join(f"({q})" for q in _REPORT))
def i23_report_items(spark, sf_dir):
    """The items of all ten sections."""
    return report_items(spark, sf_dir).withColumn("value", F.round("value", 6))


@C.add()
def i23_report_sections(spark, sf_dir):
    return rp.markdown(rp.conclusions(report_items(spark, sf_dir), _SECTIONS))


@C.add(PRELUDE + f", d AS (SELECT venue AS style, us // {DAY} AS ts, avg(quote) AS v FROM trades GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY style ORDER BY ts DESC) AS k FROM d) SELECT style, round(max(v) FILTER (k = 1) - avg(v) FILTER (k > 1), 6) AS delta FROM n GROUP BY style")
def f04_style_trends(spark, sf_dir):
    h = trades(spark, sf_dir).groupBy(F.col("venue").alias("style"), F.floor(F.col("us") / DAY).alias("ts")).agg(F.avg("quote").alias("value"))
    return rp.style_trends(h).select("style", F.round("delta", 6).alias("delta"))


@C.add(PRELUDE + f", d AS (SELECT token AS model, us // {DAY} AS ts, avg(quote) AS auc FROM trades GROUP BY 1, 2), n AS (SELECT *, auc - lag(auc) OVER (PARTITION BY model ORDER BY ts) AS gain, row_number() OVER (PARTITION BY model ORDER BY ts DESC) AS k FROM d) SELECT model, round(gain, 6) AS gain FROM n WHERE k = 1 AND gain > 0")
def f05_improvements(spark, sf_dir):
    h = trades(spark, sf_dir).groupBy(F.col("token").alias("model"), F.floor(F.col("us") / DAY).alias("ts")).agg(F.avg("quote").alias("auc"))
    return rp.improvements(h).filter("gain > 0").select("model", F.round("gain", 6).alias("gain"))


@C.add("SELECT k.kind, count(*) FILTER (date_trunc(k.unit, e.ts) = date_trunc(k.unit, TIMESTAMP '2024-01-30 12:00:00') AND e.event_type = k.kind AND e.value > 150) = 0 AS due FROM events e, (VALUES ('view', 'day'), ('signup', 'week')) AS k(kind, unit) GROUP BY k.kind")
def i23b_report_due(spark, sf_dir):
    from ..sources.bindings import events

    made = events(spark, sf_dir).filter("value > 150").select(F.col("event_type").alias("kind"), F.col("us").alias("ts"))
    at = NOW - DAY // 2
    return rp.due(made, at, "view", "day").select(F.lit("view").alias("kind"), "due").unionByName(rp.due(made, at, "signup", "week").select(F.lit("signup").alias("kind"), "due"))


# --- alerts ----------------------------------------------------------------

_ALERTS = f""", x AS (SELECT ({NOW} - max(us)) / 60e6 AS m, (SELECT count(*) FROM failed WHERE us >= {NOW - DAY}) AS f, (SELECT count(*) FROM trades WHERE us >= {NOW - DAY}) AS t, (SELECT CAST(sum(CASE WHEN side = 'sell' THEN quote ELSE -quote END) AS DOUBLE) FROM trades WHERE us >= {NOW - DAY}) AS pnl,
  (SELECT min(auc) FROM judged) AS auc, ({NOW} - (SELECT max(window_index) FROM l) * {DAY}) / 60e6 AS label_age FROM trades),
fired AS (SELECT 'ingestion_stalled' AS name, 'critical' AS severity, m AS value FROM x WHERE m > 15 UNION ALL SELECT 'high_failed_tx_ratio', 'warning', f / greatest(t, 1) FROM x WHERE f / greatest(t, 1) > 0.5
  UNION ALL SELECT 'copy_emergency_stop_active', 'critical', NULL FROM x WHERE f > 0.1 * t UNION ALL SELECT 'daily_loss_near_limit', 'warning', pnl FROM x WHERE pnl <= -0.8 UNION ALL SELECT 'model_accuracy_degraded', 'warning', auc FROM x WHERE auc < 0.55 UNION ALL SELECT 'no_recent_regime', 'info', label_age FROM x WHERE label_age > 120)"""


@C.add(POSITIONS + _PRED + _SECTION_SQL + _ALERTS + " SELECT name, severity, round(value, 6) AS value FROM fired")
def i24_alerts(spark, sf_dir):
    """All six rules on what the tables tell: trades, failures, PnL, the weakest model, the last label."""
    from ..sources.bindings import failed_transactions

    t = trades(spark, sf_dir)
    day = F.col("us") >= NOW - DAY
    m = t.agg(((NOW - F.max("us")) / 60e6).alias("minutes_since_trade"), F.count_if(day).cast("double").alias("trades_1h"), F.sum(F.when(day, F.when(F.col("side") == "sell", F.col("quote")).otherwise(-F.col("quote")))).alias("daily_pnl"))
    f = failed_transactions(spark, sf_dir).agg(F.count_if(day).cast("double").alias("failed_1h"))
    auc = ev.performance(resolved(spark, sf_dir)).agg(F.min("auc").alias("latest_auc"))
    age = daily_labels(spark, sf_dir).agg(((NOW - F.max("window_index") * DAY) / 60e6).alias("minutes_since_regime"))
    c = m.crossJoin(f).crossJoin(auc).crossJoin(age)  # a row each
    c = c.select("*", (F.col("failed_1h") > 0.1 * F.col("trades_1h")).alias("emergency_stop"), F.lit(1.0).alias("daily_limit"))
    return dc.alerts(c).select("name", "severity", F.round("value", 6).alias("value"))
