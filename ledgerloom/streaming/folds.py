"""Folds along event time, for ``ordered``: positions, labels, daily losses, ranks, and who traded within the hour."""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.positions import COLUMNS, SCHEMA, Episode
from ..operators.regime import BEAR, BULL, STICKY
from ..sources.bindings import DAY
from .ordered import Fold

MINUTE = 60_000_000


# --- positions -------------------------------------------------------------


def _trade(key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[list[tuple], tuple]:
    episode, out = Episode(*state) if state else None, []
    for us, _, side, amount, sol in rows:
        if episode is None or episode.closed:
            episode = Episode(us, episode.number + 1 if episode else 1)
        episode.add(us, side, amount, sol)
        if episode.closed:
            out.append(episode.row(*key)[2:])
    if not episode.closed:
        out.append(episode.row(*key)[2:])
    return out, astuple(episode)


#: Rows: ``us, event_id, side, amount, sol`` of a (wallet, token). The state of a pair goes once its position is closed and the pair idle.
POSITIONS = Fold(
    _trade,
    "opened_us long, number long, at_us long, bought double, sold double, cost double, proceeds double, pnl double, trades long, sells long",
    SCHEMA.removeprefix("wallet long, token long, "),
    droppable=lambda state: Episode(*state).closed,
)


def latest_positions(made: DataFrame) -> DataFrame:
    """Positions as they stand by all rows of ``POSITIONS`` so far; episodes of a pair are numbered by their start."""
    keys = ["wallet", "token", "opened_us", "episode"]
    last = made.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in COLUMNS if c not in keys]), "trades").alias("r")).select(*keys, "r.*")
    number = F.row_number().over(Window.partitionBy("wallet", "token").orderBy("opened_us", "episode"))
    return last.withColumn("episode", number.cast("long")).select(*COLUMNS)


# --- regime labels ---------------------------------------------------------


def sticky(label: str, pct: float | None) -> str:
    """The label of a window by its change and the label before it."""
    if pct is None:
        return "sideways"
    if pct > BULL or (label == "bull" and pct > BULL - STICKY):
        return "bull"
    if pct < BEAR or (label == "bear" and pct < BEAR + STICKY):
        return "bear"
    return "sideways"


def _label(key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[list[tuple], tuple]:
    before, label = state or (None, "sideways")
    out = []
    for us, price in rows:
        pct = (price - before) / abs(before) * 100 if before else None
        label, before = sticky(label, pct), price
        out.append((us, pct, label))
    return out, (before, label)


#: Rows: ``us`` (a finished window's start) and ``price``.
LABELS = Fold(_label, "price double, label string", "us long, pct double, label string")


# --- daily losses ----------------------------------------------------------


def daily_loss(limit: int) -> Fold:
    """Rows: ``us, event_id, cents`` of a ``day``. A trip comes out when it happens, the day's total when the clock has passed midnight."""

    def add(key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[list[tuple], tuple]:
        total, tripped, _ = state or (0, None, 0)
        out = []
        for us, _, cents in rows:
            total += cents
            if tripped is None and total <= -limit:
                tripped = us
                out.append((total, tripped, False))
        return out, (total, tripped, rows[-1][0] // DAY)

    over = lambda key, state: [(state[0], state[1], True)]
    return Fold(add, "cents long, tripped_us long, at_day long", "cents long, tripped_us long, ended boolean", over, wake=lambda state: (state[2] + 1) * DAY)


# --- ranks -----------------------------------------------------------------


def ew_rank(alpha: float = 0.25) -> Fold:
    """Rows: ``us, event_id, roi`` of a wallet: its exponentially weighted outcome."""

    def add(key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[list[tuple], tuple]:
        ew, n = state or (0.0, 0)
        for _, _, roi in rows:
            ew, n = (1 - alpha) * ew + alpha * roi, n + 1
        return [(n, ew)], (ew, n)

    return Fold(add, "ew double, n long", "n long, ew double")


# --- who traded within the hour --------------------------------------------


def hour_steps(minutes: int = 60) -> Fold:
    """Rows: ``us, event_id, cents`` of a wallet: steps of the windows' totals along the line of minutes.

    A trade at minute m lies in the windows that start from m - 59 to m. A wallet counts once a window, so it adds itself
    only from where its trade before doesn't cover: each trade gives a rise and a fall, whatever the width.
    """

    def add(key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[list[tuple], tuple]:
        last = state[0] if state else None
        steps: dict[int, list[int]] = {}
        for us, _, cents in rows:
            m = us // MINUTE
            low = m - minutes + 1
            for at, sign in ((low, 1), (m + 1, -1)):
                s = steps.setdefault(at, [0, 0, 0])
                s[0] += sign
                s[1] += sign * cents
            if m != last:
                steps.setdefault(low if last is None else max(last + 1, low), [0, 0, 0])[2] += 1
                steps.setdefault(m + 1, [0, 0, 0])[2] -= 1
            last = m
        return [(at, *s) for at, s in steps.items() if any(s)], (last,)

    return Fold(add, "minute long", "minute long, n long, cents long, wallets long")


def hour_series(steps: DataFrame) -> DataFrame:
    """``start_us``, ``n``, ``volume``, ``wallets`` of every minute's window with a trade: running sums of the steps, days first."""
    by = steps.groupBy("minute").agg(*[F.sum(c).alias(c) for c in ("n", "cents", "wallets")]).withColumn("day", F.floor(F.col("minute") / 1440))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    days = by.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("n", "cents", "wallets")])
    days = days.select("day", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "cents", "wallets")], F.lead("day").over(Window.orderBy("day")).alias("next_day"))
    inside = Window.partitionBy("day").orderBy("minute")
    run = by.join(days, "day").select("minute", *[(F.sum(c).over(inside) + F.col(f"{c}_before")).alias(c) for c in ("n", "cents", "wallets")], F.lead("minute").over(inside).alias("next"), "day", "next_day")
    # the last step of a day holds until the next day's first one
    first = by.groupBy("day").agg(F.min("minute").alias("first")).withColumnRenamed("day", "next_day")
    until = run.join(first, "next_day", "left").withColumn("until", F.coalesce("next", "first", F.col("minute") + 1))
    every = until.filter("n > 0").select(F.explode(F.sequence("minute", F.col("until") - 1)).alias("minute"), "n", "cents", "wallets")
    return every.select((F.col("minute") * MINUTE).alias("start_us"), "n", (F.col("cents") / 100).alias("volume"), "wallets")
