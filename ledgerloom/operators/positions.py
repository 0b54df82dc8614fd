"""Position episodes: an ordered fold of trades per wallet and token.

Where an episode ends depends on the state that the fold has built up, so no
window expresses it. Rows are dealt by (wallet, token), sorted inside each
task, and folded as they stream by: a task holds one running episode, however
many trades a pair has. Batch and streaming share ``Episode``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DUST = 0.005
SCHEMA = (
    "wallet long, token long, episode long, status string, opened_us long, closed_us long, last_us long, bought_tokens double, sold_tokens double, "
    "bought_sol double, sold_sol double, remaining double, avg_entry double, avg_exit double, pnl double, roi double, hold_s long, trades long, sells long"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass
class Episode:
    """One wallet's holding of one token, from its first trade to the sale of all but dust. Average-cost basis."""

    opened_us: int
    number: int = 1
    last_us: int = 0
    bought: float = 0.0
    sold: float = 0.0
    cost: float = 0.0
    proceeds: float = 0.0
    pnl: float = 0.0
    trades: int = 0
    sells: int = 0

    def add(self, us: int, side: str, amount: float, sol: float) -> None:
        self.last_us = us
        self.trades += 1
        if side == "buy":
            self.bought += amount
            self.cost += sol
        else:
            entry = self.cost / self.bought if self.bought else 0.0
            self.sold += amount
            self.proceeds += sol
            self.pnl += sol - entry * amount
            self.sells += 1

    @property
    def closed(self) -> bool:
        if self.bought > 0:
            return self.bought - self.sold <= DUST * self.bought
        return self.sold > 0

    def row(self, wallet: int, token: int) -> tuple:
        done = self.closed
        roi = self.pnl / self.cost if done and self.bought > 0 and self.cost > 0 else None
        hold = ((self.last_us - self.opened_us) // 1_000_000 if self.bought > 0 else 0) if done else None
        entry = self.cost / self.bought if self.bought else None
        leave = self.proceeds / self.sold if self.sold else None
        return (wallet, token, self.number, "closed" if done else "open", self.opened_us, self.last_us if done else None, self.last_us, self.bought, self.sold, self.cost, self.proceeds, self.bought - self.sold, entry, leave, self.pnl, roi, hold, self.trades, self.sells)


def fold_positions(trades: DataFrame, order: list[str]) -> DataFrame:
    """Episodes of all (wallet, token) pairs; trades without a SOL value are skipped. ``order`` breaks ties of ``us``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, episode, out = None, None, []
        for frame in frames:
            for wallet, token, us, side, amount, sol in zip(*(frame[c].tolist() for c in ("wallet", "token", "us", "side", "amount", "sol"))):
                if pair != (wallet, token):
                    if episode is not None:
                        out.append(episode.row(*pair))
                    pair, episode = (wallet, token), Episode(us)
                elif episode.closed:
                    out.append(episode.row(*pair))
                    episode = Episode(us, episode.number + 1)
                episode.add(us, side, amount, sol)
            if len(out) >= 10_000:
                yield _frame(out)
                out = []
        if episode is not None:
            out.append(episode.row(*pair))
        yield _frame(out)

    kept = trades.filter("sol is not null").select("wallet", "token", "us", "side", "amount", "sol", *order)
    dealt = kept.repartition("wallet", "token").sortWithinPartitions("wallet", "token", "us", *order)
    return dealt.select("wallet", "token", "us", "side", "amount", "sol").mapInPandas(run, SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=COLUMNS)
    return frame.astype({c: "Int64" for c in ("closed_us", "hold_s")})


def max_drawdown(closed: DataFrame) -> DataFrame:
    """``wallet``, ``max_drawdown_sol``, ``max_drawdown_pct`` over the cumulative PnL of closed positions."""
    from pyspark.sql import Window

    w = Window.partitionBy("wallet").orderBy("closed_us", "token", "episode").rowsBetween(Window.unboundedPreceding, 0)
    curve = closed.withColumn("curve", F.sum(F.coalesce("pnl", F.lit(0.0))).over(w))
    peaked = curve.withColumn("peak", F.greatest(F.lit(0.0), F.max("curve").over(w)))
    fall = F.col("peak") - F.col("curve")
    return peaked.groupBy("wallet").agg(F.max(fall).alias("max_drawdown_sol"), F.max(F.when(F.col("peak") > 0, fall / F.col("peak"))).alias("max_drawdown_pct"))
