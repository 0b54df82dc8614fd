"""Column functions: pricing, coercion, scaling, labels and sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in a slice of ``dedupe_names``.
SLICE = 100_000

# Upper bounds in seconds, in order; the last bucket is open.
ENTRY_DELAY = [("<1m", 60), ("1-10m", 600), ("10-60m", 3600), ("1-6h", 21600), ("6-24h", 86400), (">24h", None)]
HOLD_TIME = [("<5m", 300), ("5-30m", 1800), ("30m-4h", 14400), ("4-24h", 86400), (">24h", None)]
# The venues, in order.
VENUES = ["pumpfun", "pumpswap", "raydium_amm", "raydium_clmm", "raydium_cpmm", "orca_whirlpool", "jupiter", "unknown"]


def price_quote(token: Column, quote: Column) -> Column:
    """Quote a token; null if either amount is 0."""
    return F.when((token != 0) & (quote != 0), F.try_divide(quote, token))


def price_usd(price: Column, quote_kind: Column, sol_price: Column) -> Column:
    """USD price: by the SOL price for WSOL quotes, as is for stable ones, else null."""
    return F.when(quote_kind == "wsol", price * sol_price).when(quote_kind == "stable", price)


def quote_in_sol(quote: Column, quote_kind: Column, sol_price: Column) -> Column:
    return F.when(quote_kind == "wsol", quote).when((quote_kind == "stable") & (sol_price > 0), F.try_divide(quote, sol_price))


def finite(text: Column, default: Column | None = None) -> Column:
    """A number from text; what doesn't parse, NaN and infinities are null (or ``default``)."""
    x = text.try_cast("double")
    x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return x if default is None else F.coalesce(x, default)


def quantize_sol(x: Column) -> Column:
    """Nine decimals, half to even."""
    return F.bround(x, 9)


def parse_price(payload: Column, mint: str, above: float | None = 0.0) -> Column:
    """``data[mint].price``, else the first entry's; must be above ``above``, unless that is None."""
    data = F.from_json(payload, "data map<string, struct<price string>>")["data"]
    price = F.coalesce(F.try_element_at(data, F.lit(mint))["price"], F.get(F.map_values(data), F.lit(0))["price"])
    x = finite(price)
    return x if above is None else F.when(x > above, x)


def bucket_label(seconds: Column, table: list[tuple[str, int | None]]) -> Column:
    """First bucket whose upper bound is above ``seconds``."""
    out = F.lit(table[-1][0])
    for label, upper in reversed(table[:-1]):
        out = F.when(seconds < upper, label).otherwise(out)
    return F.when(seconds.isNotNull(), out)


def scale(x: Column, lo: float, hi: float, degenerate: float = 0.0) -> Column:
    """Linear from 0 at ``lo`` to 1 at ``hi``, clamped."""
    if hi <= lo:
        return F.lit(degenerate)
    return F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))


def clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def cyclic_hour(hour: Column, minute: Column) -> tuple[Column, Column]:
    angle = (hour + minute / 60.0) / 24.0 * (2 * F.pi())
    return F.sin(angle), F.cos(angle)


def one_hot(value: Column, choices: list[str]) -> list[Column]:
    return [(value == c).cast("double").alias(f"is_{c}") for c in choices]


def venue_name(short: Column) -> Column:
    """The venue that a short name stands for; itself if it is one, else ``unknown``."""
    return F.when(short == "raydium", "raydium_amm").when(short == "orca", "orca_whirlpool").when(short.isin(*VENUES), short).otherwise("unknown")


def log_feature(x: Column) -> Column:
    return F.when(x >= 0, F.log1p(x))


def base_style(name: Column) -> Column:
    return F.regexp_replace(name, r"^(.+)-\d+$", "$1")


def dedupe_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Second and later rows of a name get ``-2``, ``-3`` and so on, in the order of the number ``order``.

    Rows are numbered inside slices of ``SLICE`` numbers, and slices by their counts, so a name of any number of rows is dealt over many tasks.
    """
    df = df.withColumn("_slice", F.floor(F.col(order) / SLICE))
    before = Window.partitionBy(name).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(name, "_slice").agg(F.count(F.lit(1)).alias("_n")).select(name, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    df = df.withColumn("_rn", F.row_number().over(Window.partitionBy(name, "_slice").orderBy(order))).join(base, [name, "_slice"])
    n = F.col("_base") + F.col("_rn")
    df = df.withColumn("_nr", n).drop("_slice", "_rn", "_base")
    n = F.col("_nr")
    return df.withColumn(name, F.when(n > 1, F.concat_ws("-", name, n.cast("string"))).otherwise(F.col(name))).drop("_nr")


def valid_address(x: Column) -> Column:
    return x.rlike("^[1-9A-HJ-NP-Za-km-z]{32,44}$")


def freshness(age_s: Column, stale_s: float) -> Column:
    return F.when(age_s.isNull(), "absent").when(age_s > stale_s, "stale").otherwise("ok")


def copy_size(mode: str, leader: Column, headroom: Column, fixed: float = 0.05, percent: float = 2.0, most: float = 0.5, dust: float = 0.001) -> Column:
    """SOL to put into a copy: fixed or a share of the leader's, within the largest position and the headroom; dust is 0. A struct of size and notes."""
    wanted = F.lit(fixed) if mode == "fixed" else leader * percent / 100.0  # in this order: 2 % of 17.5 is 0.35 then, not one bit more
    capped = F.least(wanted, F.lit(most))
    fitted = F.greatest(F.least(capped, headroom), F.lit(0.0))
    size = F.bround(F.when(fitted < dust, 0.0).otherwise(fitted), 9)
    notes = F.array_compact(F.array(F.when(wanted > most, "capped at the largest position"), F.when(capped > headroom, "cut to the headroom"), F.when(fitted < dust, "below dust")))
    return F.struct(size.alias("size_sol"), notes.alias("notes"))
