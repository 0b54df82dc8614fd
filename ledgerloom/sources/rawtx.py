"""Raw transaction documents: flattening, balance deltas, swap inference, attribution.

All operators are expressions and joins on the document table; balances stay
in arrays until they are summed, so a document costs its own size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Quote mints, the venue programs' priorities, tip accounts, the create line, the smallest native flow.
WSOL = "So11111111111111111111111111111111111111112"
USDC = "EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v"
USDT = "Es9vMFrzaCERmJfrF4H2FYD4KCoNkY11McCe8BenwNYB"
QUOTES = [WSOL, USDC, USDT]
TIP_ACCOUNTS = [
    "96gYZGLnJYVFmbjzopPSU6QiEV5fGqZNyN9nmNhvrZU5", "HFqU5x63VTqvQss8hp11i4wVV8bD44PvwucfZ2bU7gRe",
    "Cw8CFyM9FkoMi7K7Crf6HNQqf4uEMzpKw6QNghXLvLkY", "ADaUMid9yfUytqMBgopwjb2DTLSokTSzL1zt6iGPaS49",
    "DfXygSm4jCyNCybVYYK6DwvWqjKee8pbDmJGcLWNDXjh", "ADuUkR4vqLUMWXxW9gh6D6L8pMSawimctcNZ5pGwDcEt",
    "DttWaMuVvTiduZRnguLF7jNxTgiMBZ1hyAumKUiL2KRL", "3AVi9Tg9Uo68tJfuvoKvqKNWKkC5wPdSSdeBnizKZ6jT",
]
CREATE_LINE = "Program log: Instruction: Create"
LEAST_NATIVE = 0.0005

_TOKEN_BALANCES = "array<struct<accountIndex:int,mint:string,owner:string,uiTokenAmount:struct<amount:string,decimals:int>>>"
_INSTRUCTIONS = "array<struct<programId:string,accounts:array<string>,data:string>>"
DOCUMENT = (
    "slot long, blockTime long, transaction struct<signatures:array<string>,message:struct<accountKeys:array<struct<pubkey:string,signer:boolean>>,instructions:" + _INSTRUCTIONS + ">>, "
    "meta struct<err:string,fee:long,preBalances:array<long>,postBalances:array<long>,preTokenBalances:" + _TOKEN_BALANCES + ",postTokenBalances:" + _TOKEN_BALANCES
    + ",logMessages:array<string>,innerInstructions:array<struct<index:int,instructions:" + _INSTRUCTIONS + ">>,loadedAddresses:struct<writable:array<string>,readonly:array<string>>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Flat documents from JSON files (one document a file or a line)."""
    return flatten(spark.read.schema(DOCUMENT).option("multiLine", True).json(path))


def flatten(raw: DataFrame) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    tokens = lambda c: F.transform(F.coalesce(F.col(c), F.expr(f"cast(array() as {_TOKEN_BALANCES})")), lambda b: F.struct(b["owner"].alias("owner"), b["mint"].alias("mint"), (b["uiTokenAmount"]["amount"].cast("double") / F.pow(F.lit(10.0), b["uiTokenAmount"]["decimals"])).alias("amount")))
    inner = F.flatten(F.transform(F.coalesce("meta.innerInstructions", F.expr(f"cast(array() as array<struct<index:int,instructions:{_INSTRUCTIONS}>>)")), lambda i: i["instructions"]))
    calls = F.concat("transaction.message.instructions", inner)
    return raw.select(
        F.get("transaction.signatures", F.lit(0)).alias("signature"), "slot", F.col("blockTime").alias("block_time"), F.col("meta.err").alias("err"), F.col("meta.fee").alias("fee"),
        F.col("transaction.message.accountKeys").alias("static_keys"), F.coalesce("meta.loadedAddresses.writable", none).alias("writable"), F.coalesce("meta.loadedAddresses.readonly", none).alias("readonly"),
        F.col("meta.preBalances").alias("pre"), F.col("meta.postBalances").alias("post"), tokens("meta.preTokenBalances").alias("pre_tokens"), tokens("meta.postTokenBalances").alias("post_tokens"),
        F.coalesce("meta.logMessages", none).alias("logs"), F.transform(calls, lambda c: F.struct(c["programId"].alias("program"), c["accounts"].alias("accounts"))).alias("calls"),
    )


def account_keys() -> Column:
    """Static keys, then loaded writable, then loaded readonly ones."""
    return F.concat(F.transform("static_keys", lambda k: k["pubkey"]), F.col("writable"), F.col("readonly"))


def fee_payer() -> Column:
    signer = F.filter("static_keys", lambda k: F.coalesce(k["signer"], F.lit(False)))
    return F.coalesce(F.get(signer, F.lit(0))["pubkey"], F.get("static_keys", F.lit(0))["pubkey"])


def program_ids() -> Column:
    return F.array_distinct(F.transform("calls", lambda c: c["program"]))


def _token_changes() -> Column:
    """All balances of a document as changes: those after added, those before taken away."""
    part = lambda c, sign: F.transform(c, lambda b: F.struct(b["owner"].alias("owner"), b["mint"].alias("mint"), (sign * b["amount"]).alias("x")))
    return F.concat(part("post_tokens", 1), part("pre_tokens", -1))


def token_deltas(docs: DataFrame) -> DataFrame:
    """(signature, owner, mint, delta): sum after less sum before, zero rows dropped."""
    every = docs.select("signature", F.explode(_token_changes()).alias("b")).select("signature", "b.*")
    return every.groupBy("signature", "owner", "mint").agg(F.sum("x").alias("delta")).filter(F.abs("delta") > 1e-12)


def _native_changes() -> Column:
    """All accounts of a document as (owner, lamports); the fee payer gets the fee and transfers to tip accounts back."""
    zipped = F.arrays_zip(account_keys().alias("key"), F.col("pre"), F.col("post"))
    raw = F.transform(zipped, lambda z: F.struct(z["key"].alias("owner"), (z["post"] - z["pre"]).alias("d")))
    known = F.filter(raw, lambda r: r["d"].isNotNull() & r["owner"].isNotNull())
    tips = F.aggregate(F.filter(known, lambda r: r["owner"].isin(*TIP_ACCOUNTS) & (r["d"] > 0)), F.lit(0).cast("long"), lambda x, r: x + r["d"])
    back = lambda r: F.when(r["owner"] == fee_payer(), F.col("fee") + tips).otherwise(0)
    return F.transform(known, lambda r: F.struct(r["owner"].alias("owner"), (r["d"] + back(r)).alias("lamports")))


def native_deltas(docs: DataFrame) -> DataFrame:
    """(signature, owner, lamports) of every account; the fee payer gets the fee and transfers to tip accounts back."""
    return docs.select("signature", F.explode(_native_changes()).alias("z")).select("signature", "z.*")


def payer_deltas(docs: DataFrame) -> DataFrame:
    """The rows of ``native_deltas`` that are the fee payer's own."""
    every = docs.select("signature", fee_payer().alias("payer"), F.explode(_native_changes()).alias("z"))
    return every.filter("z.owner = payer").select("signature", "z.*")


def infer_swaps(docs: DataFrame) -> DataFrame:
    """Swap events of the fee payer: (signature, wallet, mint, side, token_amount, quote_mint, quote_amount, event_index).

    One mint besides quotes: the larger opposite SOL leg (wrapped, or native
    from 0.0005 on), else the first opposite stable leg (USDC before USDT).
    Two such mints of opposite signs: two events, by mint. Else none.
    Each document is read once and brings its native flow along; only the payer's changes leave it.
    """
    ok = docs.filter("err is null").select("signature", fee_payer().alias("owner"), _native_changes().alias("natives"), _token_changes().alias("tokens"))
    mine = lambda c: F.filter(c, lambda b: b["owner"] == F.col("owner"))
    ok = ok.select("signature", "owner", mine("natives").alias("natives"), mine("tokens").alias("tokens"))
    flow = F.when(F.size("natives") > 0, F.aggregate("natives", F.lit(0).cast("long"), lambda x, r: x + r["lamports"]) / 1e9)
    rows = ok.select("signature", "owner", flow.alias("native"), F.explode("tokens").alias("b"))
    legs = rows.groupBy("signature", "owner", F.col("b.mint").alias("mint")).agg(F.sum("b.x").alias("delta"), F.max("native").alias("native")).filter(F.abs("delta") > 1e-12)
    quote = F.col("mint").isin(*QUOTES)
    of = lambda m: F.max(F.when(F.col("mint") == m, F.col("delta")))
    s = legs.groupBy("signature", "owner").agg(
        F.array_sort(F.collect_list(F.when(~quote, F.struct("mint", "delta")))).alias("own"), of(WSOL).alias("wsol"), of(USDC).alias("usdc"), of(USDT).alias("usdt"), F.max("native").alias("native")
    )
    one, two = F.get("own", F.lit(0)), F.get("own", F.lit(1))
    against = lambda c, x: F.when((F.signum(c) == -F.signum(x)) & (c != 0), c)
    d = one["delta"]
    wsol, nat = against(F.col("wsol"), d), F.when(F.abs("native") >= LEAST_NATIVE, against(F.col("native"), d))
    sol = F.when(F.coalesce(F.abs(wsol), F.lit(0.0)) >= F.coalesce(F.abs(nat), F.lit(0.0)), wsol).otherwise(nat)
    usdc, usdt = against(F.col("usdc"), d), against(F.col("usdt"), d)
    event = lambda leg, mint, amount: F.struct(leg["mint"].alias("mint"), F.when(leg["delta"] > 0, "buy").otherwise("sell").alias("side"), F.abs(leg["delta"]).alias("token_amount"), mint.alias("quote_mint"), F.abs(amount).alias("quote_amount"))
    single = F.when(sol.isNotNull(), event(one, F.lit(WSOL), sol)).when(usdc.isNotNull(), event(one, F.lit(USDC), usdc)).when(usdt.isNotNull(), event(one, F.lit(USDT), usdt))
    events = F.when(F.size("own") == 1, F.array_compact(F.array(single))).when((F.size("own") == 2) & (F.signum(one["delta"]) == -F.signum(two["delta"])), F.array(event(one, two["mint"], two["delta"]), event(two, one["mint"], one["delta"])))
    return s.select("signature", F.col("owner").alias("wallet"), F.posexplode(events).alias("event_index", "e")).select("signature", "wallet", "e.*", "event_index")


def attribute_venue(docs: DataFrame, venues: DataFrame) -> DataFrame:
    """(signature, venue): the matching venue of the first priority; an aggregator only where no venue matched. ``venues``: (program, venue, priority, aggregator)."""
    called = docs.select("signature", F.explode(program_ids()).alias("program")).join(F.broadcast(venues), "program")
    best = called.groupBy("signature").agg(F.min_by("venue", F.struct("aggregator", "priority")).alias("venue"))
    return best


def matching_venues(docs: DataFrame, venues: DataFrame) -> DataFrame:
    """(signature, venue, run): all venues whose program a transaction calls, numbered from 0 in the order of priority, aggregators last."""
    called = docs.select("signature", F.explode(F.array_distinct(program_ids())).alias("program")).join(F.broadcast(venues), "program").select("signature", "venue", "aggregator", "priority").distinct()
    n = F.row_number().over(Window.partitionBy("signature").orderBy("aggregator", "priority"))
    return called.select("signature", "venue", (n - 1).alias("run"))


def token_owners(docs: DataFrame) -> DataFrame:
    """(signature, pool): accounts that own a token account in a transaction, before or after."""
    every = F.array_distinct(F.transform(F.concat("pre_tokens", "post_tokens"), lambda b: b["owner"]))
    return docs.select("signature", F.explode(every).alias("pool")).filter("pool is not null")


def aggregator_tag(programs: list[str]) -> Column:
    return F.arrays_overlap(program_ids(), F.array(*[F.lit(p) for p in programs]))


def dedup_events(events: DataFrame) -> DataFrame:
    """The first event of each (wallet, mint, side, quote) of a transaction, with a dense index."""
    first = Window.partitionBy("signature", "wallet", "mint", "side", "quote_mint").orderBy("event_index")
    kept = events.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return kept.withColumn("event_index", F.row_number().over(Window.partitionBy("signature").orderBy("event_index")) - 1)


def attribute_pool(docs: DataFrame, positions: DataFrame, traders: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """(signature, pool): the account at the program's fixed place, if exactly one (program, pool) agrees and it isn't the trader; with ``owners`` (signature, pool) it must also own a token account. ``positions``: (program, place from 0)."""
    c = docs.select("signature", F.explode("calls").alias("c")).select("signature", "c.program", "c.accounts")
    p = c.join(F.broadcast(positions), "program").select("signature", "program", F.get("accounts", F.col("place")).alias("pool")).filter("pool is not null").distinct()
    p = p.join(traders.select("signature", F.col("wallet").alias("pool")), ["signature", "pool"], "left_anti")
    if owners is not None:
        p = p.join(owners.select("signature", "pool"), ["signature", "pool"], "left_semi")
    one = p.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.max("pool").alias("pool"))
    return one.select("signature", F.when(F.col("n") == 1, F.col("pool")).alias("pool"))


def side_audit(docs: DataFrame, events: DataFrame, wsol_base: DataFrame) -> DataFrame:
    """Events whose logged side differs from the inferred one; the logged side is flipped where WSOL is the pool's base. ``wsol_base``: (signature)."""
    logged = F.when(F.array_contains("logs", "Program log: Instruction: Buy"), "buy").when(F.array_contains("logs", "Program log: Instruction: Sell"), "sell")
    l = docs.select("signature", logged.alias("logged")).filter("logged is not null").join(wsol_base.withColumn("flip", F.lit(True)), "signature", "left")
    seen = l.withColumn("logged", F.when(F.col("flip"), F.when(F.col("logged") == "buy", "sell").otherwise("buy")).otherwise(F.col("logged"))).drop("flip")
    return events.join(seen, "signature").filter("logged <> side").select("signature", "wallet", "mint", "side", "logged")


def incoming_funder(docs: DataFrame, addresses: DataFrame) -> DataFrame:
    """(signature, wallet, funder): for wallets that gained lamports, the other account that lost most."""
    raw = docs.select("signature", F.explode(F.arrays_zip(account_keys().alias("key"), F.col("pre"), F.col("post"))).alias("z")).select("signature", F.col("z.key").alias("account"), (F.col("z.post") - F.col("z.pre")).alias("d")).filter("d is not null and account is not null")
    gained = raw.filter("d > 0").join(addresses.select(F.col("wallet").alias("account")), "account", "left_semi").select("signature", F.col("account").alias("wallet"))
    lost = raw.filter("d < 0").groupBy("signature").agg(F.min_by("account", F.struct("d", "account")).alias("funder"))
    return gained.join(lost, "signature")


def first_creators(docs: DataFrame, mints: DataFrame) -> DataFrame:
    """(mint, creator): the fee payer of a token's first create transaction. ``mints``: (signature, mint)."""
    made = docs.filter(F.array_contains("logs", CREATE_LINE)).select("signature", "slot", fee_payer().alias("payer"))
    return made.join(mints, "signature").groupBy("mint").agg(F.min_by("payer", F.struct("slot", "signature")).alias("creator"))
