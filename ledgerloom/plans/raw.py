"""Raw-transaction queries over one document per order, its balances built from the order's line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import rawtx as rx
from ..sources.bindings import read
from .catalog import Catalog

C = Catalog()
#: Line items a task takes: tasks grow in number with the tables, not in size, whatever the session's settings are.
ROWS = 250_000


def documents(spark, sf_dir):
    """Up to three mints an order; the quote leg is WSOL, native SOL, or USDC by customer; every eleventh order failed."""
    items = read(spark, sf_dir, "lineitem")
    tasks = -(-items.count() // ROWS) or 1  # counted in the files' footers
    items, o = items.repartition(tasks, "l_orderkey"), read(spark, sf_dir, "orders").repartition(tasks, "o_orderkey")
    owner, k = F.concat(F.lit("w"), F.col("o_custkey") % 200), F.col("o_orderkey")
    leg = F.struct(F.concat(F.lit("w"), F.col("o_custkey") % 200).alias("owner"), F.concat(F.lit("m"), F.col("l_partkey") % 3).alias("mint"), F.col("l_quantity").alias("amount"))
    sold = F.col("l_returnflag") == "R"
    cost = F.sum(F.when(sold, -F.col("l_quantity")).otherwise(F.col("l_quantity")))
    j = o.join(items, o.o_orderkey == items.l_orderkey)
    d = j.groupBy("o_orderkey", "o_custkey").agg(F.collect_list(F.when(sold, leg)).alias("a"), F.collect_list(F.when(~sold, leg)).alias("b"), cost.alias("net"))
    kind = F.col("o_custkey") % 3
    quote = lambda mint, amount: F.struct(owner.alias("owner"), F.lit(mint).alias("mint"), amount.cast("double").alias("amount"))
    no = F.expr("cast(array() as array<struct<owner:string,mint:string,amount:double>>)")
    pre = F.concat("a", F.when(kind == 0, F.array(quote(rx.WSOL, 10_000 + F.col("net") * 2))).when(kind == 2, F.array(quote(rx.USDC, 10_000 + F.col("net")))).otherwise(no))
    post = F.concat("b", F.when(kind == 0, F.array(quote(rx.WSOL, F.lit(10_000)))).when(kind == 2, F.array(quote(rx.USDC, F.lit(10_000)))).otherwise(no))
    lam = F.when(kind == 1, (F.col("net") * 1_000_000_000).cast("long")).otherwise(F.lit(0).cast("long"))
    big = F.lit(10**15)
    call = lambda p, a: F.struct(F.lit(p).alias("program"), a.alias("accounts"))
    accounts = F.array(F.lit("x"), F.concat(F.lit("pool"), k % 50), owner)
    venue = F.when(k % 4 == 0, F.array(call("ray", accounts), call("jup", accounts))).when(k % 4 == 1, F.array(call("pump", accounts))).when(k % 4 == 2, F.array(call("jup", accounts))).otherwise(F.array(call("sys", accounts)))
    return d.select(
        k.alias("signature"), k.alias("slot"), F.when(k % 11 == 0, "failed").alias("err"), F.lit(5000).cast("long").alias("fee"),
        F.array(F.struct(F.lit("relay").alias("pubkey"), F.lit(False).alias("signer")), F.struct(owner.alias("pubkey"), F.lit(True).alias("signer"))).alias("static_keys"),
        F.array(F.concat(F.lit("bank"), k % 7)).alias("writable"), F.array(F.lit(rx.TIP_ACCOUNTS[0])).alias("readonly"),
        F.array(big, big + lam + 6000, big, F.lit(0).cast("long")).alias("pre"), F.array(big, big, big + lam, F.lit(1000).cast("long")).alias("post"), pre.alias("pre_tokens"), post.alias("post_tokens"),
        F.when(k % 5 == 0, F.array(F.lit("Program log: Instruction: Buy"))).otherwise(F.array(F.lit("x"))).alias("logs"), venue.alias("calls"),
    )


_D = """WITH j AS (SELECT o_orderkey AS signature, 'w' || (o_custkey % 200) AS owner, o_custkey % 3 AS kind, 'm' || (l_partkey % 3) AS mint, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
net AS (SELECT signature, owner, kind, sum(x) AS net FROM j GROUP BY 1, 2, 3),
tok AS (SELECT signature, owner, mint, sum(x) AS delta FROM j GROUP BY 1, 2, 3
  UNION ALL SELECT signature, owner, 'So11111111111111111111111111111111111111112', -2 * net FROM net WHERE kind = 0
  UNION ALL SELECT signature, owner, 'EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v', -net FROM net WHERE kind = 2),
deltas AS (SELECT * FROM tok WHERE abs(delta) > 1e-12)"""

_SWAPS = _D + f""", own AS (SELECT signature, owner, mint, delta, row_number() OVER (PARTITION BY signature ORDER BY mint) AS i, count(*) OVER (PARTITION BY signature) AS n FROM deltas WHERE mint LIKE 'm_' AND signature % 11 <> 0),
q AS (SELECT signature, kind, CASE kind WHEN 0 THEN -2 * net WHEN 1 THEN -net ELSE -net END AS qd, net FROM net),
s AS (SELECT o.signature, o.owner AS wallet, o.mint, o.delta, CASE WHEN kind = 2 THEN '{rx.USDC}' ELSE '{rx.WSOL}' END AS quote_mint, abs(qd) AS quote_amount, 0 AS event_index FROM own o JOIN q USING (signature) WHERE n = 1 AND abs(qd) > 1e-12 AND sign(qd) = -sign(delta)
  UNION ALL SELECT a.signature, a.owner, a.mint, a.delta, b.mint, abs(b.delta), a.i - 1 FROM own a JOIN own b ON a.signature = b.signature AND a.i <> b.i WHERE a.n = 2 AND sign(a.delta) = -sign(b.delta)),
swaps AS (SELECT signature, wallet, mint, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, round(abs(delta), 6) AS token_amount, quote_mint, round(quote_amount, 6) AS quote_amount, CAST(event_index AS INT) AS event_index FROM s)"""


def swaps(spark, sf_dir):
    s = rx.infer_swaps(documents(spark, sf_dir))
    return s.withColumn("token_amount", F.round("token_amount", 6)).withColumn("quote_amount", F.round("quote_amount", 6))


@C.add("SELECT CAST(o_orderkey AS VARCHAR) AS signature, o_orderkey AS slot, 'w' || (o_custkey % 200) AS payer, CAST(3 AS INT) AS n_keys, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' END AS err, round(CAST(floor(o_totalprice) AS BIGINT) / 100, 6) AS amount FROM orders")
def a01_raw_document_source(spark, sf_dir):
    """Orders as nested JSON documents, written as text and read back through the explicit schema."""
    from uuid import uuid4

    from ..sources.tables import scratch

    o = read(spark, sf_dir, "orders")
    owner = F.concat(F.lit("w"), F.col("o_custkey") % 200)
    units = F.struct(F.floor("o_totalprice").cast("string").alias("amount"), F.lit(2).alias("decimals"))
    message = F.struct(F.array(F.struct(F.lit("relay").alias("pubkey"), F.lit(False).alias("signer")), F.struct(owner.alias("pubkey"), F.lit(True).alias("signer"))).alias("accountKeys"))
    transaction = F.struct(F.array(F.col("o_orderkey").cast("string")).alias("signatures"), message.alias("message"))
    meta = F.struct(
        F.when(F.col("o_orderkey") % 11 == 0, "failed").alias("err"), F.lit(5000).alias("fee"),
        F.array(F.struct(F.lit(1).alias("accountIndex"), F.lit("m").alias("mint"), owner.alias("owner"), units.alias("uiTokenAmount"))).alias("postTokenBalances"),
        F.struct(F.array(F.lit("bank")).alias("writable"), F.expr("cast(array() as array<string>)").alias("readonly")).alias("loadedAddresses"),
    )
    path = f"{scratch(spark)}/documents-{uuid4().hex}"
    o.select(F.to_json(F.struct(F.col("o_orderkey").alias("slot"), transaction.alias("transaction"), meta.alias("meta")))).write.text(path)
    docs = rx.flatten(spark.read.schema(rx.DOCUMENT).json(path))
    return docs.select("signature", "slot", rx.fee_payer().alias("payer"), F.size(rx.account_keys()).alias("n_keys"), "err", F.round(F.get("post_tokens", F.lit(0))["amount"], 6).alias("amount"))


@C.add(_D + f" SELECT signature, owner AS payer, [ 'relay', owner, 'bank' || (signature % 7), '{rx.TIP_ACCOUNTS[0]}'] AS keys, CAST(CASE signature % 4 WHEN 0 THEN 2 ELSE 1 END AS INT) AS programs, signature % 4 IN (0, 2) AS aggregator FROM net")
def c01_c04_c09_keys_and_programs(spark, sf_dir):
    return documents(spark, sf_dir).select("signature", rx.fee_payer().alias("payer"), rx.account_keys().alias("keys"), F.size(rx.program_ids()).alias("programs"), rx.aggregator_tag(["jup"]).alias("aggregator"))


@C.add(_D + " SELECT signature, owner, mint, round(delta, 6) AS delta FROM deltas")
def c02_token_deltas(spark, sf_dir):
    return rx.token_deltas(documents(spark, sf_dir)).withColumn("delta", F.round("delta", 6))


@C.add(_D + " SELECT signature, CASE WHEN kind = 1 THEN CAST(-net * 1000000000 AS BIGINT) ELSE 0 END AS lamports FROM net")
def c03_native_delta(spark, sf_dir):
    return rx.payer_deltas(documents(spark, sf_dir)).select("signature", "lamports")


@C.add(_SWAPS + " SELECT * FROM swaps")
def c05_c07_swap_inference(spark, sf_dir):
    again = F.explode(F.array(F.lit(0), F.lit(10)))  # the same events from a second adapter
    twice = swaps(spark, sf_dir).select("*", again.alias("by")).withColumn("event_index", F.col("event_index") + F.col("by")).drop("by")
    return rx.dedup_events(twice)


@C.add(_D + " SELECT signature, CASE signature % 4 WHEN 0 THEN 'raydium' WHEN 1 THEN 'pumpfun' ELSE 'jupiter' END AS venue FROM net WHERE signature % 4 < 3")
def c06_venue_attribution(spark, sf_dir):
    venues = spark.createDataFrame([("pump", "pumpfun", 0, False), ("ray", "raydium", 1, False), ("orca", "orca", 2, False), ("jup", "jupiter", 3, True)], "program string, venue string, priority int, aggregator boolean")
    return rx.attribute_venue(documents(spark, sf_dir), venues)


@C.add(_D + " SELECT signature, 'pool' || (signature % 50) AS pool FROM net WHERE signature % 4 < 2")
def c08_pool_attribution(spark, sf_dir):
    d = documents(spark, sf_dir)
    places = spark.createDataFrame([("ray", 1), ("pump", 1)], "program string, place int")
    return rx.attribute_pool(d, places, d.select("signature", rx.fee_payer().alias("wallet")))


@C.add(_D + " SELECT signature, 'pool' || (signature % 50) AS pool FROM net WHERE signature % 4 < 2 AND signature % 50 % 3 = 0")
def c08_owned_pools(spark, sf_dir):
    """Only accounts that own a token account of the transaction are pools; here every third one's balance is listed."""
    d = documents(spark, sf_dir)
    pool = F.concat(F.lit("pool"), F.col("signature") % 50)
    held = F.struct(pool.alias("owner"), F.lit("m0").alias("mint"), F.lit(1.0).alias("amount"))
    d = d.withColumn("post_tokens", F.when(F.col("signature") % 50 % 3 == 0, F.concat("post_tokens", F.array(held))).otherwise(F.col("post_tokens")))
    places = spark.createDataFrame([("ray", 1), ("pump", 1)], "program string, place int")
    return rx.attribute_pool(d, places, d.select("signature", rx.fee_payer().alias("wallet")), rx.token_owners(d))


@C.add(_D + " SELECT signature, CASE signature % 4 WHEN 0 THEN 'raydium' WHEN 1 THEN 'pumpfun' ELSE 'jupiter' END AS venue, CAST(0 AS INT) AS run FROM net WHERE signature % 4 < 3 UNION ALL SELECT signature, 'jupiter', 1 FROM net WHERE signature % 4 = 0")
def c06_matching_adapters(spark, sf_dir):
    """Every adapter whose program a transaction calls runs, in the order of priority."""
    venues = spark.createDataFrame([("pump", "pumpfun", 0, False), ("ray", "raydium", 1, False), ("orca", "orca", 2, False), ("jup", "jupiter", 3, True)], "program string, venue string, priority int, aggregator boolean")
    return rx.matching_venues(documents(spark, sf_dir), venues)


@C.add(_SWAPS + ", o AS (SELECT DISTINCT signature, mint FROM swaps WHERE signature % 7 = 0) SELECT mint, arg_min(wallet, signature) AS creator FROM (SELECT o.mint, o.signature, n.owner AS wallet FROM o JOIN net n USING (signature)) GROUP BY mint")
def a08_creators_of_mints(spark, sf_dir):
    """The payer of a token's first create transaction; every seventh document is one."""
    d = documents(spark, sf_dir)
    made = d.withColumn("logs", F.when(F.col("signature") % 7 == 0, F.concat("logs", F.array(F.lit(rx.CREATE_LINE)))).otherwise(F.col("logs")))
    return rx.first_creators(made, swaps(spark, sf_dir).select("signature", "mint").distinct())


@C.add(_SWAPS + " SELECT signature, wallet, mint, side, CASE WHEN signature % 10 = 0 THEN 'sell' ELSE 'buy' END AS logged FROM swaps WHERE signature % 5 = 0 AND side <> CASE WHEN signature % 10 = 0 THEN 'sell' ELSE 'buy' END")
def c10_side_audit(spark, sf_dir):
    d = documents(spark, sf_dir)
    return rx.side_audit(d, swaps(spark, sf_dir), d.filter("signature % 10 = 0").select("signature"))


@C.add(_D + " SELECT signature, owner AS wallet, 'bank' || (signature % 7) AS funder FROM net WHERE kind = 1 AND CAST(-net * 1000000000 AS BIGINT) - 6000 > 0")
def c11_incoming_funder(spark, sf_dir):
    d = documents(spark, sf_dir)
    return rx.incoming_funder(d, d.select(rx.fee_payer().alias("wallet")).distinct())
