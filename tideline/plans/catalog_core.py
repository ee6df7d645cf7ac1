"""Catalog: sources, projections, joins, set operations, samples and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import bigints, scalars
from tideline.operators import asof, ledger, panel
from tideline.plans.registry import query
from tideline.session import table

HEAD_LAG = 120


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", asof.epoch_us("ts"))


@query(
    "asof_label_counts",
    """
    WITH p AS (SELECT user_id, epoch_us(ts) AS k FROM events WHERE event_type = 'purchase'),
         c AS (SELECT user_id, epoch_us(ts) AS rk, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY ALL),
         j AS (SELECT p.k, c.rk FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.k >= c.rk)
    SELECT CASE WHEN rk IS NULL THEN 'unavailable' WHEN rk = k THEN 'exact' ELSE 'forward_fill' END AS method,
           count(*) AS n
    FROM j GROUP BY 1
    """,
)
def asof_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    left = ev.filter("event_type = 'purchase'").select("user_id", F.col("us").alias("k"))
    right = ev.filter("event_type = 'click'").groupBy("user_id", F.col("us").alias("rk")).agg(F.max("value").alias("rate"))
    joined = asof.asof_backward(left, right, "k", "rk", ["rate"], by=["user_id"])
    return asof.label(joined, "k", "rk").groupBy("method").agg(F.count("*").alias("n"))


@query(
    "asof_rates",
    """
    WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS k FROM events WHERE event_type = 'purchase'),
         c AS (SELECT user_id, epoch_us(ts) AS rk, max(value) AS rate FROM events WHERE event_type = 'click' GROUP BY ALL)
    SELECT event_id, p.user_id, k, rk, rate, CASE WHEN rk IS NULL THEN 'unavailable' WHEN rk = k THEN 'exact' ELSE 'forward_fill' END AS method
    FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.k >= c.rk
    """,
)
def asof_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    left = ev.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("us").alias("k"))
    right = ev.filter("event_type = 'click'").groupBy("user_id", F.col("us").alias("rk")).agg(F.max("value").alias("rate"))
    return asof.label(asof.asof_backward(left, right, "k", "rk", ["rate"], by=["user_id"]), "k", "rk")


@query(
    "finality_cutoff",
    f"SELECT event_type, count(*) AS n FROM events WHERE epoch_us(ts) <= (SELECT max(epoch_us(ts)) FROM events) - {HEAD_LAG} * 1000000 GROUP BY event_type",
)
def finality_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    head = ev.agg(F.max("ts")).first()[0]  # a literal, so that the cutoff reaches the scan
    return panel.final_only(ev, F.lit(head), F.expr(f"INTERVAL {HEAD_LAG} SECONDS"), "ts").groupBy("event_type").agg(F.count("*").alias("n"))


@query("event_names", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'Swap' WHEN 'click' THEN 'Mint' WHEN 'signup' THEN 'Burn' ELSE 'Unknown' END AS event_name FROM events")
def event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = panel.lookup(F.col("event_type"), {"purchase": "Swap", "click": "Mint", "signup": "Burn"})
    return table(spark, sf_dir, "events").select("event_id", name.alias("event_name"))


@query("adapter_exclusion", "SELECT event_id, user_id, event_type FROM events WHERE NOT (event_type = 'view' AND user_id IN (1, 2, 3, 5, 8))")
def adapter_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.exclude(table(spark, sf_dir, "events"), "event_type", "view", ["user_id"], ["1", "2", "3", "5", "8"]).select("event_id", "user_id", "event_type")


@query("union_vertical", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def union_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return a.unionByName(b)


@query(
    "union_relaxed",
    """SELECT event_id, value AS paid, NULL::BIGINT AS visitor FROM events WHERE event_type = 'purchase'
       UNION ALL SELECT event_id, NULL, user_id FROM events WHERE event_type = 'signup'""",
)
def union_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    a = ev.filter("event_type = 'purchase'").select("event_id", F.col("value").alias("paid"))
    b = ev.filter("event_type = 'signup'").select("event_id", F.col("user_id").alias("visitor"))
    return a.unionByName(b, allowMissingColumns=True)


@query("key_difference", "SELECT n_nationkey AS k FROM nation EXCEPT ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return a.exceptAll(table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("k")))


@query(
    "range_flag_join",
    """SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN FALSE
         ELSE l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAY END AS in_range
       FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l_orderkey = o_orderkey""",
)
def range_flag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.col("l_orderkey").alias("k"))
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("lo"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("hi"))
    return panel.in_range(li, o, "k", "l_shipdate", "lo", "hi").select("l_orderkey", "l_linenumber", "in_range")


@query(
    "fee_attribution",
    """
    WITH a AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice * 100)::HUGEINT AS amt, l_quantity::HUGEINT AS own, (l_quantity + l_linenumber)::HUGEINT AS total, l_returnflag <> 'R' AS live FROM lineitem),
    f AS (SELECT *, CASE WHEN amt > 0 THEN (amt * 3000) // 997000 ELSE 0 END AS fee FROM a)
    SELECT l_orderkey, l_linenumber, fee::VARCHAR AS fee, (CASE WHEN live AND total > 0 THEN (fee * own) // total ELSE 0 END)::VARCHAR AS share FROM f
    """,
)
def fee_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    fee = scalars.swap_fee(F.round(F.col("l_extendedprice") * 100), 3000)
    d = li.select("l_orderkey", "l_linenumber", fee.alias("f"), F.col("l_quantity").alias("own"), (F.col("l_quantity") + F.col("l_linenumber")).alias("total"), (F.col("l_returnflag") != "R").alias("live"))
    share = scalars.vault_share(F.col("f"), F.col("own"), F.col("total"), F.col("live"))
    return d.select("l_orderkey", "l_linenumber", F.col("f").cast("string").alias("fee"), share.cast("string").alias("share"))


@query("hex_words", "SELECT event_id, event_id AS a, (event_id * 1000003)::BIGINT AS b, (event_id % 1000 - 500)::INTEGER AS tick, '0x' || lpad(lower(to_hex(event_id)), 40, '0') AS address FROM events")
def hex_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids encoded to 32-byte words and decoded again in the JVM."""
    w = lambda c: F.lpad(F.lower(F.hex(c)), 64, "0")
    tick = (F.col("event_id") % 1000 - 500).cast("long")
    signed = F.concat(F.when(tick < 0, F.lit("f" * 48)).otherwise(F.lit("0" * 48)), F.lpad(F.lower(F.hex(tick)), 16, "0"))
    d = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("0x"), w(F.col("event_id")), w(F.col("event_id") * 1000003), signed).alias("data"), F.concat(F.lit("0x"), w(F.col("event_id"))).alias("topic"))
    word = lambda i: scalars.word("data", i)
    return d.select("event_id", scalars.hex_to_long(F.substring(word(0), 49, 16)).alias("a"), scalars.word_decimal(word(1)).cast("long").alias("b"), scalars.word_int32(word(2)).alias("tick"), scalars.topic_address("topic").alias("address"))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw logs made of events: swaps, transfers, and rows that cannot be decoded."""
    w = lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 64, "0")
    neg = lambda c: F.concat(F.lit("f" * 48), F.lpad(F.lower(F.hex(-c.cast("long"))), 16, "0"))
    topic = {v: k for k, v in bigints.TOPICS.items()}
    cents = F.round(F.col("value") * 100).cast("long") + 1
    swap = F.concat(F.lit("0x"), w(cents), neg(cents), w(cents * 7), w(cents * 3), w(F.col("user_id") % 887272))
    move = F.concat(F.lit("0x"), w(cents))
    kind = F.col("event_type")
    t = lambda name: F.array(F.lit(topic[name]), F.concat(F.lit("0x"), w(F.col("user_id"))), F.concat(F.lit("0x"), w(F.col("user_id") + 1)))
    topics = F.when(kind == "purchase", t("Swap")).when(kind == "click", t("Transfer")).when(kind == "signup", t("Mint")).otherwise(F.array(F.lit("0x00")))
    return table(spark, sf_dir, "events").select("event_id", topics.alias("topics"), F.when(kind == "purchase", swap).when(kind == "click", move).otherwise(F.lit("0x")).alias("data"))


@query(
    "decode_payloads",
    """
    WITH e AS (SELECT event_id, event_type, user_id, (round(value * 100))::BIGINT + 1 AS c FROM events),
    a AS (SELECT *, '0x' || lpad(lower(to_hex(user_id)), 40, '0') AS x, '0x' || lpad(lower(to_hex(user_id + 1)), 40, '0') AS y FROM e)
    SELECT event_id,
      CASE event_type WHEN 'purchase' THEN 'Swap' WHEN 'click' THEN 'Transfer' WHEN 'signup' THEN 'Mint' ELSE 'Unknown' END AS event_name,
      CASE event_type WHEN 'purchase' THEN x END AS sender, CASE event_type WHEN 'click' THEN y END AS "to",
      CASE event_type WHEN 'purchase' THEN c::VARCHAR END AS amount0, CASE event_type WHEN 'purchase' THEN (-c)::VARCHAR END AS amount1,
      CASE event_type WHEN 'purchase' THEN (user_id % 887272)::INTEGER END AS tick,
      CASE event_type WHEN 'click' THEN c::VARCHAR END AS value, event_type = 'signup' AS failed
    FROM a
    """,
)
def decode_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = panel.decode(_logs(spark, sf_dir))
    return d.select("event_id", "event_name", "sender", "to", "amount0", "amount1", "tick", "value", F.col("decode_error").isNotNull().alias("failed"))


@query("tick_ratios")
def tick_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root prices of the distinct ticks of a table, then joined back: big integers once a tick."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 887272).cast("int").alias("tick"))
    known = t.select("tick").distinct().withColumn("sqrt_ratio", bigints.sqrt_ratio_udf("tick"))
    return t.join(known, "tick").withColumn("liquidity", bigints.liquidity_udf(F.col("tick"), F.col("tick") - 600, F.col("tick") + 600, F.lit("1000000000000000000"), F.col("o_orderkey").cast("string")))


@query("props_json", "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(
    "identifiers",
    """
    SELECT event_id, sha256('{"chainId":42220,"address":"0xabc","topic0":"' || event_type || '","fromBlock":' || event_id || ',"toBlock":' || (event_id + 9) || '}') AS cache_key,
           substr(sha256(event_type || event_id || 'v1'), 1, 12) AS run_id,
           ('0x' || substr(sha256(event_id || 'boot'), 1, 8))::BIGINT AS seed,
           CASE WHEN event_type = 'view' THEN 0 ELSE event_id END AS first_block
    FROM events
    """,
)
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    stem = F.when(F.col("event_type") == "view", F.lit("none")).otherwise(F.concat(e.cast("string"), F.lit("_"), (e + 9).cast("string")))
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.cache_key(F.lit(42220), F.lit("0xABC"), F.col("event_type"), e, e + 9).alias("cache_key"),
        scalars.run_id(F.col("event_type"), e.cast("string"), F.lit("v1")).alias("run_id"), scalars.seed_of(e.cast("string"), "boot").alias("seed"),
        scalars.block_range(stem)["first"].alias("first_block"),
    )


@query(
    "address_checks",
    """SELECT c_custkey, regexp_matches('0x' || substr(sha256(c_name), 1, 40 - (c_custkey % 2)::INT), '^0x[0-9a-fA-F]{40}$') AS address_ok,
         regexp_matches('0x' || sha256(c_name), '^0x[0-9a-fA-F]{64}$') AS tx_ok, 'https://explorer.example/tx/0x' || sha256(c_name) AS url FROM customer""",
)
def address_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.sha2("c_name", 256)
    cut = F.concat(F.lit("0x"), F.substr(h, F.lit(1), (40 - F.col("c_custkey") % 2).cast("int")))
    tx = F.concat(F.lit("0x"), h)
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.is_address(cut).alias("address_ok"), scalars.is_tx_hash(tx).alias("tx_ok"), scalars.tx_url(tx).alias("url"))


@query(
    "payment_headers",
    """SELECT c_custkey, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS ok,
         CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN '0x' || substr(sha256(c_name), 1, 40) END AS payer,
         CASE WHEN c_custkey % 3 = 0 THEN 'network' WHEN c_custkey % 5 = 0 THEN 'payer' END AS reason FROM customer""",
)
def payment_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    who = F.concat(F.lit("0x"), F.substr(F.sha2("c_name", 256), F.lit(1), F.when(c % 5 == 0, 39).otherwise(40)))
    body = F.to_json(F.struct(F.lit("exact").alias("scheme"), F.when(c % 3 == 0, "other").otherwise("main").alias("network"), F.struct(F.struct(who.alias("from")).alias("authorization"), F.lit("0xab").alias("signature")).alias("payload")))
    out = table(spark, sf_dir, "customer").select("c_custkey", scalars.payment_header(F.base64(body.cast("binary")), "main").alias("r"))
    return out.select("c_custkey", "r.*")


@query("seeded_sample", "SELECT doc_id, n_chars FROM documents ORDER BY md5('run' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.seeded_sample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 50, "run")


@query("distinct_sorted", "SELECT DISTINCT l_suppkey FROM lineitem ORDER BY 1")
def distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().orderBy("l_suppkey")


@query("first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("ledger_guard", "SELECT count(*) FILTER (event_type = 'error') = 0 AS ok, count(*) FILTER (event_type = 'error') AS hits FROM events")
def ledger_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.guard(table(spark, sf_dir, "events").withColumnRenamed("event_type", "endpoint"), "error")


@query(
    "ledger_month",
    """WITH n AS (SELECT date_trunc('month', max(ts)) AS since FROM events)
       SELECT count(*) AS used, count(*) >= 100 AS over FROM events, n WHERE event_type = 'error' AND ts >= since""",
)
def ledger_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint"), F.col("ts").alias("timestamp"))
    now = ev.agg(F.max("timestamp")).first()[0]
    return ledger.month_to_date(ev, F.lit(now), "error", 100)


@query(
    "fetch_budget",
    """SELECT s_suppkey, ceil(s_suppkey * 7777 / 10000.0)::BIGINT AS block_calls, ceil(s_acctbal / 1000)::BIGINT AS swap_calls,
         (ceil(s_suppkey * 7777 / 10000.0) + ceil(s_acctbal / 1000))::BIGINT AS calls, ceil(s_suppkey * 7777 / 10000.0) + ceil(s_acctbal / 1000) > 50 AS over
       FROM supplier WHERE s_acctbal > 0""",
)
def fetch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") > 0).alias("active"), (F.col("s_suppkey") * 7777).alias("blocks"), F.col("s_acctbal").alias("swaps"))
    return ledger.budget(v, 50).select("s_suppkey", "block_calls", "swap_calls", "calls", "over")


@query("manifest_upsert", "SELECT o_custkey AS k, 'old' AS origin FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    old = o.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k"), F.lit("old").alias("origin"))
    return ledger.insert_new(old, o.select(F.col("o_custkey").alias("k"), F.lit("new").alias("origin")), "k")


@query("manifest_find", "SELECT doc_id, lang, source FROM documents WHERE source = 'src3'")
def manifest_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.find(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "source", "src3")


@query("freshness", "SELECT s_suppkey, 5000 - s_suppkey AS lag, 5000 - s_suppkey <= 4950 AS fresh FROM supplier")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.fresh(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("block")), 5000, 4950).select("s_suppkey", "lag", "fresh")


@query("contract_keys", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'b,c' ELSE 'c' END AS missing FROM nation")
def contract_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(ledger.missing_keys(have, ["a", "b", "c"]), ",").alias("missing"))


@query(
    "content_hash",
    """WITH h AS (SELECT sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}') AS h FROM customer)
       SELECT sha256(concat_ws(':', count(*), """
    + ", ".join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT)" for k in range(8))
    + ")) AS hash FROM h",
)
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.content_hash(table(spark, sf_dir, "customer").select("c_name", "c_custkey", "c_mktsegment"))


@query(
    "sensitivity_sweep",
    """WITH g AS (SELECT unnest([0.1, 0.2, 0.3]::DOUBLE[]) AS lam), h AS (SELECT unnest([1.0, 2.0, 3.0]::DOUBLE[]) AS mu)
       SELECT o_custkey, count(*) AS cells, count(DISTINCT o_totalprice * lam * mu > 50000) AS outcomes, count(DISTINCT o_totalprice * lam * mu > 50000) = 1 AS invariant FROM orders, g, h GROUP BY o_custkey""",
)
def sensitivity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer: whether a decision on their orders is the same everywhere on a grid of parameters."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    cells = ledger.sweep_rows(o, {"lam": [0.1, 0.2, 0.3], "mu": [1.0, 2.0, 3.0]}, F.col("o_totalprice") * F.col("lam") * F.col("mu") > 50000)
    return ledger.invariance(cells, ["o_custkey"])


@query(
    "firing_decision",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 'null_cost' WHEN o_totalprice / 1e6 >= 0.25 THEN 'null_lr'
         WHEN o_orderkey % 2 = 0 THEN 'null_convex' WHEN o_orderkey % 5 = 0 THEN 'null_strip_unavailable' END AS verdict FROM orders""",
)
def firing_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cost = F.when((F.col("o_orderstatus") == "F") & (k % 7 == 0), "FAIL").otherwise("PASS")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.firing(cost, F.col("o_totalprice") / 1e6, k % 2 != 0, k % 5 == 0, 0.25).alias("verdict"))


@query("cost_leg", "SELECT p_partkey, CASE WHEN p_retailprice > 1200 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM part")
def cost_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.cost_verdict(F.col("p_retailprice"), F.lit(1200)).alias("verdict"))


@query("price_ranks", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rk FROM customer")
def price_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(w).cast("long").alias("rk"))
