"""Catalog: sources and sinks, each written from a table to the shared folder and read back, and big integers in closed form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import bigints
from tideline.plans.registry import query
from tideline.session import shared_dir, table
from tideline.sources import blocklog, config, logs, sinks

LOGS, CHUNK = 10, 250


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/catalog/{name}-{uuid.uuid4().hex}"


def _hex(c) -> F.Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(c.cast("long"))))


@query(
    "log_lines",
    """SELECT event_id AS "blockNumber", '' AS "blockHash", '0x' || sha256(event_id::VARCHAR) AS "txHash", user_id AS "logIndex", '0xpool' || (user_id % 7) AS "contractAddress",
         event_type AS first_topic, '0x' AS data, event_id * 3 + 5 AS block_timestamp FROM events""",
)
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw logs as JSON lines, in order, and their typed rows."""
    at = _scratch(spark, "logs")
    wire = table(spark, sf_dir, "events").select(
        _hex(F.col("event_id")).alias("blockNumber"), F.concat(F.lit("0x"), F.sha2(F.col("event_id").cast("string"), 256)).alias("transactionHash"), _hex(F.col("user_id")).alias("logIndex"),
        F.concat(F.lit("0xPool"), (F.col("user_id") % 7).cast("string")).alias("address"), F.array("event_type", F.lit("second")).alias("topics"), _hex(F.col("event_id") * 3 + 5).alias("timeStamp"),
    )
    sinks.write_json_lines(wire, at, ["blockNumber"])
    return logs.read_logs(spark, at).withColumn("first_topic", F.col("topics")[0]).drop("topics")


@query("state_lines", """SELECT event_id AS "blockNumber", (event_id * 1000000007)::VARCHAR AS "totalAmounts_0", '1' AS "totalSupply", user_id::INTEGER AS "currentTick", CASE WHEN event_id % 2 = 0 THEN 20 END AS "lowerTick" FROM events""")
def state_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scratch(spark, "state")
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("blockNumber"), (F.col("event_id") * 1000000007).cast("string").alias("totalAmounts_0"), F.lit("1").alias("totalSupply"), F.col("user_id").alias("currentTick"), F.when(F.col("event_id") % 2 == 0, 20).alias("lowerTick"))
    sinks.write_json_lines(rows, at, ["blockNumber"])
    return logs.read_state(spark, at).select("blockNumber", "totalAmounts_0", "totalSupply", "currentTick", "lowerTick")


@query("rate_lines", "SELECT event_id AS block, 'broker' AS source, (event_id * 10)::VARCHAR AS rate_x1e18, CASE WHEN event_id % 20 = 0 THEN 'exact' ELSE 'unavailable' END AS method, NULL::VARCHAR AS provenance_url FROM events WHERE event_id % 10 = 0")
def rate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scratch(spark, "rates")
    e = table(spark, sf_dir, "events").filter("event_id % 10 = 0")
    rows = e.select(F.col("event_id").alias("block"), F.lit("broker").alias("source"), (F.col("event_id") * 10).cast("string").alias("rate_x1e18"), F.when(F.col("event_id") % 20 == 0, "exact").otherwise("unavailable").alias("method"))
    sinks.write_json_lines(rows, at, ["block"])
    return logs.read_rates(spark, at)


@query("ledger_lines", "SELECT event_type AS endpoint, count(*) AS calls, sum(event_id)::BIGINT AS cost FROM events GROUP BY event_type")
def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger appended to twice, with lines that do not parse, which are skipped."""
    at = _scratch(spark, "ledger")
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("event_type").alias("endpoint"), F.col("event_id").cast("double").alias("cost"), "event_id")
    for k in (0, 1):
        sinks.append_ledger(e.filter(F.col("event_id") % 2 == k).drop("event_id"), at)
    spark.createDataFrame([("{broken",), ("",)], "value string").write.mode("append").text(at)
    return logs.read_ledger(spark, at).groupBy("endpoint").agg(F.count("*").alias("calls"), F.sum("cost").cast("long").alias("cost"))


@query("panel_files", "SELECT l_returnflag, count(*) AS n, 'tables' AS chain FROM lineitem GROUP BY l_returnflag")
def panel_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel written with its provenance, which is read back from the schema alone."""
    at = _scratch(spark, "panel")
    logs.write_panel(table(spark, sf_dir, "lineitem"), at, dict.fromkeys(logs.PROVENANCE_KEYS, "x") | {"chainId": "tables"})
    return spark.read.parquet(at).groupBy("l_returnflag").agg(F.count("*").alias("n")).withColumn("chain", F.lit(logs.read_provenance(spark, at)["chainId"]))


@query("manifest_file", "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 10 THEN 'old' ELSE 'new' END AS origin FROM nation")
def manifest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _scratch(spark, "manifest")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    sinks.upsert_manifest(n.filter("k < 10").withColumn("origin", F.lit("old")), n.withColumn("origin", F.lit("new")), "k", at)
    return spark.read.parquet(at)


def _block_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a wire log, LOGS a block."""
    k = F.col("event_id")
    block = F.floor(k / LOGS).cast("long")
    return table(spark, sf_dir, "events").select(
        _hex(block).alias("blockNumber"), F.lit("").alias("blockHash"), F.concat(F.lit("0x"), k.cast("string")).alias("transactionHash"), _hex(k % LOGS).alias("logIndex"), F.lit("0xp").alias("address"),
        F.array("event_type").alias("topics"), F.lit("0x").alias("data"), _hex(2 * block).alias("timeStamp"), block.alias("block"),
    )


def _typed(raw: DataFrame) -> DataFrame:
    d = logs.log_rows(raw.selectExpr("*", "NULL AS txHash", "NULL AS contractAddress"))
    return d.select("blockNumber", "logIndex", F.col("topics")[0].alias("topic"), "block_timestamp")


@query("block_pages", f"""SELECT event_id // {LOGS} AS "blockNumber", event_id % {LOGS} AS "logIndex", event_type AS topic, 2 * (event_id // {LOGS}) AS block_timestamp FROM events""")
def block_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block-log source over pages made of the events: a partition a chunk of blocks."""
    at = _scratch(spark, "pages")
    blocklog.write_pages(_block_logs(spark, sf_dir), at, CHUNK)
    return _typed(blocklog.load(spark, path=at, chunkSize=CHUNK))


@query("block_filter", f"""SELECT event_id // {LOGS} AS "blockNumber", event_id % {LOGS} AS "logIndex", event_type AS topic, 2 * (event_id // {LOGS}) AS block_timestamp FROM events WHERE event_id // {LOGS} >= 120 AND event_type IN ('purchase', 'click')""")
def block_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same source under a filter on blocks and topics, which the source takes over, where the session lets it, and reads only those chunks."""
    at = _scratch(spark, "pages")
    blocklog.write_pages(_block_logs(spark, sf_dir), at, CHUNK)
    raw = blocklog.load(spark, path=at, chunkSize=CHUNK)
    return _typed(raw.filter((F.col("block") >= 120) & F.col("topic").isin("purchase", "click")))


@query("block_stream", f"""SELECT event_id // {LOGS} AS "blockNumber", event_id % {LOGS} AS "logIndex", event_type AS topic, 2 * (event_id // {LOGS}) AS block_timestamp FROM events""")
def block_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source as a stream, run twice over growing pages with one checkpoint: the second run takes the new chunks alone."""
    at = _scratch(spark, "stream")
    wire = _block_logs(spark, sf_dir)
    spark.dataSource.register(blocklog.BlockLogSource)
    half = (wire.agg(F.max("block")).first()[0] or 0) // CHUNK // 2 * CHUNK
    for part in ("block < {}", "block >= {}"):
        blocklog.write_pages(wire.filter(part.format(half)), f"{at}/pages", CHUNK)
        raw = spark.readStream.format("blocklog").options(path=f"{at}/pages", chunkSize=CHUNK).load()
        run = _typed(raw).writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out")
        run.awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("block_snapshots", """SELECT DISTINCT l_suppkey AS "blockNumber", CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey * 10 END AS tick FROM lineitem""")
def block_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-in-time reads of distinct blocks; reads that fail leave nulls."""

    def fetch(block: int) -> dict:
        if block % 7 == 0:
            raise OSError("no such block")
        return {"tick": block * 10}

    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("blockNumber"))
    got = blocklog.snapshot_blocks(blocks, fetch, "blockNumber long, tick double")
    return got.select("blockNumber", F.when(~F.isnan("tick"), F.col("tick")).cast("long").alias("tick"))


@query("tx_logs", """SELECT event_id AS "blockNumber", '0x' || user_id AS "txHash", user_id AS "logIndex", '0xabc' AS "contractAddress", 2 AS topics FROM events WHERE event_type = 'purchase'""")
def tx_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of transactions in the newer shape, of one topic, as the older one's rows."""
    e = table(spark, sf_dir, "events")
    items = e.select(
        F.col("event_id").alias("block_number"), F.lit("").alias("block_hash"), F.concat(F.lit("0x"), F.col("user_id").cast("string")).alias("transaction_hash"), F.col("user_id").alias("index"),
        F.struct(F.lit("0xABC").alias("hash")).alias("address"), F.array("event_type", F.lit(None), F.lit("0x2")).alias("topics"), F.lit("0x").alias("data"),
    )
    return logs.log_rows(logs.normalise_tx_logs(items, "purchase")).select("blockNumber", "txHash", "logIndex", "contractAddress", F.size("topics").alias("topics"))


@query(
    "protocol_file",
    """WITH s AS (SELECT s_suppkey, s_suppkey % 10 = 9 AS bad, s_suppkey % 2 = 0 AS short FROM supplier)
       SELECT s_suppkey, v AS vault, CASE v WHEN 'v1' THEN s_suppkey % 3 = 0 WHEN 'v2' THEN FALSE END AS active, CASE WHEN NOT bad THEN (500 + s_suppkey)::INTEGER END AS fee_tier,
         CASE WHEN NOT bad THEN CASE WHEN short THEN 64 ELSE 120 END END AS finality, CASE WHEN NOT bad THEN '0x' || substr(sha256(s_suppkey::VARCHAR), 1, 40) END AS pool, bad AS broken,
         CASE WHEN s_suppkey % 4 = 0 THEN 1000 + s_suppkey WHEN s_suppkey % 4 = 1 THEN 2000 + s_suppkey ELSE 42 END AS head
       FROM s, (SELECT unnest(['v1', 'v2', NULL]) AS v) WHERE (v IS NULL) = bad""",
)
def protocol_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications, one a supplier, parsed in bulk, some of them with an address that is none, and the head of each."""
    k = F.col("s_suppkey")
    line = lambda *parts: F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])
    text = F.concat_ws(
        "\n", line("[protocol]"), line('name = "p', k.cast("string"), '"'), line("chain_id = 5"), F.when(k % 2 == 0, "finality = 64"),
        line("[protocol.anchor_pool]"), line('address = "0x', F.substring(F.sha2(k.cast("string"), 256), 1, 40), F.when(k % 10 == 9, "z").otherwise(""), '"'), line("fee_tier_bps = ", (500 + k).cast("string")),
        line("[protocol.vaults.v1]"), line("active = ", F.when(k % 3 == 0, "true").otherwise("false")), line("[protocol.vaults.v2]"), line("active = false"),
    )
    s = table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text"))
    head = config.head_of(F.when(k % 4 == 0, (1000 + k).cast("string")).otherwise(""), F.when(k % 4 == 1, 2000 + k), F.lit(42))
    return config.protocols(s, "text", "s_suppkey").select("s_suppkey", "vault", "active", "fee_tier", "finality", "pool", F.col("error").isNotNull().alias("broken"), head.alias("head"))


@query(
    "front_matter",
    """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN upper(source) END AS verdict, CASE WHEN doc_id % 3 > 0 THEN lang END AS evidence, CASE WHEN doc_id % 3 > 0 AND lang = 'en' THEN TRUE ELSE FALSE END AS calibrated FROM documents""",
)
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and evidence of whole documents, two of three with front matter before their text."""
    head = F.concat(F.lit("---\nverdict : none\nverdict: "), F.col("source"), F.lit("\nevidence_source: '"), F.col("lang"), F.lit("'\n---\nverdict: pass\n"))
    text = F.concat(F.when(F.col("doc_id") % 3 > 0, head).otherwise(""), F.coalesce("text", F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    evidence = config.front_matter_value(F.col("text"), "evidence_source")
    return d.select("doc_id", F.upper(config.front_matter_value(F.col("text"), "verdict")).alias("verdict"), evidence.alias("evidence"), F.coalesce(evidence == "en", F.lit(False)).alias("calibrated"))


#: Signatures of events and the topics that are known for them.
SIGNATURES = {
    "Swap(address,address,int256,int256,uint160,uint128,int24)": "0xc42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67",
    "Mint(address,address,int24,int24,uint128,uint256,uint256)": "0x7a53080ba414158be7ec69b987b5fb7d07dee101fe85488f0853ae16239d0bde",
    "Burn(address,int24,int24,uint128,uint256,uint256)": "0x0c396cd989a39f4459b5fa1aed6a9a8dcdbc45908acfd67e028cd568da98982c",
    "Transfer(address,address,uint256)": "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef",
}


_KINDS = dict(zip(("purchase", "click", "view"), SIGNATURES, strict=False))
_LAST = list(SIGNATURES)[-1]


@query(
    "topic_hashes",
    f"SELECT CASE event_type {' '.join(f"WHEN '{k}' THEN '{s}'" for k, s in _KINDS.items())} ELSE '{_LAST}' END AS signature, "
    f"CASE event_type {' '.join(f"WHEN '{k}' THEN '{SIGNATURES[s]}'" for k, s in _KINDS.items())} ELSE '{SIGNATURES[_LAST]}' END AS topic, count(*) AS n FROM events GROUP BY 1, 2",
)
def topic_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic of each signature that events have, hashed once a signature."""
    kind = F.lit(_LAST)
    for name, signature in _KINDS.items():
        kind = F.when(F.col("event_type") == name, signature).otherwise(kind)
    n = table(spark, sf_dir, "events").groupBy(kind.alias("signature")).agg(F.count("*").alias("n"))
    return n.select("signature", bigints.topic_udf("signature").alias("topic"), "n")


@query(
    "tick_values",
    """WITH t AS (SELECT o_orderkey, (o_orderkey * 37) % 1200001 - 600000 AS tick FROM orders), p AS (SELECT *, 4.999750016665417e-05 AS h FROM t),
       r AS (SELECT *, exp(600 * h) AS w, (o_orderkey + 1) * 1e22 AS x, (o_orderkey + 7) * 1e22 AS y FROM p)
       SELECT o_orderkey, tick::INTEGER AS tick, round(tick * h, 6) AS log_root,
         CASE WHEN abs(tick) <= 200000 THEN round(ln(least(x * exp(tick * h) * w / (w - 1), y / (exp(tick * h) * (1 - 1 / w)))), 9) END AS log_liquidity FROM r""",
)
def tick_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logarithms of exact root prices and liquidities, which have a closed form."""
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select("o_orderkey", (F.pmod(k * 37, F.lit(1200001)) - 600000).cast("int").alias("tick"))
    zeros = F.lit("0" * 22)
    amounts = F.concat((k + 1).cast("string"), zeros), F.concat((k + 7).cast("string"), zeros)
    liquidity = F.when(F.abs("tick") <= 200000, bigints.liquidity_udf(F.col("tick"), F.col("tick") - 600, F.col("tick") + 600, *amounts).cast("double"))
    root = F.ln(bigints.sqrt_ratio_udf("tick").cast("double") / float(1 << 96))
    return t.select("o_orderkey", "tick", F.round(root, 6).alias("log_root"), F.round(F.ln(liquidity), 9).alias("log_liquidity"))
