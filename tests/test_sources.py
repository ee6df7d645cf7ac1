import json

import pytest

from tests import fetchers
from tideline.plans import catalog
from tideline.sources import blocklog, config, logs, sinks


def test_log_schema_and_aliases(spark, tmp_path):
    rows = [
        {"blockNumber": "0x3FE56C0", "transactionHash": "0xa", "logIndex": "0x2", "address": "0xABC", "topics": ["0x1", None], "data": "0x00", "timeStamp": "0x10"},
        {"blockNumber": "0x1", "txHash": "0xb", "contractAddress": "0xDEF", "data": "0x01", "timeStamp": "0x11"},
    ]
    (tmp_path / "l.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows))
    out = logs.read_logs(spark, str(tmp_path)).orderBy("blockNumber").collect()
    assert [(r["blockNumber"], r["txHash"], r["logIndex"], r["contractAddress"], r["block_timestamp"]) for r in out] == [(1, "0xb", 0, "0xdef", 17), (67000000, "0xa", 2, "0xabc", 16)]
    (tmp_path / "bad.jsonl").write_text(json.dumps({"blockNumber": None, "timeStamp": "0x1"}))
    with pytest.raises(Exception, match="null blockNumber"):
        logs.read_logs(spark, str(tmp_path / "bad.jsonl")).collect()


def test_empty_rates(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text("")
    assert logs.read_rates(spark, str(tmp_path)).columns == ["block", "source", "rate_x1e18", "method", "provenance_url"]


def test_provenance_round_trip(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(ValueError, match="gitCommit"):
        logs.write_panel(df, str(tmp_path / "p"), dict.fromkeys(logs.PROVENANCE_KEYS[:-1], "x"))
    assert not (tmp_path / "p").exists()
    logs.write_panel(df, str(tmp_path / "p"), dict.fromkeys(logs.PROVENANCE_KEYS, "x"))
    assert logs.read_provenance(spark, str(tmp_path / "p")) == dict.fromkeys(logs.PROVENANCE_KEYS, "x")


def test_paging_keeps_straddling_blocks():
    got = list(blocklog.pages(fetchers.fetch, "0xp", blocklog.Range(1, 30, "0xt"), page=25))
    assert len(got) == 300 == len({(x["transactionHash"], x["logIndex"]) for x in got})
    assert [(r.first, r.last) for r in blocklog.ranges(1, 25, 10, ["t"])] == [(1, 10), (11, 20), (21, 25)]


def test_retry_waits_and_gives_up():
    waits, calls = [], []

    def fail():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError):
        blocklog.with_retry(fail, 6, sleep=waits.append)
    assert len(calls) == 6 and waits == [1, 2, 4, 8, 16]


def test_source_in_spark(spark):
    spark.dataSource.register(blocklog.BlockLogSource)
    df = spark.read.format("blocklog").options(fetcher="tests.fetchers:fetch", fromBlock=1, toBlock=30, chunkSize=15, pageSize=25, topics="0xt,0xu", address="0xp").load()
    assert logs.log_rows(df.selectExpr("*", "NULL AS txHash", "NULL AS contractAddress")).count() == 600


def test_snapshots_survive_failures(spark):
    def fetch(b):
        if b == 2:
            raise OSError("gone")
        return {"tick": b * 10}

    blocks = spark.createDataFrame([(1,), (1,), (2,), (3,)], "blockNumber long")
    out = blocklog.snapshot_blocks(blocks, fetch, "blockNumber long, tick double").orderBy("blockNumber").collect()
    assert [r["blockNumber"] for r in out] == [1, 2, 3] and out[0]["tick"] == 10 and (out[1]["tick"] is None or out[1]["tick"] != out[1]["tick"])


def test_configuration():
    a = "0x" + "1" * 40
    p = config.load_protocol(f'[protocol]\nname = "x"\nchain_id = 5\n[protocol.anchor_pool]\naddress = "{a}"\nfee_tier_bps = 7777\n[protocol.vaults.v1]\nactive = true\n[protocol.vaults.v2]\nactive = false\n')
    assert p.finality == 120 and p.fee_tier == 7777 and p.active_vaults() == ["v1"]
    with pytest.raises(ValueError):
        config.load_protocol('[protocol]\n[protocol.anchor_pool]\naddress = "0x12"\n')
    assert config.verdict("---\nverdict: fail\n---\ntext") == "FAIL" and config.verdict("none") is None
    with pytest.raises(ValueError):
        config.calibration("---\nevidence_source: b\n---", "a")
    assert config.resolve_head("5", 6, 7, None) == 5 and config.resolve_head(None, None, 7, None) == 7
    with pytest.raises(ValueError):
        config.resolve_head(None, None, None, lambda: 1, dry_run=True)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    sinks.write_json_lines(df, str(tmp_path / "j"), ["k"])
    lines = "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part-*")))
    assert lines == '{"k":1,"v":"a"}\n{"k":2,"v":"b"}\n{"k":3,"v":"c"}\n'
    with pytest.raises(ValueError):
        sinks.artifact({"a": 1}, ["a", "b"])
    assert json.loads(sinks.artifact({"b": 2, "a": 1}, ["a"])) == {"a": 1, "b": 2}
    sinks.append_ledger(spark.createDataFrame([("x",)], "endpoint string"), str(tmp_path / "l"))
    sinks.append_ledger(spark.createDataFrame([("y",)], "endpoint string"), str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2


def _pages(spark, path, first, last):
    d = spark.range(first, last + 1).selectExpr(
        "concat('0x', lower(hex(id))) AS blockNumber", "'' AS blockHash", "concat('0x', id) AS transactionHash", "'0x0' AS logIndex", "'0xp' AS address", "array(concat('0xt', id % 2)) AS topics",
        "'0x' AS data", "concat('0x', hex(2 * id)) AS timeStamp", "id AS block",
    )
    blocklog.write_pages(d, path, 10)


def test_filters_choose_the_ranges_that_are_read(spark, tmp_path):
    _pages(spark, str(tmp_path / "p"), 0, 99)
    spark.dataSource.register(blocklog.BlockLogSource)
    df = spark.read.format("blocklog").options(path=str(tmp_path / "p"), chunkSize=10).load()
    assert df.rdd.getNumPartitions() == 10 and df.count() == 100
    some = df.filter("block > 24 AND block <= 39 AND topic = '0xt1'")
    assert some.rdd.getNumPartitions() == 2 and sorted(r["block"] for r in some.collect()) == list(range(25, 40, 2))
    both = df.filter("topic IN ('0xt0', '0xt1') AND data = '0x' AND block = 7")
    assert both.rdd.getNumPartitions() == 2 and both.count() == 1
    assert df.filter("topic = ''").count() == 0 and df.filter("block > 30 AND block < 20").count() == 0
    r = blocklog.BlockLogReader({"fetcher": "x:y", "fromBlock": "1", "toBlock": "30", "chunkSize": "10", "topics": "0xt,0xu"})
    left = list(r.pushFilters([blocklog.EqualTo(("topic",), "0xu"), blocklog.LessThan(("block",), 21), blocklog.EqualTo(("data",), "0x")]))
    assert [(p.first, p.last, p.topic) for p in r.partitions()] == [(1, 10, "0xu"), (11, 20, "0xu")] and blocklog.EqualTo(("data",), "0x") in left


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_block_queries_with_and_without_filters_handed_over(spark, pushed):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    was = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
    try:
        for name in ("block_pages", "block_filter"):
            got = sorted(map(tuple, catalog.queries()[name](spark, sf).collect()))
            assert got == sorted(con.execute(catalog.oracle_sql()[name]).fetchall()) and got
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", was)


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    spark.dataSource.register(blocklog.BlockLogSource)
    at = {k: str(tmp_path / k) for k in ("pages", "out", "checkpoint")}
    for first, last in ((0, 29), (30, 59), (60, 59)):
        if last >= first:
            _pages(spark, at["pages"], first, last)
        raw = spark.readStream.format("blocklog").options(path=at["pages"], chunkSize=10).load()
        raw.select("block").writeStream.format("parquet").option("checkpointLocation", at["checkpoint"]).trigger(availableNow=True).start(at["out"]).awaitTermination()
        got = sorted(r["block"] for r in spark.read.parquet(at["out"]).collect())
        assert got == list(range(last + 1))


def test_offsets_of_the_stream():
    s = blocklog.BlockLogStream({"fetcher": "tests.fetchers:fetch", "toBlock": "100", "confirmations": "12", "blocksPerBatch": "50", "chunkSize": "30", "fromBlock": "1"})
    assert [s.initialOffset()["block"], s.latestOffset()["block"], s.latestOffset()["block"], s.latestOffset()["block"]] == [0, 50, 88, 88]
    assert [(p.first, p.last) for p in s.partitions({"block": 0}, {"block": 50})] == [(1, 30), (31, 50)]
    with pytest.raises(ValueError, match="fell back"):
        s.partitions({"block": 50}, {"block": 40})
