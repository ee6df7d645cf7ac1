import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import bigints, digests, scalars


def test_sqrt_ratio_anchors():
    assert bigints.sqrt_ratio(0) == 1 << 96
    assert bigints.sqrt_ratio(-bigints.MAX_TICK) == 4295128739
    assert bigints.sqrt_ratio(bigints.MAX_TICK) == 1461446703485210103287273052203988822378723970342
    for t in (1, 100, 10000):
        assert bigints.sqrt_ratio(-t) < 1 << 96 < bigints.sqrt_ratio(t)
        assert abs(bigints.sqrt_ratio(t) / 2**96 - 1.0001 ** (t / 2)) < 1e-9 * 1.0001 ** (t / 2)
    with pytest.raises(ValueError):
        bigints.sqrt_ratio(bigints.MAX_TICK + 1)


def test_liquidity_branches():
    a, b = bigints.sqrt_ratio(-600), bigints.sqrt_ratio(600)
    below, inside, above = bigints.sqrt_ratio(-1000), 1 << 96, bigints.sqrt_ratio(1000)
    assert bigints.liquidity(below, a, b, 10**18, 0) > 0 == bigints.liquidity(below, a, b, 0, 10**18)
    assert bigints.liquidity(above, a, b, 0, 10**18) > 0 == bigints.liquidity(above, a, b, 10**18, 0)
    assert bigints.liquidity(inside, a, b, 10**18, 10**18) == bigints.liquidity(inside, b, a, 10**18, 10**18) > 0


def test_topics_are_hashes_of_signatures():
    assert bigints.TOPICS[bigints.topic_of("Transfer(address,address,uint256)")] == "Transfer"
    assert bigints.TOPICS[bigints.topic_of("Swap(address,address,int256,int256,uint160,uint128,int24)")] == "Swap"
    assert bigints.TOPICS[bigints.topic_of("Mint(address,address,int24,int24,uint128,uint256,uint256)")] == "Mint"
    assert bigints.TOPICS[bigints.topic_of("Burn(address,int24,int24,uint128,uint256,uint256)")] == "Burn"


def test_decode_and_errors():
    pad = lambda x: f"{x & (1 << 256) - 1:064x}"
    data = "0x" + "".join(map(pad, (100, -100, 10**30, 2**127, -4000)))
    got = bigints.decode_one("Swap", ["", "0x" + pad(1), "0x" + pad(2)], data)
    assert (got["amount0"], got["amount1"], got["sqrtPriceX96"], got["liquidity"], got["tick"]) == ("100", "-100", str(10**30), str(2**127), -4000)
    assert got["decode_error"] is None and got["sender"] == "0x" + "0" * 39 + "1"
    assert "words" in bigints.decode_one("Swap", ["", "0x1", "0x2"], "0x00")["decode_error"]
    assert bigints.decode_one("Mint", ["", "0x" + pad(1)], "0x" + pad(1) * 4)["decode_error"].startswith("IndexError")
    assert bigints.decode_one("Unknown", None, None)["decode_error"] is None


def test_fee_exact_and_overflow(spark):
    df = spark.createDataFrame([("1000000000000000000", "1000000000000000000000", "7"), ("-5", "1", "1"), ("99999999999", "1", "0"), (None, "1", "1")], "a string, own string, total string")
    fee = scalars.swap_fee(F.col("a"), 100)
    out = df.select(fee.cast("string").alias("fee"), scalars.vault_share(fee, F.col("own"), F.col("total"), F.lit(True)).cast("string").alias("share"), bigints.share_udf(fee.cast("string"), "own", "total").alias("exact")).collect()
    assert [r["fee"] for r in out] == ["100010001000100", "0", str(99999999999 * 100 // 999900), "0"]
    assert out[0]["exact"] == str(100010001000100 * 10**21 // 7)
    assert out[0]["share"] in (None, out[0]["exact"])  # null where 38 digits do not hold the quotient
    assert [r["share"] for r in out[1:]] == ["0", "0", "0"]


def test_floor_div_does_not_round(spark):
    df = spark.createDataFrame([("99999999999", "100000000000", "0"), ("100000000000000000000000", "7", "14285714285714285714285"), ("5", "0", None)], "a string, b string, q string")
    assert all(r["x"] == r["q"] for r in df.select(scalars.floor_div(F.col("a"), F.col("b")).cast("string").alias("x"), "q").collect())


def test_payment_header_reasons(spark):
    import base64
    import json

    ok = {"scheme": "exact", "network": "main", "payload": {"authorization": {"from": "0x" + "Ab" * 20}, "signature": "0x12"}}
    enc = lambda d: base64.b64encode(json.dumps(d).encode()).decode()
    rows = [enc(ok), enc(ok | {"scheme": "x"}), enc(ok | {"network": "y"}), enc(ok | {"payload": {}}), "%%%", None]
    out = spark.createDataFrame([(r,) for r in rows], "h string").select(scalars.payment_header(F.col("h"), "main").alias("p")).select("p.*").collect()
    assert [r["reason"] for r in out] == [None, "scheme", "network", "payer", "malformed", "malformed"]
    assert out[0]["ok"] and out[0]["payer"] == "0x" + "ab" * 20


def test_firing_order(spark):
    df = spark.createDataFrame([("FAIL", 0.9, False, True), ("PASS", 0.9, False, True), ("PASS", 0.01, False, True), ("PASS", float("nan"), True, True), (None, 0.01, True, False)], "c string, p double, g boolean, s boolean")
    out = df.select(scalars.firing(F.col("c"), F.col("p"), F.col("g"), F.col("s")).alias("v")).collect()
    assert [r["v"] for r in out] == ["null_cost", "null_lr", "null_convex", "null_strip_unavailable", None]


def test_liquidity_udf_bad_input(spark):
    df = spark.createDataFrame(pd.DataFrame({"t": [0, None], "x": ["10", "oops"]}).astype(object), "t int, x string")
    out = df.select(bigints.liquidity_udf("t", F.lit(-10), F.lit(10), "x", F.lit("10")).alias("l")).collect()
    assert out[0]["l"] != "0" and out[1]["l"] == "0"


def test_md5_of_many_numbers():
    from hashlib import md5

    numbers = np.array([0, 7, 10, 99, 100, 123456789, 10**17, -5])
    prefixes = [b"perm:1:", b"perm:10:", b"perm:999:", b"x" * 50]
    got = digests.md5(prefixes, numbers)
    want = [[md5(p + str(x).encode()).hexdigest() for x in numbers.tolist()] for p in prefixes]
    assert [[f"{a:016x}{b:016x}" for a, b in row] for row in got.tolist()] == want
