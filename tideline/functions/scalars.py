"""Scalar functions as Column expressions: hexadecimal words, addresses, hashes, keys, decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS = "^0x[0-9a-fA-F]{40}$"
TX_HASH = "^0x[0-9a-fA-F]{64}$"
NUMERIC = "decimal(38,0)"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hex_to_long(x: str | Column) -> Column:
    """A 0x-prefixed or plain hexadecimal string of up to 63 bits as a long; null stays null."""
    return F.conv(F.regexp_replace(_c(x), "^0[xX]", ""), 16, 10).cast("long")


def topic_address(x: str | Column) -> Column:
    """The address in the last 20 bytes of a 32-byte topic, in lower case."""
    return F.concat(F.lit("0x"), F.lower(F.right(_c(x), F.lit(40))))


def word(data: str | Column, i: int) -> Column:
    """The i-th 32-byte word of 0x-prefixed data, as 64 hexadecimal digits."""
    return F.substring(_c(data), 3 + 64 * i, 64)


def word_int32(w: Column) -> Column:
    """A sign-extended word whose value fits 32 bits, as an int: ticks, for one."""
    low = F.conv(F.right(w, F.lit(8)), 16, 10).cast("long")
    return F.when(low >= 2**31, low - 2**32).otherwise(low).cast("int")


def word_decimal(w: Column) -> Column:
    """An unsigned word below 10^37 as a decimal, from two halves of 15 digits; null where it is larger.

    Only the lower 120 bits are read; the upper 34 digits must be zero.
    """
    high = F.conv(F.substring(w, 35, 15), 16, 10).cast(NUMERIC)
    low = F.conv(F.substring(w, 50, 15), 16, 10).cast(NUMERIC)
    fits = F.substring(w, 1, 34) == F.lit("0" * 34)
    return F.when(fits, F.try_add(F.try_multiply(high, F.lit(2**60).cast(NUMERIC)), low).cast(NUMERIC))


def is_address(x: str | Column) -> Column:
    return _c(x).rlike(ADDRESS)


def is_tx_hash(x: str | Column) -> Column:
    return _c(x).rlike(TX_HASH)


def tx_url(x: str | Column, template: str = "https://explorer.example/tx/%s") -> Column:
    return F.format_string(template, _c(x))


def cache_key(chain: Column, address: Column, topic: Column, first: Column, last: Column) -> Column:
    """sha256 of a request's canonical JSON: fixed order of keys, the address in lower case."""
    text = F.format_string('{"chainId":%d,"address":"%s","topic0":"%s","fromBlock":%d,"toBlock":%d}', chain.cast("long"), F.lower(address), topic, first.cast("long"), last.cast("long"))
    return F.sha2(text, 256)


def run_id(data_hash: Column, commit: Column, version: Column) -> Column:
    """First 12 digits of the sha256 of the three parts."""
    return F.substring(F.sha2(F.concat(data_hash, commit, version), 256), 1, 12)


def seed_of(text: Column, suffix: str = "") -> Column:
    """First four bytes, big-endian, of the sha256 of a text."""
    return F.conv(F.substring(F.sha2(F.concat(text, F.lit(suffix)), 256), 1, 8), 16, 10).cast("long")


def block_range(stem: Column) -> Column:
    """Struct (first, last) of a file stem like 12_34; zeros where it is none."""
    parts = F.split(stem, "_")
    ok = stem.rlike("^[0-9]+_[0-9]+$")
    zero = F.lit(0).cast("long")
    return F.struct(F.when(ok, parts[0].try_cast("long")).otherwise(zero).alias("first"), F.when(ok, parts[1].try_cast("long")).otherwise(zero).alias("last"))


def payment_header(header: Column, network: str) -> Column:
    """Struct (ok, payer, reason) of a base64 JSON payment header: scheme, network, addresses are checked."""
    raw = F.try_to_binary(header, F.lit("base64"))
    text = F.decode(raw, "utf-8")
    get = lambda path: F.get_json_object(text, path)
    payer = get("$.payload.authorization.from")
    reason = (
        F.when(text.isNull() | get("$").isNull(), "malformed")
        .when(F.coalesce(get("$.scheme") != "exact", F.lit(True)), "scheme")
        .when(F.coalesce(get("$.network") != network, F.lit(True)), "network")
        .when(~F.coalesce(payer.rlike(ADDRESS), F.lit(False)), "payer")
        .when(~F.coalesce(get("$.payload.signature").rlike("^0x[0-9a-fA-F]+$"), F.lit(False)), "signature")
    )
    return F.struct(reason.isNull().alias("ok"), F.when(reason.isNull(), F.lower(payer)).alias("payer"), reason.alias("reason"))


def floor_div(a: Column, b: Column) -> Column:
    """Exact floor division of non-negative decimals; null where it would overflow or b is zero."""
    a, b = a.cast(NUMERIC), F.nullif(b.cast(NUMERIC), F.lit(0).cast(NUMERIC))
    return F.try_divide(a - a % b, b).cast(NUMERIC)


def swap_fee(amount: Column, tier: int) -> Column:
    """Fee on a positive amount, tier in millionths: amount * tier // (10^6 - tier); zero for others."""
    amount = amount.cast(NUMERIC)
    return F.when(amount > 0, floor_div(F.try_multiply(amount, F.lit(tier).cast(NUMERIC)), F.lit(1_000_000 - tier))).otherwise(F.lit(0).cast(NUMERIC))


def vault_share(fee: Column, own: Column, total: Column, in_range: Column) -> Column:
    """Part of a fee by liquidity: fee * own // total in range and with liquidity, else zero."""
    live = F.coalesce(in_range & (total.cast(NUMERIC) > 0), F.lit(False))
    return F.when(live, floor_div(F.try_multiply(fee, own.cast(NUMERIC)), total)).otherwise(F.lit(0).cast(NUMERIC))


#: The log-log slopes above which a method is named, and the name below all of them.
DECAY_METHODS = ((-0.5, "none"), (-1.5, "PROJ"))
LAST_METHOD = "COS"


def decay_method(slope: Column) -> Column:
    """Which inversion method suits a characteristic function of this log-log slope."""
    out = F.lit(LAST_METHOD)
    for above, name in reversed(DECAY_METHODS):
        out = F.when(slope > above, name).otherwise(out)
    return out


def cost_verdict(lower: Column, ceiling: Column) -> Column:
    return F.when(lower > ceiling, "PASS").otherwise("FAIL")


def branching_ratio(a00: Column, a01: Column, a10: Column, a11: Column, beta: Column) -> Column:
    """Spectral radius of a 2x2 excitation matrix over its decay, in closed form (entries are not negative)."""
    tr = (a00 + a11) / beta
    det = (a00 * a11 - a01 * a10) / (beta * beta)
    return (tr + F.sqrt(F.greatest(tr * tr - 4 * det, F.lit(0.0)))) / 2


def stationarity_penalty(rho: Column) -> Column:
    return F.when(rho >= 1, 1e18 * (1 + (rho - 1))).otherwise(0.0)


def firing(cost: Column, p_value: Column, any_passed: Column, strip_degenerate: Column, alpha: float = 0.05) -> Column:
    """The first of the null verdicts that holds, null if none does."""
    not_nan = p_value.isNotNull() & ~F.isnan(p_value)
    return (
        F.when(F.upper(cost) == "FAIL", "null_cost")
        .when(not_nan & (p_value >= alpha), "null_lr")
        .when(~F.coalesce(any_passed, F.lit(False)), "null_convex")
        .when(F.coalesce(strip_degenerate, F.lit(False)), "null_strip_unavailable")
    )
