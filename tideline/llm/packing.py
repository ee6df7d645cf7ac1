"""Best-fit packing with several permitted sequence lengths.

Documents become pieces of at most the largest capacity. Each shard of pieces is packed by
best-fit decreasing: a piece goes to the open bin it fills best; where none has room, the bin size
of least cost is opened, the room left over being credited at a price. Several prices are tried, so
that the permitted lengths are chosen jointly, and each bin is at last cut down to the smallest
permitted length that holds its contents. The cheapest outcome of a shard is kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import n_words, numbered

CAPACITIES = (512, 1024, 2048, 4096, 8192)
PRICES = (0.0, 0.5, 0.8, 0.95, 1.05)
SHARD_ROWS = 8192
OUT = "doc_id string, piece int, start long, n_tokens long, bin_id long, capacity int, bin_offset int"


def bin_cost(capacity: int, overhead: float = 64.0, attention: float = 1 / 65536) -> float:
    """Cost of a bin: a fixed part, its slots, and attention, which grows with the square of its length."""
    return overhead + capacity + attention * capacity * capacity


def downsize(used: int, capacities: Sequence[int]) -> int:
    return next(c for c in sorted(capacities) if c >= used)


def pack(lengths: Sequence[int], capacities: Sequence[int], price: float) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length, and the bins' final capacities. Lengths come in any order.

    Ties go to the earlier piece and the earlier opened bin; zero lengths are not accepted.
    """
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    place, offset = [0] * len(lengths), [0] * len(lengths)
    used: list[int] = []
    room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # open bins by the room they have
    some = 0  # bit r is set where a bin has room r
    opens: dict[int, int] = {}
    limit: list[int] = []
    for i in order:
        n = lengths[i]
        if fit := some >> n:
            r = (fit & -fit).bit_length() - 1 + n
            b = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            if n not in opens:
                opens[n] = min((c for c in sizes if c >= n), key=lambda c: bin_cost(c) - price * (bin_cost(c) / c) * (c - n))
            r, b = opens[n], len(used)
            used.append(0)
            limit.append(r)
        place[i], offset[i] = b, used[b]
        used[b] += n
        r -= n
        if r:
            room[r].append(b)
            some |= 1 << r
    return place, offset, [downsize(u, sizes) for u in used]


def pack_best(lengths: Sequence[int], capacities: Sequence[int], prices: Sequence[float] = PRICES):
    """The cheapest of the packings under each price; the first on ties."""
    return min((pack(lengths, capacities, p) for p in prices), key=lambda x: sum(map(bin_cost, x[2])))


def lengths_of(docs: DataFrame) -> DataFrame:
    """_rid, doc_id as text, n (tokens) of every row of docs: a small written table, the only pass over the texts."""
    return numbered(docs.select(F.col("doc_id").cast("string").alias("doc_id"), n_words().alias("n")), "_rid", "lengths")


def pieces(n: DataFrame, longest: int) -> DataFrame:
    """doc_id, piece, start, n_tokens, _rid: consecutive pieces of at most `longest` tokens of each row of lengths_of().

    A document without tokens keeps one piece of no tokens.
    """
    cut = n.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / longest).cast("int") - 1))))
    start = F.col("piece").cast("long") * longest
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(longest).cast("long"), F.col("n") - start).alias("n_tokens"), "_rid")


def best_fit(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a piece: doc_id, piece, start, n_tokens, bin_id, capacity, bin_offset.

    Every document keeps every token: texts longer than the largest capacity are cut into pieces.
    Null and empty texts have one piece of 0 tokens, bin_id and capacity null. Repeated rows and ids,
    null ids too, are packed each on its own. An empty table gives no rows; other columns are ignored.
    Shards are dealt by row, not by document or source, so no hot key gathers in one task; their
    number follows the input, and bin ids are unique across them.
    """
    capacities = tuple(sorted(capacities))
    lengths = lengths_of(docs)
    shards = max(1, math.ceil(lengths.count() / shard_rows))
    rows = pieces(lengths, capacities[-1]).withColumn("_shard", F.pmod(F.xxhash64("_rid", "piece"), F.lit(shards)).cast("long"))

    def pack_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "_rid", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        full = int((pdf["n_tokens"] > 0).sum())
        place, offset, sizes = pack_best(pdf["n_tokens"][:full].tolist(), capacities)
        rest = [None] * (len(pdf) - full)
        base = int(key[0]) << 32
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"], "piece": pdf["piece"], "start": pdf["start"], "n_tokens": pdf["n_tokens"],
                "bin_id": pd.array([base + b for b in place] + rest, dtype="Int64"),
                "capacity": pd.array([sizes[b] for b in place] + rest, dtype="Int32"),
                "bin_offset": pd.array(list(offset) + rest, dtype="Int32"),
            }
        )

    return rows.groupBy("_shard").applyInPandas(pack_shard, OUT).withColumn("doc_id", F.col("doc_id").cast("long"))
