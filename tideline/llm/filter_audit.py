"""Filter interaction audit: what each of five filters removes, in every order of application.

Duplicates are found by partition refinement: rows are split by the length of their text, then by the
hashes of successive blocks, and a class of one row is dropped as soon as it stands alone. What survives
every block is compared as full text. The five verdicts of a row become a mask; masks are counted once
for each part, and all orders are answered from those counts.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import WORD, clean_text, discard, spill

FILTERS = "ABCDE"
MIN_WORDS = 50
#: Least distinct words and most capitals, in per cent of words and of code points.
MIN_DISTINCT, MAX_CAPITALS = 65, 5
SYMBOLS = "[#$%&*|]"
#: Bits of the broadcast map of surviving classes, 8 MB at most.
MAP_BITS = 1 << 26
#: Code points where the blocks of a text begin; the last block runs to the end.
BLOCKS = (0, 64, 1024, 16384)


def block_hashes(text: Column, bits: int = 64) -> list[Column]:
    """One hash for each block of a text; bits below 64 keep that many, so that tests can make them collide."""
    ends = [*(b - a for a, b in zip(BLOCKS, BLOCKS[1:])), 2**31 - 1]
    hashes = [F.xxhash64(F.substring(text, at + 1, n)) for at, n in zip(BLOCKS, ends, strict=True)]
    return hashes if bits >= 64 else [F.shiftrightunsigned(h, 64 - bits) for h in hashes]


def text_masks() -> Column:
    """The verdicts of the filters A to D as bits 0 to 3, from the columns _t (the text) and _w (its words)."""
    words = F.size("_w")
    fails = [
        words < MIN_WORDS,
        F.lit(100) * F.size(F.array_distinct("_w")) < F.lit(MIN_DISTINCT) * words,
        F.lit(100).cast("long") * F.regexp_count("_t", F.lit("[A-Z]")) > F.lit(MAX_CAPITALS) * F.length("_t"),
        F.col("_t").rlike(SYMBOLS),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def refine(rows: DataFrame) -> DataFrame:
    """The rows of `rows` (_id, _len, _hashes) that agree with another in length and every block hash, with their class in _key.

    Each round counts the classes so far, drops those of one row and splits the rest by the next block. The
    classes are written as one row each, so that a class that holds a third of all rows is only met by a join
    of two scans, which Spark can split.
    """
    left = rows.select("_id", "_len", "_hashes", F.xxhash64("_len").alias("_key"))
    for k in range(len(BLOCKS) + 1):
        many = spill(left.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1").select("_key"), f"audit-many-{k}")
        met = left.join(many, "_key", "left_semi")
        if k < len(BLOCKS):
            met = met.withColumn("_key", F.xxhash64("_key", "_len", F.get("_hashes", F.lit(k))))
        kept = spill(met, f"audit-class-{k}")
        discard(many, *[left] * bool(k))
        left = kept
    return left


def may_hold(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of docs whose _key falls on a bit that some class of `classes` sets: all members, few others.

    The map has MAP_BITS bits however many classes there are, so it can be broadcast, and texts that stand alone
    leave before any shuffle. Far more classes than bits make it let through more, never less.
    """
    at = F.pmod("_key", F.lit(MAP_BITS)) + 1
    maps = classes.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_map"))
    placed = docs.withColumn("_bucket", F.bitmap_bucket_number(at)).join(F.broadcast(maps), "_bucket")
    bit = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.substring("_map", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return placed.filter(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit.bitwiseAND(F.lit(7)))) != 0).select(*docs.columns)


def first_copies(docs: DataFrame, rows: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame | None]:
    """The least doc_id of each class of equal texts, by _key; and by _key and _t for classes whose texts differ.

    The second is None where no class holds two texts, which is so unless hashes collide. Texts of surviving
    classes meet by their whole content, after each task has merged its own copies.
    """
    classes = rows.select("_key").distinct()
    key = F.xxhash64(F.length("_t"))
    for h in block_hashes(F.col("_t"), bits):
        key = F.xxhash64(key, F.length("_t"), h)
    # an inner join, as Spark would push a semi join below the map's join and shuffle every text
    texts = may_hold(docs.withColumn("_key", key), classes).join(classes, "_key").groupBy("_key", "_t").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    kept = spill(texts, "audit-texts")
    per = kept.groupBy("_key").agg(F.count("*").alias("_texts"), F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
    one = spill(per.filter("_texts = 1 AND _n > 1").select("_key", "_first"), "audit-first")
    odd = per.filter("_texts > 1").select("_key")
    return one, None if odd.isEmpty() else kept.join(odd, "_key", "left_semi").select("_key", "_t", "_first")


def masks(docs: DataFrame, bits: int = 64) -> DataFrame:
    """_id, part and _mask for each row of docs: bit i is set where filter i of FILTERS fails.

    E fails for a row whose id is greater than the least id with its text. Null texts count as empty ones and
    are copies of them; a null id is no one's smaller id and has none; rows that repeat an id and a text are
    not copies by E. Other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), clean_text().alias("_t"))
    worded = base.withColumn("_w", F.regexp_extract_all("_t", F.lit(f"({WORD})"), F.lit(1)))
    rows = spill(worded.select("_id", "part", text_masks().alias("_abcd"), F.length("_t").alias("_len"), F.array(*block_hashes(F.col("_t"), bits)).alias("_hashes")), "audit-rows")
    key = F.xxhash64("_len")
    for k in range(len(BLOCKS)):
        key = F.xxhash64(key, "_len", F.get("_hashes", F.lit(k)))
    keyed = rows.select("_id", "part", "_abcd", key.alias("_key"))
    one, odd = first_copies(base.select("_id", "_t"), refine(rows), bits)
    late = F.when(F.col("_id") > F.col("_first"), 16).otherwise(0)
    plain = keyed if odd is None else keyed.join(odd.select("_key").distinct(), "_key", "left_anti")
    out = plain.join(one, "_key", "left").select("_id", "part", (F.col("_abcd") + late).alias("_mask"))
    if odd is None:
        return out
    again = worded.select("_id", "part", "_t", text_masks().alias("_abcd"))
    own = F.xxhash64(F.length("_t"))
    for h in block_hashes(F.col("_t"), bits):
        own = F.xxhash64(own, F.length("_t"), h)
    mixed = again.withColumn("_key", own).join(odd, ["_key", "_t"]).select("_id", "part", (F.col("_abcd") + late).alias("_mask"))
    return out.unionByName(mixed)


def _steps() -> list[tuple[int, int, str, int]]:
    """Each step of each order: the filters before it as bits, its filter, the order's name, the step's number."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append((before, f, "".join(FILTERS[i] for i in order), step))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame, bits: int = 64) -> DataFrame:
    """One row for each part, order of the filters and step; see the contract of op12 for the counts.

    docs needs doc_id, source and text; labels doc_id, quality and toxic. A document is good (or toxic) where
    any label row of its id says 1; without a label, or with a null one, it is neither. A null source is the
    part ''. An empty table has no parts and gives no rows.

    Masks are counted by part first. What a filter removes in an order depends on the set of filters before
    it alone, so 80 pairs of a set and a filter answer all 600 steps of the 120 orders.
    """
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    counted = masks(docs, bits).join(marks, "_id", "left").groupBy("part", "_mask").agg(F.count("*").alias("_n"), F.sum(F.coalesce("_good", F.lit(0))).alias("_good"), F.sum(F.coalesce("_toxic", F.lit(0))).alias("_toxic"))
    states = ",".join(f"named_struct('before', {before}, 'f', {f})" for before in range(32) for f in range(5) if not before >> f & 1)
    each = counted.withColumn("_s", F.explode(F.expr(f"array({states})"))).select("part", "_mask", "_n", "_good", "_toxic", "_s.before", "_s.f")
    bit = F.call_function("shiftleft", F.lit(1), F.col("f"))
    fails, past = F.col("_mask").bitwiseAND(bit) != 0, F.col("_mask").bitwiseAND(F.col("before")) == 0
    total = lambda when, n="_n": F.sum(F.when(when, F.col(n)).otherwise(0)).cast("long")
    each = each.groupBy("part", "before", "f").agg(
        total(past & ~fails).alias("kept"), total(past & fails).alias("removed"), total(~past & fails).alias("redundant"),
        total(F.col("_mask") == bit).alias("unique_fails"), total(past & fails, "_good").alias("good_lost"), total(past & fails, "_toxic").alias("toxic_lost"),
    )
    steps = F.broadcast(each.sparkSession.createDataFrame(_steps(), "before int, f int, filter_order string, step int"))  # 600 rows, always
    shapley = F.sum("removed").over(Window.partitionBy("part", "f"))
    return each.join(steps, ["before", "f"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))
