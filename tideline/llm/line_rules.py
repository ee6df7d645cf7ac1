"""Quality rules by the frequency of lines across documents, in DataFrame functions alone.

Lines are normalised and hashed; for each host the distinct documents that hold a line are counted.
Lines in more documents than the limits allow are removed, and documents that are left with too
little are rejected. Copies of one text count as one document, so a clean text does not turn into
boilerplate by being copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import SPACE, WORD, clean_text, fresh, numbered

#: A line is removed if more distinct documents of its host hold it than this number and this share.
MAX_DOCS = 50
MAX_SHARE = 0.02
#: A document is rejected if less than this share of its words is left.
KEEP_SHARE = 0.3
WINDOW = 8
_SALTS = 32


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")


def normal(line: Column) -> Column:
    """A line in lower case, trimmed, white space as single spaces, digits as 0."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), SPACE + "+", " "), "[0-9]+", "0"))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text.

    n_repeat_words counts the words inside windows of eight words that occur twice or more in the text.
    Windows are hashed, hashes sorted with their positions, and the positions of repeated hashes swept
    once: no step grows faster than a sort. Texts without a repeated hash skip the sweep.
    """
    text = clean_text()
    d = docs.withColumns({"_w": words(text), "_lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")})
    n = F.size("_w")
    d = d.withColumns({"n_words": n.cast("long"), "word_chars": F.length(F.array_join("_w", "")).cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_wh", F.transform("_w", lambda w: F.xxhash64(w)))
    d = d.withColumn("_h", F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("_wh"), i + k) for k in range(WINDOW)])))
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.withColumn("_ranked", F.when(some, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    d = d.withColumn("_at", F.sort_array(F.transform(F.filter("_ranked", lambda x, j: (F.get(F.col("_ranked"), j - 1)["h"] == x["h"]) | (F.get(F.col("_ranked"), j + 1)["h"] == x["h"])), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_at", lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), j + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_w", "_lines", "_wh", "_h", "_ranked", "_at")


def content(text: str = "text") -> list[Column]:
    """Two independent 64-bit hashes of a text: its name, in _text and _more, wherever it stands."""
    return [F.xxhash64(text).alias("_text"), F.xxhash64(F.lit(1), F.col(text)).alias("_more")]


def host_of() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def line_rows(docs: DataFrame) -> DataFrame:
    """_host, _text and _more (the text's name), _pos, _line (hash of the normalised line), _n (its words)."""
    d = docs.select(host_of().alias("_host"), *content(), F.posexplode(F.split(clean_text(), "\n", -1)).alias("_pos", "_l"))
    return d.filter(F.col("_l").rlike(WORD)).select("_host", "_text", "_more", "_pos", F.xxhash64(normal(F.col("_l"))).alias("_line"), F.regexp_count("_l", F.lit(WORD)).alias("_n"))


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """_host, _line, n_docs of the lines above both limits."""
    per_line = lines.select("_host", "_line", "_text").distinct().groupBy("_host", "_line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > max_docs)
    per_host = lines.select("_host", "_text").distinct().groupBy("_host").agg(F.count("*").alias("host_docs"))
    return per_line.join(per_host, "_host").filter(F.col("n_docs") > max_share * F.col("host_docs")).select("_host", "_line", "n_docs")


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, keep_share: float = KEEP_SHARE) -> DataFrame:
    """doc_id, source, the base counts, words_removed and depleted of every row of docs.

    Null texts count as empty; a null host is a host of its own. Documents without words lose nothing
    and are not depleted. Repeated rows are judged alike, each on its own; an empty table stays empty.
    What a text loses is joined by host and content, so no row needs an id.
    """
    d = docs.select("doc_id", "text", "source")
    lines = line_rows(d)
    hot = frequent_lines(lines, max_docs, max_share).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    key = ["_host", "_text", "_more"]
    met = lines.withColumn("_salt", F.pmod(F.col("_text"), F.lit(_SALTS)).cast("int")).join(hot, ["_host", "_line", "_salt"])
    # copies of a text within a host share its lines' words: each place counts once
    removed = met.groupBy(*key, "_pos").agg(F.first("_n").alias("_n")).groupBy(*key).agg(F.sum("_n").cast("long").alias("words_removed"))
    counted = base_counts(d.withColumns({"_host": host_of()} | dict(zip(key[1:], content(), strict=True)))).drop("text")
    out = counted.join(removed, key, "left").drop(*key).withColumn("words_removed", F.coalesce("words_removed", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("words_removed")
    return out.withColumn("depleted", (F.col("n_words") > 0) & (left < keep_share * F.col("n_words")))


def clean(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """docs whose text has lost the lines above the limits; order and the other lines stay as they are.

    Hot lines are joined per line, salted, and texts are put together again from the lines that stay.
    """
    rid, own = fresh("_rid", docs.columns), fresh("_clean", docs.columns)
    whole = numbered(docs, rid)
    d = whole.select("text", "source", F.col(rid).alias("_rid"))
    hot = frequent_lines(line_rows(d), max_docs, max_share).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))).withColumn("_hot", F.lit(True))
    cut = d.select("_rid", host_of().alias("_host"), F.posexplode(F.split(clean_text(), "\n", -1)).alias("_pos", "_l")).withColumns({"_line": F.xxhash64(normal(F.col("_l"))), "_salt": F.pmod(F.col("_rid"), F.lit(_SALTS)).cast("int")})
    kept = cut.join(hot, ["_host", "_line", "_salt"], "left").filter("_hot IS NULL")
    text = kept.groupBy("_rid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_l"))), lambda x: x["_l"]), "\n").alias(own)).withColumnRenamed("_rid", rid)
    return whole.join(text, rid, "left").withColumn("text", F.when(F.col("text").isNotNull(), F.coalesce(own, F.lit("")))).select(*docs.columns)
