"""Mixing sources to target weights by iterative proportional fitting.

Token totals of (source, language, topic) cells are raked until their marginals meet the targets.
A cell's weight is its raked share over its share of the corpus; documents are then kept with a
probability in proportion to the weight of their cell, by a hash of the row, not by chance.

A topic is a cluster of documents by their words: each document is a vector of its words' hashed counts,
less the mean of its language, and the clusters are found by a few rounds of spherical k-means over all
documents. Vectors hold small integers, so sums are the same in any order and topics the same anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from tideline.llm.common import fresh, n_words, spill, uniform

MARGINS = ("source", "lang", "topic")
#: Default targets are the corpus's own shares to this power: below 1, rare sources gain.
POWER = 0.95
ROUNDS = 60
TOLERANCE = 1e-9
#: Up to so many cells are raked on the driver and broadcast; beyond, as tables.
MAX_CELLS = 100_000


#: Topics, the numbers of a vector, rounds of clustering, and the slots that languages are hashed into.
TOPICS = 8
DIMENSIONS = 64
CLUSTER_ROUNDS = 4
LANGUAGES = 1024
NO_TOPIC = "none"


class _Slots(dict):
    """Slot of a word; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word) % DIMENSIONS
        return out


_SLOTS = _Slots()


def vector_of(text: str | None) -> bytes:
    """Square roots of the counts of a text's hashed words, scaled to length 127, as small integers; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return b""
    x = np.sqrt(np.bincount(np.fromiter(map(_SLOTS.__getitem__, words), np.int64, len(words)), minlength=DIMENSIONS))
    return np.rint(x * (127 / np.sqrt(x @ x))).astype(np.int8).tobytes()


@F.pandas_udf(BinaryType())
def _vector_udf(text: pd.Series) -> pd.Series:
    return text.map(vector_of, na_action=None)


def nearest_topic(vectors: list[bytes], codes: np.ndarray, means: dict[int, np.ndarray], centres: np.ndarray) -> np.ndarray:
    """The topic of each vector, less its language's mean; the smaller number on ties; -1 for the empty vector."""
    full = np.array([len(v) > 0 for v in vectors], bool)
    out = np.full(len(vectors), -1)
    if full.any():
        x = np.frombuffer(b"".join(vectors), np.int8).reshape(-1, DIMENSIONS).astype(np.float64)
        x -= np.stack([means[c] for c in codes[full].tolist()])
        out[full] = (x @ centres.T).argmax(axis=1)
    return out


def cluster(rows: DataFrame, vector: str, code: str, rounds: int = CLUSTER_ROUNDS, seed: int = 3) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The mean vector of each language's slot, and the topics' centres, from all rows.

    Each round sends one row of sums for each task, slot and topic; at most LANGUAGES x TOPICS of them come
    to the driver.
    """
    centres = np.random.default_rng(seed).normal(size=(TOPICS, DIMENSIONS))
    centres /= np.sqrt((centres * centres).sum(axis=1, keepdims=True))
    means: dict[int, np.ndarray] = {}

    def sums(known: dict[int, np.ndarray], centres: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for pdf in batches:
                vectors, codes = pdf["v"].tolist(), pdf["c"].to_numpy()
                topic = nearest_topic(vectors, codes, known, centres) if known else np.array([0 if len(v) else -1 for v in vectors])
                for c, k, v in zip(codes.tolist(), topic.tolist(), vectors, strict=True):
                    if k >= 0:
                        one = held.setdefault((c, k), np.zeros(DIMENSIONS + 1, np.int64))
                        one[:-1] += np.frombuffer(v, np.int8)
                        one[-1] += 1
            if held:
                yield pd.DataFrame([(c, k, x.tolist()) for (c, k), x in held.items()], columns=["c", "k", "s"])

        return run

    def total(known: dict[int, np.ndarray], centres: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        parts = rows.select(F.col(vector).alias("v"), F.col(code).alias("c")).mapInPandas(sums(known, centres), "c int, k int, s array<long>")
        each = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(DIMENSIONS + 1)]
        return {(r["c"], r["k"]): np.array(r[2:], np.float64) for r in sorted(parts.groupBy("c", "k").agg(*each).collect())}

    for (c, _), s in total({}, centres).items():
        means[c] = s[:-1] / s[-1]
    for _ in range(rounds if means else 0):
        new = np.zeros_like(centres)
        for (c, k), s in total(means, centres).items():
            new[k] += s[:-1] - s[-1] * means[c]
        size = np.sqrt((new * new).sum(axis=1, keepdims=True))
        centres = np.where(size > 1e-9, new / np.maximum(size, 1e-9), centres)
    return means, centres


def topics(rows: DataFrame, vector: str, code: str) -> Column:
    """The topic of each row of a written table, as a Column over its vector and its language's slot."""
    sent = rows.sparkSession.sparkContext.broadcast(cluster(rows, vector, code))

    @F.pandas_udf(StringType())
    def name(v: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([NO_TOPIC if k < 0 else f"topic{k}" for k in nearest_topic(v.tolist(), c.to_numpy(), *sent.value)])

    return name(F.col(vector), F.col(code))


def targets_of(shares: Mapping[str, float], power: float = POWER) -> dict[str, float]:
    """Shares to a power, scaled to one."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(cells: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Raked cell masses. codes[m][i] is cell i's category in margin m; targets[m] are its shares.

    Categories without mass keep none; the targets of a margin are scaled to those that have some. A margin
    whose targets name no category with mass is left as it is.
    """
    w = cells.astype(float) / cells.sum()
    for _ in range(rounds):
        worst = 0.0
        for code, want in zip(codes, targets, strict=True):
            have = np.bincount(code, weights=w, minlength=len(want))
            live = np.where(have > 0, want, 0.0)
            if live.sum() <= 0:
                continue
            live = live / live.sum()
            factor = np.divide(live, have, out=np.zeros_like(have), where=have > 0)
            worst = max(worst, float(np.abs(live - have).max()))
            w = w * factor[code]
        if worst < tolerance:
            break
    return w / w.sum()


def rake_table(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, rounds: int = ROUNDS, power: float = POWER, tolerance: float = TOLERANCE) -> DataFrame:
    """The same as rake(), with the cells in a table: for more cells than the driver should hold."""
    margins = [c for c in cells.columns if c in MARGINS]
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0])
    w = cells.withColumn("w", F.col("tokens") / F.lit(total))
    want = {}
    for m in margins:
        if targets and m in targets:
            want[m] = spark.createDataFrame([(str(k), float(v)) for k, v in targets[m].items()], f"{m} string, t double")
        else:
            want[m] = spill(cells.groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("t")), f"target-{m}")
    for _ in range(rounds):
        worst = 0.0
        for m in margins:
            have = spill(w.groupBy(m).agg(F.sum("w").alias("have")).join(want[m], m, "left").select(m, "have", F.when(F.col("have") > 0, F.coalesce("t", F.lit(0.0))).otherwise(0.0).alias("live")), "margin")
            live = have.agg(F.sum("live")).first()[0] or 0.0
            if live <= 0:
                continue
            share = F.col("live") / F.lit(live)
            worst = max(worst, have.agg(F.max(F.abs(share - F.col("have")))).first()[0])
            factor = have.select(m, F.when(F.col("have") > 0, share / F.col("have")).otherwise(0.0).alias("f"))
            w = w.join(factor, m).withColumn("w", F.col("w") * F.col("f")).drop("f")
        w = spill(w, "rake")
        if worst < tolerance:
            break
    return w.withColumn("w", F.col("w") / F.lit(w.agg(F.sum("w")).first()[0]))


def names(docs: DataFrame) -> dict[str, str]:
    """The names of the columns that labelled() and weighted() add: free ones, whatever docs has."""
    return {n: fresh(f"_{n}", docs.columns) for n in (*MARGINS, "tokens", "weight", "probability", "sampled")}


def labelled(docs: DataFrame, topic_of: Column | None = None) -> DataFrame:
    """docs, written, with the source, language, topic and tokens of names(); nulls are a category of their own.

    topic_of, a Column over docs, replaces the clusters.
    """
    own, p = F.lit("(null)"), names(docs)
    lang = F.coalesce(F.col("lang").cast("string"), own)
    found = {p["source"]: F.coalesce(F.col("source").cast("string"), own), p["lang"]: lang, p["tokens"]: n_words()}
    if topic_of is not None:
        return spill(docs.withColumns({**found, p["topic"]: F.coalesce(topic_of, own)}), "labelled")
    vector, code = fresh("_vector", docs.columns), fresh("_code", docs.columns)
    rows = spill(docs.withColumns({**found, vector: _vector_udf("text"), code: F.pmod(F.xxhash64(lang), F.lit(LANGUAGES)).cast("int")}), "labelled")
    return rows.withColumn(p["topic"], topics(rows, vector, code)).drop(vector, code)


def cell_weights(rows: DataFrame, p: Mapping[str, str], targets: Mapping[str, Mapping[str, float]] | None = None, power: float = POWER, max_cells: int = MAX_CELLS) -> tuple[DataFrame, bool]:
    """Each cell's weight and sampling probability, and whether their number is bounded by max_cells."""
    spark = rows.sparkSession
    cells = spill(rows.groupBy(*[F.col(p[m]).alias(m) for m in MARGINS]).agg(F.sum(p["tokens"]).alias("tokens")).filter("tokens > 0"), "cells")
    n = cells.count()
    if n == 0:
        return spark.createDataFrame([], "source string, lang string, topic string, weight double, probability double"), True
    if n <= max_cells:
        pdf = cells.toPandas().sort_values(list(MARGINS)).reset_index(drop=True)
        codes, want = [], []
        total = pdf["tokens"].sum()
        for m in MARGINS:
            code, names = pdf[m].factorize()
            shares = pdf.groupby(m)["tokens"].sum() / total
            goal = (targets or {}).get(m) or targets_of(shares.to_dict(), power)
            codes.append(code)
            want.append(np.array([float(goal.get(k, 0.0)) for k in names]))
        raked = rake(pdf["tokens"].to_numpy(), codes, want)
        pdf["weight"] = raked / (pdf["tokens"].to_numpy() / total)
        pdf["probability"] = pdf["weight"] / pdf["weight"].max()
        out = spark.createDataFrame(pdf[[*MARGINS, "weight", "probability"]], "source string, lang string, topic string, weight double, probability double")
        return out, True
    raked = spill(rake_table(cells, targets, power=power), "raked")
    sums = raked.agg(F.sum("tokens").alias("n"))
    out = spill(raked.crossJoin(F.broadcast(sums)).withColumn("weight", F.col("w") / (F.col("tokens") / F.col("n"))), "weights")
    top = out.agg(F.max("weight").alias("top"))
    return out.crossJoin(F.broadcast(top)).select(*MARGINS, "weight", (F.col("weight") / F.col("top")).alias("probability")), False


def weighted(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, power: float = POWER, seed: int = 20, max_cells: int = MAX_CELLS, topic_of: Column | None = None) -> DataFrame:
    """docs with the columns of names(): source, language, topic, tokens, weight, probability and sampled.

    Null sources and languages are the category (null). Documents without tokens have no weight: they
    get weight 0, probability 0 and are not sampled. Repeated rows share one fate, since the draw is a
    hash of id and text. An empty table stays empty. Columns of docs stay as they are.
    """
    p = names(docs)
    rows = labelled(docs, topic_of)
    cells, small = cell_weights(rows, p, targets, power, max_cells)
    cells = cells.select(*[F.col(m).alias(p[m]) for m in MARGINS], F.col("weight").alias(p["weight"]), F.col("probability").alias(p["probability"]))
    keys = [p[m] for m in MARGINS]
    if small:
        out = rows.join(F.broadcast(cells), keys, "left")
    else:  # a hot cell is spread over salts
        salts, salt = 32, fresh("_salt", rows.columns)
        rows = rows.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text"), F.lit(salts)).cast("int"))
        spread = cells.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out = rows.join(spread, [*keys, salt], "left").drop(salt)
    zero = F.lit(0.0)
    out = out.withColumns({p["weight"]: F.coalesce(p["weight"], zero), p["probability"]: F.when(F.col(p["tokens"]) > 0, F.coalesce(p["probability"], zero)).otherwise(zero)})
    return out.withColumn(p["sampled"], uniform(seed, F.col("doc_id"), F.col("text")) < F.col(p["probability"]))
