"""Language identification by a string kernel with Nystroem landmarks and kernel ridge regression.

The kernel of two texts is the number of character n-grams of 1 to LONGEST letters that both hold, each
counted once, over the geometric mean of how many each holds: the blended spectrum by presence. N-grams
are of lower-case letters and single spaces, with all else a space, hashed to GRAMS buckets. Landmarks
are texts of the sample; a text's features are its kernel with each, whitened by the landmarks' own
kernel matrix; one ridge regression a language answers, one against the rest. Rows are scored in blocks,
each by one product of its presence matrix with that of the landmarks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import discard, fold, fresh, spill  # noqa: F401

#: N-grams of 1 to so many characters.
LONGEST = 3
#: Buckets of hashed n-grams, a power of two.
GRAMS = 1 << 15
LANDMARKS = 192
#: The regression learns from at most so many documents of a language, and of all languages together.
PER_LANGUAGE, SAMPLE = 1500, 12_000
RIDGE = 1e-3
UNKNOWN = "und"
BLOCK_ROWS = 64


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter; and its lower case, where that is one letter, or 32 for all else."""
    low = np.full(sys.maxunicode + 1, 32, np.uint32)
    for i in range(sys.maxunicode + 1):
        if (c := chr(i)).isalpha():
            low[i] = ord(x) if len(x := c.lower()) == 1 else i
    return low != 32, low


def grams(text: str | None) -> np.ndarray | None:
    """The buckets of a text's n-grams, with repeats; None where it has no letter."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.concatenate([np.array([32], np.uint32), _letters()[1][raw], np.array([32], np.uint32)])
    kept = low[np.concatenate([[True], (low[1:] != 32) | (low[:-1] != 32)])]
    if len(kept) < 3:
        return None
    h, out = np.zeros(len(kept), np.uint32), []
    for n in range(LONGEST):
        h = (h[: len(kept) - n] * np.uint32(0x9E3779B1)) ^ (kept[n:] * np.uint32(0x85EBCA6B))
        out.append((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - GRAMS.bit_length() + 1))
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    columns: np.ndarray  # buckets that any landmark holds
    landmarks: np.ndarray  # columns x landmarks, presence as 0 and 1
    roots: np.ndarray  # of the landmarks' sizes
    weights: np.ndarray  # landmarks x languages, the whitening folded in
    bias: np.ndarray


def presence(texts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(texts), GRAMS), np.uint8)
    for row, ids in zip(out, texts, strict=True):
        row[ids] = 1
    return out


def kernel(present: np.ndarray, columns: np.ndarray, landmarks: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """The kernel of each row of a presence matrix with each landmark.

    The product counts, so it is exact in any order of summation and a row's kernel is the same in every block.
    """
    sizes = present.sum(axis=1, dtype=np.int64)
    return (present[:, columns].astype(np.float32) @ landmarks).astype(np.float64) / (np.sqrt(np.maximum(sizes, 1))[:, None] * roots)


def blocks(texts, n: int = BLOCK_ROWS) -> Iterator[tuple[list[int], np.ndarray]]:
    """Presence matrices of at most n texts with the places of those texts; texts without a letter are left out."""
    at, held = [], []
    for i, text in enumerate(texts):
        if (ids := grams(text)) is not None:
            at.append(i)
            held.append(ids)
        if len(held) == n:
            yield at, presence(held)
            at, held = [], []
    if held:
        yield at, presence(held)


def _rank() -> Column:
    return F.xxhash64(F.lit(11), F.col("_id"))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = SAMPLE) -> DataFrame:
    """_id, _lang, _present (packed bits) of at most per_language documents of each language and `most` in all.

    Documents are taken by a hash of their id; an id counts once a language. Of more languages than `most`
    can hold, the most frequent are learned. Rows without id, language or any letter teach nothing.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("lang").cast("string").alias("_lang"), "text").dropna(subset=["_id", "_lang"])
    ids = known.select("_id", "_lang").distinct()
    sizes = ids.groupBy("_lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_lang").limit(most).collect()  # at most `most`
    if not sizes:
        return known.select("_id", "_lang", F.lit(b"").alias("_present")).limit(0)
    each = max(1, min(per_language, most // len(sizes)))
    # a language's share of the hashes that is sure to hold about twice as many as are wanted
    cut = docs.sparkSession.createDataFrame([(r["_lang"], min(1.0, 2.0 * each / r["_n"] + 64 / r["_n"])) for r in sizes], "_lang string, _share double")
    near = ids.join(F.broadcast(cut), "_lang").filter(F.pmod(_rank(), F.lit(1 << 30)) < F.col("_share") * float(1 << 30))
    ranked = near.groupBy("_lang").agg(F.slice(F.sort_array(F.collect_list(F.struct(_rank().alias("_r"), F.col("_id")))), 1, each).alias("_x"))
    chosen = ranked.select("_lang", F.explode("_x._id").alias("_id"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed: list[bytes | None] = [None] * len(b)
            for at, x in blocks(t.as_py() for t in b.column("text")):
                for i, bits in zip(at, np.packbits(x, axis=1), strict=True):
                    packed[i] = bits.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_lang"), pa.array(packed, pa.binary())], names=["_id", "_lang", "_present"])

    rows = known.join(F.broadcast(chosen), ["_id", "_lang"])  # at most `most` ids
    # where an id repeats with other texts, the least packed bits stand for it
    return rows.mapInArrow(encode, "_id long, _lang string, _present binary").filter("_present IS NOT NULL").groupBy("_id", "_lang").agg(F.min("_present").alias("_present"))


def fit(docs: DataFrame, landmarks: int = LANDMARKS, per_language: int = PER_LANGUAGE, most: int = SAMPLE, ridge: float = RIDGE) -> Model:
    """Landmarks and weights from the documents of docs that have a language: doc_id, lang, text.

    Landmarks are dealt to the languages in turn, by the hash of the id. Without any document to learn from the
    model knows no language and answers `und`.
    """
    spark = docs.sparkSession
    seen = spill(sample(docs, per_language, most), "kernel-sample")
    order = [r for r in seen.select("_id", "_lang").collect()]
    languages = sorted({r["_lang"] for r in order})
    if not languages:
        discard(seen)
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    by: dict[str, list[int]] = {x: [] for x in languages}
    for r in sorted(order, key=lambda r: (r["_id"] * 0x9E3779B97F4A7C15 % (1 << 64), r["_id"])):
        by[r["_lang"]].append(r["_id"])
    want = [(ids[k], x) for k in range(max(map(len, by.values()))) for x, ids in by.items() if k < len(ids)][:landmarks]
    picked = seen.join(F.broadcast(spark.createDataFrame(want, "_id long, _lang string")), ["_id", "_lang"]).collect()
    unpack = lambda rows: np.unpackbits(np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1), axis=1)
    marks = unpack([r["_present"] for r in sorted(picked, key=lambda r: (r["_lang"], r["_id"]))])
    columns = np.flatnonzero(marks.any(axis=0))
    table, roots = np.ascontiguousarray(marks[:, columns].T.astype(np.float32)), np.sqrt(marks.sum(axis=1, dtype=np.int64))
    sent = spark.sparkContext.broadcast((columns, table, roots))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            got = [kernel(unpack(rows), *known) for k in range(0, len(b), BLOCK_ROWS) if (rows := [x.as_py() for x in b.column("_present")[k : k + BLOCK_ROWS]])]
            out = pa.array([x.tobytes() for y in got for x in y], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_lang"), out], names=["_id", "_lang", "x"])

    rows = seen.mapInArrow(features, "_id long, _lang string, x binary").collect()  # at most `most` rows of `landmarks` numbers
    discard(seen)
    rows.sort(key=lambda r: (r["_lang"], r["_id"]))
    k = np.array([np.frombuffer(r["x"]) for r in rows])
    lang = np.searchsorted(languages, [r["_lang"] for r in rows])
    return solve(languages, columns, table, roots, k, lang, ridge)


def solve(languages: list[str], columns: np.ndarray, table: np.ndarray, roots: np.ndarray, k: np.ndarray, lang: np.ndarray, ridge: float = RIDGE) -> Model:
    """One ridge regression a language on the whitened kernels, every language weighing alike."""
    values, vectors = np.linalg.eigh((table.T @ table).astype(np.float64) / np.outer(roots, roots))
    good = values > 1e-6 * max(values.max(), 1e-12)
    white = vectors[:, good] / np.sqrt(values[good])
    x = np.column_stack([k @ white, np.ones(len(k))])
    w = 1.0 / np.bincount(lang, minlength=len(languages))[lang] / len(languages)
    y = np.where(np.arange(len(languages)) == lang[:, None], 1.0, -1.0)
    a = (x * w[:, None]).T @ x + ridge * np.diag([*np.ones(x.shape[1] - 1), 0.0]) + 1e-9 * np.eye(x.shape[1])
    beta = np.linalg.solve(a, (x * w[:, None]).T @ y)
    return Model(languages, columns, table, roots, white @ beta[:-1], beta[-1])


def predict(docs: DataFrame, model: Model, columns: tuple[str, str] = ("lang_pred", "score"), rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with the language of each whole text and a score from 0 to 1.

    The score is the winner's share in the exponentials of the regressions' answers. Texts that are null or
    hold no letter are `und` with score 0. Each row is judged by its text alone; ties go to the language that
    sorts first; an empty table stays empty. Columns of the two names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(columns[0], T.StringType()), T.StructField(columns[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            names, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
            for at, x in blocks((t.as_py() for t in batch.column("text")), rows) if m.languages else ():
                z = np.einsum("ij,jk->ik", kernel(x, m.columns, m.landmarks, m.roots), m.weights) + m.bias  # row by row, alike in every block
                e = np.exp(4 * (z - z.max(axis=1, keepdims=True)))
                for i, best, share in zip(at, z.argmax(axis=1), 1 / e.sum(axis=1), strict=True):
                    names[i], scores[i] = m.languages[best], share
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *columns])

    return docs.mapInArrow(run, schema)
