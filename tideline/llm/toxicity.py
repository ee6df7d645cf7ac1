"""Toxicity by a convolutional text classifier trained in numpy.

Words are hashed to embeddings; filters of several widths run over the whole text; each filter's
maximum feeds a logistic unit. Max pooling sends gradients to one window a filter, so a training
step costs little more than a forward pass. Scores are calibrated so that THRESHOLD is the best
cut for each language, the language being guessed from function words of the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import fold  # noqa: F401

BUCKETS = 1 << 16
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
THRESHOLD = 0.7
#: The classifier learns from at most so many labelled documents of each label, 0 and 1.
SAMPLE_PER_LABEL = (12_000, 4000)
EPOCHS = 8
#: Share of words hidden in each step, so that no rare word alone decides.
HIDDEN_WORDS = 0.3
#: Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to is that with for this",
    "fr": "le les et des un une du pour est",
    "de": "der die und das ist nicht den zu ein",
    "es": "el los las y por para una es al",
}
LANGUAGES = ("other", *FUNCTION_WORDS)
_PAD = 2
_FOLDED = bytes(i + 32 if 65 <= i <= 90 else 32 if i < 48 or 57 < i < 97 or 122 < i < 128 else i for i in range(256))


class _Ids(dict):
    """Bucket of a word; bucket 0 is for padding. Emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = out = 1 + xxhash.xxh32_intdigest(word) % (BUCKETS - 1)
        return out


_IDS = _Ids()


def word_ids(text: str | None) -> np.ndarray:
    """Buckets of the words of a text: letters and digits in lower case, all else separates."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLDED).split()
    return np.fromiter(map(_IDS.__getitem__, words), np.int32, len(words))


@dataclass
class Model:
    embed: np.ndarray  # BUCKETS x DIM, row 0 is zero
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    cuts: np.ndarray  # raw logit of the best cut by language
    scale: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Each word's part in each filter, by the offset in the window."""
        return [[(self.embed @ w[k]).astype(np.float32) for k in range(len(w))] for w in self.filters]


def _language_table() -> np.ndarray:
    out = np.zeros(BUCKETS, np.int8)
    for k, name in enumerate(FUNCTION_WORDS, 1):
        for w in FUNCTION_WORDS[name].split():
            out[_IDS[w.encode()]] = k
    return out


def join_ids(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids with padding around each document, and where each document begins."""
    sizes = np.array([len(d) + 2 * _PAD for d in docs], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    flat = np.zeros(int(sizes.sum()) + max(WIDTHS), np.int32)
    for s, d in zip(starts, docs, strict=True):
        flat[s + _PAD : s + _PAD + len(d)] = d
    return flat, starts


def pooled(tables: list[list[np.ndarray]], flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Maximum of each filter over each document, before bias. Windows stay inside their document's padding."""
    n = len(flat) - max(WIDTHS)
    out = []
    for parts in tables:
        a = parts[0][flat[:n]]
        for k in range(1, len(parts)):
            a += parts[k][flat[k : n + k]]
        if len(parts) > 1:  # windows that reach the next document see padding there: _PAD >= width - 1
            a = a.copy()
        out.append(np.maximum.reduceat(a, starts, axis=0))
    return np.concatenate(out, axis=1)


def languages(table: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The language whose function words a document has most of; 0 where it has none."""
    lang = table[flat]
    doc = np.zeros(len(flat), np.int64)
    doc[starts[1:]] = 1
    count = np.bincount(np.cumsum(doc) * len(LANGUAGES) + lang, minlength=len(starts) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))[: len(starts)]
    count[:, 0] = 0
    return count.argmax(axis=1)


def train(docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 6, rate: float = 0.1, prior: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Adagrad on the logistic loss, both labels weighing alike; then the cuts from held-back documents.

    Embeddings start at zero: a word that no step has met has no say, however many of them a text holds.
    prior: what a document of each label stands for when the cuts are chosen, the sample being no mirror
    of the labels' shares.
    """
    rng = np.random.default_rng(seed)
    embed = np.zeros((BUCKETS, DIM), np.float32)
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    nf = len(WIDTHS) * FILTERS
    bias, out, out_bias = np.full(nf, 0.1, np.float32), rng.normal(0, 0.3, nf).astype(np.float32), 0.0
    ge, gf, gb, go, gc = np.full((BUCKETS, DIM), 1e-4, np.float32), [np.full_like(f, 1e-4) for f in filters], np.full(nf, 1e-4, np.float32), np.full(nf, 1e-4, np.float32), 1e-4
    held = np.arange(len(docs)) % 5 == 4
    rows = np.flatnonzero(~held)
    share = max(1e-3, float(labels[rows].mean())) if len(rows) else 0.5
    weight = np.where(labels == 1, 0.5 / share, 0.5 / max(1e-3, 1 - share)).astype(np.float32)
    for _ in range(epochs):
        rng.shuffle(rows)
        for at in range(0, len(rows), 32):
            batch = rows[at : at + 32]
            flat, starts = join_ids([docs[i] for i in batch])
            flat[rng.random(len(flat)) < HIDDEN_WORDS] = 0
            n, ends = len(flat) - max(WIDTHS), np.append(starts[1:], len(flat) - max(WIDTHS))
            emb = embed[flat]
            where, top = [], []
            for f in filters:
                a = emb[:n] @ f[0]
                for k in range(1, len(f)):
                    a += emb[k : n + k] @ f[k]
                best = np.stack([s + a[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])
                where.append(best)
                top.append(a[best, np.arange(FILTERS)])
            z = np.concatenate(top, axis=1) + bias
            h = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ out + out_bias, -30, 30)))
            d = ((p - labels[batch]) * weight[batch] / len(batch)).astype(np.float32)
            dz = np.outer(d, out) * (z > 0)
            g = h.T @ d + 1e-4 * out
            go += g * g
            out -= rate * g / np.sqrt(go)
            gc += float(d.sum()) ** 2
            out_bias -= rate * float(d.sum()) / gc**0.5
            g = dz.sum(axis=0)
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            touched, change = [], []
            for j, f in enumerate(filters):
                dzj = dz[:, j * FILTERS : (j + 1) * FILTERS]
                gw = np.zeros_like(f)
                for k in range(len(f)):
                    e = emb[where[j] + k]  # documents x filters x DIM
                    gw[k] = np.einsum("bf,bfd->df", dzj, e)
                    touched.append(flat[where[j] + k].ravel())
                    change.append((dzj[:, :, None] * f[k].T[None]).reshape(-1, DIM))
                gf[j] += gw * gw
                f -= rate * gw / np.sqrt(gf[j])
            ids, back = np.unique(np.concatenate(touched), return_inverse=True)
            g = np.zeros((len(ids), DIM), np.float32)
            np.add.at(g, back, np.concatenate(change))
            ge[ids] += g * g
            embed[ids] -= rate * g / np.sqrt(ge[ids])
            embed[0] = 0
    model = Model(embed, filters, bias, out, out_bias, np.zeros(len(LANGUAGES)), np.ones(len(LANGUAGES)))
    back = [docs[i] for i in np.flatnonzero(held)] or docs
    truth = labels[held] if held.any() else labels
    if len(back):
        raw, lang = logits(model, model.tables(), _language_table(), back)
        calibrate(model, raw, truth, lang, prior)
    return model


def logits(model: Model, tables, language_table: np.ndarray, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat, starts = join_ids(docs)
    h = np.maximum(pooled(tables, flat, starts) + model.bias, 0)
    return h @ model.out + model.out_bias, languages(language_table, flat, starts)


def calibrate(model: Model, raw: np.ndarray, truth: np.ndarray, lang: np.ndarray, prior: tuple[float, float] = (1.0, 1.0), least: int = 40) -> None:
    """For each language the cut with the best F1, in the middle of its gap; all languages' cut where few rows speak for one."""

    def cut(r: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-r, kind="stable")
        w = np.where(y == 1, prior[1], prior[0])
        f1 = 2 * np.cumsum((y * w)[order]) / (np.cumsum(w[order]) + max(1e-9, float((y * w).sum())))
        k = int(f1.argmax())
        below = r[order[k + 1]] if k + 1 < len(r) else r[order[k]] - 2
        return float((r[order[k]] + below) / 2)

    overall = cut(raw, truth) if truth.any() else float(raw.max()) + 1 if len(raw) else 0.0
    spread = max(0.25, float(raw.std()) if len(raw) else 1.0)
    for k in range(len(LANGUAGES)):
        own = lang == k
        model.cuts[k] = cut(raw[own], truth[own]) if own.sum() >= least and truth[own].sum() >= 8 else overall
        model.scale[k] = 1.0 / spread


def probability(model: Model, raw: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """A score in (0, 1) that rises with the logit and is THRESHOLD at the language's cut."""
    base = np.log(THRESHOLD / (1 - THRESHOLD))
    x = np.clip((raw - model.cuts[lang]) * model.scale[lang] * 2 + base, -30, 30)
    return 1 / (1 + np.exp(-x))


def fit(docs: DataFrame, labels: DataFrame, per_label: tuple[int, int] = SAMPLE_PER_LABEL, seed: int = 6) -> Model:
    """Train on at most per_label[y] documents of each label y, the first by a hash of the id.

    labels needs doc_id and toxic; rows with a null in either are left out, repeated labels of a document
    count once (the greater). Of rows that repeat an id with different texts the least by a hash of its words
    teaches. Documents are used whole. Without any labelled document the model gives
    every text the same low score.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ranked = None
    for y in (0, 1):
        some = known.filter(F.col("toxic") == y).orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(per_label[y])
        ranked = some if ranked is None else ranked.unionByName(some)
    pairs = ranked.collect()  # at most sum(per_label)
    if not pairs:
        return Model(np.zeros((BUCKETS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), np.zeros(len(WIDTHS) * FILTERS), 0.0, np.ones(len(LANGUAGES)), np.ones(len(LANGUAGES)))
    chosen = docs.sparkSession.createDataFrame(pairs, "doc_id long, toxic int")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b for b in batches if len(b)):
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "ids": [word_ids(t).astype(np.uint16).tobytes() for t in pdf["text"]]})

    encoded = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInPandas(encode, "doc_id long, toxic int, ids binary")
    # of rows that repeat an id with other texts one is taken, the same one anywhere
    rows = encoded.groupBy("doc_id", "toxic").agg(F.min_by("ids", F.struct(F.xxhash64("ids"), "ids")).alias("ids")).collect()
    rows.sort(key=lambda r: xxhash.xxh64_intdigest(str(r["doc_id"]), seed))
    every = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    prior = tuple(every.get(y, 0) / max(1, sum(r["toxic"] == y for r in pairs)) for y in (0, 1))
    return train([np.frombuffer(r["ids"], np.uint16).astype(np.int32) for r in rows], np.array([r["toxic"] for r in rows]), seed=seed, prior=prior)


def score(docs: DataFrame, model: Model, column: str = "score", words_at_once: int = 400_000) -> DataFrame:
    """docs with a score column: likelier toxic towards 1. Null and empty texts score as texts without words.

    Every row is scored on its whole text alone, so repeated rows score alike; an empty table stays empty.
    Other columns pass through as they are; one of the score's name is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        tables, table = m.tables(), _language_table()
        for batch in batches:
            scores, held, n = [], [], 0
            for text in batch.column("text"):
                held.append(word_ids(text.as_py()))
                n += len(held[-1]) + 4
                if n > words_at_once:
                    scores.append(probability(m, *logits(m, tables, table, held)))
                    held, n = [], 0
            if held:
                scores.append(probability(m, *logits(m, tables, table, held)))
            got = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)
