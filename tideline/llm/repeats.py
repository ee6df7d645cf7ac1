"""Long repeated byte strings by a run-length compressed Burrows-Wheeler transform.

Only strings that share their least k-gram can be equal. So each text is cut into contexts, the stretches
of windows with the same least k-gram hash: every window of LENGTH bytes lies in one context, and equal
windows lie in contexts of the same hash. Equal contexts count as one. Where a hash has several different
contexts, or one that holds its k-gram twice, they are indexed together: the transform of the contexts is
run-compressed, and at the ends of its runs the suffix and the length of its match with the one before
it are sampled. Inside a run a match only repeats, one byte shorter, what the sample to its left says;
so matching statistics are streamed from the samples, and those of LENGTH and more mark the repeated bytes.
Contexts go by the 64-bit hash of their least k-gram and one of their own bytes: contexts that agree in
both are taken for equal, which in a corpus-wide index would add no run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import discard, numbered, release, spill

LENGTH = 400
GRAM = 128
#: Bytes of contexts in one index; a hash with more of them goes by the windows' own hashes.
INDEX_BYTES = 2_000_000
_P = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(8).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k bytes, by doubling."""
    part, size, out, done, rest = _TABLE[b], 1, None, 0, k
    while True:
        if rest & 1:
            if out is None:
                out, done = part, size
            else:
                n = len(b) - done - size + 1
                out = part[:n] * np.uint64(pow(_P, done, 2**64)) + out[size : size + n]
                done += size
        rest >>= 1
        if not rest:
            break
        n = len(b) - 2 * size + 1
        part = part[:n] * np.uint64(pow(_P, size, 2**64)) + part[size : size + n]
        size *= 2
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def slide(x: np.ndarray, w: int, of=np.minimum) -> np.ndarray:
    """Minimum, or maximum, of each run of w values, by doubling."""
    size = 1
    while 2 * size <= w:
        x = of(x[:-size], x[size:])
        size *= 2
    return of(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def contexts(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int, bool]]:
    """start, size, hash, content hash, and whether the least k-gram occurs twice, of each context of a text."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) < length:
        return
    w = length - gram + 1
    h = gram_hashes(b, gram)
    low = slide(h, w)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    size = np.diff(np.append(first, len(low))) + length - 1
    value = low[first].view(np.int64)
    # anchors: k-grams that are the least of some window; two equal ones in a row share a context
    wide = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(slide(wide, w, np.maximum) == h)
    pair = np.flatnonzero((h[at[1:]] == h[at[:-1]]) & (np.diff(at) <= w))
    one = np.searchsorted(first, np.maximum(0, at[pair + 1] - w + 1), side="right") - 1
    two = np.searchsorted(first, np.minimum(len(low) - 1, at[pair]), side="right") - 1
    mark = np.zeros(len(first) + 1, np.int64)
    np.add.at(mark, np.minimum(one, two), 1)
    np.add.at(mark, np.maximum(one, two) + 1, -1)
    twice = np.cumsum(mark[:-1]) > 0
    # the windows that span both lie in one run, but neighbours are marked too: they are only looked at twice
    for s, n, v, t in zip(first.tolist(), size.tolist(), value.tolist(), twice.tolist(), strict=True):
        yield s, n, v, xxhash.xxh3_64_intdigest(raw[s : s + n]) - (1 << 63), t


# ---- the index ----------------------------------------------------------------------------------


def suffix_ranks(text: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffix array of a text of non-negative symbols, and the ranks by the first 1, 2, 4, ... symbols.

    Prefix doubling; suffixes whose rank is settled are not sorted again.
    """
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    ranks, k = {}, 1
    # ranks are places of the first of their group, so settled suffixes keep theirs
    starts = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
    sizes = np.diff(np.append(starts, n))
    rank[order] = np.repeat(starts, sizes)
    ranks[1] = rank.astype(np.int32)
    open_at = np.repeat(sizes > 1, sizes)
    while open_at.any():
        where = np.flatnonzero(open_at)
        sfx = order[where]
        ahead = sfx + k
        key = rank[sfx] * np.int64(n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        sfx, key = sfx[by], key[by]
        order[where] = sfx
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(key)))
        rank[sfx] = np.repeat(where[heads], sizes)
        open_at[where] = np.repeat(sizes > 1, sizes)
        k *= 2
        ranks[k] = rank.astype(np.int32)
    return order, ranks


class RunIndex:
    """The run-compressed transform of a set of strings, with samples at the ends of its runs.

    heads: the transform's symbol of each run; lengths: of each run; suffix, before: at each run's first
    row the suffix there and the one in the row above; match: the length of their common prefix.
    Each string ends in a symbol of its own, so matches do not cross strings.
    """

    def __init__(self, strings: list[bytes], least: int = 1):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        text = np.empty(int(self.starts[-1]), np.int64)
        body = np.ones(len(text), bool)
        body[self.starts[1:] - 1] = False
        text[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + len(strings)
        text[~body] = np.arange(len(strings))
        order, ranks = suffix_ranks(text)
        bwt = text[order - 1]
        change = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.heads, self.lengths = bwt[change], np.diff(np.append(change, len(bwt)))
        change = change[change > 0]
        self.suffix, self.before = order[change], order[change - 1]
        self.match = np.zeros(len(change), np.int64)
        # the common prefix, from the longest power of two down; ranks of equal beginnings are equal
        p, q, n = self.suffix.copy(), self.before.copy(), len(text)
        for k in sorted(ranks, reverse=True):
            same = (p < n) & (q < n)
            same[same] = ranks[k][p[same]] == ranks[k][q[same]]
            self.match += k * same
            p, q = p + k * same, q + k * same
        keep = self.match >= least
        self.suffix, self.before, self.match = self.suffix[keep], self.before[keep], self.match[keep]

    def statistics(self) -> np.ndarray:
        """At each place of the text the length of its longest match that starts anywhere else.

        Streamed from the samples: from one to the next a match loses a byte at each step, and a sample's
        match reaches at least as far as what the ones before it left. Matches below `least` count as none.
        """
        n = int(self.starts[-1])
        reach = np.zeros(n, np.int64)
        for at in (self.suffix, self.before):
            np.maximum.at(reach, at, at + self.match)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)

    def repeated(self, length: int = LENGTH) -> list[list[tuple[int, int]]]:
        """Of each string the runs of bytes that lie in strings of `length` which occur elsewhere too."""
        match = self.statistics()
        at = np.arange(len(match))
        inside = (np.maximum.accumulate(np.where(match >= length, at + match, 0)) > at).astype(np.int8)
        step = np.diff(np.concatenate([[0], inside, [0]]))
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(self.starts) - 1)]
        for a, z in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
            k = int(np.searchsorted(self.starts, a, side="right")) - 1
            out[k].append((a - int(self.starts[k]), z - int(self.starts[k])))
        return out


# ---- over a cluster -----------------------------------------------------------------------------


def context_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """h, c, _rid, at, size, twice of every context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rid, text in zip(pdf["_rid"].tolist(), pdf["text"], strict=True):
                if text:
                    rows += [(v, c, rid, s, n, t) for s, n, v, c, t in contexts(text.encode("utf-8", "surrogatepass"), length, gram)]
                if len(rows) > 200_000:
                    yield pd.DataFrame(rows, columns=["h", "c", "_rid", "at", "size", "twice"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["h", "c", "_rid", "at", "size", "twice"])

    return docs.select("_rid", "text").mapInPandas(run, "h long, c long, _rid long, at int, size int, twice boolean")


def context_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, c, bytes of the wanted (h, c, _rid, at, size), cut in the JVM."""
    cuts = wanted.groupBy("_rid").agg(F.collect_list(F.struct("h", "c", "at", "size")).alias("cuts"))
    met = docs.select("_rid", F.col("text").cast("binary").alias("raw")).join(cuts.hint("shuffle_hash"), "_rid")
    part = F.transform("cuts", lambda x: F.struct(x["h"].alias("h"), x["c"].alias("c"), F.substring(F.col("raw"), x["at"] + 1, x["size"]).alias("bytes")))
    return met.select(F.inline(part))


_SPANS = "h long, c long, spans array<struct<a:int,z:int>>"


def index_groups(rows: DataFrame, buckets: int, length: int) -> DataFrame:
    """h, c, spans: repeated runs inside each context, by an index of all contexts of a bucket of hashes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "c"], kind="stable").reset_index(drop=True)
        sizes = pdf["bytes"].str.len().to_numpy()
        cut, held, last = [0], 0, None
        for i, (h, n) in enumerate(zip(pdf["h"].tolist(), sizes.tolist(), strict=True)):
            if h != last and held > INDEX_BYTES:  # contexts of one hash stay together
                cut.append(i)
                held = 0
            held, last = held + n, h
        out = []
        for a, z in zip(cut, [*cut[1:], len(pdf)], strict=True):
            out += RunIndex(pdf["bytes"][a:z].tolist(), length).repeated(length)
        kept = [i for i, s in enumerate(out) if s]
        return pd.DataFrame({"h": pdf["h"].iloc[kept], "c": pdf["c"].iloc[kept], "spans": pd.Series([[{"a": a, "z": z} for a, z in out[i]] for i in kept], index=kept, dtype=object)})

    return rows.withColumn("_b", F.pmod(F.xxhash64("h"), F.lit(buckets))).groupBy("_b").applyInPandas(run, _SPANS)


def window_groups(rows: DataFrame, length: int) -> DataFrame:
    """The same for hashes with more contexts than one task should index: each window's own hash is counted."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for h, c, raw in zip(pdf["h"].tolist(), pdf["c"].tolist(), pdf["bytes"], strict=True):
                b = np.frombuffer(raw, np.uint8)
                x = gram_hashes(b, length)
                y = gram_hashes(b[::-1], length)[::-1]
                x, y = x.view(np.int64), y.astype(np.uint64).view(np.int64)
                for a in range(0, len(x), 200_000):
                    z = min(len(x), a + 200_000)
                    yield pd.DataFrame({"h": h, "c": c, "at": np.arange(a, z, dtype=np.int32), "x": x[a:z], "y": y[a:z]})

    w = rows.mapInPandas(windows, "h long, c long, at int, x long, y long")
    often = w.groupBy("x", "y").agg(F.count("*").alias("k")).filter("k > 1").select("x", "y")
    one = F.struct(F.col("at").alias("a"), (F.col("at") + length).alias("z"))
    return w.join(often, ["x", "y"]).groupBy("h", "c").agg(F.sort_array(F.collect_list(one)).alias("spans"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """_rid and spans (a, z): byte runs of each text, perhaps touching or overlapping, that are repeated.

    docs needs _rid and text; rows without such a run are left out.
    """
    spark = docs.sparkSession
    rows = spill(context_rows(docs, length, gram), "contexts")
    kinds = spill(
        rows.groupBy("h", "c").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.min(F.struct("_rid", "at", "size")).alias("r")).select("h", "c", "n", "twice", "r.*"), "kinds"
    )
    release(spark)
    per = kinds.groupBy("h").agg(F.count("*").alias("k"), F.max("twice").alias("any_twice"), F.sum("size").alias("held"), F.sum("n").alias("all_n"))
    # written first, so that the join below meets two plain exchanges and a hot hash can be split
    per = spill(per.filter("k > 1 OR any_twice").select("h", "held"), "per")
    many = spill(kinds.join(per, "h").select("h", "c", "n", "_rid", "at", "size", "held"), "many")
    total = many.agg(F.sum("size")).first()[0] or 0
    raw = spill(context_bytes(docs, many.select("h", "c", "_rid", "at", "size")), "bytes")
    release(spark)
    big = spill(many.filter(F.col("held") > 4 * index_bytes).select("h").distinct(), "big")
    hot = big.limit(1).count() > 0
    found = index_groups(raw.join(big, "h", "left_anti") if hot else raw, max(1, math.ceil(total / index_bytes)), length)
    if hot:
        found = found.unionByName(window_groups(raw.join(big, "h", "left_semi"), length))
    whole = kinds.filter("n > 1").select("h", "c", F.array(F.struct(F.lit(0).alias("a"), F.col("size").alias("z"))).alias("spans"))
    spans = spill(whole.unionByName(found), "spans")
    discard(raw, many, per, big)
    release(spark)
    hit = rows.select("h", "c", "_rid", "at").join(spans, ["h", "c"]).select("_rid", F.transform("spans", lambda s: F.struct((s["a"] + F.col("at")).alias("a"), (s["z"] + F.col("at")).alias("z"))).alias("s"))
    out = spill(hit.groupBy("_rid").agg(F.flatten(F.collect_list("s")).alias("spans")), "removed")
    discard(rows, kinds, spans)
    release(spark)
    return out


def merge(spans: list, n: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans; touching ones are one run."""
    out: list[list[int]] = []
    for a, z in sorted((x["a"], x["z"]) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, min(z, n)])
    return [(a, min(z, n)) for a, z in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for every row of docs.

    A byte goes if a string of `length` bytes that covers it starts anywhere else too, in any text or the
    same; strings are judged on the input. Null texts are empty, texts shorter than `length` lose nothing;
    repeated rows repeat each other and lose all they have in common; an empty table gives an empty one.
    Rows are told apart by ids in a written copy, so null and repeated ids and lost executors do no harm.
    """
    d = numbered(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), "_rid")
    spans = repeated_spans(d, length, gram)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b for b in batches if len(b)):
            out = []
            for text, found in zip(pdf["text"], pdf["spans"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                runs = merge(found, len(raw)) if found is not None else []
                at, parts = 0, []
                for a, z in runs:
                    parts.append(raw[at:a])
                    at = z
                out.append((len(raw), sum(z - a for a, z in runs), len(runs), b"".join([*parts, raw[at:]])))
            n, gone, k, kept = zip(*out, strict=True)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": n, "n_removed": gone, "n_spans": k, "kept": kept})

    return d.join(spans.hint("shuffle_hash"), "_rid", "left").select("doc_id", "text", "spans").mapInPandas(run, "doc_id string, n_bytes long, n_removed long, n_spans long, kept binary").withColumn("doc_id", F.col("doc_id").cast("long"))
