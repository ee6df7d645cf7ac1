"""Exact n-gram Jaccard join in the metric space of shingle sets.

Texts become sets of hashed word shingles; equal sets are one node. Jaccard distance is a metric, so a
pivot's distances bound all others. Nodes that can link must share a token of their prefixes, the part of
a set, rarest tokens first, that a set this similar cannot miss. The least node of each token is a pivot;
the nodes that meet it form its region, and every link lies inside some region.

A region joins recursively: a pivot takes all members within the link distance into its cell; members
beyond become pivots of further cells; and a member within twice that distance of another cell's pivot,
the window in which the triangle inequality allows a link across, becomes a pivot as well, until no window
spans two components. First each node joins only its commonest region, which joins most copies; then the
regions that still hold several classes join completely. Large regions are cut into blocks that meet in
pairs, so no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import fresh, numbered, release, spill

WORDS = 5
PERCENT = 75
#: Slots of the frequency sketch that orders tokens: bounded, whatever the corpus.
SKETCH_BITS = 22
_SLICES = 64
#: Members of a block; a task holds two at most.
BLOCK = 1000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit hash of a word; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words; of all words as one run, if there are fewer."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))
    k = min(words, len(w))
    n = len(w) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * _ODD + h[j : n + j]
    out = np.sort(_mix(out))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def node_of(tokens: np.ndarray) -> int:
    """The signed 64-bit id of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))) if len(tokens) else 0


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Tokens of which a set of n must share one with any set that similar."""
    return n - -(-n * percent // 100) + 1


def signature_bits(n: int) -> int:
    """Bits of the signature of a set of n: a power of two, at least twice n and 64."""
    return max(64, 1 << (2 * n - 1).bit_length())


def signature(tokens: np.ndarray) -> bytes:
    """The parity of the number of tokens in each of signature_bits() slots.

    Each token in one set only flips one bit, so two signatures differ in no more bits than the sets do in
    tokens. A longer one folds onto a shorter by exclusive or of its halves.
    """
    bits = signature_bits(len(tokens))
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def slot(tokens: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


# ---- joining one region -------------------------------------------------------------------------


class Members:
    """Sets with an inverted index of the tokens that two or more of them hold."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        sorted_tokens = tokens[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_tokens[1:] != sorted_tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(tokens)))
        group = np.empty(len(tokens), np.int64)
        group[order] = np.repeat(np.arange(len(first)), count)
        self.postings, self.first, self.count, self.group = owner[order], first, count, group
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])

    def shared(self, q: int) -> np.ndarray:
        """Tokens that each member shares with member q."""
        g = self.group[self.bounds[q] : self.bounds[q + 1]]
        g = g[self.count[g] > 1]
        n = self.count[g]
        if not len(g):
            out = np.zeros(len(self.sizes), np.int64)
        else:
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(self.first[g] - (ends - n), n)
            out = np.bincount(self.postings[at], minlength=len(self.sizes))
        out[q] = self.sizes[q]
        return out


def join_region(sets: list[np.ndarray], labels: list | None = None, need: np.ndarray | None = None, percent: int = PERCENT) -> np.ndarray:
    """The component of each member, as the index of its first member.

    Members with equal labels are known to be linked. need marks those that must meet all others; pairs
    of members that neither is needed are left to the labels.
    """
    m = len(sets)
    parent = np.arange(m)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)

    if labels is not None:
        seen: dict = {}
        for i, x in enumerate(labels):
            union(i, seen.setdefault(x, i))
    index = Members(sets)
    need = np.ones(m, bool) if need is None else need
    covered, pivot = ~need, np.zeros(m, bool)
    windows: list[tuple[int, np.ndarray]] = []

    def open_cell(q: int) -> None:
        both = index.shared(q)
        of = index.sizes[q] + index.sizes - both
        link = 100 * both >= percent * of
        for j in np.flatnonzero(link):
            union(q, int(j))
        covered[link] = True
        pivot[q] = True
        # twice the link distance: beyond it no member can link into this cell
        wide = ~link & (100 * both >= (2 * percent - 100) * of)
        if wide.any():
            windows.append((q, np.flatnonzero(wide)))

    for q in np.flatnonzero(need):
        if not covered[q]:
            open_cell(int(q))
    while True:
        todo = {int(w) for q, near in windows for w in near if not pivot[w] and find(int(w)) != find(q)}
        if not todo:
            break
        for w in sorted(todo):
            if not pivot[w]:
                open_cell(w)
    return np.array([find(i) for i in range(m)], dtype=np.int64)


def plausible(sizes: np.ndarray, signatures: list[bytes], percent: int = PERCENT) -> np.ndarray:
    """Members that some other member may link with, by size and by the bits in which signatures differ.

    No member with a link is left out.
    """
    alive = np.zeros(len(sizes), bool)
    classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    width = np.array([len(x) for x in signatures])
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        own = own[np.argsort(sizes[own], kind="stable")]
        classes[int(w)] = own, np.frombuffer(b"".join(signatures[i] for i in own), np.uint64).reshape(len(own), -1)

    def compare(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, same: bool) -> None:
        # b is in order of size: each member of a meets one stretch of it
        low = np.searchsorted(sizes[b], -(-sizes[a] * percent // 100), side="left")
        high = np.searchsorted(sizes[b], sizes[a] * 100 // percent, side="right")
        for k in range(len(a)):
            lo = max(low[k], k + 1) if same else low[k]
            for c in range(lo, high[k], 4096):
                cut = slice(c, min(high[k], c + 4096))
                apart = np.bitwise_count(y[cut] ^ x[k]).sum(axis=1, dtype=np.int64)
                ok = (100 + percent) * apart <= (100 - percent) * (sizes[b[cut]] + sizes[a[k]])
                if ok.any():
                    alive[a[k]] = True
                    alive[b[cut][ok]] = True

    for w, (own, x) in classes.items():
        compare(own, x, own, x, True)
        if 2 * w in classes:
            other, y = classes[2 * w]
            half = y.shape[1] // 2
            compare(own, x, other, y[:, :half] ^ y[:, half:], False)
    return alive


# ---- the distributed join -----------------------------------------------------------------------


def sets_and_sketch(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, np.ndarray]:
    """_rid, doc_id, n, node, sig of every row of docs, and a level for each slot of the sketch.

    Each task counts the tokens of its distinct sets into the sketch's slots; levels are twice the
    logarithm of the counts.
    """
    schema = "_rid long, doc_id string, n long, node long, sig binary, slice int, slot int, counts binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, seen, held, size, first = np.zeros(1 << SKETCH_BITS, np.uint32), set(), [], 0, 0

        def flush() -> None:
            if held:
                np.add(counts, np.bincount(slot(np.concatenate(held)), minlength=len(counts)), out=counts, casting="unsafe")
                held.clear()

        for pdf in (b for b in batches if len(b)):
            ns, nodes, sigs = [], [], []
            for text in pdf["text"]:
                s = shingles(text, words)
                ns.append(len(s))
                nodes.append(node_of(s))
                sigs.append(signature(s) if len(s) else b"")
                if len(s) and nodes[-1] not in seen:
                    if len(seen) > 300_000:
                        seen.clear()
                    seen.add(nodes[-1])
                    held.append(s)
                    size += len(s)
                    if size > 1_000_000:
                        flush()
                        size = 0
            first = first or int(pdf["_rid"].iloc[0])
            yield pd.DataFrame({"_rid": pdf["_rid"], "doc_id": pdf["doc_id"], "n": ns, "node": nodes, "sig": sigs, "slice": -1, "slot": 0, "counts": None})
        flush()
        if counts.any():
            parts = counts.astype(np.uint32).reshape(_SLICES, -1)
            yield pd.DataFrame(
                {"_rid": pd.array([None] * _SLICES, "Int64"), "doc_id": None, "n": pd.array([None] * _SLICES, "Int64"), "node": pd.array([None] * _SLICES, "Int64"),
                 "sig": None, "slice": range(_SLICES), "slot": (first >> 33) % 64, "counts": [_packed(p) for p in parts]}
            )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // _SLICES, np.uint64)
        for raw in pdf["counts"]:
            total += _unpacked(raw)
        return pd.DataFrame({"slice": [int(pdf["slice"].iloc[0])], "slot": [0], "counts": [_packed(np.minimum(total, 2**32 - 1).astype(np.uint32))]})

    both = spill(docs.select("_rid", F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema), "sets")
    part = "slice int, slot int, counts binary"
    sums = both.filter("slice >= 0").select("slice", "slot", "counts").groupBy("slice", "slot").applyInPandas(add, part).groupBy("slice").applyInPandas(add, part).collect()
    level = np.zeros((_SLICES, (1 << SKETCH_BITS) // _SLICES), np.uint8)
    for r in sums:
        level[r["slice"]] = (2 * np.log2(1.0 + _unpacked(r["counts"]))).astype(np.uint8)
    return both.filter("slice < 0").select("_rid", F.col("doc_id").cast("long").alias("doc_id"), "n", "node", "sig"), level.ravel()


def _packed(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(a.astype(np.uint32).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint32).astype(np.uint64)


def prefix(tokens: np.ndarray, level: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The prefix of a set under the order by level, then hash; the same order in every set."""
    k = prefix_length(len(tokens), percent)
    of = level[slot(tokens)]
    order = np.argsort(of, kind="stable")[:k]  # tokens are sorted, so ties stay in the order of hashes
    return tokens[order]


def region_pairs(docs: DataFrame, level: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """node, pivot, k: in how many tokens of the node's prefix that pivot is the least node.

    A token's nodes fall apart where sizes are too far from each other for any link across; each part
    has a pivot of its own, and parts of one node are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            tokens, nodes, sizes, n = [], [], [], 0
            out = lambda: pd.DataFrame({"token": np.concatenate(tokens), "node": np.concatenate(nodes), "n": np.concatenate(sizes)})
            for text in pdf["text"]:
                s = shingles(text, words)
                node = node_of(s)
                if len(s) and node not in seen:
                    if len(seen) > 300_000:
                        seen.clear()
                    seen.add(node)
                    p = prefix(s, sent.value, percent)
                    tokens.append(p.view(np.int64))
                    nodes.append(np.full(len(p), node, np.int64))
                    sizes.append(np.full(len(p), len(s), np.int32))
                    n += len(p)
                    if n > 500_000:
                        yield out()
                        tokens, nodes, sizes, n = [], [], [], 0
            if tokens:
                yield out()

    rows = docs.select("text").mapInPandas(run, "token long, node long, n int")
    w = Window.partitionBy("token")
    met = rows.withColumns({"a": F.min("node").over(w), "z": F.max("node").over(w)}).filter("a <> z")
    by_size = w.orderBy("n", "node")
    gap = F.lag("n").over(by_size) * 100 < F.col("n") * percent
    parts = met.withColumn("part", F.coalesce(F.sum(gap.cast("int")).over(by_size.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    p = Window.partitionBy("token", "part")
    near = parts.withColumns({"pivot": F.min("node").over(p), "z": F.max("node").over(p)}).filter("pivot <> z")
    return near.groupBy("node", "pivot").agg(F.count("*").alias("k"))


def plausible_pairs(pairs: DataFrame, own: DataFrame, percent: int = PERCENT, block: int = BLOCK // 2) -> DataFrame:
    """Those (node, pivot, k) whose node may link with another node of the pivot's region.

    Regions larger than a block meet in pairs of blocks. The least node that stays becomes the pivot.
    """
    with_self = pairs.select("node", "pivot", "k")
    size = with_self.groupBy("pivot").agg(F.count("*").alias("m"))
    dealt = with_self.join(size, "pivot").withColumn("nb", F.ceil(F.col("m") / block).cast("int")).withColumn("at", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least("at", j).alias("i"), F.greatest("at", j).alias("j")))
    tasks = dealt.select("node", "pivot", "k", F.explode(meet).alias("t"))
    sigs = own.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    rows = tasks.join(sigs, "node").select("pivot", "t.i", "t.j", "node", "k", "n", "sig")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.loc[plausible(pdf["n"].to_numpy(), pdf["sig"].tolist(), percent), ["node", "pivot", "k"]]

    kept = spill(rows.groupBy("pivot", "i", "j").applyInPandas(run, "node long, pivot long, k long").distinct(), "kept")
    least = kept.groupBy("pivot").agg(F.min("node").alias("least"))
    return kept.join(least, "pivot").groupBy("node", F.col("least").alias("pivot")).agg(F.sum("k").alias("k"))


def node_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """node, tokens of the wanted (_rid, node)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (b for b in batches if len(b)):
            yield pd.DataFrame({"node": pdf["node"], "tokens": [shingles(t, words).tobytes() for t in pdf["text"]]})

    return docs.select("_rid", "text").join(wanted.hint("shuffle_hash"), "_rid").select("node", "text").mapInPandas(run, "node long, tokens binary")


def first_edges(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """a, b: links within the commonest region of each node, a block of members with the region's pivot at a time."""
    home = pairs.groupBy("node").agg(F.max(F.struct("k", "pivot")).alias("m")).select("node", F.col("m.pivot").alias("pivot"))
    size = home.groupBy("pivot").agg(F.count("*").alias("members"))
    dealt = home.join(size, "pivot").withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    own = dealt.filter("node <> pivot").select("node", "pivot", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("b"))
    pivots = size.select(F.col("pivot").alias("node"), "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("members") / block) - 1)).alias("b"))
    rows = own.unionByName(pivots).join(sets, "node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(first=pdf["node"] != pdf["pivot"]).sort_values(["first", "node"]).reset_index(drop=True)
        comp = join_region([np.frombuffer(t, np.uint64) for t in pdf["tokens"]], percent=percent)
        a, b = pdf["node"].to_numpy(), pdf["node"].to_numpy()[comp]
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    return rows.groupBy("pivot", "b").applyInPandas(run, "a long, b long")


def rest_edges(pairs: DataFrame, labels: DataFrame, sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """a, b: links that are still missing, from all regions that hold more than one class."""
    with_self = pairs.select("node", "pivot").unionByName(pairs.select(F.col("pivot").alias("node"), "pivot")).distinct()
    p = with_self.join(labels, "node").join(labels.select(F.col("node").alias("pivot"), F.col("label").alias("plabel")), "pivot")
    p = p.withColumn("far", F.col("label") != F.col("plabel"))
    stat = p.groupBy("pivot").agg(F.count_if("far").alias("nf"), F.count_if(~F.col("far")).alias("nl")).filter("nf > 0")
    p = p.join(stat, "pivot")
    fb, lb = F.ceil(F.col("nf") / block).cast("int"), F.ceil(F.col("nl") / block).cast("int")
    p = p.withColumns({"fb": fb, "lb": lb}).withColumn("at", F.pmod(F.xxhash64("node"), F.when(F.col("far"), F.col("fb")).otherwise(F.col("lb"))).cast("int"))
    one = F.array(F.struct(F.lit("S").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    t = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    of_far = F.concat(F.transform(upto("fb"), lambda j: t("F", F.least(F.col("at"), j), F.greatest(F.col("at"), j))), F.transform(upto("lb"), lambda j: t("L", F.col("at"), j)))
    tasks = F.when(F.col("nf") + F.col("nl") <= block, one).when(F.col("far"), of_far).otherwise(F.transform(upto("fb"), lambda i: t("L", i, F.col("at"))))
    rows = p.withColumn("t", F.explode(tasks)).select("pivot", "t.kind", "t.i", "t.j", "node", "label", "far").join(sets, "node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node").reset_index(drop=True)
        node, label = pdf["node"].to_numpy(), pdf["label"].to_numpy()
        comp = join_region([np.frombuffer(x, np.uint64) for x in pdf["tokens"]], label.tolist(), pdf["far"].to_numpy(), percent)
        a, b = label, label[comp]
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]}).drop_duplicates()

    return rows.groupBy("pivot", "kind", "i", "j").applyInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: connected components of (a, b), root the least node; only nodes that have an edge.

    Alternating large-star and small-star steps; each writes its edges to the shared folder, and they end
    when a round changes nothing.
    """
    e = spill(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    last = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written, so that the joins meet two plain exchanges and a hub's edges can be split
        low = spill(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        e = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        e = spill(e, "large")
        low = spill(e.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        e = spill(small.distinct(), "edges")
        now = mark(e)
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """_rid, doc_id, n_shingles, node, root for every row of docs, which needs _rid, doc_id and text.

    Rows link if 100 * intersection >= percent * union of their shingle sets; root names the connected
    component. Null and empty texts, and texts of white space, have an empty set and link with nothing:
    their root is null. Fewer words than `words` are one shingle. Repeated rows link with each other. An
    empty table gives an empty one. percent must be above 50.
    """
    spark = docs.sparkSession
    own, level = sets_and_sketch(docs, words)
    alone = F.when(F.col("n") > 0, F.col("node")).alias("root")
    pairs = spill(region_pairs(docs, level, words, percent), "pairs")
    release(spark)
    if pairs.limit(1).count():
        pairs = spill(plausible_pairs(pairs, own, percent), "plausible")
        release(spark)
    if not pairs.limit(1).count():  # no two sets share a token: no links but between equal sets
        return own.select("_rid", "doc_id", F.col("n").alias("n_shingles"), "node", alone)
    nodes = pairs.select("node").unionByName(pairs.select(F.col("pivot").alias("node"))).distinct()
    wanted = own.filter("n > 0").groupBy("node").agg(F.min("_rid").alias("_rid")).join(nodes, "node")
    sets = spill(node_sets(docs, wanted, words), "tokens")
    release(spark)
    near = spill(components(first_edges(pairs, sets, percent, block)), "near")
    labels = spill(nodes.join(near, "node", "left").select("node", F.coalesce("root", F.col("node")).alias("label")), "labels")
    more = near.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest_edges(pairs, labels, sets, percent, block))
    roots = spill(components(more), "roots")
    release(spark)
    root = F.when(F.col("n") > 0, F.coalesce("root", F.col("node")))
    return own.join(roots, "node", "left").select("_rid", "doc_id", F.col("n").alias("n_shingles"), "node", root.alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the smallest doc_id of the row's component.

    See classes(). Rows with an empty set are their own component; a component of null ids alone has a
    null component_id.
    """
    c = spill(classes(numbered(docs.select("doc_id", "text"), "_rid"), words, percent, block), "classes")
    # written first, so that the join below meets two plain exchanges and a hot component can be split
    some = spill(c.filter("root IS NOT NULL").groupBy("root").agg(F.count("*").alias("k"), F.min("doc_id").alias("component_id")).filter("k > 1"), "components")
    out = c.join(some, "root", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("k") > 1, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """docs with one row of each component: the one of the smallest doc_id, null ids last, then the first row.

    Rows with an empty set link with nothing and stay.
    """
    rid = fresh("_rid", docs.columns)
    d = numbered(docs, rid)
    c = spill(classes(d.select("doc_id", "text", F.col(rid).alias("_rid")), words, percent, block), "classes")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_rid"))
    first = c.filter("root IS NOT NULL").groupBy("root").agg(F.min_by("_rid", order).alias("_rid")).select("_rid")
    keep = first.unionByName(c.filter("root IS NULL").select("_rid"))
    return d.join(keep.select(F.col("_rid").alias(rid)).hint("shuffle_hash"), rid, "left_semi").select(*docs.columns)
