"""Gated recurrent language model with a class-factored output, in numpy.

Word counts come from every training document. The commonest words are the model's vocabulary; all
others are one unknown word for the network, and share its probability by their smoothed counts, so
that texts with any words have a proper probability. Documents are encoded once. Training is truncated
backpropagation, first on a bounded sample on the driver, then on all training documents, in groups
dealt by a hash of id and text, with the groups' parameters averaged in the order of the groups: the net
does not depend on how the table is split. Scoring carries the state from window to window through
whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import discard, fold, numbered, release, spill

VOCABULARY = 4096  # with the unknown word (0) and the end (1)
CLASS = 64  # words a class; classes are runs of ranks
DIM = 32
HIDDEN = 32
STEPS = 32  # length of a window
STREAMS = 64
WIDE = 256  # streams of the groups, which have more text
#: Words whose counts every task holds; rarer words meet their counts in a join.
HEAD = 200_000
#: The driver's first fit sees about so many documents, by hash, of at most so many tokens each.
SAMPLE_DOCS, SAMPLE_TOKENS = 1000, 100_000
#: Words that a task counts at once.
COUNTED_AT_ONCE = 4_000_000
#: Tokens of a group of training documents.
GROUP_TOKENS = 4_000_000
UNKNOWN, END = 0, 1
RATE = 0.1
_CHUNKS = 64
_ROWS = 4096  # rows of logits at once, so that they stay in the cache
_BLOCK = 2048  # rows of a training step's logits at once
_SAFE = 80.0  # logits within this bound need no maximum before the exponential


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes.split and bytes.lower know ASCII only, as wanted."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and how many each text has; the same words as words_of() finds."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(pc.binary_length(words), 0)
    if pc.any(blank).as_py():  # of a text without a word the split leaves one empty string
        sizes[blank.to_numpy(zero_copy_only=False)[np.cumsum(sizes) - 1]] = 0
        words = words.filter(pc.invert(blank))
    return words, sizes


def pieces(batch: pa.RecordBatch, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about `most` bytes of text, a row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + most, side="right")))
        yield batch.slice(a, z - a)
        a = z


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all texts of docs; each task sums its own words before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = 0

        def out() -> pa.RecordBatch:
            found = pc.value_counts(pa.concat_arrays(held))
            held.clear()
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

        for batch in batches:
            for piece in pieces(batch):
                words, _ = split_words(piece.column("text"))
                held.append(words)
                size += len(words)
                if size > COUNTED_AT_ONCE:
                    yield out()
                    size = 0
        if size:
            yield out()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The words with the highest counts, at most `most` of them; words of one count are all in or all out.

    The bound is a count, found from how many words have each, so no task sends more than its own share.
    """
    top = 1_000_000
    have = counts.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count("*").alias("words")).collect()  # at most `top` rows
    least, total = None, 0
    for n, words in sorted(((r["n"], r["words"]) for r in have), reverse=True):
        if total + words > most:
            break
        least, total = n, total + words
    return counts.filter(F.col("n") >= least) if least is not None else counts.limit(0)


@dataclass
class Net:
    embed: np.ndarray  # V x DIM
    wx: np.ndarray  # DIM x 3H: update, reset, new
    u: np.ndarray  # H x 3H
    b: np.ndarray  # 3H
    wc: np.ndarray  # H x C
    bc: np.ndarray  # C
    wo: np.ndarray  # V x H
    bo: np.ndarray  # V

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.wx, self.u, self.b, self.wc, self.bc, self.wo, self.bo]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float32)

    def with_flat(self, flat: np.ndarray) -> Net:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Net(*out)


def new_net(counts: np.ndarray, dim: int = DIM, hidden: int = HIDDEN, size: int = CLASS, seed: int = 2) -> Net:
    """A net whose output starts at the smoothed unigram distribution of counts (one a vocabulary word)."""
    rng = np.random.default_rng(seed)
    v = len(counts)
    p = (counts + 0.5) / (counts + 0.5).sum()
    classes = -(-v // size)
    pc = np.bincount(np.arange(v) // size, weights=p, minlength=classes)
    f = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
    return Net(
        rng.normal(0, 0.3, (v, dim)).astype(np.float32), f(dim, 3 * hidden), f(hidden, 3 * hidden), np.zeros(3 * hidden, np.float32),
        0.1 * f(hidden, classes), np.log(pc).astype(np.float32), 0.1 * f(v, hidden), np.log(p / pc[np.arange(v) // size]).astype(np.float32),
    )


def _logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)), in place."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _log_sum(x: np.ndarray, safe: bool = False) -> np.ndarray:
    """ln of the sum of exponentials of each row. x is overwritten.

    Where all of x is known to be within the safe bound, no maximum is taken. Else one maximum serves the
    whole block; rows so far below it that their sum underflows get their own.
    """
    if safe:
        np.exp(x, out=x)
        return np.log(x @ np.ones(x.shape[1], x.dtype))
    top = x.max() if x.size else np.float32(0)
    x -= top
    low = x.max(axis=1) < -60 if x.size and x.min() < -60 else None
    far = x[low].astype(np.float64) if low is not None and low.any() else None
    np.exp(x, out=x)
    out = np.log(x @ np.ones(x.shape[1], x.dtype) + np.float32(1e-38))
    if far is not None:
        own = far.max(axis=1)
        out[low] = own + np.log(np.exp(far - own[:, None]).sum(axis=1))
    return out + top


class Output:
    """The output layer made ready: weights with their biases as a last row, and whether logits are safely small.

    States lie within -1 and 1, so a logit is at most the sum of its absolute weights.
    """

    def __init__(self, net: Net, size: int = CLASS):
        self.size = size
        self.classes = np.vstack([net.wc, net.bc[None]]).astype(np.float32)
        self.words = np.concatenate([net.wo, net.bo[:, None]], axis=1).astype(np.float32).reshape(-1, size, net.wo.shape[1] + 1).transpose(0, 2, 1).copy()
        self.safe = bool(np.abs(self.classes).sum(axis=0).max() < _SAFE and np.abs(self.words).sum(axis=1).max() < _SAFE)

    def _each(self, states: np.ndarray, weights: np.ndarray, chosen: np.ndarray, out: np.ndarray) -> None:
        for a in range(0, len(states), _ROWS):
            z = min(len(states), a + _ROWS)
            x = states[a:z] @ weights
            out[a:z] += x[np.arange(z - a), chosen[a:z]]
            out[a:z] -= _log_sum(x, self.safe)

    def log_prob(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """ln of each id's probability after its state, a row that ends in 1: its class's, times its own in the class."""
        cls = ids // self.size
        order = np.argsort(cls.astype(np.int16), kind="stable")
        states, ids, cls = np.take(states, order, axis=0), ids[order], cls[order]
        got = np.zeros(len(ids), np.float32)
        self._each(states, self.classes, cls, got)
        edges = np.searchsorted(cls, np.arange(len(self.words) + 1))
        for c in np.flatnonzero(np.diff(edges)):
            a, z = edges[c], edges[c + 1]
            self._each(states[a:z], self.words[c], ids[a:z] - c * self.size, got[a:z])
        out = np.empty_like(got)
        out[order] = got
        return out


def output_log_prob(net: Net, h: np.ndarray, ids: np.ndarray, size: int = CLASS) -> np.ndarray:
    """ln of each id's probability after the state h."""
    return Output(net, size).log_prob(np.concatenate([h, np.ones((len(h), 1), np.float32)], axis=1).astype(np.float32), ids)


def log_prob(net: Net, docs: list[np.ndarray], steps: int = STEPS) -> np.ndarray:
    """ln of the probability of each document's ids, each from its first to its last.

    Documents run side by side, the longest first, so that those still running are a prefix; the state
    is carried from window to window, and only the windows' states are held at once. Equal documents
    are worked on once.
    """
    names: dict[bytes, int] = {}
    place = np.array([names.setdefault(d.tobytes(), len(names)) for d in docs], np.int64)
    if len(names) < len(docs):
        first = np.unique(place, return_index=True)[1]
        return log_prob(net, [docs[i] for i in first], steps)[place]
    score = np.zeros(len(docs))
    if not docs:
        return score
    sizes = np.array([len(d) for d in docs])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    flat = np.concatenate([docs[i] for i in order]) if sizes.sum() else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    hid, output = net.u.shape[0], Output(net)
    table = net.embed @ net.wx + net.b
    # update, reset and new apart, so that each is one stretch of memory; gates are 1 / (1 + exp(-x))
    (tz, tr, tn), (uz, ur, un) = ([np.ascontiguousarray(x[:, k * hid : (k + 1) * hid]) * np.float32(1 if k == 2 else -1) for k in range(3)] for x in (table, net.u))
    h = np.zeros((len(docs), hid), np.float32)
    previous = np.full(len(docs), END, np.int64)
    got = np.zeros(len(docs))
    longest = int(sizes[0])
    running = np.searchsorted(-sizes, -np.arange(longest), side="left")  # documents longer than t
    for t0 in range(0, longest, steps):
        ends = np.concatenate([[0], np.cumsum(running[t0 : t0 + steps])])
        states, targets = np.ones((ends[-1], hid + 1), np.float32), np.empty(ends[-1], np.int64)
        for k, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            n = z - a
            h, previous = h[:n], previous[:n]
            gate = h @ ur
            gate += np.take(tr, previous, axis=0)
            new = h @ un
            new *= _logistic(gate)
            new += np.take(tn, previous, axis=0)
            np.tanh(new, out=new)
            np.matmul(h, uz, out=gate)
            gate += np.take(tz, previous, axis=0)
            h = h - new
            h *= _logistic(gate)
            h += new
            states[a:z, :hid] = h
            previous = targets[a:z] = flat[starts[:n] + (t0 + k)]
        lp = output.log_prob(states, targets)
        for a, z in zip(ends[:-1], ends[1:], strict=True):
            got[: z - a] += lp[a:z]
    score[order] = got
    return score


class Adagrad:
    def __init__(self, net: Net, rate: float):
        self.rate, self.sums, self.room = rate, [np.full_like(p, 1e-3) for p in net.parts()], Room()

    def step(self, net: Net, grads: list[np.ndarray]) -> None:
        for k, (p, s, g) in enumerate(zip(net.parts(), self.sums, grads, strict=True)):
            if isinstance(g, tuple):  # rows and their gradients
                rows, g = g
                own = np.take(s, rows, axis=0) + g * g
                s[rows] = own
                p[rows] -= self.rate * g / np.sqrt(own)
            else:
                by = np.multiply(g, g, out=self.room(k, g.shape, g.dtype))
                s += by
                np.sqrt(s, out=by)
                np.divide(g, by, out=by)
                by *= self.rate
                p -= by


class Room(dict):
    """Arrays by name that every window uses again; new ones of that size would be pages that the system has to clear."""

    def __call__(self, name: str | int, shape: tuple[int, ...], kind: np.dtype) -> np.ndarray:
        if (held := self.get(name)) is None or held.shape != shape or held.dtype != kind:
            held = self[name] = np.empty(shape, kind)
        return held


def _order(keys: np.ndarray, most: int) -> np.ndarray:
    """The stable order of keys below `most`; short ones are sorted by their bytes."""
    return np.argsort(keys.astype(np.uint16) if most <= 1 << 16 else keys, kind="stable")


def _by_row(rows: np.ndarray, grads: np.ndarray, most: int, room: Room, often: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the sums of their gradients: rows met more than `often` one by one, the first, second, ...
    gradients of the others together."""
    order = _order(rows, most)
    rows = rows[order]
    grads = np.take(grads, order, axis=0, out=room("sorted", grads.shape, grads.dtype), mode="clip")
    at = np.flatnonzero(np.diff(rows, prepend=-1))
    times = np.diff(np.append(at, len(rows)))
    by = np.argsort(-times, kind="stable")
    at, times = at[by], times[by]
    sums = np.take(grads, at, axis=0)
    many = int(np.searchsorted(-times, -often, side="left"))
    for i, (a, n) in enumerate(zip(at[:many].tolist(), times[:many].tolist(), strict=True)):
        np.matmul(np.ones(n, grads.dtype), grads[a : a + n], out=sums[i])
    for k in range(1, often):
        z = int(np.searchsorted(-times, -k, side="left"))  # rows met more than k times
        if z <= many:
            break
        sums[many:z] += np.take(grads, at[many:z] + k, axis=0)
    return rows[at], sums


def _softmax(x: np.ndarray, safe: bool) -> np.ndarray:
    """Exponentials over their sum in each row, in place."""
    if not safe:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x *= (1 / (x @ np.ones(x.shape[1], x.dtype)))[:, None]
    return x


def output_gradients(net: Net, states: np.ndarray, ids: np.ndarray, size: int, room: Room) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Loss of each id, the gradients of the states, and those of wc with bc and of wo with bo, of the summed loss.

    A state is a row that ends in 1, which carries the biases. Rows are put in the order of their classes, so that
    each class is one slice, and worked on in blocks that stay in a core's cache.
    """
    n, hid, kind, many = len(ids), states.shape[1] - 1, states.dtype, net.wc.shape[1]
    top = np.vstack([net.wc, net.bc[None]])
    words = room("words", (len(net.bo), hid + 1), kind)
    words[:, :hid], words[:, hid] = net.wo, net.bo
    safe = max(np.abs(top).sum(axis=0).max(), (np.abs(words) @ np.ones(hid + 1, kind)).max()) < _SAFE
    order = _order(ids // size, many)
    one = np.take(states, order, axis=0, out=room("states in order", states.shape, kind), mode="clip")
    ids = ids[order]
    cls = ids // size
    edges = np.searchsorted(cls, np.arange(many + 1)).tolist()
    inner = room("inner", words.shape, kind)
    for c in np.flatnonzero(np.diff(edges) == 0).tolist():
        inner[c * size : (c + 1) * size] = 0
    back, gtop = top[:hid].T.copy(), np.zeros_like(top)
    dh, right, at = room("dh in order", (n, hid), kind), np.empty(n, kind), np.arange(min(n, _BLOCK))
    for a in range(0, n, _BLOCK):
        z = min(n, a + _BLOCK)
        h, d, more = one[a:z], dh[a:z], room("more", (_BLOCK, hid), kind)[: z - a]
        p, q = room("p", (_BLOCK, many), kind)[: z - a], room("q", (_BLOCK, size), kind)[: z - a]
        slices = [(max(a, edges[c]), min(z, edges[c + 1]), c * size) for c in range(cls[a], cls[z - 1] + 1)]
        slices = [(i, j, v) for i, j, v in slices if i < j]
        _softmax(np.matmul(h, top, out=p), safe)
        for i, j, v in slices:
            np.matmul(one[i:j], words[v : v + size].T, out=q[i - a : j - a])
        _softmax(q, safe)
        right[a:z] = 1
        for x, chosen in ((p, cls[a:z]), (q, ids[a:z] - cls[a:z] * size)):
            flat, own = x.reshape(-1), at[: z - a] * x.shape[1] + chosen
            hit = flat[own]
            right[a:z] *= hit
            flat[own] = hit - 1
        np.matmul(p, back, out=d)
        gtop += h.T @ p
        for i, j, v in slices:
            np.matmul(q[i - a : j - a], net.wo[v : v + size], out=more[i - a : j - a])
            if i == edges[v // size]:
                np.matmul(q[i - a : j - a].T, one[i:j], out=inner[v : v + size])
            else:
                inner[v : v + size] += q[i - a : j - a].T @ one[i:j]
        d += more
    loss, out = np.empty(n, kind), room("dh", (n, hid), kind)
    loss[order], out[order] = -np.log(right + 1e-30), dh
    return loss, out, [gtop, inner]


def gradients(net: Net, x: np.ndarray, y: np.ndarray, h: np.ndarray, size: int = CLASS, room: Room | None = None) -> tuple[list, np.ndarray, float]:
    """Gradients of the mean loss over a window (steps x streams), the state after it, and the loss.

    The state is cleared where a document begins, that is after an end. room: the arrays of the window before,
    whose gradients are overwritten then.
    """
    room = Room() if room is None else room
    steps, streams = x.shape
    hid, dim = net.u.shape[0], net.embed.shape[1]
    n, kind = steps * streams, net.u.dtype
    # words' vectors with a 1 at last, which carries the biases
    table = room("table", (len(net.embed), dim + 1), kind)
    table[:, :dim], table[:, dim] = net.embed, 1
    e = np.take(table, x.ravel(), axis=0, out=room("e", (n, dim + 1), kind), mode="clip").reshape(steps, streams, dim + 1)
    # states and gates have a column a stream, so that a step's three gates are one product and each is one stretch of
    # memory; update and reset are 1 / (1 + exp(x)), so their signs are turned
    sign = np.repeat(np.array([-1, -1, 1], kind), hid)
    u, wx = np.ascontiguousarray((net.u * sign).T), np.ascontiguousarray((np.vstack([net.wx, net.b[None]]) * sign).T)
    gates, hs, inner = room("gates", (steps, 3 * hid, streams), kind), room("hs", (steps + 1, hid, streams), kind), room("new", (steps, hid, streams), kind)
    states = room("states", (steps, streams, hid + 1), kind)
    states[:, :, hid] = 1
    begins = [np.flatnonzero(row) for row in x == END]
    ahead, some = room("ahead", (2 * hid, streams), kind), room("some", (hid, streams), kind)
    hs[0] = h.T
    for t in range(steps):
        before = hs[t]
        before[:, begins[t]] = 0
        gate = np.matmul(wx, e[t].T, out=gates[t])
        both, new = gate[: 2 * hid], gate[2 * hid :]
        both += np.matmul(u[: 2 * hid], before, out=ahead)
        _logistic(both)
        np.matmul(u[2 * hid :], before, out=inner[t])
        new += np.multiply(both[hid:], inner[t], out=some)
        np.tanh(new, out=new)
        h = np.subtract(before, new, out=hs[t + 1])
        h *= both[:hid]
        h += new
        states[t, :, :hid] = h.T
    loss, dh, outputs = output_gradients(net, states.reshape(n, hid + 1), y.ravel(), size, room)
    dh = dh.reshape(steps, streams, hid)
    back = np.ascontiguousarray(np.roll(net.u, hid, axis=1))  # new, update, reset
    wx, ge = np.ascontiguousarray(net.wx.T), room("ge", (steps, streams, dim), kind)
    gu, gwx = np.zeros((3 * hid, hid), kind), np.zeros((3 * hid, dim + 1), kind)
    carry, d = np.zeros((hid, streams), kind), room("d", (hid, streams), kind)
    slopes = room("slopes", (4, hid, streams), kind)  # of new's state part, update, reset and new
    sm, sz, sr, sn = slopes
    to_state, to_input = slopes[:3].reshape(3 * hid, streams), slopes[1:].reshape(3 * hid, streams)
    for t in reversed(range(steps)):
        np.add(dh[t].T, carry, out=d)
        before, (z, r, new) = hs[t], gates[t].reshape(3, hid, streams)
        np.subtract(1, z, out=some)
        np.multiply(new, new, out=sn)
        np.subtract(1, sn, out=sn)
        some *= d
        sn *= some
        np.subtract(before, new, out=sz)
        sz *= some
        sz *= z
        np.multiply(sn, r, out=sm)
        np.subtract(1, r, out=sr)
        sr *= sm
        sr *= inner[t]
        np.matmul(back, to_state, out=carry)
        d *= z
        carry += d
        carry[:, begins[t]] = 0
        gu += to_state @ before.T
        gwx += to_input @ e[t]
        np.matmul(to_input.T, wx, out=ge[t])
    rows, sums = _by_row(x.ravel(), ge.reshape(n, dim), len(net.embed), room)
    dense = [gwx.T, np.roll(gu.T, -hid, axis=1), *outputs]
    norm = float(np.sqrt(sum(float(np.vdot(g, g)) for g in (sums, *dense)))) / n
    scale = kind.type(1 / n / max(1.0, norm))
    sums *= scale
    gwx, gu, gtop, gwords = dense
    parts = [gwx[:dim], gu, gwx[dim], gtop[:hid], gtop[hid], gwords[:, :hid], gwords[:, hid]]
    return [(rows, sums), *(np.multiply(g, scale, out=room(k, g.shape, kind)) for k, g in enumerate(parts))], hs[steps].T.copy(), float(loss.mean())


def train(net: Net, docs: list[np.ndarray], epochs: int = 1, rate: float = 0.1, steps: int = STEPS, streams: int = STREAMS) -> list[float]:
    """Train net in place by truncated backpropagation over parallel streams; the mean loss of each epoch."""
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    streams = max(1, min(streams, len(flat) // (2 * steps)))
    long = len(flat) // streams
    if long < 2:
        return []
    y = flat[: long * streams].reshape(streams, long).T
    x = np.vstack([np.full((1, streams), END, flat.dtype), y[:-1]])
    made, losses, room = Adagrad(net, rate), [], Room()
    for _ in range(epochs):
        h, total = np.zeros((streams, net.u.shape[0]), np.float32), []
        for t in range(0, long, steps):
            grads, h, loss = gradients(net, x[t : t + steps], y[t : t + steps], h, room=room)
            made.step(net, grads)
            total.append(loss)
        losses.append(float(np.mean(total)))
    return losses


@dataclass
class Model:
    """The net, the head's words by rank with their counts, and the corpus's totals."""

    net: Net
    head: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    rest_tokens: int
    rest_distinct: int
    ends: int

    def ranks(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.head)}

    def ids(self, ranks: np.ndarray) -> np.ndarray:
        """Vocabulary ids of a text's ranks (-1: not in the head), then the end."""
        out = np.where((ranks >= 0) & (ranks < len(self.net.bo) - 2), ranks + 2, UNKNOWN)
        return np.append(out, END)


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of docs once, as a written table: _rid, doc_id as text, held_out, _h (a hash of id and text), ids (of
    the vocabulary, an end at last), n_tokens, known, base and rest, and the words beyond the head with their counts.

    known, base and rest are the number of known words, the sum of their base scores, and the sum of what known
    words beyond the vocabulary share of the unknown word's probability, all as far as the head tells.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "_h", "ids", "n_tokens", "known", "base", "rest", "tail", "times"]
    schema = "doc_id string, held_out boolean, _h long, ids binary, n_tokens long, known long, base double, rest double, tail array<string>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        head, own = pa.array([w.decode("utf-8", "surrogatepass") for w in m.head], pa.string()), np.log10(m.counts + 1)
        vocab = len(m.net.bo) - 2
        base_of, rest_of = np.log10(m.tokens + m.distinct + 1), np.log10(m.rest_tokens + m.rest_distinct + 1)
        end_base = np.log10(m.ends + 1) - base_of
        # by rank, and at last of words beyond the head
        values = np.append(np.where(np.arange(len(own)) < vocab, np.arange(len(own)) + 2, UNKNOWN), UNKNOWN).astype(np.uint16)
        bases, rests = np.append(own, 0.0), np.append(np.where(np.arange(len(own)) < vocab, 0.0, own), 0.0)

        def of(piece: pa.RecordBatch) -> pa.RecordBatch:
            words, sizes = split_words(piece.column("text"))
            docs, rows = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
            rank = pc.fill_null(pc.index_in(words, value_set=head), len(own)).to_numpy(zero_copy_only=False)
            each = lambda weights: np.bincount(rows, weights, docs)
            beyond = rank == len(own)
            missing = np.bincount(rows[beyond], minlength=docs)
            far = np.bincount(rows[rank >= vocab], minlength=docs)
            ends = np.cumsum(sizes + 1)
            ids = np.full(len(rank) + docs, END, np.uint16)
            ids[np.arange(len(rank)) + rows] = values[rank]
            tail = words.filter(pa.array(beyond)).dictionary_encode()
            pair, times = np.unique(rows[beyond] * np.int64(max(1, len(tail.dictionary))) + tail.indices.to_numpy(zero_copy_only=False), return_counts=True)
            who, code = np.divmod(pair, max(1, len(tail.dictionary)))
            cuts = pa.array(np.searchsorted(who, np.arange(docs + 1)).astype(np.int32))
            columns = [
                piece.column("doc_id"), piece.column("held_out"), piece.column("_h"),
                pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer((2 * np.append(0, ends)).astype(np.int32)), pa.py_buffer(ids)]),
                pa.array(sizes + 1), pa.array(sizes - missing + (m.ends > 0)), pa.array(each(bases[rank]) - base_of * sizes + end_base), pa.array(each(rests[rank]) - rest_of * far),
                pa.ListArray.from_arrays(cuts, tail.dictionary.take(pa.array(code))), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for piece in pieces(batch):
                yield of(piece)

    h = F.xxhash64(F.lit(2), "doc_id", "text")
    return numbered(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "held_out", h.alias("_h"), "text").mapInArrow(run, schema), "_rid", "encoded")


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint16).astype(np.int64)


def first_rows(rows: DataFrame, n: int, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """_h, ids of about sample_docs of n rows by their hash, never more than twice as many: equal ones count once, and
    texts of more than SAMPLE_TOKENS tokens, which no driver should hold by the thousand, are left to the groups."""
    some = rows.filter((F.pmod("_h", F.lit(max(1, -(-n // sample_docs)))) == 0) & (F.length("ids") <= 2 * SAMPLE_TOKENS))
    return some.groupBy("_h").agg(F.min("ids").alias("ids")).orderBy("_h").limit(2 * sample_docs)


def repeats_dropped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of a task, equal ones once, so that a row that repeats often sends a group no more than one a task."""
    seen: set[tuple[int, int]] = set()
    for pdf in batches:
        fresh = []
        for pair in zip(pdf["once"].tolist(), pdf["_h"].tolist(), strict=True):
            fresh.append(pair not in seen)
            seen.add(pair)
        yield pdf[fresh]


def learn(model: Model, encoded: DataFrame, sample_docs: int = SAMPLE_DOCS, epochs: int = 3, group_tokens: int = GROUP_TOKENS) -> None:
    """Train model's net in place on the rows of encode() that are not held out.

    About sample_docs of them, by hash, are the driver's first fit. Then every one of them is in one group
    by its hash (rows without an id are dealt by their number); a group trains from the same start in the
    order of the hashes, and the groups' nets are averaged by their tokens in the order of the groups, in
    as many levels as there are. Rows that repeat an id and a text teach once.
    """
    rows = encoded.filter(~F.col("held_out"))
    have = rows.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).first()
    if not have["n"]:
        return
    some = first_rows(rows, have["n"], sample_docs).collect()
    train(model.net, [_ids(r["ids"]) for r in sorted(some, key=lambda r: (r["_h"], r["ids"]))], epochs)
    groups = -(-int(have["tokens"]) // group_tokens)
    start, schema = encoded.sparkSession.sparkContext.broadcast(model.net), "chunk int, g long, w double, v binary"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        """A group's net after its documents, in chunks, with the number of its tokens."""
        net, g = start.value.with_flat(start.value.flat()), int(pdf["g"].iloc[0])
        ids = [_ids(raw) for raw in pdf.drop_duplicates(["once", "_h", "ids"]).sort_values(["_h", "ids"])["ids"]]
        train(net, ids, rate=RATE, streams=WIDE)
        parts = np.array_split(net.flat(), _CHUNKS)
        return pd.DataFrame({"chunk": range(_CHUNKS), "g": g, "w": float(sum(map(len, ids))), "v": [p.tobytes() for p in parts]})

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g")
        w = float(pdf["w"].sum())
        total = sum(w * np.frombuffer(v, np.float32).astype(np.float64) for w, v in zip(pdf["w"], pdf["v"], strict=True))
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "g": [int(pdf["g"].iloc[0]) >> 8], "w": [w], "v": [(total / w).astype(np.float32).tobytes()]})

    key = F.when(F.col("doc_id").isNull(), F.xxhash64("_rid")).otherwise(F.xxhash64("_h"))
    own = F.when(F.col("doc_id").isNull(), F.col("_rid")).otherwise(-1)
    dealt = rows.select(F.pmod(key, F.lit(groups)).cast("int").alias("g"), own.alias("once"), "_h", "ids").mapInPandas(repeats_dropped, "g int, once long, _h long, ids binary")
    nets = dealt.groupBy("g").applyInPandas(one, schema)
    while groups > 256:
        nets, groups = nets.groupBy("chunk", F.shiftright("g", 8)).applyInPandas(mean, schema), -(-groups // 256)
    parts = nets.groupBy("chunk").applyInPandas(mean, schema).collect()
    model.net = model.net.with_flat(np.concatenate([np.frombuffer(r["v"], np.float32) for r in sorted(parts, key=lambda r: r["chunk"])]))
    start.unpersist()


def count(docs: DataFrame, vocabulary: int = VOCABULARY, head: int = HEAD, seed: int = 2) -> tuple[Model, DataFrame]:
    """A model that is not trained yet, and the written table (word, n) of all training counts, the end not among them."""
    counts = spill(count_words(docs), "words")
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_docs = docs.count()
    top = sorted(commonest(counts, head).collect(), key=lambda r: (-r["n"], r["word"]))
    vocab_counts = np.array([r["n"] for r in top[: vocabulary - 2]], float)
    rest_tokens = int(totals["n"] or 0) - int(vocab_counts.sum())
    rest_distinct = int(totals["v"]) - len(vocab_counts)
    size = -(-(len(vocab_counts) + 2) // CLASS) * CLASS
    start = np.concatenate([[rest_tokens, n_docs], vocab_counts, np.zeros(size - 2 - len(vocab_counts))])
    model = Model(
        new_net(start, seed=seed), [r["word"].encode("utf-8", "surrogatepass") for r in top], np.array([r["n"] for r in top], float),
        int(totals["n"] or 0) + n_docs, int(totals["v"]) + (n_docs > 0), rest_tokens, rest_distinct, n_docs,
    )
    return model, counts


def fit(docs: DataFrame, vocabulary: int = VOCABULARY, head: int = HEAD, sample_docs: int = SAMPLE_DOCS, epochs: int = 3, seed: int = 2) -> tuple[Model, DataFrame]:
    """The trained model and the table (word, n) of all training counts, the end not among them.

    docs are the training documents: every one is counted and trained on. Null texts are empty: an end each.
    Without any document the net stays at its start.
    """
    model, counts = count(docs, vocabulary, head, seed)
    encoded = encode(docs.withColumn("held_out", F.lit(False)), model)
    learn(model, encoded, sample_docs, epochs)
    discard(encoded)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    docs needs doc_id, text and held_out. Null and empty texts are an end alone. Rows are numbered in the
    encoded table, so repeated rows and null ids each have their own result; an empty table gives an empty one.
    """
    return score_encoded(encode(docs, model), model, counts)


def score_encoded(encoded: DataFrame, model: Model, counts: DataFrame, tokens_at_once: int = 6_000_000) -> DataFrame:
    """The same for rows of encode()."""
    sent = encoded.sparkSession.sparkContext.broadcast(model.net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rids, held, size = [], [], 0
        for pdf in batches:
            for rid, raw in zip(pdf["_rid"].tolist(), pdf["ids"], strict=True):
                rids.append(rid)
                held.append(np.frombuffer(raw, np.uint16))
                size += len(held[-1])
                if size > tokens_at_once:
                    yield pd.DataFrame({"_rid": rids, "lp": log_prob(sent.value, held) / np.log(10)})
                    rids, held, size = [], [], 0
        if rids:
            yield pd.DataFrame({"_rid": rids, "lp": log_prob(sent.value, held) / np.log(10)})

    lp = spill(encoded.select("_rid", "ids").mapInPandas(run, "_rid long, lp double"), "scores")
    out = based(encoded, model, counts).join(lp, "_rid")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", (F.col("lp") + F.col("rest") + F.col("more")).alias("score"))


def based(encoded: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """_rid, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, and rest and more for the score, of rows of
    encode(): what the counts alone tell. Words beyond the head meet their counts in a join: none of them is hot,
    since a word outside the head has at most 1/HEAD of all tokens."""
    tail = encoded.filter(F.size("tail") > 0).select("_rid", F.inline(F.arrays_zip("tail", "times")))
    met = tail.join(counts.select(F.col("word").alias("tail"), F.col("n").alias("c")).hint("shuffle_hash"), "tail")
    found = met.groupBy("_rid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("also"))
    out = encoded.select("_rid", "doc_id", "held_out", "n_tokens", "known", "base", "rest").join(found, "_rid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "_rid", F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), "rest", more.alias("more"),
    )


def counted(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """A model of the rows that are not held out, not trained yet, their counts, and one encoding of all rows."""
    model, counts = count(docs.filter(~F.col("held_out")))
    encoded = encode(docs, model)
    release(docs.sparkSession)
    return model, counts, encoded


def fit_and_score(docs: DataFrame) -> DataFrame:
    """score() of all rows of docs by a model of those that are not held out, over one encoding of them all."""
    model, counts, encoded = counted(docs)
    learn(model, encoded)
    release(docs.sparkSession)
    return score_encoded(encoded, model, counts)


def base_scores(docs: DataFrame) -> DataFrame:
    """The columns of fit_and_score() that the counts alone give, by its steps without the net."""
    model, counts, encoded = counted(docs)
    return based(encoded, model, counts).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")


def held_out_rows(docs: DataFrame, of: int = 7, remainder: int = 2) -> DataFrame:
    """docs with held_out: crc32 of the id as text has this remainder."""
    return docs.select("doc_id", "text", (fold(of) == remainder).alias("held_out"))
