"""Language-model scoring: a gated recurrent network over words, in numpy.

Words (A-Z lower-cased) and an end for each text are counted over all training documents.
The most frequent ones are the network's vocabulary; all others share one entry, inside
which a word has its smoothed share of their counts. The network predicts a word in two
steps, first its class, then the word within it (class-factored softmax). It learns by
truncated backpropagation: gradients reach back one window, the state goes on. For scoring,
documents run side by side in lanes, window by window, each with its state carried from its
first word to its end, so that a score is the log-likelihood of the complete document.
It begins on a sample; then every task trains it on over all of its training documents, and
the tasks' parameters are averaged, so that what it learns from grows with the corpus. For
learning only, long texts are cut into parts that run side by side.

Counts of the most frequent words travel to every task, up to HOT_WORDS of them; all rarer
words are joined with the table of counts, so that no word is dropped.
"""

from __future__ import annotations

import copy
import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, averaged, blocks, one_thread, pieces, write_shared

END = "\n"  # no word holds white space
#: Words whose counts every task holds, at most (some 30 MB a worker).
HOT_WORDS = 200_000
VOCABULARY = 8192
HIDDEN, EMBED = 48, 24
#: The network begins on whole training documents of about so many tokens in all, by hash of the id;
#: from there on it learns from all training documents.
SAMPLE_TOKENS = 600_000
#: Every task trains a network of its own over its documents, SHARD_TOKENS at a time; networks are averaged by tokens.
SHARD_TOKENS, SHARD_LANES, SHARD_RATE = 1_500_000, 384, 0.006
#: Averages of networks that go to the driver, at most (some 3 MB each).
SUMS, FAN_IN = 4, 64
EPOCHS, LANES, WINDOW, RATE = 2, 48, 32, 0.004
#: For learning, a longer text is cut into parts of so many words that run side by side; scoring cuts none.
PART = 2048
#: Scoring reads windows of so many places: one long text leaves few lanes, and then windows are longer.
SCORE_LANES, SCORE_PLACES = 256, 16_384
#: Levels of counts (16 for each doubling), and parts of the level at the cut, by hash.
_LEVELS, _PARTS = 16, 4096
#: Tokens of whole documents that a task gathers before it scores them.
SCORE_TOKENS = 3_000_000
#: Bytes of words that are looked up together; and of those that are counted together.
_WORDS, _COUNTED = 1 << 22, 1 << 24
_RANGE = 1 << 30
#: Rows of the softmax over classes, and parameters, that are worked on together; sums of which exp needs no shift.
_ROWS, _BLOCK, _SAFE = 2048, 16_384, 60.0
_OTHER, _END = 0, 1


def words_of(column, size: int = _WORDS):
    """Of an Arrow column of texts: runs of rows, as their words (an Arrow array, A-Z lower-cased, one row's after
    another's), and where each row's begin (with the end). A null has none."""
    for _, data, offsets in blocks(column, size):
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        rows = offsets[:-1][offsets[:-1] < len(data)]
        first[rows] = inside[rows]
        starts, kept = np.flatnonzero(first), _LOWER[data[inside]]
        at = np.append(np.cumsum(inside, dtype=np.int64)[starts] - 1, len(kept))
        parts = [None, pa.py_buffer(at), pa.py_buffer(kept)]
        yield pa.Array.from_buffers(pa.large_binary(), len(starts), parts), np.searchsorted(starts, offsets)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class WordNetwork:
    """Input table, gated recurrent layer, softmax over classes and over a class's words."""

    def __init__(self, counts: np.ndarray, seed: int = 1):
        """counts: of the vocabulary's entries, in the order of their numbers."""
        rng = np.random.default_rng(seed)
        self._classes(_class_starts(counts))
        held, k = counts + 0.5, len(self.first) - 1
        mass = np.add.reduceat(held, self.first[:-1])
        draw = lambda scale, *s: rng.standard_normal(s) * scale
        made = {
            "embed": draw(0.3, len(held), EMBED), "w": draw(EMBED**-0.5, EMBED, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN),
            "u": draw(HIDDEN**-0.5, HIDDEN, 3 * HIDDEN), "c": draw(0.05, HIDDEN, k), "cb": np.log(mass / mass.sum()),
            "o": draw(0.05, len(held), HIDDEN), "ob": np.log(held / mass[self.of]),
        }
        self.shapes = {name: x.shape for name, x in made.items()}
        self.use(np.concatenate([x.reshape(-1) for x in made.values()]).astype(np.float32))

    def use(self, flat: np.ndarray) -> None:
        """All parameters as one vector; p holds views of it."""
        self.flat, self.p, self.spaces, self.near = flat, self._views(flat), {}, None

    def _space(self, name: str, *shape: int) -> np.ndarray:
        """An array for intermediate values, the same memory each time: new memory costs as much as the products."""
        n = math.prod(shape)
        if len(self.spaces.get(name, ())) < n or self.spaces[name].dtype != self.flat.dtype:
            self.spaces[name] = np.empty(n, self.flat.dtype)
        return self.spaces[name][:n].reshape(shape)

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        at, views = 0, {}
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            views[name] = flat[at : at + n].reshape(shape)
            at += n
        return views

    def _classes(self, first: np.ndarray) -> None:
        """first: where classes begin, and the end; of: each entry's class."""
        self.first, self.of = first, np.repeat(np.arange(len(first) - 1, dtype=np.min_scalar_type(len(first))), np.diff(first))

    def __getstate__(self):
        return self.shapes, self.first, self.flat

    def __setstate__(self, state):
        self.shapes, first, flat = state
        self._classes(first)
        self.use(flat.copy())

    def step(self, x: np.ndarray, h: np.ndarray):
        """The layer written plainly, lanes as rows; x: the input's part of the gates. Returns the new
        state and the gates. _forward does the same for a window."""
        g = h @ self.p["u"]
        zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r, q = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * q)
        return n + z * (h - n), (z, r, q, n)

    def _table(self, words: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The input's part of the gates for each of words, bias included: gate after gate, a row for each word."""
        embed = self.p["embed"][words]
        made = np.empty((3, len(embed), HIDDEN), embed.dtype)
        np.matmul(embed, _by_gate(self.p["w"]), out=made)
        made += self.p["b"].reshape(3, 1, HIDDEN)
        np.negative(made[:2], out=made[:2])  # as 1 / (1 + exp(-sum)) needs them
        return made.reshape(-1, HIDDEN)

    def _forward(self, x: np.ndarray, starts: np.ndarray, h: np.ndarray, keep: bool, table: np.ndarray | None = None):
        """x, starts: time by lane; h: unit by lane; table: of the words that x numbers, all if not given. The states by
        time, unit and lane (rows in memory, a lane's units side by side); and, where kept, what backpropagation needs,
        lanes as rows, each gate a block of memory. Both in memory that the next call uses again."""
        (times, lanes), table = x.shape, self._table() if table is None else table
        slots = times if keep else 1
        gates, n = self._space("gates", slots, 3, lanes, HIDDEN), self._space("n", slots, lanes, HIDDEN)
        states, inputs = self._space("states", times + 1, lanes, HIDDEN), self._space("inputs", 3, lanes, HIDDEN)
        at = x[:, None].astype(np.intp) + np.arange(0, len(table), len(table) // 3)[:, None]
        inner = _by_gate(self.p["u"])
        np.negative(inner[:2], out=inner[:2])
        states[0], fresh = h.T, starts.any(axis=1)
        for t in range(times):
            g, m, s, h = gates[t % slots], n[t % slots], states[t + 1], states[t]
            if fresh[t]:
                h = np.where(starts[t][:, None], 0, h)
            np.matmul(h, inner, out=g)
            table.take(at[t], axis=0, out=inputs, mode="clip")
            a = g[:2]
            a += inputs[:2]
            np.exp(a, out=a)
            a += 1
            np.reciprocal(a, out=a)
            np.multiply(g[1], g[2], out=m)
            m += inputs[2]
            np.tanh(m, out=m)
            np.subtract(h, m, out=s)
            s *= g[0]
            s += m
        return states[1:].transpose(0, 2, 1), (states[:-1], gates, n)

    def _near(self) -> tuple[float, np.ndarray]:
        """How large a state's units may be so that exp of no sum overflows or vanishes: of classes, and of words by class."""

        def limit(weights, bias):
            return (_SAFE - np.abs(bias)) / np.maximum(np.abs(weights, out=self._space("sizes", *weights.shape)) @ np.ones(HIDDEN, bias.dtype), 1e-9)

        p = self.p
        return float(limit(p["c"].T, p["cb"]).min()), np.minimum.reduceat(limit(p["o"], p["ob"]), self.first[:-1])

    def log_probability(self, h: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Natural log of each target's probability after state h; with grads (zeros), also d(-mean)/dh."""
        p, k, classes = self.p, HIDDEN, len(self.first) - 1
        cls = self.of[target]
        order, sizes = np.argsort(cls, kind="stable"), np.bincount(cls, minlength=classes)  # by class: its words' part is one product
        cuts, cls, rows = np.append(0, np.cumsum(sizes)), np.repeat(np.arange(classes), sizes), np.arange(len(order))
        at = target[order] - self.first[cls]
        hs, dh = np.take(h, order, axis=0, out=self._space("hs", len(order), k), mode="clip"), self._space("dh", len(order), k)
        out = np.empty(len(hs), hs.dtype)
        reach = max(1.0, float(hs.max()), -float(hs.min())) if len(hs) else 1.0
        classes_near, words_near = self.near or self._near()
        classes_near, words_near = reach < classes_near, reach < words_near
        at += rows * np.diff(self.first)[cls]  # in the sums of all places of the class
        at -= np.take(cuts[:-1] * np.diff(self.first), cls)
        chosen, share = rows[:_ROWS] * classes, 1 / max(1, len(hs))
        turned, ones = np.ascontiguousarray(p["c"].T), np.ones(max(classes, int(np.diff(self.first).max())), hs.dtype)
        for a in range(0, len(hs), _ROWS):
            own = hs[a : a + _ROWS]
            e = np.matmul(own, p["c"], out=self._space("e", len(own), classes))
            e += p["cb"]
            out[a : a + _ROWS], inverse = _softmax(e, chosen[: len(own)] + cls[a : a + _ROWS], classes_near, ones, grads is not None)
            if grads is not None:
                inverse *= share
                grads["c"] += np.multiply(own, inverse[:, None], out=self._space("own", *own.shape)).T @ e
                grads["cb"] += inverse @ e
                np.matmul(e, turned, out=dh[a : a + _ROWS])
                dh[a : a + _ROWS] *= inverse[:, None]
        for i in np.flatnonzero((sizes > 0) & (np.diff(self.first) > 1)):
            a, b, words = cuts[i], cuts[i + 1], slice(self.first[i], self.first[i + 1])
            own = hs[a:b]
            z = np.matmul(own, p["o"][words].T, out=self._space("z", b - a, words.stop - words.start))
            z += p["ob"][words]
            logs, inverse = _softmax(z, at[a:b], words_near[i], ones, grads is not None)
            out[a:b] += logs
            if grads is not None:
                inverse *= share
                np.matmul(z.T, np.multiply(own, inverse[:, None], out=self._space("own", *own.shape)), out=grads["o"][words])
                np.matmul(inverse, z, out=grads["ob"][words])
                back = z @ p["o"][words]
                back *= inverse[:, None]
                dh[a:b] += back
        logs = np.empty_like(out)
        logs[order] = out
        if grads is None:
            return logs, None
        by_row = self._space("by_row", len(hs), k)
        by_row[order] = dh
        return logs, by_row

    def train(self, docs: list[np.ndarray], seed: int = 2) -> None:
        """docs: numbers of the words, without the end. State goes on between windows; a new document starts at 0."""
        moments = self.moments()
        for epoch in range(EPOCHS):
            rng = np.random.default_rng(seed + epoch)
            shuffled = [docs[i] for i in rng.permutation(len(docs))]
            self.once(shuffled, LANES, moments, lambda at, epoch=epoch: RATE * (1 - 0.9 * (epoch + at) / EPOCHS))

    def moments(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """What Adam keeps: two vectors, and the number of steps."""
        return np.zeros_like(self.flat), np.zeros_like(self.flat), [0]

    def once(self, docs: list[np.ndarray], lanes: int, moments, rate_at) -> None:
        """One pass; moments go on from call to call, rate_at: by the share of docs read."""
        m, v, steps = moments
        inputs, targets, _, starts = in_lanes([part for d in docs for part in _parts(d)], lanes)
        h = np.zeros((inputs.shape[1], HIDDEN), self.flat.dtype)
        for t in range(0, len(inputs), WINDOW):
            x, y, s = inputs[t : t + WINDOW], targets[t : t + WINDOW], starts[t : t + WINDOW]
            g, h = self._gradients(x, y, s, h)
            steps[0] += 1
            rate = rate_at(t / len(inputs)) * min(1, steps[0] / 50)
            self._adam(g, m, v, steps[0], rate)

    def _adam(self, gradient: np.ndarray, moment: np.ndarray, square: np.ndarray, step: int, rate: float) -> None:
        """gradient is used up; moment and square are sums, not yet times 0.1 and 0.001. In blocks that stay in a core's cache."""
        shrunk = min(1, 1 / max(float(np.sqrt(gradient @ gradient)), 1e-9))
        root = math.sqrt(0.001 / (1 - 0.999**step))
        for at in range(0, len(gradient), _BLOCK):
            g, m, v = gradient[at : at + _BLOCK], moment[at : at + _BLOCK], square[at : at + _BLOCK]
            if shrunk < 1:
                g *= shrunk
            m *= 0.9
            m += g
            v *= 0.999
            g *= g
            v += g
            np.sqrt(v, out=g)
            g += 1e-7 / root
            np.divide(m, g, out=g)
            g *= rate * 0.1 / (1 - 0.9**step) / root
            self.flat[at : at + _BLOCK] -= g

    def _gradients(self, x, y, starts, h):
        """Of the mean loss of a window, as one vector like flat; and the state after it."""
        p, k = self.p, HIDDEN
        times, lanes = x.shape
        flat = self._space("gradient", len(self.flat))
        flat[:] = 0
        g = self._views(flat)
        words = x.reshape(-1).astype(np.min_scalar_type(len(self.of)))  # two bytes are sorted by their digits
        order = np.argsort(words, kind="stable")
        words = words[order]
        new = np.append(True, words[1:] != words[:-1])
        first, place = np.flatnonzero(new), np.empty(len(words), np.intp)
        words, place[order] = words[first], np.cumsum(new) - 1  # only the words of this window are looked up
        place = place.reshape(x.shape)
        states, (before, gates, n) = self._forward(place, starts, h.T, True, self._table(words))
        live = y >= 0
        d = self.log_probability(self._rows(states, live), y[live], g)[1]
        if len(d) < y.size:
            some, d = d, self._space("all", y.size, k)
            d[:] = 0
            d[live.reshape(-1)] = some
        d = d.reshape(times, lanes, k)
        inputs, de = np.ones((len(words), EMBED + 1), d.dtype), self._space("de", times, lanes, EMBED)
        inputs[:, :EMBED] = p["embed"][words]
        part, room = self._space("part", 4, lanes, k), self._space("room", 3, lanes, k)
        given, by_gate = self._space("given", lanes, EMBED + 1), self._space("by_gate", 3, lanes, EMBED)
        dn, dz, dr, dq = part  # the sums of w's gates in the order n, z, r; of u's in the order z, r, n
        back, w, u = np.zeros((lanes, k), d.dtype), _by_gate(p["w"])[[2, 0, 1]].transpose(0, 2, 1).copy(), _by_gate(p["u"]).transpose(0, 2, 1).copy()
        gw, gu = np.zeros((3, EMBED + 1, k), d.dtype), np.zeros((3, k, k), d.dtype)
        fresh = starts.any(axis=1)
        for t in range(times - 1, -1, -1):
            (z, r, q), dh, was = gates[t], d[t], before[t]
            if fresh[t]:
                was = np.where(starts[t][:, None], 0, was)
            dh += back
            np.multiply(dh, z, out=back)
            np.subtract(dh, back, out=dn)  # dh * (1 - z)
            np.subtract(was, n[t], out=dz)
            dz *= z
            dz *= dn
            np.multiply(n[t], n[t], out=dq)
            np.subtract(1, dq, out=dq)
            dn *= dq
            np.multiply(dn, r, out=dq)
            np.subtract(1, r, out=dr)
            dr *= dq
            dr *= q
            np.matmul(part[1:], u, out=room)
            for summand in room:
                back += summand
            np.matmul(part[:3], w, out=by_gate)
            np.add(by_gate[0], by_gate[1], out=de[t])
            de[t] += by_gate[2]
            gu += was.T @ part[1:]
            gw += inputs.take(place[t], axis=0, out=given, mode="clip").T @ part[:3]
            if fresh[t]:
                back[starts[t]] = 0
        for at, i in enumerate((2, 0, 1)):
            gate = slice(i * k, i * k + k)
            g["w"][:, gate], g["b"][gate], g["u"][:, at * k : at * k + k] = gw[at, :EMBED], gw[at, EMBED], gu[at]
        g["embed"][words] = np.add.reduceat(de.reshape(-1, EMBED)[order], first, axis=0)
        return flat, states[-1].T.copy()

    def _rows(self, states: np.ndarray, live: np.ndarray) -> np.ndarray:
        """States of live places, each a row."""
        rows = states.transpose(0, 2, 1).reshape(-1, HIDDEN)
        return rows if live.all() else rows[live.reshape(-1)]

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Log10 of the probability of each whole document's entries and its end."""
        if not docs:
            return np.zeros(0)
        inputs, targets, owner, starts = in_lanes([_whole(d) for d in docs], SCORE_LANES)
        h, total = np.zeros((HIDDEN, inputs.shape[1]), np.float32), np.zeros(len(docs))
        size, table, self.near = max(1, SCORE_PLACES // inputs.shape[1]), self._table(), self._near()
        for t in range(0, len(inputs), size):
            window = slice(t, t + size)
            states, _ = self._forward(inputs[window], starts[window], h, False, table)
            y, of, h = targets[window], owner[window], states[-1].copy()
            live = y >= 0
            logs, _ = self.log_probability(self._rows(states, live), y[live])
            total += np.bincount(of[live], logs, len(docs))
        self.near = None  # parameters may change now
        return total / np.log(10)


def _by_gate(x: np.ndarray) -> np.ndarray:
    """Columns of the three gates as three matrices."""
    return np.ascontiguousarray(x.reshape(len(x), 3, HIDDEN).transpose(1, 0, 2))


def _softmax(e: np.ndarray, chosen: np.ndarray, near: bool, ones: np.ndarray, learning: bool):
    """Of sums e: the log probability of each row's chosen place (its number in all of e), and 1 / total of the
    exponentials. Learning, e is left as the gradient of -log, times total. near: no exponential overflows."""
    if not near:
        e -= e.max(axis=1, keepdims=True)
    flat = e.reshape(-1)
    out = flat.take(chosen)
    np.exp(e, out=e)
    total = e @ ones[: e.shape[1]]
    out -= np.log(total)
    if learning:
        flat[chosen] -= total
    return out, 1 / total


def _class_starts(counts: np.ndarray) -> np.ndarray:
    """Where the classes begin, and the end: the first (words outside the vocabulary) is a class of its own; of the
    others, one that begins with a share p of all tokens has 1 / sqrt(p) entries. A token costs a column for each class
    and for each entry of its own class; of classes of neighbours in the order of counts, these make it about the least."""
    at, n, total = [0], len(counts), counts.sum() + 1
    while at[-1] < n:
        size = round(math.sqrt(total / (counts[at[-1] : at[-1] + 2].max() + 0.5))) if at[-1] else 1  # the end comes before more frequent words
        at.append(min(n, at[-1] + max(1, size)))
    return np.array(at)


def _whole(doc: np.ndarray) -> np.ndarray:
    """The end before the first word (what the first is predicted from), the words, the end."""
    return np.concatenate([[_END], doc, [_END]]).astype(np.int32)


def _parts(doc: np.ndarray) -> list[np.ndarray]:
    """The same in parts of PART predictions; a part begins with the word before its first."""
    full = _whole(doc)
    return [full[i : i + PART + 1] for i in range(0, len(full) - 1, PART)]


def in_lanes(runs: list[np.ndarray], most: int):
    """Runs one after another in lanes of like length: inputs, targets (-1: none), owner, starts; time by lane.

    Of a run, every entry but the first is predicted from those before it.
    """
    sizes = np.array([len(r) - 1 for r in runs])
    lanes = int(np.clip(sizes.sum() // sizes.max(), 1, most))
    ends = [(0, i) for i in range(lanes)]
    places = np.zeros((len(runs), 2), int)
    for r in np.argsort(-sizes, kind="stable"):  # the longest first, each into the shortest lane
        at, lane = heapq.heappop(ends)
        places[r] = at, lane
        heapq.heappush(ends, (at + int(sizes[r]), lane))
    t = max(e for e, _ in ends)
    inputs, targets = np.full((t, lanes), _END, np.int32), np.full((t, lanes), -1, np.int32)
    owner, starts = np.zeros((t, lanes), np.int32), np.zeros((t, lanes), bool)
    for i, r in enumerate(runs):
        at, lane = places[i]
        inputs[at : at + len(r) - 1, lane] = r[:-1]
        targets[at : at + len(r) - 1, lane] = r[1:]
        owner[at : at + len(r) - 1, lane] = i
        starts[at, lane] = True
    return inputs, targets, owner, starts


@dataclass
class LanguageModel:
    counts: DataFrame  # (word, n) of all training words, the end among them
    total: int
    distinct: int
    places: pa.Array  # hot words, the most frequent first
    hot: np.ndarray  # their counts
    entries: np.ndarray  # their vocabulary numbers; _OTHER for those outside
    end: int  # count of the end
    network: WordNetwork | None
    other: tuple[int, int]  # tokens and distinct words outside the vocabulary

    def base(self, c):
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def within(self, c):
        """Of a word outside the vocabulary, given that it is outside."""
        return np.log10((c + 0.5) / (self.other[0] + 0.5 * (self.other[1] + 1)))

    def spread(self) -> LanguageModel:
        """Without what tasks don't need."""
        return LanguageModel(None, self.total, self.distinct, self.places, self.hot, self.entries, self.end, self.network, self.other)


def _count(batches):
    held, size, texts = [], 0, 0

    def out():
        found = pc.value_counts(pa.concat_arrays(held)) if held else None
        words, counts = (found.field(0), found.field(1)) if held else (pa.array([], pa.large_binary()), pa.array([], pa.int64()))
        return pa.RecordBatch.from_arrays([words.cast(pa.binary()).cast(pa.string()), counts], ["word", "n"])

    for batch in pieces(batches, 0):
        texts += batch.num_rows
        for words, _ in words_of(batch.column(0)):
            held.append(words)
            size += words.buffers()[2].size
            if size > _COUNTED:
                yield out()
                held, size = [], 0
    if held:
        yield out()
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([texts], pa.int64())], ["word", "n"])


def _most_frequent(counts: DataFrame) -> DataFrame:
    """HOT_WORDS of counts (word, n), or nearly so many, with no sort of all: whole levels of like counts
    from the top, and of the level that no longer fits the words in the first parts by hash."""
    level, part = F.floor(F.log2("n") * _LEVELS).cast("int"), F.pmod(F.xxhash64("word"), F.lit(_PARTS))
    sizes = sorted(((r["l"], r["n"]) for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()), reverse=True)
    room, cut = HOT_WORDS, -1
    for at, n in sizes:
        if n > room:
            cut = at
            break
        room -= n
    if cut < 0:
        return counts
    parts, upto = {r["p"]: r["n"] for r in counts.filter(level == cut).groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}, 0
    while upto < _PARTS and parts.get(upto, 0) <= room:
        room -= parts.get(upto, 0)
        upto += 1
    return counts.filter((level > cut) | ((level == cut) & (part < upto)))


def places_of(words: pa.Array, known: pa.Array, none: int) -> np.ndarray:
    """Each word's place among the known ones; none for the others."""
    return pc.fill_null(pc.index_in(words, value_set=known), none).to_numpy(zero_copy_only=False)


def fit(training: DataFrame) -> LanguageModel:
    """From all training documents (doc_id, text); a null text is an empty one."""
    texts = training.select("text").mapInArrow(_count, "word string, n long")
    counts = write_shared(texts.groupBy("word").agg(F.sum("n").alias("n")), "words")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    rows = sorted(((r["word"], r["n"]) for r in _most_frequent(counts).collect()), key=lambda r: (-r[1], r[0]))
    end = next((n for w, n in rows if w == END), None)
    if end is None:
        end = sum(r["n"] for r in counts.filter(F.col("word") == END).collect())
    rows = [r for r in rows if r[0] != END]
    places = pa.array([w.encode("utf-8", "surrogatepass") for w, _ in rows], pa.large_binary())
    hot = np.array([n for _, n in rows], np.int64)
    size = min(len(rows), VOCABULARY - 2)
    entries = np.where(np.arange(len(rows)) < size, np.arange(len(rows)) + 2, _OTHER)
    other = (int(sums["n"] - hot[:size].sum() - end), int(sums["v"] - size - (end > 0)))
    network = WordNetwork(np.concatenate([[other[0], end], hot[:size]]))
    model = LanguageModel(counts, int(sums["n"]), int(sums["v"]), places, hot, entries, end, network, other)
    if sums["n"]:
        bound = min(_RANGE, SAMPLE_TOKENS * _RANGE // sums["n"])
        held = training.sparkSession.sparkContext.broadcast(model.spread())

        def sampled(batches):
            for batch in pieces(batches, 0):
                made = [x.astype(np.int16).tobytes() for x in entries_of(batch.column(0), held.value)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["x"])

        chosen = F.pmod(F.xxhash64(F.lit(3), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(_RANGE)) < bound
        found = sorted(bytes(r["x"]) for r in training.filter(chosen).select("text").mapInArrow(sampled, "x binary").collect())
        if found:
            with one_thread():
                network.train([np.frombuffer(x, np.int16).astype(np.int32) for x in found])
        _learn_from_all(training.select("text"), model)
    return model


def entries_of(column, model: LanguageModel):
    """For each text of an Arrow column: its words' vocabulary numbers."""
    known = model.places.slice(0, int(np.count_nonzero(model.entries != _OTHER)))  # they are numbered from 2 on
    for words, at in words_of(column):
        numbers = places_of(words, known, _OTHER - 2) + 2
        yield from (numbers[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


def _learn_from_all(texts: DataFrame, model: LanguageModel) -> None:
    """One round: all training documents, each task from the network that the sample gave."""
    held = texts.sparkSession.sparkContext.broadcast(model.spread())

    def trained(batches):
        network, docs, size, tokens = copy.deepcopy(held.value.network), [], 0, 0
        moments = network.moments()

        def learn():
            with one_thread():
                network.once(docs, SHARD_LANES, moments, lambda at: SHARD_RATE)

        for batch in pieces(batches, 0):
            for x in entries_of(batch.column(0), held.value):
                docs.append(x)
                size += len(x) + 1
                if size >= SHARD_TOKENS:
                    learn()
                    docs, tokens, size = [], tokens + size, 0
        if docs:
            learn()
            tokens += size
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([network.flat.tobytes()], pa.binary())], ["n", "p"])

    mean = averaged(texts.mapInArrow(trained, "n long, p binary"), SUMS, FAN_IN)
    if mean is not None:
        model.network.use(mean)


def score(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, n_known, base_score, score.

    n_tokens: words and the end; n_known: those with a count; base_score: log10 of the
    product of smoothed shares; score: log10 of the network's probability of the whole text.
    Null and empty texts have the end only. An empty table gives none; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.spread())

    def run(batches):
        m = held.value
        # one more place, the last: of words that aren't hot
        base_log, entries = np.append(m.base(m.hot), 0), np.append(m.entries, _OTHER).astype(np.int32)
        within_log = np.append(np.where(m.entries == _OTHER, m.within(m.hot), 0), 0)
        parts, numbers, tokens = [], [], 0

        def out():
            with one_thread():
                likely = m.network.score(numbers)
            whole = pa.Table.from_batches(parts).combine_chunks()
            whole = whole.set_column(5, "likely", pa.array(likely + whole.column(5).to_numpy()))
            return whole.to_batches()

        for batch in pieces(batches, 2):
            first = 0
            for words, at in words_of(batch.column(2)):
                rows, place = len(at) - 1, places_of(words, m.places, -1)
                of, rare, number = np.repeat(np.arange(rows), np.diff(at)), place < 0, entries[place]
                base, inner = (np.bincount(of, x[place], rows) for x in (base_log, within_log))
                left = np.bincount(of[rare], minlength=rows)
                rest = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(left)), pa.int32()), words.filter(pa.array(rare)).cast(pa.binary()).cast(pa.string()))
                counts = pa.array(np.diff(at) + 1), pa.array(np.diff(at) - left + (m.end > 0))
                head = batch.slice(first, rows)
                parts.append(pa.RecordBatch.from_arrays([head.column(0), head.column(1), *counts, pa.array(base + m.base(m.end)), pa.array(inner), rest], names))
                numbers += [number[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                first, tokens = first + rows, tokens + len(words) + rows
            if tokens >= SCORE_TOKENS:  # enough to fill the lanes
                yield from out()
                parts, numbers, tokens = [], [], 0
        if parts:
            yield from out()

    names = ["row", "doc_id", "n_tokens", "known", "base", "likely", "rest"]
    kind = dict(docs.dtypes)["doc_id"]
    numbered_rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    made = write_shared(numbered_rows.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, known long, base double, likely double, rest array<string>"), "scored")
    rare = made.select("row", F.explode("rest").alias("word")).join(model.counts, "word", "left")
    c = F.coalesce("n", F.lit(0))
    share = lambda tokens, kinds: F.log10((c + 0.5) / F.lit(tokens + 0.5 * (kinds + 1)))
    sums = rare.groupBy("row").agg(F.count("n").alias("more"), F.sum(share(model.total, model.distinct)).alias("b"), F.sum(share(*model.other)).alias("w"))
    out = made.select("row", "doc_id", "n_tokens", "known", "base", "likely").join(sums, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("likely") + F.coalesce("w", zero)).alias("score"),
    )
