"""Secret scan: fixed patterns, and a character convolutional network over every candidate.

The base findings are three patterns (assigned values, access keys, hex digests); they always
stay. Beyond them, every run of 12 or more key characters is a candidate, long words too; a
run of over 40 characters is read through a window of 40 that moves by 20 from its first to
its last character, each place a candidate. A small convolutional network reads it with its
surrounding characters. It learns from labelled
findings: candidates inside base findings are secrets, the others aren't; some of the
secrets are drawn anew in other alphabets, some of the rest in capitals, and the text before or after is masked at times,
so that it learns what values look like, not only what stands around them. It begins on a
sample; then every task trains it on over all of its findings but the held-out ones (a quarter, by hash),
and the tasks' parameters are averaged. A candidate's
score is the lesser of that with its context and that without. The threshold is set on
all held-out findings, by a table of their scores: no higher than finds RECALL of the secrets, else as high as keeps all but
1 - PRECISION of the rest away. Candidates from there on that no base finding overlaps are
added as kind 'model', overlapping ones as one span.
"""

from __future__ import annotations

import copy
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import averaged, drop_shared, one_thread, pieces, write_shared

#: The base patterns, by kind in the order of the listing, with the group that must be long enough.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)
KINDS = tuple(k for k, *_ in PATTERNS)
#: hex as a search for long runs only: the same matches, since each is a whole run.
_HEX = re.compile(r"[0-9a-f]{16,}")
#: What an assigned value's name holds, in lower case.
_WORDS = ("passw", "secret", "token", "api_key", "apikey")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
MODEL_KIND = "model"

CONTEXT, VALUE = 16, 40
LENGTH = 2 * CONTEXT + VALUE
EMBED, WIDTH, FILTERS, HIDDEN = 6, 5, 24, 12
STEPS, BATCH, RATE = 500, 64, 0.005
_ALPHABET = np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
_ALNUM = np.isin(np.arange(256), _ALPHABET)
#: The network begins on so many distinct candidates of each label at most, those with the least hashes;
#: from there on it learns from all, TASK_FINDINGS of a task at a time.
SAMPLE = 4000
TASK_FINDINGS, TASK_BATCH, TASK_RATE = 20_000, 128, 0.001
#: A task counts copies of a candidate once as long as it knows so many candidates.
KNOWN = 500_000
#: One of so many candidates is held out, by hash.
FOLDS = 4
#: Steps of the logit by which scores are tabled, and its bound.
STEP, BOUND = 0.01, 30
#: Candidates of whole texts that are scored together.
AT_ONCE = 20_000
RECALL, PRECISION, LEAST = 0.98, 0.999, 0.9


def _runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text)]


def base_spans(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, code points, by start and then kind as listed. runs: of key characters, if known."""
    found = []
    lower = text.lower()
    if any(word in lower for word in _WORDS):
        for kind, pattern, group, least in PATTERNS[:1]:
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    if "AKIA" in text:
        for kind, pattern, group, least in PATTERNS[1:2]:
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    for start, end in _runs(text) if runs is None else runs:  # a long hex run is inside one
        if end - start >= PATTERNS[2][3]:
            found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text, start, end)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Runs of 12 or more key characters; of longer ones than VALUE all places of the window."""
    found = []
    for start, end in _runs(text) if runs is None else runs:
        if end - start <= VALUE:
            found.append((start, end))
        else:
            found += [(at, at + VALUE) for at in (*range(start, end - VALUE, VALUE // 2), end - VALUE)]
    return found


class _Covered:
    """Whether a span meets one of the given ones (sorted by start), by search in their union."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end, _ in spans:
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def __call__(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at < len(self.ends) and self.starts[at] < end


def encode(text: str, start: int, end: int) -> np.ndarray:
    """The candidate's characters between those around it, as bytes; beyond Latin-1 as 1, beyond
    the text as 0."""
    value = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start].rjust(CONTEXT, "\0"), text[end : end + CONTEXT].ljust(CONTEXT, "\0")
    whole = before + value.ljust(VALUE, "\0") + after
    try:
        return np.frombuffer(whole.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.array([c if c < 256 else 1 for c in map(ord, whole)], np.uint8)


class SecretModel:
    """Embedding, one convolution, maximum over places, one hidden layer; and a threshold."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "embed": rng.standard_normal((256, EMBED)).astype(np.float32), "filters": draw(WIDTH * EMBED, FILTERS), "bias": np.zeros(FILTERS, np.float32),
            "hidden": draw(FILTERS, HIDDEN), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN, 1), "out_bias": np.zeros(1, np.float32),
        }
        self.threshold = 2.0  # nothing is added until it is trained

    def _forward(self, x: np.ndarray):
        e = self.p["embed"][x].reshape(len(x), LENGTH * EMBED)
        w = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, ::EMBED])
        z = w @ self.p["filters"]
        at = z.argmax(axis=1)
        raw = np.take_along_axis(z, at[:, None], axis=1)[:, 0] + self.p["bias"]
        a = np.maximum(raw, 0)
        h = np.maximum(a @ self.p["hidden"] + self.p["hidden_bias"], 0)
        return w, at, raw, a, h, (h @ self.p["out"] + self.p["out_bias"])[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The lesser probability of each candidate: in its context, and with it masked."""
        alone = x.copy()
        alone[:, :CONTEXT] = alone[:, CONTEXT + VALUE :] = 1
        return np.minimum(self._score(x), self._score(alone))

    def _score(self, x: np.ndarray) -> np.ndarray:
        parts = [1 / (1 + np.exp(-np.clip(self._forward(x[i : i + 1024])[-1].astype(float), -30, 30))) for i in range(0, len(x), 1024)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> None:
        rng, moments = np.random.default_rng(seed), self.moments()
        by = [np.flatnonzero(y == k) for k in (0, 1)]
        for step in range(1, STEPS + 1):
            i = np.concatenate([rng.choice(b, BATCH // 2) for b in by])
            self._step(x[i], y[i], rng, moments, RATE * (1 - step / (STEPS + 1)))

    def once(self, x: np.ndarray, y: np.ndarray, more: np.ndarray, more_y: np.ndarray, rng, moments) -> None:
        """One pass over x: of each label as many to a batch; the rarer label's come again, and more's of that label with them."""
        by = [rng.permutation(np.flatnonzero(y == k)) for k in (0, 1)]
        rare = int(len(by[1]) <= len(by[0]))
        extra = more[rng.permutation(np.flatnonzero(more_y == rare))]
        often, pool = x[by[1 - rare]], np.concatenate([x[by[rare]], extra])
        half = TASK_BATCH // 2
        for at in range(0, len(often), half):
            a = often[at : at + half]
            b = pool[np.arange(at, at + len(a)) % len(pool)]
            self._step(np.concatenate([a, b]), np.repeat([1 - rare, rare], len(a)), rng, moments, TASK_RATE)

    def moments(self) -> tuple[dict, dict, list[int]]:
        """What Adam keeps, and the number of steps."""
        return {}, {}, [0]

    def _step(self, batch: np.ndarray, y: np.ndarray, rng, moments, rate: float) -> None:
        m, v, steps = moments
        batch = batch.copy()
        for part in (slice(0, CONTEXT), slice(CONTEXT + VALUE, None)):
            batch[rng.random(len(y)) < 0.5, part] = 1
        anew = np.flatnonzero((y == 1) & (rng.random(len(y)) < 0.4))
        value = batch[anew, CONTEXT : CONTEXT + VALUE]
        drawn = _ALPHABET[(rng.random(value.shape) * rng.choice([36, 62], (len(anew), 1))).astype(int)]
        batch[anew, CONTEXT : CONTEXT + VALUE] = np.where(_ALNUM[value], drawn, value)
        loud = np.flatnonzero((y == 0) & (rng.random(len(y)) < 0.3))
        batch[loud] = _UPPER[batch[loud]]
        g = self._gradients(batch, y)
        steps[0] += 1
        for k in g:
            m[k] = 0.9 * m.get(k, 0) + 0.1 * g[k]
            v[k] = 0.99 * v.get(k, 0) + 0.01 * g[k] ** 2
            self.p[k] -= (rate * (m[k] / (1 - 0.9 ** steps[0])) / (np.sqrt(v[k] / (1 - 0.99 ** steps[0])) + 1e-8)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.p.values()])

    def use(self, flat: np.ndarray) -> None:
        """All parameters from one vector like flat()."""
        cuts = np.cumsum([x.size for x in self.p.values()])[:-1]
        self.p = {k: part.reshape(x.shape).astype(np.float32) for (k, x), part in zip(self.p.items(), np.split(flat, cuts), strict=True)}

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, at, raw, a, h, logit = self._forward(x)
        d = ((1 / (1 + np.exp(-logit)) - y) / len(x))[:, None]
        g = {"out": h.T @ d, "out_bias": d.sum(axis=0)}
        dh = (d @ self.p["out"].T) * (h > 0)
        g |= {"hidden": a.T @ dh, "hidden_bias": dh.sum(axis=0)}
        da = (dh @ self.p["hidden"].T) * (raw > 0)
        rows = np.arange(len(x))
        seen = w[rows[:, None], at]  # row, filter, window
        g["filters"] = np.einsum("rf,rfw->wf", da, seen)
        g["bias"] = da.sum(axis=0)
        dx = (da[:, :, None] * self.p["filters"].T[None]).reshape(len(x), FILTERS, WIDTH, EMBED)
        bytes_ = x[rows[:, None, None], at[:, :, None] + np.arange(WIDTH)]
        g["embed"] = np.stack([np.bincount(bytes_.reshape(-1), dx[..., k].reshape(-1), 256) for k in range(EMBED)], axis=1)
        return g

    def calibrate(self, tabled: dict[int, dict[int, int]]) -> None:
        """tabled: of each label, numbers of held-out findings by step of the score."""
        if not all(tabled.get(k) for k in (0, 1)):
            return
        rest, upto = 0, 1 + max(tabled[0])  # the least step with no more than 1 - PRECISION of the rest from there on
        for step in sorted(tabled[0], reverse=True):
            rest += tabled[0][step]
            if rest > (1 - PRECISION) * sum(tabled[0].values()):
                break
            upto = step
        found = 0  # the highest step with RECALL of the secrets from there on
        for step in sorted(tabled[1], reverse=True):
            found += tabled[1][step]
            if found >= RECALL * sum(tabled[1].values()):
                break
        self.threshold = float(min(_score_at(step), max(_score_at(upto), LEAST)))


def _step_of(score: np.ndarray) -> np.ndarray:
    score = np.clip(score, 1e-13, 1 - 1e-13)
    return np.floor(np.clip(np.log(score / (1 - score)), -BOUND, BOUND) / STEP).astype(np.int32)


def _score_at(step: int) -> float:
    """The least score of a step."""
    return 1 / (1 + np.exp(-step * STEP))


def _findings(batches):
    """Of each piece of a task's texts: labels, hashes and bytes of its candidates, each distinct one once (see KNOWN)."""
    known: set[int] = set()
    for batch in pieces(batches, 0):
        labels, hashes, rows = [], [], []
        for text in batch.column(0).to_pylist():
            runs = _runs(text)
            if not runs:
                continue
            covered = _Covered(base_spans(text, runs))
            for start, end in candidates(text, runs):
                x, label = encode(text, start, end).tobytes(), int(covered(start, end))
                h = xxhash.xxh64_intdigest(x) >> 1
                if 2 * h + label not in known:
                    known.add(2 * h + label)
                    labels.append(label), hashes.append(h), rows.append(x)
        if len(known) > KNOWN:
            known.clear()
        if rows:
            yield np.array(labels), np.array(hashes), np.frombuffer(b"".join(rows), np.uint8).reshape(-1, LENGTH)


def _least(batches):
    """Of a task's candidates, those with the least hashes: SAMPLE of each label at most."""
    held: dict[int, dict[int, bytes]] = {0: {}, 1: {}}
    for labels, hashes, x in _findings(batches):
        for label, rows in held.items():
            mine = np.flatnonzero(labels == label)
            mine = mine[np.argsort(hashes[mine])[:SAMPLE]]
            rows |= {int(hashes[i]): x[i].tobytes() for i in mine}
            if len(rows) > SAMPLE:
                held[label] = {h: rows[h] for h in sorted(rows)[:SAMPLE]}
    flat = [(label, h, x) for label, rows in held.items() for h, x in rows.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["label", "h", "x"])


def fit(docs: DataFrame) -> SecretModel:
    """From all documents (text), labelled by the base patterns. Without candidates of both kinds
    the model adds nothing."""
    model = SecretModel()
    texts = docs.filter(F.col("text").isNotNull()).select("text")
    written = write_shared(texts.mapInArrow(_least, "label int, h long, x binary"), "candidates")
    rows = written.groupBy("label", "h").agg(F.min("x").alias("x"))
    parts = [rows.filter(F.col("label") == k).orderBy("h").limit(SAMPLE) for k in (0, 1)]
    chosen = write_shared(parts[0].union(parts[1]), "findings")  # collected at once, every task's least would go to the driver
    found = sorted((bytes(r["x"]), r["label"]) for r in chosen.filter(F.pmod("h", F.lit(FOLDS)) != 0).collect())
    drop_shared(written, chosen)
    if len({y for _, y in found}) < 2:
        return model
    x, y = np.stack([np.frombuffer(r[0], np.uint8) for r in found]), np.array([r[1] for r in found])
    with one_thread():
        model.train(x, y)
    _learn_from_all(texts, model, x, y)
    _calibrate_on_all(texts, model)
    return model


def _learn_from_all(texts: DataFrame, model: SecretModel, sample: np.ndarray, sample_y: np.ndarray) -> None:
    """One round: all findings that aren't held out, each task from the network that the sample gave."""
    held = texts.sparkSession.sparkContext.broadcast((model, sample, sample_y))  # of bounded size: some 600 kB

    def trained(batches):
        (start, more, more_y), waiting, total = held.value, [], 0
        network, rng = copy.deepcopy(start), np.random.default_rng(7)
        moments = network.moments()

        def learn():
            with one_thread():
                network.once(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), more, more_y, rng, moments)
            waiting.clear()

        for labels, hashes, x in _findings(batches):
            own = hashes % FOLDS != 0
            if own.any():
                waiting.append((x[own], labels[own]))
                total += int(own.sum())
            if sum(len(w[1]) for w in waiting) >= TASK_FINDINGS:
                learn()
        if waiting:
            learn()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([network.flat().tobytes()], pa.binary())], ["n", "p"])

    mean = averaged(texts.mapInArrow(trained, "n long, p binary"))
    if mean is not None:
        model.use(mean)


def _calibrate_on_all(texts: DataFrame, model: SecretModel) -> None:
    held = texts.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        sums: Counter = Counter()
        for labels, hashes, x in _findings(batches):
            out = hashes % FOLDS == 0
            if out.any():
                with one_thread():
                    steps = _step_of(held.value.score(x[out]))
                sums.update(zip(labels[out].tolist(), steps.tolist(), strict=True))
        flat = [(*k, n) for k, n in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["label", "step", "n"])

    tabled: dict[int, dict[int, int]] = {}
    counts = texts.mapInArrow(scored, "label int, step int, n long").groupBy("label", "step").agg(F.sum("n").alias("n"))
    for r in counts.collect():  # 2 * BOUND / STEP rows a label at most
        tabled.setdefault(r["label"], {})[r["step"]] = r["n"]
    model.calibrate(tabled)


def find(texts: list[str | None], model: SecretModel) -> list[list[tuple[int, int, str]]]:
    """All spans of each text: the base ones and those that the model adds, by start."""
    runs = [_runs(t or "") for t in texts]
    base = [base_spans(t or "", r) for t, r in zip(texts, runs, strict=True)]
    places, rows = [], []

    def judge():
        score = model.score(np.stack(rows)) if rows else ()
        for (i, start, end), s in zip(places, score, strict=True):
            if s < model.threshold:
                continue
            last = base[i][-1] if base[i] and base[i][-1][2] == MODEL_KIND else None
            if last and start < last[1]:
                base[i][-1] = (last[0], end, MODEL_KIND)
            else:
                base[i].append((start, end, MODEL_KIND))
        places.clear(), rows.clear()

    for i, text in enumerate(texts):
        covered = _Covered(base[i])
        for start, end in candidates(text or "", runs[i]):
            if not covered(start, end):
                places.append((i, start, end))
                rows.append(encode(text, start, end))
        if len(rows) >= AT_ONCE:
            judge()
    judge()
    order = (*KINDS, MODEL_KIND)
    return [sorted(b, key=lambda s: (s[0], order.index(s[2]))) for b in base]


def scan_secrets(docs: DataFrame, model: SecretModel) -> DataFrame:
    """The columns of docs, then secrets: an array of (kind, start, end, value, known), where known
    tells base findings from added ones.

    Null and empty texts have none. An input column secrets is replaced; an empty table gives
    none. Positions count code points, end exclusive.
    """
    docs = docs.drop("secrets")
    kind = "array<struct<kind:string,start:bigint,end:bigint,value:string,known:boolean>>"
    schema = docs.limit(0).withColumn("secrets", F.lit(None).cast(kind)).schema
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: some 20 kB
    width = len(docs.columns)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("known", pa.bool_())]))

    def run(batches):
        for batch in pieces(batches, "text"):
            texts = batch.column("text").to_pylist()
            with one_thread():
                found = find(texts, held.value)
            rows = [[{"kind": k, "start": s, "end": e, "value": t[s:e], "known": k != MODEL_KIND} for s, e, k in spans] for t, spans in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(rows, arrow)], schema.names)

    return docs.mapInArrow(run, schema)
