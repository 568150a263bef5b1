"""Document quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte is
embedded; learned filters slide over eight bytes at a time; each filter's largest answer in
a chunk is kept. The chunks' largest, mean and least of these go through one hidden layer to
one probability: the least tells of a chunk that says the same again and again. Training is by gradient descent (Adam) through the places of the maxima.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import one_thread, pieces, write_shared

CHUNK, STEP = 512, 448
WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 2, 4, 48, 24
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1
#: Training takes about so many labelled documents of each label, those with the least hashes of
#: the id, and fewer where their whole texts are more than so many bytes in all. Scoring has no bound.
SAMPLE_PER_LABEL = 1200
SAMPLE_BYTES = 64_000_000
STEPS, BATCH, RATE = 600, 32, 0.004
THRESHOLD = 0.3
_RANGE = 1 << 30
_GROUP = 768


def chunks_of(text: str | None) -> np.ndarray:
    """All chunks of a text, one row each, the last one ending with the text; at least one. A
    text shorter than a chunk is padded with 0."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) < CHUNK:
        data = np.pad(data, (0, CHUNK - len(data)))
    starts = np.append(np.arange(0, len(data) - CHUNK, STEP), len(data) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(data, CHUNK)[starts]


class QualityModel:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "embed": rng.standard_normal((256, EMBED)).astype(np.float32), "filters": draw(WIDTH * EMBED, FILTERS), "bias": np.zeros(FILTERS, np.float32),
            "hidden": draw(3 * FILTERS, HIDDEN), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN, 1), "out_bias": np.zeros(1, np.float32),
        }
        self.shift = 0.0

    def _windows(self, chunks: np.ndarray) -> np.ndarray:
        e = self.p["embed"][chunks].reshape(len(chunks), CHUNK * EMBED)
        view = np.lib.stride_tricks.sliding_window_view(e, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        return np.ascontiguousarray(view).reshape(-1, WIDTH * EMBED)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Each filter's largest answer in each chunk."""
        parts = []
        for i in range(0, len(chunks), _GROUP):
            part = chunks[i : i + _GROUP]
            z = (self._windows(part) @ self.p["filters"]).reshape(len(part), POSITIONS, FILTERS)
            parts.append(z.max(axis=1))
        return np.maximum(np.concatenate(parts) + self.p["bias"], 0)

    def _head(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(f @ self.p["hidden"] + self.p["hidden_bias"], 0)
        return h, (h @ self.p["out"] + self.p["out_bias"])[:, 0]

    @staticmethod
    def _combine(a: np.ndarray, counts: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return np.concatenate([np.maximum.reduceat(a, starts), np.add.reduceat(a, starts) / counts[:, None].astype(a.dtype), np.minimum.reduceat(a, starts)], axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1 for each whole text."""
        if not texts:
            return np.zeros(0)
        out, held, counts = [], [], []
        for i, text in enumerate(texts):
            c = chunks_of(text)
            if len(c) > 4 * _GROUP:  # a very long text is pooled part by part
                a = np.concatenate([self.pooled(c[j : j + _GROUP]) for j in range(0, len(c), _GROUP)])
            else:
                a = None
            held.append((c, a))
            counts.append(len(c))
            if sum(len(x) for x, y in held if y is None) >= _GROUP or i == len(texts) - 1:
                short = [x for x, y in held if y is None]
                made = self.pooled(np.concatenate(short)) if short else None
                rows, at = [], 0
                for x, y in held:
                    if y is None:
                        y, at = made[at : at + len(x)], at + len(x)
                    rows.append(y)
                out.append(self._head(self._combine(np.concatenate(rows), np.array(counts)))[1])
                held, counts = [], []
        z = np.concatenate(out).astype(float) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def train(self, samples: list[tuple[np.ndarray, int]], seed: int = 5) -> None:
        rng, m, v = np.random.default_rng(seed), {}, {}
        for step in range(1, STEPS + 1):
            picked = [samples[i] for i in rng.integers(len(samples), size=BATCH)]
            grads = self._gradients([c for c, _ in picked], np.array([y for _, y in picked], np.float32))
            rate = RATE * min(1, step / 20) * (1 - step / (STEPS + 1))
            for k, g in grads.items():
                m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def _gradients(self, docs: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        p, counts = self.p, np.array([len(c) for c in docs])
        chunks = np.concatenate(docs)
        x = self._windows(chunks)
        z = (x @ p["filters"]).reshape(len(chunks), POSITIONS, FILTERS)
        at = z.argmax(axis=1)
        raw = np.take_along_axis(z, at[:, None], axis=1)[:, 0] + p["bias"]
        a = np.maximum(raw, 0)
        f = self._combine(a, counts)
        h, logit = self._head(f)
        d = ((1 / (1 + np.exp(-logit)) - labels) / len(docs))[:, None]
        g = {"out": h.T @ d, "out_bias": d.sum(axis=0)}
        dh = (d @ p["out"].T) * (h > 0)
        g |= {"hidden": f.T @ dh, "hidden_bias": dh.sum(axis=0)}
        df = dh @ p["hidden"].T
        owner = np.repeat(np.arange(len(docs)), counts)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        da = (df[:, FILTERS : 2 * FILTERS] / counts[:, None])[owner]
        for part in (slice(0, FILTERS), slice(2 * FILTERS, None)):  # equal extremes share what comes back
            own = f[:, part][owner] == a
            da = da + np.where(own, df[:, part][owner] / np.maximum(np.add.reduceat(own.astype(int), starts)[owner], 1), 0)
        da = da * (raw > 0)
        rows = (np.arange(len(chunks))[:, None] * POSITIONS + at).reshape(-1)
        each = np.tile(np.arange(FILTERS), len(chunks))
        flat = da.reshape(-1)
        seen = x[rows]
        g["filters"] = np.stack([flat[each == k] @ seen[each == k] for k in range(FILTERS)], axis=1)
        g["bias"] = da.sum(axis=0)
        dx = (flat[:, None] * p["filters"].T[each]).reshape(len(flat), WIDTH, EMBED)
        first = at.reshape(-1) * STRIDE
        bytes_ = chunks[np.repeat(np.arange(len(chunks)), FILTERS)[:, None], first[:, None] + np.arange(WIDTH)]
        g["embed"] = np.stack([np.bincount(bytes_.reshape(-1), dx[:, :, k].reshape(-1), 256) for k in range(EMBED)], axis=1)
        return g


def _samples(batches):
    for batch in pieces(batches, "text"):
        made = [chunks_of(text).tobytes() for text in batch.column("text").to_pylist()]
        sizes = pa.array([len(x) for x in made], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("draw"), sizes, pa.array(made, pa.binary())], ["label", "draw", "size", "chunks"])


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """docs (doc_id, text) of which labels (doc_id, quality 0 or 1) tell some.

    Null labels and labels without a document teach nothing; of a document's several labels
    the least counts; a null text is an empty one. With one label only, every score is that
    label's; with none, 0.5.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    model = QualityModel()
    if len(sizes) < 2:
        model.p["out"][:] = 0
        model.shift = 30.0 * (2 * next(iter(sizes)) - 1) if sizes else 0.0
        return model
    draw = F.pmod(F.xxhash64(F.lit(9), F.col("doc_id")), F.lit(_RANGE))
    some = F.lit(False)
    for label, n in sizes.items():
        some = some | ((F.col("label") == label) & (draw < min(_RANGE, SAMPLE_PER_LABEL * _RANGE // n)))
    chosen = F.broadcast(known.filter(some).withColumn("draw", draw))  # about 2 * SAMPLE_PER_LABEL rows
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").select("label", "draw", "text")
    found = write_shared(texts.mapInArrow(_samples, "label int, draw long, size long, chunks binary"), "samples")
    so_far = Window.partitionBy("label").orderBy("draw", "chunks").rowsBetween(Window.unboundedPreceding, -1)  # over the sample
    found = found.withColumn("before", F.coalesce(F.sum("size").over(so_far), F.lit(0))).filter(F.col("before") < SAMPLE_BYTES).select("label", "chunks").collect()
    found.sort(key=lambda r: (r["label"], bytes(r["chunks"])))
    samples = [(np.frombuffer(r["chunks"], np.uint8).reshape(-1, CHUNK), r["label"]) for r in found]
    by = {y: [s for s in samples if s[1] == y] for y in (0, 1)}
    if not by[0] or not by[1]:
        return model
    most = max(map(len, by.values()))  # the rarer label is repeated; the shift takes that back
    even = [x for y in (0, 1) for x in (by[y] * (-(-most // len(by[y]))))[:most]]
    with one_thread():
        model.train(even)
    model.shift = float(np.log(sizes[1] / sizes[0]))
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The columns of docs, then score (the probability of label 1) and predicted (1 from
    THRESHOLD on). Null and empty texts are scored as no bytes. Input columns of these two
    names are replaced; an empty table gives none."""
    docs = docs.drop("score", "predicted")
    schema = docs.limit(0).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: some 10 kB
    width = len(docs.columns)

    def run(batches):
        for batch in pieces(batches, "text"):
            with one_thread():
                s = held.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], schema.names)

    return docs.mapInArrow(run, schema)
