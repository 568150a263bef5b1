"""Language identification: nearest of several TF-IDF centroids per language, by cosine.

A text, lower-cased and with one space for each run of ASCII characters that aren't letters,
becomes counts of its byte trigrams hashed to 2,048 buckets; logarithm of the counts, times the inverse document frequency, normalised to length 1. Each language
has up to four centroids (spherical k-means over its training vectors). The nearest centroid
gives the language and its cosine the score; a text farther from it than all but one in a
thousand of the training texts of a like length is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces

BUCKETS = 2048
CENTROIDS = 4
#: Centroids are fitted on about so many training rows in all, and per language at most (by
#: hash of the id). Document frequencies and thresholds cover all training rows.
SAMPLE_ROWS = 6000
SAMPLE_PER_LANGUAGE = 1500
#: So many language values at most; more is an error, not a cut.
MAX_LANGUAGES = 2000
#: A threshold is this quantile of the distances of all training texts of a like length, to one
#: of BINS steps, and MOST at most: a text that shares nothing with any centroid is never kept.
QUANTILE, BINS, MOST = 0.999, 1000, 0.999
_RANGE = 1 << 30
_WORD_BYTES = np.arange(256, dtype=np.uint8)
_WORD_BYTES[[i for i in range(128) if not chr(i).isalpha()]] = 32


def counts_of(text: str | None) -> np.ndarray:
    """Hashed byte trigram counts of a whole text; a shorter one has its bytes as one n-gram."""
    data = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    data = _WORD_BYTES[data]
    space = data == 32
    space[1:] &= space[:-1].copy()
    if len(space):
        space[0] = False
    data = data[~space].astype(np.uint32)
    if len(data) < 3:
        data = np.pad(data, (0, 3 - len(data))) if len(data) else data
    if not len(data):
        return np.zeros(BUCKETS, np.int64)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    with np.errstate(over="ignore"):
        return np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(21), minlength=BUCKETS)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # index into languages
    farthest: np.ndarray  # by language and binary logarithm of the number of n-grams

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest centroid's language, and cosine (0 to 1)."""
        cos = self.vectors(counts) @ self.centroids.T
        near = cos.argmax(axis=1)
        return self.owner[near], np.clip(cos[np.arange(len(cos)), near].astype(float), 0, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language or und, cosine (0 to 1), rejected."""
        n = len(texts)
        letters = np.array([has_letter(t) for t in texts], bool)
        if not len(self.languages) or not n:
            return ["und"] * n, np.zeros(n), np.ones(n, bool)
        counts = np.stack([counts_of(t) for t in texts])
        own, score = self.nearest(counts)
        far = 1 - score > self.farthest[own, _length_class(counts)]
        names = [self.languages[o] if ok else "und" for o, ok in zip(own, letters, strict=True)]
        return names, np.where(letters, score, 0.0), far | ~letters


def _length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1), 1)).astype(int), 39)


def _k_means(v: np.ndarray, k: int, rng) -> np.ndarray:
    k = min(k, len(v))
    picked = [int(rng.integers(len(v)))]
    for _ in range(k - 1):  # the first centres lie far apart
        d = np.maximum(1 - (v @ v[picked].T).max(axis=1), 0) ** 2 + 1e-12
        picked.append(int(rng.choice(len(v), p=d / d.sum())))
    c = v[picked]
    for _ in range(12):
        near = (v @ c.T).argmax(axis=1)
        c = np.stack([v[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _frequencies(batches):
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in pieces(batches, 0):
        for text in batch.column(0).to_pylist():
            df += counts_of(text) > 0
            n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.concatenate([[n], df]))], ["bucket", "n"])


def _sampled(batches):
    for batch in pieces(batches, 1):
        rows = [np.minimum(counts_of(t), 2**31 - 1).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["lang", "counts"])


def _thresholds(rows: DataFrame, model: LanguageModel) -> np.ndarray:
    """By language and length class, from the distances of all rows (text): the greater of the
    quantiles of those that the language is nearest to and of all, over the class and those
    beside it. A class without rows has the threshold of the next shorter one, and MOST where
    no row is as short."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def distances(batches):
        for batch in pieces(batches, 0):
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), 512):
                counts = np.stack([counts_of(t) for t in texts[i : i + 512]])
                own, score = held.value.nearest(counts)
                step = np.ceil((1 - score) * BINS).astype(np.int64)
                seen, n = np.unique(np.stack([own, _length_class(counts), step]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (*seen, n)], ["own", "size", "step", "n"])

    steps = rows.select("text").mapInArrow(distances, "own long, size long, step long, n long").groupBy("own", "size", "step").agg(F.sum("n").alias("n"))
    wide = steps.withColumn("own", F.explode(F.array("own", F.lit(-1)))).withColumn("size", F.explode(F.sequence(F.col("size") - 1, F.col("size") + 1)))
    wide = wide.groupBy("own", "size", "step").agg(F.sum("n").alias("n"))
    each = Window.partitionBy("own", "size")
    wide = wide.withColumn("upto", F.sum("n").over(each.orderBy("step"))).withColumn("all", F.sum("n").over(each))
    found = wide.filter(F.col("upto") >= F.col("all") * QUANTILE).groupBy("own", "size").agg(F.min("step").alias("step")).collect()
    at = np.full((len(model.languages) + 1, 40), np.nan)  # the last row: of all languages
    for r in found:
        if 0 <= r["size"] < 40:
            at[r["own"], r["size"]] = r["step"] / BINS
    every = at[-1].copy()
    for b in range(40):
        if np.isnan(every[b]):
            every[b] = every[b - 1] if b else MOST
    return np.minimum(np.fmax(at[:-1], every), MOST)


def fit(training: DataFrame) -> LanguageModel:
    """From rows (doc_id, text, lang); rows with null text or lang, or without a letter, teach nothing."""
    rows = training.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not sizes:
        return LanguageModel([], np.ones(BUCKETS), np.zeros((0, BUCKETS)), np.zeros(0, int), np.ones((1, 40)))
    each = rows.select("text").mapInArrow(_frequencies, "bucket long, n long")
    df = {r["bucket"]: r["n"] for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    idf = np.log((1 + df[-1]) / (1 + np.array([df[b] for b in range(BUCKETS)]))).astype(np.float32) + 1
    bound = min(SAMPLE_PER_LANGUAGE, max(1, SAMPLE_ROWS // len(sizes)))
    limit = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(_RANGE, bound * _RANGE // n))])
    chosen = F.pmod(F.xxhash64(F.lit(5), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(_RANGE)) < limit[F.col("lang")]
    found = rows.filter(chosen).select("lang", "text").mapInArrow(_sampled, "lang string, counts binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["counts"])))  # the order of tasks doesn't matter
    names = sorted({r["lang"] for r in found})
    model = LanguageModel(names, idf, np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.ones((max(1, len(names)), 40)))
    rng, centroids, owner = np.random.default_rng(11), [], []
    for i, lang in enumerate(names):
        counts = np.stack([np.frombuffer(r["counts"], np.int32) for r in found if r["lang"] == lang])
        v = model.vectors(counts)
        c = _k_means(v, CENTROIDS, rng)
        centroids.append(c)
        owner += [i] * len(c)
    if centroids:
        model.centroids, model.owner = np.concatenate(centroids), np.array(owner)
        model.farthest = _thresholds(rows, model)
    return model


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The columns of docs, then lang_pred, score and rejected; input columns of these names are replaced.

    lang_pred: a learned value, or und for a null text or one without a letter (score 0,
    rejected). Score: the cosine with the nearest centroid, 0 to 1; the first of equally near
    centroids counts. rejected: farther than training texts of a like length are, but for one in a thousand. A model
    without languages gives und. Empty table: empty result.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = docs.limit(0).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(False)}).schema
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_LANGUAGES; 8 kB a centroid
    width = len(docs.columns)

    def run(batches):
        for batch in pieces(batches, "text"):
            texts = batch.column("text").to_pylist()
            parts = [held.value.predict(texts[i : i + 512]) for i in range(0, len(texts), 512)]
            names = [x for p in parts for x in p[0]]
            score = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
            away = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(names, pa.string()), pa.array(score), pa.array(away)], schema.names)

    return docs.mapInArrow(run, schema)
