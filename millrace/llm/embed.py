"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, reranking.

1. Equal vectors form a class; one of them goes on. Vectors of different lengths are never
   compared: each length has codes of its own.
2. On a sample of a length's vectors, principal axes and then a rotation are learned so that
   the signs of the rotated coordinates, as bits, lose least (iterative quantisation). More
   rotations, from other starts, lengthen the code until pairs of exactly the threshold,
   made from the sample, meet in some table with a probability of RECALL.
3. The code is cut into substrings, each the key of one Hamming table. Their width is the
   logarithm of the number of vectors, so that a bucket's expected size doesn't grow with
   it. Vectors that share a bucket of any table are compared by their original components,
   in double precision: buckets of few rows many at a time, others in blocks of rows. A pair
   that shares several buckets counts in the first only. What comes out is each vector's
   number of links and a forest of its links, so rows grow with the buckets' rows, not with
   their squares.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_shared, group_runs, one_thread, write_shared
from .components import connected_components

COSINE = 0.95
#: Bits of one rotation, and rotations, at most.
BITS, ROTATIONS = 64, 64
#: Bits of a key: the logarithm of the number of vectors, within these.
NARROW, WIDE = 10, 60
#: Probability that a pair of exactly the threshold's cosine shares a bucket, as measured on the sample.
RECALL = 0.98
#: Axes and rotations are learned on about so many vectors in all, by hash of the vector; all are indexed.
SAMPLE, PAIRS = 20_000, 2_000
#: Codes are learned for the most frequent lengths, up to so many and so many components in all
#: (32 MB, broadcast); vectors of the others get random rotations, which need no table.
LENGTHS, COMPONENTS = 32, 16_384
ITERATIONS = 40
BLOCK = 512
#: Buckets of up to so many rows are compared many at a time.
FEW = 48
_RANGE = 1 << 30
_PAIRS_AT_ONCE = 1 << 16


@dataclass
class Quantiser:
    mean: np.ndarray
    axes: list[np.ndarray]  # one for each rotation: dimensions x bits
    width: int

    def tables(self) -> int:
        return max(1, len(self.axes) * self.axes[0].shape[1] // self.width)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """One key of width bits for each table, for each row."""
        x = unit - self.mean
        bits = np.concatenate([x @ a > 0 for a in self.axes], axis=1)
        out = np.zeros((len(unit), self.tables()), np.int64)
        for k in range(out.shape[1]):
            part = bits[:, k * self.width : (k + 1) * self.width]
            out[:, k] = part @ (np.int64(1) << np.arange(part.shape[1], dtype=np.int64))
        return out


def width_for(n: int) -> int:
    return int(np.clip(np.ceil(np.log2(max(n, 2))), NARROW, WIDE))


def _turned(v: np.ndarray, bits: int, rng) -> np.ndarray:
    """A rotation of v's columns after which signs lose least."""
    r, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    for _ in range(ITERATIONS):
        b = np.where(v @ r > 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(b.T @ v)
        r = (u @ w).T
    return r


def _partners(unit: np.ndarray, cosine: float, rng) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of exactly that cosine: moved in any direction, and towards another of the vectors."""
    x = unit[rng.integers(len(unit), size=PAIRS)]
    out = []
    for u in (rng.standard_normal(x.shape), unit[rng.integers(len(unit), size=PAIRS)] + 1e-3 * rng.standard_normal(x.shape)):
        u = u - (u * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(u, axis=1, keepdims=True)
        u = np.where(size > 1e-9, u / np.maximum(size, 1e-9), 0)
        out.append((x, cosine * x + np.sqrt(1 - cosine**2) * u))
    return out


def learn(unit: np.ndarray, n: int, cosine: float = COSINE, seed: int = 1) -> Quantiser:
    """From unit vectors, one row each, for an index of n."""
    rng = np.random.default_rng(seed)
    mean = unit.mean(axis=0)
    x = unit - mean
    bits = min(BITS, x.shape[1])
    _, vectors = np.linalg.eigh(x.T @ x)
    top = vectors[:, ::-1][:, :bits]
    v, pairs = x @ top, _partners(unit, min(cosine, 1.0), rng)
    q = Quantiser(mean, [], width_for(n))
    while len(q.axes) < ROTATIONS:
        q.axes.append(top @ _turned(v, bits, rng))
        if len(q.axes) * bits >= q.width and min((q.keys(a) == q.keys(b)).any(axis=1).mean() for a, b in pairs) >= RECALL:
            break
    return q


def unlearned(dims: int, n: int, cosine: float = COSINE) -> Quantiser:
    """Random rotations, as many as the angle asks for."""
    rng, bits, width = np.random.default_rng(dims), min(BITS, dims), width_for(n)
    meet = (1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi) ** width
    tables = np.log(1 - RECALL) / np.log1p(-min(meet, 1 - 1e-9))
    axes = [np.linalg.qr(rng.standard_normal((dims, bits)))[0] for _ in range(int(np.clip(np.ceil(tables * width / bits), 1, ROTATIONS)))]
    return Quantiser(np.zeros(dims), axes, width)


def unit_rows(flat: bytes, dims: int, kind: str) -> np.ndarray:
    x = np.frombuffer(flat, kind).reshape(-1, dims).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(kind: str):
    """vec_id, dims and bytes of a vector, its hash; dims null for those that link with nothing."""

    def run(batches):
        for batch in batches:
            dims, data, one, two = [], [], [], []
            for v, i in zip(batch.column(1), batch.column(0), strict=True):
                x = None
                if i.is_valid and v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(kind)
                    x = x + 0.0  # -0.0 is 0.0
                if x is None or not np.isfinite(x).all() or not x.any():
                    dims.append(None), data.append(None), one.append(None), two.append(None)
                    continue
                h = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64)
                dims.append(len(x)), data.append(x.tobytes()), one.append(int(h[0])), two.append(int(h[1]))
            made = [batch.column(0), *(pa.array(c, t) for c, t in ((dims, pa.int32()), (data, pa.binary()), (one, pa.int64()), (two, pa.int64())))]
            yield pa.RecordBatch.from_arrays(made, ["vec_id", "dims", "vec", "h1", "h2"])

    return run


def _near(unit: np.ndarray, x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    parts = [np.einsum("ij,ij->i", unit[x[k : k + _PAIRS_AT_ONCE]], unit[y[k : k + _PAIRS_AT_ONCE]]) for k in range(0, len(x), _PAIRS_AT_ONCE)]
    return np.concatenate(parts) >= cosine if parts else np.zeros(0, bool)


def _pairs_of(run, starts: np.ndarray, unit: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows x and y of linked pairs, each within one of the groups that begin at starts."""
    i, j, block = (run.column(k).to_numpy() for k in ("i", "j", "block"))
    sizes = np.diff(np.append(starts, len(i)))
    few = (sizes <= FEW) & (i[starts] == j[starts])
    rows = np.flatnonzero(np.repeat(few, sizes))
    ends = np.repeat(starts + sizes, sizes)[rows]
    after = ends - rows - 1  # a row meets those behind it in its group
    x = np.repeat(rows, after)
    y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(after) - after, after)
    near = _near(unit, x, y, cosine)
    xs, ys = [x[near]], [y[near]]
    for k in np.flatnonzero(~few):
        own = np.arange(starts[k], starts[k] + sizes[k])
        a, b = own[block[own] == i[own]], own[block[own] == j[own]]
        x, y = np.nonzero(unit[a] @ unit[b].T >= cosine)
        x, y = a[x], b[y]
        keep = x < y if i[starts[k]] == j[starts[k]] else np.ones(len(x), bool)
        xs.append(x[keep]), ys.append(y[keep])
    return np.concatenate(xs), np.concatenate(ys)


def _linked(run, starts: np.ndarray, dims: int, kind: str, cosine: float):
    """Of groups of one length: rows (id, links, of): links to count, and of: an id that it is linked with by some path."""
    ids, size, table = (run.column(k).to_numpy() for k in ("id", "size", "table"))
    keys = np.frombuffer(b"".join(run.column("keys").to_pylist()), np.int64).reshape(len(ids), -1)
    unit = unit_rows(b"".join(run.column("vec").to_pylist()), dims, kind)
    x, y = _pairs_of(run, starts, unit, cosine)
    first = (keys[x] == keys[y]).argmax(axis=1) == table[x] if len(x) else np.zeros(0, bool)
    x, y = x[first], y[first]
    links = np.bincount(x, size[y], len(ids)) + np.bincount(y, size[x], len(ids))
    root = np.arange(len(ids))
    while True:  # least row reached, by pointer jumping
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            break
        root = low
    some = np.flatnonzero(links > 0)
    return [pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[root[some]])]


def _links(kind: str, cosine: float):
    def run(batches):
        for found, starts in group_runs(batches, ("dims", "table", "key", "i", "j")):
            of = found.column("dims").to_numpy()
            cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(of)), strict=True):
                own = starts[(starts >= a) & (starts < b)] - a
                with one_thread():
                    yield pa.RecordBatch.from_arrays(_linked(found.slice(a, b - a), own, int(of[a]), kind, cosine), ["id", "links", "of"])

    return run


def _learned(valid: DataFrame, kind: str, cosine: float) -> tuple[dict[int, Quantiser], int]:
    """Codes of the most frequent lengths, and the number of vectors of all lengths."""
    sizes, total, some, room = {}, 0, F.lit(False), COMPONENTS
    often = valid.groupBy("dims").agg(F.count("*").alias("n"))
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    for r in often.orderBy(F.desc("n"), "dims").limit(LENGTHS).collect():
        if r["dims"] <= room:
            sizes[r["dims"]], room = r["n"], room - r["dims"]
    for dims, n in sizes.items():
        bound = min(_RANGE, SAMPLE // len(sizes) * _RANGE // n)
        some = some | ((F.col("dims") == dims) & (F.pmod(F.xxhash64("h1"), F.lit(_RANGE)) < bound))
    held: dict[int, list[bytes]] = {}
    for r in valid.filter(some).select("dims", "vec").collect():
        held.setdefault(r["dims"], []).append(bytes(r["vec"]))
    with one_thread():
        return {d: learn(unit_rows(b"".join(sorted(v)), d, kind), sizes[d], cosine) for d, v in held.items()}, total


def near_vectors(vectors: DataFrame, *, cosine: float = COSINE) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links join vectors of one length of cosine >= cosine. Vectors that are null, empty, zero or
    hold a null or a value that isn't finite link with nothing. Equal vectors are linked with
    each other and count one by one. A null vec_id links with nothing. Rows that repeat a
    vec_id count as vectors of their own. Empty table: empty result; other columns are ignored.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    given = vectors.select(F.col("vec_id").cast("long"), "embedding")
    if kind == "<f8":
        given = given.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = given.mapInArrow(_valid(kind), "vec_id long, dims int, vec binary, h1 long, h2 long")
    rows = write_shared(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    valid = rows.filter("dims is not null")
    learned, total = _learned(valid, kind, cosine)
    held = rows.sparkSession.sparkContext.broadcast(learned)

    def keys(batches):
        codes = dict(held.value)
        for batch in batches:
            of, vec = batch.column("dims").to_numpy(), batch.column("vec")
            found: list = [None] * len(of)
            for d in map(int, np.unique(of)):
                if d not in codes:
                    codes = {**held.value, d: unlearned(d, total, cosine)}
                at = np.flatnonzero(of == d)
                with one_thread():
                    k = codes[d].keys(unit_rows(b"".join(vec.take(pa.array(at)).to_pylist()), d, kind))
                for i, x in zip(at, k, strict=True):
                    found[i] = x
            ends = np.cumsum([0, *(len(x) for x in found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in found], pa.binary()), lists], ["id", "size", "dims", "vec", "keys", "list"])

    # a class is named by its first row
    classes = write_shared(valid.groupBy("h1", "h2").agg(F.min("row").alias("id"), F.count("*").alias("size"), F.min("vec_id").alias("least")), "classes")
    first = valid.join(classes.select("id", "size"), valid["row"] == classes["id"]).select("id", "size", "dims", "vec")
    coded = write_shared(first.mapInArrow(keys, "id long, size long, dims int, vec binary, keys binary, list array<long>"), "codes")
    bucket = ["dims", "table", "key"]
    places = coded.select("id", "dims", F.posexplode("list").alias("table", "key"))
    met = places.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1")
    places = places.join(met, bucket).select(*bucket, "id", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    places = places.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    places = places.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    places = places.withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o"))
    dealt = places.join(coded.select("id", "size", "vec", "keys"), "id")
    order = [*bucket, "i", "j"]
    dealt = dealt.select(*order, "block", "id", "size", "vec", "keys").repartition(*order).sortWithinPartitions(*order, "id")
    links = write_shared(dealt.mapInArrow(_links(kind, cosine), "id long, links long, of long"), "links")
    drop_shared(coded)
    components = connected_components(links.select("id", "of")).withColumnRenamed("id", "cid")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "id", "left").join(components, F.col("id") == F.col("cid"), "left").withColumn("component", F.coalesce("component", "id"))
    named = write_shared(named.select("h1", "h2", "component", "least", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n")), "named")
    drop_shared(classes, links)
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    mine = rows.select("vec_id", "h1", "h2").join(named.join(smallest, "component").select("h1", "h2", "n", "smallest"), ["h1", "h2"], "left")
    out = mine.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("smallest", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
