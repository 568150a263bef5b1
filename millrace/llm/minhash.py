"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped edges.

1. Each text becomes its set of 64-bit hashes of five-word shingles, and a signature of 128
   bins: one hash function deals the shingles to bins, each bin keeps its least; an empty
   bin borrows from the bin that a fixed random order names first (optimal densification).
2. Documents with equal sets form a class; only its smallest doc_id, the representative,
   goes on. Its signature is cut into 25 bands of 5 bins, each band naming a bucket.
3. In a bucket, members are linked to one centre, not with each other: the member that meets
   most others in its buckets. Each member keeps its best centre. Such an edge is confirmed
   on the full sets; confirmed edges give components.
4. Where a bucket's members are still in several components, those outside the largest one
   are compared with it and with each other, in blocks of rows, by bottom-512 sketches that
   are exact for sets of up to 512 shingles. No pair becomes a row but those that the sketches
   can't refute; these are confirmed on the full sets. So a star loses no link between
   members of a bucket, and a bucket of one component and a few strays costs a few times its
   rows.

A pair of similarity 0.85 shares none of 25 buckets with probability 4e-7. A sketch of a
larger set refutes a pair only eight standard deviations below the threshold (6e-16).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, drop_shared, groups, mix64, pieces, word_hashes, write_shared
from .components import connected_components

WORDS = 5
PERCENT = 85
BINS = 128
BANDS, ROWS = 25, 5
SKETCH = 512
#: A sketch of a larger set refutes a pair so many standard deviations below the threshold; inf: never,
#: then every such pair of a bucket's different components is confirmed on full sets.
DEVIATIONS = 8.0
#: Rows of a bucket that are compared with as many others in one group.
BLOCK = 512
#: Ids of documents whose sets are wanted are broadcast up to so many (some 32 MB); beyond, joined.
MAX_BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BORROW = np.stack([_rng.permutation(BINS) for _ in range(BINS)])
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7)
_SALT = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def shingle_sets(column, words: int = WORDS):
    """For each text of an Arrow column, in order: the sorted distinct 64-bit shingle hashes."""
    with np.errstate(over="ignore"):
        for _, data, offsets in blocks(column):
            h, at = word_hashes(data, offsets)
            many = max(0, len(h) - words + 1)
            run = np.full(many, words, dtype=np.uint64) * _ODD[60]
            for j in range(words):
                run += h[j : j + many] * _ODD[j]
            run = mix64(run)
            for i in range(len(offsets) - 1):
                a, b = int(at[i]), int(at[i + 1])
                if b - a >= words:
                    s = np.sort(run[a : b - words + 1])
                    yield s[np.concatenate([[True], s[1:] != s[:-1]])]
                elif b > a:
                    x = np.full(1, b - a, dtype=np.uint64) * _ODD[60]
                    for j in range(b - a):
                        x += h[a + j] * _ODD[j]
                    yield mix64(x)
                else:
                    yield h[:0]


def signature(s: np.ndarray) -> np.ndarray:
    """128 bins from a sorted set that isn't empty."""
    first = np.searchsorted(s, _EDGES)
    end = np.append(first[1:], len(s))
    full = first < end
    sig = s[np.minimum(first, len(s) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        order = _BORROW[empty]
        sig[empty] = sig[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return sig


def bucket_keys(s: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        bands = signature(s)[: BANDS * ROWS].reshape(BANDS, ROWS)
        return mix64((bands * _ODD[10 : 10 + ROWS]).sum(axis=1, dtype=np.uint64) ^ _SALT)


def _signatures(batches):
    for batch in batches:
        n, one, two, keys = [], [], [], []
        with np.errstate(over="ignore"):
            for s in shingle_sets(batch.column(1)):
                n.append(len(s))
                one.append((s * _ODD[20]).sum(dtype=np.uint64))
                two.append(np.bitwise_xor.reduce(mix64(s ^ _ODD[21])) if len(s) else np.uint64(0))
                keys.append(bucket_keys(s) if len(s) else s)
        flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)), lists], ["doc_id", "n", "s1", "s2", "bands"])


def _sets(batches):
    """The whole set, and the bottom-k sketch: the upper 32 bits of its least hashes."""
    for batch in pieces(batches, 1):
        full, short, keys = [], [], []
        for s in shingle_sets(batch.column(1)):
            full.append(s.tobytes())
            short.append((s[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes())
            keys.append(bucket_keys(s).tobytes() if len(s) else b"")
        made = [batch.column(0), *(pa.array(x, pa.binary()) for x in (full, short, keys))]
        yield pa.RecordBatch.from_arrays(made, ["id", "shingles", "sketch", "bands"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    def run(batches):
        for batch in pieces(batches, "y", 1 << 24):
            last, centre, keep = None, None, []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x = x.as_py()
                if x != last:
                    last, centre = x, np.frombuffer(x, np.uint64)
                keep.append(similar(centre, np.frombuffer(y.as_py(), np.uint64), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of edges (a: centre, b: member): those whose sets are similar."""
    centre = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    member = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = edges.select("a", "b").join(centre, "a").join(member, "b").select("a", "b", "x", "y")
    return both.mapInArrow(_confirm(percent), "a long, b long")


def _left(buckets: DataFrame, components: DataFrame) -> DataFrame:
    """Rows of buckets whose members are in several components: key, band, id, n, comp; stray: outside
    the bucket's largest component; and how many blocks its rows and the strays make."""
    named = buckets.join(components, buckets["id"] == components["cid"], "left")
    named = named.select("key", "band", "id", "n", F.coalesce("comp", "id").alias("comp"))
    sizes = named.groupBy("key", "comp").agg(F.count("*").alias("rows"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("rows", "comp")).alias("main"), F.sum("rows").alias("rows"))
    strays = F.col("rows") - F.col("main.rows")
    blocks_of = lambda rows: F.ceil(rows / BLOCK).cast("int")
    mixed = mixed.filter(strays > 0).select("key", F.col("main.comp").alias("main"), blocks_of(F.col("main.rows")).alias("blocks"), blocks_of(strays).alias("strays"))
    return named.join(mixed, "key").withColumn("stray", F.col("comp") != F.col("main"))


def _refute(group, percent: int) -> list[tuple[int, int]]:
    """Of two blocks of one bucket's rows (i: strays, j: strays, or from -1 downwards the largest
    component's): the pairs across components that sketches can't refute."""
    i, j, own = (group.column(k)[0].as_py() for k in ("i", "j", "band"))
    ids, comp, block, n = (group.column(k).to_numpy() for k in ("id", "comp", "block", "n"))
    bands = np.frombuffer(b"".join(group.column("bands").to_pylist()), np.uint64).reshape(len(ids), BANDS)
    parts = [np.frombuffer(x, np.uint32) for x in group.column("sketch").to_pylist()]
    sizes = np.array([len(x) for x in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flat = np.concatenate(parts)
    places = last = mark = None
    found = []
    for x in range(len(ids)):
        # each pair once: from the first block's row to the second's, in the first bucket that both share
        if block[x] != i:
            continue
        other = (block == j) & (comp != comp[x])
        if i == j:
            other &= ids > ids[x]
        other &= np.minimum(n, n[x]) * 100 >= np.maximum(n, n[x]) * percent
        if not other.any():
            continue
        other &= (bands == bands[x]).argmax(axis=1) == own
        if not other.any():
            continue
        if places is None:
            values, places = np.unique(flat, return_inverse=True)
            mark = np.zeros(len(values), bool)
            last = np.where(n > SKETCH, np.array([p[-1] for p in parts]), np.uint32(0xFFFFFFFF))
        mine = places[starts[x] : starts[x] + sizes[x]]
        mark[mine] = True
        both = np.add.reduceat(mark[places].astype(np.int32), starts)
        mark[mine] = False
        theirs = np.add.reduceat((flat <= last[x]).astype(np.int32), starts)
        ours = np.searchsorted(parts[x], last, side="right")
        seen = np.maximum(ours + theirs - both, 1)
        level = percent / 100
        slack = np.where(np.maximum(n, n[x]) <= SKETCH, 0, DEVIATIONS * np.sqrt(level * (1 - level) / seen)) + 1e-9
        found += [(min(ids[x], ids[y]), max(ids[x], ids[y])) for y in np.flatnonzero(other & (both / seen >= level - slack))]
    return found


def _open_pairs(percent: int):
    def run(batches):
        found = []
        for group in groups(batches, ("key", "i", "j")):
            found += _refute(group, percent)
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        yield _pairs(found)

    return run


def _pairs(found) -> pa.RecordBatch:
    f = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy())], ["a", "b"])


def _across(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs to confirm, each bucket's rows dealt in blocks; a group has two blocks at most."""
    block = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    # strays meet every block of strays, and every block of the rest (-1, -2, ...); the rest meets the strays' blocks
    of_strays, of_rest = F.sequence(F.lit(0), F.col("strays") - 1), F.sequence(F.lit(-1), -F.col("blocks"), F.lit(-1))
    rows = left.withColumn("block", F.when(F.col("stray"), block(F.col("strays"))).otherwise(-1 - block(F.col("blocks"))))
    rows = rows.withColumn("o", F.explode(F.when(F.col("stray"), F.concat(of_strays, of_rest)).otherwise(of_strays)))
    rows = rows.withColumn("i", F.when((F.col("block") >= 0) & (F.col("o") >= 0), F.least("block", "o")).otherwise(F.greatest("block", "o")))
    rows = rows.withColumn("j", F.when((F.col("block") >= 0) & (F.col("o") >= 0), F.greatest("block", "o")).otherwise(F.least("block", "o")))
    rows = rows.select("key", "band", "id", "n", "comp", "block", "i", "j")
    rows = rows.join(sets.select("id", "sketch", "bands"), "id")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return rows.mapInArrow(_open_pairs(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| of their shingle sets;
    component_id is the smallest doc_id reached by links. Fewer than five words: the whole
    sequence is the one shingle. Null, empty or blank text: n_shingles 0, linked with
    nothing. Null doc_id: linked with nothing, component_id null, kept. Rows with one doc_id
    stand for one document. Empty table: empty result. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = write_shared(texts.mapInArrow(_signatures, "doc_id long, n long, s1 long, s2 long, bands array<long>"), "signed")
    valid = signed.filter("n > 0 and doc_id is not null")
    classes = write_shared(valid.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    first = valid.join(classes.withColumnRenamed("rep", "doc_id"), ["s1", "s2", "doc_id"], "left_semi")
    rows = first.select(F.col("doc_id").alias("id"), "n", F.posexplode("bands").alias("band", "key"))
    sized = rows.groupBy("key").agg(F.count("*").alias("met"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
    buckets = write_shared(rows.join(sized.select("key", "met"), "key"), "buckets")
    wanted = buckets.groupBy("id").agg(F.sum("met").alias("rank"))
    wanted = write_shared(wanted, "wanted")
    few = wanted.count() <= MAX_BROADCAST_IDS
    only = F.broadcast(wanted.select("id")) if few else wanted.select("id")
    found = texts.join(only, texts["doc_id"] == only["id"], "left_semi").mapInArrow(_sets, "id long, shingles binary, sketch binary, bands binary")
    sets = write_shared(found, "sets")

    ranked = buckets.join(wanted, "id")
    centres = ranked.groupBy("key").agg(F.max(F.struct("rank", (-F.col("id")).alias("c"))).alias("centre"))
    edges = ranked.join(centres, "key").groupBy(F.col("id").alias("b")).agg(F.max("centre").alias("x"))
    edges = edges.select((-F.col("x.c")).alias("a"), "b").filter("a <> b")
    links = write_shared(_confirmed(edges, sets, percent), "links")
    components = connected_components(links).select(F.col("id").alias("cid"), F.col("component").alias("comp"))
    components = write_shared(components, "components")
    more = write_shared(_across(_left(buckets, components), sets, percent), "edges")
    more = write_shared(_confirmed(more, sets, percent), "links")
    if more.limit(1).count():
        components = connected_components(links.union(more)).select(F.col("id").alias("cid"), F.col("component").alias("comp"))
    drop_shared(buckets, wanted, sets, links, more)
    named = classes.join(components, classes["rep"] == components["cid"], "left").select("s1", "s2", F.coalesce("comp", "rep").alias("comp"))
    held = signed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("s1")).alias("s1"), "s2")
    out = held.join(named, (held["s1"] == named["s1"]) & (held["s2"] == named["s2"]) & held["doc_id"].isNotNull(), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
