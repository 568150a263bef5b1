"""Incremental, reversible line dedup: sharded cuckoo filters over exact reference counts.

State of a LineIndex, all in tables of the shared folder:

* postings (doc_id, h1, h2): which document holds which line key, once each;
* counts (h1, h2, n_docs, keeper): the exact number of documents of a key, and the largest
  doc_id among them;
* filters (shard, room, bits): for each shard of the key space, a cuckoo filter of the keys that
  reach the threshold, and how many it takes at a load of 80 %.

insert() and delete() change all three; a deletion takes fingerprints out of the filters
again, so the index is as if the document had never been there. A shard that outgrows its
filter gets a larger one, made from the counts; as the keys grow, all shards are split in two. A document's lines are
tested against the filters first; only those that pass are joined with the exact counts,
which decide. Keys are 128-bit hashes (xxh3) of the normalised line.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, pieces, write_shared
from .cuckoo import CuckooFilter

MIN_CHARS = 20
MIN_DOCS = 3
#: Keys for each filter shard, about; a filter of so many takes under 1 MB.
KEYS_PER_SHARD = 1 << 17
PACK_ROWS = 100_000
_PACK = np.dtype([("doc_id", "<i8"), ("h1", "<i8"), ("h2", "<i8")])


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit digest of the stripped, A-Z lower-cased line; None if it is too short."""
    key = line.strip(SPACES)
    if len(key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower())


def _postings_of(min_chars: int):
    def run(batches):
        for batch in pieces(batches, 1):
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and doc_id is not None:
                    found = {line_key(x, min_chars) for x in text.split("\n")}
                    found.discard(None)
                    keys += found
                    ids += [doc_id] * len(found)
            h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["doc_id", "h1", "h2"])

    return run


def _pack(shards: int):
    """Postings as blocks of bytes: one for each shard and PACK_ROWS rows of a task."""

    def blocks(parts: list[np.ndarray]):
        rows = np.concatenate([np.zeros(0, _PACK), *parts])
        shard = rows["h1"] & (shards - 1)
        order = np.argsort(shard, kind="stable")
        rows, shard = rows[order], shard[order]
        found, starts = np.unique(shard, return_index=True)
        cut = [x.tobytes() for x in np.split(rows, starts[1:])] if len(rows) else []
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(cut, pa.binary())], ["shard", "block"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            rows = np.empty(batch.num_rows, _PACK)
            for k in ("doc_id", "h1", "h2"):
                rows[k] = batch.column(k).to_numpy()
            held.append(rows)
            n += len(rows)
            if n >= PACK_ROWS:
                yield blocks(held)
                held, n = [], 0
        yield blocks(held)

    return run


def _probe(batches):
    """Of blocks joined with their shard's filter: the postings that the filter lets through."""
    last, now = None, None
    for batch in batches:
        kept = [np.zeros(0, _PACK)]
        for block, bits in zip(batch.column("block"), batch.column("bits"), strict=True):
            bits = bits.as_py()
            if bits != last:
                last, now = bits, CuckooFilter.from_bytes(bits)
            rows = np.frombuffer(block.as_py(), _PACK)
            kept.append(rows[now.contains(rows["h1"] ^ rows["h2"])])
        rows = np.concatenate(kept)
        yield pa.RecordBatch.from_arrays([pa.array(rows[k].copy()) for k in ("doc_id", "h1", "h2")], ["doc_id", "h1", "h2"])


def _build_filter(key, group):
    import pandas as pd

    hashes = group["h1"].to_numpy() ^ group["h2"].to_numpy()
    made = CuckooFilter.of(hashes)
    return pd.DataFrame({"shard": [key[0]], "room": [made.room()], "bits": [made.to_bytes()]})


def _change_filter(key, old, changes):
    """changes: add boolean. Takes away what fell below the threshold, then adds."""
    import pandas as pd

    now = CuckooFilter.from_bytes(old["bits"].iloc[0])
    hashes, add = changes["h1"].to_numpy() ^ changes["h2"].to_numpy(), changes["add"].to_numpy(bool)
    if len(hashes):
        now.delete(hashes[~add])
        now.insert(hashes[add])
    return pd.DataFrame({"shard": [key[0]], "room": [now.room()], "bits": [now.to_bytes()]})


def _shards_for(keys: int) -> int:
    return 1 << max(4, (keys // KEYS_PER_SHARD).bit_length())


def _built(often: DataFrame) -> DataFrame:
    return often.groupBy("shard").applyInPandas(_build_filter, "shard long, room long, bits binary")


def _rewrite(min_chars: int, names: list[str]):
    """Drop the lines whose keys stand in the column drops."""

    def run(batches):
        for batch in pieces(batches, "text"):
            texts, n_lines, n_dropped, digests = [], [], [], []
            for text, drops in zip(batch.column("text").to_pylist(), batch.column("mr_drops").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                kept = lines
                if drops:
                    gone = {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in drops}
                    kept = [x for x in lines if line_key(x, min_chars) not in gone]
                texts.append(text if len(kept) == len(lines) else "\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                digests.append(hashlib.sha256("\n".join(kept).encode("utf-8", "surrogatepass")).hexdigest())
            made = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names)

    return run


class LineIndex:
    """An index of the lines of documents; each change returns a new one."""

    def __init__(self, postings: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, min_docs: int, min_chars: int):
        self.postings, self.counts, self.filters = postings, counts, filters
        self.shards, self.min_docs, self.min_chars = shards, min_docs, min_chars

    @staticmethod
    def _postings(docs: DataFrame, min_chars: int) -> DataFrame:
        made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        return made.mapInArrow(_postings_of(min_chars), "doc_id long, h1 long, h2 long")

    @classmethod
    def build(cls, docs: DataFrame, *, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
        """From documents (doc_id, text). Null ids and null or empty texts add nothing; rows
        that repeat a document's line count once."""
        postings = write_shared(cls._postings(docs, min_chars).distinct(), "postings")
        counts = write_shared(postings.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")), "counts")
        often = counts.filter(F.col("n_docs") >= min_docs)
        shards = _shards_for(often.count())
        often = often.select(F.col("h1").bitwiseAND(shards - 1).alias("shard"), "h1", "h2")
        return cls(postings, counts, write_shared(_built(often), "filters"), shards, min_docs, min_chars)

    def _changed(self, postings: DataFrame, counts: DataFrame) -> LineIndex:
        """With the filters brought from the old counts to the new ones. Those of shards that have more
        keys than room, or had none, are made anew; all of them when there are more shards."""
        is_in, on = F.col("n_docs") >= self.min_docs, ["h1", "h2"]
        before = self.counts.filter(is_in).select(*on)
        after = counts.filter(is_in).select(*on)
        shards = max(self.shards, _shards_for(after.count()))
        often = after.withColumn("shard", F.col("h1").bitwiseAND(shards - 1))
        if shards > self.shards:
            return LineIndex(postings, counts, write_shared(_built(often), "filters"), shards, self.min_docs, self.min_chars)
        sizes = often.groupBy("shard").agg(F.count("*").alias("n")).join(self.filters.select("shard", "room"), "shard", "left")
        grown = write_shared(sizes.filter("room is null or n > room").select("shard"), "grown")
        changes = after.join(before, on, "left_anti").withColumn("add", F.lit(True))
        changes = changes.union(before.join(after, on, "left_anti").withColumn("add", F.lit(False)))
        changes = changes.withColumn("shard", F.col("h1").bitwiseAND(self.shards - 1))
        kept, changes = (t.join(grown, "shard", "left_anti") for t in (self.filters, changes))
        filters = kept.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(_change_filter, "shard long, room long, bits binary")
        filters = filters.select("shard", "room", "bits").union(_built(often.join(grown, "shard", "left_semi")).select("shard", "room", "bits"))
        return LineIndex(postings, counts, write_shared(filters, "filters"), self.shards, self.min_docs, self.min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the lines of more documents; lines already indexed for an id change nothing."""
        key = ["doc_id", "h1", "h2"]
        new = write_shared(self._postings(docs, self.min_chars).distinct().join(self.postings, key, "left_anti"), "new")
        more = new.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        counts = self.counts.select("h1", "h2", "n_docs", "keeper").union(more.select("h1", "h2", "n_docs", "keeper"))
        counts = counts.groupBy("h1", "h2").agg(F.sum("n_docs").cast("long").alias("n_docs"), F.max("keeper").alias("keeper"))
        return self._changed(write_shared(self.postings.union(new), "postings"), write_shared(counts, "counts"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents of column doc_id; ids that aren't indexed change nothing."""
        ids = doc_ids.select("doc_id").distinct()
        gone = self.postings.join(ids, "doc_id", "left_semi")
        left = write_shared(self.postings.join(ids, "doc_id", "left_anti"), "postings")
        touched = write_shared(gone.groupBy("h1", "h2").agg(F.count("*").alias("less")), "touched")
        keepers = left.join(touched, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.max("doc_id").alias("new"))
        same = self.counts.join(touched, ["h1", "h2"], "left_anti").select("h1", "h2", "n_docs", "keeper")
        moved = self.counts.join(touched, ["h1", "h2"]).join(keepers, ["h1", "h2"])
        moved = moved.select("h1", "h2", (F.col("n_docs") - F.col("less")).alias("n_docs"), F.col("new").alias("keeper"))
        return self._changed(left, write_shared(same.union(moved), "counts"))

    def drops(self) -> DataFrame:
        """(doc_id, mr_drops): the keys that an indexed document loses. Filter first, counts after."""
        blocks = self.postings.mapInArrow(_pack(self.shards), "shard long, block binary")
        passed = blocks.join(self.filters.select("shard", "bits"), "shard").mapInArrow(_probe, "doc_id long, h1 long, h2 long")
        exact = self.counts.filter(F.col("n_docs") >= self.min_docs).select("h1", "h2", "keeper")
        lost = passed.join(exact, ["h1", "h2"]).filter(F.col("doc_id") != F.col("keeper"))
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("mr_drops"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """Documents that are indexed, without their repeated lines.

        Returns the columns of docs with text replaced, then n_lines (before), n_dropped and
        kept_sha256 (of the UTF-8 text that stays); input columns of these names are
        replaced. Null text stays null and counts as one empty line; a null doc_id keeps all
        its lines; rows of one doc_id are treated alike; an empty table gives none.
        """
        docs = docs.drop("n_lines", "n_dropped", "kept_sha256", "mr_drops")
        drops = self.drops().withColumnRenamed("doc_id", "mr_id")
        joined = docs.join(drops, docs["doc_id"] == drops["mr_id"], "left").drop("mr_id")
        schema = docs.limit(0).withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long"), "kept_sha256": F.lit("")}).schema
        return joined.mapInArrow(_rewrite(self.min_chars, schema.names), schema)


def dedup_lines(docs: DataFrame, *, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Index the documents and drop from each the lines that at least min_docs documents hold,
    but for the document with the largest id. See LineIndex.apply for the columns."""
    return LineIndex.build(docs, min_docs=min_docs, min_chars=min_chars).apply(docs)
