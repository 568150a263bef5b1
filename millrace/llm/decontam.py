"""Benchmark decontamination by spaced seeds (DataFrame functions only).

A seed is a mask over a window of tokens: the masked positions must be equal, the others
are ignored. Each mask gives every window of every benchmark item one hash; equal hashes of
a document's windows are hits. A hit fixes how the item would lie over the document, and
there all tokens are compared. The item is found when at least 80 of 100 of its tokens are
equal at their places, or when that is so of RUN tokens of it in a row, all inside the
document: so are a part of a long item, one that the document's end cuts off, and one with
a word put in or left out. No such place is missed: over 15 tokens, and in a run of 13, the
equal ones always have four in a row; from 5 to 15, the four masks leave no arrangement out
(a test tries them all). Of items of 1 to 4 tokens all must be equal, and a mask of just
their length finds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, write_shared

#: The compared offsets of each mask, and of the masks of items of 1, 2, 3 and 4 tokens.
MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4), (0, 1, 2, 4))
SHORT = ((0,), (0, 1), (0, 1, 2), (0, 1, 2, 3))
_ALL = (*MASKS, *SHORT)
#: Percent of an item's tokens, or of a run's, that must be equal; tokens of a run.
PERCENT = 80
RUN = 13
#: Seeds of so many rows, and items of so many tokens in all, are broadcast (some 100 MB at most); beyond, joined by hash.
MAX_BROADCAST_SEEDS = 1_000_000
MAX_BROADCAST_TOKENS = 5_000_000
#: Places to verify (three numbers each) are broadcast to the texts up to so many (some 50 MB); beyond, joined.
MAX_BROADCAST_HITS = 500_000


def tokens(text):
    """64-bit hashes of the words, A-Z lower-cased; an empty array for null."""
    words = F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _key(h, i, mask: int):
    """The hash of one mask's window at position i (from 0); null where the window leaves the text."""
    offsets = _ALL[mask]
    parts = [F.get(h, i + o) for o in offsets]
    return F.when(i + offsets[-1] < F.size(h), F.xxhash64(F.lit(mask), *parts))


def _seeds(items: DataFrame) -> DataFrame:
    """(item_id, j, mask, seed): an item's windows by the masks for its length."""
    at = items.select("item_id", "b", F.explode(F.sequence(F.lit(0), F.size("b") - 1)).alias("j"))
    seeds, n = None, F.size("b")
    for mask in range(len(_ALL)):
        fits = n > len(SHORT) if mask < len(MASKS) else n == len(_ALL[mask])
        of = at.filter(fits).select("item_id", "j", F.lit(mask).alias("mask"), _key(F.col("b"), F.col("j"), mask).alias("seed")).filter("seed is not null")
        seeds = of if seeds is None else seeds.union(of)
    return seeds


def find_passages(docs: DataFrame, benchmark: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_item, n_equal, at): each benchmark item found in a document.

    n_item: the item's tokens; n_equal: the most that are equal in one place where it is found;
    at: the first token position (from 0) of such a place, negative where the document begins
    inside the item. Null or empty texts and items give no rows; a null doc_id or item_id none
    either. Rows with one doc_id (or item_id) are searched one by one and the best place is
    kept. Empty tables give none. Other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").alias("item_id"), tokens(F.col("text")).alias("b"))
    items = write_shared(items.filter(F.col("item_id").isNotNull() & (F.size("b") > 0)), "items")
    seeds = write_shared(_seeds(items), "seeds")
    length = items.agg(F.coalesce(F.sum(F.size("b")), F.lit(0)).alias("t")).first()["t"]
    small = seeds.count() <= MAX_BROADCAST_SEEDS and length <= MAX_BROADCAST_TOKENS
    masks = sorted(r["mask"] for r in seeds.select("mask").distinct().collect())  # of eight at most
    texts = docs.select("doc_id", tokens(F.col("text")).alias("h")).filter(F.col("doc_id").isNotNull() & (F.size("h") > 0))
    windows = texts.select("doc_id", "h", F.explode(F.sequence(F.lit(0), F.size("h") - 1)).alias("i"))
    keys = F.array(*[_key(F.col("h"), F.col("i"), m) for m in masks] or [F.lit(None).cast("long")])
    seen = windows.select("doc_id", "i", F.explode(keys).alias("k")).filter("k is not null")
    if small:  # a seed that many items share meets a window once
        places = seeds.groupBy("seed").agg(F.collect_list(F.struct("item_id", "j")).alias("places"))
        hits = seen.join(F.broadcast(places), seen["k"] == places["seed"]).select("doc_id", "i", F.inline("places"))
    else:
        hits = seen.join(seeds, seen["k"] == seeds["seed"])
    # token arrays stay where they are: hits are narrow, each place once; texts with hits are read again
    hits = write_shared(hits.select("doc_id", "item_id", (F.col("i") - F.col("j")).alias("d")).distinct(), "hits")
    side = F.broadcast if hits.count() <= MAX_BROADCAST_HITS else lambda t: t
    wanted = docs.select("doc_id", "text").join(side(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    placed = wanted.select("doc_id", tokens(F.col("text")).alias("h")).join(side(hits), "doc_id").join(F.broadcast(items) if small else items, "item_id")
    h, b, d, n = F.col("h"), F.col("b"), F.col("d"), F.size("b")
    # of the text, what lies under the item
    since = F.greatest(F.lit(0), d)
    under = F.slice(h, since + 1, F.greatest(F.lit(0), F.least(F.size(h), n + d) - since))
    placed = placed.select("doc_id", "item_id", "b", d.alias("at"), F.size(h).alias("size"), under.alias("h"), (since - d).alias("o"))
    equal = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when((j >= F.col("o")) & (F.get(h, j - F.col("o")) == F.get(b, j)), 1).otherwise(0))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)
    found = placed.select("doc_id", "item_id", n.alias("n_item"), "size", equal.alias("e"), "at").withColumn("n_equal", total("e"))
    # runs begin where the document and the item both hold all of one
    first, last = F.greatest(F.lit(0), -F.col("at")), F.least(F.col("n_item"), F.col("size") - F.col("at")) - RUN
    run = F.exists(F.sequence(first, last), lambda s: total(F.slice("e", s + 1, RUN)) * 100 >= RUN * percent)
    whole = F.col("n_equal") * 100 >= F.col("n_item") * percent
    found = found.filter(F.when(whole, True).when((last >= first) & (F.col("n_equal") * 100 >= RUN * percent), run).otherwise(False))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", (-F.col("at")).alias("p"), "n_item")).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.n_item").cast("long").alias("n_item"), F.col("x.n_equal").cast("long").alias("n_equal"), (-F.col("x.p")).cast("long").alias("at"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """docs without the documents that hold a benchmark item; null doc_ids stay."""
    bad = find_passages(docs, benchmark, percent=percent).select(F.col("doc_id").alias("mr_id")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["mr_id"], "left_anti")
