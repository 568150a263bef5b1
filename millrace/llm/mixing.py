"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each source gets a mean repetition rate, so that its expected share of the characters is
its target weight. Each document's number of copies is a Poisson draw with that mean: a
hash of its id and the seed gives a uniform number, which is looked up in the inverted
Poisson distribution. The copies are then shuffled globally by a second hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import write_shared

#: The per-source table is broadcast up to so many steps of distributions in all (some 40 MB); beyond, it is joined.
MAX_BROADCAST_STEPS = 5_000_000
_SALTS = 64
#: A distribution is tabled so many standard deviations (and steps) to either side of its mean: beyond lies less than doubles tell.
_WIDTH, _MORE = 12, 24


def _unit(*parts):
    """A uniform number in [0, 1) of 52 bits from md5."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None, group: str, budget: float) -> DataFrame:
    """(group, size, rate): rate = budget * total size * weight / (sum of weights * size).

    weights: per group; None: all groups equal; a group without a weight gets 0. Size is
    in characters; null text counts 0. A group of size 0 has rate 0.
    """
    sizes = docs.groupBy(F.col(group).alias("mr_group")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("mr_size"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, value in sorted(weights.items()):
            weight = F.when(F.col("mr_group") == name, F.lit(float(value))).otherwise(weight)
    sizes = sizes.withColumn("mr_weight", F.when(F.col("mr_size") > 0, weight).otherwise(0.0))
    sizes = write_shared(sizes, "sizes")
    sums = sizes.agg(F.coalesce(F.sum("mr_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("mr_weight"), F.lit(0.0)).alias("weight")).first()
    share = F.col("mr_weight") / F.lit(sums["weight"])
    rate = F.lit(float(budget)) * F.lit(float(sums["size"])) * share / F.col("mr_size")
    return sizes.withColumn("mr_rate", F.when(F.col("mr_weight") > 0, rate).otherwise(0.0))


def _log_factorial(k: Column) -> Column:
    """ln(k!), by Stirling's series from 16 on."""
    x = k.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    small = F.array(*[F.lit(math.lgamma(n + 1)) for n in range(16)])
    return F.when(k < 16, F.get(small, k.cast("int"))).otherwise(series)


def _distributions(rates: DataFrame) -> DataFrame:
    """(mr_group, mr_first, mr_cdf): the Poisson distribution function at mr_first, mr_first + 1, ... of each
    group, around its mean only, as far as doubles tell. A group of rate 0 has an empty one."""
    rate = F.col("mr_rate")
    spread = _WIDTH * F.sqrt(rate) + _MORE
    first, last = F.greatest(F.lit(0), F.floor(rate - spread)), F.ceil(rate + spread)
    steps = rates.select("mr_group", "mr_rate", first.alias("mr_first"), F.explode(F.when(rate > 0, F.sequence(first, last))).alias("k"))
    steps = steps.withColumn("p", F.exp(F.col("k") * F.log("mr_rate") - F.col("mr_rate") - _log_factorial(F.col("k"))))
    upto = steps.withColumn("c", F.sum("p").over(Window.partitionBy("mr_group").orderBy("k")))
    made = upto.groupBy("mr_group").agg(F.first("mr_first").alias("mr_first"), F.array_sort(F.collect_list("c")).alias("mr_cdf"))
    return rates.filter(rate <= 0).select("mr_group", F.lit(0).cast("bigint").alias("mr_first"), F.lit(None).cast("array<double>").alias("mr_cdf")).union(made)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, *, group: str = "source", budget: float = 1.0, seed: int = 17) -> DataFrame:
    """Replicate documents so that groups meet their target weights, shuffled globally.

    Returns the columns of docs, then copy (0, 1, ...) and shuffle_key, in the order of
    shuffle_key inside hash partitions of it. Input columns of these two names are replaced.
    Null group: a group of its own. Null doc_id: drawn as the text 'null'. Null or empty
    text: drawn at its group's rate. Rows with one doc_id get the same count each. Empty
    table: an empty result. The per-group table is broadcast only up to
    MAX_BROADCAST_STEPS steps; above, documents are salted and joined, so that no group,
    however large, meets in one task.
    """
    docs = docs.drop("copy", "shuffle_key")
    rates = write_shared(_distributions(repetition_rates(docs, weights, group, budget)), "rates")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = docs.withColumn("mr_u", _unit(F.lit(str(seed)), key))
    if (rates.agg(F.sum(F.greatest(F.size("mr_cdf"), F.lit(1)))).first()[0] or 0) <= MAX_BROADCAST_STEPS:
        joined = drawn.join(F.broadcast(rates), drawn[group].eqNullSafe(rates["mr_group"]))
    else:
        drawn = drawn.withColumn("mr_salt", F.floor(F.col("mr_u") * 2**20 % _SALTS).cast("int"))
        salted = rates.withColumn("mr_s", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        joined = drawn.join(salted, drawn[group].eqNullSafe(salted["mr_group"]) & (drawn["mr_salt"] == salted["mr_s"]))
    beyond = F.size(F.filter("mr_cdf", lambda c: c <= F.col("mr_u")))
    copies = joined.withColumn("mr_n", F.coalesce(F.col("mr_first") + F.when(F.col("mr_cdf").isNotNull(), beyond), F.lit(0))).filter("mr_n > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("mr_n") - 1).cast("int"))))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), key, F.col("copy").cast("string"))), 1, 15), 16, 10)
    out = copies.withColumn("shuffle_key", order.cast("bigint")).select(*docs.columns, "copy", "shuffle_key")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")
