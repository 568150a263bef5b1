"""The queries opN_<name> of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, licenses, lm, quality, secret_scan
from .common import bound_batches, remainder, table
from .decontam import find_passages
from .embed import near_vectors
from .linededup import dedup_lines
from .minhash import near_duplicates
from .mixing import mix

SQL: dict[str, str] = {}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL["op1_mixing"] = """
with sizes as (
  select source, sum(coalesce(length(text), 0))::bigint as size from documents group by source),
weighted as (
  select *, case when size > 0 then 1.0::double else 0.0::double end as weight from sizes),
rates as (
  select source, case when weight > 0 then
           1.0::double * (sum(size) over ())::double * (weight / sum(weight) over ()) / size
         else 0.0::double end as rate from weighted),
steps as (
  select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 24)::bigint + 1)) as k
  from rates where rate > 0),
cdf as (
  select source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over
         (partition by source order by k) as c from steps),
drawn as (
  select *, ('0x' || substr(md5('17|' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint
            / 4503599627370496.0::double as u from documents),
counts as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars,
         (select count(*) from cdf where cdf.source is not distinct from d.source and cdf.c <= d.u) as n
  from drawn d)
select doc_id, text, lang, source, n_chars, copy::int as copy,
       ('0x' || substr(md5('17-order|' || coalesce(doc_id::varchar, 'null') || '|' || copy::varchar), 1, 15))::bigint
         as shuffle_key
from (select *, unnest(range(0, n)) as copy from counts)
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


SQL["op10_line_dedup"] = r"""
with lines as (
  select doc_id, i, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)),
often as (
  select key, max(doc_id) as keeper from lines where length(key) >= 20
  group by key having count(distinct doc_id) >= 3),
marked as (
  select l.*, o.key is not null and l.doc_id <> o.keeper as gone from lines l left join often o using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL["op2_minhash"] = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
  from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from shingles a join shingles b using (s) where a.doc_id < b.doc_id group by all),
links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * shared >= 85 * (x.n + y.n - shared)),
reach as (
  select doc_id as id, doc_id as seen from documents
  union
  select r.id, e.b from reach r join (select a, b from links union all select b, a from links) e on e.a = r.seen)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, min(seen) as component_id, d.doc_id = min(seen) as kept
from documents d join reach r on r.id = d.doc_id left join sizes using (doc_id)
group by d.doc_id, n
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_passages(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


SQL["op7_decontamination"] = r"""
with masks as (
  select * from (values (0, [0, 1, 2, 3], 5, 1000000000), (1, [0, 1, 3, 4], 5, 1000000000), (2, [0, 2, 3, 4], 5, 1000000000),
    (3, [0, 1, 2, 4], 5, 1000000000), (4, [0], 1, 1), (5, [0, 1], 2, 2), (6, [0, 1, 2], 3, 3), (7, [0, 1, 2, 3], 4, 4)) t(mask, offs, least, most)
  where exists (select * from benchmark
    where len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) between least and most)),
docs as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as h
  from documents),
items as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as b
  from benchmark),
dw as (
  select doc_id, i, mask, array_to_string(list_transform(offs, lambda o: h[i + o + 1]), ' ') as k
  from (select doc_id, h, unnest(range(0, len(h))) as i from docs) w, masks where i + offs[-1] < len(h)),
bw as (
  select item_id, j, mask, array_to_string(list_transform(offs, lambda o: b[j + o + 1]), ' ') as k
  from (select item_id, b, unnest(range(0, len(b))) as j from items) w, masks
  where j + offs[-1] < len(b) and len(b) between least and most),
hits as (select distinct doc_id, item_id, i - j as d from dw join bw using (mask, k)),
compared as (
  select doc_id, item_id, d, len(b) as n_item, len(h) as size,
         list_transform(range(0, len(b)), lambda j:
           case when d + j >= 0 and d + j < len(h) and h[(d + j + 1)::int] = b[(j + 1)::int] then 1 else 0 end) as e
  from hits join docs using (doc_id) join items using (item_id)),
summed as (select *, list_sum(e)::bigint as n_equal, greatest(0, -d) as r0, least(n_item, size - d) - 13 as r1 from compared),
scored as (
  select * from summed
  where n_equal * 100 >= n_item * 80
     or len(list_filter(range(r0, r1 + 1), lambda s: list_sum(e[(s + 1)::int:(s + 13)::int]) * 100 >= 13 * 80)) > 0)
select doc_id, item_id, n_item::bigint as n_item, n_equal::bigint as n_equal, d::bigint as at from scored
qualify row_number() over (partition by doc_id, item_id order by n_equal desc, d) = 1
"""


def held_out(folds: int, fold: int):
    """Whether a document is in the fold that nothing is learned from; a null doc_id isn't."""
    return F.coalesce(remainder(F.col("doc_id"), folds) == fold, F.lit(False)).alias("held_out")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(remainder(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(4, 2), "lang_pred", "score", "rejected")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 5) != 0)
    scored = quality.score(docs, quality.fit(docs, learned))
    return scored.select("doc_id", held_out(5, 0), "score", "predicted")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


SQL["op6_license_scan"] = licenses.oracle()


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan_secrets(docs, secret_scan.fit(docs)).withColumn("base", F.filter("secrets", lambda s: s["known"]))

    def joined(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secret_scan.KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("secrets").alias("spans"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


# All pairs, in double precision; the operator finds those that its tables bring together.
SQL["op9_embedding_dedup"] = """
with recursive rows as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
units as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as size from rows),
links as (
  select a.vec_id as a, b.vec_id as b from units a join units b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_inner_product(a.v, b.v) >= 0.95::double * a.size * b.size),
reach as (
  select vec_id as id, vec_id as seen from embeddings
  union
  select r.id, l.b from reach r join links l on l.a = r.seen),
least as (select id, min(seen) as component_id from reach group by id),
counts as (select a, count(*) as n from links group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join least on id = e.vec_id left join counts on a = e.vec_id
"""


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.fit(docs.filter(remainder(F.col("doc_id"), 5) != 1))
    scored = lm.score(docs, model)
    return scored.select("doc_id", held_out(5, 1), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bounded(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bound_batches(spark)
            return f(spark, sf_dir)

        return run

    return {k: bounded(f) for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
