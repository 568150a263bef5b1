"""The queue engine's queries by name, each beside the same question as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.envelope import envelope, failure
from ..functions.identity import with_identity
from ..functions.retry import RetryPolicy
from ..operators import aggregates as agg
from ..operators import enqueue, lineage, routing
from ..operators import transitions as tr
from . import fixtures as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = fx.NOW
_M = fx.ctes(m=fx.MESSAGES)
_STATUS = "queue, id, status, attempts, max_attempts, available_at, lease_until, receipt, last_error, failure_reason, failure_category, updated_at"
_COLS = _STATUS.split(", ")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _messages(spark, d) -> DataFrame:
    return fx.relation(spark, d, fx.MESSAGES)


def _longs(df: DataFrame, *but: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "bigint") and c not in but else F.col(c) for c, t in df.dtypes])


_COUNTS = "count(*) filter (where status = 0) as ready, count(*) filter (where status = 1) as processing, count(*) filter (where status = 2) as acked, count(*) filter (where status = 3) as failed"


@query(_M + f"select queue, {_COUNTS} from m group by queue")
def queue_stats(spark, d):
    return agg.stats(_messages(spark, d))


@query(_M + f"""
, g as (select queue, {_COUNTS},
  min(case when status = 0 and available_at <= {NOW} then available_at end) as oldest_available_at,
  min(case when status = 1 then updated_at end) as oldest_processing_updated_at,
  count(*) filter (where status = 1 and lease_until > {NOW}) as active_leases,
  count(*) filter (where status = 1 and lease_until <= {NOW}) as expired_leases,
  min(case when status = 1 and lease_until <= {NOW} then lease_until end) as oldest_expired_lease_until
  from m group by queue)
select *, ready + processing as pending, case when ready + processing > 1000 then 0 else 1000 - ready - processing end as available_slots,
  case when oldest_available_at is not null then greatest({NOW} - oldest_available_at, 0) end as oldest_ready_age_ms,
  case when oldest_processing_updated_at is not null then greatest({NOW} - oldest_processing_updated_at, 0) end as oldest_processing_age_ms,
  case when oldest_expired_lease_until is not null then greatest({NOW} - oldest_expired_lease_until, 0) end as oldest_expired_age_ms from g""")
def queue_diagnostics(spark, d):
    return agg.diagnostics(_messages(spark, d), NOW, 1000)


@query(_M + f"select queue, bool_or((status = 0 and available_at <= {NOW}) or (status = 1 and lease_until <= {NOW})) as deliverable from m group by queue")
def deliverable_probe(spark, d):
    return tr.deliverable(_messages(spark, d), NOW)


def _reclaimed(budget: str) -> str:
    e = f"(status = 1 and lease_until <= {NOW})"
    return f"""select queue, id, case when {e} then case when attempts < {budget} then 0 else 3 end else status end as status, attempts,
      case when {e} then {budget} else max_attempts end as max_attempts, case when {e} and attempts < {budget} then {NOW} else available_at end as available_at,
      case when not {e} then lease_until end as lease_until, case when not {e} then receipt end as receipt, last_error,
      case when {e} and attempts >= {budget} then 'retries_exhausted' else failure_reason end as failure_reason, failure_category,
      case when {e} then {NOW} else updated_at end as updated_at
      from (select queue, id, status, attempts, max_attempts, available_at, coalesce(lease_until, 0) as lease_until_0, lease_until, receipt, last_error, failure_reason, failure_category, updated_at from m)"""


@query(_M + _reclaimed("max_attempts"))
def reclaim_expired(spark, d):
    return _longs(tr.reclaim(_messages(spark, d), NOW).select(*_COLS))


def _claimed(source: str, n: int, budget: str) -> str:
    return f"""select c.queue, c.id, case when p.id is not null then 1 else status end as status, attempts + case when p.id is not null then 1 else 0 end as attempts,
      case when p.id is not null then {budget} else max_attempts end as max_attempts, available_at, case when p.id is not null then {NOW} + 60000 else lease_until end as lease_until,
      case when p.id is not null then concat('w-', cast(c.id as varchar)) else receipt end as receipt, last_error, failure_reason, failure_category,
      case when p.id is not null then {NOW} else updated_at end as updated_at
      from {source} c left join (select id from {source} where status = 0 and available_at <= {NOW} qualify row_number() over (partition by queue order by id) <= {n}) p on p.id = c.id"""


@query(_M + f", r as ({_reclaimed('max_attempts')}) " + _claimed("r", 1, "max_attempts"))
def claim_next(spark, d):
    return _longs(tr.claim(_messages(spark, d), NOW, lease_ms=60000, receipt="w").select(*_COLS))


@query(_M + f", r as ({_reclaimed('max_attempts')}) " + _claimed("r", 25, "max_attempts"))
def claim_batch(spark, d):
    return _longs(tr.claim(_messages(spark, d), NOW, lease_ms=60000, n=25, receipt="w").select(*_COLS))


_USED = f"(status = 0 and available_at <= {NOW} and attempts >= 2)"


@query(_M + f""", r as ({_reclaimed('2')}), b as (select queue, id, case when {_USED} then 3 else status end as status, attempts, case when {_USED} then 2 else max_attempts end as max_attempts,
  available_at, lease_until, receipt, last_error, case when {_USED} then 'retries_exhausted' else failure_reason end as failure_reason, failure_category,
  case when {_USED} then {NOW} else updated_at end as updated_at from r) """ + _claimed("b", 10, "2"))
def claim_with_budget(spark, d):
    return _longs(tr.claim(_messages(spark, d), NOW, lease_ms=60000, n=10, receipt="w", max_attempts=2).select(*_COLS))


# commands: every leased message; those of even users carry the right receipt, time is soon after the lease began
_AT = NOW - 1_000_000_000
_CMD = "c as (select queue, id, case when id % 3 = 0 then 'stale' else receipt end as receipt, id % 5 * 1000 as delay_ms, concat('e', cast(id % 7 as varchar(9))) as last_error, id * 10 as lease_ms from m where status = 1)"
_LIVE = f"(c.id is not null and status = 1 and m.receipt = c.receipt and m.lease_until > {_AT})"


def _commands(spark, d) -> tuple[DataFrame, DataFrame]:
    m = _messages(spark, d)
    c = m.filter("status = 1").select(
        "queue", "id", F.when(F.col("id") % 3 == 0, "stale").otherwise(F.col("receipt")).alias("receipt"), (F.col("id") % 5 * 1000).alias("delay_ms"),
        F.concat(F.lit("e"), (F.col("id") % 7).cast("string")).alias("last_error"), (F.col("id") * 10).alias("lease_ms"),
        F.lit("rejected").alias("reason"), F.lit("validation").alias("category"),
    )
    return m, c


def _changed(**new: str) -> str:
    cols = ", ".join(f"case when {_LIVE} then {new[c]} else m.{c} end as {c}" if c in new else f"m.{c}" for c in _COLS)
    return f"{_M}, {_CMD} select {cols} from m left join c on c.id = m.id and c.queue = m.queue"


@query(_changed(status="2", receipt="null", lease_until="null", updated_at=f"{_AT}"))
def ack_fenced(spark, d):
    return _longs(tr.ack(*_commands(spark, d), _AT).select(*_COLS))


@query(_changed(status="case when attempts >= max_attempts then 3 else 0 end", available_at=f"case when attempts >= max_attempts then {_AT} else {_AT} + c.delay_ms end", receipt="null", lease_until="null", last_error="c.last_error", failure_reason="case when attempts >= max_attempts then 'retries_exhausted' end", failure_category="null", updated_at=f"{_AT}"))
def nack_delayed(spark, d):
    m, c = _commands(spark, d)
    return _longs(tr.nack(m, c.withColumn("reason", F.lit(None).cast("string")), _AT).select(*_COLS))


@query(_changed(status="3", receipt="null", lease_until="null", last_error="c.last_error", failure_reason="'rejected'", failure_category="'validation'", updated_at=f"{_AT}"))
def fail_permanent(spark, d):
    return _longs(tr.fail(*_commands(spark, d), _AT).select(*_COLS))


@query(_changed(lease_until=f"{_AT} + c.lease_ms", updated_at=f"{_AT}"))
def extend_lease(spark, d):
    return _longs(tr.extend(*_commands(spark, d), _AT).select(*_COLS))


_R = "(status = 3 and id % 2 = 0)"


@query(_M + f"select queue, id, case when {_R} then 0 else status end as status, case when {_R} then 0 else attempts end as attempts, max_attempts, case when {_R} then {NOW} else available_at end as available_at, lease_until, receipt, case when not {_R} then last_error end as last_error, case when not {_R} then failure_reason end as failure_reason, case when not {_R} then failure_category end as failure_category, case when {_R} then {NOW} else updated_at end as updated_at from m")
def retry_failed(spark, d):
    m = _messages(spark, d)
    return _longs(tr.retry_failed(m, NOW, m.filter("id % 2 = 0").select("queue", "id")).select(*_COLS))


@query(_M + f"select queue, id, status from m where not (status in (2, 3) and updated_at < {NOW} and not exists (select 1 from orders o where o.o_orderkey = m.id and o.o_orderstatus = 'O'))")
def purge_terminal(spark, d):
    kept = spark.read.parquet(f"{d}/orders.parquet").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("message_id"))
    return tr.purge(_messages(spark, d), kept, NOW, include_failed=True).select("queue", "id", "status")


@query(_M + "select id, queue, greatest(attempts - 1, 0) as attempts, last_error, coalesce(failure_reason, 'legacy_unknown') as failure_reason, failure_category, updated_at / 1000.0 as failed_at from m where status = 3 order by id limit 50 offset 100")
def dead_letter_page(spark, d):
    from ..schema import failure_reason

    page = agg.failed_page(_messages(spark, d), limit=50, offset=100)
    return page.select("id", "queue", "attempts", "last_error", failure_reason(F.col("failure_reason")).alias("failure_reason"), "failure_category", (F.col("updated_at") / 1000.0).alias("failed_at"))


_LOG = "select user_id as message, event_id as seq, case event_type when 'click' then 'get' when 'view' then 'nack' when 'error' then 'get' when 'purchase' then 'ack' else 'get' end as op, {MS} as at from events"
_LAPSED = "(s.status = 1 and s.lease_until <= l.at)"
_NOWLIVE = "(s.status = 1 and s.lease_until > l.at)"
_AFTER = f"case when {_LAPSED} and l.op = 'get' then case when s.attempts >= 4 then 3 else 0 end else s.status end"
_TAKEN = f"(l.op = 'get' and {_AFTER} = 0)"


_FOLD = f"""with recursive log as (select *, row_number() over (partition by message order by seq) as rn from ({_LOG.replace('{MS}', fx.MS['duck'])})),
s(message, rn, status, attempts, lease_until) as (
  select distinct message, 0::bigint, 0, 0, null::bigint from log
  union all
  select s.message, s.rn + 1, case when {_TAKEN} then 1 when {_NOWLIVE} and l.op = 'ack' then 2 when {_NOWLIVE} and l.op = 'nack' then case when s.attempts >= 4 then 3 else 0 end else {_AFTER} end,
    s.attempts + case when {_TAKEN} then 1 else 0 end,
    case when {_TAKEN} then l.at + 3600000 when {_NOWLIVE} and l.op not in ('ack', 'nack') then s.lease_until when {_LAPSED} and l.op <> 'get' then s.lease_until end
  from s join log l on l.message = s.message and l.rn = s.rn + 1)
select message, status::bigint as status, attempts::bigint as attempts, lease_until from s qualify row_number() over (partition by message order by rn desc) = 1"""


@query(_FOLD)
def command_replay(spark, d):
    return tr.replay(fx.relation(spark, d, _LOG), lease=3600000, max_attempts=4)


_B = fx.ctes(b=fx.BATCH)


@query(_B + "select queue, job_id, min(seq) as seq, min_by(payload, seq) as payload from b group by all")
def enqueue_dedup_job_id(spark, d):
    batch = fx.relation(spark, d, fx.BATCH).withColumn("dedup_key", F.lit(None).cast("string"))
    return enqueue.first_rows(batch).select("queue", "job_id", "seq", "payload")


@query(_B + "select queue, count(distinct job_id) as inserted, count(*) - count(distinct job_id) as deduplicated from b group by queue")
def dedup_outcomes(spark, d):
    return enqueue.dedup_counts(fx.relation(spark, d, fx.BATCH))


@query(_B + "select queue, 'job_id' as kind, job_id as value from b group by queue, job_id having count(distinct payload) > 1")
def dedup_conflicts(spark, d):
    b = fx.relation(spark, d, fx.BATCH)
    rows = b.select("seq", "queue", "job_id", F.col("payload").alias("dedup_key"), F.lit("f").alias("dedup_fingerprint"))
    return enqueue.conflicts(rows, rows.limit(0).withColumn("id", F.lit(0))).filter("kind = 'job_id'")


_ROWS = """select event_type as queue, event_id as seq, event_id as id, case when event_id % 2 = 0 then concat('k', cast(user_id % 50 as varchar(9))) end as dedup_key,
  case when event_id % 2 = 0 then case when event_id % 7 = 0 then 'f1' else 'f0' end end as dedup_fingerprint, case when event_id % 3 = 0 then concat('j', cast(event_id % 300 as varchar(9))) end as job_id from events"""


@query(fx.ctes(e=_ROWS) + """
, s as (select * from e where seq % 10 = 0), b as (select * from e where seq % 10 <> 0),
u as (select queue, dedup_key, dedup_fingerprint, job_id, id, -1 as seq from s union all select queue, dedup_key, dedup_fingerprint, job_id, null, seq from b),
k as (select queue, dedup_key, first(dedup_fingerprint order by seq, dedup_fingerprint nulls first, id nulls first) as print from u where dedup_key is not null group by all),
j as (select queue, job_id, first({'p': dedup_fingerprint, 'k': dedup_key} order by seq, dedup_fingerprint nulls first, dedup_key nulls first, id nulls first) as mark from u where job_id is not null group by all)
select b.seq, b.queue, 'dedup_key' as kind, b.dedup_key as value from b join k using (queue, dedup_key) where print is distinct from b.dedup_fingerprint
union all select b.seq, b.queue, 'job_id', b.job_id from b join j using (queue, job_id)
  where b.dedup_key is not null and (mark.p is distinct from b.dedup_fingerprint or mark.k is distinct from b.dedup_key)
union all select distinct b.seq, b.queue, 'both', b.job_id from b join s x on x.queue = b.queue and x.dedup_key = b.dedup_key join s y on y.queue = b.queue and y.job_id = b.job_id where x.id <> y.id""")
def dedup_conflicts_keys(spark, d):
    """Rows whose key, job or both meet another identity, stored or before them in the batch."""
    rows = fx.relation(spark, d, _ROWS)
    return enqueue.conflicting(rows.filter("seq % 10 <> 0"), rows.filter("seq % 10 = 0")).distinct()


def _new_queue(spark, name: str):
    from ..queue import Queue
    from ..store import Store, scratch_path

    return Queue(Store(spark, scratch_path(spark, "store")), name, lease_seconds=60, max_retries=3, clock=lambda: NOW)


_PUT = """select event_id as seq, event_type as queue, props as payload, case when event_id % 4 = 1 then concat('j', cast(event_id % 1000 as varchar(9))) end as job_id,
  case when event_id % 4 = 0 then concat('k', cast(user_id as varchar(9))) end as dedup_key, case when event_id % 4 = 0 then 'f' end as dedup_fingerprint from events where event_type = 'view'"""


@query(fx.ctes(e=_PUT) + """
, n as (select *, coalesce('k' || dedup_key, 'j' || job_id) as identity from e),
s1 as (select seq, identity, row_number() over (order by seq) as id from n where seq % 2 = 0 and (identity is null or seq = (select min(x.seq) from n x where x.identity = n.identity and x.seq % 2 = 0))),
f2 as (select seq, identity, min(seq) over (partition by identity) as first from n where identity is null or identity not in (select identity from s1 where identity is not null)),
s2 as (select seq, identity, (select count(*) from s1) + row_number() over (order by seq) as id from f2 where identity is null or seq = first),
known as (select identity, min(id) as id from (select identity, id from s1 union all select identity, id from s2) where identity is not null group by 1)
select n.seq, n.queue, coalesce(s2.id, known.id)::bigint as id, s2.id is not null as inserted from n left join s2 using (seq) left join known on known.identity = n.identity""")
def enqueue_identity(spark, d):
    """Two batches through a queue and its commits; what became of the second's rows: keys, jobs, rows without either, some stored before."""
    q, rows = _new_queue(spark, "view"), fx.relation(spark, d, _PUT).withColumn("payload", F.col("payload").cast("binary"))
    q.put_frame(rows.filter("seq % 2 = 0"))
    return q.put_frame(rows)


_IDS = """select event_type as queue, event_id as seq, event_id as id, cast(0 as bigint) as status, case when event_id % 3 = 0 then concat('k', cast(user_id % 40 as varchar(9))) end as dedup_key,
  case when event_id % 5 <> 0 then concat('j', cast(event_id % 700 as varchar(9))) end as job_id from events"""


@query(fx.ctes(e=_IDS, lim="select * from (values ('click', 100000), ('view', 10), ('error', 400)) t(queue, lim)") + """
, s as (select * from e where seq % 4 = 0), b as (select *, coalesce('k' || dedup_key, 'j' || job_id, 'a' || seq) as identity from e where seq % 4 <> 0),
f as (select * from b qualify row_number() over (partition by queue, identity order by seq) = 1),
n as (select queue, count(*) as new from f where not exists (select 1 from s where s.queue = f.queue and s.dedup_key = f.dedup_key) and not exists (select 1 from s where s.queue = f.queue and s.job_id = f.job_id) group by 1),
p as (select queue, count(*) as pending from s group by 1)
select lim.queue, coalesce(pending, 0) as pending, coalesce(new, 0) as new, lim::bigint as "limit",
  case when coalesce(new, 0) = 0 then 'ok' when new > lim then 'impossible' when coalesce(pending, 0) + new > lim then 'full' else 'ok' end as verdict
from lim left join n using (queue) left join p using (queue)""")
def capacity_identities(spark, d):
    """Room for new identities: keys before jobs, rows without either one by one, some stored."""
    rows = fx.relation(spark, d, _IDS)
    limits = spark.sql("select * from values ('click', 100000L), ('view', 10L), ('error', 400L) t(queue, limit)")
    return enqueue.capacity(rows.filter("seq % 4 <> 0"), rows.filter("seq % 4 = 0"), limits)


@query(fx.ctes(e=_PUT) + f"""
, f as (select *, row_number() over (order by seq) as id from e where coalesce(dedup_key, job_id) is null or seq = (select min(x.seq) from e x where coalesce('k' || x.dedup_key, 'j' || x.job_id) = coalesce('k' || e.dedup_key, 'j' || e.job_id)))
select id, payload, job_id, case when id > 300 then 0 when id % 3 = 0 then 2 when id % 3 = 1 then 0 else 3 end::bigint as status, case when id > 300 then 0 else 1 end::bigint as attempts,
  case when id <= 300 and id % 3 = 1 then {NOW} + 5000 else {NOW} end::bigint as available_at, case when id <= 300 and id % 3 = 1 then 'again' when id <= 300 and id % 3 = 2 then 'no' end as last_error,
  case when id <= 300 and id % 3 = 2 then 'rejected' end as failure_reason, null::varchar as receipt from f""")
def store_put_claim_ack(spark, d):
    """A queue's whole way through the store: put, claim of 300, then an ack, nack or fail of each, each one commit."""
    q, rows = _new_queue(spark, "view"), fx.relation(spark, d, _PUT).withColumn("payload", F.col("payload").cast("binary"))
    q.put_frame(rows)
    commands = q.claim(300).select(F.lit("view").alias("queue"), "id", "receipt")
    q.apply(commands.filter("id % 3 = 0"), "ack")
    nack = commands.filter("id % 3 = 1").withColumns({"delay_ms": F.lit(5000).cast("long"), "last_error": F.lit("again"), "reason": F.lit(None).cast("string")})
    q.apply(nack, "nack")
    q.apply(commands.filter("id % 3 = 2").withColumns({"last_error": F.lit("no"), "reason": F.lit("rejected"), "category": F.lit(None).cast("string")}), "fail")
    m = q.store.table("messages", queue="view")
    return m.select("id", F.col("payload").cast("string").alias("payload"), "job_id", "status", "attempts", "available_at", "last_error", "failure_reason", "receipt")


@query("""select doc_id, 'event-identity:v1:' || sha256('{"event_schema":"Doc@1","identity":{"source":' || to_json(source) || ',"text":' || to_json(text) || '}}') as dedup_key,
  'event-payload:v1:' || sha256('{"event_schema":"Doc@1","payload":{"lang":' || to_json(lang) || ',"source":' || to_json(source) || ',"text":' || to_json(text) || '}}') as dedup_fingerprint from documents""")
def identity_hash(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source")
    return with_identity(docs, "Doc@1", ["text", "lang", "source"], ["text", "source"]).select("doc_id", "dedup_key", "dedup_fingerprint")


@query(fx.ctes(m=fx.MESSAGES, lim="select * from (values ('click', 2000), ('view', 500), ('purchase', 100000)) t(queue, lim)", b="select event_type as queue, concat('job-', cast(event_id % 4000 as varchar(20))) as job_id from events where event_id % 2 = 0") + """
, n as (select b.queue, count(distinct b.job_id) as new from b where not exists (select 1 from m where m.queue = b.queue and m.job_id = b.job_id) group by 1),
p as (select queue, count(*) as pending from m where status in (0, 1) group by 1)
select lim.queue, coalesce(pending, 0) as pending, coalesce(new, 0) as new, lim::bigint as "limit",
  case when coalesce(new, 0) = 0 then 'ok' when new > lim then 'impossible' when coalesce(pending, 0) + new > lim then 'full' else 'ok' end as verdict
from lim left join n using (queue) left join p using (queue)""")
def capacity_check(spark, d):
    m = _messages(spark, d).withColumn("dedup_key", F.lit(None).cast("string"))
    b = spark.read.parquet(f"{d}/events.parquet").filter("event_id % 2 = 0")
    b = b.select(F.col("event_type").alias("queue"), F.concat(F.lit("job-"), (F.col("event_id") % 4000).cast("string")).alias("job_id"), F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("dedup_key"))
    limits = spark.sql("select * from values ('click', 2000L), ('view', 500L), ('purchase', 100000L) t(queue, limit)")
    return enqueue.capacity(b, m, limits)


_T = fx.ctes(t=fx.TOPOLOGY)


def _events(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


@query(_T + "select distinct event_id, event_type, subscription, concat('__bus__:shop:', subscription) as queue from events join t on pattern = event_type or pattern = '*'")
def route_fanout(spark, d):
    out = routing.route(_events(spark, d).select("event_id", "event_type"), spark.sql(fx.TOPOLOGY))
    return out.select("event_id", "event_type", "subscription", routing.subscription_queue("shop", F.col("subscription")).alias("queue"))


@query(_T + "select event_id, event_type from events where event_type not in (select pattern from t where pattern <> '*')")
def unrouted_events(spark, d):
    return routing.unrouted(_events(spark, d).select("event_id", "event_type"), spark.sql(fx.TOPOLOGY).filter("pattern <> '*'")).select("event_id", "event_type")


_H = "select * from (values ('audit','*','log_all'), ('audit','error','log_error'), ('sales','purchase','book')) h(subscription, pattern, handler)"


@query(fx.ctes(t=fx.TOPOLOGY, h=_H) + """select event_id, e.subscription, coalesce(a.handler, w.handler) as handler
from (select distinct event_id, event_type, subscription from events join t on pattern = event_type or pattern = '*') e
left join h a on a.subscription = e.subscription and a.pattern = e.event_type left join h w on w.subscription = e.subscription and w.pattern = '*'""")
def handler_resolution(spark, d):
    out = routing.route(_events(spark, d).select("event_id", "event_type"), spark.sql(fx.TOPOLOGY))
    return routing.resolve_handlers(out, spark.sql(_H)).select("event_id", "subscription", "handler")


def _envelopes(spark, d) -> DataFrame:
    text = F.col("event_id").cast("string")
    return _events(spark, d).select("event_id", envelope(text, text, F.when(F.col("event_id") % 5 == 0, text), F.col("event_type"), F.concat("event_type", F.lit("@1")), F.col("user_id").cast("string"), F.col("props")).alias("envelope"))


@query("""select event_id, '{"event_id":"' || event_id || '","correlation_id":"' || event_id || '","causation_id":' || case when event_id % 5 = 0 then '"' || event_id || '"' else 'null' end ||
 ',"event_type":"' || event_type || '","event_schema":"' || event_type || '@1","event_created_at":"' || user_id || '","payload":' || props || '}' as envelope from events""")
def envelope_json(spark, d):
    return _envelopes(spark, d)


@query("""select event_id, case when event_id % 7 in (0, 1, 2) then 'invalid_envelope' when event_type not in ('click', 'view', 'purchase') then 'unknown_event_type' end as reason from events""")
def dead_letter_reasons(spark, d):
    e = _envelopes(spark, d).join(_events(spark, d).select("event_id"), "event_id")
    k = F.col("event_id") % 7
    text = F.when(k == 0, F.lit("not json")).when(k == 1, F.lit("[1]")).when(k == 2, F.regexp_replace("envelope", '"event_type":"[a-z]+"', '"event_type":7')).otherwise(F.col("envelope"))
    return e.select("event_id", failure(text, ["click", "view", "purchase"]).alias("reason"))


@query("select event_id, event_type, user_id::varchar as event_created_at, cast(props->>'$.k' as bigint) as k from events")
def envelope_parse(spark, d):
    v = F.get_json_object
    e = F.col("envelope")
    return _envelopes(spark, d).select("event_id", v(e, "$.event_type").alias("event_type"), v(e, "$.event_created_at").alias("event_created_at"), v(e, "$.payload.k").cast("long").alias("k"))


@query("select conv_id, turn, conv_id || '-' || turn as event_id, case when turn > 0 then conv_id || '-' || (turn - 1) end as causation_id, case when turn > 0 then conv_id || '-' || case when turn - 1 > 0 then (turn - 2) else (turn - 1) end else conv_id || '-' || turn end as correlation_id from conversations")
def lineage_chain(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")

    def name(t):
        return F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))

    rows = c.select("conv_id", "turn", name(F.col("turn")).alias("event_id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent_id"), F.when(F.col("turn") > 0, name(F.greatest(F.col("turn") - 1, F.lit(0)))).alias("known"))
    parents = rows.select("event_id", F.col("known").alias("correlation_id"))
    children = rows.select("conv_id", "turn", "event_id", "parent_id", F.lit(None).cast("string").alias("correlation_id"), F.lit(None).cast("string").alias("causation_id"))
    return lineage.with_lineage(children, parents).select("conv_id", "turn", "event_id", "causation_id", "correlation_id")


@query(f"""with recursive e as ({fx.EDGES}), r(conv_id, node) as (select conv_id, 0::bigint from conversations where turn = 0 union select r.conv_id, e.child from r join e on e.conv_id = r.conv_id and e.parent = r.node) select conv_id, node from r""")
def descendants_closure(spark, d):
    roots = spark.read.parquet(f"{d}/conversations.parquet").filter("turn = 0").select("conv_id", F.col("turn").alias("node"))
    return lineage.descendants(fx.relation(spark, d, fx.EDGES), roots, key=["conv_id"])


_X = fx.ctes(x=fx.EXECUTIONS, dl=fx.DELIVERIES, m=fx.MEMBERS)


def _run(spark, d):
    r = lambda t: fx.relation(spark, d, t)
    return r(fx.EXECUTIONS), r(fx.DELIVERIES), r(fx.MEMBERS)


@query(_X + f"select execution_id, count(*) as total, {_COUNTS} from dl join m on m.id = dl.message_id group by execution_id")
def execution_states(spark, d):
    _, dl, m = _run(spark, d)
    return agg.execution_states(dl, m)


@query(_X + f"select x.execution_id, source_completed, items_committed, count(dl.message_id) as total, {_COUNTS} from x join (select o_orderkey as execution_id, o_custkey as items_committed from orders) r using (execution_id) left join dl using (execution_id) left join m on m.id = dl.message_id group by all")
def execution_snapshot(spark, d):
    x, dl, m = _run(spark, d)
    runtime = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("execution_id"), F.col("o_custkey").alias("items_committed"))
    return agg.execution_snapshot(x, runtime, dl, m)


@query(_X + "select execution_id from x where source_completed and not exists (select 1 from dl join m on m.id = dl.message_id where dl.execution_id = x.execution_id and m.status in (0, 1))")
def finalize_executions(spark, d):
    return agg.finished(*_run(spark, d)).select("execution_id")


@query(_X + "select execution_id from x where execution_id in (select execution_id from dl where message_id % 97 = 0)")
def reopen_executions(spark, d):
    x, dl, m = _run(spark, d)
    return agg.reopened(x, dl, m.filter("id % 97 = 0")).select("execution_id")


@query("""select event_id, least(0.5 * pow(2.0, user_id % 12), 60.0) as delay,
  round(least(0.5 * pow(2.0, user_id % 12), 60.0) * (('0x' || substr(md5('7|' || event_id), 1, 8))::bigint / 4294967296.0::double), 9) as jittered from events""")
def retry_backoff(spark, d):
    """Capped exponential delays, and the same with full jitter by a seeded hash."""
    plain, jitter = (RetryPolicy.exponential(13, 0.5, 2.0, 60.0, jitter=j) for j in (False, True))
    attempt = F.col("user_id") % 12 + 1
    uniform = F.conv(F.substring(F.md5(F.concat(F.lit("7|"), F.col("event_id").cast("string"))), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))
    return _events(spark, d).select("event_id", plain.delay(attempt).alias("delay"), F.round(jitter.delay(attempt, uniform), 9).alias("jittered"))


@query("select (event_id - lo) // 1000 as batch, count(*) as items, count(*) filter (where event_type in ('click', 'view', 'purchase')) as routed, count(*) filter (where event_type not in ('click', 'view', 'purchase')) as unrouted, max(event_id) as cursor from events, (select min(event_id) as lo from events) group by 1")
def ingest_batches(spark, d):
    from ..operators.ingest import batch_counters

    return batch_counters(_events(spark, d), "event_id", 1000, F.col("event_type").isin("click", "view", "purchase"))


@query("select count(*) as items, max(event_id) as cursor, (count(*) + 999) // 1000 as batches from events where event_id > (select min(event_id) from events) + 4321")
def checkpoint_resume(spark, d):
    from ..operators.ingest import resume

    e = _events(spark, d)
    low = e.agg(F.min("event_id")).first()[0]
    return resume(e, "event_id", low + 4321, 1000)


@query("select event_type, count(value) as count, min(value) as min, max(value) as max, round(avg(value), 6) as mean, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, round(count(value) * 1e6 / sum(value), 3) as ops_per_second from events group by 1")
def latency_summary(spark, d):
    out = agg.latency_summary(_events(spark, d), "event_type", "value")  # rounded: sums of doubles depend on the order
    return out.withColumns({"mean": F.round("mean", 6), "ops_per_second": F.round("ops_per_second", 3)})


@query("select event_id, value from events where event_id % (select (count(*) + 499) // 500 from events) = 0 order by event_id limit 500")
def systematic_sample(spark, d):
    e = _events(spark, d)
    return agg.sample_every(e.select("event_id", "value"), "event_id", e.count(), 500)


@query("select user_id, count(*) as count, sum(event_id)::bigint as sum, bit_xor(event_id) as xor, sum(('0x' || substr(sha256(event_id::varchar), 1, 8))::bigint)::bigint as digest from events group by 1")
def id_validation(spark, d):
    return agg.id_check(_events(spark, d), "user_id", "event_id")


@query(_M + "select queue, min(created_at) as first_at, max(updated_at) as last_at, count(*) as n, round(count(*) * 1000.0::double / greatest(max(updated_at) - min(created_at), 1), 6) as per_second from m group by queue")
def throughput_interval(spark, d):
    return agg.throughput(_messages(spark, d), "queue", "created_at", "updated_at").withColumn("per_second", F.round("per_second", 6))


@query(_M + """, dl as (select o_orderkey as message_id from orders)
select 'duplicate id' as rule, count(*) as n from (select id from m group by id having count(*) > 1)
union all select 'duplicate job_id', count(*) from (select 1 from m where job_id is not null group by queue, job_id having count(*) > 1)
union all select 'unknown status', count(*) from m where status is null or status not in (0, 1, 2, 3)
union all select 'lease without receipt', count(*) from m where status = 1 and (receipt is null or lease_until is null)
union all select 'receipt without lease', count(*) from m where status <> 1 and receipt is not null
union all select 'delivery without message', count(*) from dl where message_id not in (select id from m)""")
def integrity_violations(spark, d):
    dl = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("message_id"))
    return agg.violations(_messages(spark, d), dl)


@query("select o_orderkey::varchar as o_orderkey, o_orderstatus, o_orderpriority, row_number() over (order by o_orderkey)::bigint as record_number from orders")
def csv_roundtrip(spark, d):
    """The orders as one CSV file in the shared folder, and its records by cursor, as a stream in ranges."""
    from ..sources.resumable import CsvSource, CsvStream
    from ..store import scratch_path

    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    base = scratch_path(spark, "csv")
    path = f"{base}/given"
    rows.orderBy("o_orderkey").coalesce(1).write.option("header", True).csv(path)
    name = next(f for f in CsvSource.listed(spark, path) if f.endswith(".csv"))
    spark.dataSource.register(CsvStream)
    stream = spark.readStream.format("millrace_csv").option("path", f"{path}/{name}").option("per_batch", 5000).load()
    out = f"{base}/read"
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").option("path", out).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    cells = F.from_json("row", "o_orderkey string, o_orderstatus string, o_orderpriority string")
    return spark.read.schema("record_number long, line_number long, row string, cursor string").parquet(out).select(cells.alias("c"), "record_number").select("c.*", "record_number")


# the last watermark is the latest command's time: leases that have ended by then are given up
_END = f"(select max({fx.MS['duck']}) from events)"


@query(f"""select message, case when status = 1 and lease_until <= {_END} then case when attempts >= 4 then 3 else 0 end else status end as status, attempts,
  case when status = 1 and lease_until > {_END} then lease_until end as lease_until from ({_FOLD})""")
def stream_state_machine(spark, d):
    """Each message's state at the end of a stream that is stopped and resumed three times; leases end by timers."""
    from ..streaming.machine import run_to_end

    log = fx.relation(spark, d, _LOG).select(F.lit("q").alias("queue"), F.col("message").cast("long").alias("message"), F.col("seq").cast("long").alias("seq"), "op", F.col("at").cast("long").alias("at"))
    cuts = [-1, *log.approxQuantile("seq", [0.25, 0.5, 0.75], 0.01), float("inf")]
    parts = [log.filter((F.col("seq") > a) & (F.col("seq") <= b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = run_to_end(spark, parts, lease=3600000, max_attempts=4)
    last = out.groupBy("queue", "message").agg(F.max_by(F.struct("status", "attempts", "lease_until"), "step").alias("x"))
    return last.select("message", "x.*")


@query("select event_type, count(*) as items, max(event_id) as cursor from events group by 1")
def resumable_stream(spark, d):
    from ..streaming.machine import resumed

    e = _events(spark, d).select("event_id", "event_type")
    out = resumed(spark, [e.filter("event_id % 3 = 0"), e.filter("event_id % 3 <> 0")])
    return out.groupBy("event_type").agg(F.count("*").alias("items"), F.max("event_id").alias("cursor"))
