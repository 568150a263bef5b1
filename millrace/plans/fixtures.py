"""Queue relations derived from the test tables, for Spark and (the same text) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = 1705276800000  # 2024-01-15T00:00:00Z
MS = {"spark": "unix_millis(cast(ts as timestamp))", "duck": "(epoch_us(ts) // 1000)"}

MESSAGES = """
select event_id + 1 as id, event_type as queue, props as payload, cast(event_id % 4 as bigint) as status,
       case when event_id % 4 = 0 then user_id % 4 else 1 + user_id % 4 end as attempts, cast(4 as bigint) as max_attempts,
       {MS} + case when event_id % 10 = 0 then 3600000 else 0 end as available_at,
       case when event_id % 4 = 1 then {MS} + 60000 * (1 + user_id % 5) end as lease_until,
       case when event_id % 4 = 1 then concat('r-', cast(event_id as varchar(20))) end as receipt,
       case when event_id % 4 = 3 then concat('error k=', cast(user_id % 7 as varchar(20))) end as last_error,
       case when event_id % 4 = 3 then case when user_id % 3 = 0 then 'retries_exhausted' when user_id % 3 = 1 then 'rejected' else 'legacy_unknown' end end as failure_reason,
       case when event_id % 4 = 3 and user_id % 3 = 1 then 'validation' end as failure_category,
       case when event_id % 3 = 0 then concat('job-', cast(event_id as varchar(20))) end as job_id,
       {MS} as created_at, {MS} + 1000 * (user_id % 60) as updated_at
from events
"""
TOPOLOGY = "select * from (values ('audit','*'), ('sales','purchase'), ('ux','click'), ('ux','view')) t(subscription, pattern)"
BATCH = """
select l_returnflag as queue, concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20))) as job_id,
       (l_orderkey * 8 + l_linenumber) * cast(100000000 as bigint) + l_partkey as seq,
       concat('p', cast(l_partkey as varchar(20))) as payload
from lineitem
"""
EDGES = "select conv_id, turn - 1 as parent, turn as child from conversations where turn > 0"
EXECUTIONS = "select o_orderkey as execution_id, o_orderstatus <> 'P' as source_completed from orders"
DELIVERIES = """
select distinct l_orderkey as execution_id, l_orderkey * 10 + l_linenumber as message_id from lineitem
"""
MEMBERS = """
select l_orderkey * 10 + l_linenumber as id,
       min(case when l_linestatus = 'O' and l_returnflag = 'N' then 0 when l_linestatus = 'O' then 1 when l_returnflag = 'R' then 3 else 2 end) as status
from lineitem group by 1
"""
_TABLES = ("events", "lineitem", "conversations", "orders")


def relation(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    for t in _TABLES:
        if f"from {t}" in text:
            text = text.replace(f"from {t}", f"from parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(text.replace("{MS}", MS["spark"]))


def ctes(**named: str) -> str:
    return "with " + ", ".join(f"{k} as ({v.replace('{MS}', MS['duck'])})" for k, v in named.items()) + " "
