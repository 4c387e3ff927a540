"""Judge data derived from the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = """
select concat('p', lpad(cast(p_partkey as string), 7, '0')) as id, cast(p_partkey as bigint) as pos, p_name as original,
 case when p_partkey % 10 = 0 then p_name else concat(upper(substr(p_name,1,1)), substr(p_name,2), ', ', p_type) end as enriched,
 case when p_partkey % 4 < 2 then p_brand end as brand, case when p_partkey % 2 = 0 then p_type end as mpn,
 case when p_partkey % 3 = 0 then 'reject' else 'approve' end as ground_truth,
 case when p_partkey % 3 <> 0 then 'ok' when p_partkey % 9 = 0 then 'overcorrection' when p_partkey % 9 = 3 then 'meaning_change' else 'casing_error' end as reason
 from part
"""
VOTES = """
select backend, pair_id, run_index, verdict,
 case when verdict = 'approve' then 'ok' else case (p + case when h2 < 150 and b not in (1, 5) then 1 else 0 end) % 3 when 0 then 'overcorrection' when 1 then 'meaning_change' else 'casing_error' end end as reason,
 concat('model-', backend) as model_id, 'v3' as prompt_version, cast(null as double) as temperature,
 case when b < 3 then 'https://api.alpha.example/v1' else concat('https://api.', backend, '.example/v1') end as base_url,
 case when b = 1 then cast(h2 % 90 as bigint) when b = 2 then cast(0 as bigint) end as cached_tokens
 from (select concat('m', cast(b as string)) as backend, b, concat('p', lpad(cast(p_partkey as string), 7, '0')) as pair_id, r as run_index, cast(floor(p_partkey / 3.0) as bigint) as p, h2,
   case when (p_partkey % 3 = 0) <> (h1 < case b when 0 then 330 when 1 then 0 when 2 then 120 when 3 then 60 when 4 then 90 else 0 end) then 'reject' else 'approve' end as verdict
  from (select p_partkey, b, r, ((p_partkey * p_partkey * 31 + p_partkey * 7919 + b * 104729 * (p_partkey % 89 + 1) + r * 15485863 * (p_partkey % 97 + 1)) % 1009) % 1000 as h1,
     ((p_partkey * p_partkey * 17 + p_partkey * 6007 + b * 1299709 * (p_partkey % 61 + 1) + r * 32452843 * (p_partkey % 83 + 1)) % 1013) % 1000 as h2
    from part cross join (select 0 as b union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) bb cross join (select 0 as r union all select 1 union all select 2) rr) z
  where not (b = 3 and p_partkey > (select max(p_partkey) * 0.6 from part)) and not (b = 4 and p_partkey % 50 = 7) and not (r = 2 and p_partkey % 11 = 5)) y
"""
CALLS = """
select concat('m', cast(user_id % 5 as string)) as backend, event_id, ts, case when event_type = 'error' then 0 else 1 end as ok, value as latency_s,
 case when event_type <> 'error' then null when event_id % 4 = 0 then 'ReadTimeout' when event_id % 4 = 1 then 'JudgeResponseError' when event_id % 4 = 2 then 'HTTPStatusError' else 'QuotaExhausted' end as error_kind,
 cast(floor((event_id % 10000) / 4000.0) as bigint) as launch from events
"""
#: The seventh backend has no rows.
ROSTER = "select concat('m', cast(i as string)) as backend from (select 0 as i union all select 1 union all select 2 union all select 3 union all select 4 union all select 5 union all select 6) s"
#: Vote counts of every size, on natural data.
LINE_VOTES = """
select cast(l_suppkey % 4 as string) as backend, cast(l_partkey as string) as pair_id, case when l_returnflag = 'R' then 'reject' else 'approve' end as verdict,
 case when l_returnflag <> 'R' then 'ok' when l_linestatus = 'O' then 'casing_error' else 'overcorrection' end as reason from lineitem
"""
#: As the views have it.
PAIR_ID = "concat('p', lpad(cast(p_partkey as string), 7, '0'))"
#: Parts in a task: a part gives up to 18 votes, so its table is small for what is made of it, a file that one task reads.
PARTS = 32_768
VIEWS = {"pairs": PAIRS, "votes": VOTES, "calls": CALLS, "roster": ROSTER, "line_votes": LINE_VOTES}
TABLES = ("part", "events", "lineitem", "labels", "pages", "conversations", "orders", "customer", "nation")


def spread(part: DataFrame) -> DataFrame:
    """The parts dealt by the id of their pair to as many tasks as there are `PARTS`; few stay where they are.

    Votes, pairs and what is grouped or joined by pair then stand in these tasks already.
    """
    n = -(-part.count() // PARTS)
    return part.repartition(n, F.expr(PAIR_ID)) if n > 1 else part


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """The tasks that votes and pairs stand in."""
    return max(1, -(-table(spark, sf_dir, "part").count() // PARTS))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view by name; only the tables its SQL names are read."""
    sql = VIEWS[name]
    for table in TABLES:
        if f"from {table}" in " ".join(sql.split()):
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            (spread(rows) if table == "part" else rows).createOrReplaceTempView(table)
    return spark.sql(sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """Oracle SQL with the views it uses spelled out in front."""
    used = [n for n in VIEWS if f" {n} " in f" {' '.join(sql.split())} ".replace(")", " ").replace(",", " ").replace("(", " ")]
    if not used:
        return sql
    heads = ", ".join(f"{n} as ({VIEWS[n].strip()})" for n in used)
    body = sql.strip()
    if body.startswith("with recursive "):
        return f"with recursive {heads}, {body[15:]}"
    return f"with {heads}, {body[5:]}" if body.startswith("with ") else f"with {heads} {body}"
