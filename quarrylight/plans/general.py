"""Queries of the general corpus problems (incremental runs, snapshot differences) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylight.operators.incremental import replay
from quarrylight.operators.snapshot_diff import manifest_changes
from quarrylight.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return replay(spark, table(spark, d, "file_entries"), table(spark, d, "sync_runs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return manifest_changes(table(spark, d, "manifest_snapshots"), table(spark, d, "sync_runs"))


QUERIES = {"p4_found": p4_found, "p5_found": p5_found}

_RUNS = """ok as (select run_id, root, started_at, row_number() over (partition by root order by started_at, run_id) as k
  from (select distinct run_id, root, started_at from sync_runs where status = 'indexed'))"""

SQL = {
    "p4_found": f"""with {_RUNS},
seen as (select o.run_id, o.root, o.k, f.rel_path, lower(f.hash) as h,
    row_number() over (partition by o.run_id, o.root, f.rel_path order by f.seen_at desc, f.obs_id desc) as r
  from ok o join file_entries f on f.root = o.root and f.loaded_at <= o.started_at and f.hash is not null),
st as (select * from seen where r = 1)
select a.run_id, a.root, a.rel_path from st a
left join st b on b.root = a.root and b.rel_path = a.rel_path and b.k = a.k - 1
where a.k > 1 and (b.h is null or b.h <> a.h)""",
    "p5_found": f"""with {_RUNS},
n as (select root, max(k) as n from ok group by root),
m as (select o.root, o.k, regexp_replace(s.rel_path, '^(\\./)+', '') as rel_path, max(lower(s.hash)) as h
  from manifest_snapshots s join ok o on o.run_id = s.run_id and o.root = s.root group by 1, 2, 3),
i as (select *, k - row_number() over (partition by root, rel_path order by k) as island from m),
e as (select root, k, rel_path, last_value(h ignore nulls) over (partition by root, rel_path, island order by k) as h from i),
p as (select * from e where h is not null),
c as (
  select b.root, b.k, b.rel_path, case when a.h is null then 'Added' else 'Modified' end as change_type
  from p b left join p a on a.root = b.root and a.rel_path = b.rel_path and a.k = b.k - 1
  where b.k > 1 and (a.h is null or a.h <> b.h)
  union all
  select a.root, a.k + 1, a.rel_path, 'Deleted'
  from p a join n on n.root = a.root left join p b on b.root = a.root and b.rel_path = a.rel_path and b.k = a.k + 1
  where a.k < n.n and b.h is null)
select o.run_id, c.root, c.rel_path, c.change_type from c join ok o on o.root = c.root and o.k = c.k""",
}
