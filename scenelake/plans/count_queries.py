"""Counts and health roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.operators import catalog as cat
from scenelake.operators import counts, workers
from scenelake.plans import oracle_parts as o
from scenelake.plans.registry import query
from scenelake.plans.tables import AS_OF, Catalog

_OPEN = "status not in ('completed','failed','poisoned')"


@query("proxyable_pending", f"""select library_id, count(*) as pending, count(*) filter ({o.IS_MEDIA}) as pending_proxyable
from asset where status='pending' and {o.LIVE} group by 1""")
def proxyable_pending(c: Catalog) -> DataFrame:
    return counts.pending_counts(c.asset, c.library)


@query("catalog_stats", f"""select count(*) as total_assets, count(*) filter (status='pending') as pending_assets,
  count(*) filter ({_OPEN}) as pending_ai_count, count(*) filter ({_OPEN})>0 or
  exists(select 1 from library where deleted_epoch is null and scan_status='scanning') as is_analyzing from asset""")
def catalog_stats(c: Catalog) -> DataFrame:
    return counts.catalog_stats(c.asset, c.library)


_STATUS = f"""select slug, coalesce(name,slug) as name, coalesce(n,0) as pending_ai, scan_status='scanning' or coalesce(n,0)>0 as is_analyzing
from library left join (select library_id, count(*) filter ({_OPEN}) as n from asset group by 1) a on a.library_id=slug
where deleted_epoch is null"""


@query("library_status", "select s.*, (select coalesce(bool_or(is_analyzing),false) from st where slug in ('src1','src2')) as incomplete from st s", {"st": _STATUS})
def library_status(c: Catalog) -> DataFrame:
    """Live libraries, with the flag a search over two of them would carry."""
    flag = counts.any_analyzing(c.asset, c.library, ["src1", "src2"]).scalar()
    return counts.library_status(c.asset, c.library).withColumn("incomplete", flag)


@query("model_usage", """select name, (select count(*) from asset a join aimodel m on m.id=a.analysis_model_id where m.name=n.name) as assets
from (select distinct name from aimodel) n""")
def model_usage(c: Catalog) -> DataFrame:
    return cat.model_usage(c.aimodel, c.asset)


@query("removable_models", """select id, name, version from aimodel m where exists
(select 1 from asset a join aimodel x on x.id=a.analysis_model_id where x.name=m.name)""")
def removable_models(c: Catalog) -> DataFrame:
    """Registry after asking to remove every model: those in use stay."""
    return cat.remove_models(c.aimodel, c.asset, c.aimodel.select("name").distinct()).select("id", "name", "version")


@query("stale_leases", f"select library_id, count(*) as stale_leases from asset where status='processing' and lease_epoch<{AS_OF} group by 1")
def stale_leases(c: Catalog) -> DataFrame:
    return counts.stale_leases(c.asset, AS_OF)


@query("latest_heartbeat", "select worker_id, hostname, seen_epoch, state, stage from worker")
def latest_heartbeat(c: Catalog) -> DataFrame:
    rows = workers.latest_heartbeat(c.heartbeat)
    return rows.select(
        "worker_id", "hostname", F.unix_seconds("last_seen_at").alias("seen_epoch"), "state",
        F.col("stats")["current_stage"].alias("stage"),
    )


@query("stale_workers", f"""select worker_id, state, seen_epoch, (select count(*) from worker where seen_epoch<{AS_OF}-86400) as pruned
from worker where seen_epoch>={AS_OF}-86400""")
def stale_workers(c: Catalog) -> DataFrame:
    """Workers left after pruning, and how many went."""
    gone = workers.count_stale_workers(c.worker, AS_OF).scalar()
    kept = workers.prune_stale_workers(c.worker, AS_OF)
    return kept.select("worker_id", "state", F.unix_seconds("last_seen_at").alias("seen_epoch"), gone.alias("pruned"))


@query("active_workers", f"""select w.worker_id, w.hostname, (select count(*) from worker p where p.hostname=w.hostname and p.worker_id<>w.worker_id
  and p.state<>'offline' and p.seen_epoch>={AS_OF}-60) as active_peers from worker w""")
def active_workers(c: Catalog) -> DataFrame:
    return workers.active_peers(c.worker, AS_OF)


@query("active_transcodes", f"""select distinct hostname from worker w join asset a on a.worker_id=w.worker_id
where w.state<>'offline' and w.seen_epoch>={AS_OF}-120 and w.stage='transcode' and a.status='processing' and a.lease_epoch>{AS_OF}""")
def active_transcodes(c: Catalog) -> DataFrame:
    return workers.active_transcodes(c.worker, c.asset, AS_OF)


@query("fleet_health", f"""select case when a>0 then 'healthy' else 'degraded' end as status,
  case when a=1 then '1 worker active' when a>0 then a||' workers active' when s>0 then 'all workers are stale, the latest seen '||({AS_OF}-latest)||'s before'
  else 'no worker is known' end as detail, a as active_count, s as stale_count
from (select count(*) filter (seen_epoch>={AS_OF}-60) as a, count(*) filter (seen_epoch<{AS_OF}-60) as s, max(seen_epoch) as latest from worker) q""")
def fleet_health(c: Catalog) -> DataFrame:
    return workers.fleet_health(c.worker, AS_OF)
