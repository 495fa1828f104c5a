"""Who may see what: clearance of callers, scoped connections, sharing between tenants, small lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matched(nodes: DataFrame, limit: int | None = None, columns: list[str] | None = None, **equal) -> DataFrame:  # noqa: ANN003
    """Nodes whose columns have the values named, by id; a value None asks for null. Only the columns asked for are read."""
    conditions = [F.col(c).isNull() if v is None else F.col(c) == F.lit(v) for c, v in equal.items()]
    found = nodes.where(reduce(Column.__and__, conditions)) if conditions else nodes
    found = found.select(*columns) if columns else found
    return found.orderBy("id").limit(limit) if limit else found


def without_vectors(nodes: DataFrame, agent: str) -> DataFrame:
    """All nodes of a tenant without their vectors, which the scan then does not read."""
    return nodes.where(F.col("agent_id") == agent).drop("embedding")


def recent(nodes: DataFrame, agent: str, limit: int = 20) -> DataFrame:
    """The last created nodes of a tenant (1 to 200), ties by id; those without a time are left out."""
    return nodes.where((F.col("agent_id") == agent) & F.col("created_at").isNotNull()).orderBy(F.desc("created_at"), "id").limit(max(1, min(200, limit)))


def split_facts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The facts, and the entities."""
    fact = F.coalesce(F.col("type") == "FACT", F.lit(False))
    return found.where(fact), found.where(~fact)


def of_types(nodes: DataFrame, types: list[str] | None) -> DataFrame:
    """Nodes of the types in any case, all without types; edges are not looked at."""
    return nodes.where(F.lower("type").isin(*[t.lower() for t in types])) if types else nodes


def caller_clearance(callers: DataFrame, agents: DataFrame, default: int = 1, closed: bool = False) -> DataFrame:
    """callers with clearance, that of their agent (agent_id, clearance_level).

    Open: an unknown agent or a missing level counts as default. Closed: only levels from 1 to 5 count, all else is 0.
    """
    level = F.col("clearance_level").cast("int")
    resolved = F.when(level.between(1, 5), level).otherwise(F.lit(0)) if closed else F.coalesce(level, F.lit(default))
    known = agents.groupBy("agent_id").agg(F.min("clearance_level").alias("clearance_level"))  # of an agent that repeats the least counts
    return callers.join(known, "agent_id", "left").withColumn("clearance", F.coalesce(resolved, F.lit(0 if closed else default))).drop("clearance_level")


def active_connections(connections: DataFrame, now: Column) -> DataFrame:
    """Connections that are active and have not expired."""
    return connections.where(F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def allowed_pairs(requests: DataFrame, connections: DataFrame, now: Column) -> DataFrame:
    """requests (source_agent_id, target_agent_id) with allowed: whether a live connection leads from one to the other."""
    live = active_connections(connections, now).select("source_agent_id", "target_agent_id").distinct().withColumn("_live", F.lit(True))
    return requests.join(live, ["source_agent_id", "target_agent_id"], "left").withColumn("allowed", F.coalesce("_live", F.lit(False))).drop("_live")


def connections_of(connections: DataFrame, agent: str) -> DataFrame:
    """The active connections from or to an agent, the newest first."""
    mine = (F.col("source_agent_id") == agent) | (F.col("target_agent_id") == agent)
    return connections.where(mine & F.col("active")).orderBy(F.desc("created_at"), "id")


def revoked(connections: DataFrame, ids: list[str], now: Column) -> DataFrame:
    """connections, those of ids no longer active, with revoked_at."""
    hit = F.col("id").isin(*ids)
    old = F.col("revoked_at") if "revoked_at" in connections.columns else F.lit(None).cast("timestamp")
    return connections.withColumns({"revoked_at": F.when(hit, now).otherwise(old), "active": F.col("active") & ~hit})


def shared_with(agents: DataFrame, links: DataFrame) -> DataFrame:
    """agent_id, allowed: each agent itself and those that its outgoing links (source, target) lead to."""
    own = agents.select("agent_id", F.col("agent_id").alias("allowed"))
    return own.unionByName(links.select(F.col("source").alias("agent_id"), F.col("target").alias("allowed")).join(agents.select("agent_id"), "agent_id", "left_semi")).distinct()
