"""Temporary bases of knowledge: manifests with a time to live, accesses that prolong it, clean-up with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_MINUTES = 120


def _minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"), F.lit(0))


def normal_manifests(raw: DataFrame, ttl: int = TTL_MINUTES, touch: bool = True) -> DataFrame:
    """Manifests as they are written, all fields strings, with types and defaults: an access is the creation, expiry follows the
    last access, a time to live below a minute or none at all is the default."""
    at = lambda name: F.try_to_timestamp(F.nullif(F.trim(name), F.lit("")))
    number = F.col("ttl_minutes").try_cast("int")
    rows = raw.select(
        "knowledge_id",
        F.coalesce(at("created_at"), F.col("modified_at")).alias("created_at"),
        at("last_accessed_at").alias("last_accessed_at"),
        at("expires_at").alias("expires_at"),
        F.when(number >= 1, number).otherwise(ttl).alias("ttl_minutes"),
        F.when(F.col("touch_on_access").isNull(), touch).otherwise(F.lower(F.trim("touch_on_access")).isin("1", "true", "yes", "on")).alias("touch_on_access"),
        F.coalesce(F.nullif("cleanup_state", F.lit("")), F.lit("active")).alias("cleanup_state"),
    )
    rows = rows.withColumn("last_accessed_at", F.coalesce("last_accessed_at", "created_at"))
    return rows.withColumn("expires_at", F.coalesce("expires_at", F.col("last_accessed_at") + _minutes(F.col("ttl_minutes"))))


def access(manifests: DataFrame, accesses: DataFrame) -> DataFrame:
    """accesses (knowledge_id, at) in their order with a status: ok, expired_on_access (the first one too late) or gone, and
    when the base expires after it. An access that is in time prolongs the life of a base that has touch_on_access."""
    rows = accesses.join(manifests, "knowledge_id")
    order = Window.partitionBy("knowledge_id").orderBy("at")
    life = _minutes(F.col("ttl_minutes"))
    before = F.lag("at").over(order)
    until = F.when(F.col("touch_on_access") & before.isNotNull(), before + life).otherwise(F.col("expires_at"))
    # once too late, whatever comes is; until then the one before prolonged it
    rows = rows.withColumn("_late", (F.col("cleanup_state") == "disabled") | (until <= F.col("at")))
    rows = rows.withColumn("_dead", F.sum(F.col("_late").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)) > 0)
    gone = F.coalesce("_dead", F.lit(False)) | (F.col("cleanup_state") == "disabled")
    status = F.when(gone, "gone").when(F.col("_late"), "expired_on_access").otherwise("ok")
    expires = F.when((status == "ok") & F.col("touch_on_access"), F.col("at") + life).when(status == "ok", F.col("expires_at"))
    return rows.select("knowledge_id", "at", status.alias("status"), expires.alias("expires_at"))


def clean_up(manifests: DataFrame, now: Column, expired_only: bool = True, reason: str = "manual") -> DataFrame:
    """What a clean-up does with each base: expired, removed and why."""
    expired = F.col("expires_at") <= now
    why = F.when(expired, "expired").otherwise("not_expired" if expired_only else reason)
    return manifests.select("knowledge_id", expired.alias("expired"), (expired | F.lit(not expired_only)).alias("removed"), why.alias("reason"))
