"""Tenants, roles, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("caller", "operator", "admin")


def role_level(role: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.lower(role))


def allowed(role: Column, needed: Column) -> Column:
    """A role may do what a lesser one may; unknown roles may nothing."""
    return (role_level(role) > 0) & (role_level(role) >= role_level(needed)) & (role_level(needed) > 0)


def with_overrides(df: DataFrame, tenants: DataFrame, defaults: dict[str, object], key: str = "tenant") -> DataFrame:
    """The rows with each setting of their tenant, or its default."""
    settings = tenants.select(key, *[F.col(c).alias(f"__{c}") for c in defaults])
    joined = df.join(settings, key, "left")
    for c, value in defaults.items():
        joined = joined.withColumn(c, F.coalesce(F.col(f"__{c}"), F.lit(value))).drop(f"__{c}")
    return joined


def mapped_tenant(df: DataFrame, mapping: DataFrame, claims: str = "claims", claim: str = "claim") -> tuple[DataFrame, DataFrame]:
    """(rows with the tenant of their first mapped claim, rows without one)."""
    keyed = df.withColumn("__k", F.xxhash64(*df.columns))
    hits = keyed.select("__k", F.posexplode(claims).alias("__i", claim)).join(mapping, claim)
    first = hits.groupBy("__k").agg(F.min_by(F.struct(*[c for c in mapping.columns if c != claim]), "__i").alias("m"))
    return keyed.join(first, "__k").select(*df.columns, "m.*"), keyed.join(first, "__k", "left_anti").drop("__k")


def sessions(df: DataFrame, key: str, at: str, tie: str, idle_seconds: int = 1800) -> DataFrame:
    """Adds session_no: a new session starts when the last event is more than the idle time ago."""
    order = Window.partitionBy(key).orderBy(at, tie)
    gap = F.unix_micros(at) - F.unix_micros(F.lag(at).over(order))
    return df.withColumn("__new", F.when(gap.isNull() | (gap > idle_seconds * 1_000_000), 1).otherwise(0)).withColumn("session_no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def client_ip(header: Column) -> Column:
    return F.trim(F.get(F.split(header, ","), 0))
