"""Refresh of rollups that read one another, each written once."""

from __future__ import annotations

from collections.abc import Callable
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from lodestar.sources import files

#: name -> (names of the rollups that it reads, builder from the written ones)
Registry = dict[str, tuple[tuple[str, ...], Callable[[dict[str, DataFrame]], DataFrame]]]


def unrefreshed(spark: SparkSession, registry: Registry, path: str) -> list[str]:
    """Rollups that are built under path, but that no refresh would renew, because they aren't registered."""
    return [n for n in files.names(spark, path) if n[0] not in "_." and n not in registry]


def rollup_refresh(spark: SparkSession, registry: Registry, base: dict[str, DataFrame], path: str, guard: bool = False) -> list[str]:
    """Write every rollup under path after those that it reads, and return the order. A builder sees only what it declares. With guard,
    a rollup that is built under path but not registered is an error, before anything is written."""
    unknown = {d for deps, _ in registry.values() for d in deps} - registry.keys() - base.keys()
    if unknown:
        raise ValueError(f"rollups read {sorted(unknown)}, which are neither registered nor given")
    if guard and (stale := unrefreshed(spark, registry, path)):
        raise ValueError(f"{stale} are built in {path}, but nothing refreshes them")
    order = [n for n in TopologicalSorter({n: [d for d in deps if d in registry] for n, (deps, _) in registry.items()}).static_order()]
    for name in order:
        deps, build = registry[name]
        seen = {d: base[d] if d in base else spark.read.parquet(f"{path}/{d}") for d in deps}
        build(seen).write.mode("overwrite").parquet(f"{path}/{name}")
    return order
