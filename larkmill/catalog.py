"""What the engine knows by name, kept as JSON in the engine's folder."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from larkmill.errors import CatalogProblem
from larkmill.sources import files

#: Kinds of entities that need nothing but their properties.
KINDS = (
    "tables", "views", "materialized_views", "data_quality_rules", "pipelines", "topics", "streams", "consumer_groups", "connectors", "storage_units", "nodes", "clusters", "shard_groups", "replica_groups",
    "models", "feature_sets", "datasets", "training_jobs", "tuning_jobs", "model_templates",
)


class Catalog:
    """entries[kind][name] is a dict of properties; tables and views are by database first."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.path = spark, f"{root}/catalog.json"
        stored = files.read_text(spark, self.path)
        self.entries: dict = json.loads(stored) if stored else {}
        for k in KINDS:
            self.entries.setdefault(k, {"default": {}} if k in ("tables", "views", "materialized_views") else {})
        self.entries.setdefault("runs", [])
        self.entries.setdefault("task_runs", [])

    def save(self) -> None:
        files.write_text(self.spark, self.path, json.dumps(self.entries))

    def of(self, kind: str) -> dict:
        return self.entries[kind]

    def need(self, kind: str, name: str) -> dict:
        found = self.entries[kind].get(name)
        if found is None:
            raise CatalogProblem(f"Unknown {kind.rstrip('s')} {name}")
        return found

    def add(self, kind: str, name: str, properties: dict, if_not_exists: bool = False) -> bool:
        """Whether it is new."""
        if name in self.entries[kind]:
            if if_not_exists:
                return False
            raise CatalogProblem(f"{kind.rstrip('s')} {name} exists")
        self.entries[kind][name] = properties
        return True

    def remove(self, kind: str, name: str, if_exists: bool = False) -> dict | None:
        if name not in self.entries[kind]:
            if if_exists:
                return None
            raise CatalogProblem(f"Unknown {kind.rstrip('s')} {name}")
        return self.entries[kind].pop(name)
