"""SHOW and DESCRIBE: lists of the catalog with fixed columns."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkmill.errors import CatalogProblem, PlanProblem
from larkmill.functions.kinds import name_of
from larkmill.sources import connectors, files
from larkmill.sql.tree import Statement

if TYPE_CHECKING:
    from larkmill.session import Engine

RULE = ("name", "table", "check", "column", "expression", "action", "min", "max", "min_rows", "last_status", "last_violations", "last_message")


def _rule(name: str, r: dict) -> list:
    return [name, *("" if r[k] is None and k != "last_violations" else r[k] for k in RULE[1:])]


def show(e: Engine, s: Statement) -> DataFrame:
    maker = globals().get(f"_{s.entity}")
    if maker is None:
        raise PlanProblem(f"SHOW {s.entity.upper()} is not supported")
    names, rows, *types = maker(e, s.name)
    return e.rows(names.split(), rows, types[0] if types else None)


def _databases(e, _):
    return "databases", [[d] for d in sorted(e.catalog.of("tables"))]


def _tables(e, name):
    return "name", [[t] for t in sorted(e.catalog.of("tables").get(name or e.database, {})) if not t.startswith("_mv_")]


def _views(e, name):
    return "name", [[t] for t in sorted(e.catalog.of("views").get(name or e.database, {}))]


def _materialized_views(e, name):
    return "name status refresh refresh_interval_seconds last_refreshed_at last_error", [[n, v["status"], "EVERY" if v["interval"] else "MANUAL", v["interval"], v["refreshed"], v["error"]] for n, v in sorted(e.catalog.of("materialized_views").get(e.database, {}).items())]


def _storage_units(e, _):
    return "name type status retention", [[n, u["type"], "ONLINE", u["retention"]] for n, u in sorted(e.catalog.of("storage_units").items())]


def _storage_usage(e, _):
    rows = []
    for n, u in sorted(e.catalog.of("storage_units").items()):
        used = files.size(e.spark, u["path"]) if u["type"] == "LOCAL" else 0
        status = e.spark._jvm.org.apache.hadoop.fs.Path(u["path"]).getFileSystem(e.spark._jsc.hadoopConfiguration()).getStatus() if u["type"] == "LOCAL" else None
        total, free = (status.getCapacity(), status.getRemaining()) if status else (0, 0)
        rows.append([n, total, used, free, round(100 * used / total, 2) if total else 0])
    return "name total_bytes used_bytes available_bytes used_pct", rows


def _connectors(e, _):
    return "name type status", [[n, c["type"], "ACTIVE"] for n, c in sorted(e.catalog.of("connectors").items())]


def _one_or_all(e, kind, name):
    return [(name, e.catalog.need(kind, name))] if name else sorted(e.catalog.of(kind).items())


def _connector_capabilities(e, name):
    return "name capability", [[n, x] for n, c in _one_or_all(e, "connectors", name) for x in connectors.CAPABILITIES[c["type"]]]


def _connector_status(e, name):
    return "name status last_test_ok last_test_latency_ms last_test_message", [[n, "ACTIVE", *([str(c["last"][0]).lower(), f"{c['last'][1]:.1f}", c["last"][2]] if c["last"] else ["", "", ""])] for n, c in _one_or_all(e, "connectors", name)]


def _nodes(e, _):
    return "name type role status host", [[n, x.get("type", ""), x.get("role", ""), x.get("status", ""), x.get("host", "")] for n, x in sorted(e.catalog.of("nodes").items())]


def _node_metrics(e, name):
    return "name cpu_utilization_pct memory_used_bytes query_throughput", [[n, x.get("cpu", 0), x.get("memory", 0), x.get("queries", 0)] for n, x in _one_or_all(e, "nodes", name)]


def _node_capabilities(e, name):
    return "name capabilities", [[n, x.get("capabilities", x.get("type", ""))] for n, x in _one_or_all(e, "nodes", name)]


def _node_partitions(e, name):
    return "node partition_id", [[node, f"{g}_{i}"] for g in sorted(e.catalog.of("shard_groups")) for i, node, _ in e.topology.shards(g) if node and name in ("", node)]


def _node_replicas(e, name):
    return "node replica_id", [[node, f"{g}_{i}"] for g in sorted(e.catalog.of("replica_groups")) for i, node, _, _ in e.topology.replicas(g) if node and name in ("", node)]


def _clusters(e, _):
    return "name status node_count", [[n, e.topology.cluster_status(n)[0], len(c["nodes"])] for n, c in sorted(e.catalog.of("clusters").items())]


def _cluster_status(e, name):
    return "name status node_count online offline", [[n, status, len(c["nodes"]), up, down] for n, c in _one_or_all(e, "clusters", name) for status, up, down in [e.topology.cluster_status(n)]]


def _cluster_metrics(e, name):
    names = "name node_count cpu_cores cpu_utilization_pct memory_bytes memory_used_bytes storage_bytes storage_used_bytes gpu_count query_throughput pipeline_throughput stream_throughput"
    return names, [[n, len(c["nodes"]), *[0] * 10] for n, c in _one_or_all(e, "clusters", name)]


def _replica_groups(e, _):
    return "name replication_factor consistency status", [[n, g["replicas"], g["consistency"], "ONLINE" if len(g["nodes"]) >= g["replicas"] else "DEGRADED"] for n, g in sorted(e.catalog.of("replica_groups").items())]


def _replication_status(e, name):
    return "replica_group replica_id node_id role state lag_ms", [[n, *r, 0] for n, _ in _one_or_all(e, "replica_groups", name) for r in e.topology.replicas(n)]


def _shard_groups(e, _):
    return "name type shard_count shard_key status", [[n, g["type"], g["shards"], g["key"], "ACTIVE"] for n, g in sorted(e.catalog.of("shard_groups").items())]


def _shards(e, name):
    return "shard_group shard_id node_id state", [[n, *r] for n, _ in _one_or_all(e, "shard_groups", name) for r in e.topology.shards(n)]


def _shard_status(e, name):
    return "shard_group shard_id node_id state row_count size_bytes", [[n, *r, 0, 0] for n, _ in _one_or_all(e, "shard_groups", name) for r in e.topology.shards(n)]


def _pipelines(e, _):
    return "name status owner", [[n, p["status"], p["owner"]] for n, p in sorted(e.catalog.of("pipelines").items())]


def _stages(e, name):
    return "name stage_order task_count", [[n, x["order"], sum(t["stage"] == n for t in p["tasks"].values())] for _, p in _one_or_all(e, "pipelines", name) for n, x in sorted(p["stages"].items(), key=lambda x: (x[1]["order"], x[0]))]


def _tasks(e, name):
    return "name stage type depends_on", [[n, t["stage"], t["type"], ",".join(t["depends_on"])] for _, p in _one_or_all(e, "pipelines", name) for n, t in sorted(p["tasks"].items())]


def _triggers(e, name):
    return "name type schedule", [[n, t["type"], t.get("schedule", "***" if t.get("secret") else "")] for _, p in _one_or_all(e, "pipelines", name) for n, t in sorted(p["triggers"].items())]


def _pipeline_runs(e, name):
    if name:
        e.pipelines.need(name)
    return "run_id pipeline trigger status duration_ms", [[r[k] for k in ("run_id", "pipeline", "trigger", "status", "duration_ms")] for r in e.catalog.of("runs") if name in ("", r["pipeline"])]


def _task_runs(e, name):
    if name:
        e.pipelines.need(name)
    names = "run_id pipeline stage task status duration_ms started_at error detail"
    return names, [[r[k] for k in names.split()] for r in e.catalog.of("task_runs") if name in ("", r["pipeline"])]


def _pipeline_metrics(e, name):
    rows = []
    for n, _ in _one_or_all(e, "pipelines", name):
        runs = [r for r in e.catalog.of("runs") if r["pipeline"] == n]
        k = max(1, len(runs))
        rows.append([n, len(runs), round(100 * sum(r["status"] == "SUCCESS" for r in runs) / k, 2), round(sum(r["duration_ms"] for r in runs) / k, 2)])
    return "pipeline run_count success_rate_pct avg_duration_ms", rows


def _streams(e, _):
    return "name status topic event_count", [[n, "ACTIVE", x["topic"], x["next"]] for n, x in sorted(e.catalog.of("streams").items())]


def _topics(e, _):
    return "name partition_count retention", [[n, t["partitions"], t["retention"]] for n, t in sorted(e.catalog.of("topics").items())]


def _consumer_groups(e, _):
    return "name offsets", [[n, ",".join(f"{k}:{v}" for k, v in sorted(g["offsets"].items()))] for n, g in sorted(e.catalog.of("consumer_groups").items())]


def _stream_metrics(e, name):
    """The lag is that of the slowest group that reads the stream; without one, all events."""
    rows = []
    for n, x in _one_or_all(e, "streams", name):
        read = [g["offsets"][n] for g in e.catalog.of("consumer_groups").values() if n in g["offsets"]]
        rows.append([n, x["next"], x["next"] - min(read, default=0)])
    return "stream event_count consumer_lag", rows


_consumer_lag = _stream_metrics


def _models(e, _):
    return "name type status latest_version", [[n, m["type"], m["status"], f"v{len(m['versions'])}" if m["versions"] else ""] for n, m in sorted(e.catalog.of("models").items())]


def _model_versions(e, name):
    return "model version run_id artifact metrics", [[n, v, x["run_id"], x["artifact"], json.dumps(x["metrics"])] for n, m in _one_or_all(e, "models", name) for v, x in m["versions"].items()]


def _model_endpoints(e, name):
    return "endpoint model version status", [[k, n, x["version"], x["status"]] for n, m in _one_or_all(e, "models", name) for k, x in sorted(m["endpoints"].items())]


def _model_metrics(e, name):
    return "model endpoint prediction_count failure_count avg_latency_ms", [[n, k, x["predictions"], x["failures"], x["ms"]] for n, m in _one_or_all(e, "models", name) for k, x in sorted(m["endpoints"].items())]


def _model_drift(e, name):
    return "model note", [[n, "drift is not tracked"] for n, _ in _one_or_all(e, "models", name)]


def _feature_sets(e, _):
    return "name source_table entity_key features target version", [[n, f["source"], f["entity_key"], ",".join(f["features"]), f["target"] or "", f["version"]] for n, f in sorted(e.catalog.of("feature_sets").items())]


def _datasets(e, _):
    return "name source version", [[n, d["source"], d["version"]] for n, d in sorted(e.catalog.of("datasets").items())]


def _training_jobs(e, _):
    return "name model feature_set framework algorithm", [[n, *(j[k] for k in ("model", "feature_set", "framework", "algorithm"))] for n, j in sorted(e.catalog.of("training_jobs").items())]


def _tuning_jobs(e, _):
    return "name model strategy objective trials", [[n, *(j[k] for k in ("model", "strategy", "objective", "trials"))] for n, j in sorted(e.catalog.of("tuning_jobs").items())]


def _model_templates(e, _):
    return "name framework algorithm", [[n, j["framework"], j["algorithm"]] for n, j in sorted(e.catalog.of("model_templates").items())]


def _data_quality_rules(e, _):
    return " ".join(RULE), [_rule(n, r) for n, r in sorted(e.catalog.of("data_quality_rules").items())], {"last_violations": T.LongType()}


def describe(e: Engine, s: Statement) -> DataFrame:
    """Columns and types of a table or view; (field, value) of anything else."""
    if s.entity in ("table", "view", "materialized_view"):
        if s.entity != "table" and s.name not in e.catalog.of(f"{s.entity}s").get(s.database or e.database, {}):
            raise CatalogProblem(f"Unknown {s.entity} {s.name}")
        declared = e.tables.entry(s.database or e.database, s.name)
        if declared:
            return e.rows(["name", "type"], declared["columns"])
        return e.rows(["name", "type"], [[f.name, name_of(f.dataType)] for f in e.open(s.database, s.name).schema])
    if s.entity == "database":
        e.catalog.need("tables", s.name)
        return e.rows(["field", "value"], [["name", s.name], ["tables", len(e.catalog.of("tables")[s.name])]])
    if s.entity == "data_quality_rule":
        return e.rows(list(RULE), [_rule(s.name, e.catalog.need("data_quality_rules", s.name))], {"last_violations": T.LongType()})
    if s.entity in ("stage", "task", "trigger"):
        found = e.pipelines.need(s.clauses.get("pipeline", ""))[f"{s.entity}s"].get(s.name)
        if found is None:
            raise CatalogProblem(f"Unknown {s.entity} {s.name}")
    else:
        found = e.catalog.need(f"{s.entity}s", s.name)
    rows = [["name", s.name]]
    for k, v in found.items():
        if k in connectors.SECRET and v:
            v = "***"
        if isinstance(v, dict):
            v = len(v) if s.entity == "pipeline" else json.dumps(v)
        rows.append([k, ",".join(map(str, v)) if isinstance(v, list) else v])
    if s.entity == "stream":
        rows.append(["event_count", found["next"]])
    if s.entity == "cluster":
        status, up, down = e.topology.cluster_status(s.name)
        rows += [["status", status], ["node_count", up + down], ["online", up], ["offline", down]]
    return e.rows(["field", "value"], rows)
