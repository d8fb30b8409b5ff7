"""Connectors: REST both ways; PostgreSQL and S3 by Spark's own sources."""

from __future__ import annotations

import json
import time
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkmill.errors import EngineError

#: Properties that a type needs, and those that are shown as ***.
NEEDED = {"REST": ("base_url",), "POSTGRES": ("host", "database", "user"), "S3": ("bucket",)}
SECRET = ("password", "api_key", "token", "secret", "secret_key", "access_key", "client_secret")
CAPABILITIES = {"REST": ("READ", "WRITE", "DISCOVER", "TEST"), "POSTGRES": ("READ", "WRITE", "TEST"), "S3": ("READ", "WRITE", "TEST")}
AUTH = ("NONE", "API_KEY", "BASIC", "BEARER", "OAUTH2", "IAM", "CERTIFICATE")
MODES = ("APPEND", "OVERWRITE")


class ConnectorProblem(EngineError):
    """The other side did not answer as hoped."""


def url(c: dict, resource: str | None) -> str:
    return c["base_url"].rstrip("/") + (f"/{resource}" if resource else "")


def _request(c: dict, resource: str | None, method: str = "GET", body: bytes | None = None, timeout: float = 30) -> bytes:
    headers = {"Accept": "application/json", "Content-Type": "application/json"}
    auth = str(c.get("auth", "NONE")).upper()
    if auth == "API_KEY":
        headers["X-API-Key"] = str(c.get("api_key", ""))
    elif auth in ("BEARER", "OAUTH2"):
        headers["Authorization"] = f"Bearer {c.get('token', '')}"
    elif auth == "BASIC":
        from base64 import b64encode

        headers["Authorization"] = "Basic " + b64encode(f"{c.get('user', '')}:{c.get('password', '')}".encode()).decode()
    try:
        with urlopen(Request(url(c, resource), body, headers, method=method), timeout=timeout) as r:
            return r.read()
    except (HTTPError, URLError, OSError) as e:
        raise ConnectorProblem(f"{method} {url(c, resource)} failed: {e}") from e


def test(c: dict) -> tuple[bool, float, str]:
    """(ok, milliseconds, message)"""
    began = time.monotonic()
    if c["type"] != "REST":
        return True, 0.0, f"{c['type']} properties are complete"
    try:
        _request(c, None, timeout=5)
        return True, (time.monotonic() - began) * 1000, "OK"
    except ConnectorProblem as e:
        if isinstance(e.__cause__, HTTPError):
            return True, (time.monotonic() - began) * 1000, f"HTTP {e.__cause__.code}"
        return False, (time.monotonic() - began) * 1000, str(e)


def discover(c: dict) -> list[str]:
    """The resources: those that the connector lists, else the keys of the root's JSON object."""
    if c.get("schema"):
        return [x.strip() for x in str(c["schema"]).split(",") if x.strip()]
    if c["type"] != "REST":
        raise ConnectorProblem(f"{c['type']} connectors do not list their resources")
    root = json.loads(_request(c, None))
    return sorted(root) if isinstance(root, dict) else []


def read(spark: SparkSession, c: dict, resource: str, limit: int | None) -> DataFrame:
    """REST: an array of flat objects as text columns, sorted by name, those of the first object."""
    if c["type"] == "POSTGRES":
        at = f"jdbc:postgresql://{c['host']}:{c.get('port', 5432)}/{c['database']}"
        return spark.read.format("jdbc").options(url=at, dbtable=resource, user=c.get("user", ""), password=c.get("password", "")).load()
    if c["type"] == "S3":
        return spark.read.parquet(f"s3a://{c['bucket']}/{resource}")
    try:
        rows = json.loads(_request(c, resource))
    except ValueError as e:
        raise ConnectorProblem(f"{url(c, resource)} gave no JSON") from e
    if not isinstance(rows, list) or any(not isinstance(r, dict) for r in rows):
        raise ConnectorProblem(f"{url(c, resource)} gave no array of objects")
    rows = rows if limit is None else rows[:limit]
    names = sorted(rows[0]) if rows else []

    def shown(x: object) -> str | None:
        return None if x is None else x if isinstance(x, str) else json.dumps(x)

    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([[shown(r.get(n)) for n in names] for r in rows], schema)


def write(df: DataFrame, c: dict, resource: str, mode: str) -> int:
    """Rows sent. REST: one request, POST to append and PUT to overwrite; the rows stream to the driver, which holds the body."""
    if mode not in MODES:
        raise ConnectorProblem(f"Mode {mode} is not supported")
    if c["type"] == "POSTGRES":
        at = f"jdbc:postgresql://{c['host']}:{c.get('port', 5432)}/{c['database']}"
        df.write.format("jdbc").options(url=at, dbtable=resource, user=c.get("user", ""), password=c.get("password", "")).mode(mode.lower()).save()
        return df.count()
    if c["type"] == "S3":
        df.write.mode(mode.lower()).parquet(f"s3a://{c['bucket']}/{resource}")
        return df.count()
    finite = df.select(*(F.when(F.isnan(f.name) | (F.abs(f.name) == float("inf")), None).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name) for f in df.schema))
    sent = [r.j for r in finite.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()]
    if sent or mode == "OVERWRITE":
        _request(c, resource, "POST" if mode == "APPEND" else "PUT", f"[{','.join(sent)}]".encode())
    return len(sent)
