import http.server
import json
import threading
from datetime import UTC, datetime, timedelta

import pytest

from larkmill.errors import EngineError
from larkmill.orchestration import cron_matches, ordered
from larkmill.session import Engine


@pytest.fixture
def e(spark, tmp_path):
    return Engine(spark, str(tmp_path / "engine"))


def run(e, *statements):
    for s in statements:
        out = e.sql(s)
    return [tuple(r) for r in out.collect()]


def test_tables(e):
    run(e, "CREATE DATABASE d", "USE d", "CREATE TABLE t (a Int64, b String, c Float64)", "INSERT INTO t VALUES (1, 'x', 1.5), (2, 'y', 2)", "INSERT INTO t (b, a) VALUES ('z', -3)")
    assert run(e, "SELECT * FROM t ORDER BY a") == [(-3, "z", None), (1, "x", 1.5), (2, "y", 2.0)]
    assert run(e, "SELECT COUNT(*) FROM d.t") == [(3,)]
    run(e, "ALTER TABLE t DROP COLUMN c, ADD COLUMN d Int32, MODIFY COLUMN a String")
    assert run(e, "SELECT a, d FROM t ORDER BY b LIMIT 1") == [("1", None)]
    assert run(e, "DESCRIBE t") == [("a", "String"), ("b", "String"), ("d", "Int32")]
    run(e, "TRUNCATE TABLE t")
    assert run(e, "SELECT a FROM t") == []
    run(e, "DROP TABLE t", "DROP TABLE IF EXISTS t")
    for bad in ("DROP TABLE t", "CREATE TABLE t (a Nope)", "CREATE TABLE t (a Int64) ENGINE = Nope", "USE nope", "CREATE DATABASE d", "INSERT INTO nope VALUES (1)"):
        with pytest.raises(EngineError):
            e.sql(bad)


def test_dictionary_tables_keep_the_last_value(e, spark):
    run(e, "CREATE TABLE d (k Int64, v String) ENGINE = Dictionary", "INSERT INTO d VALUES (1, '10'), (2, 'x')")
    e.register_frame("many", spark.range(0, 400, 1, 200).selectExpr("CAST(2 AS BIGINT) AS k", "CAST(id AS STRING) AS v"))
    run(e, "INSERT INTO d SELECT k, v FROM many")
    assert run(e, "SELECT * FROM d ORDER BY k") == [(1, "10"), (2, "399")]
    run(e, "ALTER TABLE d MODIFY COLUMN v Int64")
    assert run(e, "SELECT * FROM d ORDER BY k") == [(1, 10), (2, 399)]
    for bad in ("ALTER TABLE d ADD COLUMN w Int64", "ALTER TABLE d DROP COLUMN v"):
        with pytest.raises(EngineError, match="key and a value"):
            e.sql(bad)
    run(e, "INSERT INTO d VALUES (2, 5)")
    assert run(e, "SELECT * FROM d ORDER BY k") == [(1, 10), (2, 5)]


def test_modify_is_strict(e):
    run(e, "CREATE TABLE t (a String, b Int64)", "INSERT INTO t VALUES ('7', 1), ('seven', 2)")
    with pytest.raises(EngineError, match="convert"):
        e.sql("ALTER TABLE t MODIFY COLUMN a Int64")
    assert run(e, "SELECT a, b FROM t ORDER BY b") == [("7", 1), ("seven", 2)]
    assert run(e, "DESCRIBE t") == [("a", "String"), ("b", "Int64")]


def test_any_failure_of_a_task_is_recorded(e):
    run(e, "CREATE TABLE t (a Int64)", "INSERT INTO t VALUES (1)", "CREATE PIPELINE p OWNER 'me'", "CREATE STAGE s IN PIPELINE p ORDER 1", "CREATE TASK a IN STAGE s IN PIPELINE p TYPE SQL BODY 'SELECT a % 0 AS x FROM t'", "CREATE TASK b IN STAGE s IN PIPELINE p TYPE BUILT_IN DEPENDS ON a")
    assert run(e, "RUN PIPELINE p")[0][1] == "FAILED"
    assert [r[4] for r in run(e, "SHOW TASK_RUNS")] == ["FAILED", "SKIPPED"]


def test_insert_select_is_strict_and_whole(e):
    run(e, "CREATE TABLE raw (k String)", "INSERT INTO raw VALUES ('1'), (' 2 '), ('abc')", "CREATE TABLE typed (n Int64)")
    with pytest.raises(EngineError, match="convert"):
        e.sql("INSERT INTO typed SELECT k FROM raw")
    assert run(e, "SELECT n FROM typed") == []
    run(e, "INSERT INTO typed SELECT k FROM raw WHERE k != 'abc'", "INSERT INTO typed SELECT n FROM typed")
    assert run(e, "SELECT n FROM typed ORDER BY n") == [(1,), (1,), (2,), (2,)]
    run(e, "CREATE TABLE f (x Float64)", "INSERT INTO f VALUES (1.5)")
    with pytest.raises(EngineError):
        e.sql("INSERT INTO typed SELECT x FROM f")
    with pytest.raises(EngineError, match="columns"):
        e.sql("INSERT INTO typed SELECT x, x FROM f")


def test_catalog_is_kept(e, spark):
    run(e, "CREATE TABLE t (a Int64)", "INSERT INTO t VALUES (1)", "CREATE VIEW v AS SELECT a * 2 AS b FROM t")
    assert run(Engine(spark, e.root), "SELECT b FROM v") == [(2,)]


def test_views(e):
    run(e, "CREATE TABLE t (a Int64)", "INSERT INTO t VALUES (1), (5)", "CREATE VIEW v AS SELECT a FROM t WHERE a > 2", "CREATE VIEW w AS SELECT a FROM v")
    assert run(e, "SELECT a FROM w") == [(5,)]
    for bad in ("ALTER VIEW v AS SELECT a FROM w", "ALTER VIEW v AS SELECT nope FROM t", "ALTER VIEW v AS SELECT a AS c FROM t", "CREATE VIEW x AS SELECT nope FROM t", "INSERT INTO v VALUES (1)"):
        with pytest.raises(EngineError):
            e.sql(bad)
    assert run(e, "SELECT a FROM w") == [(5,)]
    run(e, "ALTER VIEW v AS SELECT a FROM t WHERE a < 2")
    assert run(e, "SELECT a FROM w") == [(1,)]


def test_materialized_views(e):
    run(e, "CREATE TABLE t (a Int64)", "INSERT INTO t VALUES (1)", "CREATE MATERIALIZED VIEW m AS SELECT COUNT(*) AS n FROM t", "INSERT INTO t VALUES (2)")
    assert run(e, "SELECT n FROM m") == [(1,)]
    run(e, "ALTER MATERIALIZED VIEW m SET REFRESH EVERY 1 HOUR")
    now = datetime.now(UTC)
    assert e.tick(now) == []
    assert e.tick(now + timedelta(hours=2)) == [("m", "READY")]
    assert run(e, "SELECT n FROM m") == [(2,)]
    assert run(e, "SHOW MATERIALIZED VIEWS")[0][:4] == ("m", "READY", "EVERY", "3600")


def test_quality_rules(e):
    run(e, "CREATE TABLE t (a Int64, x Float64)", "INSERT INTO t VALUES (1, 5), (1, -2), (2, 7)", "INSERT INTO t (a) VALUES (3)")
    for name, check, n in (("u", "UNIQUE a", 2), ("r", "RANGE x MIN 0", 2), ("x", "EXPRESSION 'a > 1'", 2), ("m", "MIN_ROWS 9", 5)):
        run(e, f"CREATE DATA_QUALITY_RULE {name} ON t {check}")
        assert run(e, f"RUN DATA_QUALITY_RULE {name}")[0][4:6] == ("FAILED", n)
    for bad in ("CREATE DATA_QUALITY_RULE q ON t RANGE x MIN 5 MAX 1", "CREATE DATA_QUALITY_RULE q ON t UNIQUE a ACTION QUARANTINE", "CREATE DATA_QUALITY_RULE q ON t EXPRESSION 'a >'", "CREATE DATA_QUALITY_RULE u ON t UNIQUE a"):
        with pytest.raises(EngineError):
            e.sql(bad)


def test_pipelines(e):
    run(
        e, "CREATE TABLE t (a Int64)", "CREATE PIPELINE p OWNER 'me'", "CREATE STAGE s IN PIPELINE p ORDER 1", "CREATE TASK b IN STAGE s IN PIPELINE p TYPE SQL BODY 'INSERT INTO t VALUES (1)' DEPENDS ON c",
        "CREATE TASK c IN STAGE s IN PIPELINE p TYPE BUILT_IN", "CREATE TRIGGER tick ON PIPELINE p SCHEDULE '5 * * * *'", "CREATE TRIGGER hook ON PIPELINE p WEBHOOK SECRET 'tok'",
    )
    assert run(e, "RUN PIPELINE p")[0][1] == "SUCCESS"
    assert [(r[3], r[4]) for r in run(e, "SHOW TASK_RUNS FOR PIPELINE p")] == [("c", "SUCCESS"), ("b", "SUCCESS")]
    assert e.pipelines.tick(datetime(2026, 1, 1, 0, 5, tzinfo=UTC)) == [("p", "SUCCESS")]
    assert e.pipelines.tick(datetime(2026, 1, 1, 0, 5, 30, tzinfo=UTC)) == []
    assert [e.pipelines.webhook("p", "hook", t) for t in (None, "tok")] == [401, 202]
    assert (e.pipelines.webhook("p", "nope", "tok"), e.pipelines.webhook("p", "tick", "tok")) == (404, 405)
    run(e, "CREATE TASK d IN STAGE s IN PIPELINE p TYPE BUILT_IN BODY 'fail' DEPENDS ON c", "CREATE TASK z IN STAGE s IN PIPELINE p TYPE BUILT_IN DEPENDS ON d")
    assert run(e, "RUN PIPELINE p")[0][1] == "FAILED"
    assert run(e, "SHOW TASK_RUNS")[-1][3:5] == ("z", "SKIPPED")
    run(e, "PAUSE PIPELINE p")
    with pytest.raises(EngineError, match="paused"):
        e.sql("RUN PIPELINE p")


def test_order_and_cron():
    assert ordered({"b": ["a"], "a": [], "c": []}) == ["a", "b", "c"]
    with pytest.raises(EngineError, match="circle"):
        ordered({"a": ["b"], "b": ["a"]})
    with pytest.raises(EngineError, match="unknown"):
        ordered({"a": ["x"]})
    assert cron_matches("* 3 * * 0", datetime(2026, 11, 29, 3, 1, tzinfo=UTC))


def test_streams(e, spark):
    run(e, "CREATE TOPIC t PARTITIONS 4 RETAIN 30 DAYS", "CREATE STREAM s TOPIC t", "CREATE CONSUMER_GROUP g")
    assert run(e, "PUBLISH t VALUES ('a'), ('b')") == [("1",)]
    run(e, "INSERT INTO s VALUES ('c')")
    assert run(e, "SUBSCRIBE s CONSUMER_GROUP g LIMIT 2") == [("0", "a"), ("1", "b")]
    assert run(e, "SUBSCRIBE s CONSUMER_GROUP g LIMIT 2") == [("2", "c")]
    assert run(e, "SUBSCRIBE s CONSUMER_GROUP g") == []
    assert len(run(e, "SUBSCRIBE s")) == 3
    assert run(e, "SHOW STREAM_METRICS FOR STREAM s") == [("s", "3", "0")]
    e.append_stream("s", spark.range(100).selectExpr("id", "CAST(id AS STRING) AS payload"), ["id"])
    assert run(e, "SUBSCRIBE s CONSUMER_GROUP g LIMIT 3") == [("3", "0"), ("4", "1"), ("5", "2")]
    run(e, "CREATE STREAM u", "INSERT INTO u VALUES ('z')")
    e.register_frame("t2", spark.range(3).selectExpr("id"))
    assert sorted(p for _, p in run(e, "INSERT INTO u SELECT id FROM t2", "SUBSCRIBE u")) == ["0", "1", "2", "z"]
    query = e.read_stream("s").writeStream.format("memory").queryName("log").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("log").count() == 103
    with pytest.raises(EngineError):
        e.sql("DROP TOPIC t")


def test_event_time_windows(spark, tmp_path):
    """Plain and streaming frames give the same closed windows; the last event only moves the watermark beyond them."""
    from larkmill.streaming.log import session_counts, windowed_counts

    at = lambda *minutes: [(f"2024-05-01 {m // 60:02}:{m % 60:02}:00", k) for m, k in minutes]
    rows = at((0, "a"), (4, "a"), (11, "a"), (14, "b"), (40, "a"), (41, "b"))
    schema = "t string, k string"
    spark.createDataFrame(rows, schema).selectExpr("CAST(t AS TIMESTAMP) AS ts", "k").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(at((600, "z")), schema).selectExpr("CAST(t AS TIMESTAMP) AS ts", "k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    plain = spark.read.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def closed(counted, window, name):
        made = lambda df: sorted((r.start, r.k, r.events) for r in df.selectExpr(f"date_format({window}.start, 'HH:mm') AS start", "k", "events").collect() if r.k != "z")
        query = counted(live).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert made(spark.table(name)) == made(counted(plain))
        return made(counted(plain))

    slid = closed(lambda df: windowed_counts(df, "20 minutes", "1 minute", "ts", "k", slide="10 minutes"), "window", "slid")
    assert [x for x in slid if x[1] == "a"] == [("00:00", "a", 3), ("00:10", "a", 1), ("00:30", "a", 1), ("00:40", "a", 1), ("23:50", "a", 2)]
    assert closed(lambda df: session_counts(df, "10 minutes", "1 minute", "ts", "k"), "session_window", "sessions") == [("00:00", "a", 3), ("00:14", "b", 1), ("00:40", "a", 1), ("00:41", "b", 1)]


class _Api(http.server.BaseHTTPRequestHandler):
    got: list = []

    def do_GET(self):
        body = json.dumps([{"station": "7", "rain": "3.25", "sky": "grey"}, {"station": "8", "rain": "0.5", "sky": "blue"}] if "readings" in self.path else {"readings": 2, "stations": 2}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        self.got.append((self.command, self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
        self.send_response(200)
        self.end_headers()

    do_PUT = do_POST

    def log_message(self, *_):
        pass


def test_connectors(e):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    run(e, f"CREATE CONNECTOR weather TYPE REST BASE_URL 'http://127.0.0.1:{server.server_port}'")
    assert run(e, "DISCOVER SCHEMA FROM CONNECTOR weather") == [("readings",), ("stations",)]
    assert run(e, "TEST CONNECTOR weather")[0][1] == "true"
    run(e, "CREATE TABLE rain (station Int32, mm Float64)", "INSERT INTO rain SELECT station, rain FROM CONNECTOR weather.readings WHERE sky = 'grey'", "INSERT INTO rain VALUES (9, 0)")
    assert run(e, "SELECT * FROM rain ORDER BY station") == [(7, 3.25), (9, 0.0)]
    assert run(e, "EXPORT TABLE rain TO CONNECTOR weather.archive MODE OVERWRITE") == [("weather", "archive", "OVERWRITE", 2)]
    assert _Api.got[0][:2] == ("PUT", "/archive")
    assert sorted(str(x["station"]) for x in _Api.got[0][2]) == ["7", "9"]
    with pytest.raises(EngineError):
        e.sql("EXPORT TABLE rain TO CONNECTOR weather MODE MERGE")
    server.shutdown()


def test_topology(e):
    run(e, "CREATE NODE a TYPE COMPUTE ROLE WORKER", "REGISTER NODE b HOST '127.0.0.1' PORT 9001", "CREATE CLUSTER c", "ALTER CLUSTER c ADD NODE a, ADD NODE b", "CREATE SHARD_GROUP g TYPE HASH KEY k SHARDS 4", "CREATE REPLICA_GROUP r REPLICAS 2 CONSISTENCY QUORUM")
    assert run(e, "SHOW CLUSTER STATUS c") == [("c", "DEGRADED", "2", "1", "1")]
    with pytest.raises(EngineError):
        e.sql("ALTER CLUSTER c REMOVE NODE a, REMOVE NODE a")
    assert [r[2] for r in run(e, "SHOW SHARDS g")] == ["b"] * 4
    assert e.topology.sweep(10**12) == ["b"]
    assert run(e, "SHOW REPLICATION STATUS FOR r")[0][4] == "UNASSIGNED"


def test_models(e, spark):
    rows = [(i, float(i % 7), float(i % 5), "x" if i % 2 else "y", int(i % 7 > 3)) for i in range(120)]
    e.register_frame("people", spark.createDataFrame(rows, "k long, a double, b double, c string, y int"))
    run(
        e, "CREATE FEATURE_SET f FROM people ENTITY_KEY(k) FEATURES(a, b, c) TARGET y", "CREATE MODEL m TYPE CLASSIFICATION", "CREATE TRAINING_JOB j MODEL m FEATURE_SET f FRAMEWORK SKLEARN ALGORITHM DecisionTreeClassifier OBJECTIVE ACCURACY",
        "RUN TRAINING_JOB j", "DEPLOY MODEL m:1 AS live",
    )
    assert dict((k, v) for *_, k, v in run(e, "COMPARE MODELS m:1"))["ACCURACY"] == 1.0
    assert run(e, "PREDICT MODEL m:1 FOR (k=6)")[0][:2] == ("6", "1")
    assert run(e, "PREDICT MODEL m:1 WITH (a=0, b=1, c='x')")[0][1] == "0"
    assert len(run(e, "PREDICT MODEL m:1 FROM people")) == 120
    assert run(e, "SELECT COUNT(*) FROM m_predictions") == [(120,)]
    run(e, "CREATE TUNING_JOB t TRAINING_JOB j STRATEGY GRID TRIALS 2 OBJECTIVE ACCURACY SEARCH_SPACE(max_depth='1,3')")
    assert run(e, "RUN TUNING_JOB t")[-1][0] == "best:v2"
    for bad in ("PREDICT MODEL nope WITH (a=1)", "GENERATE USING MODEL m PROMPT 'x'", "RUN TRAINING_JOB nope"):
        with pytest.raises(EngineError):
            e.sql(bad)


def test_shown(e, spark):
    e.register_frame("t", spark.createDataFrame([(1, float("nan"), None)], "a long, b double, c string"))
    assert json.loads(e.shown(e.sql("SELECT * FROM t"))) == [{"a": 1, "b": None, "c": None}]
    assert e.shown(e.sql("SELECT a, c FROM t"), "TSV") == "a\tc\n1\t\\N"
