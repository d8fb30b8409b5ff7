import pytest

from larkmill.errors import EngineError
from larkmill.session import Engine

#: A harbour: berths, the ships that lay in them, and what they were charged; one ship was never charged, one berth never used.
BERTHS = [("N1", 40, 3.5), ("N2", 60, 4.25), ("S1", 60, 6.0), ("S2", 110, 9.5)]
CALLS = [
    (701, "N1", "Tern", 2, 18.0), (702, "N2", "Heron", 5, 52.5), (703, "N1", "Skua", 1, 9.25), (704, "S1", "Heron", 3, 40.0), (705, "N2", "Tern", 8, 77.75), (706, "S1", "Plover", 4, 51.0), (707, "N1", "Dunlin", 2, 18.0),
    (708, "S1", "Skua", 9, 120.5), (709, "N2", "Curlew", 6, None),
]


@pytest.fixture(scope="module")
def e(spark):
    e = Engine(spark)
    e.register_frame("berths", spark.createDataFrame(BERTHS, "berth string, metres int, depth double"))
    e.register_frame("calls", spark.createDataFrame(CALLS, "call long, berth string, ship string, nights long, fee double").coalesce(1))
    e.register_frame("gauge", spark.createDataFrame([(1, float("nan"), None, True), (2, 0.5, "low", False), (3, None, "", True), (4, -2.0, "12", None)], "k long, level double, note string, open boolean"))
    return e


def rows(e, sql):
    return [tuple(r) for r in e.sql(sql).collect()]


def test_expressions(e):
    assert rows(e, "SELECT nights > 4 AS long_stay FROM calls ORDER BY call LIMIT 4") == [(0,), (1,), (0,), (0,)]
    assert rows(e, "SELECT 9 / 4 AS a, 10 - 2 * 3 AS b, (10 - 2) * 3 AS c, -nights % 3 AS d FROM calls WHERE call = 705") == [(2.25, 4, 24, -2)]
    assert rows(e, "SELECT mul(nights, 1.5) AS a, div(nights, 0) AS b, ge(nights, 2) AS c FROM calls WHERE ship = 'Curlew'") == [(9.0, 0.0, 1)]
    assert rows(e, "SELECT nights * 2 AS twice, twice + 1 AS more FROM calls WHERE more = 17") == [(16, 17)]
    assert rows(e, "SELECT length(ship) + 1 AS a, upper(ship) AS b, round(fee, 1) * 2 AS c FROM calls WHERE call = 703") == [(5, "SKUA", 18.6)]


def test_missing_values_and_mixed_types_are_false(e):
    assert rows(e, "SELECT k FROM gauge WHERE level < 5 ORDER BY k") == [(2,), (4,)]
    assert rows(e, "SELECT k FROM gauge WHERE level != 0.5 ORDER BY k") == [(4,)]
    assert rows(e, "SELECT k FROM gauge WHERE note ORDER BY k") == [(2,), (4,)]
    assert rows(e, "SELECT k FROM gauge WHERE note = 12 OR NOT note = 12 ORDER BY k") == [(1,), (2,), (3,), (4,)]
    assert rows(e, "SELECT COUNT(*) AS n, COUNT(level) AS m, SUM(open) AS o FROM gauge") == [(4, 3, 2)]
    assert rows(e, "SELECT ship FROM calls WHERE nights = 1 OR nights = 2 AND fee > 18.5") == [("Skua",)]


def test_aggregates_and_groups(e):
    fees = [c[4] for c in CALLS if c[4] is not None]
    assert rows(e, "SELECT SUM(fee) / COUNT(*) AS m, MIN(ship) AS a, MAX(ship) AS z FROM calls") == [(sum(fees) / 9, "Curlew", "Tern")]
    assert rows(e, "SELECT COUNT(*) AS n, SUM(nights) AS s, MIN(fee) AS f FROM calls WHERE nights > 50") == [(0, 0, None)]
    assert rows(e, "SELECT depth, COUNT(*) AS n FROM berths GROUP BY depth ORDER BY depth LIMIT 2") == [(3.5, 1), (4.25, 1)]
    assert rows(e, "SELECT ship, SUM(nights) AS total FROM calls GROUP BY ship HAVING total >= 10 ORDER BY ship") == [("Skua", 10), ("Tern", 10)]
    assert rows(e, "SELECT nights % 2 AS odd, COUNT(*) AS n FROM calls GROUP BY odd ORDER BY odd") == [(0, 5), (1, 4)]
    assert rows(e, "SELECT median(nights) AS m, PERCENTILE(nights, 25) AS p, quantile(0.75)(nights) AS q FROM calls") == [(4.0, 2.0, 6.0)]
    assert rows(e, "SELECT APPROX_QUANTILE(0.5)(nights) AS m FROM calls") == [(4.0,)]
    assert rows(e, "SELECT berth, median(fee) AS m FROM calls GROUP BY berth ORDER BY berth") == [("N1", 18.0), ("N2", 65.125), ("S1", 51.0)]


def test_joins(e):
    assert rows(e, "SELECT b.metres, SUM(c.nights) AS n FROM berths b JOIN calls c ON b.berth = c.berth GROUP BY b.metres ORDER BY b.metres") == [(40, 5), (60, 35)]
    assert rows(e, "SELECT b.berth, c.call FROM berths b LEFT JOIN calls c ON b.berth = c.berth AND c.nights > 5 ORDER BY b.berth, c.call") == [("N1", None), ("N2", 705), ("N2", 709), ("S1", 708), ("S2", None)]
    assert rows(e, "SELECT c.ship, b.berth FROM calls c RIGHT JOIN berths b ON b.berth = c.berth AND c.nights = 9 ORDER BY b.berth") == [(None, "N1"), (None, "N2"), ("Skua", "S1"), (None, "S2")]
    both = "SELECT a.berth, c.call FROM berths a FULL JOIN calls c ON a.berth = c.berth AND c.call < 703 WHERE a.metres > 50 OR c.call > 706 ORDER BY call, berth"
    assert rows(e, both) == [("S1", None), ("S2", None), ("N2", 702), (None, 707), (None, 708), (None, 709)]
    assert rows(e, "SELECT COUNT(*) AS n FROM berths a CROSS JOIN berths b") == [(16,)]
    assert rows(e, "SELECT berth FROM berths b SEMI JOIN calls c ON c.berth = b.berth AND c.fee > 70 ORDER BY berth") == [("N2",), ("S1",)]
    assert rows(e, "SELECT * FROM berths b LEFT ANTI JOIN calls c ON c.berth = b.berth") == [("S2", 110, 9.5)]
    assert rows(e, "SELECT (SELECT depth FROM berths WHERE depth > 50) AS none FROM gauge LIMIT 1") == [(0,)]


def test_queries_put_together(e):
    assert rows(e, "SELECT berth AS b FROM berths EXCEPT SELECT berth FROM calls") == [("S2",)]
    assert rows(e, "SELECT nights AS n FROM calls WHERE berth = 'N1' UNION SELECT nights FROM calls WHERE berth = 'S1' ORDER BY n DESC LIMIT 3") == [(9,), (4,), (3,)]
    assert rows(e, "SELECT berth FROM calls UNION ALL SELECT ship FROM calls WHERE call < 0 ORDER BY berth LIMIT 2") == [("N1",), ("N1",)]
    assert sorted(rows(e, "SELECT 1 AS x UNION SELECT nights FROM calls WHERE nights = 8 INTERSECT SELECT 8")) == [(1,), (8,)]
    assert rows(e, "WITH long AS (SELECT * FROM calls WHERE nights > 5), fees AS (SELECT SUM(fee) AS f FROM long) SELECT l.call, f.f FROM long l CROSS JOIN fees f ORDER BY call") == [(705, 198.25), (708, 198.25), (709, 198.25)]
    assert sorted(rows(e, "SELECT berth, ship, COUNT(*) AS n FROM calls WHERE nights > 7 GROUP BY ROLLUP(berth, ship)"), key=str) == sorted([(None, None, 2), ("N2", None, 1), ("S1", None, 1), ("N2", "Tern", 1), ("S1", "Skua", 1)], key=str)


def test_order_and_limit(e):
    assert rows(e, "SELECT ship FROM calls ORDER BY fee DESC, call LIMIT 2") == [("Skua",), ("Tern",)]
    assert rows(e, "SELECT call FROM calls ORDER BY call LIMIT 4 OFFSET 7") == [(708,), (709,)]
    assert rows(e, "SELECT call FROM calls ORDER BY call LIMIT 3, 2") == [(704,), (705,)]


def test_division_by_zero_is_endless(e):
    assert rows(e, "SELECT nights / 0 AS x, -nights / 0 AS y FROM calls LIMIT 1") == [(float("inf"), float("-inf"))]
    with pytest.raises(Exception, match="(?i)zero"):
        rows(e, "SELECT nights % 0 AS x FROM calls")


def test_names(e):
    assert e.sql("SELECT COUNT(*), MAX(depth) FROM berths").columns == ["COUNT(*)", "MAX(depth)"]
    assert e.sql("SELECT calls.fee, nights * 2, SUM(nights) OVER (PARTITION BY berth) FROM calls").columns == ["fee", "(nights * 2)", "sum_over"]


def test_windows(e):
    assert rows(e, "SELECT call, NTILE(4) OVER (ORDER BY nights DESC, call) AS q FROM calls ORDER BY call") == [(701, 3), (702, 2), (703, 4), (704, 3), (705, 1), (706, 2), (707, 4), (708, 1), (709, 1)]
    assert sorted(rows(e, "SELECT call, SUM(nights) OVER (PARTITION BY berth ORDER BY call) AS t FROM calls WHERE berth != 'N2'")) == [(701, 5), (703, 5), (704, 16), (706, 16), (707, 5), (708, 16)]
    assert set(rows(e, "SELECT COUNT(*) OVER () AS n, SUM(fee > 50) OVER () AS dear, COUNT(DISTINCT ship) OVER (PARTITION BY berth) AS s FROM calls")) == {(9, 4, 3)}


@pytest.mark.parametrize(("key", "way"), [("x", ""), ("x", "DESC"), ("s", ""), ("s", "DESC"), ("b", ""), ("d", "DESC")])
def test_ntile_over_all_rows(spark, key, way):
    rows_ = [(i, None if i % 5 == 0 else float("nan") if i % 7 == 0 else (i * 37 % 50) / 3 - 8, None if i % 11 == 0 else "x" * (i % 3) + chr(97 + i % 13), i % 2 == 0, f"2024-03-{i % 28 + 1:02}") for i in range(300)]
    e = Engine(spark)
    e.register_frame("odd", spark.createDataFrame(rows_, "i int, x double, s string, b boolean, d string").selectExpr("i", "x", "s", "b", "CAST(d AS DATE) AS d"))
    order = f"{key} {'DESC NULLS LAST' if way else 'ASC NULLS FIRST'}, i"
    for n in (7, 1000):
        want = e.sql("SELECT * FROM odd").selectExpr("i", f"CAST(NTILE({n}) OVER (ORDER BY {order}) AS LONG) AS q").collect()
        assert sorted(map(tuple, e.sql(f"SELECT i, NTILE({n}) OVER (ORDER BY {key} {way}, i) AS q FROM odd").collect())) == sorted(map(tuple, want))
    limited = e.sql(f"SELECT NTILE(2) OVER (ORDER BY {key} {way}) AS q FROM (SELECT * FROM odd LIMIT 10)").collect()
    assert sorted(r.q for r in limited) == [1] * 5 + [2] * 5
    none = e.sql(f"SELECT NTILE(2) OVER (ORDER BY {key} {way}) AS q FROM odd WHERE i < 0").collect()
    assert none == []


def test_plans(e):
    explained = lambda sql: "\n".join(r.plan for r in e.sql(f"EXPLAIN {sql}").collect())
    plan = explained("SELECT call FROM calls WHERE berth IN (SELECT berth FROM berths WHERE depth > 4)")
    assert "LeftSemi" in plan and "ExistenceJoin" not in plan
    plan = explained("SELECT call, SUM(nights) OVER () AS t FROM calls")
    assert "Window" not in plan
    plan = explained("SELECT call, NTILE(3) OVER (ORDER BY nights) AS t FROM calls").partition("== Physical Plan ==")[2]
    assert "row_number() windowspecdefinition(w1p" in plan


@pytest.mark.parametrize(
    ("sql", "message"),
    [
        ("SELECT ship, MAX(fee) FROM calls", "GROUP BY"), ("SELECT ship, MAX(fee) FROM calls GROUP BY berth", "GROUP BY"), ("SELECT WHISTLE(fee) FROM calls", "Unknown function"), ("SELECT ship FROM calls WHERE MAX(fee) > 1", "WHERE"),
        ("SELECT ship FROM calls ORDER BY keel", "ORDER BY"), ("SELECT keel FROM calls", "Unknown column"), ("SELECT call FROM docks", "Unknown table"), ("SELECT *, COUNT(*) FROM berths", "aggregates"), ("SELECT AVG(MIN(fee)) FROM calls", "nested"),
        ("SELECT quantile(1.5)(fee) FROM calls", "range"), ("SELECT NTILE(-1) OVER (ORDER BY fee) FROM calls", "positive"), ("SELECT LEAD(fee) OVER (ORDER BY call) FROM calls", "Unknown window"), ("SELECT MIN(fee), NTILE(2) OVER (ORDER BY call) FROM calls", "mixed"),
        ("SELECT ship * 2 FROM calls", "numbers"), ("SELECT berth FROM berths b JOIN calls c ON b.berth = c.berth", "Ambiguous"), ("SELECT berth FROM berths UNION SELECT berth, metres FROM berths", "as many columns"),
        ("SELECT berth FROM berths EXCEPT SELECT depth FROM berths", "one kind"), ("SELECT c.fee FROM berths b SEMI JOIN calls c ON c.berth = b.berth", "Unknown column"),
    ],
)
def test_rejected(e, sql, message):
    with pytest.raises(EngineError, match=message):
        e.sql(sql)


def test_pushdown(spark, tmp_path):
    spark.range(50).selectExpr("id", "id % 9 AS digit", "'wide' AS filler", "concat('u', id % 3) AS unit").write.parquet(str(tmp_path / "meter"))
    e = Engine(spark)
    e.register_frame("meter", spark.read.parquet(str(tmp_path / "meter")))
    plan = "\n".join(r.plan for r in e.sql("EXPLAIN SELECT id FROM meter WHERE digit >= 7 AND unit = 'u1'").collect())
    assert "GreaterThanOrEqual(digit,7)" in plan
    assert "EqualTo(unit,u1)" in plan
    assert "filler" not in plan.partition("== Physical Plan ==")[2].partition("ReadSchema")[2]
