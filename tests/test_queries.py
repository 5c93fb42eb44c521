"""Golden queries over the family and film graph."""

import pytest

from loomgraph.plans.cypher import CypherError
from loomgraph.plans.graph import SchemaError
from tests.yago import graph, with_prices


@pytest.fixture(scope="module")
def g(spark):
    return graph(spark)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


CASES = [
    ("MATCH (n) RETURN count(n) AS n", [(21,)]),
    ("MATCH ()-[e]->() RETURN count(e) AS n", [(28,)]),
    ("MATCH (p:Person {name: 'Roy Redgrave'})-[:HAS_CHILD*1..3]->(c) RETURN c.name AS n", [("Corin Redgrave",), ("Michael Redgrave",), ("Vanessa Redgrave",), ("Jemma Redgrave",), ("Natasha Richardson",)]),
    ("MATCH (p:Person {name: 'Roy Redgrave'})-[:HAS_CHILD*0..1]->(c) RETURN c.name AS n", [("Michael Redgrave",), ("Roy Redgrave",)]),
    ("MATCH (p:Person {name: 'Roy Redgrave'})-[:HAS_CHILD*]->(c) RETURN count(c) AS n", [(5,)]),
    ("MATCH (a:Person)-[:MARRIED]->(b)-[:MARRIED]->(a) RETURN a.name AS a", [("Liam Neeson",), ("Michael Redgrave",), ("Natasha Richardson",), ("Rachel Kempson",)]),
    ("MATCH (c:Person)<-[:HAS_CHILD]-(p)-[:HAS_CHILD]->(d) WHERE c.name = 'Vanessa Redgrave' RETURN d.name AS n", [("Corin Redgrave",), ("Corin Redgrave",)]),
    ("MATCH (p:Person) OPTIONAL MATCH (p)-[:DIRECTED]->(f:Film) WITH p, f WHERE p.birthyear > 1960 RETURN p.name AS p, f.title AS f", [("Christopher Nolan", "Batman Begins"), ("Jemma Redgrave", None), ("Lindsay Lohan", None), ("Natasha Richardson", None)]),
    ("MATCH (p:Person) WHERE exists((p)-[:DIRECTED]->(:Film)) RETURN p.name AS n", [("Christopher Nolan",)]),
    ("MATCH (p:Person) WHERE NOT (p)-[:ACTED_IN]->() AND p.birthyear < 1911 RETURN p.name AS n", [("Rachel Kempson",), ("Roy Redgrave",)]),
    ("MATCH (c:City)<-[:BORN_IN]-(p) RETURN c.name AS c, count(*) AS n ORDER BY n DESC, c LIMIT 2", [("London", 3), ("New York", 2)]),
    ("MATCH (n:Person) RETURN n.name AS name ORDER BY n.birthyear LIMIT 1", [("Roy Redgrave",)]),
    ("MATCH (n:City) RETURN n.name UNION ALL MATCH (n:City {name: 'London'}) RETURN n.name", [("Houston",), ("London",), ("London",), ("New York",)]),
    ("UNWIND [1, 2, 2] AS x WITH DISTINCT x RETURN x", [(1,), (2,)]),
    ("UNWIND [] AS x RETURN x", []),
    ("RETURN 1 + 2 * 3 AS a, 2 ^ 3 AS b, 'x' + 1 AS c, [1, 2] + 3 AS d, 7 % 4 AS e", [(7, 8.0, "x1", [1, 2, 3], 3)]),
    ("RETURN toString(2.3) AS a, toInteger('3') AS b, toInteger(2.3) AS c, size('abc') AS d, sign(-17) AS e, ceil(0.1) AS f", [("2.300000", 3, 2, 3, -1, 1.0)]),
    ("RETURN [1, 2, 3][-1] AS a, [1, 2, 3][7] AS b, [1, 2, 3, 4][1..3] AS c, [1, 2, 3][2..1] AS d, [1, 2, 3, 4][-2..] AS e", [(3, None, [2, 3], [], [3, 4])]),
    ("RETURN [x IN range(0, 4) WHERE x % 2 = 0 | x ^ 3] AS r, all(x IN [1, 2] WHERE x > 0) AS a, none(x IN [1] WHERE x > 1) AS n, single(x IN [1, 2] WHERE x = 2) AS s", [([0.0, 8.0, 64.0], True, True, True)]),
    ("RETURN CASE WHEN null THEN 1 ELSE 2 END AS a, null = null AS b, null <> null AS c, 1 IN [1, 2] AS d", [(2, True, False, True)]),
    ("MATCH (n:Person {name: 'Liam Neeson'}) RETURN n.nothing AS x, keys(n) AS k, labels(n) AS l", [(None, ["name", "birthyear"], ["Person"])]),
    ("MATCH p = (:Person {name: 'Roy Redgrave'})-[:HAS_CHILD]->()-[:HAS_CHILD]->(x) RETURN length(p) AS l, nodes(p) AS n", [(2, [10, 1, 2]), (2, [10, 1, 3])]),
    ("MATCH (a:Person)-[r:ACTED_IN]->(f:Film) WHERE r.charactername =~ 'K.*' RETURN a.name AS a, type(r) AS t, euid(r) AS u", [("Richard Harris", "ACTED_IN", "6_20_5_0_0")]),
    ("MATCH (p:Person) RETURN max(p.birthyear) AS hi, min(p.birthyear) AS lo, sum(p.nothing) AS s, avg(p.nothing) AS a", [(1986.0, 1873.0, 0.0, None)]),
    ("MATCH ACYCLIC (a:Person {name: 'Rachel Kempson'})-[:MARRIED*1..3]-(b) RETURN b.name AS b", [("Michael Redgrave",), ("Michael Redgrave",)]),
    ("CALL db.vertexLabels() YIELD label RETURN label", [("City",), ("Film",), ("Person",)]),
    ("CALL algo.shortestPath(10, 5) YIELD nodeCount RETURN nodeCount", [(4,)]),
]


@pytest.mark.parametrize("text,want", CASES, ids=[c[0][:50] for c in CASES])
def test_golden(g, text, want):
    got = g.cypher(text)
    if " ORDER BY " in text:
        assert [tuple(r) for r in got.collect()] == want
    else:
        assert rows(got) == sorted(want, key=str)


def test_parameters(g):
    assert rows(g.cypher("MATCH (p:Person) WHERE p.name IN $names RETURN p.birthyear AS y", {"names": ["Liam Neeson", "Dennis Quaid"]})) == [(1952,), (1954,)]


@pytest.mark.parametrize("text", ["MATCH (n:Nobody) RETURN n", "MATCH (n:Person {shoe: 1}) RETURN n"])
def test_schema_errors(g, text):
    with pytest.raises(SchemaError):
        g.cypher(text)


@pytest.mark.parametrize("text", ["MATCH (n RETURN n", "MATCH (n)", "RETURN nofunction(1)", "RETURN missing", "MATCH (n) RETURN n.name + count(n)"])
def test_query_errors(g, text):
    with pytest.raises(CypherError):
        g.cypher(text)


def test_series(g):
    s = with_prices(g)
    assert rows(s.cypher("MATCH (p:Person {name: 'Vanessa Redgrave'}) RETURN series.count(p, 'prices') AS n, series.mean(p, 'prices', 'close') AS m, series.max(p, 'prices', 'volume') AS v")) == [(3, 11.0, 300)]
    got = s.cypher("MATCH (p:Person {name: 'Roy Redgrave'}) RETURN series.range(p, 'prices', datetime('2024-01-02 00:00:00'), datetime('2024-01-03 00:00:00')) AS r, series.at(p, 'prices', datetime('2030-01-01 00:00:00')) AS x, series.range(p, 'prices', datetime('2030-01-01 00:00:00'), datetime('2031-01-01 00:00:00')) AS none").first()
    assert [p["close"] for p in got["r"]] == [11.0, 12.0] and got["x"] is None and got["none"] == []
    with pytest.raises(SchemaError):
        s.cypher("MATCH (p:Person) RETURN series.count(p, 'weights') AS n")


def test_explain(g):
    assert "Scan" in g.cypher("EXPLAIN MATCH (n:City) RETURN n.name").first()[0]
