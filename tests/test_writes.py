"""Text that changes a graph, window functions, and series fed by a stream."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import series
from loomgraph.plans.cypher import CypherError
from loomgraph.plans.graph import SchemaError
from loomgraph.streaming.series_sink import compact, read_series, upsert_stream, windowed
from tests.yago import graph


def said(result):
    return result.collect()[0][0]


def test_create(spark):
    g, out = graph(spark).execute("CREATE (a:Person {name: 'A', birthyear: 1})-[:MARRIED]->(b:Person {name: 'B'})")
    assert said(out) == "created 2 vertices, created 1 edges."
    rows = g.cypher("MATCH (a:Person {name: 'A'})-[:MARRIED]->(b) RETURN a.birthyear, b.name, id(a) <> id(b)").collect()
    assert [tuple(r) for r in rows] == [(1, "B", True)]
    g, out = g.execute("MATCH (a:Person {name: 'A'}), (b:Person {name: 'B'}) CREATE (a)-[e:MARRIED]->(b) RETURN euid(e)")
    assert said(out).endswith("_1")  # a second edge between the two
    assert g.edge("MARRIED").count() == 6


@pytest.mark.parametrize("text", ["CREATE (a:Person {name: 'Liam Neeson'})", "CREATE (a:Person {shoe: 1})", "CREATE (a:Ghost {name: 'x'})", "MATCH (a:Person {name: 'Liam Neeson'}) REMOVE a.name", "MATCH (a:Person), (c:City) CREATE (c)-[:MARRIED]->(a)"])
def test_schema_is_kept(spark, text):
    with pytest.raises(SchemaError):
        graph(spark).execute(text)


@pytest.mark.parametrize("text", ["CREATE (a)", "MATCH (a:Person) CREATE (a)-[:MARRIED]-(b:Person {name: 'x'})", "MATCH (a:Person) SET b.name = 1", "MERGE (a:Person {name: 'q'})-[:MARRIED]->(b:Person {name: 'r'})"])
def test_bad_changes(spark, text):
    with pytest.raises(CypherError):
        graph(spark).execute(text)


def test_reading_does_not_change(spark):
    with pytest.raises(CypherError):
        graph(spark).cypher("CREATE (a:City {name: 'x'})")


def test_set(spark):
    g = graph(spark)
    new, out = g.execute("MATCH (a:Person) WHERE a.birthyear > 1960 SET a.birthyear = a.birthyear + 1")
    assert said(out) == "set 4 properties."
    assert new.vertex("Person").where("birthyear = 1971").count() == 1 and g.vertex("Person").where("birthyear = 1971").count() == 0
    new, out = g.execute("MATCH (a:Person)-[e:BORN_IN]->(c) SET e.weight = 9 RETURN sum(e.weight) AS s")
    assert said(out) == 54.0 and new.edge("BORN_IN").where("weight = 9").count() == 6
    _, out = g.execute("MATCH (a:Person {name: 'Liam Neeson'}) SET a += {birthyear: 3} RETURN a.name, a.birthyear")
    assert tuple(out.collect()[0]) == ("Liam Neeson", 3)
    # several values for one element: the greatest stays, in the table and in the bindings
    new, out = g.execute("MATCH (a:Person)-[:HAS_CHILD]->(b:Person {name: 'Corin Redgrave'}) SET b.birthyear = a.birthyear RETURN DISTINCT b.birthyear")
    assert [r[0] for r in out.collect()] == [1910] and new.vertex("Person").where("name = 'Corin Redgrave' and birthyear = 1910").count() == 1


def test_delete(spark):
    g, out = graph(spark).execute("MATCH (a:Person) DETACH DELETE a")
    assert said(out) == "deleted 13 vertices, deleted 28 edges."
    assert g.vertex("Person").count() == 0 and g.vertex("Film").count() == 5
    _, out = graph(spark).execute("MATCH (:Person)-[e:BORN_IN]->(:City {name: 'London'}) DELETE e")
    assert said(out) == "deleted 0 vertices, deleted 3 edges."


def test_merge(spark):
    g = graph(spark)
    new, out = g.execute("UNWIND ['London', 'Paris', 'Paris'] AS x MERGE (c:City {name: x}) RETURN c.name AS name")
    assert sorted(r[0] for r in out.collect()) == ["London", "Paris", "Paris"] and new.vertex("City").count() == 4
    text = "MATCH (a:Person {name: 'Dennis Quaid'}), (c:City) MERGE (a)-[e:BORN_IN]->(c) ON CREATE SET e.weight = 2.5 ON MATCH SET e.weight = 1.0"
    new, _ = g.execute(text)
    rows = new.cypher("MATCH (a:Person {name: 'Dennis Quaid'})-[e:BORN_IN]->(c) RETURN c.name, e.weight").collect()
    assert {tuple(r) for r in rows} == {("Houston", 1.0), ("London", 2.5), ("New York", 2.5)}


def test_inline_property_of_another_variable(spark):
    rows = graph(spark).cypher("UNWIND ['London', 'Rome'] AS x MATCH (c:City {name: x})<-[:BORN_IN]-(p) RETURN count(p) AS n").collect()
    assert rows[0][0] == 3


def test_window_functions(spark):
    rows = graph(spark).cypher("MATCH (p:Person)-[e:BORN_IN]->(c:City) RETURN p.name AS p, rank() OVER (PARTITION BY c.name ORDER BY e.weight) AS r, sum(ALL e.weight) OVER (PARTITION BY c.name) AS s").collect()
    got = {r["p"]: (r["r"], round(r["s"], 2)) for r in rows}
    assert got["Christopher Nolan"] == (1, 60.32) and got["Vanessa Redgrave"] == (3, 60.32) and got["Dennis Quaid"] == (1, 19.11)


def test_stream_upserts_and_windows(spark, tmp_path):
    empty = series.create(spark, "bigint", {"v": "double"})
    schema = "element long, ts timestamp_ntz, v double, seq long"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def feed(rows):
        df = spark.createDataFrame(rows, "element long, ts string, v double, seq long")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        upsert_stream(stream, out, str(tmp_path / "state"), empty, "seq").awaitTermination()
        return {(r["element"], r["ts"].hour): r["v"] for r in read_series(spark, out, empty).collect()}

    first = feed([(1, "2024-01-01 02:00:00", 1.0, 1), (1, "2024-01-01 02:00:00", 2.0, 2), (2, "2024-01-01 05:00:00", 5.0, 3)])
    assert first == {(1, 2): 2.0, (2, 5): 5.0}
    second = feed([(1, "2024-01-01 01:00:00", 9.0, 4), (1, "2024-01-01 02:00:00", None, 5)])  # a late point; a null replaces too
    assert second == {(1, 1): 9.0, (1, 2): None, (2, 5): 5.0}
    compact(spark, out, empty, str(tmp_path / "compact"))
    held = read_series(spark, str(tmp_path / "compact"), empty)
    assert held.count() == 3
    rows = windowed(held, "v", "4 hours").collect()
    assert {(r["element"], r["start"].hour, r["count"], r["sum"]) for r in rows} == {(1, 0, 1, 9.0), (2, 4, 1, 5.0)}
