"""Updates, series writes, algorithms on small graphs, sources and sampling."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import series
from loomgraph.operators import algorithms as A
from loomgraph.operators import fulltext, procedures, sampling, vectors
from loomgraph.operators.components import components
from loomgraph.plans.graph import Graph, SchemaError
from loomgraph.sources.files import export_graph, import_graph, read_edge_list
from tests.yago import graph


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def ids(spark, n):
    return spark.range(n).select("id")


def as_dict(df, key="id"):
    return {r[key]: r[[c for c in df.columns if c != key][0]] for r in df.collect()}


TRIANGLE_TAIL = [(0, 1), (1, 2), (2, 0), (2, 3)]


def test_updates(spark):
    g = graph(spark)
    g2 = g.delete_vertices("Person", F.col("name") == "Liam Neeson")
    assert g2.vertex("Person").count() == 12 and g2.edge("MARRIED").count() == 2 and g2.edge("ACTED_IN").count() == 7
    g3 = g.set_properties("Person", F.col("name") == "Roy Redgrave", {"birthyear": F.lit(1)})
    assert g3.vertex("Person").where("birthyear = 1").count() == 1
    assert g.remove_properties("Person", F.lit(True), ["birthyear"]).vertex("Person").where("birthyear is null").count() == 13
    with pytest.raises(SchemaError):
        g.set_properties("Person", F.lit(True), {"shoe": F.lit(1)})
    new = spark.createDataFrame([("Roy Redgrave", 5), ("New One", 6)], "name string, birthyear smallint")
    merged = g.merge_vertices("Person", new, "name", on_match={"birthyear": F.lit(7)})
    assert {r[0]: r[1] for r in merged.vertex("Person").where("name in ('Roy Redgrave', 'New One')").select("name", "birthyear").collect()} == {"Roy Redgrave": 7, "New One": 6}
    with pytest.raises(SchemaError):
        g.insert_vertices("Person", spark.createDataFrame([(99, "Roy Redgrave")], "_vid long, name string"))
    assert g.subgraph([0, 1, 2]).pairs().count() == 4
    assert {(r["label"], r["count"]) for r in g.counts().collect()} >= {("Person", 13), ("HAS_CHILD", 7)}


def test_series_writes(spark):
    s = series.create(spark, "string", {"close": "double", "volume": "bigint"})
    point = lambda c, v=None: spark.createDataFrame([("a", "2024-01-01", c, v)], "element string, ts string, close double, volume long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    s = series.append(s, point(1.0, 5))
    s = series.append(s, point(2.0).drop("volume"))
    assert [tuple(r)[2:] for r in s.collect()] == [(2.0, None)]
    s = series.update(s, "a", "2024-01-01", "volume", 9)
    assert [tuple(r)[2:] for r in s.collect()] == [(2.0, 9)]
    s, n = series.update_cas(s, "a", "2024-01-01", "volume", 8, 10)
    assert n == 0
    s, n = series.update_cas(s, "a", "2024-01-01", "volume", 9, 10)
    assert n == 1 and s.first()["volume"] == 10
    s, n = series.update_cas(s, "b", "2024-01-01", "close", None, 1.5)
    assert n == 1 and s.count() == 2 and series.clear(s, "a").count() == 1
    with pytest.raises(Exception, match="not finite"):
        series.append(s, point(float("nan"))).collect()
    with pytest.raises(series.SeriesError):
        series.create(spark, "string", {"x": "double"}, {"nonsense": 1})
    left = spark.createDataFrame([("a", "2024-06-01"), ("a", "2023-06-01")], "who string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert sorted(str(r["volume"]) for r in series.as_of(left, s, "who", "t").collect()) == ["10", "None"]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (5, 5)], "u long, v long")
    found = as_dict(components(e), "node")
    assert as_dict(components(e, solo=0), "node") == found
    assert all(found[i] == 0 for i in range(31)) and found[102] == 100 and len(found) == 34


def test_vertex_ids_do_not_collide(spark):
    many = spark.range(100).select(F.concat(F.lit("n"), "id").alias("name")).repartition(12)
    g = Graph.empty().with_vertices("A", many, "name").with_vertices("B", many, "name")
    g = g.merge_vertices("A", spark.createDataFrame([("n1",), ("new",)], "name string"), "name")
    ids_ = g.ids()
    assert ids_.count() == 201 and ids_.distinct().count() == 201
    assert sorted(map(tuple, g.ids().collect())) == sorted(map(tuple, ids_.collect()))


def test_ranking(spark):
    e = edges(spark, TRIANGLE_TAIL)
    rank = as_dict(A.pagerank(ids(spark, 4), e, 30))
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank[2] == max(rank.values())
    assert as_dict(A.personalized_pagerank(ids(spark, 4), e, 3)) == {}
    h = {r["id"]: r for r in A.hits(ids(spark, 4), e, 20).collect()}
    assert abs(sum(r["hub"] ** 2 for r in h.values()) - 1) < 1e-6
    assert abs(sum(as_dict(A.sybilrank(ids(spark, 4), e, [0])).values()) - 1) < 1e-9
    assert as_dict(A.trustrank(ids(spark, 4), e, [0], 1))[1] == pytest.approx(0.85)
    w = spark.createDataFrame([(0, 1, 3.0), (0, 2, 1.0)], "src long, dst long, weight double")
    r = as_dict(A.weighted_pagerank(ids(spark, 3), w, 1))
    assert r[1] - r[2] == pytest.approx(0.85 / 3 * 0.5)


def test_paths(spark):
    e = edges(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (4, 0)])
    assert as_dict(A.sssp(e, 0)) == {0: 0.0, 1: 1.0, 2: 1.0, 3: 2.0}
    assert A.spsp(e, 4, 3) == 3 and A.spsp(e, 3, 4) == -1 and A.spsp(e, 1, 1) == 0
    assert {(r["root"], r["id"]) for r in A.apsp(e).where("dist = 3").collect()} == {(4, 3)}
    assert {r["id"]: (r["depth"], r["parent"]) for r in A.bfs(e, 0).collect()}[3] == (2, 2)
    diamond = edges(spark, [(0, 1), (0, 2), (1, 3), (2, 3)])
    assert sorted(r["nodes"] for r in A.all_shortest_paths(diamond, 0, 3).collect()) == [[0, 1, 3], [0, 2, 3]]
    assert as_dict(A.betweenness(diamond)) == {0: 0.0, 1: 0.5, 2: 0.5, 3: 0.0}
    assert as_dict(A.closeness(diamond))[0] == pytest.approx(3 / 4)
    two = spark.createDataFrame([(0, 1, 5.0), (1, 2, 7.0)], "src long, dst long, weight double")
    assert as_dict(A.closeness(two, [2])) == {0: pytest.approx(1 / 12), 1: pytest.approx(1 / 7)} and as_dict(A.closeness(two, [0])) == {}
    assert A.egonet(diamond, 0, 1) == 3 and A.dimension_estimation(diamond, [3]) == 2
    w = spark.createDataFrame([(0, 1, 5.0), (0, 2, 1.0), (2, 1, 1.0)], "src long, dst long, weight double")
    assert as_dict(A.mssp(w, [0])) == {0: 0.0, 1: 2.0, 2: 1.0}
    assert [r["id"] for r in A.khop(e, 4, 3).collect()] == [3]


def test_structure(spark):
    e = edges(spark, [*TRIANGLE_TAIL, (0, 1), (3, 3)])
    n = ids(spark, 4)
    assert as_dict(A.triangle_count(n, e)) == {0: 1, 1: 1, 2: 1, 3: 0}
    assert as_dict(A.local_clustering(n, e))[2] == pytest.approx(1 / 3)
    pair = spark.createDataFrame([(0, 1), (0, 3)], "a long, b long")
    assert {r["b"]: r["similarity"] for r in A.jaccard(e, pair).collect()} == {1: pytest.approx(1 / 3), 3: pytest.approx(1 / 2)}
    assert as_dict(A.kcore(n, e, 2)) == {0: True, 1: True, 2: True, 3: False}
    assert sorted(tuple(r) for r in A.ktruss(e, 3).collect()) == [(0, 1), (0, 2), (1, 2)]
    k4 = edges(spark, [(a, b) for a in range(4) for b in range(a)])
    assert as_dict(A.kcliques(k4, 4)) == {i: 1 for i in range(4)} and as_dict(A.kcliques(k4, 3)) == {i: 3 for i in range(4)}
    assert A.locate_cycles(edges(spark, TRIANGLE_TAIL), 3) == 1 and A.locate_cycles(e, 3) == 2 and A.locate_cycles(e, 1) == 1
    assert A.subgraph_isomorphism(n, edges(spark, TRIANGLE_TAIL), [[1], [2], [0]]).count() == 3
    assert {r["code"]: r["count"] for r in A.motif(edges(spark, TRIANGLE_TAIL), [0], 3).collect()} and A.motif(edges(spark, TRIANGLE_TAIL), [0], 3).agg(F.sum("count")).first()[0] == 2
    chosen = as_dict(A.maximal_independent_set(n, e))
    assert chosen == {0: True, 1: False, 2: False, 3: True}


def test_communities(spark):
    two = edges(spark, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)])
    n = ids(spark, 7)
    for f in (A.louvain, lambda i, e: A.leiden(i, e, 1.0)):
        got = as_dict(f(n, two))
        assert len({got[0], got[1], got[2]}) == 1 and len({got[3], got[4], got[5]}) == 1 and got[0] != got[3] and got[6] == 6
    assert A.modularity(two, A.louvain(n, two)) == pytest.approx(6 / 7 - 0.5)
    assert as_dict(A.wcc(n, two)) == {**{i: 0 for i in range(6)}, 6: 6}
    assert as_dict(A.scc(n, edges(spark, [(0, 1), (1, 0), (1, 2), (2, 3), (3, 2)]))) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6}
    assert len(set(as_dict(A.label_propagation(n, two, 5)).values())) >= 2
    assert all(r["labels"] is not None for r in A.speaker_listener(n, two, 3).collect())
    belief = as_dict(A.belief_propagation(n.withColumn("prior", F.when(F.col("id") == 0, 0.9).otherwise(0.5)), two, 5))
    assert belief[0] > belief[1] > 0.5


def test_search_and_sampling(spark):
    people = spark.createDataFrame([(i, [float(i)] * 4, f"name {'red fox' if i == 3 else 'dog'}") for i in range(1, 5)], "_vid long, v array<float>, t string")
    assert [r["_vid"] for r in vectors.knn(people, "v", [1.0, 2.0, 3.0, 4.0], 2).collect()] == [2, 3]
    assert vectors.within_radius(people, "v", [1.0] * 4, 4.0).count() == 2
    assert [r["_vid"] for r in fulltext.search(people, "t", "fox", 5).collect()] == [3]
    e, n = edges(spark, [(i, j) for i in range(6) for j in range(6) if i != j]), ids(spark, 6)
    assert sampling.neighbours(e, n, 2).groupBy("id").count().where("count = 2").count() == 6
    walks = sampling.node2vec_walks(e, n, 4, 2, 0.25, 4.0).collect()
    assert len(walks) == 12 and all(len(w["path"]) == 4 for w in walks)
    assert sampling.negative_edges(e.where("src < 5"), n, 3).where("src < 5").count() == 0
    assert 0 < sampling.edge_sample(e, 0.5).count() < 30


def test_import_and_export(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1,Ann,30\n2,Bob,x\n3,Cy,\n")
    (tmp_path / "k.json").write_text('["1", "3"]\n["1", "9"]\n')
    config = {
        "schema": [
            {"label": "P", "type": "VERTEX", "primary": "id", "properties": [{"name": "id", "type": "INT64"}, {"name": "name", "type": "STRING"}, {"name": "age", "type": "INT8", "optional": True}]},
            {"label": "K", "type": "EDGE", "constraints": [["P", "P"]]},
        ],
        "files": [
            {"path": f"{tmp_path}/p.csv", "format": "CSV", "label": "P", "columns": ["id", "name", "age"]},
            {"path": f"{tmp_path}/k.json", "format": "JSON", "label": "K", "SRC_ID": "P", "DST_ID": "P", "columns": ["SRC_ID", "DST_ID"]},
        ],
    }
    g, bad = import_graph(spark, json.dumps(config), continue_on_error=True)
    assert g.vertex("P").count() == 2 and g.edge("K").count() == 1 and bad.count() == 2
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        import_graph(spark, config)
    export_graph(g, f"{tmp_path}/out", "json")
    assert spark.read.json(f"{tmp_path}/out/vertices/P").count() == 2
    (tmp_path / "e.txt").write_text("# head\n0 1 2.5\n1 2 1\n")
    assert read_edge_list(spark, f"{tmp_path}/e.txt", weighted=True)[0].agg(F.sum("weight")).first()[0] == 3.5
    assert read_edge_list(spark, f"{tmp_path}/e.txt", string_ids=True)[1].count() == 3


def test_procedures(spark):
    g = graph(spark)
    procedures.register("mine", lambda graph_, n: graph_.spark.range(n))
    try:
        assert g.cypher("CALL plugin.cpp.mine(3) YIELD id RETURN sum(id) AS s").first()[0] == 3.0
    finally:
        procedures.unregister("mine")
    with pytest.raises(procedures.ProcedureError):
        g.cypher("CALL no.such() YIELD x RETURN x")


def test_communities_at_hand_equal_joins(spark, monkeypatch):
    from loomgraph.operators import communities as C

    rows = [((7 * i * i + 3 * i) % 40, (5 * i + i // 9) % 40, float(i % 5 + 1)) for i in range(130)] + [(3, 3, 2.0)]
    e, n = spark.createDataFrame(rows, "src long, dst long, weight double"), ids(spark, 42)
    for f in (A.louvain, lambda i, e: A.leiden(i, e, 1.0)):
        got = []
        for vertices, local in ((0, 0), (1000, 1000), (1000, 0)):  # by joins, in one block, in blocks of 50 edges
            monkeypatch.setattr(A, "VERTICES", vertices)
            monkeypatch.setattr(C, "LOCAL_EDGES", local)
            monkeypatch.setattr(C, "BLOCK_EDGES", 50)
            got.append(as_dict(f(n, e)))
        assert got[0] == got[1] == got[2] and len(got[0]) == 42


def test_empty_graph(spark):
    with pytest.raises(SchemaError):
        Graph.empty().all_vertices()


def test_registered_communities_run_to_the_end(spark, monkeypatch):
    from loomgraph import queries as Q

    calls = []
    monkeypatch.setattr(Q, "part_ids", lambda s, d: "ids")
    monkeypatch.setattr(Q, "part_edges", lambda s, d: "edges")
    for name in ("louvain", "leiden"):
        monkeypatch.setattr(Q.A, name, lambda *args, **given: calls.append((args, given)))
        Q.queries()[f"algo_{name}"](spark, "")
    assert calls == [(("ids", "edges"), {})] * 2  # the operators' own levels and rounds
