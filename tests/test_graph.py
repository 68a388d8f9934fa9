import gzip
import random

import pytest
from pyspark.sql import functions as F

from weft.operators import algorithms as A
from weft.operators import dml
from weft.operators.graph import EDGE_DDL, VERTEX_DDL, PropertyGraph
from weft.sources import snb_csv
from weft.sources.catalog import Database

TOY = [(1, 2), (2, 3), (3, 1), (4, 5), (6, 6), (3, 7)]


def graph(spark, vids, edges):
    v = spark.createDataFrame([(i, ["N"], {}) for i in vids], VERTEX_DDL)
    return PropertyGraph(v, spark.createDataFrame([(s, d, "e", {}, False, False) for s, d in edges], EDGE_DDL))


def toy(spark):
    return graph(spark, range(1, 8), TOY)


def test_toy_counts(spark):
    g = toy(spark)
    assert A.run_algorithm(g, "wcc").first()[0] == 3
    assert A.run_algorithm(g, "scc").first()[0] == 5
    assert A.run_algorithm(g, "bfs", source=1).first()[0] == 4
    assert A.run_algorithm(g, "nothing") is None
    assert {r["vid"]: r["level"] for r in A.bfs(g).collect()} == {1: 0, 2: 1, 3: 2, 7: 3}
    s = g.summary().first()
    assert (s["num_vertices"], s["num_edges"], s["num_edge_labels"]) == (7, 6, 1)
    assert {r["vid"]: r["idx"] for r in g.dense_ids().collect()} == {i: i - 1 for i in range(1, 8)}


def test_queries_run_on_the_whole_graph(spark, monkeypatch):
    from weft.plans import graph as P

    monkeypatch.setattr(P, "social_graph", lambda spark, sf_dir: toy(spark))
    monkeypatch.setitem(A._registry, "pagerank", lambda g: g.edges.agg(F.count(F.lit(1)).cast("double").alias("result")))
    run = lambda name: P.QUERIES[name](spark, "")
    got = {r["algorithm"]: r["result"] for r in run("algorithm_runner").collect()}
    assert got == {"pagerank": 6, "wcc": 3, "scc": 5, "bfs": 4}
    assert run("pagerank_residual").first()[0] == 6 and run("wcc_labels").count() == 7


def test_empty_graph(spark):
    g = graph(spark, [], [])
    assert g.summary().first()["num_vertices"] == 0 and g.vertex(0).count() == 0 and g.preview().count() == 0
    assert A.wcc(g).count() == 0 and A.scc(g).count() == 0 and A.bfs(g).count() == 0 and A.pagerank(g)[0].count() == 0
    one = dml.add_vertex(g, 0, [], {})
    assert one.vertex(0).count() == 1 and A.run_algorithm(one, "wcc").first()[0] == 1


def union_find(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(n)}


def reach(n, edges):
    out = {i: {i} for i in range(n)}
    for _ in range(n):
        for a, b in edges:
            for i in range(n):
                if a in out[i]:
                    out[i].add(b)
    return out


def test_random_graphs(spark):
    rng = random.Random(1)
    n = 24
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(28)]
    g = graph(spark, range(n), edges)
    assert {r["vid"]: r["component"] for r in A.wcc(g).collect()} == union_find(n, edges)
    r = reach(n, edges)
    assert {x["vid"]: x["component"] for x in A.scc(g).collect()} == {i: max(j for j in r[i] if i in r[j]) for i in range(n)}
    ranks, delta, rounds = A.pagerank(g, 6, None)
    x = [1 / n] * n
    outs = [sum(a == i for a, _ in edges) for i in range(n)]
    for _ in range(6):
        y = [0.0] * n
        for a, b in edges:
            y[b] += 0.85 * x[a] / outs[a]
        spare = (1 - sum(y)) / n
        x = [v + spare for v in y]
    got = {q["vid"]: q["rank"] for q in ranks.collect()}
    assert rounds == 6 and all(abs(got[i] - x[i]) < 1e-9 for i in range(n)) and abs(sum(got.values()) - 1) < 1e-9
    _, delta, rounds = A.pagerank(g, tolerance=0.05)
    assert delta <= 0.05 and 0 < rounds < 20
    chain = graph(spark, range(12), [(i, i + 1) for i in range(11)])
    assert A.wcc(chain).select("component").distinct().count() == 1


def test_writes(spark):
    g = toy(spark)
    g = dml.add_edge(g, 1, 4, "T", {"k": "v"}, undirected=True)
    assert g.between(4, 1).first()["is_reverse"] and g.summary().first()["num_edges"] == 7
    assert dml.add_edge(g, 1, 99, "T", {}).edges.count() == g.edges.count() == dml.add_edge(g, 1, 4, "T", {}).edges.count()
    both = dml.add_edge(g, 1, 4, "S", {})
    assert dml.rm_edge(both, 1, 4, "S").between(1, 4).count() == 1 and dml.rm_edge(both, 1, 4).between(1, 4).count() == 0
    left, gone = dml.rm_undirected(both, 4, 1, "T")
    assert gone.first()[0] == 1 and left.between(4, 1).count() == 0 and left.between(1, 4).count() == 1
    less = dml.rm_vertex(g, 3)
    assert less.vertex(3).count() == 0 and less.edges.filter("src = 3 or dst = 3").count() == 0
    again = dml.add_vertex(less, 3, ["N"], {})
    assert again.vertex(3).count() == 1 and again.edges.filter("src = 3 or dst = 3").count() == 0
    assert dml.add_vertex(g, 1, ["Other"], {}).vertex(1).first()["labels"] == ["N"]
    assert dml.add_vertex_auto(g, ["N"], {}).vertices.agg(F.max("vid")).first()[0] == 8
    assert dml.prune(PropertyGraph(g.vertices.filter("vid <> 3"), g.edges)).edges.filter("src = 3 or dst = 3").count() == 0


def test_patterns(spark):
    g = toy(spark)
    assert g.path(1, []).count() == 0 and g.path(99, [("e", "N")]).count() == 0
    assert {(r["src"], r["dst"]) for r in g.path(1, [("e", "N"), ("e", "N"), ("e", "N")]).collect()} == {(3, 1), (3, 7)}
    assert g.pattern("N", "nope").count() == 0 and g.pattern("Nope").count() == 0
    assert {r["dst"] for r in g.neighbours(3).collect()} == {1, 7}
    assert {r["vid"] for r in g.vertices_where((F.col("outdegree") == 0) & (F.col("indegree") == 1)).collect()} == {5, 7}


def test_a_root_may_be_any_number_of_replies_away(spark):
    from weft.operators import snb

    message = lambda i, label: (i, [label, "Message"], {"creationDate": str(i)})
    v = [(1, ["Person"], {"firstName": "A", "lastName": "B"}), message(100, "Post")] + [message(i, "Comment") for i in (*range(101, 116), 201, 202)]
    e = [(116 - 1, 1, "hasCreator"), (202, 1, "hasCreator"), (100, 1, "hasCreator"), (201, 202, "replyOf"), (202, 201, "replyOf")] + [(i, i - 1, "replyOf") for i in range(101, 116)]
    g = PropertyGraph(spark.createDataFrame(v, VERTEX_DDL), spark.createDataFrame([(*x, {}, False, False) for x in e], EDGE_DDL))
    assert {r["messageId"]: (r["postId"], r["personId"]) for r in snb.person_messages(g, 1).collect()} == {115: (100, 1), 100: (100, 1), 202: (None, None)}


def test_catalog_and_rollback(spark, tmp_path):
    from weft.operators.changelog import CHANGE_DDL

    db = Database(spark, f"file://{tmp_path}/db")
    assert db.graph_table().count() == 0 and db.create_graph("g") and not db.create_graph("g") and db.exists("g")
    assert db.open_graph("g").vertices.count() == 0
    db.save("g", toy(spark))
    assert Database(spark, f"file://{tmp_path}/db").open_graph("g").edges.count() == 6 and db.info()["graphs"] == 1
    add = lambda seq, vid: (seq, "vertex", "add", vid, None, None, None, ["N"], {}, False, True)
    for i in range(7):
        db.append("g", spark.createDataFrame([add(i, i)], CHANGE_DDL))
        db.create_rollback("g", f"p{i}")
    assert [r["name"] for r in db.rollback_points("g").collect()] == ["p2", "p3", "p4", "p5", "p6"]
    assert db.rollback("g", "p3").vertices.count() == 4 and db.rollback("g").vertices.count() == 7
    db.compact("g", "p2")
    assert db.open_graph("g").vertices.count() == 3
    db.drop_graph("g")
    assert not db.exists("g")


def test_snapshot_reader(spark, tmp_path):
    for part in ("initial_snapshot/static/vertices", "initial_snapshot/static/edges", "initial_snapshot/dynamic/vertices", "initial_snapshot/dynamic/edges", "inserts", "deletes"):
        (tmp_path / part).mkdir(parents=True)
    s = tmp_path / "initial_snapshot"
    (s / "static/vertices/Place.csv").write_text("id|name|type\n1|Oslo|city\n2|Norway|country\n")
    (s / "static/edges/Place_isPartOf_Place.csv").write_text("Place1Id|Place2Id\n1|2\n")
    (s / "dynamic/vertices/Post").mkdir()
    with gzip.open(s / "dynamic/vertices/Post/part-0.csv.gz", "wt") as f:
        f.write('creationDate|id|content\n5|10|"a|b ""q"""\n')
    (s / "dynamic/vertices/Person.csv").write_text("creationDate|id|firstName\n5|20|A\n6|21|\n")
    (s / "dynamic/edges/Person_knows_Person.csv").write_text("creationDate|Person1Id|Person2Id\n7|20|21\n")
    g = snb_csv.read_snb(spark, f"file://{tmp_path}")
    rows = {r["vid"]: (r["labels"], r["props"]) for r in g.vertices.collect()}
    assert rows == {1: (["Place", "City"], {"name": "Oslo"}), 2: (["Place", "Country"], {"name": "Norway"}), 10: (["Post", "Message"], {"creationDate": "5", "content": 'a|b "q"'}), 20: (["Person"], {"creationDate": "5", "firstName": "A"}), 21: (["Person"], {"creationDate": "6"})}
    assert {(r["src"], r["dst"], r["label"], r["is_reverse"]) for r in g.edges.collect()} == {(1, 2, "isPartOf", False), (20, 21, "knows", False), (21, 20, "knows", True)}
    ids = {(r["tab"], r["vid"]): r["new_id"] for r in snb_csv.remap_ids({"a": g.vertices.filter("vid > 5"), "b": g.vertices.filter("vid < 5")}).collect()}
    assert ids == {("a", 10): 0, ("a", 20): 1, ("a", 21): 2, ("b", 1): 3, ("b", 2): 4}
    with pytest.raises(FileNotFoundError):
        snb_csv.read_snb(spark, f"file://{tmp_path}/nothing")
