import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from weft import session
from weft.operators import algorithms as A
from weft.operators.graph import EDGE_DDL, VERTEX_DDL, PropertyGraph, dense_rank, write_edges
from weft.sources import snb_csv
from weft.sources.catalog import Database


def graph(spark, n=4):
    v = spark.createDataFrame([(i, ["N"], {"k": str(i)}) for i in range(n)], VERTEX_DDL)
    return PropertyGraph(v, spark.createDataFrame([(i, (i + 1) % n, "e", {"w": "1"}, False, False) for i in range(n)], EDGE_DDL))


def edges(g):
    return {(r["src"], r["dst"], r["label"], r["is_reverse"]) for r in g.edges.collect()}


def test_what_committed_is_there_after_a_crash(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    db = Database(spark, path)
    db.create_graph("g")
    db.load("g", graph(spark))
    with db.begin("g") as tx:
        tx.add_vertex(9, ["M"], {})
        tx.add_edge(9, 0, "t", {"a": "b"}, undirected=True)
        tx.add_edge(9, 77, "t", {})
    db.create_rollback("g", "first")
    with db.begin("g") as tx:
        tx.rm_vertex(1)
        tx.rm_edge(2, 3, "e")
    with pytest.raises(ZeroDivisionError), db.begin("g") as tx:
        tx.rm_vertex(0)
        1 / 0
    lost = db.begin("g")
    lost.rm_vertex(9)
    lost.flush()  # the crash comes before the commit
    anew = Database(spark, path)
    want = {(3, 0, "e", False), (9, 0, "t", False), (0, 9, "t", True)}
    assert edges(anew.open_graph("g")) == want and {r["vid"] for r in anew.open_graph("g").vertices.collect()} == {0, 2, 3, 9}
    assert edges(anew.rollback("g", "first")) == edges(graph(spark)) | want and edges(anew.rollback("g")) == want
    anew.compact("g")
    assert edges(anew.open_graph("g")) == want and edges(anew.rollback("g", "first")) == edges(graph(spark)) | want
    with anew.begin("g") as tx:
        tx.add_vertex(1, ["N"], {})
        tx.add_edge(2, 3, "e", {"w": "2"})
    assert edges(anew.open_graph("g")) == want | {(2, 3, "e", False)}
    assert anew.log("g").filter("committed").count() == 7 and anew.log("g").count() == 9
    assert len([f for f in os.listdir(tmp_path / "db/g") if f.startswith("snapshot")]) == 2
    with pytest.raises(RuntimeError):
        tx.rm_vertex(0)


def test_a_table_of_changes_is_logged_in_its_order(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    db.create_graph("g")
    rows = [(2, "edge", "add", None, 1, 0, "e", None, {}, False), (0, "vertex", "add", 0, None, None, None, ["N"], {}, False), (1, "vertex", "add", 1, None, None, None, ["N"], {}, False), (3, "vertex", "remove", 0, None, None, None, None, None, False)]
    changes = spark.createDataFrame(rows, "at bigint, kind string, op string, vid bigint, src bigint, dst bigint, label string, labels array<string>, props map<string,string>, undirected boolean")
    with db.begin("g") as tx:
        tx.add_all(changes)
        tx.add_vertex(5, [], {})
    assert [(r["seq"], r["vid"]) for r in db.log("g").orderBy("seq").collect()] == [(0, 0), (1, 1), (2, None), (3, 0), (4, 5)]
    assert {r["vid"] for r in db.open_graph("g").vertices.collect()} == {1, 5} and not edges(db.open_graph("g"))


def test_a_crash_between_renames_keeps_the_manifest(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    db.create_graph("g")
    os.rename(tmp_path / "db/manifest.json", tmp_path / "db/manifest.json.old")
    assert Database(spark, f"file://{tmp_path}/db").exists("g")


def test_a_snapshot_written_is_read_again(spark, tmp_path):
    v = [(1, ["City", "Place"], {"name": "Oslo"}), (2, ["Country", "Place"], {"name": " N|or \"way\"\n"}), (10, ["Post", "Message"], {"content": "", "creationDate": "5"}), (11, ["Comment", "Message"], {}), (20, ["Person"], {"firstName": "A"}), (21, ["Person"], {})]
    e = [(1, 2, "isPartOf", {}, False, False), (20, 21, "knows", {"creationDate": "7"}, True, False), (21, 20, "knows", {"creationDate": "7"}, True, True), (11, 10, "replyOf", {"creationDate": "6", "property_c": "2"}, False, False), (20, 20, "knows", {}, True, False)]
    g = PropertyGraph(spark.createDataFrame(v, VERTEX_DDL), spark.createDataFrame(e, EDGE_DDL))
    root = f"file://{tmp_path}/snb"
    snb_csv.write_snb(g, root)
    back = snb_csv.read_snb(spark, root)
    rows = lambda g: ({(r["vid"], tuple(sorted(r["labels"])), tuple(sorted(r["props"].items()))) for r in g.vertices.collect()}, {(r["src"], r["dst"], r["label"], tuple(sorted(r["props"].items())), r["is_reverse"]) for r in g.edges.collect()})
    assert rows(back) == rows(g)
    dense = snb_csv.read_snb(spark, root, remap=True)
    new = {1: 0, 2: 1, 11: 2, 20: 3, 21: 4, 10: 5}  # files in order: places, comments, persons, posts
    assert {r["vid"] for r in dense.vertices.collect()} == set(range(6))
    assert {(r["src"], r["dst"], r["is_reverse"]) for r in dense.edges.collect()} == {(new[s], new[d], rev) for s, d, _, _, _, rev in e}


def test_edges_are_remapped_by_the_files_their_names_stand_for(spark):
    ids = snb_csv.remap_ids({"Place": spark.createDataFrame([(7,), (9,)], "vid bigint"), "Person": spark.createDataFrame([(7,)], "vid bigint")})
    e = spark.createDataFrame([(7, 9, "isLocatedIn", {}, False, False), (8, 7, "isLocatedIn", {}, False, False)], EDGE_DDL)
    assert {(r["src"], r["dst"]) for r in snb_csv.remap_edges(e, "Person_isLocatedIn_City", ids).collect()} == {(2, 1), (8, 0)}


def test_ranks_of_any_column(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = sorted((r["k"], r["n"]) for r in dense_rank(df, "k", "n").collect())
    assert [n for _, n in got] == list(range(1000)) and dense_rank(df.limit(0), "k", "n").count() == 0


def test_labels_are_written_apart(spark, tmp_path):
    rows = spark.range(2000).select(F.lit(1).cast("bigint").alias("src"), F.col("id").alias("dst"), F.when(F.col("id") < 3, "few").otherwise("many").alias("label"), F.create_map().cast("map<string,string>").alias("props"))
    write_edges(rows, f"file://{tmp_path}/e")
    assert len([f for f in os.listdir(tmp_path / "e/label=few") if f.endswith(".parquet")]) == 1
    assert spark.read.parquet(f"file://{tmp_path}/e").count() == 2000


def test_a_scope_removes_what_was_staged_in_it(spark):
    with session.scratch_scope():
        kept = session.scratch_path(spark, "kept", lasting=True)
        df = session.stage(spark.range(3))
        path = df.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and df.count() == 3
        A.wcc(graph(spark)).collect()
    assert not os.path.exists(path) and not any(p == kept for _, p in session._scopes)


def test_a_cluster_must_name_its_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda _: None))
    with pytest.raises(RuntimeError):
        session.scratch_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_results_are_kept_with_tag_and_time(spark):
    table = A.ResultTable()
    table.run("mine", "wcc", lambda: A.run_algorithm(graph(spark), "wcc"))
    row = table.table(spark).first()
    assert (row["tag"], row["name"]) == ("mine", "wcc") and row["seconds"] > 0 and table.get("mine").first()[0] == 1 and table.get("none") is None


def test_labels_that_still_change_are_told(spark, caplog):
    chain = PropertyGraph.from_edges(spark.createDataFrame([(i, i + 1) for i in range(9)], "src bigint, dst bigint"))
    with caplog.at_level("WARNING"):
        A.directed_min_label(chain, rounds=2).collect()
    assert "stopped after 2 rounds" in caplog.text
