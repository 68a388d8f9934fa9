import random

import pytest
from pyspark.sql import functions as F

from test_graph import graph
from weft.operators import algorithms as A
from weft.sources import social


def outcome(g):
    ranks, delta, rounds = A.pagerank(g, tolerance=1e-2)
    pairs = lambda df: sorted(map(tuple, df.collect()))
    return [(v, round(r, 9)) for v, r in pairs(ranks)], round(delta, 10), rounds, pairs(A.wcc(g)), pairs(A.scc(g)), pairs(A.bfs(g)), pairs(A.bfs(g, source=5))


@pytest.mark.parametrize("vids,edges", [(range(30), None), ([], []), (range(3), [(0, 99), (99, 1), (2, 2), (1, 2), (1, 2), (2, 1)])])
def test_one_task_gives_what_rounds_give(spark, monkeypatch, vids, edges):
    rng = random.Random(3)
    g = graph(spark, vids, [(rng.randrange(30), rng.randrange(30)) for _ in range(36)] if edges is None else edges)
    one = outcome(g)
    monkeypatch.setattr(A, "ONE_TASK", -1)
    assert outcome(g) == one


def write(spark, path, name, ddl, rows):
    spark.createDataFrame(rows, ddl).write.parquet(f"{path}/{name}.parquet")


def test_algorithms_read_ends_only(spark, tmp_path):
    from weft.plans import graph as P

    at = f"file://{tmp_path}"
    own = "loaded_at bigint, deleted_at bigint"
    write(spark, at, "place", f"id bigint, label string, name string, part_of bigint, {own}", [(1, "City", "a", 2, 1, None), (2, "Country", "b", None, 1, None), (1, "City", "a", 3, 0, None), (3, None, "c", 99, 1, None)])
    write(spark, at, "tag", f"id bigint, name string, tag_class string, {own}", [(10, "t", None, 1, None), (11, "t", None, 1, 5), (None, "t", None, 1, None)])
    write(spark, at, "forum", f"id bigint, title string, creationDate bigint, {own}", [(20, "f", 1, 1, None)])
    write(spark, at, "person", f"personId bigint, firstName string, lastName string, creationDate bigint, {own}", [(i, "p", "q", 1, 1, None) for i in (30, 31, 32)] + [(30, "r", "q", 1, 2, None), (33, "p", "q", 1, 1, 2)])
    # 41's and 42's rows tell different persons: the last loaded counts, on a tie the greater columns
    messages = [(40, "Post", "x", 1, 30, 1, None), (40, "Post", "y", 1, 30, 2, None), (41, "Post", "x", 1, 30, 2, None), (41, "Post", "x", 1, 31, 1, None), (42, "Post", "b", 1, 30, 1, None), (42, "Post", "a", 1, 31, 1, None)]
    messages += [(43, "Comment", "x", 1, None, 2, None), (43, "Comment", "x", 1, 31, 1, None), (44, "Comment", "x", 1, 33, 1, None), (45, "Comment", "x", 1, None, 1, None), (46, "Comment", "x", 1, 30, 1, 9)]
    write(spark, at, "message", f"id bigint, label string, content string, creationDate bigint, personId bigint, {own}", messages)
    edges = [(30, 31, "knows"), (31, 30, "KNOWS"), (32, 32, "knows"), (30, 33, "knows"), (30, 40, "likes"), (30, 40, "likes"), (30, 40, "Likes"), (43, 40, "replyOf"), (46, 40, "replyOf"), (40, 10, "hasTag"), (40, 11, "hasTag"), (30, 31, "nothing"), (30, None, "likes"), (20, 30, "hasMember"), (40, 30, "likes")]
    write(spark, at, "edges", "edge_id bigint, src bigint, dst bigint, label string, property_c int, creationDate bigint", [(i, *e, 1, 1) for i, e in enumerate(edges)])
    g = social.social_graph(spark, at)
    ids, links = sorted(map(tuple, g.ids.collect())), sorted(map(tuple, g.links.collect()))
    results = {name: P.QUERIES[name](spark, at).collect() for name in ("pagerank_residual", "algorithm_runner")}
    # neither loads properties and labels
    assert (spark.sparkContext.applicationId, at) not in social._loaded
    assert ids == sorted(map(tuple, g.vertices.select("vid").collect())) and links == sorted(map(tuple, g.edges.select("src", "dst").collect()))
    assert {(41, 30), (42, 30), (30, 31), (31, 30), (32, 32), (1, 2)} <= set(links) and len(links) == 11
    assert len(results["algorithm_runner"]) == 4 and g.edges.filter(F.col("src") == 43).count() == 1
