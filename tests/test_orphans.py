import datetime as dt

from weft.operators.orphans import OrphanCheck

DAY = dt.datetime(2024, 1, 10)
E = "edge_id bigint, src bigint, dst bigint, label string, loaded_at timestamp_ntz, tab int, n int"
V = "id bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz, gone int"


def check(spark, edges, people, messages=(), share=0.3):
    tables = {"person": (spark.createDataFrame(list(people), V), "id"), "message": (spark.createDataFrame(list(messages), V), "id")}
    return OrphanCheck(spark.createDataFrame([(*e, 0, 0) for e in edges], E), tables, share)


def test_reasons_and_counts(spark):
    later, before = DAY + dt.timedelta(days=1), DAY - dt.timedelta(days=1)
    people = [(1, before, None, 0), (2, before, DAY, 0), (2, before, DAY, 0), (3, later, None, 0), (4, before, DAY, 0), (4, later, None, 0), (None, before, None, 0)]
    edges = [(10, 1, 2, "KNOWS", DAY), (11, 3, 9, "knows", DAY), (12, 4, None, "knows", DAY), (13, 1, 1, "unknown", DAY), (14, 9, 1, None, DAY), (15, 3, 1, "knows", later), (16, 3, 1, "knows", None), (17, 1, 1, "likes", DAY)]
    c = check(spark, edges, people, [(1, later, None, 0)])
    rows = {(r["edge_id"], r["endpoint"], r["reason"]) for r in c.rows().collect()}
    assert rows == {(10, "dst", "deleted"), (11, "src", "late"), (11, "dst", "missing"), (17, "dst", "late")}
    counts = {(r["tab"], r["period"], r["reason"]): r["n"] for r in c.counts().collect()}
    assert counts == {("person", "2024-01", "deleted"): 1, ("person", "2024-01", "late"): 1, ("person", "2024-01", "missing"): 1, ("message", "2024-01", "late"): 1}


def test_heavy_key_same_as_light(spark):
    edges = [(i, 1, 5 if i % 2 else i, "knows", DAY) for i in range(100, 300)]
    people = [(1, DAY, None, 0), (5, DAY, DAY, 0)] + [(i, DAY, None, 0) for i in range(100, 300, 4)]
    heavy, light = check(spark, edges, people, share=0.1), check(spark, edges, people, share=1.1)
    a, b = sorted(heavy.rows().collect()), sorted(light.rows().collect())
    assert a == b and len(a) == 150
    assert heavy.heavy.count() == 2 and light.heavy.count() == 0
    assert sorted(heavy.counts().collect()) == sorted(light.counts().collect())


def test_empty(spark):
    assert check(spark, [], []).rows().count() == 0
    assert {r["reason"] for r in check(spark, [(1, 2, 3, "knows", DAY)], []).rows().collect()} == {"missing"}
