import datetime as dt
import os

import pytest

from weft.operators import compaction
from weft.operators.compaction import consolidate, consolidated, read_consolidated

DDL = "path string, written_at timestamp_ntz, size_bytes bigint, body string, entity int, id int"
DAY = dt.datetime(2024, 1, 1)


def files(spark, bodies):
    return spark.createDataFrame([(f"a/dynamic/{e}/part-{i}.csv", DAY + dt.timedelta(days=day), 0, b, 0, 0) for i, (e, day, b) in enumerate(bodies)], DDL)


def test_forms_of_bodies_and_copies(spark):
    head = "id|creationDate|content|personId"
    got = consolidated(
        files(
            spark,
            [
                ("Post", 1, f'﻿{head}\r\n1|5|"a\nb|c ""q"""|3\r\n'),
                ("Post", 2, "1|5|newer|3\n2|5||3"),
                ("Post", 0, f"{head}\n2|5|older|3\n"),
                ("Post", 1, ""), ("Post", 1, head), ("Post", 1, None), ("Odd", 1, "1|2"),
                ("Post", 1, "x|5|bad id|3\n3|5|too|many|fields\n"),
                ("Forum", 1, "id|title|creationDate\n1|t|9"),
            ],
        )
    ).collect()
    assert {(r["entity"], r["id"]): r["fields"]["content"] if r["entity"] == "Post" else None for r in got} == {("Post", 1): "newer", ("Post", 2): "", ("Forum", 1): None}
    assert len(got) == 3


def test_names_in_any_order_and_case(spark):
    got = consolidated(files(spark, [("Post", 1, "personId|CONTENT|id|creationDate\r\n3|hi|1|5\r\n"), ("Post", 1, "2|5|plain|4")])).collect()
    assert {r["id"]: r["fields"] for r in got} == {1: {"personId": "3", "content": "hi", "creationDate": "5"}, 2: {"personId": "4", "content": "plain", "creationDate": "5"}}


def test_sizes_and_swap(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    bodies = [("Person", i % 3, "\n".join(f"{k}|5|name{k}|x" for k in range(i * 20, i * 20 + 40))) for i in range(60)]
    counts = consolidate(files(spark, bodies), out, target_bytes=4000)
    assert counts["records"] == 1220 and counts["read"] >= 1220
    names = [f for f in os.listdir(tmp_path / "out" / "entity=Person") if f.endswith(".parquet")]
    assert 3 <= len(names) <= counts["parts"]
    ranges = sorted((df["lo"], df["hi"]) for n in names for df in [spark.read.parquet(f"{out}/entity=Person/{n}").selectExpr("min(id) lo", "max(id) hi").first()])
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    consolidate(files(spark, bodies[:1]), out)
    assert read_consolidated(spark, out).count() == 40 and os.listdir(tmp_path) == ["out"]


def test_every_record_is_accounted_for(spark, tmp_path):
    bodies = [("Post", 1, "x|5|bad id|3\n3|5|too|many|fields\n1|5|é|3\n1|5|é|3"), ("Odd", 1, "1|2\n3|4"), ("Post", 2, "1|5|new|3"), ("Forum", 1, "9|t|5")]
    counts = consolidate(files(spark, bodies), f"file://{tmp_path}/out")
    assert counts == {"read": 7, "rejected": 3, "repeats": 2, "records": 2, "parts": 2}
    read = compaction.read_part_files(files(spark, bodies))
    assert sorted(r["reason"] for r in read.filter("reason IS NOT NULL").collect()) == ["columns", "entity", "value"]
    sizes = {r["id"]: r["bytes"] for r in compaction.read_part_files(files(spark, [("Forum", 1, "1|ab|5\n2|éé|5")])).collect()}
    assert sizes[2] - sizes[1] == 2


def test_changed_fields_do_not_pass(spark, tmp_path, monkeypatch):
    bodies = files(spark, [("Forum", 1, "1|t|9"), ("Forum", 2, "1|u|9")])
    out = f"file://{tmp_path}/out"
    assert consolidate(bodies, out)["records"] == 1
    whole = compaction.read_consolidated
    monkeypatch.setattr(compaction, "read_consolidated", lambda spark, path: whole(spark, path).selectExpr("id", "map('creationDate', '9', 'title', 't') AS fields", "entity"))
    with pytest.raises(RuntimeError):
        consolidate(bodies, out)
    monkeypatch.setattr(compaction, "read_consolidated", lambda spark, path: whole(spark, path).filter("id <> 1"))
    with pytest.raises(RuntimeError):
        consolidate(bodies, out)


def test_one_of_two_bodies_of_a_path_is_chosen_whatever_the_batches(spark):
    rows = [("a/dynamic/Forum/p.csv", DAY, 0, f"1|{t}|9", 0, 0) for t in "abcd"]
    chosen = {consolidated(spark.createDataFrame(rows, DDL).repartition(n)).first()["fields"]["title"] for n in (1, 4)}
    assert len(chosen) == 1


def test_failure_leaves_the_old_folder(spark, tmp_path, monkeypatch):
    out = f"file://{tmp_path}/out"
    consolidate(files(spark, [("Forum", 1, "1|t|9")]), out)

    def broken(*_):
        raise RuntimeError("counts differ")

    monkeypatch.setattr(compaction, "_reconcile", broken)
    with pytest.raises(RuntimeError):
        consolidate(files(spark, [("Forum", 1, "2|t|9")]), out)
    assert [r["id"] for r in read_consolidated(spark, out).collect()] == [1]


def test_empty(spark):
    assert consolidated(files(spark, [])).count() == 0
