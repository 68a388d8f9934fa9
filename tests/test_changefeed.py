import random

from weft.operators.changefeed import apply_changes
from weft.operators.changelog import CHANGE_DDL, state_at

DDL = "seq bigint, src bigint, dst bigint, edge_label string, remove int, committed int, creationDate bigint, __rank int"


def brute(rows):
    done = sorted({r[:5] for r in rows if r[5] == 1 and r[0] is not None and r[1] is not None and r[2] is not None})
    alive = {}
    for seq, s, d, label, remove in done:
        if remove == 0 and label is not None:
            alive[s, d, label] = seq
        elif remove == 1:
            for k in [k for k in alive if k[:2] == (s, d) and label in (None, k[2])]:
                del alive[k]
    return {(*k, v) for k, v in alive.items()}


def random_log(rng, n, keys):
    rows = []
    for seq in range(n):
        s, d, remove = (1, 1, rng.randrange(2)) if rng.random() < 0.3 else (rng.randrange(keys), rng.randrange(keys), int(rng.random() < 0.4))
        label = rng.choice(["a", "b", "c"]) if not remove or rng.random() < 0.7 else None
        for _ in range(rng.choice([1, 1, 2])):
            rows.append((seq, s, d, label, remove, rng.choice([0, 1, 1, 1, None]), None if remove else seq, 0))
    rng.shuffle(rows)
    return rows


def alive(df):
    return {(r["src"], r["dst"], r["edge_label"], r["seq"]) for r in df.collect()}


def test_against_replay(spark):
    for seed in range(3):
        rows = random_log(random.Random(seed), 400, 6)
        got = apply_changes(spark.createDataFrame(rows, DDL))
        assert alive(got) == brute(rows) and got.count() == len(brute(rows))


def test_base_and_odd_rows(spark):
    base = spark.createDataFrame([(1, 2, "a", 1, 5, 0), (1, 3, "a", 2, 5, 0), (1, 4, "b", 90, 5, 0)], "src bigint, dst bigint, edge_label string, seq bigint, creationDate bigint, remove int")
    log = spark.createDataFrame([(10, 1, 2, None, 1, 1, None, 0), (11, 1, 3, "a", 0, 1, 7, 0), (12, 1, 4, None, 1, 1, None, 0), (None, 1, 9, "a", 0, 1, 7, 0), (13, None, 9, "a", 0, 1, 7, 0), (14, 1, 9, None, 0, 1, 7, 0), (15, 1, 9, "a", 2, 1, 7, 0)], DDL)
    assert alive(apply_changes(log, base)) == {(1, 3, "a", 11), (1, 4, "b", 90)}
    assert alive(apply_changes(spark.createDataFrame([], DDL), base)) == {(1, 2, "a", 1), (1, 3, "a", 2), (1, 4, "b", 90)}
    assert apply_changes(spark.createDataFrame([], DDL)).count() == 0


def replay(rows):
    v, e = {}, {}
    for r in sorted((r for r in rows if r[10]), key=lambda r: r[0]):
        seq, kind, op, vid, s, d, label, _, _, undirected, _ = r
        if kind == "vertex" and op == "add":
            v.setdefault(vid, seq)
        elif kind == "vertex":
            v.pop(vid, None)
            e = {k: x for k, x in e.items() if vid not in k[:2]}
        elif op == "add":
            if s in v and d in v:
                e.setdefault((s, d, label), seq)
                if undirected:
                    e.setdefault((d, s, label), seq)
        else:
            e = {k: x for k, x in e.items() if k[:2] != (s, d) or label not in (None, k[2])}
    return v, e


def test_state_at_equals_replay(spark):
    for seed in range(3):
        rng, rows = random.Random(seed), []
        for seq in range(300):
            if rng.random() < 0.3:
                rows.append((seq, "vertex", rng.choice(["add", "add", "remove"]), rng.randrange(6), None, None, None, ["X"], {"seq": str(seq)}, False, rng.random() < 0.9))
            else:
                op = rng.choice(["add", "add", "remove"])
                label = rng.choice(["a", "b"]) if op == "add" or rng.random() < 0.6 else None
                rows.append((seq, "edge", op, None, rng.randrange(6), rng.randrange(6), label, None, {"seq": str(seq)}, op == "add" and rng.random() < 0.3, rng.random() < 0.9))
        for at in (80, None):
            g = state_at(spark.createDataFrame(rows, CHANGE_DDL), at)
            v, e = replay([r for r in rows if at is None or r[0] <= at])
            assert {r["vid"]: int(r["props"]["seq"]) for r in g.vertices.collect()} == v
            assert {(r["src"], r["dst"], r["label"]): int(r["props"]["seq"]) for r in g.edges.collect()} == e


def test_stream(spark, tmp_path):
    from weft.streaming.changefeed import LOG_DDL, ChangeStream

    rows = random_log(random.Random(9), 300, 5)
    stream = ChangeStream(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/state")
    for i in range(3):
        part = [(*r[:7], None, None) for r in rows[i::3]]
        spark.createDataFrame(part, LOG_DDL).coalesce(2).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream.start(f"file://{tmp_path}/check", 1).awaitTermination()
    assert alive(stream.edges()) == brute(rows)


def test_stream_merges_and_removes_what_is_merged(spark, tmp_path):
    import os

    from weft.streaming.changefeed import LOG_DDL, ChangeStream

    rows = random_log(random.Random(10), 240, 5)
    stream = ChangeStream(spark, "", f"file://{tmp_path}/state", merge_every=3)
    batch = lambda i: spark.createDataFrame([(*r[:7], None, None) for r in rows[i::8]], LOG_DDL)
    for i in range(8):
        stream._apply(batch(i), i)
        if i == 4:  # a batch run again
            stream._apply(batch(i), i)
    assert alive(stream.edges()) == brute(rows)
    assert sorted(os.listdir(tmp_path / "state/base")) == ["2", "5"] and sorted(os.listdir(tmp_path / "state/changes")) == ["3", "4", "5", "6", "7"]
