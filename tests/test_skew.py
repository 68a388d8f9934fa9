import datetime as dt
import random

from weft.operators.skew import KeyChunks

DDL = "k bigint, t timestamp_ntz, l string, key int, n int, chunk int"


def brute(rows):
    by = {}
    for k, t, l in rows:
        if k is not None:
            by.setdefault(k, []).append((t, l))
    out = {}
    for k, v in by.items():
        gaps = [(b[0] - a[0]).total_seconds() for a, b in zip(v, v[1:]) if a[0] is not None and b[0] is not None]
        out[k] = (len(v), max(gaps, default=None), sum(a[1] != b[1] for a, b in zip(v, v[1:])), v[0][0], v[-1][0])
    return out


def run(df, chunk, share):
    got = KeyChunks(df, "k", "t", "l", chunk, share)
    rows = got.results().collect()
    assert len(rows) == len({r["key"] for r in rows})
    return got, {r["key"]: (r["n"], r["max_gap_s"], r["label_changes"], r["first_time"], r["last_time"]) for r in rows}, {r["key"]: r["chunks"] for r in rows}


def data():
    rng = random.Random(4)
    day = dt.datetime(2024, 1, 1)
    return [(rng.choice([1, 1, 1, 2, 2, None, *range(3, 60)]), rng.choice([None, *(day + dt.timedelta(seconds=rng.randrange(10**5)) for _ in range(6))]), rng.choice(["a", "b", None])) for _ in range(3000)]


def test_in_order_of_a_file(spark, tmp_path):
    rows = data()
    spark.createDataFrame([(*r, 0, 0, 0) for r in rows], DDL).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    want = brute(rows)
    got, results, chunks = run(df, 25, 0.02)
    assert results == want and chunks[1] == -(-want[1][0] // 25) and max(chunks.values()) == chunks[1]
    assert {r["key"] for r in got.heavy().collect()} == {k for k, v in want.items() if v[0] >= 0.02 * len(rows)}
    assert run(df, 10**6, 2)[1] == want


def test_without_files_and_empty(spark):
    rows = data()[:400]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], DDL).coalesce(1)
    assert run(df, 10, 0.02)[1] == brute(rows)
    assert run(df.limit(0), 10, 0.02)[1] == {}
