import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weft.operators.topn import top_n

DDL = "g bigint, s bigint, t bigint, __rank int, n string"


def brute(rows, n):
    by = {}
    for g, s, t in set(rows):
        if g is not None and s is not None:
            by.setdefault(g, []).append((-s, t is not None, t or 0, t))
    return {(g, -x[0], x[3]) for g, v in by.items() for x in sorted(v)[:n]}


def run(spark, rows, n, share):
    df = spark.createDataFrame([(*r, 0, "") for r in rows], DDL)
    got = [(r["g"], r["s"], r["t"]) for r in top_n(df, "g", "s", "t", n, share, 4).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(1 if rng.random() < 0.4 else rng.randrange(40), rng.choice([None, *range(8)]), rng.randrange(200)) for _ in range(3000)]
    rows += rows[:500] + [(1, 7, 3)] * 800 + [(None, 1, 1), (2, 3, None)]
    for share in (0.002, 0.05, 2):
        assert run(spark, rows, 10, share) == brute(rows, 10)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3) | st.none(), st.integers(0, 4) | st.none(), st.integers(0, 9)), max_size=40))
def test_small_inputs(spark, rows):
    assert run(spark, rows, 3, 0.3) == brute(rows, 3)


def test_a_budget_makes_groups_heavy_whatever_their_share():
    from weft.operators.heavy import MAX_HEAVY, heavy_limit

    assert heavy_limit(100, 0.02) == 2 and heavy_limit(10**6, 0.002) == 2000 and heavy_limit(10**10, 0.002) == 5_000_000
    assert 10**15 / heavy_limit(10**15, 0.002) <= MAX_HEAVY
