import random

import numpy as np
import pytest

from weft.llm import leaks
from weft.llm.text import words_of

DDL = "doc_id bigint, text string, item_id int, windows int"


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz aa bb cc dd ee ff gg".split())
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 40)))) for i in range(30)]
    items += [(100, items[3][1]), (101, ""), (102, None), (None, items[4][1]), (3, "zz " * 12)]
    docs = []
    for d in range(120):
        w = [word() for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.5:
            part = items[rng.randrange(30)][1].split()
            n = rng.choice([9, 10, 11, len(part)])
            a = rng.randrange(max(1, len(part) - n + 1))
            at = rng.randrange(len(w) + 1)
            w[at:at] = part[a : a + n]
        docs.append((d, rng.choice([" ", "  ", "&nbsp;", "<b class='x'>", "​ "]).join(x.upper() if rng.random() < 0.2 else x for x in w)))
    return docs + [(200, None), (201, ""), (None, docs[0][1]), (0, docs[5][1])], items


def brute(docs, items, run=10):
    of = {}
    for k, t in items:
        w = words_of(t)
        for i in range(len(w) - run + 1):
            of.setdefault(tuple(w[i : i + run]), set()).add(k)
    return {(d, k) for d, t in docs if d is not None for w in [words_of(t)] for i in range(len(w) - run + 1) for k in of.get(tuple(w[i : i + run]), ()) if k is not None}


def test_exact_runs_against_brute_force(spark):
    docs, items = corpus(1)
    a = spark.createDataFrame([(*x, 0, 0) for x in docs], DDL)
    b = spark.createDataFrame([(*x, 0) for x in items], "item_id bigint, text string, doc_id int")
    got = leaks.find_leaks(a, b).filter("exact").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items) and len(got) == len(brute(docs, items)) > 20


def test_whole_items_with_changes_against_all_windows(spark):
    rng = random.Random(8)
    vocabulary = [a + b for a in "bdfgklmn" for b in ("al", "en", "ir", "os", "ut", "ax")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(20, 120)))) for i in range(40)]
    docs = []
    for d in range(0, 15000, 50):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 150))]
        part = items[rng.randrange(40)][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(part))
            part[at : at + 1] = rng.choice([[], ["zz"], [part[at], "zz"]])
        at = rng.randrange(len(w) + 1)
        docs.append((d, " ".join(w[:at] + part + w[at:])))
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(a, b).filter("whole >= 0.8").collect()}
    index = leaks.ItemIndex.build(items, 10, 2)
    want = set()
    for d, t in docs:
        w = words_of(t)
        for k, _ in enumerate(items):
            n = len(index.words[k])
            if any(index.whole(w[max(0, i) : i + n], k) >= 0.8 for i in range(-n // 4, len(w))):
                want.add((d, k))
    assert got <= want and len(want) > 150 and len(got) >= 0.95 * len(want)


def test_items_in_groups_give_the_same(spark, monkeypatch):
    docs, items = corpus(2)
    a = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(leaks, "MAX_WINDOWS", 300)
    got = leaks.find_leaks(a, b).filter("exact").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id bigint, text string")
    assert leaks.find_leaks(none, items).count() == 0
    assert leaks.find_leaks(none.union(spark.createDataFrame([(1, "x")], none.schema)), items.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_no_pair_within_the_radius_is_missed(radius):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base.copy()
    for i in range(len(near)):
        for bit in rng.choice(64, rng.integers(0, 9), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(bit)
    index = leaks.ItemIndex(10, radius, np.arange(300), np.zeros(300, dtype=np.int64), base, {}, {}, list(range(300)))
    left, right = index.candidates(near)
    distance = np.bitwise_count(near[:, None] ^ base[None, :])
    assert set(zip(left.tolist(), right.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(distance <= radius))))


def test_fingerprints_are_majorities_of_signs():
    words = [f"w{i % 7}" for i in range(50)]
    signs = leaks.Signs()
    got = signs.fingerprints(signs.rows(words), 10)
    for i in (0, 13, 40):
        total = [sum(1 if leaks.word_hash(w) >> (63 - b) & 1 else -1 for w in words[i : i + 10]) for b in range(64)]
        assert int(got[i]) == sum((t > 0) << (63 - b) for b, t in enumerate(total))


def test_words():
    assert words_of("A&amp;B <br/>c­at 3 < 5 D​É́_x") == ["a", "b", "cat", "3", "5", "dé", "x"]
