import os
import random

import numpy as np
import pytest

from weft.llm import packing

DDL = "doc_id bigint, text string, tokens int, shard int"
needs_vocabulary = pytest.mark.skipif(not os.path.isdir(packing.TOKENIZERS), reason="no vocabulary files")


def check(into, lengths, sizes, capacities):
    used = np.bincount(into, weights=sizes, minlength=len(lengths)).astype(int)
    assert (used <= lengths).all() and set(lengths) <= set(capacities)
    for u, c in zip(used, lengths):
        assert not any(u <= x < c for x in capacities)
    return used


def best(sizes, capacity):
    """The least number of containers, by trying all assignments."""
    least = len(sizes)

    def go(i, bins):
        nonlocal least
        if len(bins) >= least:
            return
        if i == len(sizes):
            least = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return least


def test_close_to_the_best_on_small_cases():
    rng = random.Random(1)
    for _ in range(20):
        sizes = np.array([rng.randrange(1, 60) for _ in range(8)])
        into, lengths = packing.best_fit(sizes, (60,))
        check(into, lengths, sizes, (60,))
        assert len(lengths) <= 11 / 9 * best(sorted(sizes.tolist(), reverse=True), 60) + 1


def test_little_room_unused_and_lengths_brought_down():
    rng = random.Random(2)
    sizes = np.array([min(2048, int(rng.lognormvariate(5, 1)) + 1) for _ in range(5000)])
    into, lengths = packing.best_fit(sizes, (2048,))
    check(into, lengths, sizes, (2048,))
    assert len(lengths) <= -(-sizes.sum() // 2048) + 1
    into, lengths = packing.best_fit(np.array([5, 100, 300]), (64, 512))
    assert check(into, lengths, np.array([5, 100, 300]), (64, 512)).tolist() == [405] and lengths.tolist() == [512]
    assert packing.best_fit(np.array([5]), (64, 512))[1].tolist() == [64]
    assert len(packing.best_fit(np.array([], dtype=int), (64,))[1]) == 0


def test_several_lengths_cost_less_than_the_longest_alone():
    rng = random.Random(4)
    permitted = (256, 512, 1024, 2048)
    total = lambda lengths: sum(packing.cost(c, 8, 4096) for c in lengths.tolist())
    for spread in (0.3, 1.0, 1.6):
        sizes = np.array([min(2048, int(rng.lognormvariate(5, spread)) + 1) for _ in range(3000)])
        into, lengths = packing.best_fit(sizes, permitted, 8, 4096)
        used = check(into, lengths, sizes, permitted)
        alone = packing.best_fit(sizes, (2048,), 8, 4096)
        brought_down = np.array(permitted)[np.searchsorted(permitted, np.bincount(alone[0], weights=sizes))]
        assert total(lengths) < 0.95 * total(brought_down) and used.sum() > 0.9 * lengths.sum()
    for _ in range(40):
        sizes = np.array([rng.randrange(0, 65) for _ in range(rng.randrange(1, 30))])
        for overhead, attention in ((0, 0), (30, 0), (4, 50)):
            into, lengths = packing.best_fit(sizes, (16, 32, 64), overhead, attention)
            check(into, lengths, sizes, (16, 32, 64))
            alone = packing.best_fit(sizes, (64,))[0]
            down = np.array((16, 32, 64))[np.searchsorted((16, 32, 64), np.bincount(alone, weights=sizes))]
            assert sum(packing.cost(c, overhead, attention) for c in lengths) <= sum(packing.cost(c, overhead, attention) for c in down)


def test_audit_finds_what_is_wrong(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "x", 0, 0), (2, "y", 0, 0), (2, "y", 0, 0)], DDL)
    monkeypatch.setattr(packing, "token_counts", lambda pages, folder: spark.createDataFrame([(1, 10), (2, 3), (2, 3)], "doc_id bigint, tokens bigint"))
    placed = lambda *rows: spark.createDataFrame(list(rows), "doc_id bigint, piece int, start bigint, tokens bigint, container string, capacity int, used bigint")
    found = lambda *rows: tuple(packing.audit(pages, placed(*rows)).first())
    a, b, c = (1, 0, 0, 8, "p", 8, 8), (1, 1, 8, 2, "q", 8, 8), (2, 0, 0, 3, "q", 8, 8)
    assert found(a, b, c, c) == (2, 0, 0, 0, True)
    assert found(a, c, c) == (2, 2, 1, 1, True) and found(a, b, c, c, c) == (2, 3, 0, 1, True) and found(a, a, c, c)[2:4] == (1, 2)


@needs_vocabulary
def test_every_token_has_one_place(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["tree", "house", "über", "美"]) for _ in range(rng.choice([0, 3, 30, 90, 400])))) for i in range(80)]
    docs += [(7, docs[7][1]), (90, None), (None, "lost"), (91, "x" * 20_000)]
    df = spark.createDataFrame([(*d, 0, 0) for d in docs], DDL)
    counts = {(r["doc_id"], r["tokens"]) for r in packing.token_counts(df).collect()}
    tokenizer = packing.load_tokenizer()
    assert counts == {(i, len(tokenizer.encode_ordinary(t or ""))) for i, t in docs if i is not None}
    for capacities in ((128,), (32, 64, 128)):
        rows = packing.pack(df, capacities, shard_items=20).collect()
        used, pieces = {}, {}
        for r in rows:
            used[r["container"]] = used.get(r["container"], 0) + r["tokens"]
            pieces.setdefault(r["doc_id"], []).append((r["start"], r["tokens"]))
            assert r["capacity"] in capacities
        assert all(used[r["container"]] == r["used"] <= r["capacity"] for r in rows)
        for i, n in counts:
            copies = 2 if i == 7 else 1
            spans = sorted(pieces[i])
            assert sum(t for _, t in spans) == n * copies and (n > 128 or len(spans) == copies)
            assert copies == 2 or all(a + t == b for (a, t), (b, _) in zip(spans, spans[1:]))
        assert len(used) <= sum(n * (2 if i == 7 else 1) for i, n in counts) / 128 * 1.2 + 3


@needs_vocabulary
def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], DDL)).count() == 0


@needs_vocabulary
def test_same_tokens_as_the_other_form_of_the_vocabulary():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(os.path.join(packing.TOKENIZERS, "byte_bpe_50k.json"))
    own = packing.load_tokenizer()
    for text in ("It's we'll  two   spaces\n\nand 123 café!", "говорят — 美しい", "a'b 'sd 'llama"):
        assert own.encode_ordinary(text) == other.encode(text, add_special_tokens=False).ids
