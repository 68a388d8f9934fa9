"""Evaluation texts in a training corpus, by SimHash windows and multi-index Hamming blocks.

A window is as long as the shortest passage that counts as a leak (``run`` words), since an item may stand in a page only in
part; windows of the whole item's length would miss such passages. Every window of every page and item gets a 64-bit
SimHash of its words. The items' fingerprints, whose number is checked before they are sent to the workers, are
indexed by ``radius + 1`` blocks of bits: two fingerprints within the radius agree in at least one block, so
no pair within it is missed. Candidates within the radius are verified by the exact similarity of the two windows'
five-word shingles, weighted by how few items share them, and word by word. Each also says where in the page the whole item would stand: the
item and the page's window of the item's size there are compared in the same way, which tells items that stand in a page as a whole, with changes or without.

Pages are read in place; only candidate pairs leave the workers, so nothing about the corpus is shuffled but its findings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.text import words_of

SHINGLE = 5
#: Windows of all items that may be indexed on each worker (24 bytes each and their words); beyond it, items go in groups.
MAX_WINDOWS = 2_000_000


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Signs:
    """The 64 signs of each word, kept as one row of +1 and -1 for each distinct word seen."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.empty((1024, 64), dtype=np.int16)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) > 1_000_000:  # memory of a worker
            self.index.clear()
        found = list(map(self.index.get, words))
        if None in found:
            new = [w for w in dict.fromkeys(words) if w not in self.index]
            first = len(self.index)
            self.index.update(zip(new, range(first, first + len(new)), strict=True))
            while len(self.index) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            hashes = np.array([word_hash(w) for w in new], dtype=">u8")
            self.table[first : first + len(new)] = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16) * 2 - 1
            found = list(map(self.index.get, words))
        return np.array(found, dtype=np.int64)

    def fingerprints(self, rows: np.ndarray, run: int) -> np.ndarray:
        """SimHash of each window of ``run`` words, by differences of running sums, in slices of bounded memory."""
        n = len(rows) - run + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        out = np.empty(n, dtype=np.uint64)
        step = 1 << 13
        for a in range(0, n, step):
            b = min(n, a + step)
            sums = np.cumsum(self.table[rows[a : b + run - 1]], axis=0, dtype=np.int32)
            window = sums[run - 1 :].copy()
            window[1:] -= sums[: b - a - 1]
            out[a:b] = np.packbits(window > 0, axis=1).view(">u8").ravel()
        return out


@dataclass
class ItemIndex:
    """Windows of the items: row and place of each, their fingerprints, and one sorted table for each block of bits."""

    run: int
    radius: int
    item: np.ndarray
    place: np.ndarray
    prints: np.ndarray
    words: dict[int, list[str]]
    weight: dict[tuple[str, ...], float]
    ids: list[int]
    blocks: list[tuple[np.ndarray, ...]] | None = None
    shingles: dict[int, tuple[set[tuple[str, ...]], float]] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"blocks": None, "shingles": None}  # made anew on each worker: larger than what they are made from

    @classmethod
    def build(cls, items: list[tuple[int, str]], run: int, radius: int) -> ItemIndex:
        signs, item, place, prints, words = Signs(), [], [], [], {}
        for k, (_, text) in enumerate(items):
            w = words_of(text)
            f = signs.fingerprints(signs.rows(w), run)
            if len(f):
                words[k] = w
                item.append(np.full(len(f), k, dtype=np.int64))
                place.append(np.arange(len(f), dtype=np.int64))
                prints.append(f)
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, dtype=t)
        item, place, prints = join(item, np.int64), join(place, np.int64), join(prints, np.uint64)
        df: dict[tuple[str, ...], int] = {}
        for w in words.values():
            for s in {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}:
                df[s] = df.get(s, 0) + 1
        weight = {s: float(np.log(1 + len(words) / n)) for s, n in df.items()}
        return cls(run, radius, item, place, prints, words, weight, [k for k, _ in items])

    @staticmethod
    def _edges(radius: int) -> list[tuple[int, int]]:
        cut = np.linspace(0, 64, radius + 2).astype(int)
        return [(int(a), int(b - a)) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    @classmethod
    def _blocks(cls, prints: np.ndarray, radius: int) -> list[tuple[np.ndarray, ...]]:
        out = []
        for shift, width in cls._edges(radius):
            keys = cls._key(prints, shift, width)
            order = np.argsort(keys, kind="stable")
            # narrow blocks are looked up by their value, wide ones among the sorted values that occur
            values = np.unique(keys) if width > 22 else None
            start = np.searchsorted(keys[order], np.arange(1 << width, dtype=np.uint64) if values is None else values)
            out.append((values, np.append(start, len(keys)).astype(np.int32), order))
        return out

    @staticmethod
    def _key(prints: np.ndarray, shift: int, width: int) -> np.ndarray:
        return (prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``prints`` and in the index of all pairs within the radius."""
        if not len(self.prints):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        if self.blocks is None:
            self.blocks = self._blocks(self.prints, self.radius)
        left, right = [], []
        for (shift, width), (values, start, order) in zip(self._edges(self.radius), self.blocks, strict=True):
            keys = self._key(prints, shift, width)
            if values is None:
                at = keys.astype(np.int64)
                sizes = start[at + 1] - start[at]
            else:
                at = np.minimum(np.searchsorted(values, keys), len(values) - 1)
                sizes = np.where(values[at] == keys, start[at + 1] - start[at], 0)
            hit = np.flatnonzero(sizes)
            sizes = sizes[hit]
            for a in _slices(sizes, 4_000_000):
                h, n = hit[a], sizes[a]
                l = np.repeat(h, n)
                r = order[np.repeat(start[at[h]], n) + _ramp(n)]
                near = np.bitwise_count(prints[l] ^ self.prints[r]) <= self.radius
                left.append(l[near])
                right.append(r[near])
        if not left:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        pairs = np.unique(np.concatenate(left).astype(np.int64) * max(1, len(self.prints)) + np.concatenate(right))
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))

    def _shingles(self, words: list[str]) -> tuple[set[tuple[str, ...]], float]:
        """The shingles of a text and their weight."""
        found = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        return found, self._weigh(found)

    def _weigh(self, shingles: set[tuple[str, ...]]) -> float:
        most = float(np.log(1 + max(1, len(self.words))))
        return sum(self.weight.get(x, most) for x in shingles)

    def similarity(self, page: list[str], item: list[str]) -> float:
        """The weight of the shingles two windows share, over that of all."""
        (a, wa), (b, wb) = self._shingles(page), self._shingles(item)
        both = self._weigh(a & b)
        whole = wa + wb - both
        return both / whole if whole else float(page == item)

    def whole(self, page: list[str], k: int) -> float:
        """The same for the whole item ``k``, whose shingles are kept."""
        if self.shingles is None:
            self.shingles = {}
        if k not in self.shingles:
            self.shingles[k] = self._shingles(self.words[k])
        (a, wa), (b, wb) = self._shingles(page), self.shingles[k]
        both = self._weigh(a & b)
        whole = wa + wb - both
        return both / whole if whole else 0.0


def _ramp(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of ``sizes`` whose sums stay near ``most``, so that no expansion fills the memory."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield slice(a, b)
        a = b


FOUND = "doc_id bigint, item_id bigint, windows bigint, distance int, similarity double, exact boolean, whole double"


def _search(index: ItemIndex, least: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = Signs()
        for batch in batches:
            for part in _pages(batch):
                out = _page_batch(part, index, signs, least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.float64()), strict=True)],
                    names=["doc_id", "item_id", "windows", "distance", "similarity", "exact", "whole"],
                )

    return search


def _pages(batch: pa.RecordBatch) -> Iterator[list[tuple[int, list[str]]]]:
    """Pages of a batch in groups of some 200,000 words; a longer page stands alone."""
    group, size = [], 0
    for k, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        w = words_of(text.as_py())
        group.append((k, w))
        size += len(w)
        if size > 200_000:
            yield group
            group, size = [], 0
    if group:
        yield group


def _page_batch(pages: list[tuple[int, list[str]]], index: ItemIndex, signs: Signs, least: float) -> list[list]:
    run = index.run
    prints, owner, place = [], [], []
    for j, (_, w) in enumerate(pages):
        f = signs.fingerprints(signs.rows(w), run)
        prints.append(f)
        owner.append(np.full(len(f), j))
        place.append(np.arange(len(f)))
    prints, owner, place = np.concatenate(prints), np.concatenate(owner), np.concatenate(place)
    at, of = index.candidates(prints)
    best: dict[tuple[int, int], list] = {}
    # all windows of one alignment of a page and an item point to the same place of the whole item
    wholes: dict[tuple[int, int, int], float] = {}
    for a, b in zip(at.tolist(), of.tolist(), strict=True):
        j, k = int(owner[a]), int(index.item[b])
        page = pages[j][1][place[a] : place[a] + run]
        begin = int(place[a] - index.place[b])
        if (j, k, begin) not in wholes:
            wholes[j, k, begin] = index.whole(pages[j][1][max(0, begin) : begin + len(index.words[k])], k)
        whole = wholes[j, k, begin]
        item = index.words[k][index.place[b] : index.place[b] + run]
        same = page == item
        score = 1.0 if same else index.similarity(page, item)
        if score < least and whole < least:
            continue
        distance = int(prints[a] ^ index.prints[b]).bit_count()
        k = index.ids[k]
        old = best.get((j, k), [0, 64, 0.0, False, 0.0])
        best[(j, k)] = [old[0] + 1, min(old[1], distance), max(old[2], score), old[3] or same, max(old[4], whole)]
    out: list[list] = [[], [], [], [], [], [], []]
    for (j, k), v in best.items():
        for c, x in zip(out, (pages[j][0], k, *v), strict=True):
            c.append(x)
    return out


def find_leaks(pages: DataFrame, items: DataFrame, run: int = 10, radius: int = 2, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, windows, distance, similarity, exact, whole: pages that hold a passage of an item.

    ``windows`` counts the pairs of windows that are similar, or belong to a place where the whole item is, by at least ``least`` in weighted shingles, ``distance`` and
    ``similarity`` are those of the nearest, ``exact`` tells whether a run of ``run`` words stands in both, ``whole`` is the greatest similarity of the
    whole item to the page's words at such a place. All items that hold the passage count.
    Rows repeated under one id, on either side, are taken together. Null or empty texts and those shorter than ``run`` words have no window and give no row, as do rows of a null id.
    Any number of items is served: they are searched in groups of at most ``MAX_WINDOWS`` windows, so that what a
    worker is sent stays bounded.
    """
    spark = pages.sparkSession
    known = items.select(F.col("item_id").cast("bigint"), "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    found = None
    for group in _groups(known):
        shared = spark.sparkContext.broadcast(ItemIndex.build(group, run, radius))

        def search(batches, shared=shared):
            yield from _search(shared.value, least)(batches)

        part = pages.select(F.col("doc_id").cast("bigint"), "text").filter(F.col("doc_id").isNotNull() & (F.length("text") >= run)).mapInArrow(search, FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], FOUND)
    return found.groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows"), F.min("distance").alias("distance"), F.max("similarity").alias("similarity"), F.max("exact").alias("exact"), F.max("whole").alias("whole"))


def _groups(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in groups whose texts have at most MAX_WINDOWS characters' worth of windows, streamed to the driver one at a time."""
    group, size = [], 0
    for row in items.toLocalIterator():
        group.append((row["item_id"], row["text"]))
        size += len(row["text"]) // 2 + 1
        if size > MAX_WINDOWS:
            yield group
            group, size = [], 0
    if group:
        yield group
