"""Pages packed into containers of a fixed number of tokens, by variable-capacity best fit.

Pages are counted in tokens on their workers; from then on only identifiers and lengths are handled. Items are spread by hash over
shards of some 50,000, each packed on its own by best fit in falling order of length: an item goes to the open container it
fills best, and where none holds it one is opened. Its length is chosen by trial: each permitted length is filled with what is left of the
shard's items, and the one of least cost for each token held is opened. This is done with all permitted lengths, and again without the shortest ones, and the
packing of least total cost kept, so that several lengths never cost more than the longest alone. At the end each container is brought down to the least
permitted length that holds its contents.
A shard leaves one or two containers badly filled; these are packed once more across shards, as items of their own.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.session import stage

TOKENIZERS = os.environ.get("WEFT_TOKENIZERS", "/opt/tokenizers")
# Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_ITEMS = 50_000


def load_tokenizer(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("weft", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(pages: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, tokens of each page with a doc_id; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(folder)
        for batch in batches:
            counts = [len(tokenizer.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "tokens"])

    return pages.select(F.col("doc_id").cast("bigint"), "text").filter(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id bigint, tokens bigint")


def cost(length, overhead: float = 0, attention: float = 0):
    """What a container of a length costs, in tokens: itself, a fixed part and, as every token attends to all, a part that grows with its square."""
    return overhead + length + (length * length / attention if attention else 0)


def _trial(room: int, left: np.ndarray, present: int) -> int:
    """The tokens that the items left fill a room with, the longest that fit first."""
    free = room
    while m := present & ((1 << (free + 1)) - 1):
        size = m.bit_length() - 1
        free -= size * min(int(left[size]), free // size)
        present &= (1 << size) - 1
    return room - free


def _fit(sizes: np.ndarray, order: np.ndarray, permitted: list[int], price: dict[int, float]) -> tuple[np.ndarray, list[int]]:
    """The container of each item and what each holds."""
    left = np.bincount(sizes, minlength=permitted[-1] + 1)
    present = sum(1 << int(x) for x in np.flatnonzero(left) if x)
    room: list[list[int]] = [[] for _ in range(permitted[-1] + 1)]
    mask, used, into = 0, [], np.empty(len(sizes), dtype=np.int64)
    for i in order:
        size = int(sizes[i])
        left[size] -= 1
        if size and not left[size]:
            present ^= 1 << size
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            r = permitted[-1]
            if len(permitted) > 1:
                r = min((c for c in permitted if c >= size), key=lambda c: (price[c] / max(1, size + _trial(c - size, left, present)), -c))
            k = len(used)
            used.append(0)
        into[i] = k
        used[k] += size
        r -= size
        room[r].append(k)
        mask |= 1 << r
    return into, used


def best_fit(sizes: np.ndarray, capacities: tuple[int, ...], overhead: float = 0, attention: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item and the length of each container, of least total ``cost`` among the choices of lengths tried.

    These are all permitted lengths and those from each on, down to the longest alone. Sizes must not exceed the greatest capacity.
    """
    permitted = sorted(set(capacities))
    price = {c: cost(c, overhead, attention) for c in permitted}
    order = np.argsort(-sizes, kind="stable")
    best = None
    for first in range(len(permitted)):
        into, used = _fit(sizes, order, permitted[first:], price)
        lengths = np.array(permitted)[np.searchsorted(permitted, used)] if used else np.empty(0, dtype=np.int64)
        total = sum(map(price.get, lengths.tolist()))
        if best is None or total < best[0]:
            best = (total, into, lengths)
    return best[1], best[2]


PACKED = "doc_id bigint, piece int, start bigint, tokens bigint, shard int, slot bigint"


def _pack(capacities: tuple[int, ...], overhead: float, attention: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "tokens"], kind="stable")
        into, _ = best_fit(pdf["tokens"].to_numpy(), capacities, overhead, attention)
        return pdf.assign(slot=into)[["doc_id", "piece", "start", "tokens", "shard", "slot"]]

    return run


def pack(pages: DataFrame, capacities: tuple[int, ...] = (2048,), overhead: float = 0, attention: float = 0, folder: str = TOKENIZERS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """doc_id, piece, start, tokens, container, capacity, used: where every token of every page goes.

    A page of no more than the greatest capacity is one piece; a longer one is cut into pieces of that capacity, each with its own
    container, and a rest packed like other pages. ``start`` is the piece's first token. Pages without a token have a piece of
    length 0. ``overhead`` and ``attention`` are those of ``cost``. Rows repeated under one doc_id are packed as often as they occur; null doc_ids are left out; an empty table gives no row.
    """
    most = max(capacities)
    counted = stage(token_counts(pages, folder), "tokens")
    whole = F.expr(f"CASE WHEN tokens > {most} THEN CAST((tokens - 1) DIV {most} AS INT) ELSE 0 END")
    pieces = counted.withColumn("whole", whole)
    # copies of one row get different shards too, so a row repeated very often fills no single one
    rest = pieces.select("doc_id", F.col("whole").alias("piece"), (F.col("whole") * most).cast("bigint").alias("start"), (F.col("tokens") - F.col("whole") * most).alias("tokens"))
    shards = max(1, -(-counted.count() // shard_items))
    sharded = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    first = stage(sharded.repartition(shards, "shard").groupBy("shard").applyInPandas(_pack(capacities, overhead, attention), PACKED), "packed")
    fit = F.expr("CASE " + " ".join(f"WHEN used <= {c} THEN {c}" for c in sorted(capacities)) + " END")
    fills = first.groupBy("shard", "slot").agg(F.sum("tokens").alias("used"))
    # badly filled containers are items of a second round: a few of each shard, so shards ** 2 times fewer tasks
    poor = stage(fills.filter(F.col("used") * 4 < fit * 3), "poor")
    groups = max(1, -(-poor.count() // shard_items))
    again = (
        poor.select(F.col("slot").alias("doc_id"), F.col("shard").alias("piece"), F.lit(0).cast("bigint").alias("start"), F.col("used").alias("tokens"), F.pmod(F.xxhash64("shard", "slot"), F.lit(groups)).cast("int").alias("shard"))
        .groupBy("shard").applyInPandas(_pack(capacities, overhead, attention), PACKED)
        .select(F.col("piece").alias("shard"), F.col("doc_id").alias("slot"), F.concat(F.lit("r"), F.col("shard"), F.lit("-"), F.col("slot")).alias("moved"))
    )
    placed = first.join(again, ["shard", "slot"], "left").withColumn("container", F.coalesce("moved", F.concat(F.lit("s"), F.col("shard"), F.lit("-"), F.col("slot")))).select("doc_id", "piece", "start", "tokens", "container")
    used = placed.groupBy("container").agg(F.sum("tokens").alias("used"))
    mixed = placed.join(used, "container").select("doc_id", "piece", "start", "tokens", "container", fit.cast("int").alias("capacity"), "used")
    full = pieces.filter(F.col("whole") > 0).withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece"))
    alone = full.select("doc_id", "piece", (F.col("piece") * most).cast("bigint").alias("start"), F.lit(most).cast("bigint").alias("tokens"), F.concat(F.lit("d"), "row", F.lit("-"), "piece").alias("container"), F.lit(most).alias("capacity"), F.lit(most).cast("bigint").alias("used"))
    return mixed.unionByName(alone)


def audit(pages: DataFrame, packed: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row: pages placed, tokens not placed (counted anew), pages with a gap or overlap, containers overfull or misnamed, and whether the containers,
    by tokens, are no more than 2 % and two above the least number possible.

    Of rows repeated under one doc_id gaps are not looked for.
    """
    counted = token_counts(pages, folder).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"))
    # a page's pieces lie end to end if each begins where the ones before it end
    ends = packed.groupBy("doc_id").agg(F.sum("tokens").alias("placed"), F.max(F.col("start") + F.col("tokens")).alias("end"), F.count(F.lit(1)).alias("n"), F.count_distinct("start").alias("starts"), F.min("start").alias("begin"))
    page = counted.join(ends, "doc_id", "full").agg(
        F.count("placed").alias("pages"),
        F.coalesce(F.sum(F.abs(F.coalesce("tokens", F.lit(0)) - F.coalesce("placed", F.lit(0)))), F.lit(0)).alias("tokens_lost"),
        F.count_if((F.col("copies") == 1) & ((F.col("begin") != 0) | (F.col("end") != F.col("tokens")) | (F.col("n") != F.col("starts")))).alias("gaps"),
    )
    box = packed.groupBy("container").agg(F.sum("tokens").alias("sum"), F.max("capacity").alias("capacity"), F.max("used").alias("used"))
    least = F.ceil(F.coalesce(F.sum("sum"), F.lit(0)) / F.max("capacity"))
    boxes = box.agg(F.count_if((F.col("sum") != F.col("used")) | (F.col("sum") > F.col("capacity"))).alias("overfull"), F.coalesce(F.count(F.lit(1)) <= least * 1.02 + 2, F.lit(True)).alias("tight"))
    return page.crossJoin(boxes)  # two single rows
