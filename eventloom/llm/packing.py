"""Filling fixed-capacity containers with items that are never split unless they must be.

Items are spread over groups of bounded total size; each group is packed by multiway
differencing: two partial partitions at a time are merged with opposing imbalances,
the fullest windows of one onto the emptiest of the other, which leaves near-equal
windows. Should one exceed the capacity, the group is packed anew with one window more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import cut_lineage

WINDOWS_PER_GROUP = 64
#: Packing is dear and sizes are small, so tasks are counted in groups (about a tenth of a second each), not bytes.
GROUPS_PER_TASK = 8
#: Beyond this many tasks each takes more groups.
MAX_TASKS = 50_000
PIECES = "window_id string, doc_id bigint, piece_no int, token_start bigint, n_tokens bigint"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """``k`` near-equal sets of positions of ``sizes`` (Karmarkar-Karp, k ways)."""
    if k == 1:
        return [list(range(len(sizes)))]
    # A partition is its k sums in descending order with the sets that give them. Each
    # starts with one item; the one with the widest spread is merged with the next.
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = s
        heap.append((-s, i, sums, {0: [i]}))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, sets_a = heapq.heappop(heap)
        _, _, b, sets_b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        place = np.empty(k, np.int64)
        place[order] = np.arange(k)
        sets = {int(place[i]): s for i, s in sets_a.items()}
        for i, s in sets_b.items():
            at = int(place[k - 1 - i])
            # the shorter list is moved
            if at in sets:
                small, large = sorted((sets[at], s), key=len)
                large.extend(small)
                sets[at] = large
            else:
                sets[at] = s
        sums = sums[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), serial, sums, sets))
        serial += 1
    if not heap:
        return [[] for _ in range(k)]
    sets = heap[0][3]
    return [sets.get(i, []) for i in range(k)]


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of positions, none above ``capacity``; every size is at most that."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        windows = differencing(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return [w for w in windows if w]
        k += 1


def windows(items: DataFrame, capacity: int = 2048, windows_per_group: int = WINDOWS_PER_GROUP) -> DataFrame:
    """Containers for ``items`` (doc_id bigint, n_tokens bigint).

    Result: one row per piece: window_id, doc_id, piece_no, token_start, n_tokens. An
    item above the capacity is cut: its full pieces fill windows of their own, the rest
    is an item like others. Empty items (null or 0 tokens) need no room and get no row;
    rows with a null id are packed like others. Repeated rows are items of their own.

    Groups come from a hash of the row, so that each holds about ``windows_per_group``
    windows whatever the corpus; a task packs about ``GROUPS_PER_TASK`` of them, one at
    a time, so the number of tasks grows with the corpus and a task's memory doesn't.
    The sizes are written to the checkpoint folder once, as the total must be known first.
    """
    sized = cut_lineage(items.select("doc_id", F.col("n_tokens").cast("bigint").alias("size")).filter("size > 0"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    groups = max(1, round(total / (capacity * windows_per_group)))
    rows = sized.withColumn("row", F.monotonically_increasing_id())  # stable, as the rows are written
    full = F.floor(F.col("size") / capacity).cast("int")
    rest = F.col("size") % capacity
    piece = F.explode(F.sequence(F.lit(0), full - 1)).alias("piece_no")
    # full pieces never meet the packer
    whole = (
        rows.filter(F.col("size") >= capacity)
        .select("row", "doc_id", piece)
        .select(
            F.concat_ws("-", F.lit("w"), F.col("row").cast("string"), F.col("piece_no").cast("string")).alias("window_id"),
            "doc_id",
            "piece_no",
            (F.col("piece_no") * F.lit(capacity).cast("bigint")).alias("token_start"),
            F.lit(capacity).cast("bigint").alias("n_tokens"),
        )
    )
    loose = rows.filter(rest > 0).select(
        "doc_id",
        full.alias("piece_no"),
        (F.col("size") - rest).cast("bigint").alias("token_start"),
        rest.cast("bigint").alias("n_tokens"),
        F.pmod(F.xxhash64("row"), F.lit(groups)).alias("grp"),
    )
    tasks = min(MAX_TASKS, -(-groups // GROUPS_PER_TASK))
    packed = loose.repartition(tasks, "grp").sortWithinPartitions("grp").mapInPandas(_packer(capacity), PIECES)
    return whole.unionByName(packed)


def _packer(capacity: int):
    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        name = np.empty(len(group), object)
        for i, w in enumerate(pack(group["n_tokens"].tolist(), capacity)):
            name[w] = f"g-{group['grp'].iat[0]}-{i}"
        group.insert(0, "window_id", name)
        return group.drop(columns="grp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for grp, part in batch.groupby("grp", sort=False):
                if held and held[0]["grp"].iat[0] != grp:
                    yield packed(pd.concat(held, ignore_index=True))
                    held = []
                held.append(part)
        if held:
            yield packed(pd.concat(held, ignore_index=True))

    return run
