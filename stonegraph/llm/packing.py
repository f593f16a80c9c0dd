"""Items of varying length packed into containers of fixed capacity.

First-fit decreasing: the items, longest first, go each to the first container
with room, found in a tournament tree over the rooms left. It runs by itself
in randomised groups of items, so the work is spread and a group's size is
bounded whatever the table's; each group leaves one part-filled container at
most besides what its own items' lengths enforce.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonegraph.session import checkpointed, shuffle_partitions


class Tournament:
    """Rooms of containers in a complete binary tree; each inner node holds the greater of its two."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1
        while self.leaves < most:
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first container with room for ``size``, which is taken from it."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        at = k - self.leaves
        room[k] -= size
        k //= 2
        while k:
            best = room[2 * k] if room[2 * k] >= room[2 * k + 1] else room[2 * k + 1]
            if room[k] == best:
                break
            room[k] = best
            k //= 2
        return at


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each size (each at most ``capacity``); equal sizes in the order given."""
    where = np.zeros(len(sizes), np.int64)
    tree = Tournament(max(1, len(sizes)), capacity)
    order = np.argsort(-sizes, kind="stable")
    for row, size in zip(order.tolist(), sizes[order].tolist()):
        where[row] = tree.place(size)
    return where


def _pack(capacity: int):
    schema = pa.schema([("item", pa.int64()), ("piece", pa.int32()), ("size", pa.int64()), ("container", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        t = pa.Table.from_batches(kept)
        group, item, piece, size = (t.column(i).to_numpy() for i in range(4))
        order = np.lexsort((piece, item, group))
        for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            where = (group[rows[0]].astype(np.int64) << 32) + first_fit_decreasing(size[rows], capacity)
            yield pa.RecordBatch.from_arrays([pa.array(item[rows]), pa.array(piece[rows]), pa.array(size[rows]), pa.array(where)], schema=schema)

    return pack


def fill_containers(items: DataFrame, *, item: str, size: str, capacity: int, group_items: int = 32_768, seed: int = 7) -> DataFrame:
    """(item, piece, size, container): every item placed, no container over ``capacity``.

    An item longer than the capacity is cut into full pieces and a rest,
    numbered from 0; no other is cut. Sizes that are null, or under 0, count as
    0; such items are placed too. Rows with a null item are left out; ``item``
    should be a unique whole number. ``group_items`` is about how many pieces a
    group holds; the groups are drawn by hash of item and piece. An empty table
    gives no rows; extra columns are ignored.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    spark = items.sparkSession
    whole = items.select(F.col(item).cast("bigint").alias("item"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size")).where("item is not null")
    last = F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)).cast("int") - 1
    pieces = whole.select("item", "size", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select("item", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("size") - F.col("piece").cast("bigint") * capacity).alias("size"))
    pieces = checkpointed(pieces)
    groups = max(1, -(-pieces.count() // group_items))
    drawn = pieces.select(F.pmod(F.xxhash64(F.lit(seed), "item", "piece"), F.lit(groups)).cast("int").alias("group"), "item", "piece", "size")
    placed = drawn.repartition(max(1, min(groups, max(shuffle_partitions(spark), groups))), "group")
    return placed.mapInArrow(_pack(capacity), "item bigint, piece int, size bigint, container bigint")
