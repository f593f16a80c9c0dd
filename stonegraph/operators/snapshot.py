"""What changed between consecutive full snapshots of a keyed table.

Keys and contents are reduced to fixed-width hashes, bucketed by key hash and
compared as sorted numpy arrays; the full key strings are fetched afterwards,
for the differing keys only. A key is known by 96 bits of hash, a content by
64 bits within its key.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stonegraph.session import BitTable, bounded_rows, checkpointed, partitions_for

COMPACT = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("ord", pa.int32()), ("at", pa.int64()), ("h", pa.int64())])
DIFF = pa.schema(list(COMPACT) + [("later", pa.int32()), ("change", pa.int8())])
CHANGES = ("added", "removed", "changed")


def _columns(batches: list[pa.RecordBatch]) -> list[np.ndarray]:
    return [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches]) for i in range(5)]


def _winners(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows sorted by key and snapshot, of each pair the one with the greatest (at, h); and which rows begin a key."""
    k1, k2, ord_, at, h = cols
    order = np.lexsort((h, at, ord_, k2, k1))
    k1, k2, ord_, at, h = (c[order] for c in cols)
    new_key = np.ones(len(k1), bool)
    new_key[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    new_pair = new_key.copy()
    new_pair[1:] |= ord_[1:] != ord_[:-1]
    last = np.append(new_pair[1:], True)
    key_no = np.cumsum(new_key) - 1
    return [c[last] for c in (k1, k2, ord_, at, h)], key_no[last]


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before the shuffle: of each batch, the winning row of each key and snapshot, so that copies of a hot key don't travel."""
    for b in batches:
        if b.num_rows:
            cols, _ = _winners(_columns([b]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, COMPACT)], schema=COMPACT)


def difference(batches: Iterator[pa.RecordBatch], snapshots: int) -> Iterator[pa.RecordBatch]:
    """Set differences of neighbouring snapshots within one bucket of keys."""
    kept = [b for b in batches if b.num_rows]
    if not kept:
        return
    cols, key_no = _winners(_columns(kept))
    ord_, h = cols[2], cols[4]
    by_ord = np.argsort(ord_, kind="stable")
    rows_of = np.split(by_ord, np.searchsorted(ord_[by_ord], np.arange(1, snapshots)))
    for s in range(1, snapshots):
        old, new = rows_of[s - 1], rows_of[s]
        a, b = key_no[old], key_no[new]  # both ascending
        at_a, at_b = np.searchsorted(a, b), np.searchsorted(b, a)
        in_a = (at_a < len(a)) & (a[np.minimum(at_a, max(len(a) - 1, 0))] == b) if len(a) else np.zeros(len(b), bool)
        in_b = (at_b < len(b)) & (b[np.minimum(at_b, max(len(b) - 1, 0))] == a) if len(b) else np.zeros(len(a), bool)
        both = np.flatnonzero(in_a)
        changed = both[h[new[both]] != h[old[at_a[both]]]]
        for code, rows in ((0, new[~in_a]), (1, old[~in_b]), (2, new[changed])):
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(c[rows], t.type) for c, t in zip(cols, COMPACT)] + [pa.array(np.full(len(rows), s, np.int32)), pa.array(np.full(len(rows), code, np.int8))], schema=DIFF)


def snapshot_changes(rows: DataFrame, *, key: str, ord: str, at: str, content: str, snapshots: int, buckets: int | None = None) -> DataFrame:
    """(key, ord, change) for each key that differs between snapshot ``ord - 1`` and ``ord``.

    ``ord`` numbers the snapshots from 0 to ``snapshots - 1``; a snapshot is
    all rows of its number. Of several rows of a key in a snapshot the one with
    the greatest ``at`` (null is least) counts, of ties the one with the
    greatest content hash. A null content equals only a null content. Rows with
    a null key or number are no records; the first snapshot gives no cases; an
    empty table gives none. Extra columns are ignored. A key that is repeated
    very often is combined before the shuffle. ``buckets`` defaults to a number
    by the estimated size of ``rows``. The differing keys' hashes are found, and
    checkpointed, when the function is called.
    """
    src = rows.select(F.col(key).alias("key"), F.col(ord).cast("int").alias("ord"), F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**62))).alias("at"), F.col(content).cast("string").alias("content"))
    src = src.where(F.col("key").isNotNull() & F.col("ord").between(0, snapshots - 1))
    h = F.when(F.col("content").isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64("content"))
    keyed = src.select(F.xxhash64("key").alias("k1"), F.hash("key").alias("k2"), "ord", "at", h.alias("h"), "key")
    compact = keyed.drop("key").mapInArrow(combine, "k1 bigint, k2 int, ord int, at bigint, h bigint")
    diff = checkpointed(compact.repartition(buckets or partitions_for(rows, expansion=1.5), "k1", "k2").mapInArrow(lambda it: difference(it, snapshots), "k1 bigint, k2 int, ord int, at bigint, h bigint, later int, change tinyint").select("k1", "k2", "later", "change"))
    # Full keys, for what differs: others are sifted out where they are read, and each key travels once from each task.
    sifted = BitTable(diff, "k1", diff.count()).held(keyed.select("k1", "k2", "key"), "k1").distinct()
    full = sifted.join(diff, ["k1", "k2"]).select("later", "change", "key")
    name = F.element_at(F.array(*map(F.lit, CHANGES)), F.col("change").cast("int") + 1)
    return full.select(F.col("key"), F.col("later").alias("ord"), name.alias("change"))


def plain_path(c: Column) -> Column:
    """A path with forward slashes and without blanks at its ends, empty or ``.`` segments; null if nothing is left."""
    slashes = F.translate(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), "\\", "/")
    tidy = F.regexp_replace(F.regexp_replace(slashes, r"(^|/)(\.?/)+", "$1"), r"/\.?$|^\.$", "")
    return F.when(c.rlike(r"(?U)^\s|\s$|\\|//|(^|/)\./|^/|/\.?$|^\.$"), F.nullif(tidy, F.lit(""))).otherwise(F.nullif(c, F.lit("")))


def blob_id(c: Column) -> Column:
    """The 40 hexadecimal digits in a content id, in lower case; without such, the trimmed text; null for nothing."""
    low = F.lower(F.trim(c))
    hexes = F.regexp_extract(low, r"(?:^|[^0-9a-f])([0-9a-f]{40})(?:[^0-9a-f]|$)", 1)
    return F.when(F.length(low) == 40, low).otherwise(F.coalesce(F.nullif(hexes, F.lit("")), F.nullif(F.regexp_replace(low, r"(?U)^\s+|\s+$", ""), F.lit(""))))


def snapshot_order(headers: DataFrame, *, commit: str = "commit", date: str = "commit_date", limit: int = 10_000) -> list[str]:
    """Commits in full and lower case, by the instant of their date. ValueError beyond ``limit`` snapshots."""
    full = F.lower(F.trim(F.col(commit)))
    by = headers.where(F.col(commit).isNotNull() & F.col(date).isNotNull()).groupBy(full.alias("c")).agg(F.max(F.try_to_timestamp(F.col(date))).alias("t"))
    rows = bounded_rows(by.where("t is not null"), limit, "the list of snapshots")
    return [r["c"] for r in sorted(rows, key=lambda r: (r["t"], r["c"]))]


def sole_beginnings(commits: list[str]) -> list[tuple[str, int]]:
    """(beginning, place in the list) of every beginning, of one digit or more, that fits one commit only, and of each commit in full."""
    order = sorted(range(len(commits)), key=commits.__getitem__)
    shared = [len(os.path.commonprefix([commits[a], commits[b]])) for a, b in zip(order, order[1:])]
    out = []
    for n, k in enumerate(order):
        least = max([shared[n - 1] if n else 0, shared[n] if n < len(shared) else 0]) + 1
        out += [(commits[k][:size], k) for size in range(min(least, len(commits[k])), len(commits[k]) + 1)]
    return out


def manifest_changes(files: DataFrame, headers: DataFrame) -> DataFrame:
    """(commit, path, change) between the snapshots of a corpus manifest.

    ``files`` has commit, path, sha and fetched; ``headers`` commit and
    commit_date. A commit may be cut short to any beginning; one that fits no
    snapshot, or several, counts for none. Paths and content ids are brought to
    their plain forms first; rows without a path are no files.
    """
    commits = snapshot_order(headers)
    spark = files.sparkSession
    known = spark.createDataFrame([(c, i) for i, c in enumerate(commits)], "full string, ord int")
    begins = spark.createDataFrame(sole_beginnings(commits), "begin string, ord int")  # at most 40 for each of the few snapshots
    given = files.select(F.lower(F.trim("commit")).alias("begin"), plain_path(F.col("path")).alias("path"), blob_id(F.col("sha")).alias("sha"), "fetched")
    placed = given.join(F.broadcast(begins), "begin")
    changes = snapshot_changes(placed, key="path", ord="ord", at="fetched", content="sha", snapshots=len(commits), buckets=partitions_for(files, expansion=1.5))
    return changes.join(F.broadcast(known), "ord").select(F.col("full").alias("commit"), F.col("key").alias("path"), "change")


def change_counts(changes: DataFrame, *, by: str = "commit", change: str = "change") -> DataFrame:
    """(by, added, removed, changed): how many keys each snapshot changed."""
    return changes.groupBy(by).agg(*(F.count(F.when(F.col(change) == c, 1)).alias(c) for c in CHANGES))
