"""Pieces that the corpus operators share: words, staged tables, hot keys, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import scratch, staged, staged_path  # noqa: F401  (the operators take them from here)

#: White space between words; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key with at least this share of all rows is hot; so there are at most as many hot keys.
HOT_SHARE = 1000
#: Ids of 8 bytes that may be broadcast after they were counted; beyond it, a shuffle join.
BROADCAST_ROWS = 2_000_000


def word_array(text: Column) -> Column:
    """Words of a text in order; NULL and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def attach_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left-joined with groups (one row per key; size: rows that have the key, of total).

    Keys with at least total/HOT_SHARE rows number HOT_SHARE at most; their hashes split both sides into a part that
    is joined by a broadcast of those groups and one that is joined by a shuffle, in which no key has more than that
    share of the rows.
    """
    limit = max(total // HOT_SHARE, 1)
    place = F.xxhash64(key)
    hot = [r[0] for r in groups.where(F.col(size) >= limit).select(place.alias("h")).distinct().collect()]
    if not hot:
        return rows.join(groups, key, "left")
    warm = rows.where(place.isin(hot)).join(F.broadcast(groups.where(place.isin(hot))), key, "left")
    return warm.unionByName(rows.where(~place.isin(hot)).join(groups.where(~place.isin(hot)), key, "left"))


def in_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows whose key is among groups' (one row per key), joined as attach_group does."""
    found = attach_group(rows, groups.select(key, F.col(size).alias("__in")), key, "__in", total)
    return found.where("__in IS NOT NULL").drop("__in")


def keep_ids(rows: DataFrame, ids: DataFrame, key: str, n_ids: int, how: str = "left_semi") -> DataFrame:
    """rows whose key is among ids (n_ids of them, counted): broadcast while few, else a shuffle join."""
    ids = ids.select(F.col(ids.columns[0]).alias("__id"))
    side = F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids
    return rows.join(side, rows[key].eqNullSafe(F.col("__id")), how)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8_000_000):
    """Fewer rows and bytes in an Arrow batch, for jobs that run within: their Python workers hold one batch at a
    time, however long the texts and sets in it are.  A row beyond the size makes a batch of its own."""
    prefix = "spark.sql.execution.arrow"
    wanted = {f"{prefix}.maxRecordsPerBatch": rows, f"{prefix}.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def text_chunks(ids, texts, limit: int = 2_000_000) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and UTF-8 texts in runs of about limit bytes, so that a batch of long texts stays small."""
    out_ids, out, size = [], [], 0
    for i, t in zip(ids, texts):
        b = t.encode("utf-8", "replace") if isinstance(t, str) else b""
        out_ids.append(i)
        out.append(b)
        size += len(b) + 64
        if size >= limit:
            yield out_ids, out
            out_ids, out, size = [], [], 0
    if out:
        yield out_ids, out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", label: str = "cc") -> DataFrame:
    """(node, component) for every node of an edge list; component is the smallest node of its component.

    Alternates large-star and small-star steps, each a partial-aggregated minimum and a join on the node, until
    the edge set stops changing.  Self-loops and NULL ends add nothing.  No edges: an empty frame.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = staged(e.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), label)
    seen = None
    while True:
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = staged(small, label)
    roots = e.select(F.col("v").alias("node")).distinct()
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(roots.select("node", F.col("node").alias("component")))
