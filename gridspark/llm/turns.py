"""Conversations in the order of their turns, dealt to tasks by ranges of rows, so that a long one spans several."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def in_order(rows: DataFrame, keep: bool = False) -> DataFrame:
    """conv_id, turn, role, text, part, at, shared: rows sorted by conv_id, turn (NULLs first), role and the text's hash.

    Ranges of about equal numbers of rows make the parts; at grows along the order, over all parts.  Rows that agree
    in all columns are told apart by their place in the input, so ranges can also cut through them.  A conversation
    that several parts hold is shared; as parts are ranges, there are fewer of those than parts.
    """
    spark = rows.sparkSession
    keyed = rows.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("place"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "mark", "place")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = staged(dealt.select("conv_id", "turn", "role", "text", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("at")), "turns", keep)
    cut = dealt.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    cut = cut.select(F.col("conv_id").alias("__conv"), F.lit(True).alias("shared"))
    return dealt.join(F.broadcast(cut), dealt["conv_id"].eqNullSafe(F.col("__conv")), "left").drop("__conv").withColumn("shared", F.coalesce("shared", F.lit(False)))


def grouped(rows: DataFrame) -> DataFrame:
    """rows of in_order with each conversation's rows of a part side by side, in order."""
    return rows.repartition("conv_id", "part").sortWithinPartitions("part", "at")


def runs(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[pd.DataFrame, bool, bool]]:
    """(rows, begins, ends) for runs of at most `most` rows of one conversation and part; batches come from grouped,
    with conv, the conversation's id as text."""
    held, last, begun = None, None, True
    for pdf in batches:
        if not len(pdf):
            continue
        keys = list(zip(pdf["part"], pdf["conv"]))
        at = 0
        while at < len(pdf):
            end = at + 1
            while end < len(pdf) and keys[end] == keys[at]:
                end += 1
            piece = pdf.iloc[at:end]
            if held is not None and keys[at] == last:
                held = pd.concat([held, piece])
            else:
                if held is not None:
                    yield held, begun, True
                held, last, begun = piece, keys[at], True
            while len(held) > most:
                yield held.iloc[:most], begun, False
                held, begun = held.iloc[most:], False
            at = end
    if held is not None:
        yield held, begun, True
