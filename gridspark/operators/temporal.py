"""Event order, as-of and interval joins, windows over strictly earlier rows, upserts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from ..staging import staged
from .guards import ContractError, require_unique
from .order import with_index

#: Events that one task may order.
CALENDAR = 1_000_000
STATS = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "median": F.median}


def event_index(events: DataFrame, order: list[str], name: str = "event_index") -> DataFrame:
    """Distinct events with a dense index from 0.

    They are written down and counted: a calendar of up to CALENDAR events is ordered in one task, a longer one by ranges.
    """
    distinct = staged(events.select(*order).distinct(), "events")
    if distinct.count() > CALENDAR:
        return with_index(distinct, list(order), name).withColumn(name, F.col(name).cast("double"))
    return distinct.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("double"))


def shifted(df: DataFrame, group: list[str], value: str, order: str, name: str, window: int | None = None, min_periods: int = 1, stat: str = "mean", check: bool = False) -> DataFrame:
    """df with a statistic of the group's earlier rows only: all of them, or the last `window`.

    Fewer than min_periods earlier values give NULL.  check refuses NULL or repeated (group, order).
    """
    if stat not in STATS:
        raise ContractError(f"no such statistic: {stat}")
    if check:
        require_unique(df, [*group, order])
    start = -window if window else Window.unboundedPreceding
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(start, -1)
    return df.withColumn(name, F.when(F.count(value).over(w) >= min_periods, STATS[stat](value).over(w)))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], strict: bool = False, width: float | None = None) -> DataFrame:
    """left with the values of the last right row at or before (strict: before) its time.

    Both sides go through one sort by key and time, and each left row takes the last right row before it; there
    is no join on an inequality.  With a width (seconds, or units of a number) a key is sorted by stretches of it, in
    several tasks, and a stretch without a right row before takes the last one of earlier stretches.
    """
    put = F.struct(F.col(time).alias("__at"), *values)
    a = left.select(*keys, time, F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(put.alias("x")).schema["x"].dataType).alias("__put"), F.lit(0 if strict else 1).alias("__side"))
    b = right.select(*keys, time, F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), put.alias("__put"), F.lit(1 if strict else 0).alias("__side"))
    both, by = a.unionByName(b), list(keys)
    if width:
        both, by = both.withColumn("__cell", _bucket(left, time, width)), [*keys, "__cell"]
    w = Window.partitionBy(*by).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("__last", F.last("__put", ignorenulls=True).over(w)).where("__row IS NOT NULL")
    if width:
        latest = both.groupBy(*by).agg(F.max_by("__put", F.when(F.col("__put").isNotNull(), F.col(time))).alias("__put"))
        earlier = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
        carried = latest.select(*by, F.last("__put", ignorenulls=True).over(earlier).alias("__carried"))
        here = here.join(carried, by, "left").withColumn("__last", F.coalesce("__last", "__carried"))
    return here.select("__row.*", *[F.col(f"__last.{v}").alias(v) for v in values], F.col("__last.__at").alias("matched_at"))


def _bucket(df: DataFrame, column: str, width: float) -> Column:
    """The number of the stretch of so many seconds (or units, of a number) that a value lies in."""
    kind = df.schema[column].dataType.typeName()
    x = F.unix_micros(F.col(column).cast("timestamp")) / 1e6 if kind.startswith("timestamp") else F.col(column).cast("double")
    return F.floor(x / width)


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str, rank: str, width: float | None = None) -> DataFrame:
    """points with the interval (key, start to end, both included) of highest rank that holds them.

    With a width, points and intervals are dealt to stretches of it (seconds, or units of a number), so a key with many
    of both is split over tasks; else they meet on equal keys with a range residual.  The winner is a partial aggregate
    for each distinct key and time, which points then take by an equality.
    """
    other = [c for c in intervals.columns if c not in keys]
    side = intervals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(rank, *[c for c in other if c != rank]).alias("__iv"))
    at = points.select(*keys, time).where(F.col(time).isNotNull()).distinct()
    on = [at[k] == side[f"__{k}"] for k in keys]
    if width:
        at = at.withColumn("__cell", _bucket(points, time, width))
        cells = F.sequence(_bucket(intervals, start, width), _bucket(intervals, end, width))
        side = intervals.where(F.col(start) <= F.col(end)).select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(rank, *[c for c in other if c != rank]).alias("__iv"), F.explode(cells).alias("__span"))
        on = [*[at[k] == side[f"__{k}"] for k in keys], at["__cell"] == side["__span"]]
    inside = (F.col(time) >= F.col(f"__iv.{start}")) & (F.col(time) <= F.col(f"__iv.{end}"))
    best = at.join(side, [*on, inside]).groupBy(*[at[k].alias(f"__{k}") for k in keys], at[time].alias("__time")).agg(F.max("__iv").alias("__iv"))
    out = points.join(best, [*[points[k] == best[f"__{k}"] for k in keys], points[time] == best["__time"]], "left")
    return out.select(*[points[c] for c in points.columns], *[F.col(f"__iv.{c}").alias(c) for c in other])


def without_overlap(df: DataFrame, marks: DataFrame, keys: list[str], time: str, mark: str, seconds: int) -> DataFrame:
    """Rows of df with no mark of the same key within so many seconds before or after.

    Rows and marks are dealt to stretches of that length, a mark to its own and both next ones, so a key with many of
    both is split over tasks.
    """
    cell = _bucket(marks, mark, seconds)
    side = marks.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(mark).alias("__mark"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("__span"))
    reach = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    near = F.col("__mark").between(F.col(time) - reach, F.col(time) + reach)
    rows = df.withColumn("__cell", _bucket(df, time, seconds))
    return rows.join(side, [*[rows[k] == side[f"__{k}"] for k in keys], rows["__cell"] == side["__span"], near], "left_anti").drop("__cell")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def last_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def most_similar(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """target, <key>, similarity: each query's k rows of highest cosine, to six places, itself left out; ties by key.

    Exact search in blocks: both sides are packed into blocks of about `block` vectors, every pair of blocks is one
    matrix product in a task, and only k rows a query leave it.
    """
    ship_package(rows.sparkSession)

    def packed(df: DataFrame, name: str) -> DataFrame:
        df = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        n = max(1, -(-df.count() // block))
        return df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(f"{name}_block")).agg(F.collect_list("id").alias(f"{name}_id"), F.collect_list("v").alias(f"{name}_v"))

    a, b = packed(queries, "a"), packed(rows, "b")
    blocks = a.agg(F.collect_set("a_block").alias("all"))
    pairs = b.join(F.broadcast(blocks)).select("b_id", "b_v", F.explode("all").alias("a_block")).join(a, "a_block")

    def run(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                x, y = np.array(r["a_v"].tolist()), np.array(r["b_v"].tolist())
                norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                s = np.round(norm(x) @ norm(y).T, 6)
                ids, own = np.asarray(r["b_id"]), np.asarray(r["a_id"])
                for i in range(len(own)):
                    other = np.flatnonzero(ids != own[i])
                    top = other[np.lexsort((ids[other], -s[i, other]))[:k]]
                    yield pd.DataFrame({"target": own[i], key: ids[top], "similarity": s[i, top]})

    found = pairs.mapInPandas(run, f"target long, `{key}` long, similarity double")
    return last_per_group(found, ["target"], [F.col("similarity").desc(), F.col(key)], k)


def resample(df: DataFrame, group: list[str], x: str, values: list[str], step: float) -> DataFrame:
    """Linear interpolation onto multiples of step within each pair of neighbours, from the first x on."""
    w = Window.partitionBy(*group).orderBy(x)
    out = df.select(*group, x, *values).withColumn("__x1", F.lead(x).over(w)).withColumn("__x0", F.min(x).over(Window.partitionBy(*group)))
    for v in values:
        out = out.withColumn(f"__n_{v}", F.lead(v).over(w))
    first = F.ceil((F.col(x) - F.col("__x0")) / step)
    last = F.when(F.col("__x1").isNull(), F.floor((F.col(x) - F.col("__x0")) / step)).otherwise(F.ceil((F.col("__x1") - F.col("__x0")) / step) - 1)
    out = out.where(last >= first).withColumn("__k", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    grid = F.col("__x0") + F.col("__k") * step
    share = F.when(F.col("__x1") > F.col(x), (grid - F.col(x)) / (F.col("__x1") - F.col(x))).otherwise(0.0)
    return out.select(*group, grid.alias(x), *[(F.col(v) + share * (F.coalesce(f"__n_{v}", v) - F.col(v))).alias(v) for v in values])


def curvature(df: DataFrame, group: list[str], order: str, x: str, y: str) -> DataFrame:
    """Planar curvature by central differences in order, one-sided at the ends; groups under five rows give NULL."""
    w, whole = Window.partitionBy(*group).orderBy(order), Window.partitionBy(*group)

    def slope(c: str) -> Column:
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2)

    out = df.withColumn("__dx", slope(x)).withColumn("__dy", slope(y))
    out = out.withColumn("__ddx", slope("__dx")).withColumn("__ddy", slope("__dy")).withColumn("__n", F.count("*").over(whole))
    bend = F.abs(F.col("__dx") * F.col("__ddy") - F.col("__dy") * F.col("__ddx"))
    speed = F.pow(F.col("__dx") * F.col("__dx") + F.col("__dy") * F.col("__dy"), 1.5)
    value = F.when(F.col("__n") >= 5, F.try_divide(bend, F.greatest(speed, F.lit(1e-9))))
    return out.withColumn("curvature", value).drop("__dx", "__dy", "__ddx", "__ddy", "__n")
