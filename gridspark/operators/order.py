"""Positions in one order over a whole table, without one task that sees all of it: dense indexes, running totals, ranks
and exact quantiles of groups of any size."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: monotonically_increasing_id holds the partition above this bit and the row's place in it below.
_PLACE = 33


def _ranges(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """df in ranges of the order, one a partition, with __part and __place (in the range, from 0).

    Ranges come from a sample, so they are written down: who reads them twice sees the same ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    dealt = dealt.withColumns({"__part": F.shiftright("__at", _PLACE), "__place": F.col("__at").bitwiseAND((1 << _PLACE) - 1)})
    return staged(dealt.drop("__at"), label)


def _offsets(sums: dict[int, tuple], names: list[str], dealt: DataFrame) -> DataFrame:
    """dealt with what all earlier ranges hold of each name; there are as many rows to add as there are ranges."""
    parts = sorted(sums)
    if not parts:
        return dealt.withColumns({n: F.lit(0) for n in names})
    before = [list(accumulate((sums[p][k] for p in parts[:-1]), initial=0)) for k in range(len(names))]
    written = lambda column, x: f"CAST({x!r} AS DOUBLE)" if any(isinstance(y, float) for y in column) else f"{int(x)}L"
    rows = ", ".join(f"({p}L, {', '.join(written(c, c[i]) for c in before)})" for i, p in enumerate(parts))
    side = dealt.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(__part, {', '.join(f'`{n}`' for n in names)})")
    return dealt.join(F.broadcast(side), "__part")


def with_index(df: DataFrame, order: list[str | Column], name: str = "index") -> DataFrame:
    """df with its rows' dense index from 0 in an order over the whole table; ties are in no defined order.

    Ranges of the order are counted, and a row's index is its place in its range and the rows of earlier ranges.
    An empty table gives an empty one; NULLs come first.
    """
    dealt = _ranges(df, [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order], "index")
    counts = {r["__part"]: (r["n"],) for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    out = _offsets(counts, ["__before"], dealt)
    return out.select(*df.columns, (F.col("__before") + F.col("__place")).alias(name))


def running_totals(df: DataFrame, order: list[str], amounts: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of an amount over all rows before it in the order, which must have no ties."""
    dealt = _ranges(df.withColumns({f"__a_{n}": c for n, c in amounts.items()}), [F.col(c).asc_nulls_first() for c in order], "totals")
    sums = dealt.groupBy("__part").agg(*[F.coalesce(F.sum(f"__a_{n}"), F.lit(0)).alias(n) for n in amounts]).collect()
    out = _offsets({r["__part"]: tuple(r[n] for n in amounts) for r in sums}, [f"__b_{n}" for n in amounts], dealt)
    before = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    return out.select(*df.columns, *[(F.col(f"__b_{n}") + F.coalesce(F.sum(f"__a_{n}").over(before), F.lit(0))).alias(n) for n in amounts])


def percent_ranks(df: DataFrame, value: str, name: str, where: Column | None = None) -> DataFrame:
    """df with the average rank of value over the whole table as a share of its number of values; NULL has none.

    Equal values are counted first, so a value that fills the table is one row; where limits the rows that are ranked.
    """
    rows = df.where(F.col(value).isNotNull() & where) if where is not None else df.where(F.col(value).isNotNull())
    counted = rows.groupBy(value).agg(F.count("*").alias("__n"))
    placed = running_totals(counted, [value], {"__less": F.col("__n")})
    every = counted.agg(F.sum("__n").alias("__all"))
    share = (F.col("__less") + (F.col("__n") + 1) / 2) / F.col("__all")
    ranks = placed.join(F.broadcast(every)).select(F.col(value).alias("__v"), share.alias(name))
    found = df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")
    return found if where is None else found.withColumn(name, F.when(where, F.col(name)))


def quantiles(df: DataFrame, group: list[str], values: dict[str, tuple[str, float]], count: str | None = None) -> DataFrame:
    """group and, for each name, the exact quantile (linear between neighbours) of a column, as F.percentile gives it;
    count names a column for the number of a group's rows.

    df is read once, all its columns together.  Equal values of a group are counted, the distinct ones dealt to ranges
    over the whole table, so a group with a third of all rows, or one value with them, is spread like any other; of each
    group only the ranges that hold a wanted place are looked into.  NULL is left out; a group without values has NULL,
    and rows of a NULL group are a group.
    """
    columns = list(dict.fromkeys(c for c, _ in values.values()))
    long = df.select(*group, F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("__k", "__v"))
    cells = long.groupBy(*group, "__k", "__v").agg(F.count("*").alias("__rows"), F.count("__v").alias("__n"))
    dealt = _ranges(cells, [F.col(c).asc_nulls_first() for c in (*group, "__k", "__v")], "quantiles")
    parts = dealt.groupBy(*group, "__k", "__part").agg(F.sum("__rows").alias("__rows"), F.sum("__n").alias("__n"))
    whole = Window.partitionBy(*group, "__k")
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("*", before.alias("__before"), F.sum("__n").over(whole).alias("__all"))
    at = {name: (F.col("__all") - 1) * F.lit(float(q)) for name, (_, q) in values.items()}
    ends = {name: (F.floor(x), F.ceil(x)) for name, x in at.items()}
    of = lambda name: F.col("__k") == columns.index(values[name][0])
    holds = lambda i: (F.col("__before") <= i) & (i < F.col("__before") + F.col("__n"))
    looked = F.lit(False)
    for name, e in ends.items():
        looked = looked | (of(name) & (holds(e[0]) | holds(e[1])))
    keys = [*group, "__k", "__part"]
    inside = dealt.select(*keys, "__v", "__n").where("__n > 0").alias("d").join(parts.where(looked).select(*keys, "__before", "__all").alias("p"), _same(keys, "d", "p"))
    less = F.coalesce(F.sum("d.__n").over(Window.partitionBy(*[f"d.{c}" for c in keys]).orderBy("d.__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = inside.select(*[f"d.{c}" for c in (*group, "__k", "__v", "__n")], "p.__all", (F.col("p.__before") + less).alias("__before"))
    picked, made = [], []
    for j, (name, e) in enumerate(ends.items()):
        picked += [F.max(F.when(of(name) & holds(i), F.col("__v"))).alias(f"__{x}{j}") for x, i in zip("lh", e)]
        up = F.max(F.when(of(name), at[name] - e[0]))
        picked.append(up.alias(f"__u{j}"))
        low, high, up = (F.col(f"__{x}{j}") for x in "lhu")
        made.append(F.when(low == high, low).otherwise((F.lit(1.0) - up) * low + up * high).alias(name))
    found = inside.groupBy(*group).agg(*picked).select(*group, *made)
    every = parts.where("__k = 0").groupBy(*group).agg(F.sum("__rows").alias(count or "__rows"))
    return every.alias("p").join(found.alias("e"), _same(group, "p", "e"), "left").select(*[f"p.{g}" for g in group], *[f"e.{n}" for n in values], *([f"p.{count}"] if count else []))


def _same(group: list[str], a: str, b: str) -> Column:
    on = F.lit(True)
    for g in group:
        on = on & F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}"))
    return on
