"""A joint ridge of two crossed effects, solved by block elimination: products and inverse are tables of Spark.

Of teams and drivers the side with more levels has a diagonal block, so it is eliminated cell by cell; what is left for
the other side (and the intercept) is a matrix in blocks, inverted block column by block column.  Effects, their variances
and any covariance follow by joins of cells with that inverse.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from ..staging import scratch, staged
from .order import with_index

#: Rows and columns of a block of the inverse, and levels of the eliminated side that meet one in a row.
BLOCK = 256
SLICE = 4096


@dataclass(frozen=True)
class Ridge:
    """small and large: i or b, level, weight, effect, variance; all for a residual variance of 1, but for `variance` itself.

    cells: b, i, w (i is 0 for the intercept, else a level of the small side); blocks: bi, bj, m, the inverse.
    """

    small: DataFrame
    large: DataFrame
    cells: DataFrame
    blocks: DataFrame
    intercept: float
    variance: float

    def products(self, wanted: DataFrame) -> DataFrame:
        """(b, i, v): the inverse's row i times the cells of b, for wanted pairs (b, i)."""
        return _products(self.cells, self.blocks, wanted)

    def covariances(self, wanted: DataFrame) -> DataFrame:
        """(b, i, covariance) of a large side's effect and a small side's, for wanted pairs (b, i)."""
        found = self.products(wanted).join(self.large.select("b", "diagonal"), "b")
        return found.select("b", "i", (-F.lit(self.variance) * F.col("v") / F.col("diagonal")).alias("covariance"))


def _arrays(structs: str, *fields: str, prefix: str = "") -> list[Column]:
    """The fields of an array of structs as arrays of numbers: workers get those as NumPy arrays, structs as Python objects
    of many times their size."""
    return [F.col(f"{structs}.{f}").alias(prefix + f) for f in fields]


def _packed(entries: DataFrame) -> DataFrame:
    """(bi, bj, m): the dense blocks, as bytes of doubles, of entries (i, j, v)."""

    def work(batches):
        for pdf in batches:
            out = []
            for i, j, v in zip(pdf["i"], pdf["j"], pdf["v"]):
                m = np.zeros((BLOCK, BLOCK))
                np.add.at(m, (i, j), v)
                out.append(m.tobytes())
            yield pd.DataFrame({"bi": pdf["bi"], "bj": pdf["bj"], "m": out})

    at = lambda c: (F.col(c) % BLOCK).cast("int").alias(c)
    # A block has BLOCK squared entries at most.
    held = entries.groupBy(F.floor(F.col("i") / BLOCK).alias("bi"), F.floor(F.col("j") / BLOCK).alias("bj")).agg(F.collect_list(F.struct(at("i"), at("j"), "v")).alias("e"))
    return held.select("bi", "bj", *_arrays("e", "i", "j", "v")).mapInPandas(work, "bi long, bj long, m binary")


def _outer(cells: DataFrame) -> DataFrame:
    """(i, j, v) with i <= j: sums over b of the products of b's cells, over b's diagonal; each batch adds up what it can."""

    def work(batches):
        for pdf in batches:
            total: dict[int, float] = {}
            for i, w, d in zip(pdf["i"], pdf["w"], pdf["diagonal"]):
                order = np.argsort(i)
                i, w = i[order], w[order]
                x, y = np.triu_indices(len(i))
                for key, v in zip((i[x] << 32 | i[y]).tolist(), (w[x] * w[y] / d).tolist()):
                    total[key] = total.get(key, 0.0) + v
            keys = np.fromiter(total, np.int64, len(total))
            yield pd.DataFrame({"i": keys >> 32, "j": keys & 0xFFFFFFFF, "v": np.fromiter(total.values(), float, len(total))})

    rows = cells.groupBy("b").agg(F.collect_list(F.struct("i", "w")).alias("row"), F.first("diagonal").alias("diagonal"))
    return rows.select(*_arrays("row", "i", "w"), "diagonal").mapInPandas(work, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def inverse(blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The inverse of a symmetric positive definite matrix of blocks (bi, bj, m), by block Gauss-Jordan steps.

    Each step inverts one diagonal block, as large as a block, and updates all others by joins with its row and column.
    """
    as_matrix = lambda b: np.frombuffer(b).reshape(BLOCK, BLOCK)

    def pivot(batches):
        for pdf in batches:
            yield pd.DataFrame({"p": [np.linalg.inv(as_matrix(m)).tobytes() for m in pdf["m"]]})

    def step(k: int):
        def work(batches):
            for pdf in batches:
                out = []
                for i, j, m, p, left, up in zip(pdf["bi"], pdf["bj"], pdf["m"], pdf["p"], pdf["left"], pdf["up"]):
                    p = as_matrix(p)
                    if i == k and j == k:
                        new = p
                    elif i == k:
                        new = p @ as_matrix(m)
                    elif j == k:
                        new = -as_matrix(m) @ p
                    else:
                        new = as_matrix(m) - as_matrix(left) @ p @ as_matrix(up)
                    out.append(np.ascontiguousarray(new).tobytes())
                yield pd.DataFrame({"bi": pdf["bi"], "bj": pdf["bj"], "m": out})

        return work

    for k in range(n_blocks):
        p = blocks.where((F.col("bi") == k) & (F.col("bj") == k)).select("m").mapInPandas(pivot, "p binary")
        left = blocks.where(F.col("bj") == k).select("bi", F.col("m").alias("left"))
        up = blocks.where(F.col("bi") == k).select("bj", F.col("m").alias("up"))
        rows = blocks.join(left, "bi").join(up, "bj").join(F.broadcast(p))  # one block
        blocks = staged(rows.select("bi", "bj", "m", "p", "left", "up").mapInPandas(step(k), "bi long, bj long, m binary"), "inverse", keep=k == n_blocks - 1)
    return blocks


def _products(cells: DataFrame, blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    def work(batches):
        for pdf in batches:
            for m, b, i, w, q, j in zip(*(pdf[c] for c in ("m", "b", "i", "w", "ask_b", "ask_i"))):
                ids, at = np.unique(b, return_inverse=True)
                x = np.zeros((len(ids), BLOCK))
                x[at, i.astype(int)] = w
                z = x @ np.frombuffer(m).reshape(BLOCK, BLOCK)
                place = np.minimum(np.searchsorted(ids, q), len(ids) - 1)
                yield pd.DataFrame({"b": q, "i": j, "v": np.where(ids[place] == q, z[place, (j % BLOCK).astype(int)], 0.0)})

    slice_ = F.floor(F.col("b") / SLICE).alias("slice")
    mine = cells.groupBy(slice_, F.floor(F.col("i") / BLOCK).alias("bi")).agg(F.collect_list(F.struct("b", (F.col("i") % BLOCK).alias("i"), "w")).alias("mine"))
    ask = wanted.groupBy(slice_, F.floor(F.col("i") / BLOCK).alias("bj")).agg(F.collect_list(F.struct("b", "i")).alias("ask"))
    rows = mine.join(ask, "slice").join(blocks, ["bi", "bj"]).select("m", *_arrays("mine", "b", "i", "w"), *_arrays("ask", "b", "i", prefix="ask_"))
    return rows.mapInPandas(work, "b long, i long, v double").groupBy("b", "i").agg(F.sum("v").alias("v"))


def solve(cells: DataFrame, small: str, large: str, ridge: float) -> Ridge:
    """The ridge of value on the levels of two columns, with an intercept that is not penalised.

    cells has (small, large, w, wy, wyy): the sums of weights, weighted values and weighted squares of a pair of levels.
    No limit on the levels: the large side costs what its cells do; the small side's matrix is distributed in blocks.
    """
    spark = cells.sparkSession
    ship_package(spark)
    with scratch(spark):
        side = lambda c, name: cells.groupBy(F.col(c).alias("level")).agg(F.sum("w").alias("weight"), F.sum("wy").alias("wy")).transform(lambda d: with_index(d, ["level"], name))
        s = staged(side(small, "i").withColumn("i", F.col("i") + 1), "small")
        b = staged(side(large, "b").withColumn("diagonal", F.col("weight") + ridge), "large")
        total = s.agg(F.sum("weight").alias("w"), F.sum("wy").alias("wy"), F.count("*").alias("n")).first()
        pairs = cells.join(s.select(F.col("level").alias(small), "i"), small).join(b.select(F.col("level").alias(large), "b", "diagonal"), large)
        pairs = staged(pairs.select("b", "i", "w", "wy", "wyy", "diagonal"), "pairs")
        every = pairs.select("b", "i", "w", "diagonal").unionByName(b.select("b", F.lit(0).cast("long").alias("i"), F.col("weight").alias("w"), "diagonal"))
        x = staged(every, "cells", keep=True)
        # Schur complement: what the small side and the intercept have of their own, less what goes through the large side.
        own = s.select("i", F.col("i").alias("j"), (F.col("weight") + ridge).alias("v")).unionByName(s.select(F.lit(0).cast("long").alias("i"), F.col("i").alias("j"), F.col("weight").alias("v")))
        first = spark.range(1).select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(float(total["w"])).alias("v"))
        upper = own.unionByName(first).unionByName(_outer(x).select("i", "j", (-F.col("v")).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))
        n = total["n"] + 1
        n_blocks = -(-n // BLOCK)
        # The last block is filled up with ones on the diagonal, every pair of blocks is there.
        fill = spark.range(n, n_blocks * BLOCK).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
        grid = spark.range(n_blocks).select((F.col("id") * BLOCK).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("k")).select("i", (F.col("k").cast("long") * BLOCK).alias("j"), F.lit(0.0).alias("v"))
        both = upper.unionByName(upper.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
        inv = inverse(staged(_packed(both.unionByName(fill).unionByName(grid)), "schur"), n_blocks)
        # Right-hand side, and effects of the small side.
        through = x.join(b.select("b", F.col("wy").alias("y")), "b").groupBy("i").agg(F.sum(F.col("w") * F.col("y") / F.col("diagonal")).alias("v"))
        right = s.select("i", "wy").unionByName(spark.createDataFrame([(0, float(total["wy"]))], "i long, wy double")).join(through, "i", "left").select("i", (F.col("wy") - F.coalesce("v", F.lit(0.0))).alias("r"))

        def times(batches):
            for pdf in batches:
                for bi, bj, m, r in zip(pdf["bi"], pdf["bj"], pdf["m"], pdf["r"]):
                    vector = np.zeros(BLOCK)
                    for e in r:
                        vector[e["i"]] = e["r"]
                    m = np.frombuffer(m).reshape(BLOCK, BLOCK)
                    yield pd.DataFrame({"i": bi * BLOCK + np.arange(BLOCK), "v": m @ vector, "d": np.diag(m) if bi == bj else 0.0})

        parts = right.groupBy(F.floor(F.col("i") / BLOCK).alias("bj")).agg(F.collect_list(F.struct((F.col("i") % BLOCK).cast("int").alias("i"), "r")).alias("r"))
        z = inv.join(parts, "bj").select("bi", "bj", "m", "r").mapInPandas(times, "i long, v double, d double").groupBy("i").agg(F.sum("v").alias("effect"), F.sum("d").alias("unit"))
        z = z.where(F.col("i") < n).join(s.select("i", "level", "weight"), "i", "left")
        z = staged(z, "small-effects", keep=True)
        intercept = float(z.where("i = 0").first()["effect"])
        # Effects of the large side, then what one cell leaves.
        gone = pairs.join(z.select("i", F.col("effect").alias("t")), "i")
        passed = gone.groupBy("b").agg(F.sum(F.col("w") * F.col("t")).alias("v"))
        e = b.join(passed, "b").withColumn("effect", (F.col("wy") - F.col("weight") * intercept - F.col("v")) / F.col("diagonal"))
        q = _products(x.select("b", "i", "w"), inv, x.select("b", "i")).join(x.select("b", "i", "w"), ["b", "i"]).groupBy("b").agg(F.sum(F.col("v") * F.col("w")).alias("q"))
        e = e.join(q, "b").select("b", "level", "weight", "effect", "diagonal", (1 / F.col("diagonal") + F.col("q") / F.col("diagonal") / F.col("diagonal")).alias("unit"))
        e = staged(e, "large-effects", keep=True)
        left = gone.join(e.select("b", F.col("effect").alias("d")), "b")
        fitted = F.lit(intercept) + F.col("t") + F.col("d")
        rss = left.agg(F.sum(F.col("wyy") - 2 * fitted * F.col("wy") + F.col("w") * fitted * fitted).alias("rss")).first()["rss"]
        traces = z.where("i > 0").select("unit").unionByName(e.select("unit")).agg(F.sum("unit").alias("t"), F.count("*").alias("n")).first()
        freedom = max(total["w"] - (traces["n"] + 1 - ridge * traces["t"]), 1.0)
        variance = max(rss / freedom, 1e-12)
    scaled = lambda df, key: df.select(key, "level", "weight", "effect", (F.col("unit") * variance).alias("variance"), *(["diagonal"] if key == "b" else []))
    return Ridge(scaled(z.where("i > 0"), "i"), scaled(e, "b"), x.select("b", "i", "w"), inv, intercept, variance)
