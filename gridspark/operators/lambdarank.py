"""A listwise ranker: boosted trees on lambda gradients of NDCG, with histograms and gradients as aggregates of Spark."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import scratch, staged
from .guards import ContractError


@dataclass(frozen=True)
class RankerConfig:
    """top: places whose order counts (NDCG@top); bins: of a feature's histogram; the tree's other bounds as usual.

    A histogram has 2 ** depth * features * bins cells at most: those, and nothing of the rows, reach the driver.
    """

    trees: int = 30
    depth: int = 3
    rate: float = 0.1
    bins: int = 32
    top: int = 5
    smooth: float = 1.0
    least: int = 1
    sigma: float = 1.0


@dataclass(frozen=True)
class Split:
    feature: int
    edge: float
    left: Split | float
    right: Split | float


@dataclass(frozen=True)
class Ranker:
    features: tuple[str, ...]
    trees: tuple[Split | float, ...]
    losses: tuple[float, ...]

    def score(self) -> Column:
        """The ensemble's score as one expression; a missing feature goes to the left."""
        return sum((_leaf(t, self.features) for t in self.trees), F.lit(0.0))

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        return df.withColumn(name, self.score())


def _leaf(tree: Split | float, features: tuple[str, ...]) -> Column:
    if not isinstance(tree, Split):
        return F.lit(float(tree))
    x = F.col(features[tree.feature]).cast("double")
    return F.when(x > tree.edge, _leaf(tree.right, features)).otherwise(_leaf(tree.left, features))


def discount(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1.0)


def gradients(rows: DataFrame, race: str, score: str, relevance: str, top: int, sigma: float = 1.0) -> DataFrame:
    """rows (with __id) and g, h: first and second lambda gradients of NDCG@top, summed over the pairs in a race of which
    one is among the top by score.

    Each row meets only the top rows of its race, so a race costs its rows times top, and no list of a whole race is
    made; a pair's part for the top row is a partial sum.  Equal relevance makes no pair; ties in score go by __id.
    """
    by = Window.partitionBy(race).orderBy(F.col(score).desc(), "__id")
    ideal = Window.partitionBy(race).orderBy(F.col(relevance).desc(), "__id")
    gain = F.pow(F.lit(2.0), F.col(relevance)) - 1.0
    ranked = rows.select("__id", race, F.col(score).alias("s"), F.col(relevance).alias("y"), gain.alias("gain"), F.row_number().over(by).alias("rank"), F.row_number().over(ideal).alias("best"))
    inside = lambda c: F.when(F.col(c) <= top, discount(F.col(c))).otherwise(0.0)
    ranked = ranked.select("*", inside("rank").alias("d"), (F.col("gain") * inside("best")).alias("part"))
    # At most top rows a race.
    heads = ranked.groupBy(F.col(race).alias("__race")).agg(F.sum("part").alias("ideal"), F.collect_list(F.when(F.col("rank") <= top, F.struct("__id", "s", "y", "gain", "d", "rank"))).alias("heads")).where("ideal > 0")
    pairs = ranked.join(heads, F.col(race) == F.col("__race")).select("__id", "s", "y", "gain", "d", "rank", "ideal", F.explode("heads").alias("t"))
    # A pair of two top rows is met twice: it is taken where the other one is the higher.
    pairs = pairs.where((F.col("t.y") != F.col("y")) & (F.col("t.rank") < F.col("rank")))
    up = F.col("y") > F.col("t.y")
    apart = sigma * F.when(up, F.col("s") - F.col("t.s")).otherwise(F.col("t.s") - F.col("s"))
    delta = F.abs((F.col("gain") - F.col("t.gain")) * (F.col("d") - F.col("t.d"))) / F.col("ideal")
    p = 1.0 / (1.0 + F.exp(apart))
    sign = F.when(up, 1.0).otherwise(-1.0)
    pairs = pairs.select("__id", F.col("t.__id").alias("other"), (sigma * p * delta * sign).alias("g"), (sigma * sigma * p * (1 - p) * delta).alias("h"))
    both = pairs.select("__id", "g", "h").unionByName(pairs.select(F.col("other").alias("__id"), (-F.col("g")).alias("g"), "h"))
    sums = both.groupBy("__id").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    return rows.join(sums, "__id", "left").withColumns({"g": F.coalesce("g", F.lit(0.0)), "h": F.coalesce("h", F.lit(0.0))})


def bin_edges(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """For each feature the edges between its bins: its distinct approximate quantiles (error of a quarter bin)."""
    shares = [k / bins for k in range(1, bins)]
    found = rows.approxQuantile([f"__x{k}" for k in range(len(features))], shares, 0.25 / bins)
    return [sorted(set(e)) for e in found]


def _grow(rows: DataFrame, edges: list[list[float]], config: RankerConfig) -> Split | float:
    """The tree of least squared error to second order, level by level; a level is one aggregate over node, feature, bin."""
    n_features = len(edges)
    above = lambda value, es: F.size(F.filter(F.array(*map(F.lit, es)), lambda e: value > e)) if es else F.lit(0)
    rows = rows.withColumn("__bins", F.array(*[above(F.col(f"__x{k}"), es) for k, es in enumerate(edges)]))
    node: Column = F.lit(1)
    chosen: dict[int, tuple[int, int]] = {}
    leaves: dict[int, float] = {}
    open_ = {1}
    for level in range(config.depth + 1):
        cells = rows.withColumn("__node", node).where(F.col("__node").isin(*open_)).select("__node", "g", "h", F.posexplode("__bins").alias("f", "b"))
        found = cells.groupBy("__node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect()
        nxt = set()
        for at in sorted(open_):
            hist = {(r["f"], r["b"]): (r["g"], r["h"], r["n"]) for r in found if r["__node"] == at}
            g, h, n = (math.fsum(v[k] for (f, _), v in hist.items() if f == 0) for k in range(3))
            leaves[at] = config.rate * g / (h + config.smooth)
            best = (1e-12, None)
            for f in range(n_features) if level < config.depth else ():
                gl = hl = nl = 0.0
                for b in range(len(edges[f])):
                    x = hist.get((f, b), (0.0, 0.0, 0))
                    gl, hl, nl = gl + x[0], hl + x[1], nl + x[2]
                    if nl >= config.least and n - nl >= config.least:
                        better = gl * gl / (hl + config.smooth) + (g - gl) ** 2 / (h - hl + config.smooth) - g * g / (h + config.smooth)
                        best = max(best, (better, (f, b)), key=lambda t: t[0])
            if best[1] is not None:
                chosen[at] = best[1]
                nxt |= {2 * at, 2 * at + 1}
        if not nxt:
            break
        step = node
        for at in sorted(open_ & set(chosen)):
            f, b = chosen[at]
            step = F.when(node == at, F.when(F.get("__bins", F.lit(f)) > b, 2 * at + 1).otherwise(2 * at)).otherwise(step)
        rows = rows.withColumn(f"__n{level}", step)
        node, open_ = F.col(f"__n{level}"), nxt

    def built(at: int) -> Split | float:
        if at not in chosen:
            return leaves[at]
        f, b = chosen[at]
        return Split(f, edges[f][b], built(2 * at), built(2 * at + 1))

    return built(1)


def fit_lambdarank(df: DataFrame, race: str, features: list[str], relevance: str = "relevance", config: RankerConfig = RankerConfig()) -> Ranker:
    """A ranker of the rows of a race by relevance (0 or more, higher is better).

    Rows without race or relevance are left out; a missing or NaN feature counts as the lowest value.  losses has
    1 - mean NDCG@top before each tree and at the end.  Without rows to learn from there is one tree, 0 everywhere.
    """
    x = {f"__x{k}": F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")), F.lit(-math.inf)) for k, f in enumerate(features)}
    rows = df.where(F.col(race).isNotNull() & F.col(relevance).isNotNull()).withColumns(x)
    rows = rows.select(F.monotonically_increasing_id().alias("__id"), F.col(race).alias("__race_key"), F.col(relevance).cast("double").alias("__y"), *x)
    with scratch(df.sparkSession):
        rows = staged(rows, "ranker-rows").withColumn("__s", F.lit(0.0))
        if rows.where("__y < 0").limit(1).count():
            raise ContractError("relevance must not be negative")
        edges = bin_edges(rows.select(*x), features, config.bins)
        edges = [[e for e in es if e > -math.inf] for es in edges]
        trees, losses = [], []
        for k in range(config.trees):
            losses.append(_loss(rows, config.top))
            grad = staged(gradients(rows, "__race_key", "__s", "__y", config.top, config.sigma), "ranker-gradients")
            tree = _grow(grad, edges, config)
            trees.append(tree)
            rows = grad.drop("g", "h").withColumn("__s", F.col("__s") + _leaf(tree, tuple(x)))
            if not isinstance(tree, Split):
                break
        losses.append(_loss(rows, config.top))
    return Ranker(tuple(features), tuple(trees), tuple(losses))


def ndcg(rows: DataFrame, race: str, score: str, relevance: str, top: int, tie: str) -> DataFrame:
    """race, ndcg: NDCG@top with gain 2^relevance - 1; races without relevance have none."""
    rank = F.row_number().over(Window.partitionBy(race).orderBy(F.col(score).desc(), tie))
    ideal = F.row_number().over(Window.partitionBy(race).orderBy(F.col(relevance).desc(), tie))
    gain = F.pow(F.lit(2.0), F.col(relevance)) - 1.0
    part = lambda r: F.sum(F.when(F.col(r) <= top, F.col("__g") * discount(F.col(r))).otherwise(0.0))
    out = rows.select(race, gain.alias("__g"), rank.alias("__r"), ideal.alias("__b"))
    return out.groupBy(race).agg(F.try_divide(part("__r"), part("__b")).alias("ndcg"))


def _loss(rows: DataFrame, top: int) -> float:
    found = ndcg(rows, "__race_key", "__s", "__y", top, "__id").agg(F.avg("ndcg")).first()[0]
    return 1.0 - found if found is not None else 0.0
