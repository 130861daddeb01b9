"""Checks of data and of models: retirements by season, and how often contrasts of a session lie within their intervals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from ..staging import staged
from .order import _same

# Status texts that name no cause, and the normal quantiles of intervals of 80 and 95 percent.
GENERIC = ("Retired", "Did not finish", "")
Z80, Z95 = 1.281551566, 1.959963985
#: Different (error, variance) of a session that meet those of another block in one task.
BLOCK = 32768


def status_quality(results: DataFrame, season: str = "season", dnf: str = "dnf", status: str = "status") -> DataFrame:
    """Per season: entries, retirements, dnf_rate, distinct_causes and generic_cause_share of retirements, lapped_rows, and
    dnf_rate_if_lapped_counted.  A NULL status counts as empty; without retirements the share is 0."""
    text = F.coalesce(F.col(status), F.lit(""))
    out, lapped = F.coalesce(F.col(dnf) == 1, F.lit(False)), F.lower(text).contains("lapped")
    share = lambda c: F.avg(c.cast("int"))
    return results.groupBy(season).agg(
        F.count("*").alias("entries"), F.count(F.when(out, 1)).alias("retirements"), F.avg(dnf).alias("dnf_rate"), F.countDistinct(F.when(out, text)).alias("distinct_causes"),
        F.coalesce(F.avg(F.when(out, text.isin(*GENERIC).cast("int"))), F.lit(0.0)).alias("generic_cause_share"), F.count(F.when(lapped, 1)).alias("lapped_rows"), share(out | lapped).alias("dnf_rate_if_lapped_counted"))


def _within(x: np.ndarray, y: np.ndarray, d: float, z: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each x, the places in y (ascending, no value twice) from and to which (x - y)^2 / d <= z^2, as floats compare."""
    t, up = math.sqrt(d) * z, math.inf
    while t * t / d > z * z:
        t = math.nextafter(t, 0.0)
    while (after := math.nextafter(t, up)) * after / d <= z * z:
        t = after
    lo, hi = np.searchsorted(y, x - t, "left"), np.searchsorted(y, x + t, "right")
    # The sum of x and t is rounded, so places may be one off.
    lo -= (lo > 0) & (x - y[lo - 1] <= t)
    lo += (lo < len(y)) & (x - y[np.minimum(lo, len(y) - 1)] > t)
    hi += (hi < len(y)) & (y[np.minimum(hi, len(y) - 1)] - x <= t)
    hi -= (hi > 0) & (y[hi - 1] - x > t)
    return lo, hi


def _block_pairs(a: pd.DataFrame, b: pd.DataFrame, c: float, same: bool) -> tuple[float, float, float]:
    """Over the pairs of two blocks of (e, v, m), the sum of squared standardised errors and how many lie within Z80, Z95.

    Blocks of few variances take sums and places in sorted errors by pairs of variances, others a matrix in strips.  Within
    one block each pair counts once, and a row that stands for m entries has m (m - 1) / 2 pairs in itself.
    """
    square, inside = 0.0, [0.0, 0.0]
    p, q = ({v: (g["e"].to_numpy(), g["m"].to_numpy(float)) for v, g in x.sort_values("e").groupby("v")} for x in (a, b))
    finite = bool(np.isfinite(a[["e", "v"]]).all(axis=None) and np.isfinite(b[["e", "v"]]).all(axis=None))
    if finite and 200 * len(p) * len(q) < len(a) * len(b) and min(p) + min(q) - 2 * c > 0:
        middle = a["e"].mean()
        sums = lambda level: {v: (m.sum(), (m * (e - middle)).sum(), (m * (e - middle) ** 2).sum(), np.concatenate([[0.0], np.cumsum(m)])) for v, (e, m) in level.items()}
        left, right = sums(p), sums(q)
        for v, (e, m) in p.items():
            for w, (f, _) in q.items():
                d = v + w - 2 * c
                (n0, s0, r0, _), (n1, s1, r1, upto) = left[v], right[w]
                square += (n1 * r0 + n0 * r1 - 2 * s0 * s1) / d
                for k, z in enumerate((Z80, Z95)):
                    lo, hi = _within(e, f, d, z)
                    inside[k] += float((m * (upto[hi] - upto[lo])).sum())
        # Each pair was met from both sides, and each entry with itself.
        return (square / 2, *((x - a["m"].sum()) / 2 for x in inside)) if same else (square, *inside)
    e, v, m = (b[k].to_numpy(float) for k in "evm")
    strip = max(1, 4_000_000 // len(b))
    with np.errstate(divide="ignore", invalid="ignore"):
        for at in range(0, len(a), strip):
            x, y, n = (a[k].to_numpy(float)[at : at + strip, None] for k in "evm")
            s = (x - e) ** 2 / (y + v - 2 * c)
            times = n * m
            if same:
                i, j = np.arange(at, at + len(x))[:, None], np.arange(len(b))
                times = np.where(i < j, times, np.where(i == j, n * (n - 1) / 2, 0.0))
            met = times > 0
            square += float((s * times)[met].sum())
            for k, z in enumerate((Z80, Z95)):
                inside[k] += float(times[met & (s <= z * z)].sum())
    return square, *inside


def contrast_coverage(errors: DataFrame, session: list[str], entry: str, error: str, variance: str, shared: Column | None = None) -> DataFrame:
    """<session>, n_entries, n_pairs, mean_square, coverage_80, coverage_95 over all pairs of entries timed together.

    A contrast's standardised error is the difference of two errors over the root of the sum of their variances (which
    contain the noise), less twice `shared`, a session's common covariance.  A session's entries lie in blocks of BLOCK,
    and pairs of blocks are dealt to tasks; no row is made for a pair.  Entries without error or variance are left out;
    sessions with fewer than two have no row.
    """
    ship_package(errors.sparkSession)
    known = errors.where(F.col(error).isNotNull() & F.col(variance).isNotNull() & ~F.isnan(error) & ~F.isnan(variance))
    common = F.lit(0.0) if shared is None else shared
    cells = staged(known.groupBy(*session, F.col(error).cast("double").alias("__e"), F.col(variance).cast("double").alias("__v")).agg(F.count("*").alias("__m"), F.max(common).cast("double").alias("__c")), "contrast-cells")
    sizes = cells.groupBy(*session).agg(F.sum("__m").alias("__n"), F.max("__c").alias("__c"), F.ceil(F.count("*") / BLOCK).alias("__blocks")).where("__n >= 2")
    sizes = staged(sizes.withColumn("__id", F.monotonically_increasing_id()), "contrast-sessions")
    held = cells.alias("p").join(sizes.alias("e"), _same(session, "p", "e")).select("__id", "e.__c", "__e", "__v", "__m", "__blocks", F.pmod(F.xxhash64("__e", "__v"), F.col("__blocks")).alias("__b"))
    met = held.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)).alias("__o"))
    met = met.select("__id", F.col("__c").alias("c"), F.col("__e").alias("e"), F.col("__v").alias("v"), F.col("__m").alias("m"), F.least("__b", "__o").alias("lo"), F.greatest("__b", "__o").alias("hi"), (F.col("__b") > F.col("__o")).alias("second"))

    def pairs(key, pdf):
        # Rows are put in one order, so that sums are the same in each run.
        a, b = (pdf[pdf["second"] == side].sort_values(["v", "e"]) for side in (False, True))
        same = key[1] == key[2]
        b = a if same else b
        got = _block_pairs(a, b, float(pdf["c"].iloc[0]), same) if len(a) and len(b) else (0.0, 0.0, 0.0)
        return pd.DataFrame([(key[0], *got)], columns=["__id", "s", "w80", "w95"])

    sums = met.groupBy("__id", "lo", "hi").applyInPandas(pairs, "__id long, s double, w80 double, w95 double").groupBy("__id").agg(*[F.sum(k).alias(k) for k in ("s", "w80", "w95")])
    n = F.col("__n")
    # Of n and n - 1 the even one is halved first: n may be large.
    out = sizes.join(sums, "__id").withColumn("n_pairs", F.when(n % 2 == 0, F.shiftright(n, 1) * (n - 1)).otherwise(n * F.shiftright(n - 1, 1)))
    share = lambda c: F.col(c) / F.col("n_pairs")
    return out.select(*session, n.alias("n_entries"), "n_pairs", share("s").alias("mean_square"), share("w80").alias("coverage_80"), share("w95").alias("coverage_95"))


def connected_fields(sessions: DataFrame, field: str, session: str, entry: str) -> DataFrame:
    """field, n_entries, n_parts: into how many parts a field falls if entries of one session are joined.

    Each session is one star, so there are as many edges as timed entries; the parts are connected components.
    """
    from .components import components

    edges = sessions.where(F.col(entry).isNotNull() & F.col(session).isNotNull()).select(field, F.concat_ws(":", F.lit("e"), field, entry).alias("a"), F.concat_ws(":", F.lit("s"), field, session).alias("b")).distinct()
    parts = components(edges.select("a", "b"))
    found = edges.select(field, "a").distinct().join(parts, F.col("a") == F.col("node"))
    return found.groupBy(field).agg(F.count("*").alias("n_entries"), F.countDistinct("component").alias("n_parts"))
