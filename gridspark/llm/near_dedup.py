"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian screening, exact confirmation."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import attach_group, connected_components, in_groups, keep_ids, scratch, small_batches, staged, text_chunks


@dataclass(frozen=True)
class NearDedupConfig:
    """Links hold at 100 * intersection >= percent * union of word shingles.

    At the threshold itself a pair shares no band with probability (1 - 0.75 ** rows) ** bands (5e-6 here), and
    screening drops it with a probability of about miss per batch.
    """

    width: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    batch: int = 32
    miss: float = 1e-6
    seed: int = 7919
    #: Members of a bucket that are expected to be compared with all others, in the second round; then 16 times as many each.
    hubs: int = 16
    #: Members of a bucket that meet its hubs in one task; a larger bucket is dealt to several.
    deal: int = 2048

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(8)
def _factors(config: NearDedupConfig) -> tuple[np.ndarray, ...]:
    rng = np.random.Generator(np.random.PCG64(config.seed))
    odd = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(config.width), odd(config.hashes), odd(config.hashes)


def shingle_sets(texts: list[bytes], config: NearDedupConfig) -> Iterator[np.ndarray]:
    """The set of 64-bit shingle hashes, sorted, of each text; with fewer words than a shingle, one for all of them."""
    lists = [t.lower().split() for t in texts]  # bytes: only A-Z are lowered, only the six ASCII spaces split
    every = [w for words in lists for w in words]
    hashes = pd.util.hash_array(np.array(every, dtype=object), categorize=False) if every else np.empty(0, np.uint64)
    factors, at, k = _factors(config)[0], 0, config.width
    for words in lists:
        n = len(words)
        h, at = hashes[at : at + n], at + n
        if n >= k:
            s = h[: n - k + 1] * factors[0]
            for i in range(1, k):
                s = s + h[i : n - k + 1 + i] * factors[i]
            yield np.unique(_mixed(s))
        elif n:
            yield _mixed((h * factors[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
        else:
            yield np.empty(0, np.uint64)


def minhash(shingles: np.ndarray, config: NearDedupConfig) -> np.ndarray:
    _, a, b = _factors(config)
    out = np.full(config.hashes, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 2048):
        x = shingles[i : i + 2048, None] * a
        x += b
        x >>= np.uint64(32)
        np.minimum(out, x.min(axis=0), out=out)
    return out.astype("<u4")


def signatures(docs: DataFrame, config: NearDedupConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_hash (of the whole set), signature."""

    def run(batches):
        for pdf in batches:
            for ids, texts in text_chunks(pdf["doc_id"], pdf["text"]):
                rows = []
                for i, s in zip(ids, shingle_sets(texts, config)):
                    full = len(s) > 0
                    rows.append((i, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if full else None, minhash(s, config).tobytes() if full else None))
                out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_hash", "signature"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, "doc_id long, n_shingles long, set_hash binary, signature binary")


def least_matches(config: NearDedupConfig) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches with which a pair goes on).

    With m of n equal and a uniform prior the similarity is Beta(m + 1, n - m + 1); it is at or above the
    threshold with the probability that n + 1 trials at the threshold succeed m times at most.
    """
    t, out = config.percent / 100, []
    for n in range(config.batch, config.hashes + 1, config.batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= config.miss:
                break
            m += 1
        out.append((n, m))
    return out


def screen(pairs: DataFrame, reps: DataFrame, config: NearDedupConfig) -> DataFrame:
    """Of pairs (a, b), those that sizes and signature batches do not rule out: a, b, matches."""
    steps = least_matches(config)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = (np.frombuffer(b"".join(pdf[c]), "<u4").reshape(len(pdf), -1) for c in ("sa", "sb"))
            alive, matches, done = np.arange(len(pdf)), np.zeros(len(pdf), np.int64), 0
            for n, least in steps:
                matches[alive] += (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
                alive, done = alive[matches[alive] >= least], n
            yield pd.DataFrame({"a": pdf["a"].to_numpy()[alive], "b": pdf["b"].to_numpy()[alive], "matches": matches[alive]})

    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * config.percent)
    return both.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long, matches long")


def confirm(pairs: DataFrame, sets: DataFrame, config: NearDedupConfig) -> DataFrame:
    """Of pairs (a, b), those linked by their full shingle sets."""

    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["xa"], pdf["xb"]):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.intersect1d(p, q, assume_unique=True).size
                keep.append(100 * both >= config.percent * (len(p) + len(q) - both))
            yield pdf.loc[keep, ["a", "b"]]

    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"x{x}"))
    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "xa", "xb").mapInPandas(run, "a long, b long")


def full_sets(docs: DataFrame, config: NearDedupConfig) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for ids, texts in text_chunks(pdf["doc_id"], pdf["text"]):
                yield pd.DataFrame({"doc_id": ids, "shingles": [s.tobytes() for s in shingle_sets(texts, config)]})

    return docs.mapInPandas(run, "doc_id long, shingles binary")


def rare_prefixes(sets: DataFrame, config: NearDedupConfig) -> DataFrame:
    """(key, rep, n, k, at): buckets by the shingles that a link cannot do without, n nodes in each; the shingle is
    the at-th of the node's k in the order.

    With shingles in one order for all sets, here from those that few sets have to those that many have, two
    linked sets of k shingles share one of the first k - ceil(k * percent / 100) + 1.  What many texts quote is at
    the end of the order, so it makes no bucket unless it is nearly all of a text.
    """

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"rep": pdf["doc_id"], "part": pdf["part"], "shingles": [np.frombuffer(x, "<i8") for x in pdf["shingles"]]})

    lists = sets.select("doc_id", F.xxhash64("shingles").alias("part"), "shingles").mapInPandas(run, "rep long, part long, shingles array<long>")
    each = staged(lists.select("rep", "part", F.size("shingles").alias("k"), F.explode("shingles").alias("key")), "open-shingles")
    shared = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    own = Window.partitionBy("rep", "part")
    held = attach_group(each, shared, "key", "n", each.count()).where("n IS NOT NULL")
    ranked = held.withColumn("at", F.row_number().over(own.orderBy("n", "key")) + F.col("k") - F.count("*").over(own))
    first = ranked.where(F.col("at") <= F.col("k") - F.ceil(F.col("k") * config.percent / 100) + 1).select("key", "rep", "k", "at").distinct()
    first = staged(first, "rare-shingles")
    return attach_group(first, first.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key", "n", first.count()).where("n IS NOT NULL")


def near_dedup(docs: DataFrame, config: NearDedupConfig = NearDedupConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents with equal shingle sets become one node.  Nodes that share a band's bucket are candidates; first
    each is compared with the middle of its bucket, then only nodes of a bucket that are not yet in one
    component are compared.  Those are put into finer buckets by their rarest shingles, of which linked sets share
    one, and rounds take more and more of a bucket's nodes in a hashed order, until every pair of a bucket was
    compared or is joined by a path.  So large groups and common passages cost few pairs and no link is lost.

    NULL, empty and blank texts have an empty set and link with nothing; rows with a NULL id link with nothing
    either, have a NULL component_id and are kept; rows that repeat an id are the same node; an empty table gives
    an empty result; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    with small_batches(docs.sparkSession), scratch(docs.sparkSession):
        return _near_dedup(docs, config, id_col, text_col)


def _near_dedup(docs: DataFrame, config: NearDedupConfig, id_col: str, text_col: str) -> DataFrame:
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = staged(signatures(slim, config), "signatures", keep=True)
    full = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = staged(full.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "shingle-groups")
    reps = groups.select("rep", "n_shingles", "signature")
    width = 4 * config.rows
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("signature", 1 + width * k, width)) for k in range(config.bands)])
    banded = groups.select("rep", F.explode(keys).alias("key"))
    many = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = attach_group(banded, many, "key", "n", groups.count() * config.bands)
    buckets = staged(buckets.where("n IS NOT NULL"), "buckets")
    n_placed = buckets.count()
    # The node with the most company over all its buckets is the middle of its group: what was copied, not a copy.
    members = staged(buckets.groupBy("rep").agg(F.sum("n").alias("company")), "bucket-members")
    sets = staged(full_sets(keep_ids(slim, members.select("rep"), "doc_id", members.count()), config), "shingle-sets")

    placed = buckets.join(members, "rep")
    middle = placed.groupBy("key").agg((-F.max(F.struct("company", -F.col("rep"))).getField("col2")).alias("hub"), F.count("*").alias("size"))
    starred = attach_group(placed, middle, "key", "size", n_placed).where("rep <> hub")
    tested = staged(starred.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    likely = staged(screen(tested, reps, config), "screened")
    best = likely.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a"))
    links = staged(confirm(best, sets, config), "links")
    parts = staged(connected_components(links), "parts")

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components so far."""
        for x in ("a", "b"):
            pairs = pairs.join(parts.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left")
        return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def joined(more: DataFrame) -> DataFrame:
        """parts after more links: only the components that these join are joined anew, each by its least node."""
        ends = more
        for x in ("a", "b"):
            ends = ends.join(parts.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left")
        ends = staged(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct(), "links")
        if ends.isEmpty():
            return parts
        moved = staged(connected_components(ends), "moved").select(F.col("node").alias("component"), F.col("component").alias("to"))
        sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
        groups = staged(moved.join(sizes, "component"), "moved-parts")
        old = attach_group(parts, groups, "component", "size", parts.count()).select("node", F.coalesce("to", "component").alias("component"))
        fresh = moved.join(parts.select(F.col("node").alias("component")), "component", "left_anti")
        return staged(old.unionByName(fresh.select(F.col("component").alias("node"), F.col("to").alias("component"))), "parts")

    parts = joined(confirm(apart(likely), sets, config))

    def split(rows: DataFrame, total: int) -> DataFrame:
        """Rows (key, rep, n) of buckets whose nodes are in several components so far, with their component."""
        here = rows.join(parts, rows["rep"] == parts["node"], "left").select(*rows.columns, F.coalesce("component", "rep").alias("part"))
        several = here.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("size")).where("p <> q")
        return in_groups(here, several, "key", "size", total)

    left = staged(split(buckets, n_placed).select("rep").distinct(), "open-nodes")
    open_ = staged(rare_prefixes(sets.join(left, F.col("doc_id") == F.col("rep"), "left_semi"), config), "rare-buckets")
    # In a bucket of n nodes, a round takes those whose hashed place is below hubs / n; the last takes all.
    place = F.pmod(F.xxhash64("rep", F.lit(config.seed)), F.lit(1 << 40)) / float(1 << 40)
    # A bucket's members are dealt to as many parts as it has shares of config.deal, and its hubs go to each part.
    shares = F.ceil(F.col("n") / config.deal).cast("int")
    share = F.pmod(F.xxhash64("rep", F.lit(config.seed + 1)), shares).cast("int")
    done, now, total = 0, config.hubs, open_.count()
    while True:
        here = staged(split(open_, total).where(F.col("n") > done).select("*", place.alias("place"), share.alias("share")), "open-buckets")
        total = here.count()
        if not total:
            break
        hub = here.where((F.col("place") * F.col("n") >= done) & (F.col("place") * F.col("n") < now))
        hub = hub.select("key", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.col("rep").alias("h"), F.col("place").alias("hp"), F.col("part").alias("hq"), F.col("k").alias("hk"), F.col("at").alias("ha"))
        # If this shingle is the first that both have, they share as many more as the shorter rest holds, at most.
        most = (F.least(F.col("k") - F.col("at"), F.col("hk") - F.col("ha")) + 1) * (100 + config.percent)
        pairs = here.join(hub, ["key", "share"]).where("part <> hq AND (place > hp OR (place = hp AND rep > h))").where(most >= (F.col("k") + F.col("hk")) * config.percent)
        pairs = pairs.select(F.least("rep", "h").alias("a"), F.greatest("rep", "h").alias("b")).distinct()
        pairs = staged(pairs.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
        parts = joined(confirm(screen(pairs, reps, config), sets, config))
        tested = staged(tested.unionByName(pairs), "pairs")
        open_, done, now = here.select("key", "rep", "n", "k", "at"), now, now * 16
    classes = groups.select("set_hash", "size", "rep").join(parts, F.col("rep") == F.col("node"), "left")
    classes = staged(classes.select("set_hash", "size", F.coalesce("component", "rep").alias("class_id")), "classes", keep=True)
    nodes = sig.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "set_hash")
    named = attach_group(nodes, classes, "set_hash", "size", nodes.count()).select("doc_id", "n_shingles", F.col("class_id").alias("component_id"))
    alone = sig.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
