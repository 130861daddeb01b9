"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import running_totals, with_index
from .common import WORD, attach_group, scratch, staged

#: Words of a block, about: a shard's blocks are equal to within a word.
BLOCK = 64
#: Documents of a shard, about; a large source has many shards.
SHARD_DOCS = 2048
SEED = 20240229
#: A source gives at most so many times its own size.
MOST = 3


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    n = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n.alias("size"), F.xxhash64(text_col).alias("text_key"))


def targets(sized: DataFrame) -> DataFrame:
    """(source, place, n_docs, source_size, weight, target): sources by code point, NULL last, weigh 1, 2, 3 and again.

    The weights share the sum of all sizes; no target is above MOST times its source's size, and what is cut off
    is shared by weight among the rest.  With sources sorted by limit per weight, those at their limit come
    first, so one pass of running sums finds the level at which the rest stand.  Places and running sums are those of
    ranges over all sources, however many there are.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    per = with_index(per, [F.col("source").isNull(), F.col("source")], "place").withColumn("place", F.col("place") + 1)
    most = F.col("source_size") * MOST
    per = per.withColumn("weight", (F.col("place") - 1) % 3 + 1).withColumns({"__ratio": most / F.col("weight"), "__none": F.col("source").isNull()})
    every = per.agg(F.sum("source_size").alias("__size"), F.sum("weight").alias("__weights"))
    run = running_totals(per, ["__ratio", "__none", "source"], {"__most": most, "__before": F.col("weight")}).join(F.broadcast(every))
    run = run.withColumn("__level", (F.col("__size") - F.col("__most")) / (F.col("__weights") - F.col("__before")))
    free = run.where(F.col("__level") * F.col("weight") <= most).agg(F.min(F.struct("__ratio", "__level")).getField("__level").alias("__free"))
    target = F.least(most.cast("double"), F.coalesce("__free", F.lit(0.0)) * F.col("weight"))
    return run.join(F.broadcast(free)).select("source", "place", "n_docs", "source_size", "weight", target.alias("target"))


def apportion(units: DataFrame, group: str, key: str, claim: str, seats: Column, out: str) -> DataFrame:
    """units with an integer column out: Sainte-Lague seats for each unit of a group, by highest claim / (2k + 1).

    A unit's seats lie within (units / 2) * its share + 1 of its rounded quota, so only that many quotients are
    ranked.  Units without a claim get none.  Ties go to the smaller key.  Quotients are ranked by ranges of (group,
    quotient) over all groups, so that a group with most of the units, as the shards of a large source, is no one task's.
    """
    units = staged(units.withColumn("__s", seats.cast("long")), "mix-units")
    n = units.count()
    sums = staged(units.groupBy(group).agg(F.sum(claim).alias("__t"), F.count("*").alias("__n")), "mix-groups")
    base = attach_group(units, sums, group, "__n", n)
    share = F.when(F.col("__t") > 0, F.col(claim) / F.col("__t")).otherwise(F.lit(0.0))
    base = base.withColumn("__q", F.floor(share * F.col("__s") + 0.5).cast("long"))
    base = base.withColumn("__w", F.when(share > 0, F.ceil(share * F.col("__n") / 2).cast("long") + 1).otherwise(F.lit(0)))
    base = staged(base.withColumn("__low", F.greatest(F.col("__q") - F.col("__w"), F.lit(0))), "mix-quotients")
    tries = base.where("__w > 0").select(group, key, "__s", F.explode(F.sequence(F.col("__low"), F.col("__q") + F.col("__w"))).alias("__k"), F.col(claim).alias("__c"))
    ranked = staged(with_index(tries, [F.col(group), (F.col("__c") / (2 * F.col("__k") + 1)).desc(), F.col(key).isNull(), F.col(key)], "__i"), "mix-ranks")
    first = ranked.groupBy(group).agg(F.min("__i").alias("__first"), F.count("*").alias("__tries"))
    sure = staged(base.groupBy(group).agg(F.sum("__low").alias("__sure")).join(first, group), "mix-first")
    placed = attach_group(ranked, sure, group, "__tries", ranked.count())
    won = placed.where(F.col("__i") - F.col("__first") < F.col("__s") - F.col("__sure")).groupBy(F.col(group).alias("__g"), F.col(key).alias("__u")).agg(F.count("*").alias("__won"))
    joined = base.join(won, base[group].eqNullSafe(F.col("__g")) & base[key].eqNullSafe(F.col("__u")), "left")
    return joined.select(*[c for c in units.columns if c != "__s"], (F.col("__low") + F.coalesce(F.col("__won"), F.lit(0))).cast("long").alias(out))


def plan(sized: DataFrame, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, taken, and times (how often each of its blocks is taken) with start,
    blocks and shard_size, which tell its words' blocks.

    A source's documents are dealt to shards and lie in a shard in seeded order as one stream of words, cut into
    blocks of equal size.  Blocks are apportioned to sources, then to a source's shards; a shard takes its
    quota in whole rounds, and the rest from blocks in seeded order.
    """
    level = staged(targets(sized), "mix-targets", keep=True)
    pick = lambda *x: F.xxhash64(F.lit(seed), *x)
    per = level.select(
        F.col("source").alias("of"), "place", "source_size", "target",
        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / shard_docs)).cast("long").alias("n_shards"),
    )
    docs = sized.join(per, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "text_key", "source", "size", "source_size", "target", "place", F.pmod(pick(F.lit("shard"), "doc_id"), F.col("n_shards")).alias("shard"),
        pick(F.lit("order"), "doc_id").alias("order"),
    )
    stream = Window.partitionBy("place", "shard").orderBy("order", "doc_id", "text_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    shards = docs.groupBy("place", "shard").agg(F.sum("size").alias("shard_size")).where("shard_size > 0")
    total = level.agg(F.floor(F.sum("target") / block + 0.5)).first()[0] or 0
    seats = apportion(level.select("place", "target", F.lit(0).alias("all")), "all", "place", "target", F.lit(total), "seats")
    units = shards.join(seats.select("place", "seats"), "place")
    quotas = apportion(units, "place", "shard", "shard_size", F.col("seats"), "quota")
    quotas = quotas.withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("shard_size") / block)).cast("long"))
    quotas = staged(quotas.select("place", "shard", "shard_size", "blocks", F.least("quota", F.col("blocks") * MOST).alias("quota")), "mix-quotas", keep=True)
    chosen = quotas.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    rank = F.row_number().over(Window.partitionBy("place", "shard").orderBy(pick(F.lit("block"), "place", "shard", "block"), "block"))
    times = F.floor(F.col("quota") / F.col("blocks")).cast("int") + (rank <= F.col("quota") % F.col("blocks")).cast("int")
    chosen = chosen.select("place", "shard", "block", times.alias("times")).where("times > 0")
    # Word x of a shard lies in block floor(x * blocks / shard_size); block j starts at word ceil(j * shard_size / blocks).
    holds = lambda x: F.floor(x * F.col("blocks") / F.col("shard_size")).cast("long")
    edge = lambda j: F.ceil(j * F.col("shard_size") / F.col("blocks")).cast("long")
    end = F.col("start") + F.col("size")
    words = docs.join(quotas, ["place", "shard"], "left")
    words = words.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(holds(F.col("start")), holds(end - 1)))))
    lo, hi = F.greatest(edge(F.col("block")), F.col("start")) - F.col("start"), F.least(edge(F.col("block") + 1), end) - F.col("start")
    words = words.withColumn("lo", lo).withColumn("hi", hi)
    words = words.join(chosen.hint("merge"), ["place", "shard", "block"], "left")
    times = F.transform(F.sort_array(F.collect_list(F.struct("block", F.coalesce("times", F.lit(0)).alias("times")))), lambda x: x["times"])
    taken = F.sum((F.col("hi") - F.col("lo")) * F.col("times"))
    docs_out = words.groupBy("place", "shard", "order", "doc_id", "text_key", "start", "size").agg(
        *[F.first(c).alias(c) for c in ("source", "source_size", "target", "blocks", "shard_size")],
        F.count("*").alias("rows"), F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), times.alias("times"),
    )
    # Equal rows without words share a place in the stream: they are counted and given back one by one.
    each = F.when(F.col("size") > 0, F.lit(1)).otherwise(F.col("rows").cast("int"))
    return docs_out.withColumn("__row", F.explode(F.array_repeat(F.lit(1), each))).drop("__row", "rows", "place", "shard", "order")


def words_taken(words: Column, round_: Column) -> Column:
    """Of a document's words, those that the mix takes at least round_ times (columns of plan() beside them)."""
    block = lambda i: F.floor((F.col("start") + i) * F.col("blocks") / F.col("shard_size"))
    return F.filter(words, lambda w, i: F.get("times", (block(i) - block(F.lit(0))).cast("int")) >= round_)


def mix_sources(docs: DataFrame, block: int = BLOCK, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and the columns that words_taken reads.

    NULL text has size 0 and is never taken; NULL is a source of its own; repeated rows are documents of their
    own; rows with a NULL id are mixed as well; an empty table gives an empty result; other columns are ignored.
    A document whose row is repeated k times has k result rows; rows of one id with different texts are told apart by
    text_key, the text's xxhash64.
    """
    with scratch(docs.sparkSession):
        return plan(staged(sizes(docs, id_col, text_col, source_col), "mix-sizes", keep=True), block=block, seed=seed)
