"""A pipeline over documents: quality rules, exact and near deduplication, source mixing, SentencePiece ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm.common import BROADCAST_ROWS, WORD, keep_ids, staged, staged_path
from gridspark.llm.exact_dedup import exact_dedup
from gridspark.llm.mixing import mix_sources, words_taken
from gridspark.llm.near_dedup import near_dedup
from gridspark.llm.pieces import encode_pieces
from gridspark.llm.quality import quality_rules
from gridspark.llm.queries import PIECE_MODEL


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with __key and __size of the text: with the id they tell rows apart, also those that share an id."""
    return docs.withColumns({"__key": F.xxhash64("text"), "__size": F.coalesce(F.char_length("text"), F.lit(0))})


def _chosen(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, __key) is among chosen's, broadcast only while they are few."""
    pairs = staged(chosen.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__k")).distinct(), "kept-rows")
    side = F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS // 2 else pairs
    keyed = _keyed(docs)
    rows = keyed.join(side, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__key").eqNullSafe(F.col("__k")), "left_semi")
    return rows.select(*docs.columns)


def _once(docs: DataFrame, repeated: bool) -> DataFrame:
    """docs, with rows that repeat an id and its text counted once."""
    return docs.dropDuplicates(["doc_id", "text"]) if repeated else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no rule rejects.  NULL, empty and blank texts have too few words and go; NULL ids, sources and other
    columns decide nothing; equal rows fare alike; an empty table stays empty."""
    return _chosen(docs, quality_rules(_keyed(docs), carry=("__key",)).where("kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row that the operator keeps; of rows that share its id as well, the longest.  NULL counts as
    empty text, a NULL id comes after all others; of wholly equal rows one stays; an empty table stays empty."""
    kept = staged(exact_dedup(_keyed(docs), carry=("__key", "__size")).where("kept"), "kept-rows")
    first = F.min(F.struct((-F.col("__size")).alias("s"), F.col("__key").alias("k")))
    one = kept.groupBy("text_sha256", "doc_id").agg(first.getField("k").alias("__key"), F.count("*").alias("n"))
    return _once(_chosen(docs, one), not one.where("n > 1").isEmpty())


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that stands for its group; rows that share an id are one document, whose texts all stay.  Rows with a
    NULL id and texts without words are nobody's copy and stay; an empty table stays empty."""
    kept = near_dedup(docs).where("kept").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = staged(kept, "kept-ids")
    n_ids, most = kept.agg(F.count("*"), F.max("n")).first()
    return _once(keep_ids(docs, kept.select("doc_id"), "doc_id", n_ids), (most or 0) > 1)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, with the white space behind them; a block that is taken
    k times stands in k rows of its document.  Texts without words, NULL ones too, give nothing to a mix and go; a NULL
    source is a source; NULL ids are mixed as any; an empty table stays empty."""
    same = Window.partitionBy("__id", "__source", "__key")
    held = F.struct("start", "blocks", "shard_size", "times").alias("__plan")
    plan = mix_sources(docs).where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_key").alias("__key"), held)
    plan = staged(plan.withColumn("__copy", F.row_number().over(same.orderBy("__plan.start"))), "mix-plan")
    repeated = not plan.where("__copy > 1").isEmpty()
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), F.col("doc_id").alias("__id"), F.col("source").cast("string").alias("__source"), F.xxhash64("text").alias("__key"))
    copy = F.row_number().over(same.orderBy(F.xxhash64("__doc"))) if repeated else F.lit(1)
    rows, left, right = rows.withColumn("__copy", copy), "d", "p"
    names = ("__id", "__source", "__key", "__copy")
    rows = rows.alias(left).join(plan.alias(right), [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names])
    words = F.regexp_extract_all("__doc.text", F.lit(f"{WORD}[\\x20\\x09-\\x0D]*"), F.lit(0))
    rows = rows.select("__doc", words.alias("__words"), "__plan.*")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.array_max("times"))).alias("__round"))
    rows = rows.select("__doc", F.array_join(words_taken(F.col("__words"), F.col("__round")), "").alias("__text"))
    new = {"text": F.col("__text"), "n_chars": F.char_length("__text").cast("long")}
    return rows.select(*[new.get(c, F.col("__doc").getField(c)).alias(c) for c in docs.columns])


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row, as encode_pieces gives them: none for NULL and empty texts; every row stays, also repeated ones
    and those with a NULL id; an empty table stays empty."""
    return encode_pieces(docs, PIECE_MODEL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mix_sources", mix),
    ("pieces", pieces),
]
#: SQL can express neither merges of pieces nor seeded blocks; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = staged_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
