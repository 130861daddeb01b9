"""Exact deduplication against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, attach_group, scratch, staged, staged_path


#: Digests of a bucket, about; an index that outgrows this is dealt to more buckets.
BUCKET_ROWS = 4_000_000
LEAST_BUCKETS = 16


class DigestIndex:
    """Digests seen so far, with the id that stands for each.

    A folder of Parquet files in buckets, each sorted by digest; a later session opens it by its path.  A batch
    meets it in a sort-merge join that shuffles the batch's digests only.  The number of buckets grows with the
    index: once they hold more than bucket_rows each, it is written anew, as the next generation beside the last,
    with at least twice as many, so a digest is moved a few times at most however long the index lives.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.bucket_rows = spark, bucket_rows
        self.path = (path or staged_path(spark, "digests")).rstrip("/")
        self.name = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]
        self.generation, self.buckets = self._latest()
        self._open()

    def _latest(self) -> tuple[int, int]:
        """Number and buckets of the newest whole generation; a folder's name tells both."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [(0, 0)]
        if fs.exists(root):
            names = [x.getPath().getName() for x in fs.listStatus(root)]
            found += [tuple(map(int, n.split("-")[1:])) for n in names if n.startswith("generation-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return max(found)

    def _open(self) -> None:
        self.table = f"{self.name}_{self.generation}"
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if self.buckets:
            self.spark.sql(
                f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._folder()}'"
            )

    def _folder(self) -> str:
        return f"{self.path}/generation-{self.generation}-{self.buckets}"

    def read(self) -> DataFrame:
        if not self.buckets:
            return self.spark.createDataFrame([], "digest binary, keep_id long")
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append(self, entries: DataFrame) -> None:
        """Add digests that the index does not hold."""
        rows, mode = staged(entries.select("digest", "keep_id"), "new-digests"), "append"
        total = rows.count() + (self.read().count() if self.buckets else 0)
        if total > self.bucket_rows * self.buckets:
            rows, mode = self.read().unionByName(rows), "overwrite"
            self.generation, self.buckets = self.generation + 1, max(LEAST_BUCKETS, 2 * self.buckets, -(-2 * total // self.bucket_rows))
            self.table = f"{self.name}_{self.generation}"
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if not self.buckets:
            return
        rows = rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        (rows.write.mode(mode).format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self._folder()).saveAsTable(self.table))

    def close(self) -> None:
        """Take the index out of the session's catalogue; its files stay."""
        for k in range(self.generation + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{k}")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, digest, n_points, the columns to carry): SHA-256 of the text without white space; NULL counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.regexp_replace(text, SPACE, "")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(bare, 256)).alias("digest"),
        F.char_length(text).alias("n_points"),
        *carry,
    )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 and the columns to carry.

    Of equal texts in the batch the row with most code points, then the smallest id, stays (a NULL id is last);
    a text that the index already holds yields to the indexed id.  New digests are appended to the index.
    NULL text counts as empty; repeated rows count each; an empty table gives an empty result; other columns are
    ignored, whatever their names.  Running a batch again changes nothing.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or DigestIndex(spark)
    with scratch(spark):
        rows = staged(digests(docs, id_col, text_col, carry), "digests", keep=True)
        first = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i")))
        best = staged(rows.groupBy("digest").agg(first.getField("i").alias("keep_id"), F.count("*").alias("group_size")), "digest-groups")
        known = index.read().select(F.col("digest").alias("known"))
        index.append(best.join(known.hint("merge"), F.col("digest") == F.col("known"), "left_anti"))
        # The index now holds every digest of the batch; what it says of each is what stays.
        said = best.select("digest", "group_size").join(index.read().hint("merge"), "digest")
        groups = staged(said, "digest-decisions", keep=True)
        if own:
            index.close()
    out = attach_group(rows, groups, "digest", "group_size", rows.count())
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), *carry,
    )
