"""Upserts into a partitioned Parquet table that a killed job can repeat: prepared aside, noted in a journal, then applied."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.guards import ContractError, require_unique
from . import paths


class JournaledTable:
    """A table of rows with a key, partitioned by one column; batches have names and are taken once.

    A batch's touched partitions are merged and written aside; a journal entry then makes the batch count, and only after
    that are the partitions overwritten.  Until the entry is there nothing happened; once it is, any later session finishes
    the overwrite, which may be repeated, before it goes on.  Readers take prepared partitions from aside, so they see a
    batch whole or not at all.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], partition: str) -> None:
        self.spark, self.path, self.keys, self.partition = spark, path.rstrip("/"), keys, partition
        self.data, self.aside, self.notes = f"{self.path}/data", f"{self.path}/prepared", f"{self.path}/journal"

    def batches(self) -> dict[str, str]:
        """State of each batch that counts: prepared or done."""
        return {n.removesuffix(".json"): json.loads(paths.read_text(self.spark, f"{self.notes}/{n}"))["state"] for n in paths.names(self.spark, self.notes) if n.endswith(".json")}

    def _note(self, batch: str, state: str, schema: str, touched: list) -> None:
        paths.write_text(self.spark, f"{self.notes}/{batch}.json", json.dumps({"batch": batch, "state": state, "schema": schema, "partitions": touched}, default=str))

    def _entry(self, batch: str) -> dict:
        return json.loads(paths.read_text(self.spark, f"{self.notes}/{batch}.json"))

    def read(self) -> DataFrame | None:
        """All rows, with prepared batches' partitions from aside; None before the first batch."""
        waiting = [b for b, s in self.batches().items() if s == "prepared"]
        out = self.spark.read.parquet(self.data) if paths.exists(self.spark, self.data) else None
        for b in waiting:
            held = self.spark.read.parquet(f"{self.aside}/{b}")
            rest = out.join(F.broadcast(held.select(self.partition).distinct()), self.partition, "left_anti") if out is not None else None
            out = held if rest is None else rest.select(held.columns).unionByName(held)
        return out

    def _apply(self, batch: str) -> None:
        held = self.spark.read.parquet(f"{self.aside}/{batch}")
        held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition).parquet(self.data)
        entry = self._entry(batch)
        self._note(batch, "done", entry["schema"], entry["partitions"])
        paths.remove(self.spark, f"{self.aside}/{batch}")

    def recover(self) -> list[str]:
        """Finish batches that count but were not applied, and drop what others left aside; the finished ones."""
        states = self.batches()
        finished = [b for b, s in states.items() if s == "prepared"]
        for b in finished:
            self._apply(b)
        for left in paths.names(self.spark, self.aside):
            if states.get(left) != "prepared":
                paths.remove(self.spark, f"{self.aside}/{left}")
        return finished

    def upsert(self, batch: str, rows: DataFrame, stop: str | None = None) -> bool:
        """Take a batch: rows replace those of equal keys, which lie in the same partition; False if it was taken before.

        Keys must be unique in the batch and, as all columns of the partition, not NULL.  Only partitions that the batch
        touches are read and written.  stop ends the job before a step (prepare, note, apply), for tests of recovery.
        """
        if "/" in batch or not batch:
            raise ContractError("a batch needs a name without slashes")
        self.recover()
        if batch in self.batches():
            return False
        require_unique(rows, sorted({*self.keys, self.partition}))
        touched = rows.select(self.partition).distinct()
        old = self.spark.read.parquet(self.data) if paths.exists(self.spark, self.data) else None
        merged = rows
        if old is not None:
            # Partitions of a batch are few: their values prune the scan.
            values = [r[0] for r in touched.collect()]
            kept = old.where(F.col(self.partition).isin(values)).join(rows.select(*self.keys).distinct(), self.keys, "left_anti")
            merged = kept.unionByName(rows, allowMissingColumns=True)
        if stop == "prepare":
            return False
        merged.repartition(self.partition).write.mode("overwrite").parquet(f"{self.aside}/{batch}")
        if stop == "note":
            return False
        self._note(batch, "prepared", merged.schema.simpleString(), [r[0] for r in self.spark.read.parquet(f"{self.aside}/{batch}").select(self.partition).distinct().collect()])
        if stop == "apply":
            return False
        self._apply(batch)
        return True
