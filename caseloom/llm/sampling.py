"""Problem 1: a sample that stays the same in every run and only grows as data grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Scratch, hot_keys, salted_lookup

_BITS = 52
#: Batches of numbers that are read side by side before they are written as one.
MERGED = 16


def permanent_number(identity: Column, seed: int) -> Column:
    """The uniform value in [0, 1) an identifier gets at first sight: 52 bits of its digest with the seed."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), identity), 256), 1, _BITS // 4), 16, 10).cast("double") / float(1 << _BITS)


class PermanentSample:
    """Permanent random numbers kept in a folder; a sample opened there again goes on where it was.

    ``insert`` gives a value to each identifier that has none yet (anti-join) and never touches another; ``select``
    takes the identifiers under a threshold. The threshold is kept too and never falls: asking for a smaller share than
    before gives the earlier, larger one, so what was chosen once stays chosen. Each insert is a batch with a number of
    its own and written whole, so a batch that broke off is replaced by its repetition. MERGED batches become one table.

    Identifiers are compared as written. A null identifier is none, so its row gets one of its own from ``fallback``."""

    def __init__(self, folder: Scratch, seed: int = 0):
        self.folder, self.seed, self.batches, self.first = folder, seed, 0, 0
        self.known: DataFrame | None = None
        if folder.has("merged"):
            # The newest whole table of merged batches; older ones and its batches may still lie beside it.
            at = max((n for n in folder.names("merged") if folder.has(f"merged/{n}/_SUCCESS")), key=lambda n: int(n.split("=")[1]), default=None)
            if at is not None:
                self.first = self.batches = int(at.split("=")[1])
                self.known = folder.spark.read.parquet(f"{folder.root}/merged/{at}")
        while folder.has(f"numbers/batch={self.batches}/_SUCCESS"):
            self._add(folder.spark.read.parquet(f"{folder.root}/numbers/batch={self.batches}"))
        self.threshold = folder.spark.read.parquet(f"{folder.root}/thresholds").agg(F.max("share")).first()[0] if folder.has("thresholds/_SUCCESS") else 0.0

    def _add(self, batch: DataFrame) -> None:
        self.batches += 1
        self.known = batch if self.known is None else self.known.unionByName(batch)

    def _merge(self) -> None:
        """Writes all numbers as one table; only once it is whole do those it was made of go."""
        merged = self.folder.keep(self.known, f"merged/upto={self.batches}")
        self.folder.drop(*[f"numbers/batch={n}" for n in range(self.first, self.batches)], *([f"merged/upto={self.first}"] if self.first else []))
        self.known, self.first = merged, self.batches

    @staticmethod
    def identity(identifier: Column, fallback: Column) -> Column:
        return F.coalesce(F.concat(F.lit("id:"), identifier), F.concat(F.lit("row:"), fallback.cast("string")))

    def insert(self, rows: DataFrame, identifier: Column, fallback: Column) -> None:
        if self.batches - self.first >= MERGED:
            self._merge()
        fresh = rows.select(self.identity(identifier, fallback).alias("identity")).distinct()
        if self.known is not None:
            fresh = fresh.join(self.known, "identity", "left_anti")
        self._add(self.folder.keep(fresh.withColumn("u", permanent_number(F.col("identity"), self.seed)), f"numbers/batch={self.batches}"))

    def select(self, share: float) -> DataFrame:
        """The chosen ``identity`` and its value ``u``."""
        if self.known is None:
            raise ValueError("nothing has been inserted")
        if share > self.threshold:
            self.threshold = share
            self.folder.spark.createDataFrame([(share,)], "share double").coalesce(1).write.mode("append").parquet(f"{self.folder.root}/thresholds")
        return self.known.where(F.col("u") < self.threshold)

    def rows(self, rows: DataFrame, identifier: Column, fallback: Column, share: float) -> DataFrame:
        """The rows of chosen identifiers with ``identity`` and ``u``, which replace columns of these names; rows of a
        hot identifier are spread."""
        marked = rows.drop("identity", "u").withColumn("identity", self.identity(identifier, fallback))
        return salted_lookup(marked, self.select(share), "identity", hot_keys(marked, "identity"), F.xxhash64(fallback))


def grown_sample(rows: DataFrame, arrivals: list[Column], identifier: Column, fallback: Column, share: float, folder: Scratch, seed: int = 0) -> DataFrame:
    """Rows of a sample built up delivery by delivery: ``arrivals`` are conditions, inserted in turn."""
    sample = PermanentSample(folder, seed)
    for arrived in arrivals:
        sample.insert(rows.where(arrived), identifier, fallback)
    return sample.rows(rows, identifier, fallback, share)
